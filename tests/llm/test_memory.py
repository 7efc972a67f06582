"""Memory of Python workers: texts come in small batches, and what they took goes back to the system."""

import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
import pytest
from conftest import ROOT

from cadenza.llm import op08_bpe

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A worker's life outside Spark: the encoder is loaded by one text, then batches of 40 MB come by a stream; MB of memory that it has more of afterwards.
WORKER = """
import gc, re, sys
import public_tokenizers, pyarrow as pa
from pyspark.sql.types import StructType
from cadenza.llm import op08_bpe

class Frame:
    columns = ["doc_id", "text"]
    schema = StructType().add("doc_id", "long").add("text", "string")
    select = lambda self, *names: self
    mapInArrow = lambda self, run, schema: run

def held():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def spent(batches):
    n = sum(b.num_rows for b in op08_bpe.encode(Frame(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)(batches))
    gc.collect()
    return n

def table(n, k):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([k] * n, pa.int64()), "text": pa.array([f"the cat sat on mat {k} " * (200 + i % 50) for i in range(n)])})

def stream():
    with open(sys.argv[1], "rb") as f:
        yield from pa.ipc.open_stream(f)

if len(sys.argv) > 2:
    with pa.OSFile(sys.argv[1], "wb") as f, pa.ipc.new_stream(f, table(1, 0).schema) as out:
        for k in range(3):
            out.write_batch(table(8000, k))
else:
    spent(iter([table(1, 0)]))
    before = held()
    assert spent(stream()) == 24_000
    print(held() - before)
"""


def test_texts_come_in_small_batches(spark, monkeypatch):
    def sizes(df, *_):
        return df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")

    monkeypatch.setattr(op08_bpe, "round_trip", sizes)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "string(id) as text")
    before = spark.conf.get(BATCH)
    try:
        for own, most in ((before, 1000), ("7", 7), ("0", 1000)):
            spark.conf.set(BATCH, own)
            got = [r["n"] for r in corpus_pipeline.encoding(spark, docs, "").collect()]
            assert sum(got) == 3000 and max(got) == most
            assert spark.conf.get(BATCH) == own
    finally:
        spark.conf.set(BATCH, before)


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_gives_back_what_texts_took(tmp_path):
    for more in (["write"], []):
        out = subprocess.run([sys.executable, "-c", WORKER, str(tmp_path / "texts"), *more], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert float(out) < 20
