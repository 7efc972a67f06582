"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import itertools

import corpus_pipeline
import numpy as np
import pytest
from helpers import documents, empty
from test_ten_operators import brute_fingerprint, encoding, labelled

from cadenza.llm import op04_quality, op07_simhash, op09_mixing
from cadenza.llm.common import Scratch


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of both qualities with copies, repeated rows and odd rows, and their labels."""
    docs, labels = labelled(spark, 240)
    rows = docs.collect()
    copies = [(1000 + i, rows[i][1], *rows[i][2:]) for i in range(0, 240, 4)]
    odd = [(2000 + i, *r[1:]) for i, r in enumerate(documents(spark).collect())] + [rows[1]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([*rows, *copies, *odd], docs.schema).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "t")
    good = scratch.keep(corpus_pipeline.quality(spark, docs, folder), "good")
    net = op04_quality.train(*op04_quality.sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    tables = net.tables()
    want = [r for r in docs.collect() if op04_quality.probability(net, tables, (r["text"] or "").encode()) >= 0.3]
    assert sorted(map(str, good.collect())) == sorted(map(str, want))
    clean = [r for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 3]
    assert {r["doc_id"] for r in clean} <= {r["doc_id"] for r in good.collect()}

    single = scratch.keep(corpus_pipeline.near_duplicates(spark, good, folder), "single")
    rows = good.collect()
    codes = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    sets = {r["doc_id"]: set(op07_simhash.shingle_hashes(r["text"] or "", 5).tolist()) for r in rows}
    label = {i: i for i in codes if i is not None}
    for _ in range(10):
        for a, b in itertools.combinations(sorted(label), 2):
            if (codes[a] ^ codes[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    kept = [r["doc_id"] for r in single.collect()]
    assert sorted(kept, key=str) == sorted({i for i in label if label[i] == i} | {i for i in kept if i is None}, key=str)
    assert single.columns == columns

    mixed = scratch.keep(corpus_pipeline.mixing(spark, single, folder), "mixed")
    assert mixed.columns == columns
    took = [r["doc_id"] for r in mixed.collect()]
    assert len(took) == len(set(took)) and set(took) <= set(kept)
    again = [r["doc_id"] for r in op09_mixing.mix(single, scratch, share=0.9, epochs=1).collect()]
    assert sorted(took, key=str) == sorted(again, key=str)

    enc = encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in mixed.collect()}
    for r in corpus_pipeline.encoding(spark, mixed, folder).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
