"""Byte-level BPE encoding and decoding (operator 8)."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import PieceEncoder, decode_bytes, read_ranks, token_table, tokenizer_from_ranks
from .common import lean

_encoders: dict[tuple[str, str], tuple[PieceEncoder, list[bytes]]] = {}


def encoder(ranks_path: str, pattern: str) -> tuple[PieceEncoder, list[bytes]]:
    """The encoder and token table of a rank file, built once per worker process."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        tokenizer = tokenizer_from_ranks(read_ranks(ranks_path))
        _encoders[key] = (PieceEncoder(tokenizer, pattern), token_table(tokenizer))
    return _encoders[key]


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``: the token ids of each whole text as little-endian unsigned 32-bit integers (binary).

    Null and empty texts give no ids; rows, ties and repeats stay as they are. A column named like
    ``ids`` is replaced. One pass over Arrow batches, no shuffle.
    """
    rest = [c for c in df.columns if c != ids]
    schema = df.select(*rest).schema.add(ids, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(ranks_path, pattern)
        for b in batches:
            out = pa.array([x for run in itertools.batched(_texts(b.column(rest.index(text))), 256) for x in enc.encode_many(list(run))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*rest, ids])

    return df.select(*rest).mapInArrow(lean(run), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Append ``into``: the bytes that the ids stand for. The bytes of a split character are joined again. Null ids: empty."""
    rest = [c for c in df.columns if c != into]
    schema = df.select(*rest).schema.add(into, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _, table = encoder(ranks_path, pattern)
        for b in batches:
            out = [decode_bytes(np.frombuffer(x.as_py() or b"", "<u4"), table) for x in b.column(rest.index(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*rest, into])

    return df.select(*rest).mapInArrow(lean(run), schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, with ids and bytes never leaving the worker.

    A null or empty text has no tokens and the digests of nothing. Repeated rows and null doc_ids stay, an empty table gives an empty one, and other
    columns, whatever their names, are not read. A very long text goes through in runs of its pieces. One pass over Arrow batches.
    """
    key = df.select(doc_id).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc, table = encoder(ranks_path, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in (x for run in itertools.batched(_texts(b.column(1)), 256) for x in enc.encode_many(list(run))):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(decode_bytes(np.frombuffer(ids, "<u4"), table)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{doc_id}` {key.dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(doc_id, text).mapInArrow(lean(run), schema)
