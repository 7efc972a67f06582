"""Token ids in directly addressable codes (operator 5).

An id is cut into chunks of ``BITS`` bits, lowest first. Level 0 holds the first chunk of every id;
a bitmap tells which ids go on; level k+1 holds the next chunk of those alone. A rank directory counts
the set bits before every block of 512, so the place of an id's next chunk is one directory entry and
at most eight words of popcounts away: any token can be read without decoding those before it.

A segment is a few documents, written as one byte string:

    magic "DAC1", then unsigned 32-bit: bits, levels, documents
    signed 64-bit: null marks and ids of the documents; unsigned 64-bit: where each document's tokens begin, and the end
    for each level: unsigned 64-bit number of chunks, the chunks in whole bytes, and but for the last level
    the bitmap (64-bit words, lowest bit first) and the rank directory (unsigned 32-bit)
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PieceEncoder, tokenizer_from_json
from .common import Scratch

BITS = 8
BLOCK = 512
#: Ids after which a segment is closed; a document is never cut.
SEGMENT_IDS = 500_000
#: Pieces that a worker remembers.
PIECES = 800_000
MAGIC = b"DAC1"


class Codes:
    """A sequence of unsigned integers under 2**32 in directly addressable codes of whole bytes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]):
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], np.asarray(ids, dtype=np.uint32)
        while True:
            chunk, above = rest.astype(np.uint8), rest >> BITS
            on = above > 0
            if not on.any():
                levels.append((chunk, None, None))
                return cls(levels)
            bits = np.packbits(on, bitorder="little")
            words = np.zeros(-(-len(on) // BLOCK) * BLOCK // 64, np.uint64)
            words.view(np.uint8)[: len(bits)] = bits
            counts = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            levels.append((chunk, words, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)))
            rest = above[on]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def access(self, i: int) -> int:
        """The i-th integer, from one chunk of each of its levels."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunk, words, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (BITS * level)
            if words is None or not (int(words[i // 64]) >> (i % 64)) & 1:
                return value
            first = i // BLOCK * (BLOCK // 64)
            whole = int(np.bitwise_count(words[first : i // 64]).sum())
            i = int(ranks[i // BLOCK]) + whole + (int(words[i // 64]) & ((1 << (i % 64)) - 1)).bit_count()
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The integers from start to stop: the first one's place in each level by rank, the rest by counting on."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for level, (chunk, words, ranks) in enumerate(self.levels):
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(BITS * level)
            if words is None or stop <= start:
                break
            low = start // 64
            bits = np.unpackbits(words[low : -(-stop // 64)].view(np.uint8), bitorder="little")[start - low * 64 : stop - low * 64].astype(bool)
            first = start // BLOCK * (BLOCK // 64)
            start = int(ranks[start // BLOCK]) + int(np.bitwise_count(words[first:low]).sum()) + (int(words[low]) & ((1 << (start % 64)) - 1)).bit_count()
            where = where[bits]
            stop = start + len(where)
        return out

    def to_bytes(self) -> bytes:
        parts = []
        for chunk, words, ranks in self.levels:
            parts += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
            if words is not None:
                parts += [words.astype("<u8").tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, levels: int, at: int = 0) -> Codes:
        out = []
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            if k == levels - 1:
                out.append((chunk, None, None))
            else:
                blocks = -(-n // BLOCK)
                words = np.frombuffer(data, "<u8", blocks * BLOCK // 64, at)
                at += words.nbytes
                ranks = np.frombuffer(data, "<u4", blocks, at)
                at += ranks.nbytes
                out.append((chunk, words, ranks))
        return cls(out)


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    begins = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    codes = Codes.encode(np.frombuffer(b"".join(ids), "<u4"))
    head = MAGIC + struct.pack("<3I", BITS, len(codes.levels), len(doc_ids))
    nulls = np.array([x is None for x in doc_ids], dtype="<i8")
    return head + nulls.tobytes() + np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + begins.tobytes() + codes.to_bytes()


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    bits, levels, n = struct.unpack_from("<3I", data, 4)
    if bits != BITS:
        raise ValueError(f"chunks of {bits} bits")
    nulls = np.frombuffer(data, "<i8", n, 16)
    ids = np.frombuffer(data, "<i8", n, 16 + 8 * n)
    begins = np.frombuffer(data, "<u8", n + 1, 16 + 16 * n)
    return [None if z else int(x) for z, x in zip(nulls, ids, strict=True)], begins, Codes.from_bytes(data, levels, 16 + 16 * n + 8 * (n + 1))


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def _encoder(path: str, pattern: str) -> PieceEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = PieceEncoder(tokenizer_from_json(path), pattern, Tokenizer.from_file(path), PIECES)
    return _encoders[path, pattern]


SEGMENTS = "part int, sequence long, before long, n_docs long, n_ids long, segment binary"


def write(df: DataFrame, scratch: Scratch, tokenizer_path: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write segments in ascending order of doc_id.

    The rows are dealt by ranges of doc_id and sorted within a part; each part is cut into segments of
    about ``SEGMENT_IDS`` ids, each a row (part, sequence) of a Parquet
    table in the shared folder, with the number of the part's ids before it. Null
    texts count as empty; null ids come first; rows with one doc_id are ordered by their text, equal rows stay. A task holds
    one segment's ids, and at least those of one document: a very long text is one segment. An empty table writes none. Other columns, whatever their
    names, are not read.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, end = _encoder(tokenizer_path, pattern), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        docs: list[int | None] = []
        ids: list[bytes] = []
        held = sequence = before = 0

        def flush() -> pa.RecordBatch:
            row = [part, sequence, before, len(docs), held, write_segment(docs, ids)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "sequence", "before", "n_docs", "n_ids", "segment"])

        for b in batches:
            texts = (t.as_py() or "" for t in b.column(1))
            encoded = (x for run in itertools.batched(texts, 256) for x in enc.encode_many(list(run)))
            for d, x in zip(b.column(0).to_pylist(), encoded, strict=True):
                ids.append(x + end)
                docs.append(d)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
                    docs, ids, held, before, sequence = [], [], 0, before + held, sequence + 1
        if docs:
            yield flush()

    rows = df.select(F.col(doc_id).cast("long").alias("_d"), F.col(text).alias("_t"))
    rows = rows.repartitionByRange(parts, F.col("_d").asc_nulls_first()).sortWithinPartitions(F.col("_d").asc_nulls_first(), F.col("_t").asc_nulls_first())
    return scratch.keep(rows.mapInArrow(run, SEGMENTS), "segments")


def read(segments: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document from the written segments: doc_id, start (ids before it), n_tokens, ids_crc32.

    A segment knows the ids before it in its part; those of earlier parts are summed from a row per part,
    of which there are at most as many as the partitions of the write, and broadcast. No segments give no rows.
    """
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    parts = parts.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_parts"))
    rows = segments.join(F.broadcast(parts), "part").select((F.col("_parts") + F.col("before")).alias("base"), "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs, begins, codes = read_segment(data.as_py())
                begins = begins.astype(np.int64)
                crcs = [zlib.crc32(codes.slice(i, j).astype("<u4").tobytes()) for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins[:-1] + base, pa.int64()), pa.array(np.diff(begins), pa.int64()), pa.array(crcs, pa.int64())], names=[doc_id, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, f"`{doc_id}` long, start long, n_tokens long, ids_crc32 long")
