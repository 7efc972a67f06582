"""Near-duplicate embeddings (operator 6): random-hyperplane tables, exact cosine, components.

Equal vectors are one node with a count. A node's side of ``bits`` random hyperplanes is its bucket in a
table; two vectors at the threshold's angle share a bucket of one table with probability
(1 - angle / pi) ** bits, and there are so many tables that a pair at the threshold shares a bucket of
some table with probability ``RECALL`` at least; closer pairs do more surely. ``bits`` grows with the
logarithm of the number of nodes, so that buckets keep their mean size.

What is dealt to the buckets is not the vectors but sketches of 256 bits, of more hyperplanes: a node goes on, with its vector, only in those buckets where some sketch is
near its own. What goes on is compared by exact cosine in double precision. A bucket of more than ``TILE``
nodes is cut into blocks, and each pair of blocks is one task's work. A pair that meets in several
tables is counted in the first of them alone. Each task returns a row per linked node, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .groups import merge, whole_groups

THRESHOLD = 0.9
RECALL = 0.996
BUCKET = 1024
TILE = 4096
SEED = 20_240_607
#: Words of 64 bits of a sketch, and standard deviations by which sketches of linked vectors may differ beyond the mean.
WORDS, SPREAD = 4, 4.5


def plan(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, nodes) / BUCKET)) if nodes > BUCKET else 4))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _codes(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(SEED).standard_normal((units.shape[1], tables * bits))
    sides = (units @ planes > 0).reshape(len(units), tables, bits)
    return (sides @ (1 << np.arange(bits))).astype(np.int32)


def _pack(x: np.ndarray) -> bytes:
    """A vector's bytes: in single precision where that loses nothing."""
    short = x.astype(np.float32)
    return (short if np.array_equal(short, x) else x).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * size else np.float64).astype(np.float64)


def _usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _sketches(units: np.ndarray) -> np.ndarray:
    """More sides of each vector, as words."""
    planes = np.random.default_rng(SEED + 1).standard_normal((units.shape[1], 64 * WORDS))
    return np.packbits(units @ planes > 0, axis=1, bitorder="little").view(np.uint64)


def apart(threshold: float = THRESHOLD) -> int:
    """Sketch bits in which two vectors at the threshold may differ: the mean and SPREAD standard deviations (one such pair in 300,000 differs in more)."""
    p, n = math.acos(threshold) / math.pi, 64 * WORDS
    return math.ceil(n * p + SPREAD * math.sqrt(n * p * (1 - p)))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length."""
    for b in batches:
        sizes = np.array([len(x) for x in b.column("vector")], np.int64)
        for size in np.unique(sizes):
            part = b.filter(pa.array(sizes == size))
            yield part, np.asarray(part.column("vector").flatten(), np.float64).reshape(-1, size)


CELL = ["size", "bucket", "low", "high"]


def _cells(dealt: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of a bucket with block, low, high: all zero, or for a hot bucket once for each cell (pair of blocks) that the row's block is in."""
    dealt = dealt.join(hot, (F.col("size") == F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("s", "b", "blocks", "other")


def candidates(nodes: DataFrame, scratch: Scratch, bits: int, tables: int) -> DataFrame:
    """size, bucket, low, high, block, node: the nodes of each cell that have a sketch near another's there. Vectors are not shuffled for it."""
    most, names = apart(), [f"s{i}" for i in range(WORDS)]

    def buckets(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = _unit(vectors)
        return (np.arange(tables, dtype=np.int64) << np.int64(bits)) + _codes(units, bits, tables), _sketches(units)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, vectors in _arrays(batches):
            bucket, n = np.unique(buckets(vectors)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), vectors.shape[1], np.int32)), pa.array(bucket), pa.array(n)], names=["size", "bucket", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _arrays(batches):
            bucket, sketch = buckets(vectors)
            size, words = pa.array(np.full(len(vectors), vectors.shape[1], np.int32)), [pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(WORDS)]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([size, pa.array(bucket[:, t]), part.column("node"), *words], names=["size", "bucket", "node", *names])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, CELL):
            block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
            sketch = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names])
            met = np.zeros(table.num_rows, bool)
            for a, z in zip(begins.tolist(), np.append(begins[1:], table.num_rows).tolist(), strict=True):
                for s in range(a, z, 256):
                    e = min(z, s + 256)
                    differ = sum(np.bitwise_count(w[s:e, None] ^ w[None, a:z]) for w in sketch) <= most
                    differ[np.arange(e - s), np.arange(s - a, e - a)] = False
                    if low[a] != high[a]:
                        differ &= block[s:e, None] != block[None, a:z]
                    met[s:e] |= differ.any(axis=1)
            out = table.select([*CELL, "block", "node"]).filter(pa.array(met))
            yield from out.combine_chunks().to_batches()

    vectors = nodes.select("node", "vector")
    hot = vectors.mapInArrow(count, "size int, bucket long, n long").groupBy("size", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > TILE)
    hot = scratch.keep(hot.select(F.col("size").alias("s"), F.col("bucket").alias("b"), F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "hot")
    dealt = _cells(vectors.mapInArrow(emit, f"size int, bucket long, node long, {', '.join(f'{x} long' for x in names)}"), hot).select(*CELL, "block", "node", *names)
    found = dealt.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(near, "size int, bucket long, low int, high int, block int, node long")
    return scratch.keep(found, "candidates")


def link(nodes: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """nodes: node (long), n_rows (long), vector (array<double>). Returns node, root, added: a row for each task in which a node has a link.

    ``root`` is a node of its component, ``added`` the rows linked to it whose link is counted there.
    """
    bits, tables = plan(n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _arrays(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n_rows"), pa.array([_pack(x) for x in vectors], pa.binary())], names=["_node", "n_rows", "raw"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, CELL):
            node, n_rows = table.column("node").to_numpy(), table.column("n_rows").to_numpy()
            block, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
            first = table.column("bucket").to_numpy() >> bits
            raws, sizes = table.column("raw").combine_chunks(), table.column("size").to_numpy()
            label, added = np.arange(len(node)), np.zeros(len(node), np.int64)
            for a, z in zip(begins.tolist(), np.append(begins[1:], len(node)).tolist(), strict=True):
                if z - a < 2:
                    continue
                x = _unit(np.stack([_unpack(v.as_py(), sizes[a]) for v in raws[a:z]]))
                c = _codes(x, bits, tables)[:, : int(first[a])]
                across = low[a] != high[a]
                for s in range(0, z - a, 512):
                    i, j = np.nonzero(x[s : s + 512] @ x.T >= THRESHOLD)
                    i = i + s
                    keep = (i < j) & (block[a + i] != block[a + j] if across else True)
                    i, j = i[keep], j[keep]
                    if len(i):
                        label = merge(label, a + i, a + j)
                        new = ~(c[i] == c[j]).any(axis=1)
                        np.add.at(added, a + i[new], n_rows[a + j[new]])
                        np.add.at(added, a + j[new], n_rows[a + i[new]])
            linked = np.flatnonzero((label != np.arange(len(node))) | (added > 0))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]]), pa.array(added[linked])], names=["node", "root", "added"])

    packed = nodes.select("node", "n_rows", "vector").mapInArrow(pack, "_node long, n_rows long, raw binary")
    rows = candidates(nodes, scratch, bits, tables).join(packed, F.col("node") == F.col("_node")).drop("_node")
    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(compare, "node long, root long, added long")


def near_duplicates(df: DataFrame, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, at cosine ``THRESHOLD`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths don't link. Equal vectors link with each other: a row's n_links counts the other rows of
    its node and all rows of linked nodes. component_id is the smallest vec_id of the component; rows
    without links are their own. A null vec_id takes part but is not a component_id unless all are null;
    repeated rows count one by one. An empty table gives an empty one.
    """
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = df.where(_usable(vector)).select(F.col(vec_id).alias("vec"), x.alias("vector")).withColumn("node", F.xxhash64("vector"))
    rows = rows.withColumn("check", F.xxhash64(F.lit(1), "vector"))
    grouped = rows.groupBy("node", "check").agg(F.count("*").alias("n_rows"), F.min("vec").alias("least"), F.first("vector").alias("vector"))
    nodes = scratch.keep(grouped.drop("check"), "nodes")
    n = nodes.count()
    links = scratch.keep(link(nodes, scratch, n), "links")
    of = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    more = links.groupBy(F.col("node").alias("_n")).agg(F.sum("added").alias("added"))
    known = nodes.select("node", "n_rows", "least").join(more, F.col("node") == F.col("_n"), "left")
    of = of.select(F.col("node").alias("_m"), "component")
    known = known.join(of, F.col("node") == F.col("_m"), "left").select("node", "least", F.coalesce("component", "node").alias("root"), (F.col("n_rows") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"))
    known = scratch.keep(known, "known")
    roots = known.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    known = known.join(roots, F.col("root") == F.col("_r")).select(F.col("node").alias("_k"), "n_links", "component_id")
    linked = rows.select(F.col("vec").alias(vec_id), F.col("node").alias("_node"))
    alone = df.where(~_usable(vector)).select(F.col(vec_id), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    out = linked.join(known, F.col("_node") == F.col("_k")).select(vec_id, "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
