"""SimHash near-duplicates (operator 7): fingerprints, a Gray-order hierarchical index, components.

Two fingerprints that differ in at most three of 64 bits agree on at least one of four quarters of
the bits. Every distinct fingerprint is therefore dealt to four groups, by the value of each quarter,
and each group is searched with a hierarchical index: its codes are sorted by Gray rank, so that
neighbours share long bit patterns; the bits that all codes below a node share are kept as that node's
masked pattern; a search goes down from the root, adds up the differences on the bits that each level
newly fixes, and leaves a whole subtree once they exceed the limit.

A group of more than ``GROUP`` codes (a quarter that very many texts share) is dealt again, by quarters
of the bits that are not fixed yet, and so on; this loses no pair, as the three differing bits lie among
the free bits. Groups are bounded at every level, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import connected_components
from .groups import merge, whole_groups

LIMIT = 3
FANOUT = 8
GROUP = 2048
GROUP_KEYS = ["kind", "cut", "value"]
#: Hot group keys, and ids, are broadcast up to so many rows (under 40 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
#: Codes that one search compares at most at a time.
FRONTIER = 1_000_000
#: Share of all shingles (by hash) that the first pass over the texts counts.
FIRST = 1 / 3
#: Shingles of a part's texts that one task holds at most, and texts of a larger part that every task of it has.
CELL = 1_000_000
PIVOTS = 16


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(w) - words + 1))


def majority(hashes: list[np.ndarray], limit: int = 65_536) -> np.ndarray:
    """A fingerprint for each array: the bits that over half of its hashes have set; zero for an empty array."""
    out = np.zeros(len(hashes), np.uint64)
    for k, h in enumerate(hashes):
        if len(h):
            counts = np.zeros(64)
            for i in range(0, len(h), limit):  # whole numbers under 2 ** 24 are exact in single precision
                bits = np.unpackbits(np.ascontiguousarray(h[i : i + limit], dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
                counts += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
            out[k] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (long: the 64 bits, signed) of every whole text; null texts count as empty."""
    key = df.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = majority([h for x in b.column(1) for h in [shingle_hashes(x.as_py() or "")]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], names=[doc_id, "code"])

    return df.select(doc_id, text).mapInArrow(lean(run), f"`{doc_id}` {key}, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(s))
    return out


class GrayIndex:
    """The index over groups of codes. codes: sorted by group and Gray rank; begins: where each group begins."""

    def __init__(self, codes: np.ndarray, begins: np.ndarray):
        self.codes = codes
        sizes = np.diff(np.append(begins, len(codes)))
        self.root = np.repeat(np.arange(len(begins)), sizes)
        self.cost = np.repeat(sizes, sizes)
        #: From the leaves up: (bits that all codes below share, their values, first child, children).
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes, None, None)]
        low, high = codes, codes
        while True:
            sizes = np.diff(np.append(begins, len(low)))
            nodes = -(-sizes // FANOUT)
            ends = np.cumsum(nodes)
            first = np.repeat(begins - (ends - nodes) * FANOUT, nodes) + np.arange(ends[-1]) * FANOUT
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            shared = ~(low ^ high)
            children = np.diff(np.append(first, sizes.sum()))
            self.levels.append((shared, low & shared, first, children))
            begins = ends - nodes
            if nodes.max() == 1:
                return

    def links(self, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places i < j of one group whose codes differ in at most ``limit`` bits."""
        slices = np.cumsum(self.cost) // FRONTIER
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(self.codes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            query, node = np.arange(a, b), self.root[a:b]
            shared, value, _, _ = self.levels[-1]
            apart = np.bitwise_count((self.codes[query] ^ value[node]) & shared[node]).astype(np.int64)
            for (shared, _, first, children), (below, value, _, _) in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
                keep = apart <= limit
                query, node, apart = query[keep], node[keep], apart[keep]
                n = children[node]
                child = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                fixed = np.repeat(shared[node], n)
                query, apart = np.repeat(query, n), np.repeat(apart, n)
                apart = apart + np.bitwise_count((self.codes[query] ^ value[child]) & below[child] & ~fixed)
                node = child
            keep = (apart <= limit) & (query < node)
            yield query[keep], node[keep]


def _cuts(level: int, parts: int) -> list[int]:
    """The masks of a level: bits that its groups agree on, ``parts`` for each mask of the level before."""
    masks = [0]
    for _ in range(level):
        out = []
        for m in masks:
            free = [i for i in range(64) if not m >> i & 1]
            for part in np.array_split(free, parts):
                out.append(m | sum(1 << int(i) for i in part))
        masks = out
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(rows: DataFrame, limit: int) -> DataFrame:
    """Links within groups as (kind, src, dst): each code that has a link, with the first code of its component in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, GROUP_KEYS):
            codes = table.column("code").to_numpy().view(np.uint64)
            group = np.zeros(len(codes), np.int64)
            group[begins[1:]] = 1
            order = np.lexsort((gray_rank(codes), np.cumsum(group)))
            codes = codes[order]
            label = np.arange(len(codes))
            if len(codes) > len(begins):
                for i, j in GrayIndex(codes, begins).links(limit):
                    label = merge(label, i, j)
            linked = np.flatnonzero(label != np.arange(len(codes)))
            kind = table.column("kind").to_numpy()[order][linked]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(codes[linked].view(np.int64)), pa.array(codes[label[linked]].view(np.int64))], names=["kind", "src", "dst"])

    return rows.select(*GROUP_KEYS, "code").sortWithinPartitions(*GROUP_KEYS).mapInArrow(lean(run), "kind int, src long, dst long")


def link_codes(codes: DataFrame, scratch: Scratch, limit: int = LIMIT, name: str = "codes") -> DataFrame:
    """Edges (kind, src, dst) whose components are those of the links at ``limit`` or fewer bits among the distinct ``code`` values of each ``kind`` (int)."""
    found, level, parts, rows = [], 1, limit + 1, codes.select("kind", "code", F.lit(0).alias("cut"))
    while True:
        masks = F.array(*[F.lit(_signed(m)) for m in _cuts(level, parts)])
        dealt = rows.select("kind", "code", F.explode(F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda j: F.col("cut") * parts + j)).alias("cut"))
        dealt = dealt.withColumn("value", F.col("code").bitwiseAND(F.get(masks, F.col("cut"))))
        sizes = dealt.groupBy(*GROUP_KEYS).count().where(F.col("count") > GROUP).select(*GROUP_KEYS)
        hot = scratch.keep(sizes, f"{name}_hot_{level}", narrow=True)
        n = hot.count()
        side = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        work = dealt.join(side, GROUP_KEYS, "left_anti") if n else dealt
        found.append(scratch.keep(_search(work.repartition(*GROUP_KEYS), limit), f"{name}_links_{level}"))
        if not n:
            break
        rows = scratch.keep(dealt.join(side, GROUP_KEYS, "left_semi").select("kind", "code", "cut"), f"{name}_rows_{level}")
        level += 1
    edges = found[0]
    for x in found[1:]:
        edges = edges.union(x)
    return edges


def near_duplicates(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Rows of one fingerprint are one node; a node's links are found with ``link_codes``. component_id is the
    smallest doc_id of the component. Null and empty texts have fingerprint zero and link like any other. A
    null doc_id takes part, and is never a component_id unless its component has no other. Repeated rows stay,
    an empty table gives an empty one, and other columns are not looked at.
    """
    rows = scratch.keep(fingerprints(df, doc_id, text), "codes")
    nodes = scratch.keep(rows.groupBy("code").agg(F.min(doc_id).alias("least")), "nodes", narrow=True)
    of = connected_components(link_codes(nodes.select(F.lit(0).alias("kind"), "code"), scratch).select("src", "dst"), scratch)
    known = nodes.join(of, nodes["code"] == of["node"], "left").select("code", "least", F.coalesce("component", "code").alias("root"))
    known = scratch.keep(known, "known", narrow=True)
    roots = scratch.keep(known.groupBy("root").agg(F.min("least").alias("component_id")), "roots", narrow=True)
    known = known.join(roots, "root").select(F.col("code").alias("_code"), "component_id")
    out = rows.join(known, F.col("code") == F.col("_code"))
    return out.select(doc_id, F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def _node(text: str, seed: int = 0) -> int:
    """A text's identity: the hash of its lower-cased words."""
    return xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), seed) - (1 << 63)


def row_key(doc_id: str, text: str) -> Column:
    """A row's identity: the hash of its id and text, of which either may be null."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, text)


def profiles(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, key, node, check (a second hash of what node is a hash of), code (the fingerprint) of every whole text."""
    id_kind = df.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, checks, codes = [], [], []
            for x in b.column(2):
                t = x.as_py() or ""
                nodes.append(_node(t))
                checks.append(_node(t, 1))
                codes.append(majority([shingle_hashes(t)]).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(codes, pa.int64())], names=["id", "key", "node", "check", "code"])

    return df.select(doc_id, row_key(doc_id, text).alias("key"), text).mapInArrow(lean(run), f"id {id_kind}, key long, node long, check long, code long")


def _by_code(nodes: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Edges that join nodes whose codes are equal or linked, by way of a vertex for each such code."""
    codes = scratch.keep(nodes.groupBy("code").agg(F.count("*").alias("n")), "codes", narrow=True)
    links = link_codes(codes.select(F.lit(0).alias("kind"), "code"), scratch, limit)
    vertex = lambda c: F.xxhash64(F.lit(0), c)
    met = codes.where("n > 1").select("code").union(links.select("src")).union(links.select("dst")).distinct()
    return nodes.select("node", "code").join(met, "code").select(F.col("node").alias("src"), vertex("code").alias("dst")).union(links.select(vertex("src"), vertex("dst")))


def _room(size: int | np.ndarray, similarity: float):
    """How many shingles of a set of ``size`` a similar set may lack."""
    return np.floor((1 - similarity) * size + 1e-9)


def _shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(x.as_py() or "", words)) for x in texts]


def _ends(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rows by key, then by the first column: places of the first and last row of each key, all columns in that order, and where only one value is."""
    order = np.lexsort((columns[0], keys))
    keys, columns = keys[order], [c[order] for c in columns]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(keys)) - 1 if len(keys) else new
    return np.stack([new, last]), [keys, *columns], columns[0][new] == columns[0][last]


def _alone(df: DataFrame, text: str, similarity: float, words: int) -> DataFrame:
    """node of each text that has more shingles to itself than a similar text may lack, by the shingles of the first ``FIRST`` of all hashes.

    Of a shingle that many texts of a batch hold, two rows go on: no task reads very many rows of one shingle.
    """
    below = np.uint64(FIRST * (1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                texts = b.column(0).slice(s, 500)
                nodes = np.array([_node(x.as_py() or "") for x in texts], np.int64)
                sets = _shingle_sets(texts, words)
                room = np.array([_room(len(x), similarity) for x in sets], np.int32)
                first = [x[: np.searchsorted(x, below)] for x in sets]
                n = [len(x) for x in first]
                at, columns, one = _ends(np.concatenate(first), np.repeat(nodes, n), np.repeat(room, n))
                at = np.concatenate([at[0], at[1][~one]])
                yield pa.RecordBatch.from_arrays([pa.array(columns[0][at].view(np.int64)), pa.array(columns[1][at]), pa.array(columns[2][at])], names=["shingle", "node", "room"])

    each = df.select(text).mapInArrow(lean(run), "shingle long, node long, room int")
    own = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.min("room").alias("room")).where("node = other")
    return own.groupBy("node").agg(F.count("*").alias("n"), F.min("room").alias("room")).where("n > room").select("node")


def _candidates(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Edges whose components hold any two similar sets (node, shingles) together: each text meets the shingles of its prefix.

    The prefix of a set is its rarest shingles (by count, then hash), one more than a similar set may lack; of two similar sets the rarest
    common shingle is in both prefixes. Shingles of one set alone meet no other and are left out.
    """
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    counts = scratch.keep(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = each.join(counts, "shingle")
    own = Window.partitionBy("node")
    ranked = shared.withColumns({"place": F.row_number().over(own.orderBy("n", "shingle")), "met": F.count("*").over(own)})
    rest = F.floor((1 - similarity) * F.col("size") + 1e-9) + 1 - (F.col("size") - F.col("met"))
    return ranked.where(F.col("place") <= rest).select(F.col("node").alias("src"), F.xxhash64("shingle").alias("dst"))


def link_sets(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> np.ndarray:
    """Components of the links between similar sets: ``label`` (each set's component so far, by its first member) with them joined.

    Sets meet by the prefixes of their shingles, rarest first, as in ``_candidates``. Two sets of one component are not compared again, so that a large
    group of near copies costs a few comparisons for each.
    """
    label, n, size = label.copy(), len(sets), np.array([len(x) for x in sets], np.int64)
    if not size.sum():
        return label
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    alone = int((count == 1).sum())  # their ranks come first
    column = rank[column]
    doc = np.repeat(np.arange(n), size)
    column = column[np.lexsort((column, doc))]
    begin = np.cumsum(size) - size
    first = (np.arange(len(column)) - begin[doc] <= _room(size, similarity)[doc]) & (column >= alone)
    prefix, owner = column[first] - alone, doc[first]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    room = np.bincount(prefix, minlength=len(count) - alone)
    start, fill = np.cumsum(room) - room, np.zeros(len(room), np.int64)
    posting, mixed, mark = np.zeros(len(prefix), np.int64), np.zeros(len(room), bool), np.zeros(len(count), bool)

    def try_all(i: int, others: np.ndarray) -> None:
        for k in range(0, len(others), 256):
            js = others[k : k + 256]
            js = js[(label[js] != label[i]) & (np.minimum(size[js], size[i]) >= similarity * np.maximum(size[js], size[i]) - 1e-9)]
            if not len(js):
                continue
            ends = np.cumsum(size[js])
            places = np.repeat(begin[js] - ends + size[js], size[js]) + np.arange(ends[-1])
            mark[column[begin[i] : begin[i] + size[i]]] = True
            both = np.add.reduceat(mark[column[places]].astype(np.int64), ends - size[js])
            mark[column[begin[i] : begin[i] + size[i]]] = False
            for j in js[both >= similarity * (size[i] + size[js] - both) - 1e-9]:
                a, b = sorted((label[i], label[j]))
                if a != b:
                    label[label == b] = a

    for i in range(n):
        own = prefix[cuts[i] : cuts[i + 1]]
        for every in (False, True):  # the last member of each posting first; all members of those that still hold others
            open_ = own[fill[own] > 0]
            open_ = open_[mixed[open_] | (label[posting[start[open_]]] != label[i])]
            if not len(open_):
                break
            met = np.concatenate([posting[start[r] : start[r] + fill[r]] for r in open_]) if every else posting[start[open_] + fill[open_] - 1]
            try_all(i, np.unique(met))
        mixed[own] |= (fill[own] > 0) & (label[posting[start[own]]] != label[i])
        posting[start[own] + fill[own]] = i
        fill[own] += 1
    return label


def _exact(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: part, cell, pivot, node, known, shingles. Edges (part, src, dst) between similar nodes of a cell; ``known``: nodes with one value are linked.

    A component's edges go to its first pivot, or its smallest node if it has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["part", "cell"]):
            part, node, known, other = table.column("part").to_numpy(), table.column("node").to_numpy(), table.column("known").to_numpy(), ~table.column("pivot").to_numpy(zero_copy_only=False)
            raw = table.column("shingles").combine_chunks()
            raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
            held, at = raw.values.to_numpy().view(np.uint64), raw.offsets.to_numpy()
            for a, z in zip(begins.tolist(), np.append(begins[1:], len(node)).tolist(), strict=True):
                order = a + np.lexsort((node[a:z], other[a:z]))
                _, first, of = np.unique(known[order], return_index=True, return_inverse=True)
                label = link_sets([held[at[i] : at[i + 1]] for i in order], first[of], similarity)
                src, dst = node[order], node[order][label]
                linked = np.flatnonzero(src != dst)
                yield pa.RecordBatch.from_arrays([pa.array(part[order][linked]), pa.array(src[linked]), pa.array(dst[linked])], names=["part", "src", "dst"])

    keys = ["part", "cell"]
    return rows.select("part", "cell", "pivot", "node", "known", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "part long, src long, dst long")


def _within_parts(sets: DataFrame, of: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """sets: node, shingles; of: node, part. Edges (src, dst) whose components are those of the links within parts.

    A part of over ``CELL`` shingles is cut into cells. Each cell has the part's ``PIVOTS`` besides, so that most of a large group of near copies is
    found to be one component at once; only what isn't in it is then compared with all of the part, each cell with each cell of such texts.
    """
    sizes = of.groupBy("part").agg(F.sum("size").alias("all"), F.count("*").alias("n")).where("n > 1").select("part", F.ceil(F.col("all") / CELL).cast("int").alias("cells"))
    cut = scratch.keep(of.join(sizes, "part").select("node", "part", "cells", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("own")), "cut", narrow=True)
    kept = scratch.keep(sets.join(small_or_hashed(cut), "node"), "cut_sets")
    plain = kept.select("part", F.col("own").cast("long").alias("cell"), F.lit(False).alias("pivot"), "node", F.col("node").alias("known"), "shingles")
    large = cut.where("cells > 1")
    if not large.limit(1).count():
        return _exact(plain, similarity).select("src", "dst")
    few = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(3), "node").alias("h"), "node"))), 1, PIVOTS)
    # Of each cell the first ones by hash: a list is bounded by its cell.
    first = large.groupBy("part", "cells", "own").agg(few.alias("p")).groupBy("part", "cells").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, PIVOTS).alias("p"))
    first = scratch.keep(first.select("part", "cells", F.explode("p.node").alias("node")), "pivots", narrow=True)
    copies = kept.select("node", "shingles").join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "node")
    copies = copies.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)).alias("cell"), F.lit(True).alias("pivot"), "node", F.col("node").alias("known"), "shingles")
    found = scratch.keep(_exact(plain.unionByName(copies), similarity), "edges_1")
    main = found.join(first.select("part", F.col("node").alias("dst")), ["part", "dst"], "left_semi").select("part", "src", "dst").distinct()
    main = main.groupBy("part", "dst").agg(F.count("*").alias("n")).groupBy("part").agg(F.max_by("dst", F.struct("n", "dst")).alias("main"))
    inside = found.join(main, "part").where("dst = main").select("part", F.col("src").alias("node")).union(main.select("part", F.col("main").alias("node"))).distinct()
    state = large.join(inside.withColumn("_in", F.lit(True)), ["part", "node"], "left").join(main, "part", "left")
    state = scratch.keep(state.select("part", "node", "cells", "own", F.col("_in").isNull().alias("outside"), F.when(F.col("_in"), F.col("main")).otherwise(F.col("node")).alias("known")), "state", narrow=True)
    outside = state.where("outside")
    rounds = outside.join(kept.select("node", F.size("shingles").alias("size")), "node").groupBy("part").agg(F.ceil(F.sum("size") / CELL).cast("int").alias("rounds"))
    rounds = scratch.keep(rounds, "rounds", narrow=True)
    again = kept.select("node", "shingles").join(state, "node").join(rounds, "part")
    held = again.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).withColumn("cell", F.col("own").cast("long") * F.col("rounds") + F.col("k"))
    asks = again.where("outside").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    asks = asks.withColumn("cell", F.col("c").cast("long") * F.col("rounds") + F.pmod(F.xxhash64(F.lit(5), "node"), F.col("rounds")))
    columns = ["part", "cell", F.lit(False).alias("pivot"), "node", "known", "shingles"]
    more = _exact(held.select(*columns).union(asks.select(*columns)), similarity)
    return found.select("src", "dst").union(more.select("src", "dst"))


def similar_documents(df: DataFrame, scratch: Scratch, similarity: float = 0.8, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id, key (of the row's id and text), kept (the component's key to keep) of every row, where texts link that are similar or whose fingerprints link.

    Similar: the sets of their shingles of ``words`` words have a Jaccard similarity of ``similarity`` or more (the whole sequence is the
    shingle of a shorter text). Every such pair is found: texts with more shingles to themselves than a similar text may lack have none
    and are left out, first by a share of the shingles of all texts, then by all shingles of those that remain; the remaining
    ones meet by the rarest shingles of each. What these join is one part, whose texts lie together; within it again only texts that share one of
    their rarest shingles are compared, exactly (``link_sets``). A task returns an edge for each linked text, never pairs. Fingerprints link at ``LIMIT`` bits as in ``near_duplicates``, and nulls, empty
    texts, repeats and empty tables give the same.
    """
    rows = scratch.keep(profiles(df, doc_id, text), "profiles", texts=True)
    grouped = rows.groupBy("node").agg(F.min("key").alias("key"), F.min("code").alias("code"), (F.min("check") != F.max("check")).alias("clash"))
    nodes = scratch.keep(grouped, "texts")
    alone = scratch.keep(_alone(df, text, similarity, words), "alone", narrow=True, texts=True)
    left = scratch.keep(nodes.join(alone, "node", "left_anti").select("node", "key"), "left", narrow=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                sets = _shingle_sets(part.column(1), words)
                ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    whole = df.select(row_key(doc_id, text).alias("own"), F.col(text).alias("text")).join(small_or_hashed(left), F.col("own") == F.col("key"))
    sets = whole.select("node", "text").mapInArrow(lean(run), "node long, shingles array<long>").dropDuplicates(["node"])  # a row may be repeated
    sets = scratch.keep(sets, "sets", texts=True)
    of = connected_components(_candidates(sets, similarity, scratch), scratch).withColumnRenamed("node", "of")
    parts = sets.select("node", F.size("shingles").alias("size")).join(of, F.col("node") == F.col("of")).select("node", "size", F.col("component").alias("part"))
    parts = scratch.keep(parts, "parts", narrow=True)
    edges = scratch.keep(_within_parts(sets, parts, similarity, scratch).union(_by_code(nodes, LIMIT, scratch)), "edges")
    of = connected_components(edges, scratch, name="cc2").withColumnRenamed("node", "of")
    known = nodes.select("node", "clash").join(of, F.col("node") == F.col("of"), "left").select("node", "clash", F.coalesce("component", "node").alias("root"))
    known = scratch.keep(known, "known", narrow=True)
    # Rows of unlike texts whose hashes are equal are their own components: none goes for what it isn't.
    rows = scratch.keep(rows.join(known, "node").select("id", "key", F.when(F.col("clash"), F.col("key")).otherwise(F.col("root")).alias("root")), "rooted", narrow=True)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    roots = rows.groupBy("root").agg(first).select("root", F.col("first.id").alias("component_id"), F.col("first.key").alias("kept"))
    roots = scratch.keep(roots, "roots", narrow=True)
    return rows.join(roots, "root").select(F.col("id").alias(doc_id), "component_id", "key", "kept")


def keep_first(df: DataFrame, found: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component of ``found``: that of the smallest doc_id (a null one last), and of its texts one; of equal rows of id and text, the smallest.

    ``found`` is from ``similar_documents``, or has doc_id and component_id alone; the rows of an id are then all of one component, and the
    smallest text stays.
    """
    if "kept" in found.columns:
        keys = found.groupBy("key").agg(F.bool_or(F.col("key") == F.col("kept")).alias("stays"), F.count("*").alias("n")).withColumnRenamed("key", "__key")
        keys = scratch.keep(keys, "keys", narrow=True)
        rows = df.withColumn("__key", row_key(doc_id, text)).join(small_or_hashed(keys.where("not stays").select("__key")), "__key", "left_anti")
        many = keys.where("stays and n > 1").select("__key")
        if many.limit(1).count():
            names = [F.col(f"`{c}`") for c in df.columns]
            many = small_or_hashed(many)
            # By id and text too: rows that only share a hash all stay.
            one = rows.join(many, "__key", "left_semi").groupBy("__key", F.col(doc_id).alias("__id"), F.col(text).alias("__text")).agg(F.min(F.struct(*names)).alias("__row")).select("__row.*")
            return rows.join(many, "__key", "left_anti").select(*names).union(one)
        return rows.select(*df.columns)
    stays = F.col(doc_id).eqNullSafe(F.col("component_id"))
    ids = scratch.keep(found.groupBy(F.col(doc_id).alias("__id")).agg(F.count_if(stays).alias("__rows")), "ids", narrow=True)
    rows = df.join(small_or_hashed(ids.where("__rows = 0").select("__id")), F.col(doc_id).eqNullSafe(F.col("__id")), "left_anti")
    if ids.where("__rows > 1").limit(1).count():
        names = [c for c in df.columns if c not in (doc_id, text)]
        rows = rows.groupBy(doc_id).agg(F.min(F.struct(text, *names)).alias("__row")).select(doc_id, *[F.col("__row")[c].alias(c) for c in (text, *names)])
    return rows.select(*df.columns)


def small_or_hashed(rows: DataFrame) -> DataFrame:
    """The small side of a join with texts: broadcast if its counted rows are few, else dealt by hash so that texts need no sort."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")
