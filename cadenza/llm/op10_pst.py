"""Language-model scores from a probabilistic suffix tree over bytes (operator 10).

A text is read as its lower-cased words joined by one space, then an end byte, after ``DEPTH`` start bytes (which UTF-8
doesn't hold): every token is the bytes of a word with what follows it, so the probability of the bytes is that of the
tokens. The tree keeps a context of two bytes or more if

- it occurs ``CONTEXT_LEAST`` times in the training texts, and
- its next-symbol distribution diverges from that of the context one byte shorter: the Kullback-Leibler
  divergence times the context's count reaches ``EVIDENCE`` nats per next symbol that it has met, or
- it is the suffix of a kept context.

These bounds are absolute, so that more text keeps more and longer contexts. The contexts of no byte and of one are always
kept; they are a table of 65,536 counts at most, the only part of the model that every task has. A kept context's distribution is
smoothed by that of its suffix: (n(s x) + STRENGTH p(x | suffix)) / (n(s) + STRENGTH), and the empty context's by equal shares.

The texts are packed into blocks. A block's distinct grams (a symbol after DEPTH bytes), with their counts in its training texts,
are dealt to shards by the last two bytes of the context: all longer contexts that end alike, their suffixes and their next symbols meet in one
shard, which builds that subtree alone. The same messages are the block's questions: a shard answers each with the grams' log
probabilities. Words go the same way, by their hash, and are answered with their counts. Messages are sorted integers in compressed
byte planes. Those of a shard are merged and answered ``CHUNK`` blocks at a time, so that no task holds what all blocks send.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_remainder

DEPTH = 6
FOLDS = 10
CONTEXT_LEAST = 16
EVIDENCE = 2.0
STRENGTH = 4.0
START, END = 0xFF, 10
#: Bytes of text of a block, positions that are looked at together, symbols for each shard, and blocks whose messages a task merges.
BLOCK_BYTES, WINDOW, SHARD_SYMBOLS, CHUNK = 8_000_000, 1_000_000, 8_000_000, 256
#: Base model: added to every count.
ADDED = 0.1
WORDS, GRAMS = 0, 1
#: Counts of one block's messages, and of several merged.
COUNT = (np.int32, np.int64)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def token_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, then that of the end."""
    return np.fromiter(map(xxhash.xxh64_intdigest, [*words, b"\n"]), np.uint64, len(words) + 1)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; sorted integers are best given as differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def expand(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, np.uint64), dtype=np.uint64)


def grams(data: np.ndarray, n: int = DEPTH + 1) -> np.ndarray:
    """Each symbol of ``data`` with the n - 1 before it, packed into an integer, from place n - 1 on; built from runs of 1, 2, 4 symbols."""
    size = max(0, len(data) - n + 1)
    runs = {1: data.astype(np.uint64)}
    while 2 * (s := max(runs)) <= n:
        runs[2 * s] = runs[s][:-s] << np.uint64(8 * s) | runs[s][s:]
    out, at = np.zeros(size, np.uint64), 0
    for s in sorted(runs, reverse=True):
        if n & s:
            out = out << np.uint64(8 * s) | runs[s][at : at + size]
            at += s
    return out


class Block:
    """Texts as symbols. joined: each text's words joined by one space; trains: which texts are learnt from."""

    def __init__(self, joined: list[bytes], trains: np.ndarray):
        begin = bytes([START]) * DEPTH
        self.joined, self.trains = joined, trains
        self.data = np.frombuffer(b"".join(x for t in joined for x in (begin, t, bytes([END]))), np.uint8)
        self.ends = np.cumsum([len(t) + DEPTH + 1 for t in joined])

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Grams, and the text of each, of a bounded number of places at a time. Places of start bytes are left out."""
        begins = np.append(0, self.ends[:-1])
        for a in range(DEPTH, len(self.data), WINDOW):
            z = min(a + WINDOW, len(self.data))
            first, last = np.searchsorted(self.ends, (a, z - 1), side="right")
            own = np.arange(first, last + 1)
            text = np.repeat(own, np.minimum(self.ends[own], z) - np.maximum(begins[own], a))
            real = self.data[a:z] != START
            yield grams(self.data[a - DEPTH : z])[real], text[real]

    def tokens(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token hashes, and the text of each, of some texts at a time."""
        for i in range(0, len(self.joined), 500):
            found = [token_hashes(t.split()) for t in self.joined[i : i + 500]]
            yield np.concatenate(found), np.repeat(np.arange(i, i + len(found)), [len(h) for h in found])

    def keys(self, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return self.tokens() if kind == WORDS else self.windows()

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of the block, sorted, and how often it holds each."""
        return _gathered([_counted(key) for key, _ in self.keys(kind)])

    def messages(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of the block, sorted, and how often its training texts hold each."""
        whole, held_out = [], []
        for key, text in self.keys(kind):
            whole.append(_counted(key))
            held_out.append(_counted(key[~self.trains[text]]))
        apart, m = _gathered(held_out)
        keys, n = _gathered(whole)
        n[np.searchsorted(keys, apart)] -= m
        return keys, n.astype(COUNT[False])


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """By the hash of a word, or of the last two bytes of a gram's context."""
    at = keys if kind == WORDS else (keys >> np.uint64(8) & np.uint64(0xFFFF)) + np.uint64(1)
    return ((at * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)).astype(np.uint16)


def pair_counts(block: Block) -> np.ndarray:
    """How often each symbol comes after each, in the training texts: 65,536 counts."""
    data = Block([t for t, y in zip(block.joined, block.trains, strict=True) if y], np.zeros(0, bool)).data
    if not len(data):
        return np.zeros(65_536, np.int64)
    both = (data[:-1].astype(np.uint16) << np.uint16(8) | data[1:])[data[1:] != START]
    return np.bincount(both, minlength=65_536)


class Pairs:
    """The contexts of no byte and of one."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(256, 256).astype(np.float64)
        self.of = self.counts.sum(axis=1)
        single = self.counts.sum(axis=0)
        empty = (single + STRENGTH / 256) / (single.sum() + STRENGTH)
        self.p = (self.counts + STRENGTH * empty) / (self.of[:, None] + STRENGTH)


class Subtree:
    """Kept contexts of two bytes or more, and their next symbols: for each depth sorted contexts with counts, sorted context + symbol with counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray, n: np.ndarray, pairs: Pairs) -> Subtree:
        """keys: sorted grams that share a shard; n: their counts."""
        found = []
        for d in range(2, DEPTH + 1):
            e, m = _sums(keys & np.uint64((1 << 8 * (d + 1)) - 1), n)
            c, first = np.unique(e >> np.uint64(8), return_index=True)
            of = np.add.reduceat(m, first) if len(first) else np.zeros(0, np.int64)
            found.append((c, of, e, m))
        good = []
        for k, (c, of, e, m) in enumerate(found):
            size = np.diff(np.append(np.searchsorted(e >> np.uint64(8), c), len(e)))
            if k:
                c0, of0, e0, m0 = found[k - 1]
                up = e & np.uint64((1 << 8 * (k + 2)) - 1)
                before = m0[np.searchsorted(e0, up)] / of0[np.searchsorted(c0, up >> np.uint64(8))]
            else:
                b, x = (e >> np.uint64(8) & np.uint64(255)).astype(np.int64), (e & np.uint64(255)).astype(np.int64)
                before = pairs.counts[b, x] / pairs.of[b]
            gain = np.bincount(np.repeat(np.arange(len(c)), size), m * np.log(m / np.repeat(of, size) / before), len(c))
            good.append((of >= CONTEXT_LEAST) & (gain >= EVIDENCE * size))
        for k in range(len(found) - 1, 0, -1):
            up = found[k][0][good[k]] & np.uint64((1 << 8 * (k + 1)) - 1)
            good[k - 1][np.searchsorted(found[k - 1][0], up)] = True
        levels = []
        for (c, of, e, m), g in zip(found, good, strict=True):
            mine = g[np.searchsorted(c, e >> np.uint64(8))]
            levels.append((c[g], of[g], e[mine], m[mine]))
        return cls(levels)

    def pack(self) -> list[bytes]:
        return [x for c, of, e, m in self.levels for x in (squeeze_sorted(c), squeeze(of), squeeze_sorted(e), squeeze(m))]

    @classmethod
    def unpack(cls, raw: list[bytes]) -> Subtree:
        return cls([(expand_sorted(c), expand(of, np.int64), expand_sorted(e), expand(m, np.int64)) for c, of, e, m in zip(*[raw[i::4] for i in range(4)], strict=True)])

    def log_probabilities(self, keys: np.ndarray, pairs: Pairs) -> np.ndarray:
        """log10 of each gram's last symbol after the longest kept suffix of what stands before it."""
        b, x = (keys >> np.uint64(8) & np.uint64(255)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        p, alive = pairs.p[b, x], np.arange(len(keys))
        for k, (c, of, e, m) in enumerate(self.levels):
            g = keys[alive] & np.uint64((1 << 8 * (k + 3)) - 1)
            at, has = _find(c, g >> np.uint64(8))
            alive, g, at = alive[has], g[has], at[has]
            if not len(alive):
                break
            where, seen = _find(e, g)
            count = np.zeros(len(g))
            count[seen] = m[where[seen]]
            p[alive] = (count + STRENGTH * p[alive]) / (of[at] + STRENGTH)
        return np.log10(p)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.int32)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of ``n`` over each."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _gathered(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of some passes, sorted, and the sums of their counts. Empties the list."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys, n = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
    found.clear()
    return _sums(keys, n)


def _find(among: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``what`` in the sorted ``among``, and which are there."""
    at = np.searchsorted(among, what)
    inside = at < len(among)
    has = np.zeros(len(what), bool)
    has[inside] = among[at[inside]] == what[inside]
    return at, has


class Lookup:
    """Values of sorted keys by a direct-mapped table, frequent keys first; what the table lacks is searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, n: np.ndarray):
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        self.table = np.zeros(1 << int(np.uint64(64) - self.shift), np.int32)
        order = np.argsort(n)
        self.table[self._slot(keys[order])] = order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def pack(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df: id, text, held_out. Blocks: block, texts (an Arrow stream of id, held_out, joined words), pairs, symbols, tokens (of training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sequence, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            table = pa.concat_tables(pa.Table.from_batches([b]) for b in held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            joined = table.column("joined").to_pylist()
            trains = ~table.column("held_out").to_numpy(zero_copy_only=False)
            tokens = sum(len(t.split()) + 1 for t, y in zip(joined, trains, strict=True) if y)
            block = Block(joined, trains)
            row = [(part << 24) + sequence, sink.getvalue().to_pybytes(), squeeze(pair_counts(block)), len(block.data), tokens]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "texts", "pairs", "symbols", "tokens"])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                part_of = b.slice(i, 500)
                joined = [b" ".join(words_of(x.as_py() or "")) for x in part_of.column(1)]
                held.append(pa.RecordBatch.from_arrays([part_of.column(0), part_of.column(2), pa.array(joined, pa.large_binary())], names=["id", "held_out", "joined"]))
                size += sum(map(len, joined))
                if size >= BLOCK_BYTES:
                    yield flush()
                    sequence, held, size = sequence + 1, [], 0
        if held:
            yield flush()

    return scratch.keep(df.select("id", "text", "held_out").mapInArrow(run, "block long, texts binary, pairs binary, symbols long, tokens long"), "blocks")


def _opened(texts: bytes) -> tuple[pa.Table, Block]:
    table = pa.ipc.open_stream(texts).read_all()
    return table, Block(table.column("joined").to_pylist(), ~table.column("held_out").to_numpy(zero_copy_only=False))


def sum_pairs(blocks: DataFrame) -> np.ndarray:
    """The pair counts of all blocks: 65,536 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65_536, np.int64)
        for b in batches:
            for x in b.column(0):
                total += expand(x.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros(65_536, np.int64)
    for r in blocks.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def ask(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's messages: block, kind, shard, keys, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, texts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, own = _opened(texts.as_py())
                for kind in (WORDS, GRAMS):
                    keys, n = own.messages(kind)
                    shard = shard_of(kind, keys, shards)
                    order = np.argsort(shard, kind="stable")
                    ends = np.searchsorted(shard[order], np.arange(shards + 1))
                    rows = [(s, squeeze_sorted(keys[order[a:z]]), squeeze(n[order[a:z]])) for s, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
                    columns = [pa.array([block] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "shard", "keys", "n"])

    return blocks.select("block", "texts").mapInArrow(run, "block long, kind int, shard int, keys binary, n binary")


def _merged(table: pa.Table, merged: bool) -> tuple[np.ndarray, np.ndarray]:
    """The keys of messages with their counts (of a block each, or of several) added up; keys that no training text holds are left out."""
    keys = np.concatenate([expand_sorted(x.as_py()) for x in table.column("keys")])
    n = np.concatenate([expand(x.as_py(), COUNT[merged]) for x in table.column("n")]).astype(np.int64)
    return _sums(keys[n > 0], n[n > 0])


def learn(asked: DataFrame, pairs: np.ndarray, tasks: int) -> DataFrame:
    """kind, shard, model (a subtree, or words and their counts), distinct (words), from all messages."""

    def merge(table: pa.Table) -> pa.Table:
        keys, n = _merged(table, False)
        return pa.table({"kind": table.column("kind")[:1].cast(pa.int32()), "shard": table.column("shard")[:1].cast(pa.int32()), "keys": pa.array([squeeze_sorted(keys)], pa.binary()), "n": pa.array([squeeze(n)], pa.binary())})

    def build(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys, n = _merged(table, True)
        model = [squeeze_sorted(keys), squeeze(n)] if kind == WORDS else Subtree.build(keys, n, Pairs(pairs)).pack()
        return pa.table({"kind": pa.array([kind], pa.int32()), "shard": table.column("shard")[:1].cast(pa.int32()), "model": pa.array([model], pa.list_(pa.binary())), "words": pa.array([len(keys) if kind == WORDS else 0], pa.int64())})

    parts = asked.repartition(tasks, "kind", "shard", "chunk").groupBy("kind", "shard", "chunk").applyInArrow(merge, "kind int, shard int, keys binary, n binary")
    return parts.repartition(tasks, "kind", "shard").groupBy("kind", "shard").applyInArrow(build, "kind int, shard int, model array<binary>, words long")


def answer(asked: DataFrame, models: DataFrame, pairs: np.ndarray, chunks: int, tasks: int) -> DataFrame:
    """block, kind, shard, answers: for each key of a message, in its order, the log probability (single precision) or the count."""

    def run(messages: pa.Table, models: pa.Table) -> pa.Table:
        if not messages.num_rows:  # no block of this chunk holds a key of the shard
            return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "answers": pa.array([], pa.binary())})
        keys = [expand_sorted(x.as_py()) for x in messages.column("keys")]
        ends = np.append(0, np.cumsum([len(k) for k in keys]))
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        model = models.column("model")[0].as_py()
        if messages.column("kind")[0].as_py() == WORDS:
            known, count = expand_sorted(model[0]), expand(model[1], np.int64)
            at, has = _find(known, distinct)
            value = np.zeros(len(distinct), np.int64)
            value[has] = count[at[has]]
        else:
            value = Subtree.unpack(model).log_probabilities(distinct, Pairs(pairs)).astype(np.float32)
        value = value[where]
        out = pa.array([squeeze(value[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.table({"block": messages.column("block"), "kind": messages.column("kind"), "shard": messages.column("shard"), "answers": out})

    keys = ["kind", "shard", "chunk"]
    copies = models.select("kind", "shard", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "model")
    left = asked.repartition(tasks, *keys).groupBy(*keys)
    return left.cogroup(copies.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, "block long, kind int, shard int, answers binary")


def lm_scores(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows outside the held-out tenth. A null or empty text is its end alone; a null doc_id counts as
    the id '' (held out). Without training texts every count is 0, base_score is that of an empty count and
    score of equal shares. Repeated rows are counted and scored one by one; an empty table gives an empty one; other columns,
    whatever their names, are not read. A text may be as long as a row: its places are looked at ``WINDOW`` at a time.
    """
    key = df.select(doc_id).schema[0].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (id_remainder(doc_id, FOLDS) == 0).alias("held_out"))
    blocks = pack(rows, scratch)
    n_blocks, symbols, n_train = blocks.agg(F.count("*"), F.coalesce(F.sum("symbols"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    shards = min(65_536, max(8, -(-symbols // SHARD_SYMBOLS)))
    chunks = max(1, -(-n_blocks // CHUNK))
    pairs = sum_pairs(blocks)
    asked = ask(blocks, shards).withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    asked = scratch.keep(asked, "asked")
    models = scratch.keep(learn(asked, pairs, shards), "models")
    n_words = models.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    answers = scratch.keep(answer(asked, models, pairs, chunks, shards), "answers")
    scratch.drop("asked")
    most = float(n_train) + ADDED * (n_words + 1)

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        table, own = _opened(texts.column("texts")[0].as_py())
        n = len(own.joined)
        kinds, places = told.column("kind").to_numpy(), told.column("shard").to_numpy()
        looked = {}
        for kind, form in ((WORDS, np.int64), (GRAMS, np.float32)):
            keys, count = own.distinct(kind)
            order = np.argsort(shard_of(kind, keys, shards), kind="stable")
            mine = np.flatnonzero(kinds == kind)
            mine = mine[np.argsort(places[mine])]
            values = np.zeros(len(keys), form)
            values[order] = np.concatenate([expand(told.column("answers")[int(i)].as_py(), form) for i in mine])
            looked[kind] = Lookup(keys, values.astype(np.float64), count)
        n_tokens, n_known, base, model = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for h, at in own.tokens():
            c = looked[WORDS](h)
            n_tokens += np.bincount(at, minlength=n)
            n_known += np.bincount(at, c > 0, n).astype(np.int64)
            base += np.bincount(at, np.log10((c + ADDED) / most), n)
        for g, at in own.windows():
            model += np.bincount(at, looked[GRAMS](g), n)
        columns = {"id": table.column("id"), "held_out": table.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(n, n_train, np.int64), "base_score": base, "score": model}
        return pa.table(columns)

    schema = f"id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    tasks = max(1, n_blocks)
    whole = blocks.select("block", "texts").repartition(tasks, "block").groupBy("block")
    told = answers.repartition(tasks, "block").groupBy("block")
    return whole.cogroup(told).applyInArrow(score, schema).withColumnRenamed("id", doc_id)
