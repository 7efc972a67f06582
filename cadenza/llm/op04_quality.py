"""Quality classifier (operator 4): a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by the filters' width less one, so that every
window of the whole text lies in one chunk. A filter is a linear form of the embeddings of ``WIDTH``
bytes. Each chunk is max-pooled per filter; a text's features are the mean and the maximum over its
chunks, and a logistic layer combines them into one probability.

For scoring, the two byte embeddings of a pair and their part of a filter are one row of a table of
65,536 pairs, so that a window costs WIDTH / 2 table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, lean

WIDTH = 6
FILTERS = 12
EMBED = 8
CHUNK = 256
#: Labelled texts of each class that training takes at most: those of the smallest hash of their id; their bytes together, and those of one text.
SAMPLE = 1200
SAMPLE_BYTES, LONGEST = 64_000_000, 4_000_000
#: Chunks that one training step takes from a text, at random over the whole of it.
DRAWN = 6
EPOCHS = 12
FOLDS = 5
THRESHOLD = 0.3
SEED = 7


class Net(NamedTuple):
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 FILTERS: of the mean, of the maximum
    offset: float

    def tables(self) -> np.ndarray:
        """WIDTH / 2 tables of a byte pair's part in each filter."""
        single = np.einsum("be,wef->wbf", self.embed, self.filters)
        pairs = single[0::2][:, :, None, :] + single[1::2][:, None, :, :]
        return np.ascontiguousarray(pairs.reshape(WIDTH // 2, 65_536, FILTERS), dtype=np.float32)


def _chunks(data: np.ndarray) -> np.ndarray:
    """Rows of CHUNK + WIDTH - 1 bytes; a shorter rest is moved back to end with the text, a text under a row is filled with zeros."""
    row = CHUNK + WIDTH - 1
    if len(data) <= row:
        return np.pad(data, (0, row - len(data)))[None]
    starts = np.append(np.arange(0, len(data) - row, CHUNK), len(data) - row)
    return np.lib.stride_tricks.sliding_window_view(data, row)[starts]


def _pool(rows: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Chunks to max-pooled, rectified filters."""
    pairs = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
    total = tables[0].take(pairs[:, :CHUNK], axis=0)
    for k in range(1, WIDTH // 2):
        total += tables[k].take(pairs[:, 2 * k : 2 * k + CHUNK], axis=0)
    return np.maximum(total.max(axis=1) + bias, 0)


def features(net: Net, tables: np.ndarray, text: bytes, at_once: int = 256) -> np.ndarray:
    """The text's 2 FILTERS features, a bounded number of chunks at a time."""
    rows = _chunks(np.frombuffer(text, np.uint8))
    total, most = np.zeros(FILTERS), np.zeros(FILTERS)
    for i in range(0, len(rows), at_once):
        pooled = _pool(rows[i : i + at_once], tables, net.bias.astype(np.float32))
        total += pooled.sum(axis=0, dtype=np.float64)
        most = np.maximum(most, pooled.max(axis=0))
    return np.concatenate([total / len(rows), most])


def probability(net: Net, tables: np.ndarray, text: bytes) -> float:
    z = float(features(net, tables, text) @ net.weights + net.offset)
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(texts: list[bytes], labels: list[int]) -> Net:
    """Fit the network by Adam on the log loss, classes weighted alike. Without texts of both classes: the constant of what there is."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels, np.float64)
    p = {
        "embed": rng.standard_normal((256, EMBED)) * 0.5,
        "filters": rng.standard_normal((WIDTH, EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED),
        "bias": np.zeros(FILTERS),
        "weights": rng.standard_normal(2 * FILTERS) * 0.1,
        "offset": np.zeros(1),
    }
    if len(set(labels)) < 2:
        p["weights"][:] = 0
        p["offset"][:] = 0 if not labels else 4.0 * (2 * labels[0] - 1)
        return Net(p["embed"], p["filters"], p["bias"], p["weights"], float(p["offset"][0]))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rows = [_chunks(np.frombuffer(t, np.uint8)) for t in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            picked = [rows[k][rng.integers(0, len(rows[k]), DRAWN)] for k in batch]
            x = np.concatenate(picked)
            net = Net(p["embed"], p["filters"], p["bias"], p["weights"], 0.0)
            single = np.einsum("be,wef->wbf", net.embed, net.filters).astype(np.float32)
            total = single[0].take(x[:, :CHUNK], axis=0)
            for w in range(1, WIDTH):
                total += single[w].take(x[:, w : w + CHUNK], axis=0)
            where = total.argmax(axis=1)  # chunks x filters
            top = np.take_along_axis(total, where[:, None, :], axis=1)[:, 0, :] + net.bias
            pooled = np.maximum(top, 0).reshape(len(batch), DRAWN, FILTERS)
            best = pooled.argmax(axis=1)
            h = np.concatenate([pooled.mean(axis=1), pooled.max(axis=1)], axis=1)
            z = h @ net.weights + p["offset"][0]
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[batch]) * weight[batch] / len(batch)
            back = error[:, None] * net.weights
            g = np.repeat(back[:, None, :FILTERS] / DRAWN, DRAWN, axis=1)
            np.add.at(g, (np.arange(len(batch))[:, None], best, np.arange(FILTERS)[None]), back[:, FILTERS:])
            g = g.reshape(-1, FILTERS) * (top > 0)
            c, f = np.nonzero(g)
            v = g[c, f]
            grad = {"bias": np.bincount(f, v, FILTERS), "weights": h.T @ error, "offset": np.array([error.sum()]), "embed": np.zeros_like(p["embed"]), "filters": np.zeros_like(p["filters"])}
            for w in range(WIDTH):
                byte = x[c, where[c, f] + w]
                np.add.at(grad["embed"], byte, v[:, None] * p["filters"][w][:, f].T)
                np.add.at(grad["filters"][w].T, f, v[:, None] * p["embed"][byte])
            step += 1
            for k, d in grad.items():
                a, b = moments[k]
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p[k] -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net = Net(p["embed"], p["filters"], p["bias"], p["weights"], float(p["offset"][0]))
    return _refit(net, texts, y, weight)


def _refit(net: Net, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> Net:
    """Fit the last layer again, on features of the whole texts."""
    tables = net.tables()
    x = np.stack([features(net, tables, t) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    u = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(u.shape[1])
    ridge = np.diag([1e-3] * (u.shape[1] - 1) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        r = weight * p * (1 - p) + 1e-9
        w -= np.linalg.solve((u.T * r) @ u / len(u) + ridge, u.T @ (weight * (p - y)) / len(u) + ridge @ w)
    return net._replace(weights=w[:-1] / scale, offset=float(w[-1] - (w[:-1] * mean / scale).sum()))


def sample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep_out: bool = True) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels to learn from: ``SAMPLE`` of each class at most, of ``SAMPLE_BYTES`` at most, none of the held-out rows.

    Null labels and ids, labels that contradict each other or have no document, and texts over ``LONGEST`` bytes teach nothing. Null texts count as
    empty; of the texts of one id the smallest is taken. The driver holds this sample and no more.
    """
    ids = df.select(F.col(doc_id).alias("_doc"))
    ok = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).join(ids, F.col(doc_id) == F.col("_doc"), "left_semi")
    if keep_out:
        ok = ok.where(id_remainder(doc_id, FOLDS) != 0)
    ok = ok.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    draw = [ok.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE) for y in (0, 1)]
    chosen = draw[0].union(draw[1]).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    few = F.broadcast(chosen)  # at most 2 SAMPLE rows
    rows = df.select(F.col(doc_id).alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(few, F.col("_d") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y")).withColumn("_n", F.octet_length("_t")).where(F.col("_n") <= LONGEST)
    upto = F.sum("_n").over(Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))  # SAMPLE rows a class
    got = rows.withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_BYTES).orderBy("_y", F.xxhash64("_id"), "_id").collect()
    return [r["_t"].encode() for r in got], [r["_y"] for r in got]


def score(df: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text", into: str = "score") -> DataFrame:
    """doc_id and the probability that a text's quality label is 1. Every byte of every text is read; null counts as empty. No shuffle."""
    key = df.select(doc_id).schema[0].dataType.simpleString()
    packed = [np.asarray(x).tolist() for x in net]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(*[np.array(x) for x in packed[:-1]], packed[-1])
        tables = own.tables()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([probability(own, tables, (x.as_py() or "").encode()) for x in b.column(1)], pa.float64())], names=[doc_id, into])

    return df.select(doc_id, text).mapInArrow(lean(run), f"`{doc_id}` {key}, `{into}` double")


def keep_good(df: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose score reaches ``THRESHOLD``, with all their columns. One pass, no shuffle; only texts go to the workers and only verdicts come back."""
    packed = [np.asarray(x).tolist() for x in net]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Net(*[np.array(x) for x in packed[:-1]], packed[-1])
        tables = own.tables()
        for c in columns:
            yield pa.array([probability(own, tables, (x.as_py() or "").encode()) >= THRESHOLD for x in c], pa.bool_())

    return df.where(F.arrow_udf(lean(run), "boolean")(F.col(text)))


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from ``labels`` (doc_id, quality) outside the held-out fifth.

    Rows whose label is null or contradicted, and labels without a document, teach nothing. With no usable
    labels every score is 0.5. A null doc_id counts as the id '' (held out). Repeated rows stay, ties at the threshold
    are accepted, an empty table gives an empty one.
    """
    net = train(*sample(df, labels, doc_id, text))
    out = score(df, net, doc_id, text)
    return out.select(doc_id, (id_remainder(doc_id, FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
