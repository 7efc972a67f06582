"""Sharding by balanced label propagation (operator 3), in DataFrame operations only.

Documents of equal texts are one group; two groups are linked if they share a line of ``LINE`` characters
or more. A group of more than 1 / HOT of all rows is placed first, in as few shards as hold it, and stays; its documents count for its neighbours like others.
The others start in the shard of their hash, in proportion to the room. In each round every line counts the
documents that it has in each shard, every group adds up the counts of its lines, and asks to move to
the shard where most of its neighbours are. Rounds end when under 1 / SETTLED of the linked groups move, or after ``ROUNDS``. A shard admits movers by falling gain while it has room: its quota
less the large groups and the linked documents that stay. Documents without links are then spread over what room is left. Lines and groups meet by joins on their hash, never as pairs.

The law is ``rows``: in the end each shard holds its exact quota. A shard's documents are ranked (large groups
first, then linked ones and copies, then the others, a group's documents together); those beyond the quota
fill the shards that have too few, in that order. Slots are the ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, utf8_size
from .ranks import running_sum

SHARDS = 8
LINE = 12
ROUNDS = 6
SETTLED = 8
#: Buckets that a shard's ranks are summed by; groups of over 1 / HOT of all rows get SALTS buckets of their own.
BUCKETS = 1024
HOT = 1024
SALTS = 32
#: Steps of a hash by which rows or groups are spread over shards in proportion.
STEPS = 10_000
#: Steps of gain (powers of two) and of hash within a step, by which movers are admitted.
GAINS, SLICES = 32, 16


def incidence(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """g, line, w: lines (hashes) that at least two groups share, and how many documents of each group hold it.

    Sums are written before they are joined: a join of two written tables can be split where one line has very many rows.
    """
    lines = F.transform(F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(x) >= LINE), lambda x: F.xxhash64(x))
    each = rows.select("g", F.explode(F.array_distinct(lines)).alias("line"))
    held = scratch.keep(each.groupBy("g", "line").agg(F.count("*").alias("w")), "held")
    shared = held.groupBy("line").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("line")
    shared = scratch.keep(shared, "shared", narrow=True)
    return held.join(shared, "line")


def _largest(columns: list[Column]) -> Column:
    """The first place of the largest of the columns."""
    return F.array_position(F.array(*columns), F.greatest(*columns)).cast("int") - 1


def _each(values: list[int], shard: str) -> Column:
    """The shard's value."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(shard))


def spread(room: list[float], step: Column) -> Column:
    """The shard of a step of hash, in proportion to the room; even shares if there is none."""
    room = [max(0.0, r) for r in room] if max(room) > 0 else [1.0] * SHARDS
    out, upto = F.lit(max(range(SHARDS), key=room.__getitem__)), sum(room)
    for s in reversed(range(SHARDS)):
        out = F.when(step < round(STEPS * upto / sum(room)), s).otherwise(out) if room[s] else out
        upto -= room[s]
    return out.cast("int")


def place_large(groups: list[tuple[int, int]], quota: list[int]) -> tuple[list[tuple[int, list[int], list[int]]], list[int]]:
    """Large groups (g, n), into as few shards as hold them: (g, last steps of hash, shards), and the room that is left."""
    room, out = list(quota), []
    for g, n in groups:
        left, shards, ends = n, [], []
        while left > 0 and max(room) > 0:
            fits = [s for s in range(SHARDS) if room[s] >= left]
            s = min(fits, key=room.__getitem__) if fits and shards else max(range(SHARDS), key=room.__getitem__)
            took = min(left, room[s])
            room[s] -= took
            left -= took
            shards.append(s)
            ends.append(round(STEPS * (n - left) / n))
        out.append((g, ends or [STEPS], shards or [0]))
    return out, room


VOTES = [f"v{s}" for s in range(SHARDS)]


def settled_votes(links: DataFrame, pieces: DataFrame) -> DataFrame:
    """line, and for each shard the documents that large groups have of it there. pieces: g, ends, shards of the large groups."""
    of = links.join(F.broadcast(pieces), "g")  # under HOT rows
    step = lambda i: F.get("ends", i) - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
    share = lambda s: F.aggregate(F.transform("shards", lambda x, i: F.when(x == s, step(i)).otherwise(0)), F.lit(0), lambda a, x: a + x) / STEPS
    return of.groupBy("line").agg(*[F.sum(F.col("w") * share(s)).alias(v) for s, v in enumerate(VOTES)])


def wishes(links: DataFrame, state: DataFrame, settled: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """g, n, label, to (where most neighbours are, if more than here) and gain of every linked group. state: g, n, label."""
    placed = links.join(state.select("g", "label"), "g")
    votes = placed.select("line", *[F.when(F.col("label") == s, F.col("w")).otherwise(0).cast("double").alias(v) for s, v in enumerate(VOTES)]).unionByName(settled)
    votes = scratch.keep(votes.groupBy("line").agg(*[F.sum(v).alias(v) for v in VOTES]), f"votes_{k}", narrow=True)
    # A group's own documents on the line are no neighbours.
    near = placed.join(votes, "line").groupBy("g").agg(*[F.sum(F.col(v) - F.when(F.col("label") == s, F.col("w")).otherwise(0)).alias(v) for s, v in enumerate(VOTES)])
    wish = state.join(near, "g").withColumn("to", _largest([F.col(v) for v in VOTES]))
    here = reduce(lambda a, s: F.when(F.col("label") == s, F.col(VOTES[s])).otherwise(a), range(SHARDS), F.lit(0))
    wish = wish.withColumn("gain", F.greatest(*[F.col(v) for v in VOTES]) - here)
    return wish.select("g", "n", "label", F.when(F.col("gain") > 0, F.col("to")).otherwise(F.col("label")).alias("to"), "gain")


def propagate(links: DataFrame, groups: DataFrame, settled: DataFrame, quota: list[int], scratch: Scratch) -> DataFrame:
    """g, n, label of the linked groups after the rounds. groups: g, n (documents), label; settled: what large groups have of each line; quota: each shard's room for the others.

    A round writes votes and wishes only: what a shard admits is one number, and with these the wishes give the next labels as they are read.
    """
    state, kept = scratch.keep(groups, "labels_0", narrow=True), "labels_0"
    linked = state.count()
    for k in range(1, ROUNDS + 1):
        wish = wishes(links, state, settled, scratch, k)
        step = F.least(F.lit(GAINS - 1), F.floor(F.log2(F.greatest(F.col("gain"), F.lit(1))))).cast("int")
        wish = wish.withColumn("turn", (F.lit(GAINS - 1) - step) * SLICES + F.pmod(F.xxhash64("g", F.lit(k)), F.lit(SLICES)))
        wish = scratch.keep(wish.drop("gain"), f"wish_{k}")
        scratch.drop(f"votes_{k}")
        scratch.drop(kept)
        kept = f"wish_{k}"
        stay = wish.where("to = label").groupBy(F.col("label").alias("s")).agg(F.sum("n").alias("stays"))
        asked = wish.where("to <> label").groupBy("to", "turn").agg(F.sum("n").alias("n"))  # at most SHARDS x GAINS x SLICES rows
        upto = asked.withColumn("upto", F.sum("n").over(Window.partitionBy("to").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
        room = upto.join(F.broadcast(stay), F.col("to") == F.col("s"), "left").where(F.col("upto") + F.coalesce("stays", F.lit(0)) <= _each(quota, "to"))
        last = {r["to"]: r["last"] for r in room.groupBy("to").agg(F.max("turn").alias("last")).collect()}  # at most SHARDS rows
        moves = (F.col("to") != F.col("label")) & (F.col("turn") <= _each([last.get(s, -1) for s in range(SHARDS)], "to"))
        movers = wish.where(moves).count()
        state = wish.select("g", "n", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label"))
        if movers * SETTLED < linked:
            break
    return state


def shard(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and group_rows (documents of equal text) of every row.

    Null texts count as empty (size 1) and are one group with empty ones. Null doc_ids and repeated rows are placed like
    others, and ties in rank lie between equal rows only. An empty table gives an empty one.
    """
    spark = df.sparkSession
    base = df.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    wide = base.select("id", "text", F.xxhash64("text").alias("g"))
    rows = scratch.keep(wide.select("id", "g", (utf8_size("text") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")), "rows")
    links = scratch.keep(incidence(wide, scratch), "links")
    groups = scratch.keep(rows.groupBy("g").agg(F.count("*").alias("n")), "groups", narrow=True)
    total = rows.count()
    quota = [total // SHARDS + (s < total % SHARDS) for s in range(SHARDS)]
    hot = F.col("n") > max(1.0, total / HOT)
    large = [(r["g"], r["n"]) for r in groups.where(hot).orderBy(F.desc("n"), "g").collect()]  # under HOT rows
    pieces, room = place_large(large, quota)
    pieces = spark.createDataFrame([(i, g, ends, shards) for i, (g, ends, shards) in enumerate(pieces)], "own int, _l long, ends array<int>, shards array<int>")
    step = F.pmod(F.xxhash64("g", F.lit(0)), F.lit(STEPS))
    linked = links.select("g").distinct().join(groups.where(~hot), "g").select("g", "n", spread(room, step).alias("label"))
    settled = scratch.keep(settled_votes(links, pieces.select(F.col("_l").alias("g"), "ends", "shards")), "settled", narrow=True)
    labels = propagate(links, linked, settled, room, scratch)
    taken = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # at most SHARDS rows
    room = [r - taken.get(s, 0) for s, r in enumerate(room)]
    labelled = groups.join(labels.select("g", "label"), "g", "left").join(F.broadcast(pieces), F.col("g") == F.col("_l"), "left")
    tier = F.when(F.col("label").isNotNull() | (F.col("n") > 1), 0).otherwise(1)
    common = HOT * SALTS + tier * BUCKETS + F.pmod(F.xxhash64("g", F.lit(1)), F.lit(BUCKETS))
    labelled = labelled.select(F.col("g").alias("_g"), "n", F.coalesce("label", spread(room, step)).alias("label"), "own", "ends", "shards", common.alias("common"))
    # Written, so that the rows' join can be split where a group has very many.
    placed = rows.join(scratch.keep(labelled, "labelled", narrow=True), F.col("g") == F.col("_g"))
    own_step = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(STEPS))
    place = F.when(F.col("own").isNull(), F.col("label")).otherwise(F.coalesce(F.get("shards", F.size(F.filter("ends", lambda e: e <= own_step))), F.element_at("shards", -1)))
    bucket = F.when(F.col("own").isNull(), F.col("common")).otherwise(F.col("own") * SALTS + F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    placed = scratch.keep(placed.select("id", "g", "size", "crc", "n", place.alias("label"), bucket.cast("int").alias("bucket")), "placed")
    ranked = running_sum(placed, ["label"], "bucket", [F.col("g"), F.col("id")], F.lit(1), "rank")
    have = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most SHARDS rows
    count = [have.get(s, 0) for s in range(SHARDS)]
    over = [max(0, c - q) for c, q in zip(count, quota, strict=True)]
    lack = [max(0, q - c) for c, q in zip(count, quota, strict=True)]
    ranked = ranked.withColumn("beyond", F.col("rank") - _each(quota, "label"))
    spare = F.col("beyond") + _each([sum(over[:s]) for s in range(SHARDS)], "label")
    into, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(SHARDS)):
        first = sum(lack[:s])
        here = (spare >= first) & (spare < first + lack[s])
        into, slot = F.when(here, s).otherwise(into), F.when(here, count[s] + spare - first).otherwise(slot)
    stays = F.col("beyond") < 0
    return ranked.select(
        F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.when(stays, F.col("label")).otherwise(into).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("n").alias("group_rows"),
    )
