"""Audits: duplicates, tone contours, similar families, transcripts, and what is left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import audio, pinyin
from ..sources.shared import Scratch
from .selection import bad

#: Keys of a group that are listed.
LISTED = 1000


def duplicate_groups(files: DataFrame, quality: DataFrame, payload: str = "payload") -> DataFrame:
    """files: source, key, payload (hash). Groups of several keys with one payload: source, payload, keys, n_keys, healthy, status.

    A group is quarantined if at most one of its keys is not reviewed as bad. ``keys`` are the first ``LISTED`` in order; counts are of all.
    """
    rows = files.join(quality.select("source", "key", "status"), ["source", "key"], "left")
    groups = rows.groupBy("source", payload).agg(F.count("*").alias("n_keys"), F.count_if(~bad(F.col("status"))).alias("healthy")).where("n_keys > 1")
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy("source", payload).orderBy("key"))).where(F.col("_n") <= LISTED)
    listed = first.groupBy("source", payload).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    out = listed.join(groups, ["source", payload]).select("source", payload, "keys", "n_keys", "healthy")
    return out.withColumn("status", F.when(F.col("healthy") <= 1, "quarantined").otherwise("unquarantined"))


def duplicate_counts(files: DataFrame, quality: DataFrame) -> DataFrame:
    """As ``duplicate_groups`` over one source, for groups of any size: n_keys and first_key in place of the list. files: payload, key."""
    rows = files.join(quality.select(F.col("key").alias("_k"), "status"), F.col("key") == F.col("_k"), "left")
    out = rows.groupBy("payload").agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"), F.count_if(~bad(F.col("status"))).alias("healthy"))
    return out.where("n_keys > 1").withColumn("status", F.when(F.col("healthy") <= 1, "quarantined").otherwise("unquarantined"))


def tone_flags(tracks: DataFrame, required: DataFrame, quality: DataFrame, points: str = "points", methods: tuple[str, ...] = ("pyin", "praat", "world")) -> DataFrame:
    """tracks: source, key, method, nine points (null: no track). Keys that all methods contradict in one way: reason, metrics, required, quarantined."""
    rows = tracks.where(F.col("method").isin(*methods) & F.col(points).isNotNull())
    tone = F.regexp_extract("key", "([1-4])$", 1)
    metrics = audio.contour_metrics(F.col(points))
    reasons = audio.contradicts(tone, metrics)
    by = rows.groupBy("source", "key").agg(
        F.count_distinct("method").alias("_n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", metrics.alias("m"))))).alias("metrics"),
        *[F.bool_and(x).alias(f"_{i}") for i, x in enumerate(reasons.values())],
    )
    reason = reduce(lambda a, x: F.when(F.col(f"_{x[0]}"), x[1]).otherwise(a), reversed(list(enumerate(reasons))), F.lit(None).cast("string"))
    flags = by.where(F.col("_n") == len(methods)).select("source", "key", reason.alias("reason"), "metrics").where("reason is not null")
    return with_policy(flags, required, quality)


def with_policy(flags: DataFrame, required: DataFrame, quality: DataFrame) -> DataFrame:
    """Append required (the key is needed) and quarantined (it is reviewed as bad)."""
    need = required.select(F.col("key").alias("_k")).distinct()
    known = quality.where(bad(F.col("status"))).select(F.col("source").alias("_s"), F.col("key").alias("_q")).distinct()
    rows = flags.join(need, F.col("key") == F.col("_k"), "left").join(known, (F.col("source") == F.col("_s")) & (F.col("key") == F.col("_q")), "left")
    return rows.select(*flags.columns, F.col("_k").isNotNull().alias("required"), F.col("_q").isNotNull().alias("quarantined"))


def similar_tones(waves: DataFrame, quality: DataFrame, threshold: float = 0.995, lags: int = 80) -> DataFrame:
    """waves: source, base, tone, wave. Pairs of tones of one base whose waves are nearly equal; quarantined if at most one is healthy.

    A base has at most four tones: the join on (source, base) makes six pairs a family.
    """
    left = waves.select("source", "base", F.col("tone").alias("left_tone"), F.col("wave").alias("left_wave"))
    right = waves.select("source", "base", F.col("tone").alias("right_tone"), F.col("wave").alias("right_wave"))
    rows = left.join(right, ["source", "base"]).where("left_tone < right_tone")
    rows = rows.withColumn("similarity", audio.similarity_column(lags)(F.col("left_wave"), F.col("right_wave"))).where(F.col("similarity") >= threshold)
    rows = rows.select("source", F.concat("base", F.col("left_tone").cast("string")).alias("left_key"), F.concat("base", F.col("right_tone").cast("string")).alias("right_key"), "similarity")
    known = quality.where(bad(F.col("status"))).select("source", "key").distinct()
    for side in ("left", "right"):
        rows = rows.join(known.select("source", F.col("key").alias(f"{side}_key"), F.lit(True).alias(f"_{side}")), ["source", f"{side}_key"], "left")
    return rows.select("source", "left_key", "right_key", "similarity", (F.col("_left").isNotNull() | F.col("_right").isNotNull()).alias("quarantined"))


def family_paths(files: DataFrame) -> DataFrame:
    """source, base, paths (tone -> path) of keys like ma1."""
    form = "^([a-zv]+)([1-4])$"
    rows = files.where(F.col("key").rlike(form)).select("source", F.regexp_extract("key", form, 1).alias("base"), F.struct(F.regexp_extract("key", form, 2).alias("tone"), "path").alias("e"))
    return rows.groupBy("source", "base").agg(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list("e")))).alias("paths"))


def expected_readings(words: DataFrame) -> DataFrame:
    """word, expected: the distinct readings of its entries with as many syllables as tones; of an entry with neither the empty reading."""
    reading = pinyin.expected_reading(F.col("pinyin_syllables"), F.col("lexical_tones"))
    many = [F.coalesce(F.size(c), F.lit(0)) for c in ("pinyin_syllables", "lexical_tones")]
    even = F.greatest(many[0], F.lit(0)) == F.greatest(many[1], F.lit(0))
    return words.where(even).select("word", reading.alias("r")).groupBy("word").agg(F.array_sort(F.collect_set("r")).alias("expected"))


def native_status(recognized: Column, expected: Column, transcript: Column, word: Column) -> Column:
    """text_match, unrecognized, exact, base_match or review, in that order."""
    same = (F.coalesce(transcript, F.lit("")) != "") & (F.coalesce(word, F.lit("")) != "") & (pinyin.normalized_text(transcript) == pinyin.normalized_text(word))
    heard = F.coalesce(recognized, F.array().cast("array<string>"))
    wanted = F.coalesce(expected, F.array().cast("array<array<string>>"))
    return (
        F.when(same, "text_match")
        .when(F.size(heard) == 0, "unrecognized")
        .when(F.exists(wanted, lambda e: e == heard), "exact")
        .when(F.exists(wanted, lambda e: pinyin.bases(e) == pinyin.bases(heard)), "base_match")
        .otherwise("review")
    )


def identity_status(base: Column, recognized: Column) -> Column:
    heard = F.coalesce(recognized, F.array().cast("array<string>"))
    return F.when(F.size(heard) == 0, "unrecognized").when(F.array_contains(heard, base), "match").otherwise("review")


def native_candidates(recordings: DataFrame, words: DataFrame) -> DataFrame:
    """Recordings of the first corpus that are said to be isolated words and whose word is known, with the readings that are expected."""
    rows = recordings.where((F.col("source") == "audio_cmn") & (F.col("recording_type") == "isolated_word"))
    return rows.join(expected_readings(words), "word")


def polyphonic(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows whose word is a single character with several bases. readings: word, base."""
    many = readings.where(F.char_length("word") == 1).groupBy("word").agg(F.count_distinct("base").alias("_n")).where("_n > 1")
    return rows.join(many.select("word"), "word", "left_semi")


def pending(candidates: DataFrame, completed: DataFrame, key: str = "audio_path") -> DataFrame:
    """Candidates that no completed row has."""
    return candidates.join(completed.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def take_shard(df: DataFrame, index: int, count: int, order: list[str]) -> DataFrame:
    """Every ``count``-th row in order, from ``index``."""
    if count < 1 or not 0 <= index < count:
        raise ValueError("the shard must lie in 0 .. count - 1")
    return numbered(df, order).where(F.col("_place") % count == index).drop("_place")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Append _place: the row's number from 0 in the order, without a window over all rows. Nulls come first.

    Rows are dealt by ranges of the whole order and sorted within a range, and written once, so that both the sizes of the ranges and the rows are read of
    the same ranges. The offsets are a row for each range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the range, then the row's number in it
    rows = Scratch(df.sparkSession, "numbered").keep(ranged.withColumn("_id", place), "rows")
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_inside": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("_place", F.col("_before") + F.col("_inside")).drop("_id", "_part", "_p", "_before", "_inside")


def confirm(reviews: DataFrame, second: DataFrame) -> DataFrame:
    """Rows under review with a second transcriber's findings: paraformer_transcript, _bases, _status. second: audio_path, transcript, bases."""
    own = second.select("audio_path", F.col("transcript").alias("paraformer_transcript"), F.col("bases").alias("paraformer_bases"))
    return reviews.where("status = 'review'").join(own, "audio_path").withColumn("paraformer_status", identity_status(F.col("base"), F.col("paraformer_bases")))


def merge_shards(*logs: DataFrame) -> DataFrame:
    """One row per audio_path of several logs: the smallest, where they differ."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
    return rows.groupBy("audio_path").agg(F.min(F.struct(*[c for c in rows.columns if c != "audio_path"])).alias("r")).select("audio_path", "r.*")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows by the status up to its first colon."""
    return rows.groupBy(F.split(status, ":")[0].alias("status")).agg(F.count("*").alias("n"))
