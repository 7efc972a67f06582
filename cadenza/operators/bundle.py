"""What an offline bundle needs, what is missing of it, and checks as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio, fixed
from .selection import HUMAN, PUBLIC, required_keys, select_recording


def referenced_paths(recordings: DataFrame, syllable_files: DataFrame, words: DataFrame, quality: DataFrame, public: DataFrame) -> DataFrame:
    """Distinct audio_path of eligible recordings, all syllable files, and what is chosen for every syllable and tone. No recording may lack its path."""
    own = recordings.where(~F.col("quiz_eligible").eqNullSafe(F.lit(False)))
    path = F.when(F.coalesce("audio_path", F.lit("")) == "", F.raise_error(F.lit("a recording has no audio_path")).cast("string")).otherwise(F.col("audio_path"))
    chosen = select_recording(required_keys(words), quality, public).where("audio_path is not null").select("audio_path")
    return own.select(path.alias("audio_path")).union(syllable_files.select("audio_path")).union(chosen).distinct()


def unsafe_paths(paths: DataFrame, column: str = "audio_path") -> DataFrame:
    """Paths that leave the root: absolute ones, and those whose '..' climb above it."""
    depth = F.aggregate(
        F.split(F.col(column), "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda s, p: F.struct((s["d"] + _step(p)).alias("d"), F.least(s["least"], s["d"] + _step(p)).alias("least")),
    )
    return paths.where(F.col(column).startswith("/") | (depth["least"] < 0))


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when((part == ".") | (part == ""), 0).otherwise(1)


def missing(paths: DataFrame, files: DataFrame, key: str = "audio_path") -> DataFrame:
    """Paths for which there is no file of at least one byte. files: audio_path, length."""
    return paths.join(files.where("length > 0").select(key).distinct(), key, "left_anti")


def totals(paths: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, bytes."""
    rows = paths.select("audio_path").distinct().join(files.select("audio_path", "length").distinct(), "audio_path")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two sets has, with the side."""
    l, r = left.distinct(), right.distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left")).union(r.exceptAll(l).withColumn("side", F.lit("right")))


def check(name: str, violations: DataFrame, detail: str | None = None) -> DataFrame:
    """check, ok, detail: whether there is no violation, and the first five in order."""
    shown = F.array_join(F.slice(F.array_sort(F.collect_list(F.col(detail).cast("string"))), 1, 5), ", ") if detail else F.lit("")
    few = violations.orderBy(detail).limit(5) if detail else violations.limit(1)
    return few.agg(F.count("*").alias("n"), shown.alias("detail")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), "detail")


def checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def selected_checks(keys: DataFrame, files: DataFrame, quality: DataFrame, public: DataFrame, unavailable: tuple[str, ...] = fixed.UNAVAILABLE) -> DataFrame:
    """For both modes: what is chosen for every key has a file, and no recording is chosen for exactly the keys in ``unavailable``. files: audio_path, length."""
    parts, known = [], keys.sparkSession.createDataFrame([(k,) for k in unavailable], "key string")
    for mode in (PUBLIC, HUMAN):
        chosen = select_recording(keys, quality, public, mode)
        parts.append(check(f"{mode}: selected exist", missing(chosen.where("audio_path is not null").select("audio_path"), files), "audio_path"))
        parts.append(check(f"{mode}: unavailable", differing(chosen.where("audio_path is null").select("key"), known), "key"))
    return checks(*parts)


def setup_checks(recordings: DataFrame, public: DataFrame, files: DataFrame, counts: dict[str, int], samples: DataFrame, words: DataFrame, quality: DataFrame, syllable_files: DataFrame, unavailable: tuple[str, ...] = fixed.UNAVAILABLE) -> DataFrame:
    """The checks of a finished set-up. files: audio_path, length, content; samples: audio_path, sha256; counts: recordings, syllables, public; syllable_files: audio_path."""
    names = files.select("audio_path", "length")
    bad = files.where(~audio.valid_mp3(F.col("content"))).select("audio_path")
    own = recordings.where(F.col("source") == HUMAN)
    isolated, own = own.where(F.col("recording_type") == "isolated_word"), own.select("audio_path")
    hashes = samples.join(files.select("audio_path", F.sha2("content", 256).alias("found")), "audio_path", "left").where(~F.col("found").eqNullSafe(F.col("sha256")))

    def sized(name: str, df: DataFrame, n: int) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == n).alias("ok"), F.col("n").cast("string").alias("detail"))

    return checks(
        sized("recordings", isolated, counts["recordings"]),
        check("recordings exist", missing(own, names), "audio_path"),
        check("recordings are MPEG audio", own.join(bad, "audio_path", "left_semi"), "audio_path"),
        sized("syllables", syllable_files, counts["syllables"]),
        check("syllables are MPEG audio", syllable_files.select("audio_path").join(bad, "audio_path", "left_semi"), "audio_path"),
        sized("public", public, counts["public"]),
        check("public exist", missing(public.select("audio_path"), names), "audio_path"),
        check("public are MPEG audio", public.select("audio_path").join(bad, "audio_path", "left_semi"), "audio_path"),
        check("samples", hashes.select("audio_path"), "audio_path"),
        selected_checks(required_keys(words), names, quality, public, unavailable),
    )
