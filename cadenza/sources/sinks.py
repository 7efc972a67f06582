"""Sinks: JSON, delimited text, append logs, single documents, metadata, copies and gates."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audits import numbered

#: Columns of the delimited form of the vocabulary, in order.
TONE_FIELDS = ("id", "word", "traditional", "pinyin", "pos", "level", "lexical_pattern", "default_surface_pattern", "sandhi_tags", "surface_label_needs_clip_review", "forvo_url")


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside ``path``, then put the result in its place: a failed write leaves what was there, also where it is read from.

    Both steps are renames, which is one step each where the store has a rename; a reader may meet no folder in between, never half of one.
    """
    jvm, end = spark._jvm.org.apache.hadoop.fs, uuid.uuid4().hex
    new, old, target = (jvm.Path(p) for p in (f"{path.rstrip('/')}.new-{end}", f"{path.rstrip('/')}.old-{end}", path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
        held = files.exists(target)
        if held and not files.rename(target, old):
            raise OSError(f"{path} can't be moved away")
        if not files.rename(new, target):
            if held:
                files.rename(old, target)
            raise OSError(f"{path} can't be put in place")
        files.delete(old, True)
    finally:
        files.delete(new, True)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; null fields are kept. Replaces what was there when all of it is written."""
    replace(df.sparkSession, path, lambda p: df.write.option("ignoreNullFields", False).json(p))


def document_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """place, value: the lines of one JSON array of all rows in order. No task holds all rows."""
    rows = numbered(df, order)
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    lines = rows.select(F.col("_place").alias("place"), F.concat(F.when(F.col("_place") > 0, ",").otherwise(""), body).alias("value"))
    ends = df.sparkSession.createDataFrame([(-1, "["), (2**62, "]")], "place long, value string")
    return lines.unionByName(ends)


def write_document(df: DataFrame, path: str, order: list[str]) -> None:
    """One file that is a JSON array, for tables that are one file by nature: one task writes the lines, sorted outside of memory."""
    lines = document_lines(df, order).repartition(1).sortWithinPartitions("place").select("value")
    replace(df.sparkSession, path, lambda p: lines.write.text(p))


def delimited(df: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Arrays joined by ';', booleans as True and False, for a text file: all columns, or ``fields`` in their order."""
    kinds = dict(df.dtypes)
    shown = {c: F.array_join(c, ";") if k.startswith("array") else F.initcap(F.col(c).cast("string")) if k == "boolean" else F.col(c) for c, k in kinds.items()}
    return df.select(*[shown[c].alias(c) for c in fields or kinds])


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...] | None = None, mark: bool = True) -> None:
    """A delimited file with a header, which begins with a byte-order mark unless ``mark`` is false."""
    rows = delimited(df, fields)
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], f"\ufeff{rows.columns[0]}")
    replace(df.sparkSession, path, lambda p: rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(p))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def sidecars(recordings: DataFrame) -> DataFrame:
    """audio_path, sidecar: the metadata of each recording as one JSON object, without the columns that only an index has."""
    own = [c for c in recordings.columns if c not in ("audio_path", "hsk_id", "quiz_eligible", "word")]
    return recordings.select("audio_path", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("sidecar"))


def write_sidecars(recordings: DataFrame, path: str) -> None:
    """The metadata table: a row for each recording in place of a file beside each."""
    rows = sidecars(recordings)
    replace(recordings.sparkSession, path, lambda p: rows.write.parquet(p))


def copy_plan(paths: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """Distinct paths with their size and the place that each is copied to."""
    return paths.select("audio_path").distinct().join(files.select(F.col("path").alias("audio_path"), "length"), "audio_path").withColumn("target", F.concat(F.lit(target.rstrip("/") + "/"), "audio_path"))


def _local(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not on a mounted file system")
    return unquote(parts.path) if parts.scheme else path


def copy_files(plan: DataFrame, root: str) -> DataFrame:
    """Carry out a plan of copies on the executors: audio_path, target, copied (bytes). ``root`` is where the paths begin; both places are mounted everywhere.

    A file is written beside its target and renamed, so a task that is run again only writes it again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = []
            for source, target in zip(b["audio_path"], b["target"], strict=True):
                to = _local(target)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{uuid.uuid4().hex}"
                shutil.copyfile(os.path.join(_local(root), source), part)
                os.replace(part, to)
                sizes.append(os.path.getsize(to))
            yield b.assign(copied=sizes)[["audio_path", "target", "copied"]]

    return plan.select("audio_path", "target").mapInPandas(run, "audio_path string, target string, copied long")


def gate(df: DataFrame, message: str) -> None:
    """Raise if the frame has any row; reads no more than one."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")
