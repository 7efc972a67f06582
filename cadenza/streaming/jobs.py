"""Streams over file sources: resumable audits, running totals, ingest that never repeats."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import IDENTITY
from ..sources import schemas


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def resumable(source: DataFrame, classify: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, completed: DataFrame | None = None, key: str = "audio_path") -> StreamingQuery:
    """Classify what has arrived and append it to a JSON log, then end; a later run goes on where this one stopped.

    Rows of a key that was met before are left out: the keys are state of the stream, kept in the checkpoint, so that the log is never read again by the batches that
    write it. So are the keys that ``completed`` (from other runs) has. Each batch writes a folder of the log of its own, named by checkpoint and batch: a batch
    that is repeated after a failure replaces it and adds nothing twice. Rows without a key are left out.
    """
    run = f"{zlib.crc32(checkpoint.encode()):08x}"
    fresh = source.where(F.col(key).isNotNull()).dropDuplicates([key])
    if completed is not None:
        fresh = fresh.join(completed.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")

    def batch(rows: DataFrame, n: int) -> None:
        classify(rows).write.mode("overwrite").option("ignoreNullFields", False).json(f"{log}/{run}-{n:09d}")

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_answers(attempts: DataFrame, by: str, limit: int, name: str) -> StreamingQuery:
    """The last ``limit`` answers of each learner as a table in memory: state by key, of that many rows, kept in the checkpoint. attempts: by, at (timestamp), row (string)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        held += [(at, row) for f in frames for at, row in zip(f["at"].astype("int64").tolist(), f["row"], strict=True)]
        held = sorted(held)[-limit:]
        state.update(([a for a, _ in held], [r for _, r in held]))
        yield pd.DataFrame({by: [key[0]], "rows": [[r for _, r in reversed(held)]]})

    out = attempts.select(by, "at", "row").groupBy(by).applyInPandasWithState(update, f"{by} {dict(attempts.dtypes)[by]}, rows array<string>", "at array<long>, row array<string>", "update", GroupStateTimeout.NoTimeout)
    return out.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()


def running_progress(attempts: DataFrame, name: str, by: list[str] | None = None) -> StreamingQuery:
    """Totals of all answers so far, as a table in memory that is replaced at each trigger."""
    totals = attempts.groupBy(*(by or [])).agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"))
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def new_recordings(recordings: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append recordings of a (source, word, filename) not met before. The state is one key a recording, kept in the checkpoint."""
    fresh = recordings.dropDuplicates(IDENTITY)
    return fresh.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attempts_stream(spark: SparkSession, path: str) -> DataFrame:
    return read_stream(spark, path, schemas.ATTEMPTS)
