"""Sequences: neighbours, runs, the last rows of each key, and what a bounded cache holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Append previous and following: the column's value in the rows before and after."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"previous": F.lag(column).over(w), "following": F.lead(column).over(w)})


def with_runs(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Append run_length, and run_last: whether the row ends its run of equal values."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.lag(column).over(w).eqNullSafe(F.col(column)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    whole = Window.partitionBy(*by, "_run")
    last = F.lead("_run").over(w)
    rows = rows.withColumns({"run_length": F.count("*").over(whole), "run_last": ~last.eqNullSafe(F.col("_run"))})
    return rows.drop("_new", "_run")


def latest(df: DataFrame, by: list[str], order: list[Column], limit: int = 50) -> DataFrame:
    """The first ``limit`` rows of each key in the order (give it descending for the last)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def resident(df: DataFrame, key: str, when: list[str], limit: int = 64) -> DataFrame:
    """The keys that a cache of ``limit`` entries holds at the end: those of the latest accesses. Pre-aggregated, then a top-k."""
    last = df.groupBy(key).agg(F.max(F.struct(*when)).alias("last"))
    return last.orderBy(F.col("last").desc()).limit(limit).select(key, "last.*")
