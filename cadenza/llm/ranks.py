"""Row numbers and running sums over large ordered groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], weight: Column, into: str) -> DataFrame:
    """Sum of ``weight`` over the rows of ``group`` that stand before a row, in the order of (bucket, *order).

    ``bucket`` is a small integer that follows the wanted order and deals each group's rows to many
    tasks. The rows are summed by (group, bucket), those few sums are added up in order, and only the
    rows of one bucket meet in one task. The sums by bucket are groups x buckets rows, whatever the
    size of the input.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_in"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return rows.join(offsets, on).withColumn(into, F.col("_before") + F.col("_inside")).drop("_before", "_inside", *[f"_{k}" for k in keys])
