"""Row numbers within groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged


def ranked(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place (from 1) of each row in its group, by columns that leave no ties.

    Rows are sorted by range, so a large group lies in many tasks, and written with their place in the task. What a
    task holds of each group is one small row; their running sums give the places. No task sees a whole group.
    """
    offset = (1 << 33) - 1  # of an increasing id: the task above, the place in it below
    own = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("_id", F.monotonically_increasing_id())
    own = staged(own.withColumn("_task", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(offset)).drop("_id"), "ranked")
    parts = own.groupBy(*key, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.join(parts.withColumn("_before", before).drop("_n"), [*key, "_task"]).withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("bigint")).drop("_task", "_at", "_first", "_before")
