"""Row numbers within groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import written


def with_ordinal(df: DataFrame, group: str, order: list[str], name: str = "o", size: str = "k") -> DataFrame:
    """Adds the ordinal (from 0) of each row within its group by ``order``, and the group's size.

    Rows are range-partitioned by group and order, numbered within each partition, and moved by the rows of the group in
    earlier partitions. A group with a third of all rows spreads over its share of the partitions. ``order`` must be unique
    within a group for a definite result. Null groups form one group.
    """
    keys = [group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_p", F.shiftright("_m", 33)), "ordinals")
    parts = placed.groupBy(group, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    by = W.partitionBy(group)  # one row per group and partition
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(size, F.sum("_n").over(by))
    offsets = offsets.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "_first", "_before", size)
    joined = placed.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias(name), size)
