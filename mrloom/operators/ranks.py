"""Exact ranks inside groups, however large a group is.

Rows are dealt by range of (group, order), so a large group lies in many partitions. Each partition counts the rows of each
of its groups, a running sum of these few counts says how many rows of a group stand before a partition, and a row's rank
is that number and its place among its group's rows in the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def ranked(table: DataFrame, group: str, order: list[Column], rank: str = "rank", size: str = "size") -> DataFrame:
    """table with the rank (from 1) of each row in its group and the group's size. order should tell all rows apart; null is a group.

    The rows are written once, so that the counts and the ranks see the same partitions.
    """
    keys = {f"_k{i}": c for i, c in enumerate([F.col(group), *order])}
    dealt = table.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    held = stored(dealt.drop(*(k for k in keys if k != "_k0")), "ranks")
    parts = held.groupBy("_k0", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a group's parts are neighbours: about as many rows as partitions and groups
    w = Window.partitionBy("_k0").orderBy("_part")
    parts = parts.withColumns({"_before": F.sum("_n").over(w) - F.col("_n"), size: F.sum("_n").over(Window.partitionBy("_k0"))})
    known = parts.select(F.col("_k0").alias("_g"), F.col("_part").alias("_p"), "_first", "_before", size)
    rows = held.join(known, F.col("_k0").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return rows.withColumn(rank, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")).select(*table.columns, rank, size)
