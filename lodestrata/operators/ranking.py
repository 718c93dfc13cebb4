"""Places and running sums over tables of any size: range partitions, sums by partition, and a prefix sum over a handful of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.lineage import written

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_LOCAL = 33


def _sort(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranked(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with its place (a long from 1) in ``order``; rows that are equal in it follow each other by a hash of all columns.

    Rows are dealt out by ranges of the order and sorted there; a row's place is its number in its partition after the
    rows of the partitions before. No task sees more than a range, and rows equal in the order are parted by their hash.
    """
    by = [*_sort(order), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank_at_", F.monotonically_increasing_id())
    rows = written(rows)
    part = F.shiftright("rank_at_", _LOCAL)
    sizes = rows.groupBy(part.alias("rank_part_")).agg(F.count("*").alias("rank_n_"))  # a row for each partition
    before = sizes.select("rank_part_", (F.sum("rank_n_").over(W.orderBy("rank_part_")) - F.col("rank_n_")).alias("rank_before_"))
    placed = rows.join(F.broadcast(before), part == F.col("rank_part_"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("rank_before_") + F.col("rank_at_").bitwiseAND((1 << _LOCAL) - 1) + 1).alias(name))


def dense_ranked(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """``df`` with the dense rank of the column ``key`` (null keys: null); distinct keys are ranked and joined back."""
    ranks = ranked(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)
    return df.join(ranks, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], name)


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to it; (group, order) must be unique.

    Ranges of (group, order) part a large group; each part is summed alone and starts from the sums of the group's earlier parts.
    """
    rows = written(df.repartitionByRange(*group, *order).withColumn("sum_part_", F.spark_partition_id()))
    sums = rows.groupBy(*group, "sum_part_").agg(F.sum(value).alias("sum_own_"))
    before = sums.select(*group, "sum_part_", (F.sum("sum_own_").over(W.partitionBy(*group).orderBy("sum_part_")) - F.col("sum_own_")).alias("sum_before_"))
    local = rows.withColumn("sum_local_", F.sum(value).over(W.partitionBy(*group, "sum_part_").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = local.join(before, [local[c].eqNullSafe(before[c]) for c in [*group, "sum_part_"]])
    return joined.select(*[local[c] for c in df.columns], (F.col("sum_local_") + F.col("sum_before_")).alias(name))
