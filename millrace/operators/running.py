"""Running sums and ranks that no task computes alone.

A window without, or with a skewed, partition key moves a whole domain to one task. Here the rows are
range-partitioned by (group, order) and written once, so that partitions keep their numbers; the sums
of each (partition, group) are small and give every partition its start; within a partition an ordinary window does
the rest. The result equals the single window for any partitioning.

What is ranged is moved and written, so callers pass keys and sizes and join texts or tokens to the result afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Rows the starts may have (one for each partition and group that meet) to be sent to every task; more are joined by shuffle.
MAX_STARTS = 1_000_000


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of the column over all rows before in its group.

    ``order`` must be unique within a group (ties would have no defined order); a null in a summed
    column counts 0; null groups are a group. Use ``lit(1)`` for a dense 0-based rank.
    """
    keys = [F.col(c) for c in (*group, *order)]
    values = df.withColumns({f"__v_{n}": F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for n, c in sums.items()})
    ranged = materialise(values.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()), "ranged")
    totals = materialise(ranged.groupBy("__p", *group).agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums)), "starts")
    earlier = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__p").alias("__q"), *(F.col(c).alias(f"__g_{c}") for c in group), *(F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in sums))
    same = F.col("__p") == F.col("__q")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = Window.partitionBy("__p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums})
    joined = local.join(F.broadcast(starts) if totals.count() <= MAX_STARTS else starts, same)
    return joined.select(*df.columns, *((F.col(f"__l_{n}") + F.col(f"__s_{n}")).cast("bigint").alias(n) for n in sums))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str | Column, name: str) -> DataFrame:
    """``running_sums`` of one column."""
    return running_sums(df, group, order, {name: F.col(value) if isinstance(value, str) else value})


def dense_rank(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of each row in its group."""
    return running_sums(df, group, order, {name: F.lit(1)})
