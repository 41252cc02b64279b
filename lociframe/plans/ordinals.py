"""Consecutive numbers and running sums over a whole ordered table, without one task sorting it all.

The table is range-partitioned, sorted within partitions and stored; a row's number
is its place in the partition plus the rows of the partitions before, and a running
sum is the sum within the partition plus those of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.plans.joins import sized_join
from lociframe.plans.workspace import Workspace

_PLACE = (1 << 33) - 1


def with_running(df: DataFrame, order_by: str, ordinal: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Add the place of each row from 0 as ``ordinal``, and for each ``{amount: name}`` the sum up to and with the row.

    Ties of ``order_by`` are placed in any order; null amounts add nothing; an
    empty table stays empty.
    """
    sums = sums or {}
    ordered = df.repartitionByRange(order_by).sortWithinPartitions(order_by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    placed = Workspace(df.sparkSession, "ordinals").store(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__place", place), "ordered")
    # one row a partition
    totals = placed.groupBy("__part").agg(F.count("*").alias("__rows"), *[F.coalesce(F.sum(a), F.lit(0)).cast("long").alias(f"__of_{n}") for a, n in sums.items()])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    names = ["__rows", *[f"__of_{n}" for n in sums.values()]]
    before = totals.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(c) for c in names])
    out = sized_join(placed, before, "__part", "inner")
    if ordinal:
        out = out.withColumn(ordinal, F.col("__rows") + F.col("__place"))
    here = W.partitionBy("__part").orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    for amount, name in sums.items():
        out = out.withColumn(name, F.col(f"__of_{name}") + F.coalesce(F.sum(amount).over(here), F.lit(0)))
    return out.drop("__part", "__place", *names)


def with_ordinal(df: DataFrame, order_by: str, name: str = "ordinal") -> DataFrame:
    """Add the place of each row in the order of ``order_by``, from 0."""
    return with_running(df, order_by, ordinal=name)
