"""Allele statistics of one variant over its array of calls, and their twins over long rows.

Calls count the allele ``a1``: hard calls 0, 1, 2 or expected counts in between;
null is a missing call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_called(calls: Column) -> Column:
    return F.size(F.filter(calls, lambda x: x.isNotNull())).cast("long")


def allele_count(calls: Column) -> Column:
    """The sum of the calls, in the order of samples and in double precision."""
    return F.aggregate(calls, F.lit(0.0), lambda total, x: total + F.coalesce(x.cast("double"), F.lit(0.0)))


def category_count(calls: Column, value: float | None) -> Column:
    test = (lambda x: x.isNull()) if value is None else (lambda x: x == F.lit(value))
    return F.size(F.filter(calls, test)).cast("long")


def _derived(df: DataFrame) -> DataFrame:
    """Rates from ``n_samples``, ``n_called`` and ``allele_count``; null frequencies without any call."""
    called, count = F.col("n_called"), F.col("allele_count")
    af = F.when(called > 0, count / (2 * called))
    return (
        df.withColumn("missing_rate", F.when(F.col("n_samples") == 0, F.lit(0.0)).otherwise((F.col("n_samples") - called) / F.col("n_samples")))
        .withColumn("af", af)
        .withColumn("maf", F.least("af", 1.0 - F.col("af")))
        .withColumn("mac", F.when(called > 0, F.least(count, 2.0 * called - count)))
        .withColumn("polymorphic", F.coalesce(F.col("mac") > 0, F.lit(False)))
    )


STAT_COLUMNS = ("n_samples", "n_called", "allele_count", "missing_rate", "af", "maf", "mac", "polymorphic")


def with_stats(wide: DataFrame, calls: str = "calls") -> DataFrame:
    """Add the statistics of the array column ``calls``.

    Empty arrays have a missing rate of 0 and null frequencies; a null array counts
    as empty.  Statistics that are there already are replaced.
    """
    c = F.coalesce(F.col(calls), F.array().cast("array<float>"))
    base = wide.withColumn("n_samples", F.size(c).cast("long")).withColumn("n_called", n_called(c)).withColumn("allele_count", allele_count(c))
    return _derived(base)


def long_stats(cells: DataFrame, n_samples: int | Column, by: str = "variant_idx", value: str = "value") -> DataFrame:
    """Statistics of long rows, one a variant that has any row.

    ``cells`` has at most one row a variant and sample; samples without a row are
    missing.  Partial sums are formed before the one shuffle.
    """
    x = F.when(~F.isnan(value), F.col(value)).cast("double")
    sums = cells.groupBy(by).agg(F.count(x).alias("n_called"), F.coalesce(F.sum(x), F.lit(0.0)).alias("allele_count"))
    return _derived(sums.withColumn("n_samples", n_samples if isinstance(n_samples, Column) else F.lit(n_samples).cast("long")))


def whole_mac() -> Column:
    """The minor allele count as a whole number, null if it is a fraction."""
    return F.when(F.col("mac") == F.floor("mac"), F.col("mac").cast("long"))
