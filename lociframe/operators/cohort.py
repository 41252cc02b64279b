"""Operators over wide cohort rows: one row a variant, with an array of calls in sample order.

The order of reading is: select samples, statistics, filter, missing policy, and on
the sparse path orientation to the minor allele.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.errors import InvalidOptionError, InvalidSourceError, MissingDataError, SampleFilterError, tag
from lociframe.filters import FilterExpr
from lociframe.functions.alleles import STAT_COLUMNS, with_stats
from lociframe.plans.joins import BROADCAST_ROWS, sized_join, within
from lociframe.plans.ordinals import with_ordinal, with_running
from lociframe.plans.predicates import NO, needed, simplify, to_column, to_filter, uses_stats

VARIANT_COLUMNS = ("chrom", "pos", "id", "a0", "a1")
SAMPLE_COLUMNS = ("fid", "iid", "father", "mother", "sex", "phenotype")


def sample_places(samples: DataFrame, keep: Iterable[str]) -> list[int]:
    """Ordinals of the samples to keep, in source order; all must be there, once each."""
    wanted = list(keep)
    if len(set(wanted)) < len(wanted):
        raise InvalidOptionError("a sample is named twice")
    found = samples.where(F.col("iid").isin(*wanted)).select("sample_idx", "iid").collect() if wanted else []
    named = {r.iid for r in found}
    if len(named) < len(wanted) or len(found) > len(named):
        missing = len(wanted) - len(named)
        raise SampleFilterError(f"of {len(wanted)} requested samples {len(found)} were retained and {missing} are missing")
    return sorted(r.sample_idx for r in found)


def keep_samples(wide: DataFrame, places: Sequence[int] | None, calls: str = "calls", per_sample: int = 1) -> DataFrame:
    """Calls of the samples at ``places`` only; ``per_sample`` is 2 for haplotypes."""
    if places is None:
        return wide
    at = [p * per_sample + k for p in places for k in range(per_sample)]
    # one pass over the calls: picking by place would work out a derived array once for each place
    return wide.withColumn(calls, F.filter(calls, lambda _, i: i.isin(*at) if at else F.lit(False)))


def keep_variants(wide: DataFrame, expr: FilterExpr | None, calls: str = "calls") -> DataFrame:
    """Variants that pass the filter, whose statistics are those of ``calls``.

    A filter that can't hold plans no scan; what metadata alone decide is decided
    before any statistics.  Statistics used are left in the result.
    """
    node = simplify(expr)
    if node is NO:
        return wide.where(F.lit(False))
    first = needed(node)
    rows = wide.where(to_filter(first)) if first.kind != "yes" else wide
    return with_stats(rows, calls).where(to_filter(node)) if uses_stats(node) else rows


def keep_ids(variants: DataFrame, ids: DataFrame, negate: bool = False) -> DataFrame:
    """Variants whose ``id`` is (or, negated, isn't) in a table of IDs of any size.

    A null ID is in no table, so it goes only through the negation.
    """
    wanted = ids.select("id").where(F.col("id").isNotNull()).distinct()
    return sized_join(variants, wanted, "id", "left_anti" if negate else "left_semi")


def keep_cells(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Long cells of the samples listed, once each however often a sample is listed."""
    return sized_join(cells, samples.select("sample_idx").distinct(), "sample_idx", "left_semi")


def write_cohort(wide: DataFrame, path: str) -> None:
    """Write wide rows as parquet, sorted by place within ranges of places, so that filters by place skip row groups."""
    wide.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "variant_idx").write.parquet(path)


def without_stats(wide: DataFrame) -> DataFrame:
    return wide.drop(*STAT_COLUMNS)


def _mean(calls: Column) -> Column:
    """The mean of the called values, summed in order in single precision."""
    total = F.aggregate(calls, F.lit(0.0).cast("float"), lambda a, x: (a + F.coalesce(x, F.lit(0.0).cast("float"))).cast("float"))
    return (total / F.size(F.filter(calls, lambda x: x.isNotNull())).cast("float")).cast("float")


def _raise(kind: type[Exception], message: str) -> Column:
    return F.raise_error(F.concat(F.lit(tag(kind, message)), F.lit(" "), F.coalesce("id", F.lit(""))))


def apply_missing(wide: DataFrame, policy: str = "nan", calls: str = "calls", kept: Column | None = None) -> DataFrame:
    """``nan`` leaves nulls (exports write NaN), ``raise`` fails on them, ``impute`` puts in the mean of the variant.

    Only rows for which ``kept`` holds can fail; filters may be planned in any order,
    so a filter in front alone doesn't keep a failing value from being worked out.
    """
    c = F.col(calls)
    kind = wide.schema[calls].dataType
    some_null = F.exists(c, lambda x: x.isNull())
    held = F.lit(True) if kept is None else kept
    if policy == "nan":
        return wide
    if policy == "raise":
        return wide.withColumn(calls, F.when(held & some_null, _raise(MissingDataError, "missing calls in variant").cast(kind)).otherwise(c))
    if policy == "impute":
        filled = F.transform(c, lambda x: F.coalesce(x, F.col("__mean").cast(kind.elementType)))
        no_call = (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNotNull())
        failed = _raise(MissingDataError, "no call to impute from in variant").cast(kind)
        return wide.withColumn("__mean", _mean(c)).withColumn(calls, F.when(held & no_call, failed).when(some_null & ~no_call, filled).otherwise(c)).drop("__mean")
    raise InvalidOptionError(f"unknown missing-data policy {policy!r}")


def read_variants(wide: DataFrame, expr: FilterExpr | None, policy: str = "nan", calls: str = "calls", failed: str | None = None, counted: str | None = None) -> DataFrame:
    """Variants that pass the filter, under a missing-data policy that fails for these alone.

    Statistics are those of the column ``counted``, or else of ``calls``.  ``failed`` names a column with the text of a decoding error, null where there is
    none; it too fails only for variants that pass.
    """
    node = simplify(expr)
    if node is NO:
        return wide.where(F.lit(False)).drop(*([failed] if failed else []))
    first = needed(node)
    rows = wide.where(to_filter(first)) if first.kind != "yes" else wide
    if uses_stats(node):
        rows = with_stats(rows, counted or calls)
    kept, judged = to_column(node), to_filter(node)
    if failed:
        if uses_stats(node):
            uncounted = to_column(first) & F.col("__failed").startswith(tag(InvalidSourceError, ""))
            judged = F.when(uncounted, F.raise_error(F.col("__failed")).cast("boolean")).otherwise(kept)
        rows = rows.withColumn("__failed", F.col(failed))
        error = F.raise_error(F.col(failed)).cast(rows.schema[calls].dataType)
        rows = rows.withColumn(calls, F.when(kept & F.col(failed).isNotNull(), error).otherwise(F.col(calls))).drop(failed)
    rows = apply_missing(rows, policy, calls, kept)
    return without_stats(rows.where(judged)).drop("__failed")


def orient_minor(wide: DataFrame, calls: str = "calls", most: int = 2) -> DataFrame:
    """Count the minor allele: where the alternate is commoner, values become ``most - x`` and the alleles swap.

    ``most`` is 2 for genotypes and 1 for haplotypes.  Ties stay; nulls stay null.
    """
    c = F.col(calls)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    called = F.size(F.filter(c, lambda x: x.isNotNull()))
    marked = wide.withColumn("flipped", 2 * total > F.lit(float(most)) * called)
    turned = F.transform(c, lambda x: (F.lit(float(most)).cast("float") - x).cast("float"))
    swap = F.col("flipped")
    return marked.withColumns({calls: F.when(swap, turned).otherwise(c), "a0": F.when(swap, F.col("a1")).otherwise(F.col("a0")), "a1": F.when(swap, F.col("a0")).otherwise(F.col("a1"))})


def long_cells(wide: DataFrame, calls: str = "calls", keep: Sequence[str] = ("variant_idx",)) -> DataFrame:
    """One row a cell: ``variant_idx, sample_idx, value``; the place in the array is the sample."""
    return wide.select(*keep, F.posexplode(calls).alias("at", "value")).select(*keep, F.col("at").cast("long").alias("sample_idx"), "value")


def nonzero_cells(wide: DataFrame, calls: str = "calls", keep: Sequence[str] = ("variant_idx",)) -> DataFrame:
    """The sparse long form: cells that are neither zero nor missing."""
    return long_cells(wide, calls, keep).where((F.col("value") != 0) & F.col("value").isNotNull())


def csc_columns(wide: DataFrame, calls: str = "calls") -> DataFrame:
    """Sparse columns: ``variant_idx, column, indices, data, nnz, indptr_end``.

    ``column`` numbers the retained variants in source order; ``indptr_end`` is the
    column's end in the joined ``indices`` and ``data`` of all columns.
    """
    pairs = F.filter(F.transform(calls, lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("float").alias("x"))), lambda p: p["x"] != 0)
    cut = wide.select("variant_idx", F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["x"]).alias("data"))
    counted = cut.withColumn("nnz", F.size("indices").cast("long"))
    ended = with_running(counted, "variant_idx", ordinal="column", sums={"nnz": "indptr_end"})
    return ended.withColumn("indptr_end", F.when(_fits("indptr_end").isNotNull(), F.col("indptr_end")))


#: Variants whose values of one sample share a row of the transposed forms.
PART_VARIANTS = 65_536
#: The largest place and number of entries that 32-bit indices hold.
MOST_32 = (1 << 31) - 1


def csr_parts(wide: DataFrame, calls: str = "calls", part_variants: int = PART_VARIANTS) -> DataFrame:
    """Sparse rows: ``sample_idx, part, indices, data, nnz, indptr_end``.

    ``indices`` are columns, numbered over the retained variants in source order.  A
    sample's row is parted by columns, so no task gathers more than ``part_variants``
    entries of it; parts without entries have no row.  ``indptr_end`` is the part's
    end in the joined entries of all samples.  Columns or entries beyond 32 bits fail.
    """
    numbered = with_ordinal(wide.select("variant_idx", calls), "variant_idx", "column")
    cells = nonzero_cells(numbered, calls, ("column",)).withColumn("part", F.floor(F.col("column") / part_variants).cast("long"))
    entry = F.struct(_fits("column").alias("i"), F.col("value").cast("float").alias("x"))
    parts = cells.groupBy("sample_idx", "part").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    rows = parts.select("sample_idx", "part", F.transform("e", lambda p: p["i"]).alias("indices"), F.transform("e", lambda p: p["x"]).alias("data"), F.size("e").cast("long").alias("nnz"))
    summed = with_running(rows.withColumn("__order", F.col("sample_idx") * (1 << 31) + F.col("part")), "__order", sums={"nnz": "indptr_end"}).drop("__order")
    return summed.withColumn("indptr_end", _fits("indptr_end"))


def _fits(name: str) -> Column:
    """A whole number in 32 bits, or an error."""
    return F.when(F.col(name) <= MOST_32, F.col(name).cast("int")).otherwise(F.raise_error(F.lit(tag(InvalidSourceError, "the sparse result doesn't fit 32-bit indices"))).cast("int"))


def csr_rows(wide: DataFrame, n_samples: int, calls: str = "calls") -> DataFrame:
    """Entries of each sample row: ``sample_idx, nnz``, rows without entries included."""
    counts = nonzero_cells(wide, calls).groupBy("sample_idx").agg(F.count("*").alias("nnz"))
    rows = wide.sparkSession.range(n_samples).select(F.col("id").alias("sample_idx"))
    return rows.join(counts, "sample_idx", "left").select("sample_idx", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def sample_major(wide: DataFrame, calls: str = "calls", part_variants: int = PART_VARIANTS) -> DataFrame:
    """The transpose: ``sample_idx, part, values``, the values of a sample for all variants in source order.

    A sample's values are parted: part ``k`` holds those of the retained variants from the
    one numbered ``k * part_variants`` on, so no task gathers more than that many of them.
    """
    numbered = with_ordinal(wide.select("variant_idx", calls), "variant_idx", "column")
    cells = long_cells(numbered, calls, ("column",)).withColumn("part", F.floor(F.col("column") / part_variants).cast("long"))
    ordered = F.sort_array(F.collect_list(F.struct("column", "value")))
    return cells.groupBy("sample_idx", "part").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def haplotype_samples(samples: DataFrame) -> DataFrame:
    """Two rows a sample, with ``source_sample_index`` and ``haplotype_index``."""
    return samples.withColumn("source_sample_index", F.col("sample_idx").cast("long")).withColumn("haplotype_index", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))


def variant_blocks(wide: DataFrame, size: int, name: str = "block_idx") -> DataFrame:
    """Number retained variants in source order and part them into blocks of ``size``."""
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise InvalidOptionError("a block has a positive whole number of variants")
    return with_ordinal(wide, "variant_idx", "retained_idx").withColumn(name, F.floor(F.col("retained_idx") / size).cast("long"))


def variant_window(wide: DataFrame, start: int, length: int) -> DataFrame:
    """``length`` retained variants from the one numbered ``start`` in source order.

    The numbers are worked out over ``variant_idx`` alone, without sorting the rows in one
    place; whole rows are then read only between the window's first and last ``variant_idx``,
    bounds that a scan takes.
    """
    numbered = with_ordinal(wide.select("variant_idx"), "variant_idx", "__number")
    inside = numbered.where((F.col("__number") >= start) & (F.col("__number") < start + length))
    low, high = inside.agg(F.min("variant_idx"), F.max("variant_idx")).first()
    if low is None:
        return wide.where(F.lit(False))
    before = numbered.where(F.col("variant_idx") < low).count()
    rows = with_ordinal(wide.where(F.col("variant_idx").between(low, high)), "variant_idx", "__number")
    return rows.where((F.col("__number") + before >= start) & (F.col("__number") + before < start + length)).drop("__number")


#: Positions that share a bin of the range join.
BIN = 1 << 16


def region_join(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """``(region_idx, variant)`` for all variants in each region; regions without one stay with nulls.

    ``regions`` has ``region_idx, chrom, start, end``.  Both sides meet in bins of
    positions by equal keys, so the join is planned without comparing all pairs;
    regions are broadcast if they are counted to be few, and else a bin of very many
    variants is divided.  Null or turned bounds hold
    nothing.
    """
    binned = regions.where(F.col("start") <= F.col("end")).select(
        "region_idx", F.col("chrom").alias("r_chrom"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))).alias("__bin")
    )
    place = lambda chrom: F.concat_ws(":", F.col("__bin").cast("string"), chrom)
    here = variants.withColumn("__bin", F.floor(F.col("pos") / BIN)).where(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    right = binned.withColumn("__place", place("r_chrom")).drop("__bin", "r_chrom")
    met = sized_join(here.withColumn("__place", place("chrom")).drop("__bin"), right, "__place", "inner", spread_by="variant_idx")
    hits = met.where(F.col("pos").between(F.col("start"), F.col("end"))).drop("__place", "start", "end")
    return regions.join(hits.withColumnRenamed("chrom", "variant_chrom"), "region_idx", "left")


def align_design(samples: DataFrame, table: DataFrame, on: str = "iid", complete: bool = False) -> DataFrame:
    """Samples in source order with the columns of a phenotype or covariate table, null where it has none.

    With ``complete`` a sample that lacks any of these columns is a MissingDataError.
    """
    joined = samples.join(table, on, "left").orderBy("sample_idx")
    if not complete:
        return joined
    lacking = F.lit(False)
    for name in (c for c in table.columns if c != on):
        lacking = lacking | F.col(name).isNull()
    failed = F.raise_error(F.concat(F.lit(tag(MissingDataError, "no phenotype or covariate for sample ")), F.col(on).cast("string"))).cast("long")
    return joined.withColumn("sample_idx", F.when(lacking, failed).otherwise(F.col("sample_idx")))


def diagnostics(candidates: DataFrame, retained: DataFrame, n_source_samples: int, n_samples: int) -> DataFrame:
    """One row of counts: samples and variants offered, kept and dropped."""
    none = F.lit(0).cast("long")
    offered = candidates.agg(F.count("*").alias("candidate_variants")).withColumn("retained_variants", none)
    kept = retained.agg(F.count("*").alias("retained_variants")).withColumn("candidate_variants", none)
    both = offered.unionByName(kept).agg(F.sum("candidate_variants").alias("candidate_variants"), F.sum("retained_variants").alias("retained_variants"))
    return both.select(
        F.lit(n_source_samples).cast("long").alias("source_samples"), F.lit(n_samples).cast("long").alias("retained_samples"),
        "candidate_variants", "retained_variants", (F.col("candidate_variants") - F.col("retained_variants")).alias("dropped_variants"),
    )
