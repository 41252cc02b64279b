"""Queries of the cohort operators: filters and statistics over the genotype tables, and
array operators over a wide cohort derived from ``embeddings``, ``nation`` and ``customer``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe import filters as f
from lociframe.functions.alleles import STAT_COLUMNS, category_count, long_stats, whole_mac, with_stats
from lociframe.functions.calls import decoded_ds, decoded_gt, decoded_phased, expected_dosage, implied_split, key_place, phased_dosage, sample_value, split_dosage
from lociframe.operators import cohort as ops
from lociframe.plans.predicates import needed, simplify, to_filter, uses_stats
from lociframe.session import reach_workers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FRAME = ("variant_idx", *ops.VARIANT_COLUMNS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# ---- the genotype tables: typed variants with long calls ----------------------------------------


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a variant and sample; rows that occur twice count once."""
    value = F.when(~F.isnan("dosage"), F.col("dosage").cast("double"))
    return table(spark, sf_dir, "calls").groupBy("variant_idx", "sample_idx").agg(F.max(value).alias("value"))


def typed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "variants").select(*FRAME, "alt_allele", "qual")


def with_call_stats(spark: SparkSession, sf_dir: str, variants: DataFrame) -> DataFrame:
    """Variants with the statistics of their calls among all samples; without any call all are missing."""
    n = table(spark, sf_dir, "samples").count()
    stats = long_stats(cells(spark, sf_dir), n)
    joined = variants.join(stats, "variant_idx", "left")
    none = {"n_samples": F.lit(n).cast("long"), "n_called": F.lit(0).cast("long"), "allele_count": F.lit(0.0), "missing_rate": F.lit(1.0), "polymorphic": F.lit(False)}
    return joined.withColumns({k: F.coalesce(k, v) for k, v in none.items()})


def filtered(expr: f.FilterExpr, columns: tuple[str, ...] = FRAME) -> Query:
    """Filter the typed variants: metadata first, statistics only where the filter uses them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        node = simplify(expr)
        rows = typed_variants(spark, sf_dir).where(to_filter(needed(node)))
        if uses_stats(node):
            rows = with_call_stats(spark, sf_dir, rows).where(to_filter(node))
        return rows.select(*columns)

    return run


V_SQL = """
WITH cells AS (SELECT variant_idx, sample_idx, max(CASE WHEN NOT isnan(dosage) THEN dosage::DOUBLE END) AS value FROM calls GROUP BY ALL),
sums AS (SELECT variant_idx, count(value) AS n_called, coalesce(sum(value), 0.0) AS ac FROM cells GROUP BY 1),
base AS (SELECT v.*, (SELECT count(*) FROM samples) AS n_samples, coalesce(n_called, 0) AS n_called, coalesce(ac, 0.0)::DOUBLE AS ac
  FROM variants v LEFT JOIN sums USING (variant_idx)),
v AS (SELECT variant_idx, chrom, pos, id, a0, a1, alt_allele, qual, n_samples, n_called, ac AS allele_count,
  (n_samples - n_called)::DOUBLE / n_samples AS missing_rate,
  CASE WHEN n_called > 0 THEN ac / (2 * n_called) END AS af,
  CASE WHEN n_called > 0 THEN least(ac / (2 * n_called), 1 - ac / (2 * n_called)) END AS maf,
  CASE WHEN n_called > 0 THEN least(ac, 2.0 * n_called - ac) END AS mac FROM base)
"""
_F = "SELECT variant_idx, chrom, pos, id, a0, a1 FROM v WHERE "
_ONE_ALT = "coalesce(NOT contains(alt_allele, ','), true)"


def _f32(x: float) -> str:
    return f"{x}::FLOAT::DOUBLE"


for _name, _expr, _where in (
    ("filter_chrom", f.chrom("7"), "chrom = '7'"),
    ("filter_region", f.region("1:20000000-160000000"), "chrom = '1' AND pos BETWEEN 20000000 AND 160000000"),
    ("filter_snp", f.snp(), f"strlen(a0) = 1 AND strlen(a1) = 1 AND {_ONE_ALT}"),
    ("filter_biallelic", f.biallelic(), _ONE_ALT),
    ("filter_qual", f.qual(min=20.5, max=60.1), f"qual::DOUBLE BETWEEN {_f32(20.5)} AND {_f32(60.1)} AND NOT isnan(qual)"),
    ("filter_not_qual_keeps_null", ~f.qual(min=30), "NOT coalesce(qual >= 30 AND NOT isnan(qual), false)"),
    ("filter_maf", f.maf(min=0.1, max=0.45), f"maf BETWEEN {_f32(0.1)} AND {_f32(0.45)}"),
    ("filter_not_maf", ~f.maf(max=0.2), f"NOT coalesce(maf <= {_f32(0.2)}, false)"),
    ("filter_mac", f.mac(min=2, max=4), "mac BETWEEN 2 AND 4"),
    ("filter_missing_rate", f.missing_rate(0.996), f"missing_rate <= {_f32(0.996)}"),
    ("filter_polymorphic", f.polymorphic(), "coalesce(mac > 0, false)"),
    ("filter_id_in", f.id_in(["rv4456", "rv2224", "AX-50354316", "."]), "id IN ('rv4456', 'rv2224', 'AX-50354316', '.')"),
    ("filter_not_id_in", ~f.id_in(["rv4456", "."]), "id NOT IN ('rv4456', '.')"),
    ("filter_or_mixed", (f.chrom("1") & f.maf(min=0.1)) | (f.qual(min=60) & ~f.polymorphic()) | f.id_in(["rv2392"]),
     f"(chrom = '1' AND coalesce(maf >= {_f32(0.1)}, false)) OR (coalesce(qual >= 60 AND NOT isnan(qual), false) AND NOT coalesce(mac > 0, false)) OR id = 'rv2392'"),
    ("filter_composed", f.snp() & f.qual(min=20) & f.maf(min=0.05) & f.missing_rate(0.999), f"strlen(a0) = 1 AND strlen(a1) = 1 AND {_ONE_ALT} AND qual >= 20 AND NOT isnan(qual) AND maf >= {_f32(0.05)} AND missing_rate <= {_f32(0.999)}"),
    ("filter_contradiction", f.chrom("1") & f.maf(min=0.1) & f.chrom("2"), "false"),
):
    query(_name, V_SQL + _F + _where)(filtered(_expr))


@query("variants_frame", "SELECT variant_idx, chrom, pos, id, a0, a1 FROM variants")
def variants_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_variants(spark, sf_dir).select(*FRAME)


@query("samples_frame", "SELECT sample_idx, " + ", ".join(f"CASE WHEN {c} NOT IN ('0', '.', 'NA') THEN {c} END AS {c}" if c in ("fid", "father", "mother") else c for c in ops.SAMPLE_COLUMNS) + " FROM samples")
def samples_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample columns with the tokens for none made null."""
    none = {c: F.when(~F.col(c).isin("0", ".", "NA"), F.col(c)) for c in ("fid", "father", "mother")}
    return table(spark, sf_dir, "samples").select("sample_idx", *ops.SAMPLE_COLUMNS).withColumns(none)


@query("variant_stats_long", V_SQL + "SELECT variant_idx, n_samples::BIGINT AS n_samples, n_called::BIGINT AS n_called, round(allele_count, 9) AS allele_count, round(missing_rate, 9) AS missing_rate, round(af, 9) AS af, round(maf, 9) AS maf, round(mac, 9) AS mac, coalesce(mac > 0, false) AS polymorphic FROM v")
def variant_stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = with_call_stats(spark, sf_dir, typed_variants(spark, sf_dir).select("variant_idx"))
    return stats.select("variant_idx", "n_samples", "n_called", *[F.round(c, 9).alias(c) for c in ("allele_count", "missing_rate", "af", "maf", "mac")], "polymorphic")


@query("mac_whole", V_SQL + "SELECT variant_idx, CASE WHEN mac = floor(mac) THEN mac::BIGINT END AS mac FROM v")
def mac_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_call_stats(spark, sf_dir, typed_variants(spark, sf_dir).select("variant_idx")).select("variant_idx", whole_mac().alias("mac"))


@query("ids_semi_join", "SELECT variant_idx, chrom, pos, id, a0, a1 FROM variants WHERE id IN (SELECT id FROM variants WHERE qual >= 80)")
def ids_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = typed_variants(spark, sf_dir)
    return ops.keep_ids(variants.select(*FRAME), variants.where(F.col("qual") >= 80)).select(*FRAME)


@query("ids_anti_join", "SELECT variant_idx, chrom, pos, id, a0, a1 FROM variants WHERE id NOT IN (SELECT id FROM variants WHERE qual >= 80)")
def ids_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = typed_variants(spark, sf_dir)
    return ops.keep_ids(variants.select(*FRAME), variants.where(F.col("qual") >= 80), negate=True).select(*FRAME)


@query("sample_keep_semi_join", "SELECT variant_idx, sample_idx, value FROM (SELECT variant_idx, sample_idx, max(CASE WHEN NOT isnan(dosage) THEN dosage::DOUBLE END) AS value FROM calls GROUP BY ALL) WHERE sample_idx IN (SELECT sample_idx FROM samples WHERE sex IN ('2', 'F'))")
def sample_keep_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keep_cells(cells(spark, sf_dir), table(spark, sf_dir, "samples").where(F.col("sex").isin("2", "F")))


@query("sample_call_counts", "SELECT sample_idx, count(*)::BIGINT AS n_cells, count(value)::BIGINT AS n_called FROM (SELECT variant_idx, sample_idx, max(CASE WHEN NOT isnan(dosage) THEN dosage END) AS value FROM calls GROUP BY ALL) GROUP BY 1")
def sample_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("sample_idx").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_called"))


# ---- the wide cohort ----------------------------------------------------------------------------

_X = "cast(x AS double) + ((vec_id % 41) - 20) / 50D"
_GONE = "pmod(cast(floor(abs(cast(x AS double)) * 10000D) AS bigint), 23) = 0"
WIDE = {
    "variant_idx": "vec_id", "chrom": "cast(1 + label AS string)", "pos": "1000 + 10 * vec_id", "id": "concat('rs', cast(vec_id AS string))",
    "a0": "CASE WHEN vec_id % 13 = 0 THEN 'AT' WHEN vec_id % 4 = 0 THEN 'A' WHEN vec_id % 4 = 1 THEN 'C' WHEN vec_id % 4 = 2 THEN 'G' ELSE 'T' END",
    "a1": "CASE WHEN vec_id % 4 = 0 THEN 'G' WHEN vec_id % 4 = 1 THEN 'T' WHEN vec_id % 4 = 2 THEN 'A' ELSE 'C' END",
    "alt_allele": "CASE WHEN vec_id % 17 = 0 THEN 'G,T' ELSE 'N' END", "qual": "cast(CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id % 60 END AS float)",
    "calls": f"transform(embedding, x -> cast(CASE WHEN {_GONE} THEN NULL WHEN {_X} < -0.1D THEN 0 WHEN {_X} < 0.1D THEN 1 ELSE 2 END AS float))",
    "dosages": f"transform(embedding, x -> CASE WHEN {_GONE} THEN NULL ELSE least(greatest(1D + 2D * cast(x AS double), 0D), 2D) END)",
    "first": "transform(embedding, x -> x > 0)",
}

E_SQL = """
WITH e AS (SELECT vec_id AS variant_idx, (1 + label)::VARCHAR AS chrom, 1000 + 10 * vec_id AS pos, 'rs' || vec_id AS id,
  CASE WHEN vec_id % 13 = 0 THEN 'AT' WHEN vec_id % 4 = 0 THEN 'A' WHEN vec_id % 4 = 1 THEN 'C' WHEN vec_id % 4 = 2 THEN 'G' ELSE 'T' END AS a0,
  CASE WHEN vec_id % 4 = 0 THEN 'G' WHEN vec_id % 4 = 1 THEN 'T' WHEN vec_id % 4 = 2 THEN 'A' ELSE 'C' END AS a1 FROM embeddings),
x AS (SELECT vec_id AS variant_idx, unnest(range(0, len(embedding))) AS sample_idx, unnest(embedding)::DOUBLE AS x FROM embeddings),
g AS (SELECT variant_idx, sample_idx, x, CASE WHEN (floor(abs(x) * 10000.0::DOUBLE)::BIGINT) % 23 = 0 THEN NULL
    WHEN x + ((variant_idx % 41) - 20) / 50.0::DOUBLE < -0.1::DOUBLE THEN 0
    WHEN x + ((variant_idx % 41) - 20) / 50.0::DOUBLE < 0.1::DOUBLE THEN 1 ELSE 2 END::FLOAT AS value,
  CASE WHEN (floor(abs(x) * 10000.0::DOUBLE)::BIGINT) % 23 = 0 THEN NULL ELSE least(greatest(1.0::DOUBLE + 2.0::DOUBLE * x, 0.0), 2.0) END AS dosage FROM x),
s AS (SELECT variant_idx, count(*) AS n, count(value) AS nc, coalesce(sum(value::DOUBLE), 0.0) AS ac FROM g GROUP BY 1),
st AS (SELECT *, (n - nc)::DOUBLE / n AS missing_rate, CASE WHEN nc > 0 THEN ac / (2 * nc) END AS af,
  CASE WHEN nc > 0 THEN least(ac / (2 * nc), 1 - ac / (2 * nc)) END AS maf, CASE WHEN nc > 0 THEN least(ac, 2.0 * nc - ac) END AS mac FROM s)
"""
#: Samples of the subset queries; all others are left out as a keep-list would.
SUBSET = ("S3", "S1", "S11", "S20", "S33", "S47", "S60")
_KEPT = "(" + ", ".join(s[1:] for s in SUBSET) + ")"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a variant with the calls, dosages and phases of all samples."""
    return table(spark, sf_dir, "embeddings").selectExpr(*[f"{e} AS {k}" for k, e in WIDE.items()])


def wide_samples(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("sample_idx"), F.concat(F.lit("F"), F.floor(F.col("id") / 4).cast("string")).alias("fid"), F.concat(F.lit("S"), "id").alias("iid"))


def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keep_samples(wide(spark, sf_dir), ops.sample_places(wide_samples(spark), SUBSET))


def haplotypes(rows: DataFrame) -> DataFrame:
    """Two values a sample of the hard calls; a heterozygote's alternate lies where ``first`` tells."""
    both = F.transform(F.arrays_zip("calls", "first"), lambda z: F.when(z["calls"].isNull(), F.array(F.lit(None).cast("float"), F.lit(None).cast("float"))).when(z["calls"] != 1, F.array(z["calls"] / 2, z["calls"] / 2).cast("array<float>")).when(z["first"], F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")).otherwise(F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")))
    return rows.withColumn("haplotypes", F.flatten(both))


_HAPLO_SQL = E_SQL + """, h AS (SELECT variant_idx, 2 * sample_idx + k AS row_idx, CASE WHEN value <> 1 THEN value / 2
    WHEN value = 1 THEN CASE WHEN (x > 0) = (k = 1) THEN 1 ELSE 0 END END::FLOAT AS value FROM g, (SELECT unnest([0, 1]) AS k)) """


@query("variant_counts", E_SQL + "SELECT variant_idx, count(*) FILTER (value = 0) AS hom_ref, count(*) FILTER (value = 1) AS het, count(*) FILTER (value = 2) AS hom_alt, count(*) FILTER (value IS NULL) AS missing FROM g GROUP BY 1")
def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("calls")
    return wide(spark, sf_dir).select("variant_idx", category_count(c, 0.0).alias("hom_ref"), category_count(c, 1.0).alias("het"), category_count(c, 2.0).alias("hom_alt"), category_count(c, None).alias("missing"))


@query("variant_stats_hardcall", E_SQL + "SELECT variant_idx, n::BIGINT AS n_samples, nc::BIGINT AS n_called, ac AS allele_count, missing_rate, af, maf, mac, coalesce(mac > 0, false) AS polymorphic FROM st")
def variant_stats_hardcall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stats(wide(spark, sf_dir)).select("variant_idx", *STAT_COLUMNS)


@query("variant_stats_dosage", E_SQL + "SELECT variant_idx, count(dosage)::BIGINT AS n_called, round(sum(dosage), 6) AS allele_count, round(sum(dosage) / (2 * count(dosage)), 6) AS af, round(least(sum(dosage), 2.0 * count(dosage) - sum(dosage)), 6) AS mac FROM g GROUP BY 1")
def variant_stats_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stats(wide(spark, sf_dir), "dosages").select("variant_idx", "n_called", *[F.round(c, 6).alias(c) for c in ("allele_count", "af", "mac")])


@query("stats_on_sample_subset", E_SQL + f"SELECT variant_idx, count(value)::BIGINT AS n_called, coalesce(sum(value::DOUBLE), 0.0) AS allele_count, (count(*) - count(value))::DOUBLE / count(*) AS missing_rate FROM g WHERE sample_idx IN {_KEPT} GROUP BY 1")
def stats_on_sample_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stats(_subset(spark, sf_dir)).select("variant_idx", "n_called", "allele_count", "missing_rate")


@query("filter_stats_wide", E_SQL + f"SELECT e.* FROM e JOIN st USING (variant_idx) WHERE maf >= {_f32(0.1)} AND missing_rate <= {_f32(0.06)} AND chrom IN ('1', '2', '3', '4', '5')")
def filter_stats_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = f.chrom("1") | f.chrom("2") | f.chrom("3") | f.chrom("4") | f.chrom("5")
    return ops.keep_variants(wide(spark, sf_dir), arms & f.maf(min=0.1) & f.missing_rate(0.06)).select(*FRAME)


@query("read_dense_long", E_SQL + "SELECT variant_idx, sample_idx, value FROM g")
def read_dense_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.long_cells(ops.apply_missing(wide(spark, sf_dir)))


@query("read_sample_keep", E_SQL + f"SELECT variant_idx, row_number() OVER (PARTITION BY variant_idx ORDER BY sample_idx) - 1 AS sample_idx, value FROM g WHERE sample_idx IN {_KEPT}")
def read_sample_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.long_cells(_subset(spark, sf_dir))


@query("read_nan_long", E_SQL + "SELECT variant_idx, sample_idx, coalesce(value::DOUBLE, 'NaN'::DOUBLE) AS value FROM g")
def read_nan_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.long_cells(wide(spark, sf_dir)).withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))))


@query("read_impute_mean", E_SQL + "SELECT variant_idx, sample_idx, round(coalesce(value, (ac::FLOAT / nc::FLOAT)::FLOAT)::DOUBLE, 6) AS value FROM g JOIN s USING (variant_idx)")
def read_impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.long_cells(ops.apply_missing(wide(spark, sf_dir), "impute")).withColumn("value", F.round(F.col("value").cast("double"), 6))


_WHOLE = """, whole AS (SELECT variant_idx, sum(value) > count(*) AS flip FROM g GROUP BY 1 HAVING count(*) = count(value)),
coo AS (SELECT variant_idx, sample_idx, CASE WHEN flip THEN 2 - value ELSE value END::FLOAT AS value FROM g JOIN whole USING (variant_idx)) """


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants without missing calls, of all samples, as sparse forms need them."""
    return ops.orient_minor(ops.read_variants(wide(spark, sf_dir), f.missing_rate(0.0), "raise"))


@query("sparse_coo_flipped", E_SQL + _WHOLE + "SELECT variant_idx, sample_idx, value FROM coo WHERE value <> 0")
def sparse_coo_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nonzero_cells(_sparse(spark, sf_dir))


@query("sparse_variants_flipped", E_SQL + _WHOLE + "SELECT e.variant_idx, chrom, pos, id, CASE WHEN flip THEN a1 ELSE a0 END AS a0, CASE WHEN flip THEN a0 ELSE a1 END AS a1, flip AS flipped FROM e JOIN whole USING (variant_idx)")
def sparse_variants_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select(*FRAME, "flipped")


@query("csc_indptr", E_SQL + _WHOLE + ", c AS (SELECT variant_idx, count(*) FILTER (value <> 0) AS nnz FROM coo GROUP BY 1) SELECT variant_idx, row_number() OVER o - 1 AS column, nnz, sum(nnz) OVER o::BIGINT AS indptr_end FROM c WINDOW o AS (ORDER BY variant_idx)")
def csc_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.csc_columns(_sparse(spark, sf_dir)).select("variant_idx", "column", "nnz", "indptr_end")


@query("csr_row_nnz", E_SQL + _WHOLE + "SELECT sample_idx, count(*) FILTER (value <> 0) AS nnz FROM coo GROUP BY 1")
def csr_row_nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.csr_rows(_sparse(spark, sf_dir), wide_samples(spark).count())


_COLUMNS = ", c AS (SELECT variant_idx, row_number() OVER (ORDER BY variant_idx) - 1 AS i FROM whole)"


@query("csr_entries", E_SQL + _WHOLE + _COLUMNS + ", n AS (SELECT *, row_number() OVER (ORDER BY sample_idx, i) - 1 AS place FROM coo JOIN c USING (variant_idx) WHERE value <> 0) SELECT sample_idx, i::INTEGER AS column, place, value FROM n")
def csr_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined entries of sparse rows, each with its place among all."""
    parts = ops.csr_parts(_sparse(spark, sf_dir), part_variants=50)
    entries = parts.select("sample_idx", (F.col("indptr_end") - F.col("nnz")).alias("start"), F.posexplode(F.arrays_zip("indices", "data")).alias("at", "e"))
    return entries.select("sample_idx", F.col("e.indices").alias("column"), (F.col("start") + F.col("at")).alias("place"), F.col("e.data").alias("value"))


@query("sample_major_sums", E_SQL + "SELECT sample_idx, count(*) AS n_variants, sum(value)::DOUBLE AS total FROM g GROUP BY 1")
def sample_major_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.sample_major(wide(spark, sf_dir), part_variants=300)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return rows.groupBy("sample_idx").agg(F.sum(F.size("values")).cast("long").alias("n_variants"), F.sum(total).alias("total"))


@query("haplotype_long", _HAPLO_SQL + "SELECT variant_idx, row_idx AS sample_idx, value FROM h")
def haplotype_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.long_cells(haplotypes(wide(spark, sf_dir)), "haplotypes")


@query("haplotype_minor_flip", _HAPLO_SQL + ", t AS (SELECT variant_idx, sum(value) * 2 > count(value) AS flip FROM h GROUP BY 1) SELECT variant_idx, row_idx AS sample_idx, CASE WHEN flip THEN 1 - value ELSE value END AS value FROM h JOIN t USING (variant_idx) WHERE CASE WHEN flip THEN 1 - value ELSE value END <> 0")
def haplotype_minor_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nonzero_cells(ops.orient_minor(haplotypes(wide(spark, sf_dir)), "haplotypes", most=1), "haplotypes")


@query("haplotype_samples", "SELECT i AS source_sample_index, k AS haplotype_index, 'S' || i AS iid FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(2)) AS k)")
def haplotype_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.haplotype_samples(wide_samples(spark)).select("source_sample_index", "haplotype_index", "iid")


_MAF_SQL = E_SQL + f", kept AS (SELECT variant_idx, row_number() OVER (ORDER BY variant_idx) - 1 AS retained_idx, nc FROM st WHERE maf >= {_f32(0.2)}) "


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keep_variants(wide(spark, sf_dir), f.maf(min=0.2))


@query("block_assignment", _MAF_SQL + "SELECT variant_idx, retained_idx, (retained_idx // 64)::BIGINT AS block_idx FROM kept")
def block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.variant_blocks(_common(spark, sf_dir), 64).select("variant_idx", "retained_idx", "block_idx")


@query("block_summary", _MAF_SQL + "SELECT (retained_idx // 64)::BIGINT AS block_idx, count(*) AS n_variants, min(variant_idx) AS first_variant, max(variant_idx) AS last_variant, sum(nc)::BIGINT AS n_called FROM kept GROUP BY 1")
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = ops.variant_blocks(_common(spark, sf_dir), 64)
    return blocks.groupBy("block_idx").agg(F.count("*").alias("n_variants"), F.min("variant_idx").alias("first_variant"), F.max("variant_idx").alias("last_variant"), F.sum("n_called").alias("n_called"))


@query("window_offset_limit", _MAF_SQL + "SELECT variant_idx FROM kept WHERE retained_idx >= 20 AND retained_idx < 50")
def window_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retained window is a feature of its own: so many variants from a place on."""
    return ops.variant_window(_common(spark, sf_dir).select("variant_idx"), 20, 30)


_REGIONS = ", r AS (SELECT n_nationkey::BIGINT AS region_idx, (1 + n_nationkey % 12)::VARCHAR AS rc, 1000 + 200 * n_nationkey AS rs, 2500 + 200 * n_nationkey AS re FROM nation) "


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(n.alias("region_idx"), (1 + n % 12).cast("string").alias("chrom"), (1000 + 200 * n).alias("start"), (2500 + 200 * n).alias("end"))


@query("region_join", E_SQL + _REGIONS + "SELECT region_idx, variant_idx, pos FROM r JOIN e ON chrom = rc AND pos BETWEEN rs AND re")
def region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.region_join(wide(spark, sf_dir).select("variant_idx", "chrom", "pos"), regions(spark, sf_dir)).where(F.col("variant_idx").isNotNull()).select("region_idx", "variant_idx", "pos")


@query("region_counts_with_empty", E_SQL + _REGIONS + "SELECT region_idx, count(variant_idx) AS n_variants FROM r LEFT JOIN e ON chrom = rc AND pos BETWEEN rs AND re GROUP BY 1")
def region_counts_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.region_join(wide(spark, sf_dir).select("variant_idx", "chrom", "pos"), regions(spark, sf_dir)).groupBy("region_idx").agg(F.count("variant_idx").alias("n_variants"))


@query("design_align_left_join", "SELECT i AS sample_idx, 'S' || i AS iid, c_acctbal AS trait, c_nationkey::BIGINT AS covariate FROM (SELECT unnest(range(64)) AS i) LEFT JOIN customer ON c_custkey = i")
def design_align_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    traits = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey")).alias("iid"), F.col("c_acctbal").alias("trait"), F.col("c_nationkey").cast("long").alias("covariate"))
    return ops.align_design(wide_samples(spark).select("sample_idx", "iid"), traits).select("sample_idx", "iid", "trait", "covariate")


@query("diagnostics", E_SQL + f", kept AS (SELECT variant_idx FROM g WHERE sample_idx IN {_KEPT} GROUP BY 1 HAVING count(value) > 0 AND least(sum(value::DOUBLE) / (2 * count(value)), 1 - sum(value::DOUBLE) / (2 * count(value))) >= {_f32(0.2)}) SELECT (SELECT count(DISTINCT sample_idx) FROM g) AS source_samples, (SELECT count(DISTINCT sample_idx) FROM g WHERE sample_idx IN {_KEPT}) AS retained_samples, (SELECT count(*) FROM e) AS candidate_variants, (SELECT count(*) FROM kept) AS retained_variants, (SELECT count(*) FROM e) - (SELECT count(*) FROM kept) AS dropped_variants")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a read of some samples: how many there are, and which variants pass among those kept."""
    places = ops.sample_places(wide_samples(spark), SUBSET)
    kept = ops.keep_variants(ops.keep_samples(wide(spark, sf_dir), places), f.maf(min=0.2))
    return ops.diagnostics(wide(spark, sf_dir), kept, wide_samples(spark).count(), len(places))


@query("design_complete", "SELECT i AS sample_idx, 'S' || i AS iid, c_acctbal AS trait FROM (SELECT unnest(range(64)) AS i) JOIN customer ON c_custkey = i")
def design_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design of the samples that have a trait; with one lacking it this would fail."""
    traits = table(spark, sf_dir, "customer").where(F.col("c_acctbal").isNotNull()).select(F.concat(F.lit("S"), F.col("c_custkey")).alias("iid"), F.col("c_acctbal").alias("trait"))
    known = wide_samples(spark).select("sample_idx", "iid").join(traits.select("iid"), "iid", "left_semi")
    return ops.align_design(known, traits, complete=True).select("sample_idx", "iid", "trait")


_P = "abs(x) / (abs(x) + 1)"


@query("bgen_expected_dosage", E_SQL + "SELECT variant_idx, sample_idx, round(least(greatest(ab + (1 - aa - ab) * 2, 0), 2)::DOUBLE, 5) AS dosage FROM (SELECT *, (abs(x) / (abs(x) + 1))::FLOAT AS aa, ((1 - (abs(x) / (abs(x) + 1))) / 2)::FLOAT AS ab FROM x)")
def bgen_expected_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("variant_idx"), F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    aa = F.expr(_P)
    return x.select("variant_idx", F.col("at").cast("long").alias("sample_idx"), F.round(expected_dosage(aa, (1 - aa) / 2).cast("double"), 5).alias("dosage"))


@query("bgen_phased_dosage", E_SQL + "SELECT variant_idx, sample_idx, round(least(greatest(2 - p - q, 0), 2)::FLOAT::DOUBLE, 5) AS dosage FROM (SELECT *, abs(x) / (abs(x) + 1) AS p, 1 / (abs(x) + 2) AS q FROM x)")
def bgen_phased_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("variant_idx"), F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    return x.select("variant_idx", F.col("at").cast("long").alias("sample_idx"), F.round(phased_dosage(F.expr(_P), F.expr("1 / (abs(x) + 2)")).cast("double"), 5).alias("dosage"))


@query("phased_dosage_split", E_SQL + """SELECT variant_idx, sample_idx, round((dosage + d) / 2, 9) AS left_dosage, round((dosage - d) / 2, 9) AS right_dosage,
  round(CASE WHEN x > 0 THEN least(dosage, 1) ELSE greatest(dosage - 1, 0) END, 9) AS implied_left, round(CASE WHEN x > 0 THEN greatest(dosage - 1, 0) ELSE least(dosage, 1) END, 9) AS implied_right
  FROM (SELECT *, least(dosage, 2 - dosage) * (CASE WHEN x > 0 THEN 1 ELSE -1 END) AS d FROM g) WHERE dosage IS NOT NULL""")
def phased_dosage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = wide(spark, sf_dir).select("variant_idx", F.posexplode(F.arrays_zip("dosages", "first")).alias("at", "z")).select("variant_idx", F.col("at").cast("long").alias("sample_idx"), F.col("z.dosages").alias("t"), F.col("z.first").alias("first")).where(F.col("t").isNotNull())
    d = F.least(F.col("t"), 2 - F.col("t")) * F.when(F.col("first"), 1).otherwise(-1)
    both, implied = split_dosage(F.col("t"), d), implied_split(F.col("t"), F.col("first"))
    return z.select("variant_idx", "sample_idx", F.round(both[0], 9).alias("left_dosage"), F.round(both[1], 9).alias("right_dosage"), F.round(implied[0], 9).alias("implied_left"), F.round(implied[1], 9).alias("implied_right"))


# ---- text of sample fields ----------------------------------------------------------------------

_TOKENS = {"gt": "concat(if(calls is null, './.', if(calls = 0, '0/0', if(calls = 2, '1/1', if(first, '0/1', '1/0')))), ':9')", "phased": "concat('7:', if(calls is null, '.|.', if(calls = 0, '0|0', if(calls = 2, '1|1', if(first, '0|1', '1|0')))))", "ds": "concat('x:', coalesce(cast(cast(round(dosages, 3) as float) as string), '.'))"}


def tokens(spark: SparkSession, sf_dir: str, form: str, format_text: str, key: str) -> DataFrame:
    """The wide cohort as it stands in the sample fields of text files: one row a cell, with the token of ``key``."""
    z = wide(spark, sf_dir).select("variant_idx", F.posexplode(F.arrays_zip("calls", "dosages", "first")).alias("at", "z")).select("variant_idx", F.col("at").cast("long").alias("sample_idx"), "z.*")
    field = z.select("variant_idx", "sample_idx", F.expr(_TOKENS[form]).alias("field"))
    return field.withColumn("token", sample_value(F.col("field"), key_place(F.lit(format_text), key)))


@query("gt_tokens_decoded", E_SQL + "SELECT variant_idx, sample_idx, value FROM g")
def gt_tokens_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir, "gt", "GT:GQ", "GT").select("variant_idx", "sample_idx", decoded_gt(F.col("token"))["value"].alias("value"))


@query("phased_tokens_decoded", E_SQL + "SELECT variant_idx, sample_idx, CASE WHEN value = 1 THEN (CASE WHEN x > 0 THEN 0 ELSE 1 END) ELSE value / 2 END::FLOAT AS first_allele, CASE WHEN value = 1 THEN (CASE WHEN x > 0 THEN 1 ELSE 0 END) ELSE value / 2 END::FLOAT AS second_allele FROM g")
def phased_tokens_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decoded_phased(F.col("token"))
    return tokens(spark, sf_dir, "phased", "DP:GT", "GT").select("variant_idx", "sample_idx", read["first"].alias("first_allele"), read["second"].alias("second_allele"))


@query("ds_tokens_decoded", E_SQL + "SELECT variant_idx, sample_idx, round(dosage, 3)::FLOAT AS dosage FROM g")
def ds_tokens_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir, "ds", "GT:DS", "DS").select("variant_idx", "sample_idx", decoded_ds(F.col("token"))["value"].alias("dosage"))


@query("first_of_lists", "SELECT variant_idx, CASE WHEN split_part(id, ';', 1) = '' THEN '.' ELSE split_part(id, ';', 1) END AS first_id, split_part(alt_allele, ',', 1) AS first_alt, strlen(a0) AS a0_bytes FROM variants")
def first_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split_part("id", F.lit(";"), F.lit(1))
    return typed_variants(spark, sf_dir).select("variant_idx", F.when(name == "", ".").otherwise(name).alias("first_id"), F.split_part("alt_allele", F.lit(","), F.lit(1)).alias("first_alt"), F.octet_length("a0").cast("long").alias("a0_bytes"))


# ---- the long cohort ----------------------------------------------------------------------------


@query("long_cohort_stats", "WITH c AS (SELECT l_partkey AS variant_idx, l_suppkey AS sample_idx, max((l_linenumber - 1) % 3)::DOUBLE AS value FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) SELECT variant_idx, count(*)::BIGINT AS n_called, sum(value) AS allele_count, round((n - count(*))::DOUBLE / n, 9) AS missing_rate, round(least(sum(value) / (2 * count(*)), 1 - sum(value) / (2 * count(*))), 9) AS maf FROM c, n GROUP BY variant_idx, n")
def long_cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a long cohort at the size of the largest driver table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("variant_idx"), F.col("l_suppkey").alias("sample_idx"), ((F.col("l_linenumber") - 1) % 3).cast("double").alias("value"))
    one = rows.groupBy("variant_idx", "sample_idx").agg(F.max("value").alias("value"))
    n = rows.select("sample_idx").distinct().count()
    return long_stats(one, n).select("variant_idx", "n_called", "allele_count", F.round("missing_rate", 9).alias("missing_rate"), F.round("maf", 9).alias("maf"))
