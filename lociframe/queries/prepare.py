"""Queries of the general data-preparation problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import hierarchy, multivalue, orphans, parse_lines
from lociframe.session import reach_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.parent_links(table(spark, sf_dir, "samples").select("iid", "father", "mother"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor and descendant, with the smallest number of links."""
    pairs = hierarchy.ancestor_pairs(_links(spark, sf_dir))
    return pairs.select(F.col("ancestor").alias("ancestor_iid"), F.col("node").alias("descendant_iid"), F.col("links").cast("int").alias("n_links"))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, roots, numbers of ancestors and descendants, and cycles, for every sample."""
    links = _links(spark, sf_dir)
    people = table(spark, sf_dir, "samples").select(F.col("iid").alias("node"))
    return hierarchy.hierarchy_nodes(people, hierarchy.ancestor_pairs(links), links)


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path from each root down to each sample; samples without parents are their own roots."""
    links = _links(spark, sf_dir)
    people = table(spark, sf_dir, "samples").select(F.col("iid").alias("node"))
    return hierarchy.root_paths(hierarchy.ancestor_pairs(links, paths=True), links, people)


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that are their own ancestors, with the length of the shortest cycle."""
    cycles = hierarchy.cycle_nodes(_links(spark, sf_dir))
    return cycles.select(F.col("node").alias("iid"), F.col("cycle_links").cast("int").alias("cycle_links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that don't parse, with the reason."""
    return parse_lines.failed_lines(table(spark, sf_dir, "pvar_lines"), table(spark, sf_dir, "pvar_files"))


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that don't parse, with the reason, the failing field and the byte."""
    return parse_lines.line_errors(table(spark, sf_dir, "pvar_lines"), table(spark, sf_dir, "pvar_files"))


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other lines as typed variants."""
    return parse_lines.valid_lines(table(spark, sf_dir, "pvar_lines"), table(spark, sf_dir, "pvar_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of samples and phenotypes."""
    samples, removals, phenotypes = (table(spark, sf_dir, n) for n in ("samples", "sample_removals", "phenotypes"))
    found = orphans.orphan_references(orphans.sample_references(samples, phenotypes), orphans.key_table(samples, removals))
    return found.select("table_name", "row_id", "ref_field", "orphan_kind", "load_month")


def p4_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted a table and month."""
    return orphans.orphans_by_period(p4_found(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of fields that hold two or more, with its place."""
    return multivalue.packed_values(table(spark, sf_dir, "variants"))


def p5_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delimiters inferred for each source and field, best first, with their scores."""
    fields = ("id", "alt_allele")
    scores = multivalue.delimiter_scores(multivalue._long(table(spark, sf_dir, "variants"), fields), fields)
    places = multivalue.delimiter_ranks(scores).select("source", "field_name", F.posexplode("delimiters").alias("place", "delimiter"))
    return places.join(scores.withColumnRenamed("source", "s"), (F.col("s").eqNullSafe(F.col("source"))) & (places.field_name == scores.field_name) & (places.delimiter == scores.delimiter)).select(
        "source", places.field_name, places.delimiter, (F.col("place") + 1).alias("place"), "n_fields", F.round("score", 9).alias("score")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_nodes, p1_paths, p1_cycles, p3_found, p3_errors, p3_valid, p4_found, p4_by_period, p5_found, p5_delimiters)
}

_CLOSURE = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT iid AS c, p FROM (
    SELECT iid, father AS p FROM samples UNION ALL SELECT iid, mother FROM samples)
  WHERE p NOT IN ('0', '.', 'NA') AND p IN (SELECT iid FROM samples)),
walk(c, p, n) USING KEY (c, p) AS (
  SELECT c, p, 1 FROM edges
  UNION
  SELECT w.c, e.p, w.n + 1 FROM walk w JOIN edges e ON e.c = w.p
  LEFT JOIN recurring.walk r ON r.c = w.c AND r.p = e.p WHERE r.c IS NULL)
"""

_PARSED = r"""
WITH files AS (
  SELECT file_id, n_fields, coalesce(string_split(upper(ltrim(header_line, '#')), chr(9)),
    CASE WHEN n_fields <= 5 THEN ['CHROM','ID','POS','ALT','REF'] ELSE ['CHROM','ID','CM','POS','ALT','REF'] END) AS names
  FROM pvar_files),
cut AS (
  SELECT l.file_id, l.line_number, n_fields, names,
    regexp_full_match(text, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS quoted,
    list_transform(regexp_extract_all(chr(9) || text, '\t("(?:[^"]|"")*"|[^"\t]*)', 1),
      lambda v: CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"') ELSE v END) AS f
  FROM pvar_lines l LEFT JOIN files USING (file_id)
  WHERE trim(text) <> '' AND text NOT LIKE '##%'),
named AS (
  SELECT *, f[list_position(names, 'CHROM')] AS chrom, f[list_position(names, 'POS')] AS pos_text,
    f[list_position(names, 'ID')] AS id, f[list_position(names, 'REF')] AS ref,
    f[list_position(names, 'ALT')] AS alt, f[list_position(names, 'QUAL')] AS qual_text
  FROM cut),
judged AS (
  SELECT *, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN len(f) IS DISTINCT FROM n_fields THEN 'columns'
    WHEN NOT regexp_full_match(chrom, '[A-Za-z0-9]+') THEN 'chrom'
    WHEN NOT (regexp_full_match(pos_text, '[0-9]+') AND try_cast(pos_text AS HUGEINT) <= 4294967295) THEN 'pos'
    WHEN NOT regexp_full_match(ref, '[ACGTNacgtn]+') THEN 'ref'
    WHEN NOT regexp_full_match(alt, '([ACGTNacgtn]+|\*|\.|<[A-Za-z0-9:_]+>)(,([ACGTNacgtn]+|\*|\.|<[A-Za-z0-9:_]+>))*') THEN 'alt'
    WHEN list_contains(names, 'QUAL') AND NOT regexp_full_match(qual_text, '\.|[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'qual'
    END AS fail_reason
  FROM named)
"""

_ORPHANS = """
WITH keys AS (SELECT iid, min(loaded_at) AS first, max(loaded_at) AS last FROM samples GROUP BY iid),
gone AS (SELECT iid, max(removed_at) AS removed FROM sample_removals GROUP BY iid),
refs AS (
  SELECT 'samples' AS table_name, sample_idx AS row_id, 'father' AS ref_field, father AS ref, loaded_at FROM samples
  UNION ALL SELECT 'samples', sample_idx, 'mother', mother, loaded_at FROM samples
  UNION ALL SELECT 'phenotypes', pheno_id, 'iid', iid, loaded_at FROM phenotypes),
judged AS (
  SELECT table_name, row_id, ref_field, CASE WHEN k.iid IS NULL THEN 'missing' WHEN removed > last THEN 'deleted'
    WHEN first > loaded_at THEN 'late' END AS orphan_kind, strftime(loaded_at, '%Y-%m') AS load_month
  FROM refs LEFT JOIN keys k ON k.iid = ref LEFT JOIN gone g ON g.iid = ref
  WHERE ref IS NOT NULL AND ref NOT IN ('0', '.', 'NA'))
"""

SQL: dict[str, str] = {
    "p1_found": _CLOSURE + "SELECT p AS ancestor_iid, c AS descendant_iid, n::INTEGER AS n_links FROM walk",
    "p1_paths": _CLOSURE.split("walk(c")[0]
    + """walk(c, p, n, path) USING KEY (c, p) AS (
           SELECT c, p, 1, [p] FROM edges
           UNION
           SELECT w.c, e.p, w.n + 1, min(list_append(w.path, e.p)) FROM walk w JOIN edges e ON e.c = w.p
           LEFT JOIN recurring.walk r ON r.c = w.c AND r.p = e.p WHERE r.c IS NULL GROUP BY w.c, e.p, w.n),
         below AS (SELECT c AS node, p AS root, n::BIGINT AS links, array_to_string(list_reverse(list_prepend(c, path)), '/') AS path
           FROM walk WHERE p NOT IN (SELECT c FROM edges))
       SELECT * FROM below
       UNION ALL
       SELECT iid, CASE WHEN alone THEN iid END, CASE WHEN alone THEN 0 END, CASE WHEN alone THEN iid END
       FROM (SELECT DISTINCT iid, iid NOT IN (SELECT c FROM edges) AS alone FROM samples WHERE iid NOT IN (SELECT node FROM below))""",
    "p1_cycles": _CLOSURE + "SELECT c AS iid, n::INTEGER AS cycle_links FROM walk WHERE c = p",
    "p1_nodes": _CLOSURE
    + """, up AS (SELECT c, count(*) AS na, count(*) FILTER (p NOT IN (SELECT c FROM edges)) AS nr,
           max(n) FILTER (p NOT IN (SELECT c FROM edges)) AS d, bool_or(c = p) AS cyc FROM walk GROUP BY c),
         down AS (SELECT p, count(*) AS nd FROM walk GROUP BY p)
       SELECT s.iid AS node, coalesce(na, 0)::BIGINT AS n_ancestors, coalesce(nd, 0)::BIGINT AS n_descendants,
         (CASE WHEN na IS NULL THEN 1 ELSE nr END)::BIGINT AS n_roots, (CASE WHEN na IS NULL THEN 0 ELSE d END)::BIGINT AS depth,
         coalesce(cyc, false) AS on_cycle
       FROM (SELECT DISTINCT iid FROM samples) s LEFT JOIN up ON up.c = s.iid LEFT JOIN down ON down.p = s.iid""",
    "p3_found": _PARSED + "SELECT file_id, line_number, fail_reason FROM judged WHERE fail_reason IS NOT NULL",
    "p3_valid": _PARSED
    + """SELECT file_id, line_number, chrom, pos_text::BIGINT AS pos, id, ref, alt, nullif(qual_text, '.')::DOUBLE AS qual
       FROM judged WHERE fail_reason IS NULL""",
    "p4_found": _ORPHANS + "SELECT * FROM judged WHERE orphan_kind IS NOT NULL",
    "p4_by_period": _ORPHANS + "SELECT table_name, load_month, ref_field, orphan_kind, count(*)::BIGINT AS n_orphans FROM judged WHERE orphan_kind IS NOT NULL GROUP BY ALL",
    "p5_found": r"""
WITH long AS (
  SELECT variant_idx, 'id' AS field_name, regexp_extract_all(id, '"[^"]*(?:""[^"]*)*"|''[^'']*(?:''''[^'']*)*''|[A-Za-z0-9_.:-]+') AS m FROM variants
  UNION ALL
  SELECT variant_idx, 'alt_allele', regexp_extract_all(alt_allele, '"[^"]*(?:""[^"]*)*"|''[^'']*(?:''''[^'']*)*''|[A-Za-z0-9<>*:_\[\]]+') FROM variants),
items AS (
  SELECT variant_idx, field_name, list_filter(list_transform(m, lambda v: CASE WHEN v LIKE '"%' THEN replace(v[2:-2], '""', '"')
    WHEN v LIKE '''%' THEN replace(v[2:-2], '''''', '''') ELSE v END), lambda v: v <> '') AS items FROM long)
SELECT variant_idx, field_name, unnest(range(1, len(items) + 1))::INTEGER AS ord, unnest(items) AS item FROM items WHERE len(items) >= 2""",
    "p5_delimiters": r"""
WITH long AS (
  SELECT source_format AS source, 'id' AS field_name, '[A-Za-z0-9_.:-]' AS c, '[^A-Za-z0-9_.:-]' AS other, id AS packed FROM variants
  UNION ALL SELECT source_format, 'alt_allele', '[A-Za-z0-9<>*:_\[\]]', '[^A-Za-z0-9<>*:_\[\]]', alt_allele FROM variants),
shown AS (
  SELECT source, field_name, c, other,
    regexp_replace(regexp_replace(packed, '"[^"]*(?:""[^"]*)*"|''[^'']*(?:''''[^'']*)*''', 'x', 'g'), '["'']', '', 'g') AS packed
  FROM long WHERE packed IS NOT NULL),
tried AS (SELECT source, field_name, c, packed, unnest(list_distinct(regexp_extract_all(packed, other))) AS delimiter FROM shown),
cut AS (
  SELECT source, field_name, delimiter, list_filter(list_transform(string_split(packed, delimiter), lambda p: trim(p, ' ')), lambda p: p <> '') AS pieces, c FROM tried),
numbered AS (
  SELECT source, field_name, delimiter, len(pieces) AS n, count(*) AS n_rows,
    sum(len(list_filter(pieces, lambda p: regexp_full_match(p, c || '+')))) AS n_regular
  FROM cut GROUP BY ALL),
scored AS (
  SELECT source, field_name, delimiter, sum(n_rows)::BIGINT AS n_fields,
    (sum(n_regular) + 1)::DOUBLE / (sum(n * n_rows) + 2)::DOUBLE * ((max(n_rows) + 1)::DOUBLE / (sum(n_rows) + 2)::DOUBLE) AS score
  FROM numbered GROUP BY ALL)
SELECT source, field_name, delimiter, (row_number() OVER (PARTITION BY source, field_name ORDER BY score DESC, delimiter))::INTEGER AS place,
  n_fields, round(score, 9) AS score
FROM scored""",
}
