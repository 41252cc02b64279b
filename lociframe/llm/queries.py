"""Queries of the problems of training data, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import copies, encoding, leakage, quality
from lociframe.session import reach_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with the earliest record of its group."""
    return copies.copies_in(table(spark, sf_dir, "variant_feed"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without nulls once, with the number of its copies."""
    feed = table(spark, sf_dir, "variant_feed")
    return copies.records_once(feed, copies.ledger_of_feed(feed))


def p2_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with the number of its copies; rows with a null are records of one copy."""
    feed = table(spark, sf_dir, "variant_feed")
    return copies.every_record(feed, copies.ledger_of_feed(feed))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encode_texts(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the held-out items they leak."""
    return p7_spans(spark, sf_dir).select("doc_id", "eval_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest shared span of every document and held-out item."""
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items that leak, with the number of documents."""
    return p7_found(spark, sf_dir).groupBy("eval_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are lists, tables or junk."""
    return quality.forms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and outlier scores of every text."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_records, p2_all_records, p6_ids, p7_found, p7_spans, p7_items, p8_found, p8_stats)}

_KEYS = r"""
WITH plain AS (
  SELECT rec_id, chrom, pos, a0, a1, lower(regexp_replace(chrom, '[^\p{L}\p{N}]+', '', 'g')) AS c, lower(regexp_replace(pos, '[^\p{L}\p{N}]+', '', 'g')) AS p,
    lower(regexp_replace(a0, '[^\p{L}\p{N}]+', '', 'g')) AS x, lower(regexp_replace(a1, '[^\p{L}\p{N}]+', '', 'g')) AS y
  FROM variant_feed WHERE chrom IS NOT NULL AND pos IS NOT NULL AND a0 IS NOT NULL AND a1 IS NOT NULL),
keyed AS (
  SELECT *, min(rec_id) OVER w AS keep_id, count(*) OVER w AS n_copies
  FROM plain WINDOW w AS (PARTITION BY c, p, least(x, y), greatest(x, y)))
"""

_SPANS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT eval_id, regexp_extract_all(strip_accents(lower(passage)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
doc_spans AS (SELECT doc_id, i, array_to_string(w[i:i+9], ' ') AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM docs)),
item_spans AS (SELECT eval_id, j, array_to_string(w[j:j+9], ' ') AS span FROM (SELECT eval_id, w, unnest(range(1, len(w) - 8)) AS j FROM items)),
hits AS (SELECT DISTINCT doc_id, eval_id, i, j FROM doc_spans JOIN item_spans USING (span)),
runs AS (
  SELECT doc_id, eval_id, min(i) - 1 AS first_word, count(*) + 9 AS n_words
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, eval_id, i - j ORDER BY i) AS island FROM hits)
  GROUP BY doc_id, eval_id, i - j, island),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, eval_id ORDER BY n_words DESC, first_word) AS place FROM runs)
"""

SQL: dict[str, str] = {
    "p2_found": _KEYS + "SELECT keep_id, rec_id AS copy_id FROM keyed WHERE rec_id <> keep_id",
    "p2_records": _KEYS + "SELECT rec_id, chrom, pos, a0, a1, n_copies FROM keyed WHERE rec_id = keep_id",
    "p2_all_records": _KEYS
    + """SELECT rec_id, chrom, pos, a0, a1, n_copies FROM keyed WHERE rec_id = keep_id
       UNION ALL SELECT rec_id, chrom, pos, a0, a1, 1 FROM variant_feed WHERE chrom IS NULL OR pos IS NULL OR a0 IS NULL OR a1 IS NULL""",
    "p7_found": _SPANS + "SELECT doc_id, eval_id FROM best WHERE place = 1",
    "p7_spans": _SPANS + "SELECT doc_id, eval_id, first_word::INTEGER AS first_word, n_words::INTEGER AS n_words FROM best WHERE place = 1",
    "p7_items": _SPANS + "SELECT eval_id, count(*)::BIGINT AS n_documents FROM best WHERE place = 1 GROUP BY eval_id",
}
