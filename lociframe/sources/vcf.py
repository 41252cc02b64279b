"""Text VCF as Column expressions over lines."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.errors import InvalidSourceError, UnsupportedRepresentation, tag
from lociframe.functions.calls import decoded_ds, decoded_gt, decoded_phased, key_place, optional_float, sample_value
from lociframe.sources import bgzf
from lociframe.sources.datasource import register


def read_samples(path: Path) -> list[str]:
    """The sample IDs of the ``#CHROM`` line; other header lines aren't parsed."""
    with (gzip.open(path, "rt", encoding="utf-8") if path.suffix in (".gz", ".bgz") else open(path, encoding="utf-8")) as f:
        for line in f:
            if line.startswith("#CHROM"):
                ids = line.rstrip("\r\n").split("\t")[9:]
                if len(set(ids)) < len(ids):
                    raise InvalidSourceError(f"{path} names a sample twice")
                return ids
            if not line.startswith("#"):
                break
    raise InvalidSourceError(f"{path} has no #CHROM line")


def lines(spark: SparkSession, path: Path, region: tuple[str, int, int] | None = None) -> DataFrame:
    """``variant_idx, line`` of the records, in an order that ``variant_idx`` keeps.

    A region is read through the index beside a blocked file; a compressed file
    without one can't be read by region.
    """
    packed = path.suffix in (".gz", ".bgz")
    if packed and region and bgzf.region_chunks(str(path), *region) is None:
        raise InvalidSourceError(f"{path} is compressed and has no index, so it can't be read by region")
    if packed and bgzf.is_blocked(str(path)):
        register(spark)
        source = json.dumps({"path": str(path.resolve()), "region": region})
        rows = spark.read.format("lociframe_lines").option("source", source).load()
    elif path.suffix == ".bgz":
        raise InvalidSourceError(f"{path} isn't blocked")
    else:
        rows = spark.read.text(str(path)).select(F.monotonically_increasing_id().alias("variant_idx"), F.col("value").alias("line"))
    return rows.where(is_record())


def is_record() -> Column:
    """Whether a line is neither blank nor part of the header."""
    return ~F.col("line").startswith("#") & (F.trim("line") != "")


def _at(k: int) -> Column:
    return F.get(F.col("f"), F.lit(k))


def variants(rows: DataFrame, path: str) -> DataFrame:
    """Typed variants of lines, with their split fields ``f`` and whether they are records, which only those may fail."""
    # filters may be planned in any order, so what raises looks itself at whether the line is a record
    cut = rows.select("variant_idx", F.split("line", "\t", -1).alias("f"), is_record().alias("is_record"))
    alt = _at(4)
    first = F.split_part(alt, F.lit(","), F.lit(1))
    position = _at(1).try_cast("bigint")
    broken = F.coalesce(~(_at(1).rlike(r"\A[0-9]+\z") & (position <= 4294967295)), F.lit(True))
    error = F.when(broken | (F.coalesce(_at(0), F.lit("")) == ""), tag(InvalidSourceError, f"{path}: a line has no chromosome and position")).when(
        F.coalesce(first, F.lit("")) == "", F.concat(F.lit(tag(InvalidSourceError, f"{path}: fewer than two alleles at ")), _at(0), F.lit(":"), _at(1))
    )
    good = F.when(F.col("is_record") & error.isNotNull(), F.raise_error(error).cast("string")).otherwise(_at(0))
    name = F.split_part(_at(2), F.lit(";"), F.lit(1))
    return cut.select(
        "variant_idx", good.alias("chrom"), position.alias("pos"), F.when(F.coalesce(name, F.lit("")) == "", ".").otherwise(name).alias("id"),
        _at(3).alias("a0"), first.alias("a1"), _at(3).alias("ref_allele"), alt.alias("alt_allele"), optional_float(_at(5)).alias("qual"), "f", "is_record",
    )


def with_calls(rows: DataFrame, places: list[int], kind: str, dosage: str, to_count: bool = False) -> DataFrame:
    """Add ``calls``, ``counted`` (the values per sample) and ``error`` for the samples at ``places``.

    A haplotype may be missing alone, but such a genotype can't be counted; with
    ``to_count`` it is an error.
    """
    key = "DS" if dosage == "dosage" else "GT"
    keyed = rows.withColumn("key_at", key_place(_at(8), key))
    fields = F.transform(F.array(*map(F.lit, places)), lambda i: sample_value(F.get(F.col("f"), i + 9), F.col("key_at"))) if places else F.array().cast("array<string>")
    decode = {("geno", "hardcall"): decoded_gt, ("geno", "dosage"): decoded_ds, ("haplo", "hardcall"): decoded_phased}[kind, dosage]
    read = keyed.withColumn("tokens", fields).withColumn("read", F.transform("tokens", decode))
    absent = tag(UnsupportedRepresentation, "dosages need FORMAT/DS values") if key == "DS" else tag(InvalidSourceError, "a VCF record has no FORMAT/GT")
    several = F.concat(F.lit(tag(InvalidSourceError, "several alternate alleles at ")), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))
    first = F.get(F.filter(F.transform("read", lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(0))
    error = F.when(F.contains("alt_allele", F.lit(",")), several).when(F.coalesce(F.col("key_at"), F.lit(0)) == 0, absent).otherwise(first)
    if kind == "haplo" and to_count:
        halves = F.exists("read", lambda r: r["first"].isNull() != r["second"].isNull())
        error = F.when(error.isNull() & halves, F.concat(F.lit(tag(InvalidSourceError, "a half-missing genotype can't be counted at ")), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).otherwise(error)
    if kind == "haplo":
        calls = F.flatten(F.transform("read", lambda r: F.array(r["first"], r["second"])))
        counted = F.transform("read", lambda r: r["first"] + r["second"])
    else:
        calls = counted = F.transform("read", lambda r: r["value"])
    return read.withColumns({"calls": calls.cast("array<float>"), "counted": counted.cast("array<float>"), "error": F.when(F.col("is_record"), error)}).drop("f", "is_record", "key_at", "tokens", "read")
