"""Several values packed into one field: one row a value, in order.

Delimiters differ between and within sources.  The candidates of a source and
field are all signs found there that no value holds; they are scored on how alike
the numbers of pieces are that they cut fields into and how regular the pieces
look.  A field is then cut at the delimiters of its source, the best first, and
what lies between is a value.  Quotes are read before, as a delimiter within them
is part of the value.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.plans.joins import sized_join

#: Characters of values beside ASCII letters and digits (fixed values of the fields).
EXTRA = {"id": "_.:-", "alt_allele": "<>*:_[]"}
QUOTES = "[\"']"
_QUOTED = re.compile(r"\"([^\"]*+(?:\"\"[^\"]*+)*+)\"|'([^']*+(?:''[^']*+)*+)'|([^\"']++)")
#: Stands for a quoted value where delimiters are inferred.
STAND_IN = "x"


def value_class(field: str, but: bool = False) -> str:
    """The characters of a value of ``field`` as a class that Java and Python read alike; with ``but`` all others beside quotes."""
    return ("[^\"'" if but else "[") + "A-Za-z0-9" + "".join("\\" + c for c in EXTRA[field]) + "]"


def _long(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("packed")) for f in fields])
    return rows.select("variant_idx", F.col("source_format").alias("source"), F.explode(packed).alias("f")).select("variant_idx", "source", "f.*").where(F.col("packed").isNotNull())


def _per_field(fields: tuple[str, ...], of) -> Column:
    out = None
    for f in fields:
        out = F.when(F.col("field_name") == f, of(f)) if out is None else out.when(F.col("field_name") == f, of(f))
    return out


def read_quotes(text: str) -> list[tuple[bool, str]]:
    """The parts of a text: whether it was quoted, and the part without its quotes; an unclosed quote only parts."""
    found = _QUOTED.finditer(text)
    return [(False, m[3]) if m[3] is not None else (True, m[1].replace('""', '"') if m[1] is not None else m[2].replace("''", "'")) for m in found]


@F.pandas_udf(T.StringType())
def _outside(text: pd.Series) -> pd.Series:
    return pd.Series(["".join(STAND_IN if quoted else part for quoted, part in read_quotes(t)) for t in text], dtype=object)


def outside_quotes(long: DataFrame) -> DataFrame:
    """``long`` with STAND_IN for each quoted value of a field."""
    quoted = F.col("packed").rlike(QUOTES)
    return long.where(~quoted).unionByName(long.where(quoted).withColumn("packed", _outside("packed")))


def _cut(text: Column | str, delimiter: Column) -> Column:
    """The pieces of a text between occurrences of a delimiter, which is taken literally."""
    return F.split(text, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)


def delimiter_scores(long: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``source, field_name, delimiter, n_fields, score`` over all fields, without what is quoted.

    The score is the share of regular pieces, which are one value each, times the
    share of the commonest number of pieces among the fields with the delimiter;
    both are drawn towards a half where there are few pieces or fields.
    """
    others = _per_field(fields, lambda f: F.array_distinct(F.regexp_extract_all("packed", F.lit(f"({value_class(f, but=True)})"))))
    tried = outside_quotes(long).select("source", "field_name", "packed", F.explode(others).alias("delimiter"))
    pieces = F.filter(F.transform(_cut("packed", F.col("delimiter")), lambda p: F.trim(p)), lambda p: p != "")
    regular = _per_field(fields, lambda f: F.size(F.filter("pieces", lambda p: p.rlike(f"\\A{value_class(f)}+\\z"))))
    counted = tried.withColumn("pieces", pieces).select("source", "field_name", "delimiter", F.size("pieces").alias("n"), regular.alias("n_regular"))
    by_number = counted.groupBy("source", "field_name", "delimiter", "n").agg(F.count("*").alias("rows"), F.sum("n_regular").alias("n_regular"))
    by_delimiter = by_number.groupBy("source", "field_name", "delimiter").agg(F.sum("rows").alias("n_fields"), F.max("rows").alias("modal"), F.sum(F.col("n") * F.col("rows")).alias("n_pieces"), F.sum("n_regular").alias("n_regular"))
    score = (F.col("n_regular") + 1) / (F.col("n_pieces") + 2) * ((F.col("modal") + 1) / (F.col("n_fields") + 2))
    return by_delimiter.select("source", "field_name", "delimiter", "n_fields", score.alias("score"))


def delimiter_ranks(scores: DataFrame) -> DataFrame:
    """One row a source and field: ``delimiters``, all delimiters found there, best first."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "delimiter")))
    return scores.groupBy("source", "field_name").agg(F.transform(ordered, lambda x: x["delimiter"]).alias("delimiters"))


@F.pandas_udf(T.ArrayType(T.StructType().add("quoted", T.BooleanType()).add("part", T.StringType())))
def _parts(text: pd.Series) -> pd.Series:
    return pd.Series([[{"quoted": q, "part": p} for q, p in read_quotes(t)] for t in text], dtype=object)


def cut_at(text: Column, delimiters: Column) -> Column:
    """The values of a text: cut at those of ``delimiters`` it holds, one after another, without empty pieces."""
    held = F.filter(delimiters, lambda d: F.contains(text, d))
    pieces = F.aggregate(held, F.array(text), lambda pieces, d: F.flatten(F.transform(pieces, lambda p: _cut(p, d))))
    return F.filter(pieces, lambda p: p != "")


def split_values(long: DataFrame, ranks: DataFrame) -> DataFrame:
    """``long`` rows with the array ``items``: their fields cut at the delimiters that ``ranks`` has for their source.

    A sign that isn't among the delimiters stays in the value.
    """
    group = F.concat("field_name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    known = sized_join(long.withColumn("group", group), ranks.select(group.alias("group"), "delimiters"), "group", "left", spread_by="variant_idx")
    known = known.withColumn("delimiters", F.coalesce("delimiters", F.array().cast("array<string>")))
    quoted = F.col("packed").rlike(QUOTES)
    plain = known.where(~quoted).withColumn("items", cut_at(F.col("packed"), F.col("delimiters")))
    parts = known.where(quoted).withColumn("parts", _parts("packed"))
    read = F.flatten(F.transform("parts", lambda p: F.when(p["quoted"], F.filter(F.array(p["part"]), lambda v: v != "")).otherwise(cut_at(p["part"], F.col("delimiters")))))
    return plain.unionByName(parts.withColumn("items", read).drop("parts")).drop("group", "delimiters")


def packed_values(rows: DataFrame, fields: tuple[str, ...] = ("id", "alt_allele"), at_least: int = 2) -> DataFrame:
    """``(variant_idx, field_name, ord, item)`` of all fields that hold ``at_least`` values.

    ``rows`` has ``variant_idx``, ``source_format`` and the fields.  Null fields hold
    nothing; a null source is a source of its own; repeated rows come out each;
    texts of any length are read whole.  Within quotes a doubled quote always stands
    for one; an unclosed quote only parts values.
    """
    long = _long(rows, fields)
    ranks = delimiter_ranks(delimiter_scores(long, fields))
    several = long.where(_per_field(fields, lambda f: F.col("packed").rlike(f"{value_class(f, but=True)}|{QUOTES}"))) if at_least > 1 else long
    items = split_values(several, ranks).where(F.size("items") >= at_least)
    return items.select("variant_idx", "field_name", F.posexplode("items").alias("at", "item")).select("variant_idx", "field_name", (F.col("at") + 1).cast("int").alias("ord"), "item")
