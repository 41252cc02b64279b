"""Reading calls from the text of sample fields, and arithmetic on dosages, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociframe.errors import InvalidSourceError, UnsupportedRepresentation, tag


def sample_value(field: Column, place: Column) -> Column:
    """The part of a sample field at ``place`` (from 1); null if it ends before."""
    return F.get(F.split(field, ":"), place - 1)


def key_place(format_text: Column, key: str) -> Column:
    """The place of a key in a FORMAT text, from 1; 0 if absent."""
    return F.array_position(F.split(format_text, ":"), key).cast("int")


#: Diploid genotype tokens and what they count (fixed values).
DIPLOID = {"0/0": 0, "0|0": 0, "0/1": 1, "1/0": 1, "0|1": 1, "1|0": 1, "1/1": 2, "1|1": 2}
NO_CALL = ("./.", ".|.")


def decoded_gt(token: Column) -> Column:
    """``(value, error)`` of a genotype token; all but whole diploid calls of two alleles are errors."""
    value = None
    for text, count in DIPLOID.items():
        one = F.lit(count).cast("float")
        value = F.when(token == text, one) if value is None else value.when(token == text, one)
    known = F.coalesce(token.isin(*DIPLOID, *NO_CALL), F.lit(False))
    error = F.when(~known, F.concat(F.lit(tag(InvalidSourceError, "unsupported genotype ")), F.coalesce(token, F.lit("(absent)"))))
    return F.struct(value.alias("value"), error.alias("error"))


def decoded_phased(token: Column) -> Column:
    """``(first, second, error)`` of a phased genotype token; each allele may be missing on its own."""
    a, b = F.substring(token, 1, 1), F.substring(token, 3, 1)
    good = (F.length(token) == 3) & (F.substring(token, 2, 1) == "|") & a.isin("0", "1", ".") & b.isin("0", "1", ".")
    unphased = F.length(token).eqNullSafe(3) & (F.substring(token, 2, 1) == "/")
    kind = F.when(unphased, tag(UnsupportedRepresentation, "no phased genotype: ")).otherwise(tag(InvalidSourceError, "unsupported phased genotype "))
    error = F.when(~F.coalesce(good, F.lit(False)), F.concat(kind, F.coalesce(token, F.lit("(absent)"))))
    one = lambda x: F.when(x.isin("0", "1"), x.try_cast("float"))
    return F.struct(one(a).alias("first"), one(b).alias("second"), error.alias("error"))


def decoded_ds(token: Column) -> Column:
    """``(value, error)`` of a dosage token: missing, or a finite number from 0 to 2."""
    number = F.when(token.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), token.try_cast("float"))
    good = F.coalesce(number.between(0.0, 2.0), F.lit(False))
    missing = F.coalesce(token == ".", F.lit(False))
    error = F.when(~missing & ~good, F.concat(F.lit(tag(InvalidSourceError, "invalid dosage ")), F.coalesce(token, F.lit("(absent)"))))
    return F.struct(F.when(good, number).alias("value"), error.alias("error"))


def expected_dosage(p_aa: Column, p_ab: Column) -> Column:
    """The expected count of the second allele from the probabilities of two genotypes."""
    aa, ab = p_aa.cast("float"), p_ab.cast("float")
    both = (ab + (F.lit(1.0).cast("float") - aa - ab) * F.lit(2.0).cast("float")).cast("float")
    return F.least(F.greatest(both, F.lit(0.0).cast("float")), F.lit(2.0).cast("float"))


def phased_dosage(p0: Column, p1: Column) -> Column:
    """The expected count from the probabilities of the first allele on two haplotypes."""
    return F.least(F.greatest(2.0 - p0.cast("double") - p1.cast("double"), F.lit(0.0)), F.lit(2.0)).cast("float")


def split_dosage(total: Column, delta: Column) -> Column:
    """Both haplotypes' dosages ``[(t + d) / 2, (t - d) / 2]``."""
    return F.array((total + delta) / 2, (total - delta) / 2)


def implied_split(total: Column, alternate_first: Column) -> Column:
    """Both haplotypes' dosages of a phased heterozygote without a stored difference."""
    high, low = F.least(total, F.lit(1.0)), F.greatest(total - 1.0, F.lit(0.0))
    return F.when(alternate_first, F.array(high, low)).otherwise(F.array(low, high))


def without_token(value: Column, *tokens: str) -> Column:
    """The value, or null if it is one of the tokens for none."""
    return F.when(~value.isin(*tokens), value)


def optional_float(value: Column) -> Column:
    """A finite number, null for ``.`` and everything else."""
    number = value.try_cast("float")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
