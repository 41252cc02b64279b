"""Declarative variant filters: leaves, and their combination by ``&``, ``|`` and ``~``."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from lociframe.errors import InvalidOptionError


@dataclass(frozen=True)
class FilterExpr:
    """A filter: a leaf with parameters (``op`` is ``predicate``) or a combination of filters."""

    op: str
    name: str = ""
    params: tuple[tuple[str, Any], ...] = ()
    parts: tuple[FilterExpr, ...] = ()

    def __and__(self, other: FilterExpr) -> FilterExpr:
        return _combined("and", self, other)

    def __or__(self, other: FilterExpr) -> FilterExpr:
        return _combined("or", self, other)

    def __invert__(self) -> FilterExpr:
        return FilterExpr("not", parts=(self,))

    def to_ir(self) -> dict[str, Any]:
        """The filter as plain JSON values."""
        if self.op == "predicate":
            return {"op": self.op, "name": self.name, "params": {k: list(v) if isinstance(v, tuple) else v for k, v in self.params}}
        keys = ("expr",) if self.op == "not" else ("left", "right")
        return {"op": self.op} | {k: p.to_ir() for k, p in zip(keys, self.parts)}


def from_ir(ir: dict[str, Any]) -> FilterExpr:
    """The filter that :meth:`FilterExpr.to_ir` wrote."""
    if ir["op"] == "predicate":
        return FilterExpr("predicate", ir["name"], tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in ir["params"].items()))
    return FilterExpr(ir["op"], parts=tuple(from_ir(ir[k]) for k in ("left", "right", "expr") if k in ir))


def _combined(op: str, left: FilterExpr, right: FilterExpr) -> FilterExpr:
    if not isinstance(right, FilterExpr):
        raise TypeError(f"a filter can't be combined with {type(right).__name__}")
    return FilterExpr(op, parts=(left, right))


def _leaf(name: str, **params: Any) -> FilterExpr:
    return FilterExpr("predicate", name, tuple(params.items()))


def chrom(value: str) -> FilterExpr:
    """Variants of one chromosome."""
    if not isinstance(value, str) or not value:
        raise InvalidOptionError("chrom takes a chromosome name")
    return _leaf("chrom", value=value)


def parse_region(value: str) -> tuple[str, int, int]:
    """Chromosome, first and last position of ``chrom:start-end``."""
    m = re.fullmatch(r"([^:\s]+):([0-9]+)-([0-9]+)", value) if isinstance(value, str) else None
    if not m:
        raise InvalidOptionError(f"{value!r} isn't a region; write chrom:start-end")
    start, end = int(m[2]), int(m[3])
    if not 1 <= start <= end:
        raise InvalidOptionError(f"the region {value!r} has no positions; they count from 1")
    return m[1], start, end


def region(value: str) -> FilterExpr:
    """Variants whose position lies in ``chrom:start-end``, both ends included."""
    parse_region(value)
    return _leaf("region", value=value)


def snp() -> FilterExpr:
    """Variants with one alternate allele and alleles of one byte."""
    return _leaf("snp")


def biallelic() -> FilterExpr:
    """Variants with one alternate allele."""
    return _leaf("biallelic")


def polymorphic() -> FilterExpr:
    """Variants with more than one allele among the selected samples."""
    return _leaf("polymorphic")


def _number(what: str, value: Any, whole: bool = False, most: float = math.inf) -> float | int:
    kinds = int if whole else (int, float)
    if isinstance(value, bool) or not isinstance(value, kinds) or not math.isfinite(value) or not 0 <= value <= most:
        raise InvalidOptionError(f"{what} can't be {value!r}: it takes {'whole ' if whole else ''}numbers from 0" + (f" to {most:g}" if most < math.inf else ""))
    return value if whole else float(value)


def _bounded(name: str, low: Any, high: Any, **limits: Any) -> FilterExpr:
    given = {k: _number(f"{name} {k}", v, **limits) for k, v in (("min", low), ("max", high)) if v is not None}
    if not given:
        raise InvalidOptionError(f"{name} needs min, max or both")
    if len(given) == 2 and given["min"] > given["max"]:
        raise InvalidOptionError(f"{name}: min is above max")
    return _leaf(name, **given)


def maf(min: float | None = None, max: float | None = None) -> FilterExpr:  # noqa: A002
    """Variants by minor allele frequency among the selected samples."""
    return _bounded("maf", min, max, most=1)


def mac(min: int | None = None, max: int | None = None) -> FilterExpr:  # noqa: A002
    """Variants by minor allele count among the selected samples."""
    return _bounded("mac", min, max, whole=True)


def qual(min: float | None = None, max: float | None = None) -> FilterExpr:  # noqa: A002
    """Variants by quality; those without one don't pass."""
    return _bounded("qual", min, max)


def missing_rate(max: float) -> FilterExpr:  # noqa: A002
    """Variants with at most this share of missing calls among the selected samples."""
    return _bounded("missing_rate", None, max, most=1)


def id_in(values: Iterable[str]) -> FilterExpr:
    """Variants with one of these IDs."""
    if isinstance(values, str) or not isinstance(values, Iterable):
        raise InvalidOptionError("id_in takes several variant IDs")
    ids = tuple(sorted(values)) if isinstance(values, (set, frozenset)) else tuple(values)
    if not all(isinstance(v, str) for v in ids):
        raise InvalidOptionError("variant IDs are strings")
    if len(set(ids)) < len(ids):
        raise InvalidOptionError("a variant ID is named twice")
    return _leaf("id_in", values=ids)


def as_filter(variants: Any) -> FilterExpr | None:
    """The filter that a ``variants`` option means: a filter, an iterable of IDs, or none."""
    if variants is None or isinstance(variants, FilterExpr):
        return variants
    if callable(variants) or isinstance(variants, str) or not isinstance(variants, Iterable):
        raise InvalidOptionError("variants takes a filter or variant IDs; functions can't be planned")
    return id_in(variants)
