"""From filters to Columns: simplification, null-safe leaves, and predicates that hold before decoding.

A leaf is true or false, never null: a variant without quality or frequency fails
the leaf, and passes its negation.  Rates and qualities are compared as 32-bit
thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.filters import FilterExpr, parse_region

#: Leaves that need genotypes; the others need metadata alone.
STATS = frozenset({"maf", "mac", "missing_rate", "polymorphic"})
RANGES = frozenset({"maf", "mac", "missing_rate", "qual"})
#: Cost of leaves, the cheapest being tested first.
COST = {"chrom": 1, "region": 1, "id_in": 2, "snp": 3, "biallelic": 3, "qual": 3, "polymorphic": 10, "mac": 10, "maf": 10, "missing_rate": 10}


@dataclass(frozen=True)
class Node:
    """A simplified filter: ``all``, ``any``, ``not``, ``leaf`` or the constants ``yes`` and ``no``."""

    kind: str
    name: str = ""
    low: float | None = None
    high: float | None = None
    values: frozenset | None = None
    place: tuple[str, int, int] | None = None
    parts: tuple[Node, ...] = ()


YES, NO = Node("yes"), Node("no")


def _f32(x: float | None) -> float | None:
    return None if x is None else float(np.float32(x))


def _leaf(expr: FilterExpr) -> Node:
    p = dict(expr.params)
    if expr.name in RANGES:
        exact = expr.name == "mac"
        return Node("leaf", expr.name, *[p.get(k) if exact else _f32(p.get(k)) for k in ("min", "max")])
    if expr.name == "id_in":
        return Node("leaf", "id_in", values=frozenset(p["values"])) if p["values"] else NO
    if expr.name == "region":
        return Node("leaf", "region", place=parse_region(p["value"]))
    if expr.name == "chrom":
        return Node("leaf", "chrom", values=frozenset([p["value"]]))
    return Node("leaf", expr.name)


def _cost(node: Node) -> int:
    return COST[node.name] if node.kind == "leaf" else 10 if uses_stats(node) else 8


def _met(a: Node, b: Node) -> Node | None:
    """One leaf that holds where both do; None if they can't be merged."""
    names = {a.name, b.name}
    if a.name == b.name and a.name in RANGES:
        low = max((x for x in (a.low, b.low) if x is not None), default=None)
        high = min((x for x in (a.high, b.high) if x is not None), default=None)
        return NO if low is not None and high is not None and low > high else replace(a, low=low, high=high)
    if names == {"id_in"} or names == {"chrom"}:
        both = a.values & b.values
        return replace(a, values=both) if both else NO
    if names == {"region"}:
        (c, s, e), (d, t, f) = a.place, b.place
        return replace(a, place=(c, max(s, t), min(e, f))) if c == d and max(s, t) <= min(e, f) else NO
    if names == {"chrom", "region"}:
        area, whole = (a, b) if a.name == "region" else (b, a)
        return area if area.place[0] in whole.values else NO
    if names == {"snp", "biallelic"}:
        return a if a.name == "snp" else b
    return a if a == b else None


def _merge_all(parts: list[Node]) -> Node:
    flat: list[Node] = []
    todo = list(parts)
    while todo:
        p = todo.pop(0)
        if p.kind == "all":
            todo[:0] = p.parts
        elif p.kind == "no":
            return NO
        elif p.kind == "leaf":
            for i, q in enumerate(flat):
                if q.kind == "leaf" and (m := _met(q, p)) is not None:
                    if m is NO:
                        return NO
                    del flat[i]
                    todo.insert(0, m)
                    break
            else:
                flat.append(p)
        elif p.kind != "yes" and p not in flat:
            flat.append(p)
    flat.sort(key=_cost)
    return YES if not flat else flat[0] if len(flat) == 1 else Node("all", parts=tuple(flat))


def _merge_any(parts: list[Node]) -> Node:
    flat: list[Node] = []
    todo = list(parts)
    while todo:
        p = todo.pop(0)
        if p.kind == "any":
            todo[:0] = p.parts
        elif p.kind == "yes":
            return YES
        elif p.kind != "no" and p not in flat:
            same = next((i for i, q in enumerate(flat) if q.kind == p.kind == "leaf" and q.name == p.name == "id_in"), None)
            if same is None:
                flat.append(p)
            else:
                flat[same] = replace(p, values=p.values | flat[same].values)
    flat.sort(key=_cost)
    return NO if not flat else flat[0] if len(flat) == 1 else Node("any", parts=tuple(flat))


def simplify(expr: FilterExpr | None) -> Node:
    """An equal filter that is flat, has merged leaves in the order of cost, and is ``no`` where it can't hold."""
    if expr is None:
        return YES
    if expr.op == "predicate":
        return _leaf(expr)
    parts = [simplify(p) for p in expr.parts]
    if expr.op == "not":
        inner = parts[0]
        return {"yes": NO, "no": YES}.get(inner.kind) or (inner.parts[0] if inner.kind == "not" else Node("not", parts=(inner,)))
    return _merge_all(parts) if expr.op == "and" else _merge_any(parts)


def uses_stats(node: Node) -> bool:
    return node.name in STATS if node.kind == "leaf" else any(map(uses_stats, node.parts))


def needed(node: Node, wanted: bool = True) -> Node:
    """A filter on metadata alone that holds wherever ``node`` (or, if not wanted, its negation) can hold."""
    if node.kind == "leaf" and node.name in STATS:
        return YES if wanted else NO
    if node.kind == "not":
        inner = needed(node.parts[0], not wanted)
        return {"yes": NO, "no": YES}.get(inner.kind) or Node("not", parts=(inner,))
    if node.kind in ("all", "any"):
        parts = [needed(p, wanted) for p in node.parts]
        return _merge_all(parts) if node.kind == "all" else _merge_any(parts)
    return node


def concrete_region(node: Node) -> tuple[str, int, int] | None:
    """The region outside of which the filter can't hold, if it is named as such or in a conjunction."""
    if node.kind == "leaf" and node.name == "region":
        return node.place
    if node.kind == "all":
        return next((p.place for p in node.parts if p.kind == "leaf" and p.name == "region"), None)
    return None


def _as_float(x: float | None) -> Column | None:
    return None if x is None else F.lit(x).cast("float")


def _between(value: Column, node: Node) -> Column:
    tests = [value >= node.low] if node.low is not None else []
    tests += [value <= node.high] if node.high is not None else []
    return reduce(Column.__and__, tests)


def _one_alternate() -> Column:
    return F.coalesce(~F.contains(F.col("alt_allele"), F.lit(",")), F.lit(True))


def _leaf_test(node: Node) -> Column:
    """Whether a leaf holds; null where a value is missing."""
    if node.name == "chrom":
        test = F.col("chrom").isin(*sorted(node.values))
    elif node.name == "region":
        c, s, e = node.place
        test = (F.col("chrom") == c) & F.col("pos").between(s, e)
    elif node.name == "id_in":
        test = F.col("id").isin(*sorted(node.values))
    elif node.name == "biallelic":
        test = _one_alternate()
    elif node.name == "snp":
        test = (F.octet_length("a0") == 1) & (F.octet_length("a1") == 1) & _one_alternate()
    elif node.name == "qual":
        test = ~F.isnan("qual") & _between(F.col("qual"), replace(node, low=_as_float(node.low), high=_as_float(node.high)))
    elif node.name == "polymorphic":
        test = F.col("mac") > 0
    else:
        test = _between(F.col(node.name).cast("double"), node)
    return test


def _column(node: Node, leaf, below_not) -> Column:
    if node.kind in ("yes", "no"):
        return F.lit(node.kind == "yes")
    if node.kind == "leaf":
        return leaf(node)
    if node.kind == "not":
        return ~below_not(node.parts[0])
    return reduce(Column.__and__ if node.kind == "all" else Column.__or__, [_column(p, leaf, below_not) for p in node.parts])


def to_column(node: Node) -> Column:
    """The filter as a value, true or false, over ``chrom, pos, id, a0, a1, alt_allele, qual`` and the allele statistics it uses."""
    return _column(node, lambda n: F.coalesce(_leaf_test(n), F.lit(False)), to_column)


def to_filter(node: Node) -> Column:
    """The filter as a condition for ``where``, which drops rows for null as for false.

    Only what stands under a negation must be false instead of null; the rest stays
    in a form that is pushed into scans.
    """
    return _column(node, _leaf_test, to_column)


def keep_metadata(variants: DataFrame, expr: FilterExpr | None) -> DataFrame:
    """Rows that can still pass, before any genotype is decoded."""
    node = needed(simplify(expr))
    return variants if node is YES else variants.where(to_filter(node))
