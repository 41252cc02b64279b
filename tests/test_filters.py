import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

import lociframe as L
from lociframe.filters import as_filter, from_ir
from lociframe.plans.predicates import NO, YES, concrete_region, needed, simplify, to_column, to_filter, uses_stats

LEAVES = [L.chrom("1"), L.id_in(["rs1"]), L.qual(min=20), L.maf(min=0.4)]


def truth(expr, row):
    """Plain evaluation of a filter on a row; a null fails its leaf."""
    if expr.op != "predicate":
        parts = [truth(p, row) for p in expr.parts]
        return not parts[0] if expr.op == "not" else all(parts) if expr.op == "and" else any(parts)
    p = dict(expr.params)
    if expr.name == "chrom":
        return row["chrom"] == p["value"]
    if expr.name == "id_in":
        return row["id"] in p["values"]
    if expr.name == "region":
        c, _, span = p["value"].partition(":")
        a, b = map(int, span.split("-"))
        return row["chrom"] == c and a <= row["pos"] <= b
    if expr.name == "biallelic":
        return row["alt_allele"] is None or "," not in row["alt_allele"]
    if expr.name == "snp":
        return len(row["a0"]) == len(row["a1"]) == 1 and (row["alt_allele"] is None or "," not in row["alt_allele"])
    if expr.name == "polymorphic":
        return row["mac"] is not None and row["mac"] > 0
    v = row[expr.name]
    if v is None or math.isnan(v):
        return False
    cut = (lambda x: x) if expr.name == "mac" else (lambda x: float(np.float32(x)))
    return cut(p.get("min", -math.inf)) <= v <= cut(p.get("max", math.inf))


def rows():
    base = {"pos": 15, "a0": "A", "a1": "C", "alt_allele": "C", "mac": 3.0, "missing_rate": 0.25}
    out = []
    for c, i, q, m in itertools.product(["1", "2"], ["rs1", "x"], [10.0, 30.0, None], [0.1, 0.45, None]):
        out.append(base | {"chrom": c, "id": i, "qual": q, "maf": m})
    out += [
        base | {"chrom": "1", "id": "n", "qual": float("nan"), "maf": 0.1, "alt_allele": "C,G", "pos": 5},
        base | {"chrom": "2", "id": "y", "qual": 20.0, "maf": 0.4, "alt_allele": None, "a1": "CT", "mac": 0.0, "missing_rate": 0.0},
        base | {"chrom": "1", "id": "z", "qual": 20.0, "maf": float(np.float32(0.4)), "mac": None, "missing_rate": 1.0, "pos": 99},
    ]
    return [r | {"n": k} for k, r in enumerate(out)]


SCHEMA = "pos long, a0 string, a1 string, alt_allele string, mac double, missing_rate double, chrom string, id string, qual float, maf double, n int"


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([Row(**r) for r in rows()], SCHEMA).coalesce(1).cache()
    df.count()
    return df


def kept(table, column):
    return {r.n for r in table.where(column).select("n").collect()}


def trees():
    level0 = LEAVES + [~x for x in LEAVES]
    for a, b in itertools.combinations(LEAVES, 2):
        yield from (a & b, a | b, ~(a & b), ~(a | b), ~a & b, a | ~b)
    for a, b, c in itertools.combinations(level0[:6], 3):
        yield (a & b) | c
        yield ~((a | b) & ~c)
    yield from level0


def test_compiled_filters_agree_with_plain_evaluation(table):
    exprs = list(trees())
    flags = table.select("n", *[to_column(simplify(e)).alias(f"e{k}") for k, e in enumerate(exprs)], *[to_column(needed(simplify(e))).alias(f"m{k}") for k, e in enumerate(exprs)]).collect()
    by_n = {r["n"]: r for r in rows()}
    for r in flags:
        for k, e in enumerate(exprs):
            assert r[f"e{k}"] is truth(e, by_n[r["n"]]), (e.to_ir(), by_n[r["n"]])
            assert r[f"m{k}"] or not r[f"e{k}"]  # what metadata reject can't pass


leaf = st.sampled_from(
    LEAVES + [L.chrom("2"), L.region("1:1-50"), L.region("1:40-120"), L.region("2:1-20"), L.snp(), L.biallelic(), L.polymorphic(), L.maf(max=0.2), L.mac(min=1), L.mac(max=2), L.missing_rate(0.3), L.qual(max=25), L.id_in(["y", "rs1"]), L.id_in([])]
)
tree = st.recursive(leaf, lambda t: st.one_of(st.tuples(t, t).map(lambda p: p[0] & p[1]), st.tuples(t, t).map(lambda p: p[0] | p[1]), t.map(lambda x: ~x)), max_leaves=8)


def test_conditions_keep_the_rows_that_columns_tell(table):
    for e in [*LEAVES, *[~x for x in LEAVES], (L.qual(min=20) | L.maf(min=0.4)) & ~(L.maf(max=0.2) & L.chrom("1")), L.qual(max=25) & ~L.maf(min=0.4)]:
        assert kept(table, to_filter(simplify(e))) == {r["n"] for r in rows() if truth(e, r)}


@settings(max_examples=15, deadline=None)
@given(st.lists(tree, min_size=12, max_size=12))
def test_simplified_filters_keep_their_meaning(table, exprs):
    flags = table.select("n", *[to_column(simplify(e)).alias(f"e{k}") for k, e in enumerate(exprs)], *[to_column(needed(simplify(e))).alias(f"m{k}") for k, e in enumerate(exprs)]).collect()
    by_n = {r["n"]: r for r in rows()}
    for r in flags:
        for k, e in enumerate(exprs):
            assert r[f"e{k}"] is truth(e, by_n[r["n"]])
            assert r[f"m{k}"] or not r[f"e{k}"]
            assert not uses_stats(needed(simplify(e)))


def test_thresholds_are_of_32_bits(table, spark):
    exact = spark.createDataFrame([(0.1,)], "maf double")
    assert exact.where(to_column(simplify(L.maf(min=0.1)))).count() == 0
    assert exact.where(to_column(simplify(L.maf(max=0.1)))).count() == 1


@pytest.mark.parametrize(
    "expr",
    [
        L.chrom("1") & L.chrom("2"), L.region("1:1-5") & L.region("1:6-9"), L.region("1:1-5") & L.chrom("2"), L.id_in(["a"]) & L.id_in(["b"]),
        L.maf(min=0.3) & L.maf(max=0.2), L.mac(min=3) & (L.snp() & L.mac(max=2)), L.id_in([]), (L.chrom("1") & L.chrom("2")) & L.snp(), ~(~(L.chrom("1")) | ~L.chrom("2")) & L.chrom("1") & L.chrom("3"),
    ],
)
def test_contradictions_are_found_without_data(expr):
    assert simplify(expr) is NO


def test_simplification_merges_and_orders():
    n = simplify(L.maf(min=0.1) & L.snp() & L.chrom("1") & L.maf(max=0.4) & L.biallelic() & L.region("1:5-9"))
    assert [(p.name, p.low, p.high) for p in n.parts] == [("region", None, None), ("snp", None, None), ("maf", float(np.float32(0.1)), float(np.float32(0.4)))]
    assert concrete_region(n) == ("1", 5, 9) and concrete_region(simplify(L.region("1:5-9") | L.snp())) is None
    assert simplify(~~L.snp()) == simplify(L.snp()) and simplify(None) is YES
    assert simplify(L.id_in(["a"]) | L.id_in(["b"])).values == {"a", "b"}


def test_ir_is_plain_json_and_round_trips():
    e = ~(L.chrom("1") & L.id_in({"b", "a"})) | L.maf(min=0.1, max=0.5)
    ir = json.loads(json.dumps(e.to_ir()))
    assert ir["left"] == {"op": "not", "expr": {"op": "and", "left": {"op": "predicate", "name": "chrom", "params": {"value": "1"}}, "right": {"op": "predicate", "name": "id_in", "params": {"values": ["a", "b"]}}}}
    assert from_ir(ir) == e


@pytest.mark.parametrize(
    "bad",
    [
        lambda: L.chrom(""), lambda: L.chrom(1), lambda: L.region("1:5"), lambda: L.region("1:0-5"), lambda: L.region("1:6-5"), lambda: L.region(None), lambda: L.maf(), lambda: L.maf(min=True), lambda: L.maf(max=1.5),
        lambda: L.maf(min=0.5, max=0.1), lambda: L.maf(min=float("nan")), lambda: L.mac(min=1.5), lambda: L.mac(min=-1), lambda: L.qual(), lambda: L.qual(min=float("inf")), lambda: L.missing_rate(None), lambda: L.missing_rate(2),
        lambda: L.id_in("rs1"), lambda: L.id_in([1]), lambda: L.id_in(["a", "a"]), lambda: L.id_in(5), lambda: as_filter(len), lambda: as_filter("rs1"), lambda: as_filter(3),
    ],
)
def test_bad_values_are_refused(bad):
    with pytest.raises(L.InvalidOptionError):
        bad()


def test_filters_combine_only_with_filters():
    with pytest.raises(TypeError):
        L.snp() & "x"
