import numpy as np
import pytest
from pyspark.sql import functions as F

import lociframe as L
from lociframe.errors import MissingDataError, untagged
from lociframe.functions.alleles import long_stats, with_stats
from lociframe.operators import cohort as ops
from lociframe.plans.joins import hot_keys, sized_join, skew_join
from lociframe.plans.ordinals import with_ordinal, with_running


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(0, "1", 10, "a", "A", "C", [0.0, 1.0, None]), (1, "1", 70000, "b", "G", "T", [2.0, 2.0, 1.0]), (2, "2", 5, "c", "A", "C", [None, None, None]), (3, "2", 9, "d", "A", "C", [0.0, 0.0, 0.0]), (4, "2", 11, "e", "A", "C", [])]
    return spark.createDataFrame(rows, "variant_idx long, chrom string, pos long, id string, a0 string, a1 string, calls array<float>").withColumns({"alt_allele": F.lit(None).cast("string"), "qual": F.lit(None).cast("float")})


def test_statistics_of_plain_missing_and_empty_rows(wide):
    got = {r.id: r for r in with_stats(wide).collect()}
    assert (got["a"].n_called, got["a"].allele_count, got["a"].missing_rate, got["a"].af, got["a"].mac) == (2, 1.0, 1 / 3, 0.25, 1.0)
    assert (got["b"].maf, got["b"].mac, got["b"].polymorphic) == (1 - 5 / 6, 1.0, True)
    assert (got["c"].n_called, got["c"].maf, got["c"].missing_rate, got["c"].polymorphic) == (0, None, 1.0, False)
    assert (got["d"].mac, got["d"].polymorphic) == (0.0, False)
    assert (got["e"].missing_rate, got["e"].af) == (0.0, None)


def test_statistics_agree_with_numpy_on_random_calls(spark):
    rng = np.random.default_rng(3)
    g = rng.choice([0.0, 1.0, 2.0, np.nan], size=(200, 37), p=[0.5, 0.2, 0.2, 0.1])
    data = [(k, [None if np.isnan(x) else float(x) for x in row]) for k, row in enumerate(g)]
    w = spark.createDataFrame(data, "variant_idx long, calls array<float>")
    cells = ops.long_cells(w)
    n, ac = (~np.isnan(g)).sum(1), np.nansum(g, 1)
    for frame in (with_stats(w), long_stats(cells, 37)):
        for r in frame.collect():
            k = r.variant_idx
            af = ac[k] / (2 * n[k])
            assert (r.n_called, r.allele_count, r.mac) == (n[k], ac[k], min(ac[k], 2 * n[k] - ac[k]))
            assert r.maf == min(af, 1 - af) and r.missing_rate == (37 - n[k]) / 37


def test_missing_policies_fail_for_retained_variants_only(wide):
    assert ops.read_variants(wide, L.missing_rate(0.0), "raise").count() == 3
    with pytest.raises(Exception) as e:
        ops.read_variants(wide, None, "raise").collect()
    assert isinstance(untagged(e.value), MissingDataError)
    with pytest.raises(Exception) as e:
        ops.read_variants(wide, L.chrom("2"), "impute").collect()
    assert isinstance(untagged(e.value), MissingDataError)
    assert ops.read_variants(wide, L.chrom("1"), "impute").orderBy("variant_idx").first().calls == [0.0, 1.0, 0.5]
    with pytest.raises(L.InvalidOptionError):
        ops.apply_missing(wide, "other")


def test_orientation_keeps_ties(spark):
    w = spark.createDataFrame([(0, "A", "C", [1.0, 1.0]), (1, "A", "C", [2.0, 1.0]), (2, "A", "C", [2.0, None])], "variant_idx long, a0 string, a1 string, calls array<float>")
    got = [(r.flipped, r.a0, r.a1, r.calls) for r in ops.orient_minor(w).orderBy("variant_idx").collect()]
    assert got == [(False, "A", "C", [1.0, 1.0]), (True, "C", "A", [0.0, 1.0]), (True, "C", "A", [0.0, None])]


def test_sparse_columns_rebuild_the_matrix(spark):
    rng = np.random.default_rng(5)
    g = rng.choice([0.0, 1.0, 2.0], size=(60, 9), p=[0.7, 0.2, 0.1])
    w = spark.createDataFrame([(k * 3, [float(x) for x in row]) for k, row in enumerate(g)], "variant_idx long, calls array<float>").repartition(5)
    cols = sorted(ops.csc_columns(w).collect(), key=lambda r: r.column)
    assert [r.variant_idx for r in cols] == [3 * k for k in range(60)]
    back, end = np.zeros_like(g), 0
    for r in cols:
        end += r.nnz
        assert r.indptr_end == end
        back[r.column, r.indices] = r.data
    np.testing.assert_array_equal(back, g)
    rows = {r.sample_idx: r.nnz for r in ops.csr_rows(w, 9).collect()}
    assert rows == {i: int((g[:, i] != 0).sum()) for i in range(9)}
    for size in (7, 1000):
        major = {}
        for r in sorted(ops.sample_major(w, part_variants=size).collect(), key=lambda r: (r.sample_idx, r.part)):
            assert len(r["values"]) <= size
            major.setdefault(r.sample_idx, []).extend(r["values"])
        np.testing.assert_array_equal(np.array([major[i] for i in range(9)]), g.T)
        back, end = np.zeros_like(g), 0
        for r in sorted(ops.csr_parts(w, part_variants=size).collect(), key=lambda r: (r.sample_idx, r.part)):
            end += r.nnz
            assert r.indptr_end == end and r.indices == sorted(r.indices) and len(r.indices) == r.nnz <= size
            back[r.indices, r.sample_idx] = r.data
        np.testing.assert_array_equal(back, g)


def test_sparse_forms_refuse_what_32_bits_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(ops, "MOST_32", 2)
    w = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], "variant_idx long, calls array<float>")
    for made in (ops.csc_columns(w), ops.csr_parts(w)):
        with pytest.raises(Exception, match="32-bit"):
            made.collect()


def test_design_needs_every_column_only_if_asked(spark):
    samples = spark.createDataFrame([(1, "b"), (0, "a")], "sample_idx long, iid string")
    traits = spark.createDataFrame([("a", 1.0, 2), ("b", None, 3)], "iid string, trait double, sex int")
    assert [tuple(r) for r in ops.align_design(samples, traits).select("iid", "trait").collect()] == [("a", 1.0), ("b", None)]
    for table in (traits, traits.where("iid = 'a'")):
        with pytest.raises(Exception) as e:
            ops.align_design(samples, table, complete=True).collect()
        assert isinstance(untagged(e.value), MissingDataError)
    assert ops.align_design(samples, traits.drop("trait"), complete=True).count() == 2


def test_blocks_and_windows(wide, spark):
    many = spark.range(1000).select((F.col("id") * 7).alias("variant_idx")).repartition(13)
    got = {r.variant_idx: (r.retained_idx, r.block_idx) for r in ops.variant_blocks(many, 64).collect()}
    assert got == {7 * k: (k, k // 64) for k in range(1000)}
    for start, length in ((10, 3), (998, 50), (1000, 5)):
        assert sorted(r.variant_idx for r in ops.variant_window(many, start, length).collect()) == [7 * k for k in range(1000)][start : start + length]
    repeated = spark.createDataFrame([(k,) for k in (1, 2, 2, 2, 3)], "variant_idx long")
    assert [ops.variant_window(repeated, a, 2).count() for a in (2, 4)] == [2, 1]
    with pytest.raises(L.InvalidOptionError):
        ops.variant_blocks(wide, True)


def test_region_join_keeps_empty_regions_and_crosses_bins(wide, spark):
    r = spark.createDataFrame([(0, "1", 1, 200000), (1, "2", 6, 9), (2, "9", 1, 5), (3, "2", 9, 6), (4, "1", 70000, 70000), (5, None, 1, 2)], "region_idx long, chrom string, start long, end long")
    got = ops.region_join(wide.select("variant_idx", "chrom", "pos"), r).groupBy("region_idx").agg(F.sort_array(F.collect_list("variant_idx")).alias("v")).collect()
    assert {x.region_idx: x.v for x in got} == {0: [0, 1], 1: [3], 2: [], 3: [], 4: [1], 5: []}


def test_region_join_is_the_same_where_regions_are_many(wide, spark, monkeypatch):
    from lociframe.plans import joins

    r = spark.createDataFrame([(0, "1", 1, 200000), (1, "2", 6, 9), (2, "9", 1, 5)], "region_idx long, chrom string, start long, end long")
    few = sorted(map(str, ops.region_join(wide, r).collect()))
    monkeypatch.setattr(ops, "sized_join", lambda a, b, key, how, spread_by: joins.skew_join(a, b, key, how, hot_rows=1, spread_by=spread_by))
    assert sorted(map(str, ops.region_join(wide, r).collect())) == few


def test_samples_are_found_once_or_refused(spark):
    s = spark.createDataFrame([(0, "A"), (1, "B"), (2, "B")], "sample_idx long, iid string")
    assert ops.sample_places(s, ["A"]) == [0] and ops.sample_places(s, []) == []
    for bad in (["B"], ["A", "X"]):
        with pytest.raises(L.SampleFilterError):
            ops.sample_places(s, bad)
    with pytest.raises(L.InvalidOptionError):
        ops.sample_places(s, ["A", "A"])


def test_design_keeps_sample_order_and_nulls(spark):
    s = spark.createDataFrame([(0, "B"), (1, "A"), (2, "C")], "sample_idx long, iid string")
    t = spark.createDataFrame([("A", 1.5), ("B", 2.5)], "iid string, trait double")
    assert [(r.iid, r.trait) for r in ops.align_design(s, t).collect()] == [("B", 2.5), ("A", 1.5), ("C", None)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_joins_equal_plain_ones(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("4", 3), (None, 4), ("nobody", 5)], "k string, v int")
    assert hot_keys(left, "k", 500) == ["hot"]
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
    assert sorted(map(tuple, skew_join(left, right, "k", how, hot_rows=500).collect()), key=repr) == plain
    assert sorted(map(tuple, sized_join(left, right, "k", how, rows=2).collect()), key=repr) == plain
    assert sorted(map(tuple, sized_join(left, right, "k", how).collect()), key=repr) == plain


def test_ordinals_and_running_sums_of_empty_tables(spark):
    empty = spark.createDataFrame([], "v long, n long")
    assert with_ordinal(empty, "v").count() == 0 and with_running(empty, "v", sums={"n": "s"}).count() == 0
    some = spark.createDataFrame([(3, 1), (1, None), (2, 5)], "v long, n long")
    assert sorted(map(tuple, with_running(some, "v", "k", {"n": "s"}).collect())) == [(1, None, 0, 0), (2, 5, 1, 5), (3, 1, 2, 6)]


def test_shared_folder_is_the_sessions(spark):
    from lociframe.plans.workspace import Workspace, remove_tables, shared_folder

    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    ws = Workspace(spark, "t")
    stored = ws.store(spark.range(3).toDF("x"), "x")
    assert stored.count() == 3 and ws.root.startswith(folder)
    ws.drop(stored)
    kept = ws.store(spark.range(3).toDF("x"), "x")
    remove_tables()
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        kept.collect()
