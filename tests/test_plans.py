"""What the plans of queries must and mustn't hold, whatever the size of the tables."""

import os
import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")


def plan(spark, name):
    df = entry.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", text)]


CORE = sorted(n for n in entry.queries() if not re.match(r"p[2678]_", n))


@pytest.mark.parametrize("name", CORE)
def test_no_plan_compares_all_pairs_or_runs_python_by_row(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ExternalRDD", text)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("variants_frame", {"variant_idx", "chrom", "pos", "id", "a0", "a1"}), ("filter_chrom", {"variant_idx", "chrom", "pos", "id", "a0", "a1"}), ("p3_found", {"file_id", "line_number", "text"}), ("variant_stats_hardcall", {"vec_id", "embedding"}), ("region_join", {"vec_id", "label"})],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    assert columns in read_columns(plan(spark, name))


def test_places_and_ids_reach_the_scan(spark):
    assert "EqualTo(chrom,1), GreaterThanOrEqual(pos,20000000), LessThanOrEqual(pos,160000000)" in plan(spark, "filter_region")
    assert "EqualTo(chrom,7)" in plan(spark, "filter_chrom") and "In(id, [" in plan(spark, "filter_id_in")
    assert "GreaterThanOrEqual(qual,20.5), LessThanOrEqual(qual,60.1)" in plan(spark, "filter_qual")


def test_metadata_filters_need_no_statistics_and_contradictions_no_scan(spark):
    assert "Exchange" not in plan(spark, "filter_snp") and "Exchange" not in plan(spark, "filter_qual")
    assert "FileScan" not in plan(spark, "filter_contradiction")


def test_array_statistics_take_no_shuffle(spark):
    for name in ("variant_stats_hardcall", "variant_stats_dosage", "read_impute_mean", "haplotype_long", "filter_stats_wide"):
        assert "Exchange" not in plan(spark, name)


def test_scoped_tables_are_deleted_at_the_end(spark, tmp_path):
    from lociframe.plans import Workspace, scoped_tables

    kept = Workspace(spark, "kept").store(spark.range(3), "t")
    undone = []
    with scoped_tables():
        ws = Workspace(spark, "scoped")
        ws.at_removal(lambda: undone.append(ws.root))
        stored = ws.store(spark.range(5), "t")
        assert stored.count() == 5 and not undone
    assert undone == [ws.root] and not os.path.exists(ws.root.removeprefix("file:")) and kept.count() == 3
