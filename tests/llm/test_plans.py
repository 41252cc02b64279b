"""What the plans of the queries must and mustn't hold."""

import os
import re

import pytest

from lociframe.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_plan_compares_all_pairs_or_runs_python_by_row(spark, name):
    text = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ExternalRDD", text)


def test_encoding_takes_no_shuffle_and_reads_two_columns(spark):
    text = queries.QUERIES["p6_ids"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_sql_is_given_for_known_queries_only():
    assert set(queries.SQL) <= set(queries.QUERIES)
