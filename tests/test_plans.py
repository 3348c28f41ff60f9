"""Plans keep to the shapes that scale."""

from __future__ import annotations

import pytest

from clausetrail.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
PYTHON_ALLOWED = {"txt_11_visible_text", "str_5_rate_sampling", "str_5_rate_sampling_stream"}


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_python_only_where_named(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_ALLOWED:
        assert "InPandas" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["pol_10_broad_data_sharing", "pol_23_risk_level", "pol_27_sections", "txt_4_clauses"])
def test_policy_analysis_is_one_map(spark, name):
    """Beyond spreading a single input file, analysing text shuffles nothing."""
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") == 0 and text.count("RoundRobinPartitioning") <= 1


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "txt_13_word_count")
    scan = next(line for line in text.splitlines() if "documents.parquet" in line)
    assert "n_chars" not in scan.split("ReadSchema")[1] and "source" not in scan.split("ReadSchema")[1]
