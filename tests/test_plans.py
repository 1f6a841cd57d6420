"""Structural checks on physical plans: the scale properties the design relies on."""

import pytest

import __spark_entry__ as entry
from almanac.plans import QUERIES

from .conftest import SF_SMALL

# Queries whose own plan only reads back what they wrote.
SIDE_EFFECTS = {"q_stream_ingest", "q_weeks_json"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECTS))
def test_no_cross_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_briefing_limits_before_shuffle(spark):
    df = entry.queries()["q_briefing"](spark, SF_SMALL)
    plan = plan_of(df)
    lines = plan.splitlines()
    partial = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l]
    exchanges = [i for i, l in enumerate(lines) if "Exchange" in l]
    assert partial, plan
    # a partial limit sits below (after, in the printed tree) some exchange
    assert any(p > e for p in partial for e in exchanges)
    assert "documents" in plan and plan.count("FileScan") == 1


def test_scan_is_pruned(spark):
    df = entry.queries()["q_week_list"](spark, SF_SMALL)
    plan = plan_of(df)
    scan = [l for l in plan.splitlines() if "FileScan" in l][0]
    assert "ReadSchema: struct<doc_id:bigint>" in scan


def test_bm25_broadcasts_only_term_frequencies(spark):
    plan = plan_of(entry.queries()["q_bm25"](spark, SF_SMALL))
    assert plan.count("BroadcastExchange") == 1
    assert "Filter term#" in plan or "term" in plan


def test_ann_query_reads_only_the_index(spark):
    plan = plan_of(entry.queries()["q_ann_topk"](spark, SF_SMALL))
    scans = [l for l in plan.splitlines() if "FileScan" in l]
    assert scans and all("embeddings.parquet" not in l for l in scans), scans
    assert all("ann-search" in l for l in scans)      # the ranking of what the two passes found


@pytest.mark.parametrize("name", ["q_table_repair", "q_table_repair_light"])
def test_table_repair_is_one_scan_without_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert plan.count("FileScan") == 1 and "Window" not in plan and "Exchange" not in plan


def test_cosine_has_the_query_norm_as_a_number(spark):
    plan = plan_of(QUERIES["q_cosine_topk"](spark, SF_SMALL))
    assert plan.count("SQRT(") == 1      # the norm of the stored vector only
