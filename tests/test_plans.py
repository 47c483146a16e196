"""What the plans of the engine's queries may not hold."""

import re

import pytest

import __spark_entry__ as entry

EAGER = ("stream_", "dedup_two_key", "search_run", "ledger_append", "ledger_compact", "decision_merge", "backfill_stored", "url_repair_stored")
NAMES = [n for n in entry.queries() if not n.startswith(("op", "pipeline", *EAGER))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_native_and_without_products(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert not re.search("CartesianProduct|NestedLoop|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)


def test_scans_read_what_they_need(spark, sf_dir):
    plan = plan_of(entry.queries()["monthly_eur"](spark, sf_dir))
    assert "html" not in plan and "n_chars" not in plan
    plan = plan_of(entry.queries()["daily_usage"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string>", plan) or "props" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = entry.queries()["decisions_recent"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    best = plan_of(entry.queries()["newest_n_per_type"](spark, sf_dir))
    assert "WindowGroupLimit" in best


def test_rules_are_pushed_below_the_joins(spark, sf_dir):
    plan = plan_of(entry.queries()["top_matches"](spark, sf_dir))
    scan = plan[plan.index("FileScan parquet [doc_id") :]
    assert "RLIKE" in scan[: scan.index("Location")]
