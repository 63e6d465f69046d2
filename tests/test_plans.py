"""The plans are those that the engine is designed for."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_point_lookup_is_pushed_down(spark):
    assert "EqualTo(o_orderkey,42)" in plan(spark, "point_lookup")


def test_time_window_is_pushed_down(spark):
    p = plan(spark, "upcoming_window")
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p and "Exchange" not in p


def test_top_needs_no_full_sort(spark):
    p = plan(spark, "history_top100")
    assert "TakeOrderedAndProject(limit=100" in p and "Exchange" not in p


def test_scans_read_the_needed_columns(spark):
    p = plan(spark, "history_top100")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan(spark, "lookup_default")


def test_best_price_shuffles_once_and_after_partial_aggregation(spark):
    p = plan(spark, "best_price")
    assert p.count("Exchange hashpartitioning") == 1 and "partial_min_by" in p and "Window" not in p


@pytest.mark.parametrize("name", ["market_difference", "first_bookmaker_pivot", "unnest_quotes", "odds_text", "fold_stream"])
def test_one_shuffle(spark, name):
    assert plan(spark, name).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["implied_text", "normalize_name", "lookup_default", "json_field", "outcome_label", "russian_date", "delete_by_id"])
def test_row_operators_do_not_shuffle(spark, name):
    p = plan(spark, name)
    assert "Exchange" not in p and "Python" not in p


def test_no_domain_query_runs_python(spark):
    """But the one that asks an injected model, which is a Python function, and those that run streams to their end."""
    for name in set(entry.own.QUERIES) - {"model_stream", "streamed_frames", "streamed_analyses", "sent_frames"}:
        assert "EvalPython" not in plan(spark, name) and "InPandas" not in plan(spark, name)


@pytest.mark.parametrize("name,shuffles", [("match_quotes", 2), ("all_odds_text", 2), ("typed_feed", 2), ("first_bookmaker", 2), ("best_odds", 3)])
def test_matches_are_nested_by_one_shuffle(spark, name, shuffles):
    """One of lines and one of orders, and one a grouping of the query's own."""
    p = plan(spark, name)
    assert p.count("Exchange hashpartitioning") <= shuffles and p.count("rangepartitioning") == 0


def test_names_are_not_compared_with_all(spark):
    for name in ("fuzzy_name_join", "supplier_customers", "first_named_match"):
        assert "NestedLoop" not in plan(spark, name) and "Cartesian" not in plan(spark, name)
