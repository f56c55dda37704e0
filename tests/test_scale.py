"""Plans that must hold at scale: pruned scans, no cross joins, no Python where expressions do."""

import os

import pytest

from tallyforge import plans

DATA = os.environ.get("TALLYFORGE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return plans.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("name", "column"), [("signal_line_classes", "signal_line"), ("shifted_dates", "signal_date"), ("score_histogram", "ai_maturity_score")])
def test_nested_columns_are_pruned(spark, name, column):
    schema = [x for x in plan(spark, name).splitlines() if "ReadSchema" in x][-1].split("ReadSchema:")[1]
    assert column in schema and "bench_summary" not in schema and "candidate_output" not in schema


def test_filters_reach_the_scan(spark):
    assert "IsNotNull(event_type), EqualTo(event_type,purchase)" in plan(spark, "asof_nearest")


@pytest.mark.parametrize("name", ["eightgram_nearest", "task_scores", "check_results", "asof_nearest", "family_date_gaps", "state_fold", "preference_accuracy", "capacity_reasons", "schema_violations"])
def test_no_products_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", ["task_scores", "check_results", "capacity_reasons", "schema_violations", "assembled_prompts"])
def test_row_checks_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "latest_events") and "WindowGroupLimit" in plan(spark, "longest_documents")


@pytest.mark.parametrize("name", ["lexical_nearest", "embedding_nearest"])
def test_the_searched_side_is_scanned_once_and_not_broadcast(spark, name):
    text = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and "BroadcastExchange" not in text


def test_no_query_side_goes_through_the_driver():
    import inspect

    from tallyforge.operators import similarity

    assert "toPandas" not in inspect.getsource(similarity) and ".broadcast(" not in inspect.getsource(similarity)
