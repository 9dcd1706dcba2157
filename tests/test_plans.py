"""Plan properties of the registered queries (checked on the smallest driver tables):
no cross joins, no Python evaluation, pruned scans, pushed filters, partial aggregation."""

import re

import pytest

from tests.conftest import SF_SMALL


def plan_of(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans(spark):
    from reasonloop.plans import catalog
    return {name: plan_of(spark, fn(spark, SF_SMALL)) for name, fn in catalog.QUERIES.items()}


def test_no_cross_joins_anywhere(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_no_python_evaluation(plans):
    for name, p in plans.items():
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "MapInPandas" not in p and "FlatMapGroupsInPandas" not in p, name


def test_scans_read_only_needed_columns(plans):
    # no query needs the line item's discount, tax, flags or the orders' total price
    for name, p in plans.items():
        for schema in re.findall(r"ReadSchema: (struct<[^\n]*>)", p):
            for col in ("l_discount", "l_tax", "l_returnflag", "l_linestatus", "o_totalprice", "o_orderdate"):
                assert col not in schema, (name, col)


def test_filters_reach_the_scan(plans):
    p = plans["conversation_records"]
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(role,user\)", p)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(role,assistant\)", p)


PICKS = ("keep_first_correct", "retry_shortest_correct", "shortest_vs_first", "rationalize_missed",
         "regroup_candidates", "merge_last_wins", "retry_keep_correct")


def test_picks_are_hash_aggregates_over_numbers(plans):
    for name in PICKS:
        assert "SortAggregate" not in plans[name], name
        assert "partial_m" in plans[name], name      # partial_min / partial_max before the shuffle


def test_picks_extract_once_per_row(plans):
    # the not-null filter of a prediction key must not run the extraction a second time
    for name in ("keep_first_correct", "retry_shortest_correct"):
        for cond in re.findall(r"Condition : ([^\n]*)", plans[name]):
            assert "regexp_extract" not in cond, (name, cond[:200])


def test_misses_are_computed_once(plans):
    for name in ("train_set_correct_only", "train_set_keep_all"):
        assert "LeftAnti" not in plans[name], name   # the written misses are read back


def test_key_only_query_reads_keys_only(plans):
    assert set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plans["hash_split"])) == {"struct<o_orderkey:bigint>"}


def test_regex_heavy_queries_compile(spark):
    """With codegen fallback off, a generated method over the 64 KB limit raises instead of
    silently running interpreted."""
    import __spark_entry__ as E
    qs = E.queries()
    old = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("em_profiles", "extract_profiles", "zero_shot_records", "mismatch_export",
                     "ablation_mismatches", "rescore_stored_predictions", "keep_first_correct"):
            qs[name](spark, SF_SMALL).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", old)


def test_picks_shuffle_by_problem_and_prediction(plans):
    for name in ("keep_first_correct", "retry_shortest_correct"):
        assert re.search(r"hashpartitioning\(id#\d+L?, __pk#\d+", plans[name]), name
