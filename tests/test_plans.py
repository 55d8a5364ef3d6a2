"""Plan-shape checks: pushdown, pruning, bounded top-N, no Python in the hot path,
no cartesian products."""

import pytest

from kwspread.plans.registry import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()
#: Element trees of pages, and the automaton of long dictionaries, work in Arrow batches.
ARROW_OK = {"page_extract_nested", "page_extract_first_selector", "page_error_rows", "match_large_dictionary", "match_dictionary_10k"}
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REG))
def test_no_cartesian_and_no_python(spark, name):
    p = plan_of(REG[name].build(spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert not any(node in p for node in (PYTHON if name not in ARROW_OK else PYTHON[:1]))


@pytest.mark.parametrize("name", ["cap_after_match", "cap_before_match", "sample_oldest", "latest_videos_per_channel"])
def test_top_n_uses_group_limit(spark, name):
    p = plan_of(REG[name].build(spark, SF))
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    from kwspread.plans import views as V

    df = V.table(spark, SF, "events").where(F.col("event_type") == "view").select("event_id")
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_short_dictionary_stays_in_generated_code(spark):
    from pyspark.sql import functions as F

    from kwspread.functions import match as M

    df = spark.createDataFrame([("x",)], "text string").select(
        M.first_match(F.col("text"), ["a"] * M.CHAIN).alias("a"), M.all_matches_joined(F.col("text"), ["b", "c"]).alias("b"))
    p = plan_of(df)
    assert not any(node in p for node in PYTHON) and "lambda" not in p


def test_obs_carries_no_text_through_join(spark):
    from kwspread.plans import views as V

    p = plan_of(V.obs(spark, SF))
    # the documents scan reads text once for matching; the join carries only md5/keywords
    assert "Exchange" not in p or "text:string" not in p.split("Exchange", 1)[1].split("Scan", 1)[0]
