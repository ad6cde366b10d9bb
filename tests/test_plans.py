"""Physical plans: no Python, pruned scans, few exchanges, early group limits."""

import re

import pytest

import __spark_entry__ as entry_points
from bindings.registry import QUERIES, turn_pairs
from inkwell.operators import overlap
from inkwell.operators.alignment import meteor
from inkwell.operators.scores import score_table

TABLES = "/root/testdata/sf0.001"


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[-1] if "Initial Plan" in text else text


def planned(spark, name):
    return plan_of(entry_points.queries()[name](spark, TABLES))


@pytest.mark.parametrize("name", [
    "section_filter", "basic_profile", "id_parts_by_sql_function", "language_filter", "pairs", "top_k_per_folder",
    "dedup_last", "split", "rouge_n", "bleu", "meteor", "extractive_summary", "encode", "generation_limits",
])
def test_no_python_in_plan(spark, name):
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|InPandas|InArrow", planned(spark, name))


@pytest.mark.parametrize("name", [
    "section_filter", "basic_profile", "object_paths", "split", "language_detect", "generation_limits", "sentences",
])
def test_row_functions_do_not_regroup(spark, name):
    assert "Exchange" not in planned(spark, name).replace("BroadcastExchange", "")


def test_bodies_move_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanged = re.findall(r"Exchange hashpartitioning\((\w+)#", planned(spark, "pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanged.count("article_path") == 2 and exchanged.count("abstract_path") == 2


def test_nothing_is_written_to_the_temporary_folder(spark, monkeypatch):
    import tempfile

    monkeypatch.setattr(tempfile, "mkdtemp", lambda *a, **k: pytest.fail("a temporary folder was made"))
    entry_points.queries()["vocabulary"](spark, TABLES).count()


def test_group_limit_before_exchange(spark):
    for name in ("top_k_per_folder", "dedup_last"):
        plan = planned(spark, name)
        assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning")
        assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_scores_exchange_texts_once_by_key(spark):
    # Without a small side to broadcast, the pairing join itself has exchanges;
    # count only those on the pair key above it.
    pairs = turn_pairs(spark, TABLES)
    for df in (overlap.rouge_n(pairs, ["conv_id", "turn"]), overlap.bleu(pairs, ["conv_id", "turn"]),
               meteor(pairs, ["conv_id", "turn"])):
        assert plan_of(df).count("Exchange hashpartitioning(conv_id") == 1


def test_unused_metrics_are_not_planned(spark):
    pairs = turn_pairs(spark, TABLES)
    plan = plan_of(score_table(pairs, ["conv_id", "turn"], bleu=True, include_texts=False))
    assert "ArrowEvalPython" not in plan and "Window" not in plan


def test_scan_reads_only_what_is_needed(spark):
    plan = planned(spark, "manifest")
    assert "struct<doc_id:bigint,source:string>" in plan and "text" not in plan


def test_no_cartesian_products(spark):
    for name in QUERIES:
        plan = planned(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name



def test_partitions_follow_the_bytes_of_the_scans(spark, tmp_path, monkeypatch):
    from inkwell import session

    for sf in ("sf0.01", "sf0.1"):
        pairs = turn_pairs(spark, f"/root/testdata/{sf}")
        assert session.spread(pairs, "conv_id", "turn").rdd.getNumPartitions() == 4
    size = session.input_bytes(pairs)
    assert 0 < size <= 4 * 1_731_503
    monkeypatch.setattr(session, "SPREAD_BYTES", size // 9)
    assert 9 <= session.spread(pairs, "conv_id", "turn").rdd.getNumPartitions() <= 10
    # A table without statistics has the setting.
    local = spark.createDataFrame([(1, "a")], "k int, t string")
    assert session.spread(local, "k").rdd.getNumPartitions() == 4
