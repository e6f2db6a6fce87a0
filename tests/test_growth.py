"""Nothing that grows with the input is broadcast by a guess of its size; texts are written after their shuffles."""
import pytest
from pyspark.sql import functions as F

from revlens.plans.findings_flow import _located, parse_findings
from revlens.registry import QUERIES, _index
from revlens.sources import synth


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _optimized(df, kind):
    return [n for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == kind]


def _physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["normalise_findings", "content_hash", "read_source_versions", "change_cone", "generate_tasks", "build_slices"])
def test_nothing_is_broadcast_by_a_guess(spark, sf_dir, name):
    plan = _physical(QUERIES[name](spark, sf_dir))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_of_versions_do_not_travel(spark, sf_dir):
    dealt = _optimized(synth.source_versions(spark, sf_dir), "RepartitionByExpression")
    assert dealt and not any("content" in n.output().toString() for n in dealt)


def test_versions_of_one_file_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(7,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    li = spark.range(300).select(F.col("id").alias("l_orderkey"), F.lit(7).cast("long").alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit(5.0).alias("l_quantity"))
    li.filter("floor(l_orderkey / 3) % 25 = 7").write.parquet(str(tmp_path / "lineitem.parquet"))
    v = synth.source_versions(spark, str(tmp_path)).filter("external_pr_id is not null")
    assert v.count() == 12 and v.select(F.spark_partition_id()).distinct().count() > 1
    assert v.select("external_pr_id", "from_head").distinct().count() == 12


def test_files_are_written_in_more_tasks_than_their_table_has_splits(spark, sf_dir):
    assert _optimized(synth.source_files(spark, sf_dir), "RepartitionByExpression")


def test_index_keeps_no_texts(spark, sf_dir):
    ix = _index(spark, sf_dir)
    assert not any(df.storageLevel.useMemory for df in (ix.files, ix.diffs, ix.lines))


def test_allocations_take_no_texts_along(spark, sf_dir):
    joins = _optimized(QUERIES["slice_allocations"](spark, sf_dir), "Join")
    assert joins and not any(c in j.output().toString() for j in joins for c in ("diff_text", "test_text"))


def test_parsing_sends_no_answer_text(spark):
    answers = spark.createDataFrame([(1, 1, "a.go", '{"findings":[]}')], "task_id long, pull_request_id long, file_path string, raw string")
    hunks = spark.createDataFrame([(1, "a.go", 1, 2)], "pull_request_id long, path string, start int, end int")
    (join,) = _optimized(parse_findings(answers, hunks), "Join")
    assert not any(c in join.output().toString() for c in ("json", "_fs", "confidence_tier"))


def test_findings_take_their_lines_and_symbols_along(spark):
    lines = spark.createDataFrame([("r", "a.go", n, f"line {n}") for n in range(1, 131)], "repo_full_name string, path string, line_no int, text string")
    symbols = spark.createDataFrame([("r", "a.go", "F", 1, 70), ("r", "a.go", "G", 71, 130), ("r", "a.go", "G2", 71, 130)],
                                    "repo_full_name string, path string, name string, start_line int, end_line int")
    f = spark.createDataFrame([("two", "r", "a.go", 63, 65, "t1"), ("none", "r", "a.go", None, None, "t2"), ("open", "r", "a.go", 3, None, "t3"),
                               ("else", "r", "b.go", 1, 2, "t4"), ("both", "r", "a.go", 100, 100, "t5"), ("0", "r", "a.go", 5, 5, "t6"), ("0", "r", "a.go", 128, 129, "t7")],
                              "finding_key string, repo_full_name string, file_path string, start_line int, end_line int, title string")
    got = sorted((r.finding_key, r.title, r.region or "", r.symbol or "") for r in _located(f, lines, symbols).collect())
    same = "line 5\nline 128\nline 129"  # findings without a key of their own share what belongs to it, as they always did
    assert got == sorted([
        ("two", "t1", "line 63\nline 64\nline 65", "F"), ("none", "t2", "", ""), ("open", "t3", "", "F"), ("else", "t4", "", ""),
        ("both", "t5", "line 100", "G"), ("both", "t5", "line 100", "G2"),
        *[("0", t, same, x) for t in ("t6", "t7") for x in ("F", "G", "G2")]])


def test_answers_of_line_items_without_number_or_supplier(spark, tmp_path):
    rows = [(4, 2, 3, None, 5.0, 0.05), (4, 2, None, 1, 5.0, 0.05)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    raw = {r.task_id: r.raw for r in synth.model_answers(spark, str(tmp_path)).collect()}
    assert '"severity":"info"' in raw[None]  # and no title without a supplier, so no finding
    assert raw[41] == '{"findings":[]}'


def test_review_run_plans_its_triage_once(spark, sf_dir):
    plan = _physical(QUERIES["review_run"](spark, sf_dir))
    assert "Window" not in plan and "BroadcastHashJoin [finding_id]" not in plan and len(plan) < 20_000
