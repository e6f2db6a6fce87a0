"""What travels between tasks: rows per symbol instead of per task, packed hashes, no text or whole row that isn't needed."""
import glob

from pyspark.sql import functions as F

from revlens.functions.hashing import normalise_code, packed, unpacked
from revlens.operators.joins import skip_unchanged
from revlens.operators.maintenance import one_per_id
from revlens.operators.sequences import addressed_in_next_commit
from revlens.operators.versions import not_reviewed_yet
from revlens.plans.triage import triage
from revlens.registry import QUERIES, _index
from revlens.sources.views import views


def _nodes(plan, kind):
    children = plan.children()
    own = [plan] if plan.nodeName() == kind else []
    return own + [n for i in range(children.size()) for n in _nodes(children.apply(i), kind)]


def _outputs(df, kind):
    return [n.output().toString() for n in _nodes(df._jdf.queryExecution().optimizedPlan(), kind)]


def test_tasks_are_made_after_the_joins_of_slices(spark, sf_dir):  # F1, F2, F7, F9
    joins = _outputs(QUERIES["slice_allocations"](spark, sf_dir), "Join")
    assert joins and not any("task_id" in j or "task_type#" in j for j in joins) and any("task_types" in j for j in joins)


def test_changes_know_their_tests_and_hunks_are_not_kept(spark, sf_dir):  # F20
    ix = _index(spark, sf_dir)
    assert "has_tests" in ix.changed.columns and not ix.hunks.storageLevel.useMemory


def test_heads_tasks_are_dealt_out_before_their_types(spark):  # F3-F6
    h = "ab" * 32
    rows = [(head, 7, "r", "a.go", "F", 1, 0.5, h, types) for head, types in ((1, ["logic", "style"]), (2, ["logic", "style"]), (3, ["style"]))]
    c = spark.createDataFrame(rows, "pull_request_id long, external_pr_id long, repo_full_name string, path string, symbol string, start_line int, "
                                    "risk_score double, content_hash string, task_types array<string>").withColumn("content_hash", packed("content_hash"))
    done = spark.createDataFrame([(1, "a.go", "completed"), (2, "a.go", "failed")], "pull_request_id long, path string, status string")
    out = not_reviewed_yet(c, done)
    assert sorted((r.pull_request_id, r.task_type, r.reviewed_head) for r in out.collect()) == [
        (1, "logic", None), (1, "style", None), (2, "logic", 1), (2, "style", 1), (3, "style", 1)]
    assert {r.content_hash for r in out.collect()} == {h}
    (made,) = _nodes(out._jdf.queryExecution().optimizedPlan(), "Generate")
    assert _nodes(made, "RepartitionByExpression") and _nodes(made, "Join")


def test_blanks_of_code_collapse_as_before(spark):
    texts = ["a b", "  a\t\tb \n\n c ", "\t", "", "a\tb", "\n\na \tb\r\nc\x0bd\x0ce  ", " a   b", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert d.filter(~normalise_code("t").eqNullSafe(F.trim(F.regexp_replace("t", r"\s+", " ")))).count() == 0


def test_packed_keys_give_back_every_text(spark):
    texts = ["0f" * 32, "0f" * 16, "0f" * 32 + "\n", "0F" * 16, "0f" * 24, "", "n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("k"), unpacked(packed("t")).alias("u")).collect()
    assert all(r.t == r.u for r in got) and len({bytes(r.k) for r in got}) == len(texts) and [len(r.k) for r in got[:2]] == [33, 17]


def test_few_rules_leave_lines_where_they_are(spark, monkeypatch):  # F11
    from revlens.operators import rules as R
    rules = spark.createDataFrame([("a", "c", "low", "(?i)tok.n", ["TOKEN"]), ("b", "c", "low", r"\d\.\d", ["0.0"])],
                                  "rule_id string, category string, severity string, pattern string, fragments array<string>")
    lines = spark.createDataFrame([(1, "a Token 1.5"), (2, "1.x"), (3, None), (4, "9.9")], "no int, line string")
    few = R.scan_lines(lines, rules)
    want = sorted((r.no, r.rule_id) for r in few.collect())
    assert want == [(1, "a"), (1, "b"), (4, "b")] and "SortMergeJoin" not in few._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(R, "MOST_BYTES", 0)
    many = R.scan_lines(lines, rules)
    assert sorted((r.no, r.rule_id) for r in many.collect()) == want and not any("_plain" in j for j in _outputs(many, "Join"))


def test_hashes_of_unchanged_findings_travel_packed(spark):  # F12
    f = spark.createDataFrame([("1", 1, 10, "l", "c"), ("2", 2, 20, "l", "c"), ("3", 2, 20, None, "c"), ("4", 2, 20, "l", None), ("5", 2, 21, "l", "d")],
                              "id string, pull_request_id long, review_task_id long, location_hash string, content_hash string")
    f = f.unionAll(f.filter("id in ('3', '4')").withColumns({"id": F.concat("id", F.lit("x")), "pull_request_id": F.lit(1).cast("long"), "review_task_id": F.lit(10).cast("long")}))
    tasks = spark.createDataFrame([(10, "completed"), (20, "failed")], "id long, status string")
    prs = spark.createDataFrame([(1, 7, "2024-01-01"), (2, 7, "2024-01-02")], "id long, external_pr_id long, created_at string")
    out = skip_unchanged(f, tasks, f, prs)
    assert out.columns == f.columns and sorted(r.id for r in out.collect()) == ["1", "3", "3x", "4", "4x", "5"]
    assert {r.location_hash for r in out.collect()} == {"l", None}
    joins = _outputs(out, "Join")
    assert joins and not any(" location_hash#" in j or "[location_hash#" in j for j in joins)


def test_next_heads_findings_travel_once(spark):  # F17, F19
    f = spark.createDataFrame([("gone", 1, "l1", "c"), ("same", 1, "l2", "c"), ("else", 1, "l3", "c"), ("null", 1, "l3", None), ("nowhere", 1, None, "c"),
                               ("x", 2, "l2", "c"), ("x2", 2, "l2", None), ("y", 2, "l3", "d"), ("z", 2, "l3", None), ("w", 2, None, "c")],
                              "id string, pull_request_id long, location_hash string, content_hash string")
    prs = spark.createDataFrame([(1, 7, "2024-01-01"), (2, 7, "2024-02-02")], "id long, external_pr_id long, created_at string") \
        .withColumn("created_at", F.to_timestamp("created_at"))
    out = addressed_in_next_commit(f, prs)
    assert sorted((r.id, r.addressed_status, r.location_hash) for r in out.collect()) == [
        ("else", "likely_addressed", "l3"), ("gone", "addressed", "l1"), ("nowhere", "addressed", None), ("null", "likely_addressed", "l3"),
        ("same", "unaddressed", "l2")]
    assert not any("content_hash#" in j for j in _outputs(out, "Join"))


def test_one_row_per_id_is_the_least_whole_row(spark):  # F18
    rows = [("a", 2, "x", 1), ("a", 1, "z", 2), ("a", 1, "y", 3), ("b", 5, None, 4), (None, 2, "n", 5), (None, 1, "m", 6)]
    got = one_per_id(spark.createDataFrame(rows, "id string, first int, text string, n int"), ("n", "text"))
    assert sorted((r.id or "", r.n, r.text) for r in got.collect()) == [("", 6, "m"), ("a", 3, "y"), ("b", 4, None)]


def test_triage_takes_no_prior_id_or_score_along_unless_wanted(spark, sf_dir):  # F8, F13, F14, F15
    v = views(spark, sf_dir)
    some = triage(v.findings, v.pipeline_runs, v.dismissed_fingerprints, columns=("id", "decision"))
    assert not any("confidence_score" in j or "prior_id" in j for j in _outputs(some, "Join"))
    whole = triage(v.findings, v.pipeline_runs, v.dismissed_fingerprints)
    assert not any("old_tier" in j for j in _outputs(whole, "Join"))
    both = ("id", "decision", "confidence_score", "confidence_tier", "dup_kind")
    wanted = triage(v.findings, v.pipeline_runs, v.dismissed_fingerprints, columns=both)
    assert whole.select(*both).exceptAll(wanted).count() == 0 and wanted.exceptAll(whole.select(*both)).count() == 0


def test_tables_are_written_small(spark, tmp_path):  # F8
    from revlens.sources.sinks import write_table
    write_table(spark.range(3), str(tmp_path / "t"))
    assert glob.glob(f"{tmp_path}/t/*.zstd.parquet")
