"""What travels: shuffles carry the columns wanted, once."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.functions.hashing import packed, unpacked
from revlens.operators import maintenance as M
from revlens.plans import triage as T
from revlens.plans.summary import summary_comment

DAY = dt.datetime(2024, 1, 1)
FINDING = ("id string, pipeline_run_id long, pull_request_id long, review_task_id long, repo_full_name string, location_hash string, "
           "content_hash string, created_at timestamp, confidence_score double, confidence_tier string, severity string, category string, "
           "file_path string, start_line int, symbol string, used_semantic_context boolean, title string, body string, suppression_reason string")


def _finding(i, run, loc, content="c", score=0.9, tier="high", severity="low", repo="org/r"):
    return (i, run, run, run, repo, loc, content, DAY, score, tier, severity, "style", "a.go", 3, "F", False, f"title {i}", f"body {i}", None)


def _findings(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def _runs(spark, starts):
    return spark.createDataFrame([(k, t) for k, t in starts.items()], "id long, started_at timestamp")


def _dismissed(spark, rows=()):
    return spark.createDataFrame(list(rows), "fingerprint string, repo_full_name string")


def _plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)()


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _dealt_out(df):
    """Shuffles asked for by repartition: those made, and those that read another one's rows."""
    lines = [x for x in _plan(df).toString().splitlines() if "REPARTITION_BY_COL" in x]
    again = [x for x in lines if "ReusedExchange" in x]
    return len(lines) - len(again), len(again)


@pytest.fixture
def planned(spark):
    """Plans as they would be for tables too large to broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_packed_keys_come_back(spark):
    texts = [None, "", "n", "h1", "t", "ab" * 32, "AB" * 32, "g" * 64, "\u00e4" * 32, "0" * 64]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("k")).withColumn("u", unpacked("k")).collect()
    assert [r.u for r in rows] == texts
    assert len({bytes(r.k) for r in rows}) == len(texts)
    assert max(len(r.k) for r in rows if r.t == "ab" * 32) == 33


def test_triage_sends_its_findings_once_to_their_locations(planned):
    f = _findings(planned, [_finding("a", 1, "x"), _finding("b", 2, "x")])
    t = T.triage(f, _runs(planned, {1: DAY, 2: DAY}), _dismissed(planned), columns=["id", "decision", "prior_id"])
    assert _dealt_out(t) == (1, 1)
    sent = [n for n in _nodes(_plan(t, "optimizedPlan")) if n.nodeName() == "RepartitionByExpression"]
    assert sent and not any("title" in n.output().toString() for n in sent)


def test_cross_run_duplicates_share_one_shuffle(planned):
    f = _findings(planned, [_finding("a", 1, "x"), _finding("b", 2, "x")])
    w = T.with_run_start(T.within_run_dedup(f), _runs(planned, {1: DAY, 2: DAY})) \
        .select("id", "pipeline_run_id", "location_hash", "content_hash", "is_winner", "run_started_at")
    assert _dealt_out(T.cross_run_duplicates(w)) == (2, 1)  # by run; by location, read twice


def test_triage_of_null_keys_and_starts(spark):
    h = "ab" * 32
    later = DAY + dt.timedelta(days=3)
    f = _findings(spark, [
        _finding("a", 1, h), _finding("b", 2, h), _finding("c", 3, h, "d"), _finding("n1", 1, None), _finding("n2", 2, None),
        _finding("o", 9, h), _finding("x", 2, "plain"), _finding("y", 9, "plain", repo="org/other"), _finding("l", 1, h, score=0.2, tier="low")])
    t = T.triage(f, _runs(spark, {1: DAY, 2: later, 3: later + dt.timedelta(days=1)}),
                 _dismissed(spark, [("plain", "org/r"), ("plain", None), (None, "org/r")]),
                 columns=["id", "decision", "suppression_reason", "dup_kind", "prior_id", "location_hash"])
    got = {r.id: tuple(r)[1:5] for r in t.collect()}
    dup = ("suppress", "duplicate")
    assert got == {
        "o": ("inline", None, None, None), "a": (*dup, "prior_run", "o"), "l": (*dup, "within_run", None), "b": (*dup, "prior_run", "a"),
        "c": ("inline", None, None, "b"), "n1": ("inline", None, None, None), "n2": ("inline", None, None, None),
        "x": ("suppress", "dismissed_fingerprint", None, "y"), "y": ("inline", None, None, None)}
    assert {r.id: r.location_hash for r in t.collect()} == {r.id: r.location_hash for r in f.collect()}


def test_texts_of_rows_that_are_not_shown_stay_behind(spark):
    f = _findings(spark, [_finding("a", 1, "x"), _finding("m", 1, "y", score=0.6, tier="medium"), _finding("l", 1, "z", score=0.1, tier="low"),
                          _finding("e", 1, "w", score=0.1, tier="low", severity="critical")])
    t = T.triage(f, _runs(spark, {1: DAY}), _dismissed(spark), columns=["id", "decision", "title"], texts=["title"], shown=["inline"])
    rows = {r.id: (r.decision, r.title) for r in t.collect()}
    assert all((title is not None) for decision, title in rows.values() if decision == "inline") and rows["a"] == ("inline", "title a")
    assert rows["m"] == ("summary", None) and rows["l"] == ("suppress", None)


def test_validate_joins_only_what_the_joins_need(planned):
    f = _findings(planned, [_finding("a", 1, "x"), _finding("b", 2, None, score=1.5, severity="blocker")])
    one = planned.createDataFrame([(1,)], "id long")
    bad = M.validate(f, "findings", {t: one for t in ("review_tasks", "pull_requests", "pipeline_runs")}).select("id", "reasons")
    joins = [n for n in _nodes(_plan(bad, "optimizedPlan")) if n.nodeName() == "Join"]
    assert len(joins) == 3 and not any("title" in j.left().output().toString() for j in joins)
    assert [tuple(r) for r in bad.collect()] == [
        ("b", "location_hash_null,bad_severity,score_out_of_range,missing_review_task_id,missing_pull_request_id,missing_pipeline_run_id")]


def test_hunks_alone_are_not_kept(spark, sf_dir):
    from revlens.registry import QUERIES
    spark.catalog.clearCache()
    assert "InMemoryRelation" not in _plan(QUERIES["parse_hunks"](spark, sf_dir), "withCachedData").toString()


def test_summary_sends_no_task_twice(planned):
    f = _findings(planned, [_finding("a", 1, "x")]).withColumns({"decision": F.lit("inline"), "escalated": F.lit(False)})
    prs = planned.createDataFrame([(1, 7)], "id long, pr_number int")
    tasks = planned.createDataFrame([(1, 1, "a.go", "F", "completed", None), (2, 1, "a.go", "F", "failed", "late"), (3, 1, "a.go", None, "pending", None)],
                                    "id long, pull_request_id long, file_path string, symbol string, status string, error string")
    s = summary_comment(prs, f, tasks)
    assert "Expand" not in _plan(s).toString()
    body = s.first().body
    assert "1 of 2 symbols checked" in body and "Not checked because of an error: 1**\n* `a.go` F: late" in body


def test_region_eval_chooses_rows_once(spark, sf_dir):
    from revlens.registry import QUERIES
    df = QUERIES["region_eval"](spark, sf_dir)
    scans = [n for n in _nodes(_plan(df, "optimizedPlan")) if n.nodeName() == "LogicalRelation"]
    assert not any("l_orderkey" in n.output().toString() for n in scans)  # the result reads the rows chosen, not the source again
