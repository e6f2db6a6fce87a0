"""Store semantics as set operations (reference store cases)."""
import datetime as dt

from pyspark.sql import functions as F

from revlens.operators import maintenance as M
from revlens.operators import reads as R
from revlens.operators.joins import prior_finding

TS = dt.datetime(2024, 1, 1)
PR_SCHEMA = ("external_pr_id long, head_sha string, id long, repo_full_name string, pr_number int, "
             "base_sha string, author string, deleted_at timestamp, created_at timestamp, state string, "
             "metadata string, updated_at timestamp")


def test_upsert_updates_in_place_and_is_idempotent(spark):
    cur = spark.createDataFrame([(12345, "abc", 1, "org/r", 42, "def", "u", None, TS, "open", '{"source":"test"}', TS)],
                                PR_SCHEMA)
    inc = spark.createDataFrame([(12345, "abc", 99, "org/r", 42, "def", "u", None, TS + dt.timedelta(1), "merged",
                                  '{"source":"test"}', None)], PR_SCHEMA).withColumn(
        "received_at", F.lit(TS + dt.timedelta(2)).cast("timestamp")).drop("updated_at")
    once = M.upsert_pull_requests(cur, inc)
    r = once.first()
    assert (r.id, r.created_at, r.state, r.updated_at) == (1, TS, "merged", TS + dt.timedelta(2))
    twice = M.upsert_pull_requests(once, inc)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


FSCHEMA = ("id string, location_hash string, pull_request_id long, head_sha string, created_at timestamp, "
           "suppression_reason string, is_winner boolean")


def test_duplicate_finding_refused_but_within_run_loser_kept(spark):
    cur = spark.createDataFrame([("a", "h", 1, "s", TS, None, True)], FSCHEMA)
    new = spark.createDataFrame([("b", "h", 1, "s", TS, None, True), ("c", "h", 1, "s", TS, "duplicate", False),
                                 ("d", "h2", 1, "s", TS, None, True)], FSCHEMA)
    out = {r.id: r.outcome for r in M.append_findings(cur, new).collect()}
    assert out == {"b": "conflict", "c": "inserted", "d": "inserted"}


def test_prior_finding_same_repo_only(spark):
    f = spark.createDataFrame([("a", "h", "org/r", 1, "c", TS), ("b", "h", "org/r", 2, "c", TS + dt.timedelta(1))],
                              "id string, location_hash string, repo_full_name string, pull_request_id long, "
                              "content_hash string, created_at timestamp")
    look = spark.createDataFrame([("h", "org/r"), ("h", "org/other")], "location_hash string, repo_full_name string")
    got = {r.repo_full_name: r.id for r in prior_finding(f, look).collect()}
    assert got == {"org/r": "b", "org/other": None}


def test_unaddressed_unposted_walk(spark):
    f = spark.createDataFrame([("a", 1, None, None, False, 0.9, TS)],
                              "id string, pull_request_id long, posted_at timestamp, suppression_reason string, "
                              "addressed_in_next_commit boolean, confidence_score double, created_at timestamp") \
        .withColumn("external_comment_id", F.lit(None).cast("long"))
    assert R.unposted_findings(f).count() == 1 and R.unaddressed_findings(f).count() == 0
    rec = spark.createDataFrame([("a", 777, TS)], "id string, external_comment_id long, posted_at timestamp")
    f2 = M.mark_posted(f, rec)
    assert R.unposted_findings(f2).count() == 0 and R.unaddressed_findings(f2).count() == 1
    f3 = M.mark_addressed(f2, spark.createDataFrame([("a",)], "id string"))
    assert R.unaddressed_findings(f3).count() == 0
    assert f3.first().addressed_status == "likely_addressed"


def test_dismissal_upsert_keeps_created_and_takes_newest_actor(spark):
    s = "fingerprint string, repo_full_name string, dismissed_by string, reason string, created_at timestamp"
    cur = spark.createDataFrame([("h", "org/r", "alice", "noise", TS)], s)
    new = spark.createDataFrame([("h", "org/r", "bob", "still noise", TS + dt.timedelta(3)),
                                 ("h", "org/other", "bob", "x", TS)], s)
    out = {r.repo_full_name: r for r in M.dismiss(cur, new).collect()}
    assert (out["org/r"].dismissed_by, out["org/r"].created_at) == ("bob", TS)
    assert len(out) == 2


def test_reaction_unique_per_finding_type_actor(spark):
    s = "id long, finding_id string, event_type string, actor string, created_at timestamp"
    cur = spark.createDataFrame([(1, "f", "thumbs_up", "u", TS)], s)
    new = spark.createDataFrame([(2, "f", "thumbs_up", "u", TS), (3, "f", "thumbs_down", "u", TS),
                                 (4, "f", "thumbs_down", "u", TS), (5, "f", "posted", "sys", TS),
                                 (6, "f", "posted", "sys", TS)], s)
    kept = sorted(r.id for r in M.append_events(cur, new).collect())
    assert kept == [3, 5, 6]


def test_reconcile_stale_runs(spark):
    runs = spark.createDataFrame([(1, "running", None, TS, None, TS), (2, "completed", None, TS, TS, TS)],
                                 "id long, status string, error string, started_at timestamp, "
                                 "completed_at timestamp, updated_at timestamp")
    out = M.reconcile_stale_runs(runs, F.lit(TS + dt.timedelta(1)).cast("timestamp"))
    got = {r.id: r for r in out.collect()}
    assert got[1].status == "failed" and "reconciled" in got[1].error
    assert out.filter("reconciled").count() == 1 and got[2].status == "completed"
