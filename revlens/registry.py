"""Wiring of every inventory key to the driver data.

Each entry takes (spark, sf_dir) and returns a DataFrame computed over whole
tables.  Inputs an operator needs besides the stored tables (a batch of
changes, a set of lookup keys) are derived by Spark from the same tables by
the documented rule next to each entry, so their size grows with the data.
Oracle SQL for the same keys lives in ``revlens.checks.oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import scoring as S
from .functions.hashing import hmac_sha256_hex, location_hash, signature_ok
from .operators import joins as J
from .operators import maintenance as M
from .operators import metrics as D
from .operators import reads as R
from .operators import sequences as Q
from .operators.windows import keyed_position
from .plans import triage as T
from .sources.tables import grows
from .sources.views import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def entry(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def _triaged(v, *columns, **texts):
    """J1 with the columns wanted; all when none is named."""
    return T.triage(v.findings, v.pipeline_runs, v.dismissed_fingerprints, columns=columns or None, **texts)


#: What priority order, event log and summary comment read of triaged findings.
ORDERED = ("id", "pull_request_id", "decision", "escalated", "severity", "confidence_score")
LOGGED = ("id", "decision", "suppression_reason", "created_at")
SUMMARISED = ("id", "pull_request_id", "suppression_reason", "decision", "escalated", "severity", "confidence_score", "confidence_tier",
              "file_path", "start_line", "category", "title")


# --------------------------------------------------------------------- 2.A
@entry("load_tables")
def q_load_tables(spark, d):
    """A1: the fact table with its declared columns."""
    return views(spark, d).findings


def _incoming_prs(v):
    return _incoming_of(v.pull_requests)


def _incoming_of(p):
    """A4 batch: every closed PR head is re-sent as merged two days later, and
    every third order opens a new head of its PR three days later."""
    resent = p.filter(F.col("state") == "closed").select(
        *M.PR_KEY, *M.PR_FIRST, F.lit("merged").alias("state"),
        F.lit('{"resent":true}').alias("metadata"),
        (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("received_at"))
    new = p.filter(F.col("id") % 3 == 2).select(
        "external_pr_id", F.md5(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("head_sha"),
        (F.col("id") + F.lit(1000000000)).alias("id"), "repo_full_name", "pr_number", "base_sha", "author",
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        (F.col("created_at") + F.expr("INTERVAL 3 DAYS")).alias("created_at"),
        F.lit("open").alias("state"), F.lit("{}").alias("metadata"),
        (F.col("created_at") + F.expr("INTERVAL 3 DAYS")).alias("received_at"))
    return resent.unionByName(new)


@entry("upsert_pull_requests")
def q_upsert(spark, d):
    v = views(spark, d)
    return M.upsert_pull_requests(v.pull_requests, _incoming_prs(v))


def _payloads(v):
    return payloads_of(v.pull_requests)


def payloads_of(p, extra: tuple = ()):
    """A2/A3 input: one webhook delivery per PR head.  First head of a PR is
    'opened', later heads 'synchronize', closed PRs send 'closed'; every 11th
    delivery is a check_suite event, every 13th lacks the repository, every
    7th is signed with a wrong key."""
    action = F.when(F.col("state") == "closed", "closed") \
        .when(F.col("id") % 3 == 0, "opened").otherwise("synchronize")
    repo = F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(
        F.struct(F.col("repo_full_name").alias("full_name")))
    payload = F.to_json(F.struct(
        action.alias("action"),
        F.struct(F.col("external_pr_id").alias("id"), F.col("pr_number").alias("number"),
                 F.col("state"), F.struct(F.col("head_sha").alias("sha")).alias("head"),
                 F.struct(F.col("base_sha").alias("sha")).alias("base"),
                 F.struct(F.col("author").alias("login")).alias("user")).alias("pull_request"),
        repo.alias("repository")))
    ev_type = F.when(F.col("id") % 11 == 0, "check_suite").otherwise("pull_request")
    return p.select(F.col("id").alias("delivery_id"), ev_type.alias("event_type"),
                    payload.alias("payload"), (F.col("id") % 7 == 0).alias("_wrong_key"), *extra)


WEBHOOK_KEY = "test-secret"


@entry("ingest_pr_events")
def q_ingest(spark, d):
    from .sources.ingest import ingest_pr_events
    raw = _payloads(views(spark, d))
    return ingest_pr_events(raw, DEFAULT.accepted_actions)


@entry("verify_signature")
def q_verify(spark, d):
    raw = _payloads(views(spark, d))
    sig = F.concat(F.lit("sha256="), F.when(F.col("_wrong_key"), hmac_sha256_hex("payload", "wrong-secret"))
                   .otherwise(hmac_sha256_hex("payload", WEBHOOK_KEY)))
    return raw.withColumn("signature", sig).select(
        "delivery_id", signature_ok("payload", "signature", WEBHOOK_KEY).alias("signature_ok"))


@entry("append_pipeline_runs")
def q_append_runs(spark, d):
    """A5 batch: a new run request per PR head two days after it opened; every
    5th head sends the request twice."""
    v = views(spark, d)
    p = v.pull_requests
    n = p.select(F.col("id").alias("pull_request_id"), "head_sha",
                 F.explode(F.array_compact(F.array(F.lit(1), F.when(F.col("id") % 5 == 0, F.lit(2))))).alias("k"),
                 (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("created_at"))
    n = n.select((F.col("pull_request_id") * 10 + F.col("k")).alias("id"), "pull_request_id", "head_sha",
                 F.lit(None).cast("string").alias("status"), "created_at")
    return M.append_runs(v.pipeline_runs, n).select("id", "pull_request_id", "status", "outcome")


@entry("append_review_tasks")
def q_append_tasks(spark, d):
    """A6 batch: the stored tasks re-sent without status, file-level ones with ''."""
    t = views(spark, d).review_tasks
    n = t.select("id", "pull_request_id", "task_type", "file_path",
                 F.coalesce("symbol", F.lit("")).alias("symbol"), F.lit("").alias("diff_hunk"),
                 F.lit(None).cast("string").alias("status"))
    return M.append_tasks(n)


@entry("append_findings")
def q_append_findings(spark, d):
    """The posted findings are stored; the whole findings batch arrives."""
    v = views(spark, d)
    cur = v.findings.filter(F.col("posted_at").isNotNull())
    new = T.within_run_dedup(v.findings)
    return M.append_findings(cur, new).select("id", "outcome")


@entry("append_finding_events")
def q_append_events(spark, d):
    """Events before Jan 15 are stored; events from Jan 8 on are (re)delivered."""
    e = views(spark, d).finding_events
    cur = e.filter(F.col("created_at") < F.lit("2024-01-15").cast("timestamp_ntz"))
    new = e.filter(F.col("created_at") >= F.lit("2024-01-08").cast("timestamp_ntz"))
    return M.append_events(cur, new).select("id", "finding_id", "event_type", "actor")


@entry("dismiss_fingerprints")
def q_dismiss(spark, d):
    """Every thumbs_down dismisses the finding's fingerprint for its repo."""
    v = views(spark, d)
    f = v.findings.select(F.col("id").alias("finding_id"), "location_hash", "repo_full_name")
    new = (v.finding_events.filter(F.col("event_type") == "thumbs_down").join(f, "finding_id")
           .select(F.col("location_hash").alias("fingerprint"), "repo_full_name",
                   F.col("actor").alias("dismissed_by"), F.lit("thumbs_down").alias("reason"),
                   "created_at"))
    return M.dismiss(v.dismissed_fingerprints, new)


def _arriving(v) -> dict:
    """The review tables as a careless writer would send them: some rows break a constraint."""
    def broken(df, key, **rules):
        return df.withColumns({c: F.when(F.col(key) % n == 0, F.lit(value)).otherwise(F.col(c))
                               for c, (n, value) in rules.items()})
    return {
        "pull_requests": broken(v.pull_requests, "id", state=(101, "draft"), author=(103, None)),
        "pipeline_runs": broken(v.pipeline_runs, "id", status=(101, "paused"), prompt_version=(103, None),
                                pull_request_id=(107, -1)),
        "review_tasks": broken(v.review_tasks, "id", task_type=(101, "other"), model_id=(103, None),
                               pipeline_run_id=(107, -1)),
        "findings": broken(v.findings, "pull_request_id", severity=(101, "blocker"), title=(103, None),
                           confidence_score=(107, 1.5), review_task_id=(109, -1), pipeline_run_id=(113, -1)),
        "finding_events": broken(v.finding_events, "id", finding_id=(101, "none"), actor=(103, None)),
    }


@entry("validate_rows")
def q_validate(spark, d):
    """A10: refused rows with their reasons."""
    v = views(spark, d)
    tables, u = _arriving(v), None
    for name, df in tables.items():
        r = M.validate(df, name, {t: getattr(v, t) for t in tables}).select(
            F.lit(name).alias("tbl"), F.col("id").cast("string").alias("id"), "reasons")
        u = r if u is None else u.unionByName(r)
    return u


@entry("metadata_merge")
def q_meta(spark, d):
    """Failed runs, whose metadata also holds nested values here, get their error merged in."""
    r = views(spark, d).pipeline_runs.filter(F.col("status") == "failed")
    nested = F.concat(F.regexp_replace("metadata", r"\}$", ""), F.lit(',"slice":{"diff":'), F.col("id").cast("string"),
                      F.lit(',"on":true},"n":5,"note":null,"failure_reason":"none"}'))
    m = M.merge_meta(r.withColumn("metadata", nested), {"failure_reason": F.col("error")})
    return m.select("id", "metadata")


@entry("events_without_finding")
def q_event_rejects(spark, d):
    """Events that belong to no finding: the rows ``finding_events`` can't hold."""
    from .sources.views import events_without_finding
    return events_without_finding(spark, d, views(spark, d).findings)


@entry("comment_outbox")
def q_outbox(spark, d):
    from .sources.sinks import comment_outbox
    v = views(spark, d)
    t = _triaged(v, "id", "decision", "pull_request_id", "repo_full_name", "location_hash", "file_path", "start_line", "severity",
                 "category", "confidence_tier", "title", "body", "suggestion",
                 texts=("pull_request_id", "repo_full_name", "file_path", "start_line", "severity", "category", "title", "body", "suggestion"),
                 shown=("inline",))
    return comment_outbox(t, v.findings, v.pull_requests)


@entry("purge_prs")
def q_purge(spark, d):
    """Soft-deleted PRs are purged; remaining rows per table."""
    v = views(spark, d)
    tables = {"finding_events": v.finding_events, "findings": v.findings, "review_tasks": v.review_tasks,
              "pipeline_runs": v.pipeline_runs, "pull_requests": v.pull_requests}
    ids = v.pull_requests.filter(F.col("deleted_at").isNotNull()).select("id")
    out = M.purge(tables, ids)
    u = None
    for name, df in out.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        u = c if u is None else u.unionByName(c)
    return u


# --------------------------------------------------------------------- 2.B
@entry("get_pull_request")
def q_get_pr(spark, d):
    v = views(spark, d)
    ids = v.findings.filter(F.col("posted_at").isNotNull()).select(F.col("pull_request_id").alias("id"))
    return R.get_pull_requests(v.pull_requests, ids).select("id", "external_pr_id", "state", "deleted_at")


@entry("active_pull_requests")
def q_active(spark, d):
    return R.active_pull_requests(views(spark, d).pull_requests).select("id", "repo_full_name", "pr_number")


@entry("get_pipeline_run")
def q_get_run(spark, d):
    v = views(spark, d)
    ids = v.review_tasks.filter(F.col("status") == "failed").select(F.col("pipeline_run_id").alias("id"))
    return R.get_runs(v.pipeline_runs, ids).select("id", "status", "prompt_version", "config_hash")


@entry("pending_tasks")
def q_pending(spark, d):
    return R.pending_tasks(views(spark, d).review_tasks).select("id", "risk_score", "task_type")


@entry("unaddressed_findings")
def q_unaddressed(spark, d):
    return R.unaddressed_findings(views(spark, d).findings).select("id", "pull_request_id", "created_at")


@entry("unposted_findings")
def q_unposted(spark, d):
    return R.unposted_findings(views(spark, d).findings).select("id", "pull_request_id", "confidence_score")


@entry("findings_for_pr")
def q_findings_for_pr(spark, d):
    v = views(spark, d)
    keys = v.pull_requests.filter(F.col("state") == "open").select(F.col("id").alias("pull_request_id"))
    return R.findings_for(keys, v.findings).select("id", "pull_request_id", "confidence_score", "severity")


@entry("findings_for_run")
def q_findings_for_run(spark, d):
    v = views(spark, d)
    keys = v.pipeline_runs.filter(F.col("status") == "failed").select(F.col("id").alias("pipeline_run_id"))
    return R.findings_for(keys, v.findings, "pipeline_run_id").select("id", "pipeline_run_id", "severity")


@entry("tasks_for_pr")
def q_tasks_for_pr(spark, d):
    v = views(spark, d)
    keys = v.pull_requests.filter(F.col("state") == "merged").select(F.col("id").alias("pull_request_id"))
    return R.tasks_for(keys, v.review_tasks).select("id", "pull_request_id", "status")


@entry("tasks_for_run")
def q_tasks_for_run(spark, d):
    v = views(spark, d)
    keys = v.pipeline_runs.filter(F.col("status") == "running").select(F.col("id").alias("pipeline_run_id"))
    return R.tasks_for(keys, v.review_tasks, "pipeline_run_id").select("id", "pipeline_run_id", "status")


@entry("events_for_finding")
def q_events_for(spark, d):
    v = views(spark, d)
    keys = v.findings.join(v.pull_requests.filter(F.col("state") == "open")
                           .select(F.col("id").alias("pull_request_id")), "pull_request_id", "left_semi") \
        .select(F.col("id").alias("finding_id"))
    return R.events_for(keys, v.finding_events).select("id", "finding_id", "event_type", "created_at")


@entry("runs_for_pr")
def q_runs_for(spark, d):
    v = views(spark, d)
    keys = v.pull_requests.filter(F.col("state") == "closed").select(F.col("id").alias("pull_request_id"))
    return R.runs_for(keys, v.pipeline_runs).select("id", "pull_request_id", "created_at")


@entry("suppressed_findings")
def q_suppressed(spark, d):
    t = _triaged(views(spark, d), "id", "pull_request_id", "suppression_reason")
    return R.suppressed_findings(t).select("id", "pull_request_id", "suppression_reason")


@entry("reaction_poll_set")
def q_poll(spark, d):
    f = views(spark, d).findings
    return R.reaction_poll_set(f, D.newest(f, "posted_at")).select("id", "external_comment_id", "posted_at")


@entry("soft_delete_prs")
def q_soft_delete(spark, d):
    """Delete request for every closed PR, stamped at the newest PR time."""
    p = views(spark, d).pull_requests
    ids = p.filter(F.col("state") == "closed").select("id")
    out = M.soft_delete(p, ids, D.newest(p))
    return out.select("id", "deleted_at", "updated_at", "outcome")


@entry("update_task_status")
def q_update_tasks(spark, d):
    """B15 batch: pending -> running, running -> completed, failed -> failed
    (retry exhausted), two hours after creation."""
    t = views(spark, d).review_tasks
    ch = t.filter(F.col("status") != "completed").select(
        "id",
        F.when(F.col("status") == "pending", "running").when(F.col("status") == "running", "completed")
        .otherwise("failed").alias("new_status"),
        F.when(F.col("status") == "failed", F.lit("retry exhausted")).alias("new_error"),
        (F.col("created_at") + F.expr("INTERVAL 2 HOURS")).alias("changed_at"))
    return M.update_task_status(t, ch).select("id", "status", "error", "started_at", "completed_at")


@entry("complete_runs")
def q_complete_runs(spark, d):
    """Running runs complete with the counters of D9, one day after start."""
    v = views(spark, d)
    st = D.run_stats(v.pipeline_runs, v.review_tasks, v.findings)
    res = v.pipeline_runs.drop("task_count", "finding_count").filter(F.col("status") == "running").join(
        st.select("id", "task_count", "finding_count"), "id").select(
        "id", F.lit("completed").alias("status"), "task_count", "finding_count",
        F.lit(None).cast("string").alias("error"),
        (F.col("started_at") + F.expr("INTERVAL 1 DAYS")).alias("completed_at"))
    return M.complete_runs(v.pipeline_runs.drop("task_count", "finding_count")
                           .withColumn("task_count", F.lit(0)).withColumn("finding_count", F.lit(0)), res) \
        .select("id", "status", "task_count", "finding_count", "completed_at")


@entry("reconcile_stale_runs")
def q_reconcile(spark, d):
    r = views(spark, d).pipeline_runs
    return M.reconcile_stale_runs(r, D.newest(r, "started_at"), DEFAULT.stale_after_hours) \
        .select("id", "status", "error", "completed_at", "reconciled")


@entry("mark_posted")
def q_mark_posted(spark, d):
    """Receipts for every inline finding, a day after it was created."""
    v = views(spark, d)
    t = _triaged(v, "id", "decision", "review_task_id", "created_at").filter(F.col("decision") == "inline")
    rec = t.select("id", (F.col("review_task_id") * 10 + 1).alias("external_comment_id"),
                   (F.col("created_at") + F.expr("INTERVAL 1 DAYS")).alias("posted_at"))
    return M.mark_posted(v.findings, rec).select("id", "posted_at", "external_comment_id")


@entry("mark_addressed")
def q_mark_addressed(spark, d):
    v = views(spark, d)
    ids = Q.addressed_in_next_commit(v.findings, v.pull_requests) \
        .filter(F.col("addressed_status") == "addressed").select("id")
    return M.mark_addressed(v.findings, ids).select("id", "addressed_in_next_commit", "addressed_status")


# --------------------------------------------------------------------- 2.C
@entry("prior_finding")
def q_prior(spark, d):
    return J.prior_finding(views(spark, d).findings)


@entry("fingerprint_dismissed")
def q_fp_dismissed(spark, d):
    v = views(spark, d)
    return J.with_dismissed_flag(v.findings, v.dismissed_fingerprints).select("id", "dismissed")


@entry("not_dismissed")
def q_not_dismissed(spark, d):
    v = views(spark, d)
    return J.not_dismissed(v.findings, v.dismissed_fingerprints).select("id", "location_hash")


@entry("findings_per_pr_join")
def q_c4(spark, d):
    v = views(spark, d)
    return J.prs_with_findings(v.pull_requests, v.findings).select("id", "finding_id", "confidence_tier")


@entry("findings_events_join")
def q_c5(spark, d):
    v = views(spark, d)
    return J.findings_with_events(v.findings, v.finding_events).select(
        "finding_id", "event_id", "event_type", "category")


@entry("completed_task_fingerprints")
def q_c6(spark, d):
    v = views(spark, d)
    return J.skip_unchanged(v.findings, v.review_tasks, v.findings, v.pull_requests).select("id")


@entry("posting_retry_set")
def q_c9(spark, d):
    v = views(spark, d)
    return J.posting_retry_set(v.findings, v.pipeline_runs, D.newest(v.findings)).select("id", "created_at")


@entry("foreign_key_violations")
def q_c12(spark, d):
    """Rows of every child table whose parent is missing, for each of the seven keys."""
    v = views(spark, d)
    tables, u = _arriving(v), None
    for child, keys in M.FOREIGN_KEYS.items():
        for fk, parent in keys.items():
            r = M.foreign_key_violations(tables[child], getattr(v, parent), fk).select(
                F.lit(f"{child}.{fk}").alias("fk"), F.col("id").cast("string").alias("child_id"))
            u = r if u is None else u.unionByName(r)
    return u


# --------------------------------------------------------------------- 2.D
def _f_asof(v):
    return D.newest(v.findings)


@entry("false_positive_rate")
def q_d1(spark, d):
    v = views(spark, d)
    return D.false_positive_rate(v.findings, v.finding_events, D.newest(v.findings), DEFAULT.window_days)


@entry("task_success_rate")
def q_d2(spark, d):
    t = views(spark, d).review_tasks
    return D.task_success_rate(t, D.newest(t), DEFAULT.window_days)


@entry("findings_per_pr")
def q_d3(spark, d):
    v = views(spark, d)
    return D.findings_per_pr(v.pull_requests, v.findings, D.newest(v.pull_requests), DEFAULT.window_days)


@entry("tier_distribution")
def q_d4(spark, d):
    f = views(spark, d).findings
    return D.tier_distribution(f, D.newest(f), DEFAULT.window_days)


@entry("model_usage")
def q_d5(spark, d):
    f = views(spark, d).findings
    return D.model_usage(f, D.newest(f), DEFAULT.window_days)


@entry("addressed_status_counts")
def q_d6(spark, d):
    f = views(spark, d).findings
    return D.addressed_counts(f, D.newest(f), DEFAULT.window_days)


@entry("task_stats_per_run")
def q_d7(spark, d):
    return D.task_stats(views(spark, d).review_tasks)


@entry("reactions_per_finding")
def q_d8(spark, d):
    return D.reactions(views(spark, d).finding_events)


@entry("run_completion_stats")
def q_d9(spark, d):
    v = views(spark, d)
    t = _triaged(v, "id", "pipeline_run_id", "posted_at", "suppression_reason")
    return D.run_stats(v.pipeline_runs, v.review_tasks, t).drop("status")


@entry("severity_tally")
def q_d10(spark, d):
    return D.severity_tally(views(spark, d).findings)


@entry("review_coverage")
def q_d11(spark, d):
    return D.review_coverage(views(spark, d).review_tasks)


@entry("suppression_breakdown")
def q_d12(spark, d):
    return D.suppression_breakdown(_triaged(views(spark, d), "pull_request_id", "suppression_reason"))


@entry("replay_cohorts")
def q_d13(spark, d):
    v = views(spark, d)
    return D.replay_cohorts(v.pipeline_runs, v.findings, v.finding_events)


def _pr_sizes(v):
    """Changed lines and functions per PR head, from its findings' line spans."""
    return v.findings.groupBy("pull_request_id").agg(
        F.sum(F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(1))).alias("changed_lines"),
        F.count_distinct(F.nullif(F.col("symbol"), F.lit(""))).alias("changed_functions"))


@entry("latency_p95")
def q_d15(spark, d):
    """Run duration = last task completion - run start, by PR size class."""
    v = views(spark, d)
    last = v.review_tasks.groupBy(F.col("pipeline_run_id").alias("id")).agg(
        F.max("completed_at").alias("completed_at"))
    runs = v.pipeline_runs.select("id", "started_at").join(last, "id")
    return D.latency_p95(runs, _pr_sizes(v))


@entry("presumed_true_positives")
def q_d16(spark, d):
    v = views(spark, d)
    return D.presumed_true_positives(v.pull_requests, v.findings, v.finding_events)


@entry("dismissal_rate")
def q_d17(spark, d):
    v = views(spark, d)
    return D.dismissal_rate(v.findings, v.finding_events)


@entry("config_drift")
def q_d18(spark, d):
    return D.config_drift(views(spark, d).pipeline_runs)


# --------------------------------------------------------------------- 2.E
@entry("latest_pr_by_external_id")
def q_e1(spark, d):
    return Q.latest_pr(views(spark, d).pull_requests).select("external_pr_id", "id", "head_sha")


@entry("within_run_dedup")
def q_e2(spark, d):
    return T.within_run_dedup(views(spark, d).findings).select("id", "is_winner", "suppression_reason")


@entry("priority_order")
def q_e3(spark, d):
    return T.priority_order(_triaged(views(spark, d), *ORDERED)).select("id", "pull_request_id", "position")


@entry("cross_run_duplicates")
def q_e4(spark, d):
    v = views(spark, d)
    w = T.with_run_start(T.within_run_dedup(v.findings), v.pipeline_runs).select(
        "id", "pipeline_run_id", "pull_request_id", "location_hash", "content_hash", "is_winner", "run_started_at")
    return T.cross_run_duplicates(w).filter("is_winner").select("id", "prior_id", "is_prior_dup")


@entry("breaker_streaks")
def q_e5(spark, d):
    t = views(spark, d).review_tasks.withColumn("failed", F.col("status") == "failed")
    return Q.breaker_streaks(t)


@entry("lifecycle_state")
def q_e8(spark, d):
    e = views(spark, d).finding_events
    return Q.lifecycle(e, D.newest(e))


# --------------------------------------------------------------------- 2.F
@entry("severity_case_sort")
def q_f1(spark, d):
    f = views(spark, d).findings
    order = [F.col("confidence_score").desc(), R.severity_sort_key("severity"), F.col("id")]
    return keyed_position(f, ["pull_request_id"], order, [F.col("confidence_score")], [True]) \
        .select("id", "pull_request_id", "position")


@entry("risk_order")
def q_f2(spark, d):
    t = views(spark, d).review_tasks
    return keyed_position(t, ["pipeline_run_id"], [F.col("risk_score").desc(), F.col("id")],
                          [F.col("risk_score")], [True]).select("id", "pipeline_run_id", "position")


@entry("top1_lookup")
def q_f3(spark, d):
    from .operators.windows import latest_per_key
    return latest_per_key(views(spark, d).findings, ["pull_request_id"], ["created_at", "id"],
                          ["id", "created_at"])


@entry("inline_cap")
def q_f4(spark, d):
    """F4 exercised with the early-notes cap of 7 inline findings per PR."""
    t = T.priority_order(_triaged(views(spark, d), *ORDERED))
    capped = t.withColumn("decision", F.when(F.col("position") <= 7, "inline").otherwise("summary"))
    return capped.select("id", "pull_request_id", "decision")


@entry("high_risk_first")
def q_f5(spark, d):
    t = views(spark, d).review_tasks.withColumn("high_risk", F.col("risk_score") >= DEFAULT.high_risk)
    return keyed_position(t, ["pipeline_run_id"],
                          [F.col("high_risk").desc(), F.col("risk_score").desc(), F.col("id")],
                          [F.col("high_risk")], [True]).select("id", "pipeline_run_id", "high_risk", "position")


# --------------------------------------------------------------------- 2.G
@entry("triage_partition")
def q_g2(spark, d):
    return T.decision_counts(_triaged(views(spark, d), "decision", "suppression_reason", "dup_kind"))


@entry("addressed_in_next_commit")
def q_g3(spark, d):
    v = views(spark, d)
    return Q.addressed_in_next_commit(v.findings, v.pull_requests)


# --------------------------------------------------------------------- 2.H
@entry("location_hash")
def q_h1(spark, d):
    f = views(spark, d).findings
    return f.select("id", location_hash("repo_full_name", "file_path", "symbol", "category").alias("location_hash"))


@entry("token_budget")
def q_h3(spark, d):
    t = views(spark, d).review_tasks
    b = S.token_budget(S.model_budget("model_id"), F.col("task_type"),
                       S.language_of("file_path")["approximate"])
    return t.select("id", b.alias("b")).select(
        "id", "b.diff_hunk", "b.call_graph_raw", "b.call_graph", "b.tests",
        S.budget_total(F.col("b")).alias("total"))


@entry("model_budget")
def q_h5(spark, d):
    return views(spark, d).review_tasks.select("id", "model_id", S.model_budget("model_id").alias("budget"))


@entry("token_count")
def q_h6(spark, d):
    docs = views(spark, d).table("documents")
    return docs.select("doc_id", S.token_count("text").alias("tokens"))


@entry("path_risk")
def q_h7(spark, d):
    p = views(spark, d).table("pages")
    return p.select("page_id", S.path_risk("url").alias("path_risk"),
                    S.is_security_path("url").alias("security_path"),
                    S.is_infra_yaml("url").alias("infra_yaml"))


@entry("model_routing")
def q_h10(spark, d):
    return views(spark, d).review_tasks.select("id", "task_type", S.route_model("task_type").alias("model"))


@entry("tier_from_score")
def q_h14(spark, d):
    f = views(spark, d).findings
    pen = S.round_confidence(F.col("confidence_score") * DEFAULT.penalty_factor)
    return f.select("id", pen.alias("penalised_score"), S.tier_from_score(pen).alias("penalised_tier"),
                    S.tier_ok("confidence_tier", "confidence_score").alias("tier_ok"),
                    S.severity_rank("severity").alias("severity_rank"),
                    S.escalates("category", "severity").alias("escalates"),
                    S.language_of("file_path")["language"].alias("language"))


# --------------------------------------------------------------- text / planner
def _index(spark, d, persist=True):
    from .plans.planner import Index
    from .sources import synth
    return Index(synth.source_files(spark, d), synth.diffs(spark, d), persist=persist)


@entry("read_source_files")
def q_a13(spark, d):
    from .sources import synth
    return synth.source_files(spark, d)


@entry("read_model_responses")
def q_a14(spark, d):
    from .sources import synth
    return synth.model_answers(spark, d)


@entry("parse_hunks")
def q_h20(spark, d):
    return _index(spark, d, persist=False).hunks  # read once: kept blocks would only fill memory and disk


@entry("changed_files")
def q_g4(spark, d):
    from .operators.code_index import changed_files
    from .sources import synth
    return changed_files(synth.diffs(spark, d))


@entry("infer_symbols")
def q_h28(spark, d):
    return _index(spark, d).defs.select("repo_full_name", "path", "name", "start_line", "param_count", "exported")


@entry("symbol_line_ranges")
def q_e6(spark, d):
    return _index(spark, d).symbols.select("repo_full_name", "path", "name", "start_line", "end_line")


@entry("symbol_overlaps_hunk")
def q_c7(spark, d):
    return _index(spark, d).changed.select("pull_request_id", "repo_full_name", "path", "name", "changed_lines")


@entry("change_cone")
def q_c8(spark, d):
    from .operators.code_index import change_cone
    ix = _index(spark, d)
    return change_cone(ix.changed, ix.imports, ix.calls)


@entry("symbol_references")
def q_c8_once(spark, d):
    from .operators.code_index import symbol_references
    ix = _index(spark, d)
    return symbol_references(ix.changed, ix.imports, ix.calls)


@entry("test_file_map")
def q_c10(spark, d):
    return _index(spark, d).tests


@entry("risk_score")
def q_h8(spark, d):
    from .plans.planner import scored_symbols
    return scored_symbols(_index(spark, d)).select("pull_request_id", "path", "name", "has_tests", "risk_score")


@entry("task_types")
def q_h9(spark, d):
    from .plans.planner import scored_symbols
    s = scored_symbols(_index(spark, d))
    return s.select("pull_request_id", "path", "name", F.explode(S.task_types(
        "path", "name", "exported", "start_line", "end_line", "param_count", "has_tests")).alias("task_type"))


@entry("threshold_filter")
def q_h11(spark, d):
    from .plans.planner import above_threshold, scored_symbols
    return above_threshold(scored_symbols(_index(spark, d))).select("pull_request_id", "path", "name")


@entry("infra_yaml")
def q_h12(spark, d):
    from .sources import synth
    return synth.source_files(spark, d).select("path", S.is_infra_yaml("path").alias("infra_yaml"))


@entry("file_level_tasks")
def q_h13(spark, d):
    from .plans.planner import file_level_tasks
    return file_level_tasks(_index(spark, d))


@entry("generate_tasks")
def q_j3(spark, d):
    from .plans.planner import generate_tasks
    return generate_tasks(_index(spark, d)).select("task_id", "pull_request_id", "path", "symbol",
                                                   "task_type", "risk_score", "model_id", "file_level")


def _versions(spark, d):
    """File versions, their heads, hunks of the heads, and changed symbols by version."""
    from .operators import code_index as X
    from .operators import versions as V
    from .sources import synth
    from .sources.sinks import written_once
    versions = written_once(synth.source_versions(spark, d), "versions")  # looked up, indexed and read: texts are made once
    heads = views(spark, d).pull_requests.select(F.col("id").alias("pull_request_id"), "external_pr_id", "repo_full_name")
    hunks = X.parse_hunks(synth.diffs(spark, d)).join(grows(heads.drop("repo_full_name")), "pull_request_id")
    return versions, heads, V.changed_versions(V.stored_symbols(versions), hunks)


@entry("read_source_versions")
def q_a13_versions(spark, d):
    from .sources import synth
    return synth.source_versions(spark, d)


@entry("symbols_by_head")
def q_h28_versions(spark, d):
    """H28 at the newest head of every PR: symbols of the files that its diffs name."""
    from .operators import code_index as X
    from .operators import versions as V
    from .sources import synth
    from .sources.sinks import written_once
    heads = views(spark, d).pull_requests.select(F.col("id").alias("pull_request_id"), "external_pr_id", "repo_full_name")
    paths = X.changed_files(synth.diffs(spark, d)).join(grows(heads.drop("repo_full_name")), "pull_request_id") \
        .select("external_pr_id", "repo_full_name", "path").distinct()
    newest = heads.groupBy("external_pr_id").agg(F.max("pull_request_id").alias("pull_request_id"))
    versions = written_once(synth.source_versions(spark, d), "versions")
    return V.symbols_at(V.stored_symbols(versions), paths.join(grows(newest), "external_pr_id")).select(
        "pull_request_id", "repo_full_name", "path", "symbol", "kind", "parent", "start_line", "end_line", "param_count", "exported",
        "content_hash")


@entry("changed_symbols_by_head")
def q_c7_versions(spark, d):
    return _versions(spark, d)[2].select("external_pr_id", "repo_full_name", "path", "symbol", "kind", "start_line", "end_line",
                                         "from_head", "to_head", "changed_lines")


@entry("generate_new_tasks")
def q_j3_versions(spark, d):
    """J3 with C6: the tasks of every head without those whose place and content were reviewed at an earlier one."""
    from .operators import code_index as X
    from .operators import versions as V
    from .plans.planner import task_id
    from .sources import synth
    versions, heads, changed = _versions(spark, d)
    c = V.candidate_tasks(versions, changed, heads, X.test_file_map(synth.source_files(spark, d)))
    c = V.not_reviewed_yet(c, synth.task_outcomes(spark, d)).filter("reviewed_head is null")
    return c.withColumn("task_id", task_id("pull_request_id", "path", "symbol", "task_type")).select(
        "task_id", "pull_request_id", "path", "symbol", "start_line", "task_type", "risk_score", "model_id", "content_hash")


@entry("change_cone_by_head")
def q_c8_versions(spark, d):
    from .operators import versions as V
    versions, _, changed = _versions(spark, d)
    return V.change_cone_by_head(changed, V.version_references(versions), versions)


@entry("token_packing")
def q_e7(spark, d):
    """E7 over every document: lines kept under a 512-token budget."""
    from .plans.planner import pack_lines
    docs = views(spark, d).table("documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    p = pack_lines(lines, ["doc_id"], ["pos"], "line", F.lit(512), F.floor(F.col("pos") / 4096))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("kept").alias("kept_lines"),
                                   F.max(F.when(F.col("kept"), F.col("running_tokens"))).alias("kept_tokens"))


def _slices(spark, d):
    from .plans.planner import build_slices, generate_tasks
    ix = _index(spark, d)
    return build_slices(ix, generate_tasks(ix, by_type=False))


@entry("build_slices")
def q_j4(spark, d):
    return _slices(spark, d).select(
        "task_id", "cap_diff", "cap_call_graph", "cap_tests", "cap_total", "diff_available",
        "call_graph_available", "test_available", "diff_tokens", "call_graph_tokens", "test_tokens",
        "truncated", "diff_hunk", "call_graph", "test_context")


@entry("build_prompts")
def q_j5(spark, d):
    from .plans.planner import build_prompts
    return build_prompts(_slices(spark, d)).select("task_id", "prompt_hash", "prompt_tokens")


@entry("extract_json")
def q_h21(spark, d):
    from .functions.text import extract_json
    from .sources import synth
    return synth.model_answers(spark, d).select("task_id", extract_json("raw").alias("json"))


def _parsed(spark, d):
    from .plans.findings_flow import parse_findings
    from .sources import synth
    return parse_findings(synth.model_answers(spark, d), _index(spark, d).hunks)


@entry("parse_findings")
def q_h22(spark, d):
    return _parsed(spark, d).select("task_id", "ordinal", "category", "severity", "confidence", "file_path",
                                    "start_line", "status", "reason")


def _normalised(spark, d):
    from .plans.findings_flow import normalise_findings
    ix = _index(spark, d)
    v = views(spark, d)
    tasks = v.review_tasks.select(F.col("id").alias("task_id"), "model_id")
    return normalise_findings(_parsed(spark, d), ix.lines, v.pull_requests, tasks, ix.symbols)


@entry("normalise_findings")
def q_j6(spark, d):
    return _normalised(spark, d).select("id", "repo_full_name", "file_path", "start_line", "category",
                                        "confidence_score", "confidence_tier", "location_hash", "content_hash")


@entry("content_hash")
def q_h2(spark, d):
    return _normalised(spark, d).select("id", "content_hash")


@entry("rule_scan")
def q_j7(spark, d):
    from .plans.findings_flow import rule_scan
    return rule_scan(views(spark, d).table("documents"))


@entry("rule_table_scan")
def q_j7_rules(spark, d):
    """J7 with rules as a table, over every line of every document."""
    from .operators.rules import scan_lines
    from .sources import synth
    docs = views(spark, d).table("documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return scan_lines(lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line"), synth.scan_rules(spark, d))


@entry("labelled_eval")
def q_d14(spark, d):
    """Documents flagged by the rule scan against the toxic label;
    cost = scanned tokens per true positive."""
    from .plans.findings_flow import rule_scan
    v = views(spark, d)
    docs = v.table("documents")
    flagged = rule_scan(docs).select("doc_id").distinct().withColumn("flagged", F.lit(True))
    scored = docs.select("doc_id", S.token_count("text").alias("tokens")).join(flagged, "doc_id", "left") \
        .withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    return D.labelled_eval(scored, v.table("labels"), "flagged", "toxic", "tokens")


@entry("region_eval")
def q_d14_regions(spark, d):
    """D14 per repository: findings matched one to one with labelled regions of the same change and file."""
    from .operators.evaluation import matched_eval
    from .operators.maintenance import one_per_id
    from .sources.sinks import written_once
    from .sources.views import HEADS_PER_PR, labelled_regions
    f = one_per_id(views(spark, d).findings, (
        "pull_request_id", "repo_full_name", "file_path", "category", "start_line", "end_line", "prompt_tokens"))
    f = written_once(f, "found")  # read twice
    found = f.select(F.col("id").alias("finding_id"), F.floor(F.col("pull_request_id") / HEADS_PER_PR).alias("external_pr_id"), "repo_full_name",
                     "file_path", "category", "start_line", "end_line", F.col("prompt_tokens").cast("bigint").alias("tokens"))
    return matched_eval(found, labelled_regions(f), ["external_pr_id", "file_path"], "repo_full_name")


@entry("collect_findings")
def q_g1(spark, d):
    from .plans.findings_flow import rule_scan, tool_findings
    model = _normalised(spark, d).select("id", "location_hash", "category")
    tool = tool_findings(rule_scan(views(spark, d).table("documents"))).select("id", "location_hash", "category")
    return Q.collect_findings(model, tool)


# --------------------------------------------------------------- composites and leftovers
@entry("triage")
def q_j1(spark, d):
    return _triaged(
        views(spark, d), "id", "decision", "suppression_reason", "dup_kind", "escalated", "confidence_score",
        "confidence_tier", "prior_id")


@entry("confidence_penalty")
def q_j2(spark, d):
    pen = T.confidence_penalty(T.within_run_dedup(views(spark, d).findings))
    return T.penalty_events(pen).select("finding_id", "event_type", "old_value", "new_value")


@entry("persist_and_log")
def q_j8(spark, d):
    from .plans.findings_flow import persist_and_log
    _, ev = persist_and_log(_triaged(views(spark, d), *LOGGED))
    return ev.select("finding_id", "event_type", "new_value", "seq")


@entry("write_tables")
def q_a17(spark, d):
    """A review written to its own folder and read back: every row with its partition."""
    import uuid

    from .session import ensure_checkpoint_dir
    from .sources.sinks import write_review
    v = views(spark, d)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/review-{uuid.uuid4().hex}"
    out = write_review(_triaged(v), v.findings, v.pull_requests, folder)
    rows = [out[t].select(F.lit(t).alias("tbl"), F.col(i).alias("id"), F.col(p).alias("part"))
            for t, i, p in (("findings", "id", "decision"), ("finding_events", "finding_id", "event_type"),
                            ("comment_outbox", "id", "kind"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@entry("scorecard")
def q_j10(spark, d):
    from .plans.summary import scorecard
    v = views(spark, d)
    f, t, p = v.findings, v.review_tasks, v.pull_requests
    w = DEFAULT.window_days
    return scorecard({
        "false_positive_rate": D.false_positive_rate(f, v.finding_events, D.newest(f), w),
        "task_success_rate": D.task_success_rate(t, D.newest(t), w),
        "findings_per_pr": D.findings_per_pr(p, f, D.newest(p), w).drop("pr_number"),
        "tier_distribution": D.tier_distribution(f, D.newest(f), w),
        "model_usage": D.model_usage(f, D.newest(f), w),
        "addressed_status_counts": D.addressed_counts(f, D.newest(f), w),
    })


@entry("adversarial_verdicts")
def q_c13(spark, d):
    """Reactions act as the rebuttal verdicts (down only -> reject, both ->
    weaken, up only -> uphold)."""
    v = views(spark, d)
    r = D.reactions(v.finding_events)
    verdicts = r.select("finding_id", F.when((F.col("thumbs_down") > 0) & (F.col("thumbs_up") == 0), "reject")
                        .when((F.col("thumbs_down") > 0) & (F.col("thumbs_up") > 0), "weaken")
                        .otherwise("uphold").alias("verdict"))
    out = J.adversarial_verdicts(v.findings, verdicts)
    return out.select("id", "verdict", "verdict_action", "confidence_score")


@entry("retryable")
def q_h23(spark, d):
    """H23 over provider attempts of failed tasks: status by id (429, 500, 503, 400),
    every fifth attempt a timeout."""
    t = views(spark, d).review_tasks.filter(F.col("status") == "failed")
    a = t.select("id", F.element_at(F.array(F.lit(429), F.lit(500), F.lit(503), F.lit(400)),
                                    (F.col("id") % 4 + 1).cast("int")).alias("status_code"),
                 F.when(F.col("id") % 5 == 0, "timeout").otherwise("http").alias("error_kind"))
    return a.withColumn("retryable", S.retryable("status_code", "error_kind"))


@entry("comment_body")
def q_h24(spark, d):
    from .functions.text import comment_body
    t = _triaged(views(spark, d), "id", "decision", "severity", "category", "confidence_tier", "title", "body",
                 "suggestion", texts=("severity", "category", "title", "body", "suggestion"),
                 shown=("inline",)).filter(F.col("decision") == "inline")
    return t.select("id", comment_body("severity", "category", "confidence_tier", "title", "body",
                                       "suggestion").alias("body"))


@entry("summary_comment")
def q_h25(spark, d):
    from .plans.summary import summary_comment
    v = views(spark, d)
    return summary_comment(v.pull_requests, _triaged(v, *SUMMARISED, texts=("confidence_score", "severity", "file_path", "start_line", "category", "title")), v.review_tasks)


@entry("config_hash")
def q_h26(spark, d):
    from .functions.hashing import config_hash
    r = views(spark, d).pipeline_runs
    return r.select("id", config_hash("prompt_version", "metadata").alias("config_sha"))


@entry("prompt_hash")
def q_h27(spark, d):
    from .functions.hashing import prompt_hash
    c = views(spark, d).table("conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", prompt_hash("text").alias("prompt_hash"))


@entry("token_budget_total")
def q_h4(spark, d):
    t = views(spark, d).review_tasks
    b = S.token_budget(S.model_budget("model_id"), F.col("task_type"), S.language_of("file_path")["approximate"])
    return t.select("id", b.alias("b")).select("id", S.budget_total(F.col("b")).alias("total"))


@entry("round_confidence")
def q_h15(spark, d):
    f = views(spark, d).findings
    return f.select("id", S.round_confidence(F.col("confidence_score") * DEFAULT.penalty_factor).alias("score"))


@entry("validate_tier")
def q_h16(spark, d):
    f = views(spark, d).findings
    return f.select("id", S.tier_ok("confidence_tier", "confidence_score").alias("tier_ok"))


@entry("severity_rank")
def q_h17(spark, d):
    return views(spark, d).findings.select("id", S.severity_rank("severity").alias("severity_rank"))


@entry("escalates")
def q_h18(spark, d):
    return views(spark, d).findings.select("id", S.escalates("category", "severity").alias("escalates"))


@entry("language_of")
def q_h19(spark, d):
    from .sources import synth
    f = synth.source_files(spark, d)
    l = S.language_of("path")
    return f.select("path", l["language"].alias("language"), l["approximate"].alias("approximate"),
                    l["has_grammar"].alias("has_grammar"))


@entry("review_run")
def q_j9(spark, d):
    from .plans.summary import review_run
    return review_run(spark, d)


# --------------------------------------------------------------- streaming (2.I)
@entry("stream_pr_events")
def q_i1(spark, d):
    from .streaming.streams import stream_pr_events

    def deliveries(prs):
        raw = payloads_of(prs, (F.col("created_at").cast("timestamp").alias("received_at"),))
        sig = F.concat(F.lit("sha256="), F.when(F.col("_wrong_key"), hmac_sha256_hex("payload", "wrong-secret"))
                       .otherwise(hmac_sha256_hex("payload", WEBHOOK_KEY)))
        return raw.withColumn("signature", sig)
    return stream_pr_events(spark, d, WEBHOOK_KEY, deliveries)


@entry("stream_reactions")
def q_i2(spark, d):
    from .streaming.streams import stream_reactions
    return stream_reactions(spark, d, views(spark, d).findings)


@entry("stream_scorecard")
def q_i3(spark, d):
    from .streaming.streams import stream_scorecard
    return stream_scorecard(spark, d, views(spark, d).findings)


@entry("stream_scorecards")
def q_i3_both(spark, d):
    from .streaming.streams import stream_scorecards
    return stream_scorecards(spark, d, views(spark, d).findings)


@entry("stream_upsert_pull_requests")
def q_i1_upsert(spark, d):
    from .sources.views import pull_requests_from
    from .streaming.streams import read_stream
    from .streaming.upserts import stream_pull_requests
    incoming = _incoming_of(pull_requests_from(read_stream(spark, d, "orders")))
    return stream_pull_requests(incoming, views(spark, d).pull_requests)


@entry("stream_posting_retry")
def q_i4(spark, d):
    from .streaming.streams import stream_posting_retry
    return stream_posting_retry(spark, d, views(spark, d).pipeline_runs)


@entry("stream_posting_offers")
def q_i4_offers(spark, d):
    from .streaming.streams import stream_posting_offers
    return stream_posting_offers(spark, d, views(spark, d).pipeline_runs)


@entry("stream_stale_runs")
def q_i5(spark, d):
    from .streaming.streams import stream_stale_runs
    return stream_stale_runs(spark, d, 24.0)


@entry("stream_finding_events")
def q_i6(spark, d):
    from .streaming.streams import stream_finding_events
    return stream_finding_events(spark, _triaged(views(spark, d), *LOGGED))


@entry("static_tool_grounding")
def q_c11(spark, d):
    from .plans.findings_flow import code_scan, static_tool_grounding
    from .plans.planner import generate_tasks
    ix = _index(spark, d)
    return static_tool_grounding(code_scan(ix.lines), generate_tasks(ix))


@entry("slice_allocations")
def q_j4_alloc(spark, d):
    """J4 lengths-first stage: caps, available tokens and the fill allocation per task."""
    return _slices(spark, d).select(
        "task_id", "cap_diff", "cap_call_graph", "cap_tests", "cap_total", "diff_available",
        "call_graph_available", "test_available", "diff_tokens", "call_graph_tokens", "test_tokens", "truncated")
