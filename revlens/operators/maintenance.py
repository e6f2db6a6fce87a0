"""Table maintenance with upsert / append / update semantics (A4-A12, A15-A17,
B14-B19).

Parquet files have no unique index, MERGE or trigger, so each store statement
becomes a set operation over whole tables: a batch of changes is applied with
one join or one keyed aggregation, and rows the store would refuse come out of
a second ``conflict``/``missed`` output instead of an error.  Keyed
aggregations use ``min_by``/``max_by`` so they combine map-side and a hot key
costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (CATEGORIES, CONFIDENCE_TIERS, PR_STATES, RUN_STATUSES, SEVERITIES,
                      TASK_STATUSES, TASK_TYPES)

PR_KEY = ["external_pr_id", "head_sha"]
PR_FIRST = ["id", "repo_full_name", "pr_number", "base_sha", "author", "deleted_at", "created_at"]
PR_LAST = ["state", "metadata"]


def upsert_pull_requests(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A4 (+A11): insert, or on (external_pr_id, head_sha) update state, metadata
    and updated_at; id and created_at of the first row stay.

    ``incoming`` carries ``received_at``; within a batch the latest row wins.
    Idempotent: applying the same batch twice gives the same table.
    """
    cur = current.select(*PR_KEY, *PR_FIRST, *PR_LAST, "updated_at",
                         F.lit(0).alias("_src"), F.col("updated_at").alias("_t"))
    inc = incoming.select(*PR_KEY, *PR_FIRST, *PR_LAST,
                          F.col("received_at").alias("updated_at"),
                          F.lit(1).alias("_src"), F.col("received_at").alias("_t"))
    u = cur.unionByName(inc)
    order = F.struct("_src", "_t", "id")
    first = F.min_by(F.struct(*PR_FIRST), order).alias("_first")
    last = F.max_by(F.struct(*PR_LAST, "updated_at"), order).alias("_last")
    g = u.groupBy(*PR_KEY).agg(first, last)
    return g.select(*PR_KEY, *[F.col(f"_first.{c}").alias(c) for c in PR_FIRST],
                    *[F.col(f"_last.{c}").alias(c) for c in PR_LAST],
                    F.col("_last.updated_at").alias("updated_at"))


def append_runs(current: DataFrame, new: DataFrame) -> DataFrame:
    """A5: insert runs (default status running); a second running row for the
    same (PR, head) is refused -> ``outcome`` = conflict.

    Conflicts: an existing running row, or an earlier running row of the same
    batch (batch order = created_at, id).
    """
    n = new.withColumn("status", F.coalesce(F.col("status"), F.lit("running")))
    running_now = current.filter(F.col("status") == "running") \
        .select("pull_request_id", "head_sha").distinct().withColumn("_busy", F.lit(True))
    # first running request per (PR, head) in the batch: a map-side-combined
    # min, joined back on the unique run id (no window over a hot key)
    first = (n.filter(F.col("status") == "running").groupBy("pull_request_id", "head_sha")
             .agg(F.min(F.struct("created_at", "id")).alias("_f"))
             .select(F.col("_f.id").alias("id"), F.lit(True).alias("_first")))
    n = n.join(running_now, ["pull_request_id", "head_sha"], "left").join(first, "id", "left")
    conflict = (F.col("status") == "running") & (F.coalesce(F.col("_busy"), F.lit(False)) |
                                                 ~F.coalesce(F.col("_first"), F.lit(False)))
    return n.withColumn("outcome", F.when(conflict, "conflict").otherwise("inserted")).drop("_busy", "_first")


def append_tasks(new: DataFrame) -> DataFrame:
    """Default status pending; empty strings stored as NULL."""
    return new.withColumns({
        "status": F.coalesce(F.col("status"), F.lit("pending")),
        "symbol": F.nullif(F.col("symbol"), F.lit("")),
        "diff_hunk": F.nullif(F.col("diff_hunk"), F.lit("")),
    })


FINDING_KEY = ["location_hash", "pull_request_id", "head_sha"]


def append_findings(current: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only; a duplicate (location_hash, PR, head) is refused (Q20:
    within-run dedup losers are exempt and always kept).

    ``outcome``: inserted / conflict.  Within the batch the first row of a key
    (created_at, id) is inserted.
    """
    exempt = F.coalesce(F.col("suppression_reason") == "duplicate", F.lit(False)) & \
        ~F.coalesce(F.col("is_winner"), F.lit(True))
    existing = current.filter(~F.coalesce(F.col("suppression_reason") == "duplicate", F.lit(False))) \
        .select(*FINDING_KEY).distinct().withColumn("_exists", F.lit(True))
    n = new.withColumn("_exempt", exempt)
    first_id = (n.filter(~F.col("_exempt")).groupBy(*FINDING_KEY)
                .agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
                .select("id", F.lit(True).alias("_first")))
    n = n.join(existing, FINDING_KEY, "left").join(first_id, "id", "left")
    ok = F.col("_exempt") | (~F.coalesce(F.col("_exists"), F.lit(False)) & F.coalesce(F.col("_first"), F.lit(False)))
    return n.withColumn("outcome", F.when(ok, "inserted").otherwise("conflict")) \
        .drop("_exempt", "_exists", "_first")


REACTIONS = ["thumbs_up", "thumbs_down"]


def append_events(current: DataFrame, new: DataFrame, key: str = "spec") -> DataFrame:
    """Append events; reactions are unique per (finding, type, actor) (Q6
    spec rule) or per (finding, actor) (code rule); conflicts are ignored.

    Returns the rows that get stored (lifecycle events always, reactions once).
    """
    k = ["finding_id", "event_type", "actor"] if key == "spec" else ["finding_id", "actor"]
    is_r = F.col("event_type").isin(*REACTIONS)
    reactions = new.filter(is_r)
    first = (reactions.groupBy(*k).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
             .select("id"))
    seen = current.filter(is_r).select(*k).distinct()
    kept_r = reactions.join(first, "id", "left_semi").join(seen, k, "left_anti")
    return new.filter(~is_r).unionByName(kept_r)


def dismiss(current: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (fingerprint, repo); newest actor and reason win, the
    first created_at stays."""
    u = current.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    order = F.struct("_src", "created_at", "dismissed_by")
    return u.groupBy("fingerprint", "repo_full_name").agg(
        F.max_by(F.struct("dismissed_by", "reason"), order).alias("_l"),
        F.min("created_at").alias("created_at")).select(
        "fingerprint", "repo_full_name", "_l.dismissed_by", "_l.reason", "created_at")


# ---------------------------------------------------------------------------
# FIXED VALUES: constraints of the reference's tables
# ---------------------------------------------------------------------------
NOT_NULL = {
    "pull_requests": ["external_pr_id", "repo_full_name", "pr_number", "head_sha", "base_sha", "author", "state",
                      "metadata", "created_at", "updated_at"],
    "pipeline_runs": ["pull_request_id", "head_sha", "status", "prompt_version", "config_hash", "task_count",
                      "finding_count", "metadata", "started_at", "created_at", "updated_at"],
    "review_tasks": ["pull_request_id", "pipeline_run_id", "task_type", "file_path", "risk_score", "model_id", "status",
                     "created_at"],
    "findings": ["review_task_id", "pull_request_id", "pipeline_run_id", "file_path", "category", "confidence_tier",
                 "confidence_score", "severity", "title", "body", "location_hash", "head_sha",
                 "addressed_in_next_commit", "model_id", "metadata", "created_at", "updated_at"],
    "dismissed_fingerprints": ["fingerprint", "repo_full_name", "dismissed_by", "created_at"],
    "finding_events": ["finding_id", "event_type", "actor", "metadata", "created_at"],
}
ALLOWED = {
    "pull_requests": {"state": PR_STATES},
    "pipeline_runs": {"status": RUN_STATUSES},
    "review_tasks": {"task_type": TASK_TYPES, "status": TASK_STATUSES},
    "findings": {"category": CATEGORIES, "confidence_tier": CONFIDENCE_TIERS, "severity": SEVERITIES},
}
FOREIGN_KEYS = {
    "pipeline_runs": {"pull_request_id": "pull_requests"},
    "review_tasks": {"pull_request_id": "pull_requests", "pipeline_run_id": "pipeline_runs"},
    "findings": {"review_task_id": "review_tasks", "pull_request_id": "pull_requests", "pipeline_run_id": "pipeline_runs"},
    "finding_events": {"finding_id": "findings"},
}
# ---------------------------------------------------------------------------


def validate(df: DataFrame, table: str, parents: dict[str, DataFrame]) -> DataFrame:
    """A10: the rows of a table that its constraints refuse, with ``reasons``.

    Checked are the NOT NULL columns that ``df`` carries, enums, the score's
    range and foreign keys into ``parents`` (one equi join per key)."""
    checks = [F.when(F.col(c).isNull(), f"{c}_null") for c in NOT_NULL[table] if c in df.columns]
    checks += [F.when(~F.col(c).isin(*values), f"bad_{c}") for c, values in ALLOWED.get(table, {}).items()]
    if table == "findings":
        checks.append(F.when(~F.col("confidence_score").between(0, 1), "score_out_of_range"))
    # what a row tells by itself is settled before the joins, so the columns it takes don't travel
    df, checks = df.withColumn("_own", F.concat_ws(",", *checks)), [F.nullif(F.col("_own"), F.lit(""))]
    for c, parent in FOREIGN_KEYS.get(table, {}).items():
        known = parents[parent].select(F.col("id").alias(c)).distinct().withColumn(f"_{c}", F.lit(True))
        df = df.join(known, c, "left")
        checks.append(F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), f"missing_{c}"))
    df = df.withColumn("reasons", F.concat_ws(",", *checks)).filter(F.col("reasons") != "")
    return df.drop("_own", *[f"_{c}" for c in FOREIGN_KEYS.get(table, {})])


def merge_meta(df: DataFrame, updates: dict[str, Column], col: str = "metadata") -> DataFrame:
    """Merge keys into a JSON object column.  New keys win; a NULL update
    leaves its key as it is.  Values stay what they are: nested objects,
    numbers, booleans and explicit nulls are carried as variants."""
    base = F.from_json(F.coalesce(F.col(col), F.lit("{}")), "map<string,variant>")
    add = F.map_filter(F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), v.cast("variant"))]),
                       lambda k, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(add, k), F.lit(False))), add)
    return df.withColumn(col, F.to_json(merged))


def soft_delete(prs: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Set deleted_at once; ``outcome`` marks requested rows that were
    already deleted (missed) or deleted now."""
    req = ids.select("id").distinct().withColumn("_req", F.lit(True))
    d = prs.join(req, "id", "left")
    now = F.coalesce(F.col("_req"), F.lit(False)) & F.col("deleted_at").isNull()
    missed = F.coalesce(F.col("_req"), F.lit(False)) & F.col("deleted_at").isNotNull()
    return (d.withColumn("outcome", F.when(now, "deleted").when(missed, "missed"))
             .withColumns({"deleted_at": F.when(now, as_of).otherwise(F.col("deleted_at")),
                           "updated_at": F.when(now, as_of).otherwise(F.col("updated_at"))})
             .drop("_req"))


def update_task_status(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Running -> started_at; completed/failed -> completed_at and error;
    any other status changes only the status.  ``changes``: id, new_status,
    new_error, changed_at (latest change per id wins)."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("new_status", "new_error", "changed_at"),
                                              F.struct("changed_at", "new_status")).alias("c"))
    d = tasks.join(last, "id", "left")
    st = F.col("c.new_status")
    has = st.isNotNull()
    return d.select(
        *[c for c in tasks.columns if c not in ("status", "error", "started_at", "completed_at")],
        F.when(has, st).otherwise(F.col("status")).alias("status"),
        F.when(has & st.isin("completed", "failed"), F.col("c.new_error")).otherwise(F.col("error")).alias("error"),
        F.when(has & (st == "running"), F.col("c.changed_at")).otherwise(F.col("started_at")).alias("started_at"),
        F.when(has & st.isin("completed", "failed"), F.col("c.changed_at"))
         .otherwise(F.col("completed_at")).alias("completed_at"),
    )


def missed_ids(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Requested ids that do not exist ("not found" becomes an output)."""
    return changes.select("id").distinct().join(table.select("id"), "id", "left_anti")


def complete_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Set status, counts, error and completed_at from a results batch."""
    r = results.select("id", F.col("status").alias("_st"), F.col("task_count").alias("_tc"),
                       F.col("finding_count").alias("_fc"), F.col("error").alias("_err"),
                       F.col("completed_at").alias("_at"))
    d = runs.join(r, "id", "left")
    has = F.col("_st").isNotNull()
    return d.withColumns({
        "status": F.when(has, F.col("_st")).otherwise(F.col("status")),
        "task_count": F.when(has, F.col("_tc")).otherwise(F.col("task_count")),
        "finding_count": F.when(has, F.col("_fc")).otherwise(F.col("finding_count")),
        "error": F.when(has, F.col("_err")).otherwise(F.col("error")),
        "completed_at": F.when(has, F.col("_at")).otherwise(F.col("completed_at")),
        "updated_at": F.when(has, F.col("_at")).otherwise(F.col("updated_at")),
    }).drop("_st", "_tc", "_fc", "_err", "_at")


RECONCILE_ERROR = "reconciled: process crashed or restarted"


def reconcile_stale_runs(runs: DataFrame, as_of: Column, older_than_hours: float | None = None) -> DataFrame:
    """Running -> failed with the reconcile error (Q7: all running rows when
    no threshold, else only those started before as_of - threshold)."""
    stale = F.col("status") == "running"
    if older_than_hours is not None:
        stale = stale & (F.col("started_at") < as_of - F.expr(f"INTERVAL {int(older_than_hours * 3600)} SECONDS"))
    return (runs.withColumn("_stale", stale)
            .withColumns({
                "status": F.when(F.col("_stale"), "failed").otherwise(F.col("status")),
                "error": F.when(F.col("_stale"), F.lit(RECONCILE_ERROR)).otherwise(F.col("error")),
                "completed_at": F.when(F.col("_stale"), as_of).otherwise(F.col("completed_at")),
                "updated_at": F.when(F.col("_stale"), as_of).otherwise(F.col("updated_at")),
                "reconciled": F.col("_stale")})
            .drop("_stale"))


def mark_posted(findings: DataFrame, receipts: DataFrame) -> DataFrame:
    """receipts(id, external_comment_id, posted_at) set posted_at and comment id."""
    r = receipts.select("id", F.col("external_comment_id").alias("_cid"), F.col("posted_at").alias("_pat"))
    d = findings.join(r, "id", "left")
    has = F.col("_pat").isNotNull()
    return d.withColumns({
        "posted_at": F.when(has, F.col("_pat")).otherwise(F.col("posted_at")),
        "external_comment_id": F.when(has, F.col("_cid")).otherwise(F.col("external_comment_id")),
    }).drop("_cid", "_pat")


def mark_addressed(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """Set addressed_in_next_commit; derived 3-state status (Q5)."""
    a = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    d = findings.join(a, "id", "left")
    flag = F.col("addressed_in_next_commit") | F.coalesce(F.col("_hit"), F.lit(False))
    return d.withColumn("addressed_in_next_commit", flag) \
        .withColumn("addressed_status", F.when(flag, "likely_addressed").otherwise("unaddressed")) \
        .drop("_hit")


def purge(tables: dict[str, DataFrame], pr_ids: DataFrame) -> dict[str, DataFrame]:
    """Hard delete of PRs and everything below them, children first."""
    ids = pr_ids.select(F.col("id").alias("pull_request_id")).distinct()
    findings = tables["findings"]
    gone_findings = findings.join(ids, "pull_request_id", "left_semi").select(F.col("id").alias("finding_id"))
    return {
        "finding_events": tables["finding_events"].join(gone_findings, "finding_id", "left_anti"),
        "findings": findings.join(ids, "pull_request_id", "left_anti"),
        "review_tasks": tables["review_tasks"].join(ids, "pull_request_id", "left_anti"),
        "pipeline_runs": tables["pipeline_runs"].join(ids, "pull_request_id", "left_anti"),
        "pull_requests": tables["pull_requests"].join(
            ids.withColumnRenamed("pull_request_id", "id"), "id", "left_anti"),
    }


def foreign_key_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Children whose parent row does not exist (nothing is cascaded)."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def one_per_id(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``id`` and ``columns`` of one row per id, the least by all of its columns.

    Whole rows are compared only where an id repeats: those ids are looked for first and stored, so that
    the planner knows their size, and all other rows bring nothing but the columns wanted."""
    from ..sources.sinks import written_once

    repeated = written_once(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("_id")), "repeated")
    same = F.col("id").eqNullSafe(F.col("_id"))
    once = rows.select("id", *columns).join(repeated, same, "left_anti")
    least = rows.join(repeated, same, "left_semi").groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("r"))
    return once.unionByName(least.select("id", *[f"r.{c}" for c in columns]))
