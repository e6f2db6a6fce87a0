"""Joins of the review model.

Join strategy (broadcast, shuffle-hash, sort-merge) is left to Catalyst and
AQE: a side is broadcast only when the planner has measured it under
``spark.sql.autoBroadcastJoinThreshold``; skewed partitions are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import packed, unpacked
from .windows import latest_per_key


def prior_finding(findings: DataFrame, lookups: DataFrame | None = None,
                  values: tuple[str, ...] = ("id", "pull_request_id", "content_hash", "created_at")
                  ) -> DataFrame:
    """Newest finding per (location_hash, repo), any status (code rule).

    One map-side-combined ``max_by`` for all keys; optional ``lookups`` keeps
    the requested keys only (keys without a finding come back with NULLs).
    """
    top = latest_per_key(findings, ["location_hash", "repo_full_name"], ["created_at", "id"], list(values))
    if lookups is None:
        return top
    return lookups.select("location_hash", "repo_full_name").distinct() \
        .join(top, ["location_hash", "repo_full_name"], "left")


def with_dismissed_flag(findings: DataFrame, dismissed: DataFrame) -> DataFrame:
    """EXISTS test as a left join to the distinct dismissed keys."""
    keys = dismissed.select(F.col("fingerprint").alias("location_hash"), "repo_full_name") \
        .distinct().withColumn("dismissed", F.lit(True))
    return findings.join(keys, ["location_hash", "repo_full_name"], "left") \
        .withColumn("dismissed", F.coalesce(F.col("dismissed"), F.lit(False)))


def not_dismissed(findings: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Findings surviving permanent dismissals (anti join)."""
    keys = dismissed.select(F.col("fingerprint").alias("location_hash"), "repo_full_name")
    return findings.join(keys, ["location_hash", "repo_full_name"], "left_anti")


def prs_with_findings(prs: DataFrame, findings: DataFrame) -> DataFrame:
    """C4: every PR with its findings, or one row of NULLs when it has none."""
    f = findings.select(F.col("pull_request_id").alias("id"), F.col("id").alias("finding_id"),
                        "confidence_tier", "posted_at")
    return prs.join(f, "id", "left")


def findings_with_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings x their lifecycle events (inner equi join)."""
    f = findings.select(F.col("id").alias("finding_id"), "pull_request_id", "category",
                        F.col("created_at").alias("finding_created_at"))
    return f.join(events.select(F.col("id").alias("event_id"), "finding_id", "event_type",
                                "actor", F.col("created_at").alias("event_created_at")),
                  "finding_id")


def skip_unchanged(candidates: DataFrame, tasks: DataFrame, findings: DataFrame,
                   prs: DataFrame) -> DataFrame:
    """Drop candidate findings/tasks whose (location, content) pair was
    already reviewed by a *completed* task of an earlier head of the same PR.

    Equi join on (external_pr_id, location_hash, content_hash) plus the
    head-order condition; failed tasks never suppress a re-review.  Both hashes
    travel packed, in half their bytes.
    """
    columns = candidates.columns
    candidates, findings = (d.withColumns({f"_{c}": packed(c) for c in ("location_hash", "content_hash")}) for d in (candidates, findings))
    candidates = candidates.drop("location_hash", "content_hash")
    heads = prs.select(F.col("id").alias("pull_request_id"), "external_pr_id",
                       F.col("created_at").alias("head_created_at"))
    done = (findings.join(tasks.filter(F.col("status") == "completed")
                          .select(F.col("id").alias("review_task_id")), "review_task_id", "left_semi")
            .filter(F.col("content_hash").isNotNull())
            .filter(F.col("location_hash").isNotNull()).drop("location_hash", "content_hash").join(heads, "pull_request_id")
            .select("external_pr_id", "_location_hash", "_content_hash",
                    F.col("head_created_at").alias("prior_head_at"),
                    F.col("pull_request_id").alias("prior_pr")))
    c = candidates.join(heads, "pull_request_id")
    cond = [c.external_pr_id == done.external_pr_id, c._location_hash == done._location_hash,
            c._content_hash == done._content_hash,
            (done.prior_head_at < c.head_created_at) |
            ((done.prior_head_at == c.head_created_at) & (done.prior_pr < c.pull_request_id))]
    new = c.join(done, cond, "left_anti").withColumns({c: unpacked(f"_{c}") for c in ("location_hash", "content_hash")})
    return new.select(*columns)


def posting_retry_set(findings: DataFrame, runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Unposted, unsuppressed, no comment id, run completed, within the
    trailing window; oldest first."""
    done = runs.filter(F.col("status") == "completed").select(F.col("id").alias("pipeline_run_id"))
    return (findings.filter(F.col("posted_at").isNull() & F.col("suppression_reason").isNull() &
                            F.col("external_comment_id").isNull() &
                            (F.col("created_at") > as_of - F.expr(f"INTERVAL {days} DAYS")))
            .join(done, "pipeline_run_id", "left_semi")
            .orderBy("created_at", "id"))


def adversarial_verdicts(findings: DataFrame, verdicts: DataFrame, cfg_factor: float = 0.85) -> DataFrame:
    """Finding + rebuttal verdict -> keep, suppress or lower confidence.

    ``verdicts``: finding_id, verdict in (uphold, reject, weaken).  Missing
    verdict keeps the finding unchanged.
    """
    v = verdicts.select(F.col("finding_id").alias("id"), "verdict")
    d = findings.join(v, "id", "left")
    return d.withColumns({
        "verdict_action": F.when(F.col("verdict") == "reject", "suppress")
        .when(F.col("verdict") == "weaken", "lower").otherwise("keep"),
        "confidence_score": F.when(F.col("verdict") == "weaken",
                                   F.round(F.col("confidence_score") * cfg_factor * 10000) / 10000)
        .otherwise(F.col("confidence_score")),
    })
