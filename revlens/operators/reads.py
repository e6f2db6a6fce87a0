"""Projections, filters, ordered lists and top-k.

Point lookups of the reference ("get X by id") take a DataFrame of keys and
run as one semi join, so a batch of a million lookups is one shuffle (or a
broadcast when the planner measures the key set as small).  Ordered lists are
a sort on the partition key plus the reference's order, with ``id`` appended
as a total tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import severity_rank


def _ids(keys: DataFrame, col: str = "id") -> DataFrame:
    return keys.select(F.col(col).alias("id")).distinct()


def get_pull_requests(prs: DataFrame, ids: DataFrame, include_deleted: bool = True) -> DataFrame:
    """B1: pull requests by id; Q14 switch hides soft-deleted rows."""
    out = prs.join(_ids(ids), "id", "left_semi")
    return out if include_deleted else out.filter(F.col("deleted_at").isNull())


def active_pull_requests(prs: DataFrame) -> DataFrame:
    """B2: rows that are not soft-deleted."""
    return prs.filter(F.col("deleted_at").isNull())


def get_runs(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pipeline runs by id."""
    return runs.join(_ids(ids), "id", "left_semi")


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks, highest risk first."""
    return tasks.filter(F.col("status") == "pending").orderBy(F.col("risk_score").desc(), "id")


def unaddressed_findings(findings: DataFrame, mode: str = "code") -> DataFrame:
    """Posted and not addressed, oldest first (code); spec variant keeps
    unaddressed rows that carry a content hash."""
    if mode == "code":
        out = findings.filter(F.col("posted_at").isNotNull() & ~F.col("addressed_in_next_commit"))
    else:
        out = findings.filter(~F.col("addressed_in_next_commit") & F.col("content_hash").isNotNull())
    return out.orderBy("pull_request_id", "created_at", "id")


def unposted_findings(findings: DataFrame) -> DataFrame:
    """Not posted, not suppressed, best score first."""
    return (findings.filter(F.col("posted_at").isNull() & F.col("suppression_reason").isNull())
            .orderBy("pull_request_id", F.col("confidence_score").desc(), "id"))


def severity_sort_key(sev) -> Column:
    """the reference's CASE severity 1..5 (critical first)."""
    return 6 - severity_rank(sev)


def by_severity(df: DataFrame, within: list[str] | None = None) -> DataFrame:
    """F1: score desc, then severity critical..info, then id."""
    return df.orderBy(*(within or []), F.col("confidence_score").desc(),
                      severity_sort_key("severity"), "id")


def findings_for(keys: DataFrame, findings: DataFrame, key: str = "pull_request_id") -> DataFrame:
    """All findings of the given PRs (or runs), in F1 order per key."""
    sel = keys.select(F.col(key)).distinct()
    return by_severity(findings.join(sel, key, "left_semi"), [key])


def tasks_for(keys: DataFrame, tasks: DataFrame, key: str = "pull_request_id") -> DataFrame:
    """Task lists per PR or per run."""
    return tasks.join(keys.select(key).distinct(), key, "left_semi").orderBy(key, "created_at", "id")


def events_for(keys: DataFrame, events: DataFrame) -> DataFrame:
    """Lifecycle log of the given findings, oldest first."""
    return (events.join(keys.select("finding_id").distinct(), "finding_id", "left_semi")
            .orderBy("finding_id", "created_at", "id"))


def runs_for(keys: DataFrame, runs: DataFrame, order_col: str = "created_at") -> DataFrame:
    """Runs of the given PRs, newest first (code: created_at; spec: started_at)."""
    return (runs.join(keys.select("pull_request_id").distinct(), "pull_request_id", "left_semi")
            .orderBy("pull_request_id", F.col(order_col).desc(), F.col("id").desc()))


def suppressed_findings(findings: DataFrame) -> DataFrame:
    """Suppressed rows with their reasons."""
    return findings.filter(F.col("suppression_reason").isNotNull()) \
        .orderBy("pull_request_id", "suppression_reason", "id")


def reaction_poll_set(findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Commented findings posted within the trailing window."""
    return findings.filter(F.col("external_comment_id").isNotNull() &
                           (F.col("posted_at") > as_of - F.expr(f"INTERVAL {days} DAYS")))


def risk_order(tasks: DataFrame) -> DataFrame:
    """tasks by risk desc, id."""
    return tasks.orderBy(F.col("risk_score").desc(), "id")


def high_risk_first(tasks: DataFrame, high: float = 0.7) -> DataFrame:
    """risk >= high first, then score desc, id."""
    return tasks.withColumn("high_risk", F.col("risk_score") >= high) \
        .orderBy(F.col("high_risk").desc(), F.col("risk_score").desc(), "id")


def cap_inline(inline: DataFrame, n: int | None, order: list[Column]) -> DataFrame:
    """optional per-PR inline cap; overflow goes to the summary.

    With ``n=None`` (the default, Q12) nothing moves.  A cap is a top-k per PR;
    Catalyst turns the ``row_number() <= n`` filter into a window group limit.
    """
    if n is None:
        return inline.withColumn("decision", F.lit("inline"))
    rn = F.row_number().over(Window.partitionBy("pull_request_id").orderBy(*order))
    return inline.withColumn("_rn", rn).withColumn(
        "decision", F.when(F.col("_rn") <= n, "inline").otherwise("summary")).drop("_rn")
