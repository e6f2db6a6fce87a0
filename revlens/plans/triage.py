"""Finding policy: within-run dedup (E2), confidence penalty (J2), cross-run
duplicates (E4), priority order (E3) and triage (J1, G2).

Set-based throughout: each stage is one aggregation or one windowed pass over
all findings of all PRs, instead of a per-finding lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ReviewConfig
from ..functions.hashing import packed, unpacked
from ..functions.scoring import (escalates, language_of, round_confidence, severity_rank,
                                 tier_from_score, tier_rank)
from ..operators.windows import keyed_last_before, keyed_position


def within_run_dedup(findings: DataFrame) -> DataFrame:
    """Per (run, location_hash) keep the highest score; ties keep the earlier.

    One window over rows dealt out by run, so the join to the runs that follows it shuffles and
    sorts nothing again.  Losers are kept with ``suppression_reason = 'duplicate'``.
    """
    w = Window.partitionBy("pipeline_run_id", "location_hash").orderBy(-F.col("confidence_score"), "created_at", "id")
    out = findings.repartition("pipeline_run_id") \
        .withColumn("is_winner", F.coalesce(F.first("id").over(w) == F.col("id"), F.lit(False)))
    return out.withColumn(
        "suppression_reason",
        F.when(~F.col("is_winner"), F.lit("duplicate")).otherwise(F.col("suppression_reason")))


def confidence_penalty(findings: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """x0.85 when the index is approximate and the slice used semantic context.

    Adds ``old_score``, ``old_tier``, ``penalised`` and ``tier_changed``; the tier
    never rises (Q18: lower of old tier and tier of the new score).
    """
    if cfg.approximate_index == "always":
        approximate = F.lit(True)
    else:
        approximate = F.coalesce(language_of("file_path")["approximate"], F.lit(False))
    hit = approximate & F.coalesce(F.col("used_semantic_context"), F.lit(False))
    new_score = round_confidence(F.col("old_score") * cfg.penalty_factor)
    new_tier_raw = tier_from_score(new_score, cfg)
    new_tier = F.when(tier_rank(new_tier_raw) < tier_rank("old_tier"), new_tier_raw) \
        .otherwise(F.col("old_tier"))
    d = (findings
         .withColumn("old_score", F.col("confidence_score"))
         .withColumn("old_tier", F.col("confidence_tier"))
         .withColumn("penalised", hit))
    return (d.withColumns({
        "confidence_score": F.when(F.col("penalised"), new_score).otherwise(F.col("old_score")),
        "confidence_tier": F.when(F.col("penalised"), new_tier).otherwise(F.col("old_tier"))})
        .withColumn("tier_changed", F.col("confidence_tier") != F.col("old_tier")))


def penalty_events(penalised: DataFrame, actor: str = "system") -> DataFrame:
    """J2 audit log: confidence_adjusted for every penalised row, tier_changed if moved."""
    ev = F.array_compact(F.array(
        F.when(F.col("penalised"), F.struct(F.lit("confidence_adjusted").alias("event_type"),
                                            F.format_string("%.4f", "old_score").alias("old_value"),
                                            F.format_string("%.4f", "confidence_score").alias("new_value"))),
        F.when(F.col("penalised") & F.col("tier_changed"),
               F.struct(F.lit("tier_changed").alias("event_type"), F.col("old_tier").alias("old_value"),
                        F.col("confidence_tier").alias("new_value")))))
    return (penalised.select("id", F.explode(ev).alias("e"), "created_at")
            .select(F.col("id").alias("finding_id"), "e.event_type", F.lit(actor).alias("actor"),
                    "e.old_value", "e.new_value", "created_at"))


def with_run_start(findings: DataFrame, runs: DataFrame) -> DataFrame:
    return findings.join(runs.select(F.col("id").alias("pipeline_run_id"),
                                     F.col("started_at").alias("run_started_at")),
                         "pipeline_run_id", "left")


def _keys(cfg: ReviewConfig) -> list[str]:
    return ["_key"] if cfg.prior_scope == "repo" else ["_pr", "_key"]


def _with_key(findings: DataFrame, cfg: ReviewConfig) -> DataFrame:
    """The location key in ``_keys``, never null, in place of ``location_hash``."""
    d = findings.withColumn("_key", packed("location_hash")).drop("location_hash")
    return d if cfg.prior_scope == "repo" else d.withColumn("_pr", packed(F.col("pull_request_id").cast("string")))


def _has_key(cfg: ReviewConfig) -> Column:
    """Rows whose location key was not null."""
    ok = F.col("_key") != F.lit(b"n")
    return ok if cfg.prior_scope == "repo" else ok & F.col("pull_request_id").isNotNull()


def _sortable(d: DataFrame) -> list[str]:
    return [c for c, kind in d.dtypes if not kind.startswith(("map", "variant"))]


def _day() -> Column:
    """Day of run start; rows without one go before all others."""
    return F.coalesce(F.unix_date(F.col("run_started_at").cast("date")), F.lit(-2**31))


def cross_run_duplicates(findings: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """Compare each within-run winner with the winner of the nearest earlier
    run for the same key (Q21).  Key = location_hash (repo scope: the hash
    already contains the repo) or (pull_request_id, location_hash).

    Runs over all rows (losers included, they are never a prior) and adds
    ``prior_id``, ``prior_content_hash`` and ``is_prior_dup`` (winner whose
    content hash equals the prior's, both present).  The ordered pass is
    split by day of run start so one hot location does not land in one task.
    All columns of ``findings`` travel: give it those wanted.
    """
    winner = F.coalesce(F.col("is_winner"), F.lit(True))
    d = _with_key(findings, cfg)
    d = keyed_last_before(d, _keys(cfg), ["run_started_at", "pipeline_run_id", "id"], ["id", "content_hash"], _day(),
                          include=winner, prefix="prior_", carried=_has_key(cfg), ties=_sortable(d))
    d = d.drop("prior_exists").withColumn("location_hash", unpacked("_key")).drop("_key", "_pr")
    return d.withColumn("is_prior_dup", winner & F.coalesce(
        F.col("prior_content_hash").isNotNull() & F.col("content_hash").isNotNull() &
        (F.col("prior_content_hash") == F.col("content_hash")), F.lit(False)))


def triage(findings: DataFrame, runs: DataFrame, dismissed: DataFrame,
           cfg: ReviewConfig = DEFAULT, columns: Sequence[str] | None = None,
           texts: Sequence[str] = (), shown: Sequence[str] = ("inline", "summary")) -> DataFrame:
    """E2 on the raw score -> J2 -> dismissal -> cross-run dup -> escalate/tier.

    Every input row comes out once with ``decision`` in (inline, summary,
    suppress), ``suppression_reason`` and ``dup_kind`` (within_run / prior_run).

    ``columns`` are those wanted (None: all of the findings' and all that are added).
    ``texts``: those of the columns that are read of rows with a decision in ``shown`` only; they
    are null in rows that can't get one.
    What a row tells by itself (penalty, escalation) is settled first, so the
    columns it came from travel only if they are wanted; if all are, it is settled last,
    so that it doesn't travel besides them.  Then one shuffle
    and one sort of the findings: rows are hash-partitioned by (location key,
    day of run start) and sorted by run and score.  A run's findings for one
    location all share that bucket, so the within-run winner (E2) is a window
    inside the partition; winners are one per run, so the cross-run pass (E4)
    reads the same order, and its per-bucket carry aggregate and the carry
    join reuse the same partitioning.  Dismissals come with the carry, not by a
    shuffle of their own.  A hot location is spread over its days.
    """
    keys, esc = _keys(cfg), F.col("escalated")
    d, score = findings, "confidence_score"
    if columns is not None:
        d, score = confidence_penalty(findings, cfg).withColumn("escalated", escalates("category", "severity", cfg)), "old_score"
        tiers = [tier for tier, decision in (("high", "inline"), ("medium", "summary")) if decision in shown]
        may = F.col("confidence_tier").isin(tiers) | (esc if "inline" in shown else F.lit(False))
        d = _with_key(d, cfg).withColumns({c: F.when(may, F.col(c)) for c in texts})
        used = ["id", "pipeline_run_id", *keys, *(["pull_request_id"] if "_pr" in keys else []), "repo_full_name", "content_hash", "created_at", "old_score",
                "confidence_tier", "escalated"]
        d = d.select(*[c for c in d.columns if c in used or c in columns and c != "suppression_reason"])
    else:
        d = _with_key(d, cfg)
    d = with_run_start(d, runs).withColumn("_bk", _day())
    d = d.repartition(*keys, "_bk")
    w = Window.partitionBy(*keys, "_bk", "run_started_at", "pipeline_run_id").orderBy(
        F.col(score).desc(), F.col("created_at"), F.col("id"), *_sortable(d))
    d = d.withColumn("is_winner", F.row_number().over(w) == 1)
    # the repositories in which a location is dismissed: its hash names one, so the list is short
    dis = dismissed.groupBy(packed("fingerprint").alias("_key")).agg(F.collect_set("repo_full_name").alias("_dismissed"))
    named = columns is None or "prior_id" in columns  # the prior's id goes along only if it is wanted
    d = keyed_last_before(d, keys, ["run_started_at", "pipeline_run_id"], ["id", "content_hash"] if named else ["content_hash"],
                          None, include=F.col("is_winner"), prefix="prior_", of_key=dis, carried=_has_key(cfg)).drop("prior_exists")
    d = d.withColumn("is_prior_dup", F.col("is_winner") & F.coalesce(
        F.col("prior_content_hash").isNotNull() & F.col("content_hash").isNotNull() &
        (F.col("prior_content_hash") == F.col("content_hash")), F.lit(False)))
    d = d.withColumn("is_dismissed", F.when(
        (F.col("_key") != F.lit(b"n")) & F.array_contains("_dismissed", F.col("repo_full_name")), F.lit(True))).drop("_dismissed")
    d = d.withColumn("location_hash", unpacked("_key")).drop("_key", "_pr")
    if columns is None:
        d = confidence_penalty(d, cfg).withColumn("escalated", escalates("category", "severity", cfg))
    loser = ~F.col("is_winner")
    dismissed_hit = F.col("is_winner") & F.coalesce(F.col("is_dismissed"), F.lit(False))
    decision = (F.when(loser | dismissed_hit | F.col("is_prior_dup"), "suppress")
                .when(esc | (F.col("confidence_tier") == "high"), "inline")
                .when(F.col("confidence_tier") == "medium", "summary")
                .otherwise("suppress"))
    reason = (F.when(loser, "duplicate")
              .when(dismissed_hit, "dismissed_fingerprint")
              .when(F.col("is_prior_dup"), "duplicate")
              .when(esc | F.col("confidence_tier").isin("high", "medium"), F.lit(None))
              .otherwise("low_confidence"))
    dup_kind = (F.when(loser, "within_run")
                .when(~dismissed_hit & F.col("is_prior_dup"), "prior_run"))
    d = (d.withColumn("decision", decision)
             .withColumn("suppression_reason", reason)
             .withColumn("dup_kind", dup_kind)
             .withColumn("prior_id", F.when(F.col("is_winner"), F.col("prior_id")) if named else F.lit(None).cast("string"))
             .withColumn("prior_content_hash", F.when(F.col("is_winner"), F.col("prior_content_hash"))))
    return d if columns is None else d.select(*columns)


TRIAGE_COLUMNS = ["id", "pull_request_id", "pipeline_run_id", "repo_full_name", "location_hash",
                  "confidence_score", "confidence_tier", "escalated", "decision",
                  "suppression_reason", "dup_kind", "prior_id"]


def decision_counts(triaged: DataFrame) -> DataFrame:
    """G2 summary: rows per (decision, reason, dup kind); partitions the input."""
    return (triaged.groupBy("decision", "suppression_reason", "dup_kind")
            .agg(F.count(F.lit(1)).alias("n")))


def priority_order(triaged: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """Position of each inline finding within its PR: escalated first,
    severity rank desc, score desc, id.  Bucketed by (escalated, severity) so a
    hot PR is split across tasks."""
    d = triaged.filter(F.col("decision") == "inline") \
        .withColumn("severity_rank", severity_rank("severity"))
    order = [F.col("escalated").desc(), F.col("severity_rank").desc(),
             F.col("confidence_score").desc(), F.col("id")]
    return keyed_position(d, ["pull_request_id"], order,
                          [F.col("escalated"), F.col("severity_rank")], [True, True])


def triage_partition(triaged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three disjoint outputs covering the input."""
    return (triaged.filter(F.col("decision") == "inline"),
            triaged.filter(F.col("decision") == "summary"),
            triaged.filter(F.col("decision") == "suppress"))
