"""Policy semantics: tiers, rounding, dedup ties, cross-run duplicates, triage invariants."""
import datetime as dt

from pyspark.sql import functions as F

from revlens.functions.scoring import round_confidence, tier_from_score
from revlens.plans import triage as T

TS = dt.datetime(2024, 1, 1)


def test_tier_bounds_and_rounding(spark):
    df = spark.createDataFrame([(0.80,), (0.7999,), (0.50,), (0.4999,)], "s double")
    assert [r.t for r in df.select(tier_from_score("s").alias("t")).collect()] == ["high", "medium", "medium", "low"]
    r = spark.range(1).select(round_confidence(F.lit(0.94) * 0.85).alias("x")).first().x
    assert r == 0.799
    assert spark.range(1).select(tier_from_score(F.lit(r)).alias("t")).first().t == "medium"


def _findings(spark, rows):
    schema = ("id string, pipeline_run_id long, pull_request_id long, location_hash string, repo_full_name string, "
              "confidence_score double, confidence_tier string, created_at timestamp, content_hash string, "
              "category string, severity string, file_path string, used_semantic_context boolean, "
              "suppression_reason string")
    return spark.createDataFrame(rows, schema)


def _row(i, run, lh, score, ch="c1", cat="logic", sev="medium", t=TS, sem=False):
    tier = "high" if score >= 0.8 else "medium" if score >= 0.5 else "low"
    return (i, run, run, lh, "org/r", score, tier, t, ch, cat, sev, "a.go", sem, None)


def test_within_run_dedup_tie_keeps_earlier(spark):
    f = _findings(spark, [_row("b", 1, "h", 0.9, t=TS + dt.timedelta(1)), _row("a", 1, "h", 0.9, t=TS),
                          _row("c", 1, "h", 0.5)])
    out = {r.id: r.is_winner for r in T.within_run_dedup(f).collect()}
    assert out == {"a": True, "b": False, "c": False}


def _runs(spark, n):
    return spark.createDataFrame([(i, TS + dt.timedelta(days=i)) for i in range(1, n + 1)],
                                 "id long, started_at timestamp")


def _dismissed(spark, rows=()):
    return spark.createDataFrame(list(rows), "fingerprint string, repo_full_name string")


def test_cross_run_duplicate_and_null_content_hash(spark):
    f = _findings(spark, [_row("r1", 1, "h", 0.9, ch="x"), _row("r2", 2, "h", 0.9, ch="x"),
                          _row("r3", 3, "h", 0.9, ch=None), _row("r4", 4, "h", 0.9, ch="y")])
    t = {r.id: (r.decision, r.suppression_reason) for r in
         T.triage(f, _runs(spark, 4), _dismissed(spark)).collect()}
    assert t["r1"] == ("inline", None)
    assert t["r2"] == ("suppress", "duplicate")
    assert t["r3"] == ("inline", None)      # NULL content hash is allowed through
    assert t["r4"] == ("inline", None)      # changed code re-surfaces


def test_dismissal_and_escalation(spark):
    f = _findings(spark, [_row("d", 1, "h1", 0.9), _row("e", 1, "h2", 0.2, cat="security", sev="critical"),
                          _row("l", 1, "h3", 0.2), _row("m", 1, "h4", 0.6)])
    t = {r.id: (r.decision, r.suppression_reason) for r in
         T.triage(f, _runs(spark, 1), _dismissed(spark, [("h1", "org/r")])).collect()}
    assert t == {"d": ("suppress", "dismissed_fingerprint"), "e": ("inline", None),
                 "l": ("suppress", "low_confidence"), "m": ("summary", None)}


def test_penalty_never_raises_tier(spark):
    f = _findings(spark, [_row("p", 1, "h", 0.94, sem=True), _row("q", 1, "h2", 0.5, sem=True)])
    # a row whose stated tier is below its score's tier must not be raised
    f = f.withColumn("confidence_tier", F.when(F.col("id") == "q", "low").otherwise(F.col("confidence_tier")))
    out = {r.id: (r.confidence_score, r.confidence_tier) for r in T.confidence_penalty(f).collect()}
    assert out["p"] == (0.799, "medium")
    assert out["q"][1] == "low"


def test_triage_partitions_input(spark, sf_dir):
    from revlens.sources.views import views
    v = views(spark, sf_dir)
    t = T.triage(v.findings, v.pipeline_runs, v.dismissed_fingerprints)
    assert t.count() == v.findings.count()
    assert t.select("id").distinct().count() == v.findings.count()
    assert t.filter(~F.col("decision").isin("inline", "summary", "suppress")).count() == 0
    assert t.filter((F.col("decision") == "suppress") & F.col("suppression_reason").isNull()).count() == 0
