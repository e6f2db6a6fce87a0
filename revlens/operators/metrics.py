"""Scorecards and aggregations.

Every metric is a grouped aggregation with conditional counts; Spark combines
them map-side before the shuffle.  Where two fact tables meet (D9, D13) each
is pre-aggregated to the join key first, so the join never fans out.
Trailing windows take ``as_of`` as a Column (a scalar subquery by default:
the newest timestamp of the table), never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEVERITIES


def newest(df: DataFrame, col: str = "created_at") -> Column:
    """Default ``as_of``: the newest timestamp of a table, as a scalar subquery."""
    return df.select(F.max(col)).scalar()


def _since(col: str, as_of: Column, days: int) -> Column:
    return F.col(col) > as_of - F.expr(f"INTERVAL {days} DAYS")


def _rate(num: Column, den: Column, digits: int = 3) -> Column:
    return F.when(den > 0, F.round(num / den, digits))


def false_positive_rate(findings: DataFrame, events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """thumbs_down / reacted events over findings of the trailing window."""
    f = findings.filter(_since("created_at", as_of, days)).select(F.col("id").alias("finding_id"))
    j = f.join(events.select("finding_id", "event_type"), "finding_id")
    fp = F.count_if(F.col("event_type") == "thumbs_down")
    tot = F.count_if(F.col("event_type").isin("thumbs_up", "thumbs_down"))
    return j.agg(fp.alias("false_positives"), tot.alias("total_reacted"),
                 _rate(fp, tot).alias("false_positive_rate"))


def task_success_rate(tasks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Total, completed, failed and failure rate of recent tasks."""
    t = tasks.filter(_since("created_at", as_of, days))
    n = F.count(F.lit(1))
    failed = F.count_if(F.col("status") == "failed")
    return t.agg(n.alias("total_tasks"), F.count_if(F.col("status") == "completed").alias("completed"),
                 failed.alias("failed"), _rate(failed, n).alias("failure_rate"))


def findings_per_pr(prs: DataFrame, findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """D3: per recent PR: total, high, medium and posted findings (0 when none).

    Findings are pre-aggregated per PR, then left-joined: no fan-out."""
    per = findings.groupBy("pull_request_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("confidence_tier") == "high").alias("high_confidence"),
        F.count_if(F.col("confidence_tier") == "medium").alias("medium_confidence"),
        F.count_if(F.col("posted_at").isNotNull()).alias("posted"))
    p = prs.filter(_since("created_at", as_of, days)).select(
        F.col("id").alias("pull_request_id"), "repo_full_name", "pr_number")
    out = p.join(per, "pull_request_id", "left").fillna(
        0, ["total_findings", "high_confidence", "medium_confidence", "posted"])
    return out.orderBy(F.col("total_findings").desc(), "pull_request_id")


def tier_distribution(findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Count, mean and sample stddev of the score per tier."""
    return findings.filter(_since("created_at", as_of, days)).groupBy("confidence_tier").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("confidence_score"), 3).alias("avg_score"),
        F.round(F.stddev_samp("confidence_score"), 3).alias("stddev_score"))


def model_usage(findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Calls, token sums and mean tokens per call by model."""
    return findings.filter(_since("created_at", as_of, days)).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("prompt_tokens").cast("bigint").alias("total_prompt_tokens"),
        F.sum("completion_tokens").cast("bigint").alias("total_completion_tokens"),
        F.round(F.avg(F.col("prompt_tokens") + F.coalesce(F.col("completion_tokens"), F.lit(0))))
        .alias("avg_tokens_per_call"))


def addressed_status(findings: DataFrame) -> Column:
    """Q5: boolean flag -> 3-state status (false unaddressed, true likely_addressed)."""
    return F.when(F.col("addressed_in_next_commit"), "likely_addressed").otherwise("unaddressed")


def addressed_counts(findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Findings per addressed status."""
    return (findings.filter(_since("created_at", as_of, days))
            .groupBy(addressed_status(findings).alias("addressed_status"))
            .agg(F.count(F.lit(1)).alias("count")))


def task_stats(tasks: DataFrame) -> DataFrame:
    """total/completed/failed tasks per run."""
    return tasks.groupBy("pipeline_run_id").agg(
        F.count(F.lit(1)).alias("tasks_total"),
        F.count_if(F.col("status") == "completed").alias("tasks_completed"),
        F.count_if(F.col("status") == "failed").alias("tasks_failed"))


def reactions(events: DataFrame) -> DataFrame:
    """Thumbs up / down per finding."""
    return events.filter(F.col("event_type").isin("thumbs_up", "thumbs_down")).groupBy("finding_id").agg(
        F.count_if(F.col("event_type") == "thumbs_up").alias("thumbs_up"),
        F.count_if(F.col("event_type") == "thumbs_down").alias("thumbs_down"))


def run_stats(runs: DataFrame, tasks: DataFrame, findings: DataFrame) -> DataFrame:
    """Six counters per run from two pre-aggregations (never join, then count)."""
    t = task_stats(tasks).withColumnRenamed("pipeline_run_id", "id")
    f = findings.groupBy(F.col("pipeline_run_id").alias("id")).agg(
        F.count(F.lit(1)).alias("findings_total"),
        F.count_if(F.col("posted_at").isNotNull()).alias("findings_posted"),
        F.count_if(F.col("suppression_reason").isNotNull()).alias("findings_suppressed"))
    cols = ["tasks_total", "tasks_completed", "tasks_failed", "findings_total", "findings_posted",
            "findings_suppressed"]
    out = runs.select("id", "status").join(t, "id", "left").join(f, "id", "left").fillna(0, cols)
    return out.withColumn("task_count", F.col("tasks_total").cast("int")) \
        .withColumn("finding_count", F.col("findings_total").cast("int"))


def severity_tally(findings: DataFrame) -> DataFrame:
    """Counts per severity for each PR, zero-filled (fixed pivot values)."""
    return findings.groupBy("pull_request_id").pivot("severity", SEVERITIES).agg(
        F.count(F.lit(1))).fillna(0, SEVERITIES)


def review_coverage(tasks: DataFrame) -> DataFrame:
    """Reviewed / total distinct symbols per run and failed task count."""
    sym = F.concat_ws("\x00", F.col("file_path"), F.coalesce(F.col("symbol"), F.lit("")))
    return tasks.groupBy("pipeline_run_id").agg(
        F.count_distinct(sym).alias("symbols_total"),
        F.count_distinct(F.when(F.col("status") == "completed", sym)).alias("symbols_reviewed"),
        F.count_if(F.col("status") == "failed").alias("tasks_failed"))


def suppression_breakdown(findings: DataFrame) -> DataFrame:
    """Suppressed findings per PR and reason."""
    return findings.filter(F.col("suppression_reason").isNotNull()) \
        .groupBy("pull_request_id", "suppression_reason").agg(F.count(F.lit(1)).alias("count"))


def replay_cohorts(runs: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """Metrics per (prompt_version, config_hash): runs, findings, reactions."""
    r = reactions(events)
    f = findings.select(F.col("id").alias("finding_id"), "pipeline_run_id", "posted_at") \
        .join(r, "finding_id", "left")
    per_run = f.groupBy(F.col("pipeline_run_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("posted_at").isNotNull()).alias("n_posted"),
        F.sum(F.coalesce("thumbs_up", F.lit(0))).alias("n_up"),
        F.sum(F.coalesce("thumbs_down", F.lit(0))).alias("n_down"))
    j = runs.select("id", "prompt_version", "config_hash").join(per_run, "id", "left")
    return j.groupBy("prompt_version", "config_hash").agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).cast("bigint").alias("findings"),
        F.coalesce(F.sum("n_posted"), F.lit(0)).cast("bigint").alias("posted"),
        F.coalesce(F.sum("n_up"), F.lit(0)).cast("bigint").alias("thumbs_up"),
        F.coalesce(F.sum("n_down"), F.lit(0)).cast("bigint").alias("thumbs_down"))


def labelled_eval(scored: DataFrame, labels: DataFrame, flag_col: str, label_col: str,
                  cost_col: str | None = None) -> DataFrame:
    """Precision, recall (and cost per true finding) of a flag against labels.

    ``scored`` has doc_id and a boolean flag; ``labels`` has doc_id and a 0/1
    label.  Only labelled items count.
    """
    j = scored.join(labels.select("doc_id", F.col(label_col).alias("_y")), "doc_id")
    tp = F.count_if(F.col(flag_col) & (F.col("_y") == 1))
    fp = F.count_if(F.col(flag_col) & (F.col("_y") == 0))
    fn = F.count_if(~F.col(flag_col) & (F.col("_y") == 1))
    aggs = [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
            _rate(tp, tp + fp, 4).alias("precision"), _rate(tp, tp + fn, 4).alias("recall")]
    if cost_col:
        aggs.append(_rate(F.sum(cost_col), tp, 4).alias("cost_per_tp"))
    return j.agg(*aggs)


def latency_p95(runs: DataFrame, sizes: DataFrame, p: float = 0.95) -> DataFrame:
    """Exact percentile of run duration (seconds) per PR size class."""
    d = runs.filter(F.col("completed_at").isNotNull()).select(
        "id", (F.unix_timestamp(F.col("completed_at").cast("timestamp")) -
               F.unix_timestamp(F.col("started_at").cast("timestamp"))).alias("duration_s"))
    s = sizes.select(F.col("pull_request_id").alias("id"),
                     F.when((F.col("changed_lines") < 200) & (F.col("changed_functions") < 10), "median_pr")
                     .otherwise("large_pr").alias("size_class"))
    # counts per (class, second), then positions by a running sum over that small table:
    # exact, and no class's durations are held in one buffer
    n = d.join(s, "id").filter(F.col("duration_s").isNotNull()).groupBy("size_class", "duration_s") \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("size_class")
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("duration_s"))).withColumn("runs", F.sum("n").over(w))
    at = (F.col("runs") - 1) * p
    value = lambda place: F.min(F.when(F.col("upto") > place, F.col("duration_s")))
    return n.groupBy("size_class", "runs").agg(
        value(F.floor(at)).alias("low"), value(F.ceil(at)).alias("high")).select(
        "size_class", "runs", (F.col("low") + (F.col("high") - F.col("low")) * (
            (F.col("runs") - 1) * p - F.floor((F.col("runs") - 1) * p))).alias("p95_duration_s"))


def presumed_true_positives(prs: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings on merged PRs that never got a thumbs_down, per repo."""
    merged = prs.filter(F.col("state") == "merged").select(F.col("id").alias("pull_request_id"))
    down = events.filter(F.col("event_type") == "thumbs_down").select(F.col("finding_id").alias("id"))
    f = findings.join(merged, "pull_request_id", "left_semi") \
        .join(down, "id", "left_anti")
    return f.groupBy("repo_full_name").agg(F.count(F.lit(1)).alias("presumed_tp"))


def dismissal_rate(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Posted findings that were dismissed (thumbs_down or dismissed event) / posted."""
    dis = events.filter(F.col("event_type").isin("thumbs_down", "dismissed")) \
        .select(F.col("finding_id").alias("id")).distinct().withColumn("_d", F.lit(True))
    f = findings.filter(F.col("posted_at").isNotNull()).join(dis, "id", "left")
    posted = F.count(F.lit(1))
    d = F.count_if(F.coalesce(F.col("_d"), F.lit(False)))
    return f.groupBy("repo_full_name").agg(posted.alias("posted"), d.alias("dismissed"),
                                           _rate(d, posted, 4).alias("dismissal_rate"))


def config_drift(runs: DataFrame) -> DataFrame:
    """Config hashes seen with more than one metadata snapshot."""
    return runs.groupBy("config_hash").agg(
        F.count_distinct("metadata").alias("snapshots"), F.count(F.lit(1)).alias("runs")) \
        .filter(F.col("snapshots") > 1)
