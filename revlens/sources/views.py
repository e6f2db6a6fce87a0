"""Domain tables derived from the driver tables.

The review pipeline's relations (pull_requests, pipeline_runs, review_tasks,
findings, finding_events, dismissed_fingerprints) are built from the TPC-H-like
driver tables by fixed, documented rules, so every operator runs over data
whose volume grows with the scale factor.  All expressions are native and
row-local except ``review_tasks`` (one aggregation on the line key) and
``finding_events`` (one aggregation per PR, then a join).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES, SEVERITIES, TASK_TYPES
from ..functions.hashing import location_hash
from ..functions.scoring import route_model, tier_from_score
from .tables import read_table

# ---------------------------------------------------------------------------
# FIXED VALUES of the test-data mapping (shared with the SQL oracle)
# ---------------------------------------------------------------------------
FILE_PATHS = ["internal/auth/token.go", "api/handler/user.py", "cmd/main.go",
              "deploy/helm/values.yaml", "pkg/util/strings.ts", "migration/0001.php"]
EVENT_TYPE_MAP = {"click": "thumbs_up", "error": "thumbs_down", "purchase": "posted",
                  "signup": "created", "view": "suppressed"}
N_REPOS = 25
HEADS_PER_PR = 3
# ---------------------------------------------------------------------------


def pick(values: list[str], idx) -> F.Column:
    """values[idx] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def s(x) -> F.Column:
    return x.cast("string")


def repo_of(order_key) -> F.Column:
    return F.concat(F.lit("org/repo-"), s(F.floor(order_key / HEADS_PER_PR) % N_REPOS))


def head_sha_of(order_key) -> F.Column:
    return F.md5(F.concat(F.lit("h"), s(order_key)))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pull_requests_from(read_table(spark, sf_dir, "orders"))


def pull_requests_from(o: DataFrame) -> DataFrame:
    """Row-local, so it serves batch and streaming ``orders`` alike."""
    k = F.col("o_orderkey")
    ext = F.floor(k / HEADS_PER_PR).cast("bigint")
    return o.select(
        k.alias("id"),
        ext.alias("external_pr_id"),
        ext.cast("int").alias("pr_number"),
        repo_of(k).alias("repo_full_name"),
        head_sha_of(k).alias("head_sha"),
        F.md5(F.concat(F.lit("b"), s(k))).alias("base_sha"),
        F.concat(F.lit("user-"), s(F.col("o_custkey"))).alias("author"),
        F.when(F.col("o_orderstatus") == "O", "open")
         .when(F.col("o_orderstatus") == "F", "merged").otherwise("closed").alias("state"),
        F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('"}')).alias("metadata"),
        F.when(k % 97 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("deleted_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_runs_from(read_table(spark, sf_dir, "orders"))


def pipeline_runs_from(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "running") \
        .when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("completed")
    return o.select(
        k.alias("id"),
        k.alias("pull_request_id"),
        head_sha_of(k).alias("head_sha"),
        status.alias("status"),
        F.when(k % 2 == 0, "v1").otherwise("v2").alias("prompt_version"),
        F.md5(F.concat(F.lit("c"), s(F.col("o_custkey") % 3))).alias("config_hash"),
        F.lit(0).alias("task_count"),
        F.lit(0).alias("finding_count"),
        F.when(status == "failed", F.lit("provider error")).alias("error"),
        F.concat(F.lit('{"config":"c'), s(F.col("o_custkey") % 3), F.lit('","routing":"'),
                 F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), "r2")
                 .otherwise("r1"), F.lit('"}')).alias("metadata"),
        F.col("o_orderdate").alias("started_at"),
        F.when(status != "running", F.col("o_orderdate") + F.expr("INTERVAL 1 DAYS"))
         .alias("completed_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.col("l_suppkey") % 4).alias("tt"),
        F.min("l_tax").alias("min_tax"),
        F.max(F.round(F.col("l_tax") * 12, 2)).alias("risk_score"),
        F.min(F.col("l_partkey") % 6).alias("fp"),
        F.min("l_shipdate").alias("created_at"),
    )
    status = F.when(F.col("min_tax") >= 0.07, "failed").when(F.col("min_tax") >= 0.06, "pending") \
        .when(F.col("min_tax") >= 0.055, "running").otherwise("completed")
    task_type = pick(TASK_TYPES, F.col("tt"))
    return g.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("pull_request_id"),
        F.col("l_orderkey").alias("pipeline_run_id"),
        task_type.alias("task_type"),
        pick(FILE_PATHS, F.col("fp")).alias("file_path"),
        F.when(F.col("fp") != 3, F.concat(F.lit("Fn"), s(F.col("fp")))).alias("symbol"),
        F.col("risk_score"),
        route_model(task_type).alias("model_id"),
        status.alias("status"),
        F.when(status == "failed", F.lit("provider error")).alias("error"),
        F.when(status != "pending", F.col("created_at")).alias("started_at"),
        F.when(status.isin("completed", "failed"), F.col("created_at") + F.expr("INTERVAL 1 HOURS"))
         .alias("completed_at"),
        F.col("created_at"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_from(read_table(spark, sf_dir, "lineitem"))


def findings_from(li: DataFrame) -> DataFrame:
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    qty = F.floor(F.col("l_quantity")).cast("int")
    fidx = pk % 6
    file_path = pick(FILE_PATHS, fidx)
    symbol = F.when(fidx == 3, F.lit("")).otherwise(F.concat(F.lit("Fn"), s(fidx)))
    category = pick(CATEGORIES, sk % 5)
    repo = repo_of(ok)
    score = F.round(F.col("l_discount") * 10, 2)
    start_line = F.when(pk % 9 == 0, F.lit(None).cast("int")).otherwise(qty)
    posted = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 1 DAYS"))
    return li.select(
        F.concat_ws("-", s(ok), s(ln), s(pk), s(sk), s(qty)).alias("id"),
        (ok * 10 + ln).alias("review_task_id"),
        ok.alias("pull_request_id"),
        ok.alias("pipeline_run_id"),
        repo.alias("repo_full_name"),
        head_sha_of(ok).alias("head_sha"),
        file_path.alias("file_path"),
        start_line.alias("start_line"),
        (start_line + ln % 3).alias("end_line"),
        symbol.alias("symbol"),
        category.alias("category"),
        tier_from_score(score).alias("confidence_tier"),
        score.alias("confidence_score"),
        pick(SEVERITIES, ln % 5).alias("severity"),
        F.concat(category, F.lit(" issue in "), file_path).alias("title"),
        F.concat(F.lit("Review "), symbol, F.lit(" at line "),
                 F.coalesce(s(start_line), F.lit("?"))).alias("body"),
        F.when(pk % 4 == 0, F.concat(F.lit("return "), s(qty), F.lit(";"))).alias("suggestion"),
        location_hash(repo, file_path, symbol, category).alias("location_hash"),
        F.when(pk % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.md5(F.concat(F.lit("c"), s(fidx), F.lit("-"), s(qty % 3)))).alias("content_hash"),
        posted.alias("posted_at"),
        F.when(posted.isNotNull() & (ln % 2 == 0), ok * 10 + ln).alias("external_comment_id"),
        ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"))
        .alias("addressed_in_next_commit"),
        F.lit(None).cast("string").alias("suppression_reason"),
        (F.col("l_tax") >= 0.04).alias("used_semantic_context"),
        F.concat(F.lit("model-"), s(sk % 3)).alias("model_id"),
        F.floor(F.col("l_extendedprice") / 10).cast("int").alias("prompt_tokens"),
        F.when(ln == 7, F.lit(None).cast("int"))
         .otherwise(F.floor(F.col("l_quantity") * 10).cast("int")).alias("completion_tokens"),
        F.col("l_shipdate").alias("created_at"),
    )


def labelled_regions(f: DataFrame) -> DataFrame:
    """Labels of regions: for a third of the findings a region somewhat lower in the same file and
    change, half of them with another category."""
    k = F.col("prompt_tokens")
    return f.filter(k % 3 == 0).select(
        F.concat(F.lit("label-"), "id").alias("label_id"), F.floor(F.col("pull_request_id") / HEADS_PER_PR).alias("external_pr_id"),
        "repo_full_name", "file_path", F.when(k % 2 == 0, F.col("category")).otherwise("logic").alias("category"),
        (F.col("start_line") + k % 4).alias("start_line"), (F.col("end_line") + k % 4 + 6).alias("end_line"))


def receipts_from(li: DataFrame) -> DataFrame:
    """Receipts of posted comments, 0 to 4 days after posting; some come twice."""
    f = findings_from(li).where("posted_at is not null")
    late = F.pmod(F.col("prompt_tokens"), F.lit(5))
    one = f.select(F.col("id").alias("finding_id"), (F.col("posted_at") + F.make_dt_interval(days=late)).alias("received_at"))
    again = f.where("external_comment_id is not null").select(
        F.col("id").alias("finding_id"), (F.col("posted_at") + F.make_dt_interval(days=late + 2)).alias("received_at"))
    return one.unionByName(again)


def finding_events(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Events attached to the smallest finding id of PR ``event_id*7 % 1000``.

    The per-PR minimum is a partial (map-side) aggregation, so a PR holding
    many findings costs one row per task before the shuffle.
    """
    f = f if f is not None else findings(spark, sf_dir)
    return finding_events_from(read_table(spark, sf_dir, "events"), first_findings(f), pr_count(spark, sf_dir))


def pr_count(spark: SparkSession, sf_dir: str) -> Column:
    """Size of the range of PR ids, as a scalar subquery."""
    return read_table(spark, sf_dir, "orders").select(F.max("o_orderkey") + 1).scalar()


def events_without_finding(spark: SparkSession, sf_dir: str, f: DataFrame) -> DataFrame:
    """Events whose PR has no finding: what ``finding_events`` can't attach."""
    ev = read_table(spark, sf_dir, "events").select("event_id", _event_pr(pr_count(spark, sf_dir)))
    return ev.join(first_findings(f), "pull_request_id", "left_anti").select("event_id", "pull_request_id")


def _event_pr(prs: Column) -> Column:
    """Five events in a row belong to one PR, spread over the whole range of PR ids."""
    return (F.floor(F.col("event_id") / 5) * 7 % prs).cast("bigint").alias("pull_request_id")


def first_findings(f: DataFrame) -> DataFrame:
    return f.groupBy("pull_request_id").agg(F.min("id").alias("finding_id"))


def finding_events_from(ev: DataFrame, first: DataFrame, prs: Column) -> DataFrame:
    """Events joined to the first finding of their PR (stream-static join when
    ``ev`` is a stream)."""
    et = None
    for src, dst in EVENT_TYPE_MAP.items():
        et = F.when(F.col("event_type") == src, dst) if et is None else et.when(F.col("event_type") == src, dst)
    ev = ev.select(
        F.col("event_id").alias("id"),
        _event_pr(prs),
        et.alias("event_type"),
        F.concat(F.lit("user-"), s(F.col("user_id"))).alias("actor"),
        F.col("ts").alias("created_at"),
    )
    return ev.join(first, "pull_request_id").select(
        "id", "finding_id", "event_type", "actor",
        F.lit(None).cast("string").alias("old_value"),
        F.when(F.col("event_type") == "thumbs_up", "+1")
         .when(F.col("event_type") == "thumbs_down", "-1").alias("new_value"),
        F.lit("{}").alias("metadata"),
        "created_at",
    )


def dismissed_fingerprints(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    f = f if f is not None else findings(spark, sf_dir)
    return (f.filter((F.col("pull_request_id") % 50 == 0) & (F.col("category") != "security"))
            .groupBy("repo_full_name", "location_hash")
            .agg(F.min("created_at").alias("created_at"))
            .select(F.col("location_hash").alias("fingerprint"), "repo_full_name",
                    F.lit("maintainer").alias("dismissed_by"),
                    F.lit("not useful").alias("reason"), "created_at"))


class Views:
    """All domain tables of one scale-factor directory (lazy DataFrames)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def pull_requests(self) -> DataFrame:
        return pull_requests(self.spark, self.sf_dir)

    @cached_property
    def pipeline_runs(self) -> DataFrame:
        return pipeline_runs(self.spark, self.sf_dir)

    @cached_property
    def review_tasks(self) -> DataFrame:
        return review_tasks(self.spark, self.sf_dir)

    @cached_property
    def findings(self) -> DataFrame:
        return findings(self.spark, self.sf_dir)

    @cached_property
    def finding_events(self) -> DataFrame:
        return finding_events(self.spark, self.sf_dir, self.findings)

    @cached_property
    def dismissed_fingerprints(self) -> DataFrame:
        return dismissed_fingerprints(self.spark, self.sf_dir, self.findings)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)
