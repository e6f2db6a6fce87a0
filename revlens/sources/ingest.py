"""PR event ingest (A2, I1): webhook JSON -> normalised PR event rows.

The same function serves batch and streaming DataFrames: parsing is
``from_json`` with a declared schema, filtering and projection are native.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEBHOOK_SCHEMA = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("pull_request", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("head", T.StructType([T.StructField("sha", T.StringType())])),
        T.StructField("base", T.StructType([T.StructField("sha", T.StringType())])),
        T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    ])),
    T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
])

PR_EVENT_COLUMNS = ["repo_full_name", "pr_number", "external_pr_id", "head_sha", "base_sha",
                    "author", "action"]


def parse_webhook(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    p = F.from_json(F.col(payload_col), WEBHOOK_SCHEMA)
    return raw.withColumn("_p", p)


def ingest_pr_events(raw: DataFrame, actions=("opened", "synchronize"),
                     event_type_col: str = "event_type", payload_col: str = "payload") -> DataFrame:
    """A2: keep pull_request events with an accepted action; rows lacking the
    PR or the repository are rejected with a reason instead of dropped.

    Returns every input row once with ``outcome`` in (accepted, ignored,
    rejected), the reason, and the seven normalised fields.
    """
    d = parse_webhook(raw, payload_col)
    pr = F.col("_p.pull_request")
    reason = (F.when(F.col(event_type_col) != "pull_request", "ignored_event_type")
              .when(~F.coalesce(F.col("_p.action").isin(*actions), F.lit(False)), "ignored_action")
              .when(pr.isNull() | pr["id"].isNull(), "missing_pull_request")
              .when(F.col("_p.repository").isNull() | F.col("_p.repository.full_name").isNull(),
                    "missing_repository"))
    outcome = F.when(reason.isNull(), "accepted") \
        .when(reason.startswith("ignored"), "ignored").otherwise("rejected")
    keep = [c for c in raw.columns if c not in (payload_col, "_wrong_key")]
    return d.select(
        *keep,
        F.col("_p.repository.full_name").alias("repo_full_name"),
        pr["number"].alias("pr_number"),
        pr["id"].alias("external_pr_id"),
        pr["head"]["sha"].alias("head_sha"),
        pr["base"]["sha"].alias("base_sha"),
        pr["user"]["login"].alias("author"),
        F.col("_p.action").alias("action"),
        outcome.alias("outcome"),
        reason.alias("reason"),
    )
