"""I1 into A4: the streamed table equals A4 in one batch, in any order of rows, with batches run again."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from revlens.operators import maintenance as M
from revlens.streaming.upserts import PullRequestTable, stream_pull_requests

SCHEMA = ("external_pr_id long, head_sha string, id long, repo_full_name string, pr_number int, base_sha string, author string, "
          "deleted_at timestamp, created_at timestamp, state string, metadata string, updated_at timestamp")
T0 = datetime(2024, 1, 1)


def row(pr, head, no, hours, state):
    at = T0 + timedelta(hours=hours)
    return (pr, head, no, "org/r", pr, None, None, None, at, state, f'{{"n":{no}}}', at)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(9)
    base = [row(k, "a", k, k, "open") for k in range(20)]
    new = [row(random.randrange(30), random.choice("ab"), 100 + k, random.randrange(48), random.choice(["open", "merged", "closed"]))
           for k in range(200)]
    new += new[:10]  # deliveries that come twice
    return spark.createDataFrame(base, SCHEMA), new


def incoming(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("updated_at", "received_at")


def shown(df):
    return sorted(map(str, df.select(*M.PR_KEY, *M.PR_FIRST, *M.PR_LAST, "updated_at").collect()))


@pytest.mark.parametrize("compact_every", [1, 3, 100])
def test_equals_one_batch(spark, tables, tmp_path, compact_every):
    base, new = tables
    parts = [new[k:k + 30] for k in range(0, len(new), 30)]
    random.seed(compact_every)
    random.shuffle(parts)  # an older event may come later
    for n, p in enumerate(parts):
        incoming(spark, p).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    source = lambda: spark.readStream.schema(incoming(spark, new).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    want = shown(M.upsert_pull_requests(base, incoming(spark, new)))
    assert shown(stream_pull_requests(source(), base, f"{tmp_path}/run", compact_every)) == want
    late = [row(3, "a", 999, 90, "closed")]
    incoming(spark, late).coalesce(1).write.parquet(f"{tmp_path}/in/n=99")
    assert shown(stream_pull_requests(source(), base, f"{tmp_path}/run", compact_every)) == shown(
        M.upsert_pull_requests(base, incoming(spark, new + late)))  # the same folder goes on


def test_a_batch_that_is_run_again_changes_nothing(spark, tables, tmp_path):
    base, new = tables
    t = PullRequestTable(base, str(tmp_path), 2)
    for n in range(4):
        t.apply(incoming(spark, new[50 * n:50 * n + 50]), n)
        if n in (1, 2):
            t.apply(incoming(spark, new[50 * n:50 * n + 50]), n)  # after its snapshot, and after a later one
    assert shown(t.rows()) == shown(M.upsert_pull_requests(base, incoming(spark, new[:200])))
    assert sorted(r.upto for r in spark.read.parquet(f"{tmp_path}/snapshots").select("upto").distinct().collect()) == [1, 3]


def test_no_rows(spark, tables, tmp_path):
    base, _ = tables
    assert shown(PullRequestTable(base, str(tmp_path)).rows()) == shown(base.withColumn("x", F.lit(1)))
