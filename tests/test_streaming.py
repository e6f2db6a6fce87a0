"""Streams over tables of several part files: every batch counts, repeats are stored once."""
import pytest
from pyspark.sql import functions as F

from revlens.registry import QUERIES
from revlens.streaming.streams import run_to_table, read_stream, _new_keys


@pytest.fixture(scope="module")
def parts_dir(spark, tmp_path_factory):
    """sf0.001 with the streamed tables as folders of three part files."""
    out = tmp_path_factory.mktemp("parts")
    for t, time in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate")):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        one, two = df.select(F.percentile_approx(F.unix_timestamp(F.col(time).cast("timestamp")), [0.3, 0.6])).first()[0]
        at = F.unix_timestamp(F.col(time).cast("timestamp"))
        for part in (at < one, (at >= one) & (at < two), at >= two):  # in order of time, as a feed would come
            df.where(part).coalesce(1).write.mode("append").parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["stream_pr_events", "stream_reactions", "stream_scorecard", "stream_posting_retry",
                                  "stream_stale_runs", "stream_posting_offers", "stream_scorecards", "stream_upsert_pull_requests"])
def test_several_files_give_the_rows_of_one(spark, sf_dir, parts_dir, name):
    rows = lambda d: sorted(map(str, QUERIES[name](spark, d).collect()))
    got = rows(parts_dir)
    assert got == rows(sf_dir) and got


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_stream(spark, str(tmp_path), "orders")


def test_redelivery_and_resume(spark, tmp_path):
    """A key that comes again in a later batch or a later run of the same folder is not stored twice."""
    src, folder = str(tmp_path / "t.parquet"), str(tmp_path / "run")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long").coalesce(1)
    rows(1, 2, 2).write.parquet(src)
    run = lambda: sorted(r.k for r in run_to_table(
        read_stream(spark, str(tmp_path), "t"), "t", batch_fn=_new_keys(["k"]), folder=folder).collect())
    assert run() == [1, 2]
    rows(2, 3).write.mode("append").parquet(src)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]
    assert spark.read.parquet(folder + "/out").agg(F.count_distinct("batch_id")).first()[0] == 2
