"""The hot-key-safe window helpers equal the plain windows they replace."""
import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.operators.windows import keyed_last_before, keyed_position, latest_per_key


def _data(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{rnd.randint(0, 50)}"   # one key holds two thirds of the rows
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 30))
        rows.append((f"id{i:05d}", key, ts, rnd.randint(0, 9), rnd.random() < 0.7))
    return spark.createDataFrame(rows, "id string, k string, ts timestamp, v int, flag boolean")


def test_keyed_last_before_equals_window(spark):
    df = _data(spark)
    got = keyed_last_before(df, ["k"], ["ts", "id"], ["id", "v"], F.date_trunc("day", "ts"),
                            include=F.col("flag"), prefix="p_")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("_x", F.last(F.when(F.col("flag"), F.struct("id", "v")), ignorenulls=True).over(w))
    g = {r.id: (r.p_id, r.p_v) for r in got.collect()}
    e = {r.id: ((r._x.id, r._x.v) if r._x else (None, None)) for r in want.collect()}
    assert g == e


def test_keyed_position_equals_row_number(spark):
    df = _data(spark)
    order = [F.col("v").desc(), F.col("ts"), F.col("id")]
    got = keyed_position(df, ["k"], order, [F.col("v")], [True])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert {(r.id, r.position) for r in got.collect()} == {(r.id, r.rn) for r in want.collect()}


def test_latest_per_key_equals_top1(spark):
    df = _data(spark)
    got = {(r.k, r.id) for r in latest_per_key(df, ["k"], ["ts", "id"], ["id"]).collect()}
    w = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = {(r.k, r.id) for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}
    assert got == want


def test_keyed_running_sum_equals_window(spark):
    from revlens.operators.windows import keyed_running_sum
    df = _data(spark)
    order = [F.col("ts"), F.col("id")]
    got = keyed_running_sum(df, ["k"], order, F.col("v"), F.date_trunc("day", "ts"), "rs")
    want = df.withColumn("rs", F.sum("v").over(Window.partitionBy("k").orderBy(*order)
                                                 .rowsBetween(Window.unboundedPreceding, 0)))
    assert {(r.id, r.rs) for r in got.collect()} == {(r.id, r.rs) for r in want.collect()}
