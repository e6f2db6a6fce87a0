"""Skew-tolerant ordered-window building blocks.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; if
one key holds a third of the data that task holds a third of the data.  The
helpers here split a key into (key, bucket) sub-groups, where ``bucket`` is a
coarse prefix of the sort order (a day of the timestamp, a severity level...).
The ordered work happens per sub-group; a tiny per-(key, bucket) summary table
carries state across bucket boundaries.  Results equal the plain window's.

Top-1 / latest-per-key never needs a window at all: ``max_by``/``min_by``
aggregations combine map-side, so a hot key costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: Sequence[str], newest: bool = True) -> DataFrame:
    """Top-1 row per key by ``order`` (F3/C1) via map-side-combined max_by/min_by."""
    # max/min over struct(order, values): lexicographic on the order fields first
    pick = F.max if newest else F.min
    agg = pick(F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v"))).alias("_top")
    return df.groupBy(*keys).agg(agg).select(*keys, *[F.col(f"_top.v.{v}").alias(v) for v in values])


def keyed_last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      values: Sequence[str], bucket: Column | None, include: Column | None = None,
                      prefix: str = "prev_", of_key: DataFrame | None = None,
                      carried: Column | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """For every row, ``values`` of the last earlier row of the same key (by
    ``order``, ascending) that satisfies ``include`` (all rows when None).

    ``bucket`` must be non-decreasing along ``order`` within a key (e.g. the day
    of the leading timestamp); ``None`` means the input already has a ``_bk``
    column (and may already be partitioned by (keys, _bk), which every step
    below then reuses without another shuffle).  The ordered pass runs per
    (key, bucket), so a hot key is spread over many tasks; a small per-(key, bucket) table of the
    last included row carries the answer across bucket boundaries.  Adds
    ``{prefix}{v}`` columns and ``{prefix}exists``.

    ``carried``: rows for which this doesn't hold get nothing from other buckets (null keys that
    the caller has replaced: keys that can't be null need no filter before the join).
    ``ties``: columns that go on where ``order`` ends.  Given all the columns wanted, the ordered
    pass and the small table need the same columns, so that one shuffle serves both.
    ``of_key``: a table with one row per value of one or more of the keys; its other columns
    are joined to the small table and reach the rows with it.
    """
    keys, order, values = list(keys), list(order), list(values)
    val = F.struct(*values)
    # dealt out once by (key, bucket): an aggregation left to itself would sort all rows before its shuffle as well
    d0 = df.withColumn("_bk", bucket).repartition(*keys, "_bk") if bucket is not None else df
    d0 = d0.withColumn("_v", val if include is None else F.when(include, val))
    w = Window.partitionBy(*keys, "_bk").orderBy(*order, *ties)
    d = d0.withColumn("_in", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # one row per (key, bucket) -- also for buckets without an included row,
    # so the carry reaches every bucket; max_by skips rows whose order is NULL
    place = F.struct(*order)
    if ties:
        d0, place = d0.withColumn("_place", F.row_number().over(w)), F.col("_place")
    last = (d0.groupBy(*keys, "_bk")
            .agg(F.max(F.when(F.col("_v").isNotNull(),
                              F.struct(place.alias("o"), F.col("_v").alias("v")))).alias("_m"))
            .select(*keys, "_bk", F.col("_m.v").alias("_last")))
    carry = last.select(*keys, "_bk", F.last("_last", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry"))
    if of_key is not None:
        carry = carry.join(of_key, [k for k in keys if k in of_key.columns], "left")
    d = d.join(carry, [*keys, "_bk"], "left")
    d = d.withColumn("_p", F.coalesce("_in", "_carry" if carried is None else F.when(carried, F.col("_carry"))))
    for v in values:
        d = d.withColumn(f"{prefix}{v}", F.col(f"_p.{v}"))
    d = d.withColumn(f"{prefix}exists", F.col("_p").isNotNull())
    return d.drop("_bk", "_v", "_in", "_carry", "_p")


def keyed_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              values: Sequence[str], bucket: Column, prefix: str = "prev_") -> DataFrame:
    """Previous row's ``values`` within ``keys`` (``keyed_last_before`` of all rows)."""
    return keyed_last_before(df, keys, order, values, bucket, None, prefix)


def keyed_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   bucket_cols: Sequence[Column], bucket_desc: Sequence[bool],
                   name: str = "position") -> DataFrame:
    """1-based row_number within ``keys`` by ``order``, split by a bucket prefix.

    ``bucket_cols`` (sorted descending where ``bucket_desc``) must be a leading
    prefix of ``order``, so position = rows of earlier buckets + row_number
    inside the bucket.
    """
    keys = list(keys)
    bnames = [f"_pb{i}" for i in range(len(bucket_cols))]
    d = df
    for n, c in zip(bnames, bucket_cols):
        d = d.withColumn(n, c)
    w = Window.partitionBy(*keys, *bnames).orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w))
    counts = d.groupBy(*keys, *bnames).agg(F.count(F.lit(1)).alias("_n"))
    border = [F.col(n).desc() if desc else F.col(n) for n, desc in zip(bnames, bucket_desc)]
    before = counts.select(*keys, *bnames, (F.sum("_n").over(
        Window.partitionBy(*keys).orderBy(*border)
        .rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    d = d.join(before, [*keys, *bnames], "left")
    return d.withColumn(name, (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_rn")).cast("int")) \
        .drop("_rn", "_before", *bnames)


def keyed_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column,
                      bucket: Column, name: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` by ``order``, split by
    a bucket that is non-decreasing along the order: in-bucket window sum plus
    the total of earlier buckets (a window over the small per-bucket table)."""
    keys = list(keys)
    d = df.withColumn("_rb", bucket).withColumn("_val", value)
    w = Window.partitionBy(*keys, "_rb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("_val").over(w))
    per = d.groupBy(*keys, "_rb").agg(F.sum("_val").alias("_tot"))
    before = per.select(*keys, "_rb", F.sum("_tot").over(
        Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    d = d.join(before, [*keys, "_rb"], "left")
    return d.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_in")) \
        .drop("_rb", "_val", "_in", "_before")
