"""D14 on regions: findings are matched one to one with labelled regions, then counted.

A finding may match a label of the same change and file whose lines meet its own.  Pairs are
taken best first: same category before others, then more common lines, then the smaller
finding and label ids; a pair counts if neither side is taken yet.

The best-first order needs no sorted list: in a round every finding and every label names its
best free pair, and pairs named by both sides are what the list would have given them.
Rounds go on while pairs are left; each is two keyed aggregations and an equi join, so no change
or file is gathered anywhere, and its rest is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .code_index import RANGE_BUCKET_LINES, _buckets


def overlapping_pairs(findings: DataFrame, labels: DataFrame, keys: list[str], bucket: int = RANGE_BUCKET_LINES) -> DataFrame:
    """finding_id, label_id and ``rank`` (greater is better) of all pairs that may match.

    Both have the columns ``keys``, category, start_line, end_line; rows without a start line match nothing."""
    f = findings.filter("start_line is not null").select(
        *keys, "finding_id", F.col("category").alias("f_category"), F.col("start_line").alias("f_start"),
        F.greatest("start_line", "end_line").alias("f_end")).withColumn("b", _buckets(F.col("f_start"), F.col("f_end"), bucket))
    g = labels.filter("start_line is not null").select(
        *keys, "label_id", F.col("category").alias("l_category"), F.col("start_line").alias("l_start"),
        F.greatest("start_line", "end_line").alias("l_end")).withColumn("b", _buckets(F.col("l_start"), F.col("l_end"), bucket))
    pairs = f.join(g, [*keys, "b"]).filter(
        (F.col("f_start") <= F.col("l_end")) & (F.col("l_start") <= F.col("f_end"))
        & (F.col("b") == F.floor(F.greatest("f_start", "l_start") / bucket)))
    lines = F.least("f_end", "l_end") - F.greatest("f_start", "l_start") + 1
    same = F.coalesce(F.col("f_category") == F.col("l_category"), F.lit(False)).cast("int")
    return pairs.select("finding_id", "label_id", same.alias("same"), lines.alias("lines"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The matches (finding_id, label_id) of a best-first choice."""
    # least first: minus the ranks, then the ids
    order: Column = F.struct((-F.col("same")).alias("same"), (-F.col("lines")).alias("lines"), "finding_id", "label_id")
    ensure_checkpoint_dir(pairs.sparkSession)
    left, matches = pairs.select("finding_id", "label_id", order.alias("order")).checkpoint(), None
    while left.take(1):
        by_finding = left.groupBy("finding_id").agg(F.min("order").alias("order"))
        by_label = left.groupBy("label_id").agg(F.min("order").alias("order"))
        both = by_finding.select("order").join(by_label.select("order"), "order").select("order.finding_id", "order.label_id").checkpoint()
        matches = both if matches is None else matches.unionByName(both)
        left = left.join(both.select("finding_id"), "finding_id", "left_anti").join(both.select("label_id"), "label_id", "left_anti").checkpoint()
    return pairs.select("finding_id", "label_id").limit(0) if matches is None else matches


def matched_eval(findings: DataFrame, labels: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per ``group`` (a column of both): tp, fp, fn, precision, recall, and tokens spent per true positive.

    ``findings`` carry ``tokens``; a null counts as 0."""
    matches = one_to_one(overlapping_pairs(findings, labels, keys))
    f = findings.join(matches.select("finding_id", F.lit(1).alias("hit")), "finding_id", "left").groupBy(group).agg(
        F.count("hit").alias("tp"), (F.count(F.lit(1)) - F.count("hit")).alias("fp"), F.sum("tokens").alias("tokens"))
    g = labels.join(matches.select("label_id", F.lit(1).alias("hit")), "label_id", "left").groupBy(group).agg(
        (F.count(F.lit(1)) - F.count("hit")).alias("fn"))
    both = f.join(g, group, "full")
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn"))
    return both.select(group, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                       F.when(tp + fp > 0, F.round(tp / (tp + fp), 4)).alias("precision"),
                       F.when(tp + fn > 0, F.round(tp / (tp + fn), 4)).alias("recall"),
                       F.when(tp > 0, F.round(F.coalesce("tokens", F.lit(0)) / tp, 4)).alias("cost_per_tp"))
