"""A training-data pipeline over ``documents``.

``STAGES`` lists its (name, function) stages; each takes (spark, docs, sf_dir) and returns what it
keeps, with the columns of ``documents``; the last returns the bins. ``run`` writes every stage's
rows as Parquet into the shared folder and rereads them as the next one's input, so a stage is never
computed twice and a lost executor costs one stage at most.

Nulls and odd rows: a null text is scored as an empty one by the quality stage, has no language and
so goes in the second stage; in the third, a row without a doc_id is a copy like any other, and is
kept only if no row of its group has an id; rows that repeat id and text are one document there, but
rows without id and words all stay; empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import count_rtree, decontam, langid, packing, quality
from revlens.llm.common import fold, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates here: shingles of five words, Jaccard similarity of 0.8 or more.
NEAR = count_rtree.Settings(k=5, num=80, den=100)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 1) accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.keep_good(docs.select(*COLUMNS), model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which half the letters or more are of one learned language (operator 4)."""
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    return langid.keep_known(docs.select(*COLUMNS), model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates (operator 10)."""
    docs = docs.select(*COLUMNS)
    rows = stored(count_rtree.component_rows(docs, NEAR), "components")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    first = rows.where("root is not null").groupBy("root").agg(F.min(order).alias("kept"))
    copies = rows.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("t") == F.col("kept.t"))))
    copies = stored(copies.select(F.col("doc_id").alias("copy_id"), F.col("t").alias("copy_t")).distinct(), "copies")
    numbered = docs.withColumn("t", count_rtree.text_number())
    kept = numbered.join(copies, F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("t") == F.col("copy_t")), "left_anti")
    repeated = stored(rows.where("doc_id is not null or root is not null").groupBy("doc_id", "t").count().where("count > 1")
                      .select(F.col("doc_id").alias("copy_id"), F.col("t").alias("copy_t")), "repeated")
    if not repeated.take(1):
        return kept.select(*COLUMNS)
    again = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("t") == F.col("copy_t"))
    once = kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "t"])
    return kept.join(repeated, again, "left_anti").unionByName(once).select(*COLUMNS)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (operator 2)."""
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of all documents left, by constrained best fit (operator 3)."""
    return packing.best_fit_pack(packing.with_lengths(docs))


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each),
          ("decontamination", not_leaked), ("packing", packed)]

#: The learned models and hashes of the stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
