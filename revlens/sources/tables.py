"""Readers for the driver tables (A1).

Every reader goes through ``spark.read.parquet`` so Catalyst can push filters
and prune columns down to the scan.  Schemas are declared, never inferred from
data on the hot path.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, name)))


def spread(df: DataFrame) -> DataFrame:
    """For local runs over single-file tables: deal the rows out to as many
    partitions as ``spark.revlens.spread`` says, by all columns that can be
    hashed.  Unset (the default), the scan is left as it is."""
    n = int(df.sparkSession.conf.get("spark.revlens.spread", "0"))
    return df.repartition(n, *[c for c, kind in df.dtypes if not kind.startswith("map")]) if n else df


def grows(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: it is sorted and merged, never broadcast.  The planner
    takes a text built row by row for some twenty bytes and an exploded array for one row, so by its
    estimate whole tables of lines would go through the driver."""
    return df.hint("merge")


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A1: every driver table as a lazily-read DataFrame."""
    return {t: read_table(spark, sf_dir, t) for t in TABLES
            if os.path.exists(table_path(sf_dir, t))}
