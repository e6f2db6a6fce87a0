"""Embedding near-duplicates by binary codes with error bounds (operator 6).

Every vector is normed, rotated by random orthogonal matrices and reduced to the signs of its
coordinates. A code keeps one correction factor, the inner product f of the rotated unit vector
with its code's unit vector. For another unit vector q, <code, rotated q> / f estimates the cosine
without bias, with an error of sqrt((1 - f^2) / f^2) / sqrt(D - 1) in standard deviations. Pairs
whose estimate plus ``deviations`` times that is below the threshold are decided by their codes;
all others are computed exactly in double precision.

Which pairs meet: slices of ``bits`` signs are keys of several tables; pairs of one label that agree
in any table are compared, in the first such table only. ``bits`` grows with the logarithm of a
label's size so that the expected key group stays near ``group_rows``, and the number of tables
follows from it, so that a pair at the threshold meets with probability ``recall`` or more at every
size. Groups larger than ``block_rows`` are split into blocks, and each pair of blocks is a task of
its own, so no group is gathered.

Equal vectors of a label are one class before anything else; links between classes count with the
classes' sizes, so copies are never compared or expanded. A task gives each class's number of
links, and for the components one link per class to the smallest class it reaches in that task.

Defined results: rows with a null label, or a vector that is null, empty, zero or holds null or
non-finite components, have no links and are their own component; vectors of other lengths than the
query's dimension are not compared with it; a null vec_id is treated as an id below all others;
repeated rows are links of one another; different vectors under one vec_id are one node, whose links
are counted together; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id, stored
from revlens.llm.components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    recall: float = 0.997        # of pairs at the threshold, over all tables
    group_rows: int = 256        # expected rows of a key group
    block_rows: int = 256
    deviations: float = 4.0
    seed: int = 23


def layout(largest: int, s: Settings) -> tuple[int, int]:
    """Bits of a key and number of tables for a largest label of ``largest`` classes."""
    bits = max(1, math.ceil(math.log2(max(2, largest / s.group_rows))))
    agree = (1 - math.acos(s.threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - s.recall) / math.log(1 - agree)))


def rotations(dim: int, width: int, seed: int) -> np.ndarray:
    """Stacked random orthogonal matrices, at least ``width`` rows, scaled to keep lengths."""
    rng = np.random.default_rng(seed)
    blocks = max(1, -(-width // dim))
    q = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(blocks)]
    return np.concatenate(q) / math.sqrt(blocks)


def encode(unit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, signs (+1, -1) and correction factors."""
    turned = unit @ rotation.T
    signs = np.where(turned >= 0, 1.0, -1.0)
    return turned, signs, np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def links_between(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i of a, j of b) of all pairs of unit vectors at the threshold or above."""
    _, signs, f = encode(a, rotation)
    turned = b @ rotation.T
    width = rotation.shape[0]
    f = np.maximum(f, 1e-6)
    estimate = signs @ turned.T / (math.sqrt(width) * f[:, None])
    error = s.deviations * np.sqrt(np.maximum(1 - f * f, 0)) / f / math.sqrt(max(1, width - 1))
    i, j = np.nonzero(estimate + error[:, None] >= s.threshold)
    exact = np.einsum("ij,ij->i", a[i], b[j])
    keep = exact >= s.threshold
    return i[keep], j[keep]


def keys_of(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One whole number per table from that table's slice of signs."""
    bit = (signs[:, : bits * tables] > 0).reshape(len(signs), tables, bits)
    return bit @ (1 << np.arange(bits, dtype=np.int64))


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n rows, the smallest row number it reaches over links (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def near_duplicates(rows: DataFrame, s: Settings | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding, label)."""
    s = s or Settings()
    spark = rows.sparkSession
    bound_batches(spark)
    vector = F.col("embedding").cast("array<double>")
    fine = (F.col("label").isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(vector, lambda x: x != 0))
    own = rows.select(known_id("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("embedding"),
                      F.coalesce(fine, F.lit(False)).alias("fine"))
    # Two hashes of all components stand for the vector itself in joins.
    named = own.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")})
    key = ["label", "h1", "h2"]
    classes = stored(named.where("fine").groupBy(*key).agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"),
        F.first(F.size("embedding")).alias("dim")), "vector-classes")
    met = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    largest = met.groupBy("dim").agg(F.max("n").alias("n")).collect()  # one row per vector length
    found = [_links_of(classes.where(F.col("dim") == r["dim"]), r["dim"], r["n"], s) for r in largest]
    blank = spark.createDataFrame([], "id long, links long, root long")
    for f in found:
        blank = blank.unionByName(f)
    got = stored(blank, "vector-links")
    counts = got.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(got.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # A class's own id is its smallest vec_id; classes without links are not in the two tables.
    by_class = (classes.select(*key, "id", "copies").join(counts, "id", "left")
                .join(roots.withColumnRenamed("node", "id"), "id", "left"))
    return (named.where("fine").select("vec_id", *key).join(by_class, key)
            .select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                    F.coalesce("root", "id").alias("component_id"))
            .unionByName(named.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                        F.col("vec_id").alias("component_id")))
            .select(null_id("vec_id"), "n_links", null_id("component_id"),
                    (F.col("vec_id") == F.col("component_id")).alias("kept")))


def _links_of(classes: DataFrame, dim: int, largest: int, s: Settings) -> DataFrame:
    """(id, links, root) rows of all tasks for the classes of one vector length."""
    bits, tables = layout(largest, s)
    rotation = rotations(dim, max(128, bits * tables), s.seed)

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(keys_of(encode(unit_rows(vectors), rotation)[1], bits, tables)))

    rows = classes.select("label", "id", "copies", "embedding", keys("embedding").alias("keys"))
    rows = rows.select("*", F.posexplode("keys").alias("t", "key"))
    group = ["label", "t", "key"]
    # At most rows / block_rows groups are that large.
    large = rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > s.block_rows)
    split = rows.join(large, group, "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("n") / s.block_rows), F.lit(1)).cast("int"))
    split = split.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, copies, t = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), int(pdf["t"].iloc[0])
        unit, table_keys = unit_rows(pdf["embedding"]), np.stack(pdf["keys"].to_numpy())
        if int(pdf["low"].iloc[0]) == int(pdf["high"].iloc[0]):
            i, j = links_between(unit, unit, rotation, s)
            i, j = i[i < j], j[i < j]
        else:
            first = (pdf["block"] == pdf["low"]).to_numpy()
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(a) or not len(b):
                return pd.DataFrame({"id": [], "links": [], "root": []})
            i, j = links_between(unit[a], unit[b], rotation, s)
            i, j = a[i], b[j]
        if t:  # pairs that met in an earlier table were counted there
            new = ~(table_keys[i, :t] == table_keys[j, :t]).any(1)
            i, j = i[new], j[new]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        linked = links > 0
        root = smallest_reached(len(ids), i, j)
        return pd.DataFrame({"id": ids[linked], "links": links[linked].astype(np.int64), "root": ids[root[linked]]})

    return (split.select(*group, "low", "high", "block", "id", "copies", "embedding", "keys")
            .groupBy(*group, "low", "high").applyInPandas(compare, "id long, links long, root long"))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision; very large or small ones are
    scaled first so that their squares stay finite."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
