"""Conflict-constrained best-fit packing (operator 3).

Documents are packed into bins of ``capacity`` tokens. A bin never holds two documents of one
source, nor two of one duplicate cluster. Pieces are placed in order of falling size; the open bins
stand in order of their free space and carry one bitmap of the sources and one of the duplicate
clusters they hold. The search starts at the first bin with room (the tightest) and goes on to its
successors until a bin is compatible, so every piece gets the tightest compatible bin; if there is
none, a bin is opened.

Documents longer than a bin are cut: all full cuts fill a bin of their own, and the rest is packed
like any other piece. Nothing is dropped or shortened.

The documents are dealt to shards by a hash, about ``shard_docs`` to a shard, so a hot source or a
large group of copies is spread over all shards and each shard is one bounded task. Bins do not
cross shards; at thousands of pieces a shard, what a larger one would save is small.

Defined results: a null source or cluster conflicts with nothing; a null or negative length counts
as 0 and still gets a bin; equal lengths go in order of doc_id (null first) and cluster; repeated
rows are separate documents; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, known_id, null_id

PACKED = ("doc_id long, piece int, start_token long, n_tokens long, bin_id long, bin_tokens long, "
          "source string, cluster string")


class Bins:
    """Open bins of one shard in order of free space."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (free space, bin)
        self.free: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def open(self) -> int:
        b = len(self.free)
        self.free.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        insort(self.order, (self.capacity, b))
        return b

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The tightest bin with room and without a conflict; bitmaps of the piece as given."""
        for _, b in self.order[bisect_left(self.order, (size, -1)):]:
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                return b
        return None

    def put(self, b: int, size: int, source: int, cluster: int) -> None:
        del self.order[bisect_left(self.order, (self.free[b], b))]
        self.free[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if self.free[b] > 0:  # a full bin takes only pieces of size 0, which open or find others
            insort(self.order, (self.free[b], b))


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one shard; columns as PACKED, ``bin_id`` counted inside the shard."""
    pdf = pdf.sort_values(["n_tokens", "doc_id", "cluster"], ascending=[False, True, True],
                          na_position="first", kind="stable")
    source_bit = {s: 1 << i for i, s in enumerate(pdf["source"].dropna().unique())}
    met = pdf["cluster"].dropna().value_counts()
    # A cluster with one member here can conflict with nothing here.
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(met.index[met > 1]))}
    bins, rows, rests = Bins(capacity), [], []
    for doc_id, source, cluster, n in zip(pdf["doc_id"], pdf["source"], pdf["cluster"],
                                          pdf["n_tokens"].astype("int64"), strict=True):
        source, cluster = (x if isinstance(x, str) else None for x in (source, cluster))
        full = n // capacity
        for piece in range(full):
            b = bins.open()
            bins.put(b, capacity, 0, 0)
            rows.append((doc_id, piece, piece * capacity, capacity, b, source, cluster))
        if n % capacity or not full:
            rests.append((n - full * capacity, doc_id, full, source, cluster))
    for size, doc_id, piece, source, cluster in sorted(rests, key=lambda r: -r[0]):
        bits = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        b = bins.find(size, *bits)
        if b is None:
            b = bins.open()
        bins.put(b, size, *bits)
        rows.append((doc_id, piece, piece * capacity, size, b, source, cluster))
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "start_token", "n_tokens", "bin_id",
                                      "source", "cluster"])
    out["bin_tokens"] = capacity - out["bin_id"].map(dict(enumerate(bins.free)))
    return out


def word_tokens(text: Column) -> Column:
    """Length of a text in tokens: its words and one end mark."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def best_fit_pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 4096) -> DataFrame:
    """Pack ``docs`` (doc_id, source, cluster, n_tokens); see the module's description."""
    bound_batches(docs.sparkSession)
    n_shards = max(1, -(-docs.count() // shard_docs))
    wanted = docs.select(
        known_id(), F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("string").alias("cluster"),
        F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "n_tokens"), F.lit(n_shards)).alias("shard")

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf, capacity)
        out["bin_id"] += int(key[0]) << 32
        return out[[c.split()[0] for c in PACKED.split(", ")]]

    return wanted.select("*", shard).groupBy("shard").applyInPandas(pack, PACKED).withColumn("doc_id", null_id())


def with_lengths(docs: DataFrame) -> DataFrame:
    """What best_fit_pack reads, from documents: exact copies of a text form a duplicate cluster."""
    return docs.select("doc_id", "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster"),
                       word_tokens(F.col("text")).alias("n_tokens"))
