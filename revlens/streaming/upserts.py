"""I1 into A4: a table of pull requests that a stream rewrites.

What A4 keeps of a key (the first row's identity, the last row's state) is a minimum and a
maximum by time, so it can be put together from parts in any order and any number of
times.  Every micro-batch writes the parts of its own rows (one per key) as a delta; every
``compact_every`` batches, base and deltas become one snapshot.  The table is the newest
snapshot with the deltas after it, put together by key: it equals A4 in one batch over all
rows, whatever the batches were, and whether some came twice.

A batch that is run again overwrites its own delta and snapshot and reads only snapshots of
earlier batches, which are complete, as batches follow each other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.maintenance import PR_FIRST, PR_KEY, PR_LAST
from .streams import new_folder


def parts_of(rows: DataFrame, source: int, updated_at: str) -> DataFrame:
    """One row per key: what A4 keeps of ``rows``; stored rows (source 0) come before all arriving ones (1)."""
    order: Column = F.struct(F.lit(source).alias("source"), F.col(updated_at).alias("at"), F.col("id").alias("id"))
    return put_together(rows.select(
        *PR_KEY, F.struct(order.alias("order"), *PR_FIRST).alias("first"),
        F.struct(order.alias("order"), *PR_LAST, F.col(updated_at).alias("updated_at")).alias("last")))


def put_together(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*PR_KEY).agg(F.min("first").alias("first"), F.max("last").alias("last"))


class PullRequestTable:
    """The table in ``folder``; ``base`` is what was stored before the stream."""

    def __init__(self, base: DataFrame, folder: str, compact_every: int = 8):
        self.spark, self.base, self.folder, self.compact_every = base.sparkSession, base, folder, compact_every

    def _stored(self, what: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{what}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def parts(self, before: int | None = None) -> DataFrame:
        """Parts of all batches, or of those before batch ``before`` and its own delta."""
        snapshots, deltas = self._stored("snapshots"), self._stored("deltas")
        newest = None
        if snapshots is not None:
            known = snapshots if before is None else snapshots.filter(F.col("upto") < before)
            newest = known.agg(F.max("upto")).first()[0]  # a partition column: no data is read
        found = parts_of(self.base, 0, "updated_at") if newest is None else snapshots.filter(F.col("upto") == newest).drop("upto")
        if deltas is not None:
            after = F.lit(True) if newest is None else F.col("batch_id") > newest
            until = F.lit(True) if before is None else F.col("batch_id") <= before
            found = found.unionByName(deltas.filter(after & until).drop("batch_id"))
        return put_together(found)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function; ``batch`` carries ``received_at``."""
        parts_of(batch, 1, "received_at").write.mode("overwrite").parquet(f"{self.folder}/deltas/batch_id={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.parts(batch_id).write.mode("overwrite").parquet(f"{self.folder}/snapshots/upto={batch_id}")

    def rows(self) -> DataFrame:
        return self.parts().select(*PR_KEY, *[F.col(f"first.{c}").alias(c) for c in PR_FIRST],
                                   *[F.col(f"last.{c}").alias(c) for c in (*PR_LAST, "updated_at")])


def stream_pull_requests(incoming: DataFrame, base: DataFrame, folder: str | None = None, compact_every: int = 8) -> DataFrame:
    """Runs the stream ``incoming`` to its end and returns the table; the same ``folder`` goes on where a run stopped."""
    table = PullRequestTable(base, folder or new_folder(base.sparkSession, "pull_requests"), compact_every)
    q = (incoming.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{table.folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table.rows()
