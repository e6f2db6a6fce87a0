"""Helpers shared by the text operators: table access, batches of bounded size, shared folders."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import ensure_checkpoint_dir

#: Characters of text a Python worker holds at once beside the Arrow batch it was handed.
CHARS_PER_SLICE = 2_000_000
#: Rows of one Arrow batch; documents can be long, so fewer than Spark's default.
ROWS_PER_BATCH = 2_000
#: Stands for a null id inside Python tasks; the smallest long, so that it sorts first like a null.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_at(folder: str):
    """File system and path of a folder of the shared storage, for any process of the cluster."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{Path(folder).absolute()}")


def ship_package(spark: SparkSession) -> None:
    """Hand this library to the executors' Python workers, once per application."""
    if any(f.endswith("/revlens.zip") for f in spark.sparkContext.listFiles):
        return
    top, buffer = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    folder = run_folder(spark, "library")
    store, root = store_at(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/revlens.zip") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/revlens.zip")


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def known_id(column: str = "doc_id") -> Column:
    """A long id without nulls for pandas, which would turn the column into floats."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def null_id(column: str = "doc_id") -> Column:
    """Undo ``known_id``."""
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts the lineage."""
    path = run_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 rows of a null id belong to no learning fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(batches: Iterable[pd.DataFrame], text: str = "text",
           chars: int = CHARS_PER_SLICE) -> Iterator[pd.DataFrame]:
    """Each batch in consecutive slices of about ``chars`` characters; a longer text is alone."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[text].str.len().fillna(0).to_numpy().cumsum()
        part = (size - 1).clip(0) // chars
        for _, rows in pdf.groupby(part, sort=False):
            yield rows
