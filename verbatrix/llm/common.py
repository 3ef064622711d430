"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse."""
    context, path = spark.sparkContext._jsc.sc(), spark.conf.get("spark.checkpoint.dir", None)
    if not path and context.getCheckpointDir().isDefined():
        path = context.getCheckpointDir().get()
    path = (path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_verbatrix").rstrip("/")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{_own_tables(spark)}/{what}-{uuid.uuid4().hex}"


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/verbatrix/{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder: its tables and checkpoints. Results that read them must be done with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    for path in (_own_tables(spark), *([checkpoints.get()] if checkpoints.isDefined() else [])):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    spark.sparkContext.setCheckpointDir(shared_dir(spark))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; also makes sure that the workers have this package."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id's decimal text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scored_batches(batches: Iterator[pa.RecordBatch], own: list[str], inputs: list[str], score: Callable[..., np.ndarray], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``own`` columns of each batch as they came, and ``score`` of the ``inputs``, of which ``rows`` at a time become Python values."""
    for batch in batches:
        values = [batch.column(c) for c in inputs]
        parts = [score(*(v.slice(lo, rows).to_pylist() for v in values)) for lo in range(0, len(batch), rows)]
        scores = pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), scores], [*own, "score"])
