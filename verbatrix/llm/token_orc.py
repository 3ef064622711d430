"""Token ids of documents in ORC files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import tokenizer

SCHEMA = "doc_id bigint, local_start bigint, n_tokens int, token_ids array<int>"


def _ids(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = tokenizer(path), 0
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                ids = encode.documents(texts.slice(lo, 256).to_pylist(), end_id)
                n = np.fromiter(map(len, ids), np.int32, len(ids))
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(ids).view("<i4")))
                yield pa.RecordBatch.from_arrays([docs.slice(lo, 256), pa.array(at + ends - n, pa.int64()), pa.array(n), lists], ["doc_id", "local_start", "n_tokens", "token_ids"])
                at += int(ends[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, *, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, stripe_mb: int = 16, row_index_stride: int = 1000) -> None:
    """Writes ``docs``' token ids, each with ``end_id`` appended, to ORC files under ``path`` in ascending order of ``key``.

    One range partitioning by key (equal keys by a hash of their texts); a task writes one range, to one file, or to several if the session limits the
    records of a file: doc_id, local_start (ids before the document in its range), n_tokens, token_ids. ORC run-length encodes the integers; each stripe has a row index of every
    ``row_index_stride`` rows and Bloom filters on doc_id, so that a reader skips files, stripes and row groups by
    statistics, and stripes of one file can be read by several tasks (:func:`read_tokens`).

    A null or empty text is just ``end_id``; null keys come first; repeated keys stay, in any order; texts of any
    length are one row; an empty table writes no rows; other columns are not read.
    """
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    writer = ordered.drop("tie").mapInArrow(_ids(tokenizer_path, end_id), SCHEMA).write.format("orc").mode("errorifexists")
    options = {"compression": "snappy", "orc.stripe.size": stripe_mb << 20, "orc.row.index.stride": row_index_stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.create.index": "true"}
    writer.options(**{k: str(v) for k, v in options.items()}).save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids`` (a list in the plan, so a short one) only those, pruned by the files' metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _task() -> Column:
    """The number of the task that wrote a file: names are compared as numbers, as from 100,000 tasks on they are longer."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(task, before): the ids in all ranges before each task's. One row a task; only n_tokens is read."""
    totals = spark.read.schema(SCHEMA).orc(path).select("n_tokens", _task().alias("task")).groupBy("task").agg(F.sum("n_tokens").alias("n"))
    return totals.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), batch.column(3)], ["doc_id", "local_start", "n_tokens", "ids_crc32", "task"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from the ids themselves."""
    rows = read_tokens(spark, path).select("doc_id", "local_start", "token_ids", _task().alias("task"))
    rows = rows.mapInArrow(_digests, "doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint, task bigint")
    return rows.join(read_starts(spark, path), "task").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
