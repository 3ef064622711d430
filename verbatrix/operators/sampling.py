"""Samples and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import clean_text


def random_sample(df: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """``k`` rows in random order (all, if fewer): a top-k on each task, then one of those."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(k)


def keyed_sample(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """``k`` rows that depend on the keys and the seed alone, whatever the engine or partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(k)


def clean_column(df: DataFrame, column: str, **how) -> DataFrame:
    return df.withColumn(column, clean_text(F.col(column), **how))


def sample_compare(df: DataFrame, column: str, k: int = 10, seed: int | None = None, key: str | None = None, **how) -> DataFrame:
    """(original, cleaned) of a sample; only the sample is cleaned."""
    some = keyed_sample(df, k, key, seed or 0) if key else random_sample(df, k, seed)
    return some.select(F.col(column).alias("original")).withColumn("cleaned", clean_text(F.col("original"), **how))
