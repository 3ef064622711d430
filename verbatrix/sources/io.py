"""Tables in and out: JDBC, CSV, the taxonomy's JSON, HTML reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = "L_ListingID string, L_Address string, L_City string, beds int, bath double, price double, remarks string"
TERMS = "terms array<struct<id: string, term: string, count: bigint>>"
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_jdbc(spark: SparkSession, query: str, *, url: str, user: str | None = None, password: str | None = None, **options: str) -> DataFrame:
    """The result of ``query``; credentials come from the caller. Give partitionColumn, bounds and numPartitions (with dbtable) to read in parallel."""
    given = {"url": url, **({"user": user} if user else {}), **({"password": password} if password else {}), **options}
    if "dbtable" not in given:
        given["query"] = query
    return spark.read.format("jdbc").options(**given).load()


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType = LISTING) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, *, index: str | None = None, mode: str = "errorifexists") -> None:
    """``index``: a name for a leading column that numbers the rows from 0, in their present order, without a single task for them all."""
    if index is not None:
        names = df.columns
        numbered = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
        counts = {r["__part"]: r["count"] for r in numbered.groupBy("__part").count().collect()}  # one number a partition
        before, at = {}, 0
        for p in sorted(counts):
            before[p], at = at, at + counts[p]
        starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None).cast("map<bigint,bigint>")
        df = numbered.select((F.try_element_at(starts, F.col("__part")) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(index), *names)
    df.write.options(**{k: v for k, v in _CSV.items() if k != "multiLine"}).mode(mode).csv(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TERMS).json(path, multiLine=True).select(F.inline("terms"))


def write_taxonomy(terms: DataFrame, path: str, most: int = 1000) -> None:
    """One indented JSON document, written by the driver: at most ``most`` terms."""
    rows = [{"id": r.id, "term": r.term, "count": r["count"]} for r in terms.orderBy("id").limit(most).collect()]
    Path(path).write_text(json.dumps({"terms": rows}, indent=2), encoding="utf-8")


def write_html(df: DataFrame, path: str, *, most: int = 1000, escape: bool = True) -> None:
    """A table of at most ``most`` rows. ``escape=False`` lets cells' own markup through."""
    df.limit(most).toPandas().to_html(path, escape=escape)


def report(profile: DataFrame) -> str:
    """A profile's row as text, one part a line."""
    row = profile.first()
    return "\n".join(f"{k}: {v}" for k, v in row.asDict(recursive=True).items()) if row else ""
