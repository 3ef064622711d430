"""The corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; it is written as
Parquet and reread as the next one's ``docs``. Any stage can be the first that an application runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.llm import queries as q
from verbatrix.llm.common import pinned, shared_path, table
from verbatrix.llm.mixing import mix_sources
from verbatrix.llm.packing import pack_documents
from verbatrix.llm.quality_fm import score_quality
from verbatrix.llm.simhash import simhash_groups
from verbatrix.llm.toxicity import score_toxicity
from verbatrix.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. The model is fitted to labelled documents of ``sf_dir``; without labels of both kinds none goes.

    Null and empty texts are scored like others; rows that repeat stay or go together; an empty table stays empty; other columns go.
    """
    model = q.quality_model(spark, sf_dir)
    if model is None:
        return docs.select(*COLUMNS)
    scored = score_quality(docs, model, keep=COLUMNS, score="__quality")
    return scored.where(F.col("__quality") >= q.QUALITY_LEAST).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; without labels of both kinds none goes.

    Null and empty texts have the least score; rows that repeat stay or go together; an empty table stays empty; other columns go.
    """
    model = q.toxicity_model(spark, sf_dir)
    if model is None:
        return docs.select(*COLUMNS)
    scored = score_toxicity(docs, model, keep=COLUMNS, score="__toxicity")
    return scored.where(F.col("__toxicity") < q.TOXIC_LEAST).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest doc_id (null after all others), of several the one with the least hash.

    Rows are told apart by hashes of all their columns (128 bits), so of rows that repeat an id each is judged by its own text, and of equal rows one
    stays. Null texts are empty texts, which are one another's copies.
    """
    ship(spark)
    names = ("__a", "__b")
    rows = docs.select(*COLUMNS, *[F.xxhash64(F.lit(i), *COLUMNS).alias(n) for i, n in enumerate(names)])
    groups = simhash_groups(rows, keep=names)
    same = groups.groupBy("group", *names).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    best = pinned(same.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names, "n")).alias("best")).select("group", "best.*"))
    twice = best.where("n > 1").select(*names)
    away = same.join(best.select(*names), list(names), "left_anti").select(*names)
    once = rows.join(away.unionByName(twice), list(names), "left_anti")
    return once.unionByName(rows.join(twice, list(names), "left_semi").dropDuplicates(list(names))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the order of the files' numbers and of the rows in each.

    Null and repeated ids stay; a null source is a source of its own; an empty table stays empty; other columns go.
    """
    ship(spark)
    mixed = mix_sources(docs.select(*COLUMNS), temper=0.5)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, in their stored order, in sequences of at most 1024 tokens: a row for each piece.

    A null or empty text is one token; null and repeated ids stay; an empty table gives no pieces; other columns are not read.
    """
    ship(spark)
    file = F.col("_metadata.file_name")
    order = (F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long"), file, F.col("_metadata.row_index"))
    return pack_documents(docs, tokenizer_path=q.tokenizer_path(), order=order, end_id=0, size=1024)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
