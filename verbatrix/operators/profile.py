"""Detectors, profiles and word statistics of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ENTITY, MEASUREMENTS, PRICES, TAG
from ..functions.normalize import abbreviation_pattern
from ..functions.tokens import word_count
from .ngrams import top_bigrams


def label_counts(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """(label, n) of the labels with hits: all patterns in one pass, counted independently of one another."""
    sums = df.agg(*[F.sum(F.regexp_count(F.col(column), F.lit(p)).cast("long")).alias(f"n{i}") for i, p in enumerate(patterns.values())])
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"n{i}").alias("n")) for i, label in enumerate(patterns)])
    return sums.select(F.inline(rows)).where("n > 0")


def detect_prices(df: DataFrame, column: str) -> DataFrame:
    return label_counts(df, column, PRICES)


def detect_measurements(df: DataFrame, column: str) -> DataFrame:
    return label_counts(df, column, MEASUREMENTS)


def frequencies(df: DataFrame, values: Column, name: str) -> DataFrame:
    """(name, n) of every value in an array column, partly counted before the shuffle."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def detect_html(df: DataFrame, column: str) -> DataFrame:
    """(found, n): character references and tags, row by row."""
    hits = F.concat(*[F.regexp_extract_all(F.col(column), F.lit(p), F.lit(0)) for p in (ENTITY, TAG)])
    return frequencies(df, hits, "found")


def detect_unicode(df: DataFrame, column: str) -> DataFrame:
    """(char, n): characters beyond ASCII."""
    return frequencies(df, F.regexp_extract_all(F.col(column), F.lit(r"[^\x00-\x7F]"), F.lit(0)), "char")


def detect_abbreviations(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """(abbr, n), most frequent first, ties by name."""
    found = frequencies(df, F.transform(F.regexp_extract_all(F.col(column), F.lit(abbreviation_pattern()), F.lit(0)), F.lower), "abbr")
    return found if top is None else found.orderBy(F.desc("n"), "abbr").limit(top)


def scalar_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: null_rate, avg_length, avg_num_words; nulls count only for the first; null on an empty table."""
    c = F.col(column)
    return df.agg(F.avg(c.isNull().cast("int")).alias("null_rate"), F.avg(F.length(c)).alias("avg_length"), F.avg(word_count(c)).alias("avg_num_words"))


def profile_column(df: DataFrame, column: str, top_terms: int = 200, top_abbreviations: int = 10, tokenizer: str = "treebank") -> DataFrame:
    """One row with the 13 parts of a profile. Scalars and labels take one pass, each counter one more."""
    c = F.col(column)

    def as_map(counts: DataFrame, key: str) -> DataFrame:
        return counts.agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("m"), F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def as_list(rows: DataFrame, *names: str) -> DataFrame:
        return rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), *names, F.col("n").alias("count")))).alias("l"))

    sums = [F.sum(F.regexp_count(c, F.lit(p)).cast("long")).alias(f"{k}{i}") for k, ps in (("p", PRICES), ("m", MEASUREMENTS)) for i, p in enumerate(ps.values())]
    flat = df.agg(F.avg(c.isNull().cast("int")).alias("null_rate"), F.avg(F.length(c)).alias("avg_length"), F.avg(word_count(c)).alias("avg_num_words"), *sums)

    def counter(k: str, patterns: dict) -> Column:
        entries = F.map_from_arrays(F.array(*[F.lit(x) for x in patterns]), F.array(*[F.coalesce(F.col(f"{k}{i}"), F.lit(0)) for i in range(len(patterns))]))
        return F.map_filter(entries, lambda _, n: n > 0)

    out = flat.select("null_rate", "avg_length", "avg_num_words", counter("p", PRICES).alias("price_counter"), counter("m", MEASUREMENTS).alias("measurement_counter"))
    total = lambda name: F.aggregate(F.map_values(name), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({"price_mentions": total("price_counter"), "measurement_mentions": total("measurement_counter")})
    html_ = as_map(detect_html(df, column), "found").select(F.col("total").alias("has_html"), F.col("m").alias("html_examples"))
    uni = as_map(detect_unicode(df, column), "char").select(F.col("kinds").alias("has_unicode"), F.col("m").alias("unicode_examples"))
    terms = as_list(top_bigrams(df, column, top_terms, tokenizer=tokenizer), "term").select(F.transform("l", lambda x: F.struct(x["term"].alias("term"), x["count"].alias("count"))).alias("common_terms"))
    abbr = as_list(detect_abbreviations(df, column, top_abbreviations), "abbr").select(F.transform("l", lambda x: F.struct(x["abbr"].alias("abbr"), x["count"].alias("count"))).alias("common_abbreviations"))
    for one in (terms, html_, uni, abbr):  # one row each
        out = out.join(F.broadcast(one))
    order = "null_rate avg_length avg_num_words common_terms price_mentions price_counter measurement_mentions measurement_counter has_html html_examples has_unicode unicode_examples common_abbreviations"
    return out.select(*order.split())


def describe_words(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated) and max of the words a row; nulls are skipped."""
    n = word_count(F.col(column))
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(n).alias("count"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), q.alias("q"), F.max(n).alias("max"))
    return one.select("count", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max")


def word_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, n) of the words a row in ``bins`` equal parts of their range, the last closed; empty bins have 0. One value: all in one bin half to either side."""
    counts = df.select(word_count(F.col(column)).alias("w")).where("w is not null")
    ends = counts.agg(F.min("w").cast("double").alias("a"), F.max("w").cast("double").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col("w") - F.col("a")) * bins / (F.col("b") - F.col("a"))), F.lit(bins - 1)).cast("int")
    found = counts.groupBy("w").agg(F.count("*").alias("k")).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.sum("k").alias("n"))
    every = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))
