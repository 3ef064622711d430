"""URL filters by a sort-merge range join over reversed-host keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pinned


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: the hosts under a domain are the keys that begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def with_stack(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (key, ...) with ``stack``: the rules (key) whose key is a prefix of the row's, outermost first.

    A prefix is an interval of sorted keys and such intervals nest, so the rules open at a key are found among
    the nearest rule at or before it and those that enclose that rule. Rules and rows are merged by one range
    partitioning of the keys; inside a range a sweep in key order carries the last rule's chain of enclosing
    rules along, and each range starts with what the ranges before it left open (one row a range). Ties are
    dealt by the whole row, so equal keys may spread over ranges. No side is broadcast.
    """
    rules = rules.select("key").distinct()
    prefixes = rules.select(F.col("key").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring("key", 1, n))).alias("key"))
    chains = prefixes.join(rules, "key").groupBy("of").agg(F.sort_array(F.collect_list(F.struct(F.length("key").alias("n"), "key"))).alias("chain"))
    chain = F.transform("chain", lambda c: c["key"])
    names = [c for c in rows.columns if c != "key"]
    events = chains.select(F.col("of").alias("key"), F.lit(0).alias("kind"), chain.alias("chain"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names])
    events = events.unionByName(rows.withColumns({"kind": F.lit(1), "chain": F.lit(None).cast("array<string>")}))
    events = pinned(events.withColumn("deal", F.xxhash64(*names)).repartitionByRange("key", "kind", "deal").withColumn("range", F.spark_partition_id()).drop("deal"))
    left_open = events.groupBy("range").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    left_open = left_open.select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(left_open, "range").withColumn("chain", F.coalesce(F.last("chain", ignorenulls=True).over(sweep), "carried")).where("kind = 1")
    stack = F.filter("chain", lambda c: F.col("key").startswith(c))
    return swept.select("key", *names, F.coalesce(stack, F.array().cast("array<string>")).alias("stack"))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` and host, path, rule, verdict for every row of ``pages``.

    ``rules``: (verdict, host, path) rows, or a table with those columns of any size. A rule fits its host and
    all subdomains if the path starts with the rule's; the rule with the longest host, then the longest path,
    wins, so two that fit never tie unless they are the same rule (then block wins). No rule: rule null, verdict
    ``default``. Two sweeps: over reversed hosts, then, for each rule host open there, over paths.

    Null or malformed urls have an empty host and path and fit no rule; repeated rows stay; an empty table gives
    an empty result; other columns of ``pages`` are not read; columns of ``keep`` named like a result are dropped.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = rules.select(F.coalesce("path", F.lit("")).alias("path"), ascii_lower(F.col("host")).alias("host"), "verdict").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select("host", "path", "verdict", reversed_host(F.col("host")).alias("at"))
    own = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[F.col(c) for c in own], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).alias("row")
    urls = pages.select(row).withColumn("id", F.monotonically_increasing_id())
    hosts = with_stack(urls.withColumn("key", reversed_host(F.col("row.host"))), rules.select(F.col("at").alias("key")))
    # "\x01" sorts before every character of a path and occurs in no host, so a rule host's paths are one interval
    opened = hosts.select("id", "row", F.explode_outer("stack").alias("at")).withColumn("key", F.concat(F.coalesce("at", F.lit("")), F.lit("\x01"), F.col("row.path")))
    paths = with_stack(opened.select("key", "id", "row"), rules.select(F.concat("at", F.lit("\x01"), "path").alias("key")))
    innermost = F.when(F.size("stack") > 0, F.element_at("stack", -1))
    best = paths.groupBy("id").agg(F.first("row").alias("row"), F.max_by(innermost, F.length(F.substring_index(innermost, "\x01", 1))).alias("rule_key"))
    named = rules.select(F.concat("at", F.lit("\x01"), "path").alias("rule_key"), F.concat("host", "path").alias("rule"), "verdict")
    return best.join(named, "rule_key", "left").select(*[F.col(f"row.{c}").alias(c) for c in own], "row.host", "row.path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
