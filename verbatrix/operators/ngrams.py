"""Frequent bigrams, the taxonomy made of them, and how much of a text it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import STOP_WORDS
from ..functions.tokens import bigrams, tokens


#: Bits of ids that the levels of ``_across`` take off, the last one all that are left.
_LEVELS = (18, 22, 24)


def bigram_counts(df: DataFrame, column: str, *, tokenizer: str = "treebank", row_id: str | None = None, stop_words=STOP_WORDS) -> DataFrame:
    """(term, n). With ``row_id`` (whole numbers) the last word of each row is also paired with the first of the next that has words.

    Null ids come last; rows of one id are ordered by their first and last words. Texts are read and split once: the first and last words go
    along with the bigrams, through one shuffle that all later steps share.
    """
    words = tokens(F.col(column), mode=tokenizer)
    if not row_id:
        return df.select(F.explode(bigrams(words, stop_words)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    at = F.coalesce(F.col(row_id).cast("long"), F.lit((1 << 63) - 1))

    def rows(w: Column) -> Column:
        inside = F.transform(bigrams(w, stop_words), lambda t: F.struct(t.alias("term"), F.lit(None).cast("long").alias("at")))
        ends = F.array(F.struct(F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)).alias("term"), at.alias("at")))
        return F.when(F.size(w) > 0, F.concat(inside, ends))

    each = df.select(F.explode(F.transform(F.array(words), rows)[0]).alias("r")).select("r.*")
    # conditions on counts stay above the shuffle, and all that read it ask for the same counts, so that Spark makes it once
    counted = each.groupBy("term", "at").agg(F.count("*").alias("n"), F.count("at").alias("ends"))
    found = counted.where("ends = 0 and n > 0").select("term", "n").unionByName(_across(counted.where("ends > 0 and n > 0"), stop_words))
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def _across(ends: DataFrame, stop_words) -> DataFrame:
    """Pairs (term, n) over row ends, of which ``term`` has a row's first and last word. Of each stretch of ids by a window, then of the stretches, each as one row, and so on: a window's rows are bounded by its level's bits."""
    rows, pairs = ends.select("at", F.substring_index("term", " ", 1).alias("a"), F.substring_index("term", " ", -1).alias("b"), "n"), None
    for i, bits in enumerate(_LEVELS):
        part = F.shiftright("at", bits) if bits != _LEVELS[-1] else F.lit(0)
        order = ("at", "a", "b")
        then = F.lead("a").over(Window.partitionBy(part).orderBy(*order))
        own = rows.select("a", "b", "n", then.alias("then"))
        if i == 0:  # equal rows follow one another
            both = F.array(F.struct(F.col("b").alias("left"), F.col("then").alias("right"), F.lit(1).cast("long").alias("n")), F.struct(F.col("b").alias("left"), F.col("a").alias("right"), (F.col("n") - 1).alias("n")))
            own = own.select(F.inline(both))
        else:
            own = own.select(F.col("b").alias("left"), F.col("then").alias("right"), "n")
        pairs = pairs.unionByName(own) if pairs else own
        rows = rows.groupBy(part.alias("at")).agg(F.min_by("a", F.struct(*order)).alias("a"), F.max_by("b", F.struct(*order)).alias("b"), F.lit(1).cast("long").alias("n"))
    pairs = pairs.where("right is not null and n > 0").where(~F.col("left").isin(*stop_words) & ~F.col("right").isin(*stop_words))
    return pairs.select(F.concat_ws(" ", "left", "right").alias("term"), "n")


def top_bigrams(df: DataFrame, column: str, top: int = 200, **how) -> DataFrame:
    """The ``top`` most frequent (term, n), ties by term."""
    return bigram_counts(df, column, **how).orderBy(F.desc("n"), "term").limit(top)


def taxonomy(df: DataFrame, column: str, top: int = 1000, **how) -> DataFrame:
    """(id, term, count): T0001 and on, most frequent first. The window holds ``top`` rows."""
    best = top_bigrams(df, column, top, **how)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "term"))
    return best.select(F.format_string("T%04d", rank).alias("id"), "term", F.col("n").alias("count"))


def coverage(df: DataFrame, column: str, terms: DataFrame, *, tokenizer: str = "treebank", lowercase: bool = True, strict: bool = True, stop_words=STOP_WORDS) -> DataFrame:
    """One row: hits, bigrams, min_bigrams, max_bigrams, avg_bigrams (a row) and coverage in percent; null without bigrams.

    Texts are read once: a row's number of bigrams goes along with its bigrams, partly aggregated in the same pass.
    """
    pairs = bigrams(tokens(F.col(column), mode=tokenizer, lowercase=lowercase, strict=strict), stop_words)
    size = F.struct(F.lit(None).cast("string").alias("term"), F.size("pairs").alias("k"))  # a row of its own for each text
    rows = df.select(pairs.alias("pairs")).where("pairs is not null").select(F.explode(F.concat(F.array(size), F.transform("pairs", lambda t: F.struct(t.alias("term"), F.lit(None).cast("int").alias("k"))))).alias("r"))
    counts = rows.groupBy("r.term").agg(F.count("*").alias("n"), F.sum("r.k").alias("bigrams"), F.min("r.k").alias("min_bigrams"), F.max("r.k").alias("max_bigrams"))
    known = counts.join(terms.select("term", F.lit(True).alias("known")).distinct(), "term", "left")
    of_texts = lambda c: F.max(F.when(F.col("term").isNull(), F.col(c))).alias(c)
    one = known.agg(F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("hits"), *[of_texts(c) for c in ("bigrams", "min_bigrams", "max_bigrams")], of_texts("n").alias("texts"))
    return one.select("hits", "bigrams", "min_bigrams", "max_bigrams", F.try_divide(F.col("bigrams").cast("double"), F.col("texts")).alias("avg_bigrams"), F.try_divide(100.0 * F.col("hits"), F.col("bigrams")).alias("coverage"))
