"""Single rules on single texts, detectors, tokens, profiles and files."""

import html
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from verbatrix.cleaner import TextCleaner
from verbatrix.functions import normalize as nm
from verbatrix.functions.fixed import ABBREVIATIONS, STOP_WORDS
from verbatrix.functions.tokens import tokens
from verbatrix.operators import ngrams, profile, sampling
from verbatrix.plans.listings import extract_listings
from verbatrix.sources import io
from verbatrix.streaming.clean import clean_files

REMARKS = ["Cabin, 4 br 1 ba, 950 sqft, asks 275k. W/ dock.", "Manor $3.4m, gates 7' tall, 1.5 acres &amp; stable.", "Studio .4 mile off, 8ft beams, 3\" ledge, $2.5k less!"]

CASES = {
    nm.normalize_prices: {
        "asks 275k": "asks 275000", "$3.4m manor": "$3400000 manor", "$7.5k": "$7500", "around 6.4k": "around 6400", "$2,345,678": "$2345678", "8 thousand": "8000", "3.5 million": "3500000",
        "$2,468k": "$2,468000", "$2,468,135k": "$2468,135000", "3,400 sqft": "3400 sqft", "2468,135": "2468,135", "30m track": "30000000 track", ".5k": ".5000", "1.5 thousand": "1.5000", "2million": "2million",
        "8.2m": "8199999", "2.01k": "2009", "$ 450": "$450", "9" * 30 + "k": "9" * 30 + "k", "٣k": "٣k", "": "", "½k": "½k", "5K 6M": "5000 6000000", "3 THOUSAND": "3000"},
    nm.normalize_measurements: {
        ".4 acre": "0.4 acres", "7' gate": "7 foot gate", '3" ledge': "3 inch ledge", "8ft beam": "8 foot beam", "8-ft beam": "8 foot beam", "950 sqft": "950 square feet", "3.5 acre": "3.5 acres",
        "No.5": "No0.5", "1990's": "1990 foots", "9'6\"": "9 foot6 inch", "5'x7'": "5 footx7 foot", "10 ft": "10 ft", "1500 sq. ft. lot": "1500 square feet. lot", "2.5acre": "2.5acre", "1 ACRE": "1 acres",
        "5 metres": "5 metres", "50 sq m": "50 square meters", "50 sq. meters": "50 square meters", "1,500 SQFT": "1500 square feet", "10 Square   Feet": "10 square feet"},
    nm.expand_abbreviations: {
        "4 br 1 ba": "4 bedroom 1 bathroom", "w/ dock": "with dock", "950 sqft": "950 square feet", "w/o hoa": "without homeowners association", "w/garage": "w/garage", "3br": "3br", "Main Dr": "Main dining room",
        "br.": "bedroom.", "ſs": "ſs", "sq ft, sq. ft": "square feet, square feet", "A/C W/D": "air conditioning washer dryer", "ébr": "ébr"},
    nm.html_fold: {"&amp; stable": "& stable", "read <i>notes</i> below": "read notes below", "a<br>b": "ab", "&lt;b&gt;x": "x", "x < 5 and y > 3": "x  3", "<\n>": "", "&amp;amp;": "&amp;", "&notit; &#150; &apos;": html.unescape("&notit; &#150; &apos;")},
    nm.unicode_fold: {'say "so"': 'say "so"', "\xa0wide": " wide", "“a” ‘b’ – —": "\"a\" 'b' - -", "m²…": "m2...", "": ""},
    nm.clean_text: {"4 br, 950 sqft, $7.5k. 7' gate.": "4 bedroom, 950 square feet, $7500. 7 foot gate.", "   ": "", " x\x1c": "x"},
    nm.strip: {"  a\n b\x85": "a\n b"},
}


@pytest.mark.parametrize("step", CASES, ids=lambda f: f.__name__)
def test_rules(spark, step):
    cases = {**CASES[step], None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", step(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases


def test_cleaning_the_sample(spark):
    df = spark.createDataFrame([(r,) for r in REMARKS], "remarks string")
    got = [r.remarks for r in TextCleaner().clean_column(df, "remarks").collect()]
    assert got == ["Cabin, 4 bedroom 1 bathroom, 950 square feet, asks 275000. with dock.", "Manor $3400000, gates 7 foot tall, 1.5 acres & stable.", "Studio 0.4 mile off, 8 foot beams, 3 inch ledge, $2500 less!"]
    c = TextCleaner()
    assert c._detect_price_mentions(df, "remarks") == (7, {"$_k": 1, "$_m": 1, "Nk": 2, "Nm": 1, "$N": 2})
    assert c._detect_measurements(df, "remarks") == (7, {"sq ft": 1, "sqft": 1, "acres": 1, "leading_decimal": 1, "feet_apostrophe": 1, "inches_quote": 1, "ft_abbrev": 1})
    assert c._detect_abbreviations(df, "remarks") == [("ba", 1), ("br", 1), ("sqft", 1), ("w/", 1)]
    assert len(c.sample_compare(df, "remarks", 2, 42).collect()) == 2
    p = c.profile_column(df, "remarks").first()
    assert len(p) == 13 and p.null_rate == 0 and abs(p.avg_length - sum(map(len, REMARKS)) / 3) < 1e-9 and p.avg_num_words == sum(len(r.split()) for r in REMARKS) / 3
    assert p.price_mentions == 7 and p.measurement_mentions == 7 and p.has_html == 1 and p.html_examples == {"&amp;": 1} and p.has_unicode == 0
    assert "price_mentions: 7" in io.report(c.profile_column(df, "remarks"))
    empty = c.profile_column(df.limit(0), "remarks").first()
    assert empty.null_rate is None and empty.price_mentions == 0 and empty.common_terms == []


def test_long_texts_and_nfkc(spark):
    long = "1,234 " * 50_000 + "9" * 20_000 + "k"
    samples = ["é²½ﬁ™", "Ａ１", "한글", "é", long]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", nm.unicode_fold(F.col("s")).alias("o"), nm.clean_text(F.col("s")).alias("c")).orderBy("i").collect()
    assert [r.o for r in got] == [unicodedata.normalize("NFKC", s) for s in samples]
    assert got[-1].c.startswith("1234 1234")


def test_exact_prices(spark):
    assert spark.range(1).select(nm.normalize_prices(F.lit("8.2m 2.01k 4.k"), exact=True).alias("o")).first().o == "8200000 2010 4000"


def test_fixed_values():
    assert len(ABBREVIATIONS) == 51 and len(STOP_WORDS) == len(set(STOP_WORDS)) == 179


def test_tokens(spark):
    text = "Don't stop: the wi-fi (new) works, 3 br. It's Mr. Fox... gonna go end."
    row = spark.range(1).select(tokens(F.lit(text)).alias("t"), tokens(F.lit(text), mode="space").alias("s"), tokens(F.lit(None).cast("string")).alias("n")).first()
    assert row.t == ["do", "stop", "the", "new", "works", "br", "it", "mr", "fox", "gon", "na", "go", "end"]
    assert row.s == ["the", "gonna", "go"] and row.n is None


def test_bigrams_and_coverage(spark):
    df = spark.createDataFrame([(1, "red barn the red barn"), (2, "open red"), (3, None), (200_001, "barn open"), (4, "...")], "id int, t string")
    got = {r.term: r.n for r in ngrams.bigram_counts(df, "t").collect()}
    assert got == {"red barn": 2, "open red": 1, "barn open": 1}
    across = {r.term: r.n for r in ngrams.bigram_counts(df, "t", row_id="id").collect()}
    assert across == {"red barn": 3, "open red": 1, "barn open": 2}
    tax = ngrams.taxonomy(df, "t", 2)
    assert [tuple(r) for r in tax.orderBy("id").collect()] == [("T0001", "red barn", 2), ("T0002", "barn open", 1)]
    row = ngrams.coverage(df, "t", tax).first()
    assert (row.hits, row.bigrams, row.min_bigrams, row.max_bigrams, row.avg_bigrams, row.coverage) == (3, 4, 0, 2, 1.0, 75.0)
    loose = ngrams.coverage(spark.createDataFrame([("Red wi-fi barn",)], "t string"), "t", tax, tokenizer="space", lowercase=False, strict=False).first()
    assert (loose.bigrams, loose.hits) == (2, 0)
    assert ngrams.coverage(df.limit(0), "t", tax).first().coverage is None


def test_histogram_and_describe(spark):
    df = spark.createDataFrame([("a",), ("a b",), ("a b c",), (None,)], "t string")
    assert [(r.bin, r.n) for r in profile.word_histogram(df, "t", 2).orderBy("bin").collect()] == [(0, 1), (1, 2)]
    assert sum(r.n for r in profile.word_histogram(df.limit(1), "t", 4).collect()) == 1 and profile.word_histogram(df.limit(0), "t").count() == 0
    row = profile.describe_words(df, "t").first()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (3, 2.0, 1, 2.0, 3)


def test_samples(spark):
    df = spark.range(100).withColumn("t", F.lit("3 br"))
    assert sampling.random_sample(df, 7, 1).count() == 7 and sampling.random_sample(df, 700, 1).count() == 100
    assert {r.id for r in sampling.keyed_sample(df, 5, "id").collect()} == {r.id for r in sampling.keyed_sample(df.repartition(7), 5, "id").collect()}


def test_extraction(spark):
    names = "L_ListingID string, L_Address string, L_City string, L_Keyword2 int, LM_Dec_3 double, L_SystemPrice double, L_Remarks string, other int"
    df = spark.createDataFrame([("1", "a", "c", 1, 1.0, 2.0, "é" * 26, 0), ("2", "a", "c", 1, 1.0, 2.0, "e" * 50, 0), ("3", "a", "c", 1, 1.0, 2.0, None, 0)], names)
    got = extract_listings(df, seed=1).collect()
    assert [r.L_ListingID for r in got] == ["1"] and got[0].beds == 1 and len(got[0]) == 7


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "b", 1, 2.0, 3.0, 'say "hi"\nand, more'), ("2", "a", "b", 1, 2.0, 3.0, "plain")], io.LISTING)
    io.write_csv(df, f"{tmp_path}/a.csv")
    assert sorted(r.remarks for r in io.read_csv(spark, f"{tmp_path}/a.csv").collect()) == ["plain", 'say "hi"\nand, more']
    io.write_csv(df.repartition(2), f"{tmp_path}/b.csv", index="index")
    assert sorted(int(r.index_) for r in spark.read.csv(f"{tmp_path}/b.csv", header=True, multiLine=True, escape='"').withColumnRenamed("index", "index_").collect()) == [0, 1]
    terms = spark.createDataFrame([("T0001", "red barn", 2)], "id string, term string, count bigint")
    io.write_taxonomy(terms, f"{tmp_path}/t.json")
    assert json.load(open(f"{tmp_path}/t.json")) == {"terms": [{"id": "T0001", "term": "red barn", "count": 2}]}
    assert io.read_taxonomy(spark, f"{tmp_path}/t.json").collect() == terms.collect()
    io.write_html(spark.createDataFrame([("<b>",)], "x string"), f"{tmp_path}/x.html")
    assert "&lt;b&gt;" in open(f"{tmp_path}/x.html").read()


def test_jdbc(spark):
    url = "jdbc:derby:memory:listings;create=true"
    spark.createDataFrame([(1, "red barn"), (2, None), (3, "open")], "ID int, T string").coalesce(1).write.jdbc(url, "remarks")
    got = io.read_jdbc(spark, "select id, t from remarks where id < 3", url=url)
    assert sorted(map(tuple, got.collect())) == [(1, "red barn"), (2, None)] and [c.lower() for c in got.columns] == ["id", "t"]
    parts = io.read_jdbc(spark, "", url=url, dbtable="remarks", partitionColumn="ID", lowerBound="1", upperBound="4", numPartitions="3")
    assert parts.count() == 3 and parts.rdd.getNumPartitions() == 3


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(r,) for r in REMARKS], "remarks string")
    df.write.parquet(f"{tmp_path}/in")
    clean_files(spark, f"{tmp_path}/in", "remarks string", "remarks", f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination(120)
    assert sorted(r.remarks for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r.remarks for r in TextCleaner().clean_column(df, "remarks").collect())


def test_bigrams_over_row_ends_of_any_ids(spark):
    """Ids below zero, far apart, at stretches' ends, repeated and null (last), against the rows in order."""
    from collections import Counter
    from random import Random

    from verbatrix.operators.ngrams import bigram_counts

    rng = Random(4)
    ids = [-(1 << 63), -(1 << 40) - 1, -(1 << 40), -1, 0, 1, (1 << 18) - 1, 1 << 18, (1 << 40) - 1, 1 << 40, (1 << 62) + 5, (1 << 63) - 2, *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(40))]
    rows = [(i, " ".join(rng.choices(["ash", "bay", "the", "7"], k=rng.randint(0, 4)))) for i in ids] + [(3, "ash bay")] * 4 + [(5, None), (None, "bay"), (None, "bay")]
    rng.shuffle(rows)
    want = Counter()
    last = None
    for _, text in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0)):
        words = [w for w in text.split() if w.isalpha()]
        want.update(f"{a} {b}" for a, b in zip(([last] if last and words else []) + words, words if last else words[1:]) if "the" not in (a, b))
        last = words[-1] if words else last
    for parts in (1, 7):
        got = bigram_counts(spark.createDataFrame(rows, "i bigint, t string").repartition(parts), "t", row_id="i")
        assert {r.term: r.n for r in got.collect()} == want


@pytest.mark.parametrize("name", ["q_top_bigrams_treebank", "q_top_bigrams_across"])
def test_bigrams_over_row_ends_read_texts_once(spark, name):
    from verbatrix import catalog

    top = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    top.collect()
    assert top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet") == 1


def test_treebank_words_of_marks_side_by_side(spark):
    """The words by the rules one after another, as they are stated, whichever of them a text needs."""
    import random
    import re

    from verbatrix.functions.tokens import tokens

    space, letter = r"[\t-\r\x1c-\x20]", "[a-z]"
    rules = (
        (r"([;@#$%&?!\[\](){}<>\"“”—]|\.{2,}|--+|``|'')", r" \1 "), (r"([:,])(?!\d)", r" \1 "), (rf"([^.])(\.)(?=[\])}}>\"']*(?:{space}|\Z))", r"\1 \2 "),
        (rf"(?:(?<={space})|(?<!.)(?<!\n))'(?={letter})|'(?={space}|\Z)", " ' "), (rf"(?<={letter})(n't)(?!\w)", r" \1"), (r"(?<=[a-z0-9])('(?:s|m|d|ll|re|ve))(?!\w)", r" \1"),
        (r"(?<!\w)(can)(not)(?!\w)", r"\1 \2"), (r"(?<!\w)(gim|lem)(me)(?!\w)", r"\1 \2"), (r"(?<!\w)(gon|wan)(na)(?!\w)", r"\1 \2"), (r"(?<!\w)(got)(ta)(?!\w)", r"\1 \2"),
    )
    rng, parts = random.Random(8), ["a", "n", "cannot", "gimme", "lemme", "gonna", "wanna", "gotta", "n't", "'s", "'ve", "'", "``", ".", "..", ",", ":", ")", "“", "—", "--", " ", "\n", "1", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(4000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens(F.col("t")).alias("w")).collect()
    for i, words in got:
        t = texts[i]
        for pattern, new in rules:
            t = re.sub(pattern, new, t)
        assert words == [w for w in t.split() if re.fullmatch("[a-z]+", w)], texts[i]
