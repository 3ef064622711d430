"""The registered queries over the driver's tables, and SQL that DuckDB runs to the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as nm
from .functions.fixed import ABBREVIATIONS, ENTITY, STOP_WORDS, TAG
from .operators import ngrams, profile, sampling
from .plans.listings import PARTS, REMARKS, by_template, extract_listings, listings
from .shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
_NWS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]+"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(_read(spark, sf_dir, "part"))


_FROM = f"FROM ({PARTS.format(part='part', q='chr(39)')})"


def _duck(texts: dict[int, str], changed: dict[int, str] | None = None) -> str:
    return by_template(texts, changed).replace("AS STRING", "AS VARCHAR")


def _sums(counts: dict[str, dict[int, int]], name: str) -> str:
    """Expected (name, n): by label, how often each template has it."""
    parts = [f"SELECT '{label}' AS {name}, CAST(sum(CASE k {' '.join(f'WHEN {t} THEN {c}' for t, c in by.items())} ELSE 0 END) AS BIGINT) AS n {_FROM}" for label, by in counts.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@_query("SELECT avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, avg(length(text)) AS avg_length, "
        f"avg(len(regexp_extract_all(text, '{_NWS}'))) AS avg_num_words FROM documents")
def q_profile_scalar(spark, sf_dir):
    return profile.scalar_profile(_docs(spark, sf_dir), "text")


_W = f"(SELECT len(regexp_extract_all(text, '{_NWS}')) AS w FROM documents WHERE text IS NOT NULL)"


@_query(f"SELECT count(w) AS count, avg(w) AS mean, round(stddev_samp(w), 6) AS std, min(w) AS min, quantile_cont(w, 0.25) AS q25, quantile_cont(w, 0.5) AS q50, quantile_cont(w, 0.75) AS q75, max(w) AS max FROM {_W}")
def q_describe_words(spark, sf_dir):
    return profile.describe_words(_docs(spark, sf_dir), "text").withColumn("std", F.round("std", 6))


@_query(f"""WITH e AS (SELECT min(w)::DOUBLE AS a, max(w)::DOUBLE AS b FROM {_W}), c AS (SELECT least(floor((w - a) * 50 / (b - a)), 49)::INTEGER AS bin FROM {_W}, e)
SELECT x.bin::INTEGER AS bin, a + x.bin * (b - a) / 50 AS lo, (SELECT count(*) FROM c WHERE c.bin = x.bin) AS n FROM e, (SELECT unnest(range(50)) AS bin) x""")
def q_hist_words(spark, sf_dir):
    return profile.word_histogram(_docs(spark, sf_dir), "text", 50)


@_query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE strlen(text) > 50")
def q_filter_len_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.octet_length("text") > 50).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@_query(r"SELECT char, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS char FROM documents) GROUP BY char")
def q_unicode_chars(spark, sf_dir):
    return profile.detect_unicode(_docs(spark, sf_dir), "text")


@_query(f"SELECT found, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '{ENTITY}')) AS found FROM pages) GROUP BY found")
def q_html_entities(spark, sf_dir):
    return profile.frequencies(_read(spark, sf_dir, "pages"), F.regexp_extract_all(F.col("html"), F.lit(ENTITY), F.lit(0)), "found")


@_query(f"SELECT found, count(*) AS n FROM (SELECT unnest(list_concat(regexp_extract_all(html, '{ENTITY}'), regexp_extract_all(html, '{TAG}'))) AS found FROM pages) GROUP BY found")
def q_html_found(spark, sf_dir):
    return profile.detect_html(_read(spark, sf_dir, "pages"), "html")


@_query("SELECT page_id, md5(regexp_replace(html, '</?[^>]*>', '', 'g')) AS text_md5 FROM pages")
def q_strip_tags(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(nm.strip_tags(F.col("html"))).alias("text_md5"))


_ONE_WORD = [k for k in ABBREVIATIONS if k.isalpha()]
_WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@_query(f"SELECT abbr, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS abbr FROM documents) WHERE abbr IN ({', '.join(repr(k) for k in _ONE_WORD)}) GROUP BY abbr")
def q_abbrev_words(spark, sf_dir):
    return profile.detect_abbreviations(_docs(spark, sf_dir), "text", None).where(F.col("abbr").isin(_ONE_WORD))


@_query()
def q_abbrev_documents(spark, sf_dir):
    """All abbreviations, also those with marks or spaces, which q_abbrev_words leaves out for its SQL's sake."""
    return profile.detect_abbreviations(_docs(spark, sf_dir), "text", None)


_ABBRS = {"br": {0: 1}, "ba": {0: 1}, "sqft": {0: 1}, "w/": {0: 1}, "sq. ft": {3: 1}, "a/c": {5: 1}, "w/d": {5: 1}, "w/o": {5: 1}, "hoa": {5: 1}, "yr": {6: 1}, "dr": {9: 1}}


@_query(_sums(_ABBRS, "abbr"))
def q_abbrev_counts(spark, sf_dir):
    return profile.detect_abbreviations(_listings(spark, sf_dir), "remarks", None)


_PRICES = {"$_k": {2: 1, 4: 1}, "$_m": {1: 1}, "Nk": {0: 1, 2: 1, 4: 1, 9: 1}, "Nm": {1: 1, 4: 1}, "$N": {1: 1, 2: 1, 3: 1, 4: 1, 10: 1}, "N_comma": {3: 2}, "N thousand": {3: 1}, "N million": {10: 1}}


@_query(_sums(_PRICES, "label"))
def q_price_counts(spark, sf_dir):
    return profile.detect_prices(_listings(spark, sf_dir), "remarks")


_MEASURES = {"sq ft": {0: 1, 3: 1}, "sqft": {0: 1}, "square feet": {10: 1}, "acres": {1: 1, 5: 2}, "sq meters": {5: 1}, "leading_decimal": {2: 1}, "feet_apostrophe": {1: 1, 4: 3}, "inches_quote": {2: 1, 4: 1}, "ft_abbrev": {2: 1}}


@_query(_sums(_MEASURES, "label"))
def q_measure_counts(spark, sf_dir):
    return profile.detect_measurements(_listings(spark, sf_dir), "remarks")


def _expected(changed: dict[int, str]) -> str:
    return f"SELECT id, {_duck(REMARKS, changed)} AS text {_FROM}"


def _on_listings(step) -> Query:
    return lambda spark, sf_dir: _listings(spark, sf_dir).select("id", step(F.col("remarks")).alias("text"))


_STEPS = {
    "q_norm_prices": (nm.normalize_prices, {
        0: "'Cottage with ' || z || ' br and 3 ba over ' || s || ' sqft; offers from ' || nk || '. W/ patio.'", 1: "'Villa near the lake, $2400000, doors of 8' || q || ', ' || z || '.5 acres &amp; a barn.'",
        2: "'Loft .75 mile from town: 12ft walls, 4\" shelf, was $7500 more'", 3: "'Estate at $2345678, ' || n || '250 sq. ft. and ' || zk || ' vines'",
        4: "'Once $2,468000, court 30000000 x 6' || q || 'x8' || q || ', 7' || q || '9\" gate'", 9: "'Elm Dr, 4br, w/cellar, 501000'",
        10: "'  Asking $640, or 1500000 for both, 900 Square   Feet in all  '"}),
    "q_norm_measure": (nm.normalize_measurements, {
        0: "'Cottage with ' || z || ' br and 3 ba over ' || s || ' square feet; offers from ' || n || 'k. W/ patio.'", 1: "'Villa near the lake, $2.4m, doors of 8 foot, ' || z || '.5 acres &amp; a barn.'",
        2: "'Loft 0.75 mile from town: 12 foot walls, 4 inch shelf, was $7.5k more'", 3: "'Estate at $2,345,678, ' || n || '250 square feet. and ' || z || ' thousand vines'",
        4: "'Once $2,468k, court 30m x 6 footx8 foot, 7 foot9 inch gate'", 5: "'Field 3.5 acres, pond 1 acres, 40 square meters shed, a/c, w/d, w/o hoa'",
        10: "'  Asking $ 640, or 1.5 Million for both, 900 square feet in all  '"}),
    "q_expand": (nm.expand_abbreviations, {
        0: "'Cottage with ' || z || ' bedroom and 3 bathroom over ' || s || ' square feet; offers from ' || n || 'k. with patio.'", 3: "'Estate at $2,345,678, ' || n || ',250 square feet. and ' || z || ' thousand vines'",
        5: "'Field 3.5 acre, pond 1 acre, 40 sq m shed, air conditioning, washer dryer, without homeowners association'",
        6: "'<p>Corner&nbsp;unit &lt;i&gt;sunny&lt;/i&gt; &quot;' || z || ' year&quot; B&amp;B</p>'", 9: "'Elm dining room, 4br, w/cellar, 501k'"}),
    "q_norm_unicode": (nm.unicode_fold, {7: "'\"Airy\" 7' || q || ' hall - 31⁄2 rooms ... by 12 elms'"}),
    "q_unescape": (nm.unescape, {
        1: "'Villa near the lake, $2.4m, doors of 8' || q || ', ' || z || '.5 acres & a barn.'", 6: "'<p>Corner' || chr(160) || 'unit <i>sunny</i> \"' || z || ' yr\" B&B</p>'"}),
    "q_strip": (nm.strip, {10: "'Asking $ 640, or 1.5 Million for both, 900 Square   Feet in all'"}),
    "q_clean": (nm.clean_text, {
        0: "'Cottage with ' || z || ' bedroom and 3 bathroom over ' || s || ' square feet; offers from ' || nk || '. with patio.'", 1: "'Villa near the lake, $2400000, doors of 8 foot, ' || z || '.5 acres & a barn.'",
        2: "'Loft 0.75 mile from town: 12 foot walls, 4 inch shelf, was $7500 more'", 3: "'Estate at $2345678, ' || n || '250 square feet. and ' || zk || ' vines'",
        4: "'Once $2,468000, court 30000000 x 6 footx8 foot, 7 foot9 inch gate'", 5: "'Field 3.5 acres, pond 1 acres, 40 square meters shed, air conditioning, washer dryer, without homeowners association'",
        6: "'Corner' || chr(160) || 'unit sunny \"' || z || ' year\" B&B'", 7: "'\"Airy\" 7 foot hall - 31⁄2 rooms ... by 12 elms'", 9: "'Elm dining room, 4br, w/cellar, 501000'",
        10: "'Asking $640, or 1500000 for both, 900 square feet in all'"}),
}
for _name, (_step, _changed) in _STEPS.items():
    _QUERIES[_name], _SQL[_name] = _on_listings(_step), _expected(_changed)


@_query()
def q_clean_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(nm.clean_text(F.col("html"))).alias("clean_md5"))


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_PAIRS = f"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_WS}'), lambda w: regexp_full_match(w, '[a-z]+')) AS w FROM documents),
p AS (SELECT doc_id, list_filter(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda x: x[1] NOT IN ({_STOPS}) AND x[2] NOT IN ({_STOPS})) AS x FROM t),
b AS (SELECT doc_id, unnest(list_transform(x, lambda y: y[1] || ' ' || y[2])) AS term FROM p),
c AS (SELECT term, count(*) AS n FROM b GROUP BY term)"""


@_query(f"WITH {_PAIRS} SELECT term, n FROM c ORDER BY n DESC, term LIMIT 200")
def q_top_bigrams(spark, sf_dir):
    return ngrams.top_bigrams(_docs(spark, sf_dir), "text", 200, tokenizer="space")


@_query(f"""WITH {_PAIRS}, r AS (SELECT doc_id, w FROM t WHERE len(w) > 0), e AS (SELECT w[-1] AS a, lead(w[1]) OVER (ORDER BY doc_id) AS b FROM r),
a AS (SELECT term FROM b UNION ALL SELECT a || ' ' || b FROM e WHERE b IS NOT NULL AND a NOT IN ({_STOPS}) AND b NOT IN ({_STOPS}))
SELECT term, count(*) AS n FROM a GROUP BY term ORDER BY n DESC, term LIMIT 200""")
def q_top_bigrams_across(spark, sf_dir):
    """Bigrams over the ends of documents too, in the order of their ids."""
    return ngrams.top_bigrams(_docs(spark, sf_dir), "text", 200, tokenizer="space", row_id="doc_id")


_TAXONOMY = "SELECT printf('T%04d', row_number() OVER (ORDER BY n DESC, term)) AS id, term, n AS count FROM c ORDER BY n DESC, term LIMIT 1000"


@_query(f"WITH {_PAIRS} {_TAXONOMY}")
def q_taxonomy(spark, sf_dir):
    return ngrams.taxonomy(_docs(spark, sf_dir), "text", 1000, tokenizer="space")


@_query(f"""WITH {_PAIRS}, terms AS ({_TAXONOMY}), s AS (SELECT coalesce(len(x), 0) AS k FROM p)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE term IN (SELECT term FROM terms)) AS hits, CAST(sum(k) AS BIGINT) AS bigrams, min(k) AS min_bigrams, max(k) AS max_bigrams, avg(k) AS avg_bigrams,
100.0 * (SELECT sum(n) FROM c WHERE term IN (SELECT term FROM terms)) / sum(k) AS coverage FROM s""")
def q_coverage(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return ngrams.coverage(docs, "text", ngrams.taxonomy(docs, "text", 1000, tokenizer="space"), tokenizer="space")


@_query()
def q_top_bigrams_treebank(spark, sf_dir):
    return ngrams.top_bigrams(_docs(spark, sf_dir), "text", 200, row_id="doc_id")


@_query(f"SELECT original, cleaned FROM (SELECT id, {_duck(REMARKS)} AS original, {_duck(REMARKS, _STEPS['q_clean'][1])} AS cleaned {_FROM}) ORDER BY md5(id || '|42'), id LIMIT 10")
def q_sample_compare(spark, sf_dir):
    return sampling.sample_compare(_listings(spark, sf_dir), "remarks", 10, 42, key="id")


_LISTING_TABLE = {"L_ListingID": "id", "L_Address": "concat('Lot ', id)", "L_City": "concat('City ', id % 7)", "L_Keyword2": "CAST(id % 6 + 1 AS INT)", "LM_Dec_3": "CAST(id % 4 AS DOUBLE)", "L_SystemPrice": "CAST(id * 1000 AS DOUBLE)", "L_Remarks": "remarks"}


def _listing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(spark, sf_dir).selectExpr(*[f"{v} AS {k}" for k, v in _LISTING_TABLE.items()])


@_query(f"""SELECT id AS "L_ListingID", concat('Lot ', id) AS "L_Address", concat('City ', id % 7) AS "L_City", CAST(id % 6 + 1 AS INT) AS beds, CAST(id % 4 AS DOUBLE) AS bath, CAST(id * 1000 AS DOUBLE) AS price, remarks
FROM (SELECT id, {_duck(REMARKS)} AS remarks {_FROM}) WHERE strlen(remarks) > 50""")
def q_extract(spark, sf_dir):
    return extract_listings(_listing_table(spark, sf_dir), sample=None)


@_query()
def q_random_sample(spark, sf_dir):
    return extract_listings(_listing_table(spark, sf_dir), sample=1000, seed=7)


@_query(f"SELECT least(n, 1000)::BIGINT AS rows, least(n, 1000)::BIGINT AS ids, 0::BIGINT AS strange FROM (SELECT count(*) AS n FROM (SELECT {_duck(REMARKS)} AS remarks {_FROM}) WHERE strlen(remarks) > 50)")
def q_random_sample_facts(spark, sf_dir):
    """Of the random sample: its size, how many ids it has, and how many rows aren't of the table."""
    table = extract_listings(_listing_table(spark, sf_dir), sample=None)
    some = extract_listings(_listing_table(spark, sf_dir), sample=1000, seed=7)
    return some.join(table.select("L_ListingID", F.lit(0).alias("strange")), "L_ListingID", "left").agg(F.count("*").alias("rows"), F.count_distinct("L_ListingID").alias("ids"), F.sum(F.coalesce("strange", F.lit(1))).cast("long").alias("strange"))


def _profile_sql() -> str:
    pairs = _PAIRS.replace("doc_id, ", "").replace("lower(text)", "lower(remarks)").replace("FROM documents", "FROM l")
    prices, measures, abbrs = (_sums(x, "name") for x in (_PRICES, _MEASURES, _ABBRS))
    return f"""WITH l AS (SELECT {_duck(REMARKS)} AS remarks {_FROM}), {pairs},
pr AS ({prices}), me AS ({measures}), ab AS ({abbrs} ORDER BY n DESC, name LIMIT 10),
ht AS (SELECT name, count(*) AS n FROM (SELECT unnest(list_concat(regexp_extract_all(remarks, '{ENTITY}'), regexp_extract_all(remarks, '{TAG}'))) AS name FROM l) GROUP BY name),
un AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(remarks, '[^\\x00-\\x7F]')) AS name FROM l) GROUP BY name),
te AS (SELECT term AS name, n FROM c ORDER BY n DESC, term LIMIT 20)
SELECT 'null_rate' AS part, '' AS name, round(avg(CASE WHEN remarks IS NULL THEN 1.0 ELSE 0.0 END), 9) AS value FROM l
UNION ALL SELECT 'avg_length', '', round(avg(length(remarks)), 9) FROM l
UNION ALL SELECT 'avg_num_words', '', round(avg(len(regexp_extract_all(remarks, '{_NWS}'))), 9) FROM l
UNION ALL SELECT 'price_mentions', '', sum(n) FROM pr UNION ALL SELECT 'measurement_mentions', '', sum(n) FROM me
UNION ALL SELECT 'has_html', '', sum(n) FROM ht UNION ALL SELECT 'has_unicode', '', count(*) FROM un
UNION ALL SELECT 'price_counter', name, n FROM pr UNION ALL SELECT 'measurement_counter', name, n FROM me
UNION ALL SELECT 'html_examples', name, n FROM ht UNION ALL SELECT 'unicode_examples', name, n FROM un
UNION ALL SELECT 'common_terms', name, n FROM te UNION ALL SELECT 'common_abbreviations', name, n FROM ab"""


@_query(_profile_sql())
def q_profile_parts(spark, sf_dir):
    """All 13 parts of the profile as rows: part, name (of a label, tag, character, term or abbreviation) and value."""
    one = profile.profile_column(_listings(spark, sf_dir), "remarks", top_terms=20, tokenizer="space")

    def row(part: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), name.alias("name"), F.round(value.cast("double"), 9).alias("value"))

    scalars = ("null_rate", "avg_length", "avg_num_words", "price_mentions", "measurement_mentions", "has_html", "has_unicode")
    parts = [F.array(*[row(k, F.lit(""), F.col(k)) for k in scalars])]

    def rows(part: str, entries: Column, name: str, value: str) -> Column:
        return F.transform(entries, lambda e: row(part, e[name], e[value]))

    parts += [rows(k, F.map_entries(k), "key", "value") for k in ("price_counter", "measurement_counter", "html_examples", "unicode_examples")]
    parts += [rows("common_terms", F.col("common_terms"), "term", "count"), rows("common_abbreviations", F.col("common_abbreviations"), "abbr", "count")]
    return one.select(F.inline(F.concat(*parts)))


@_query()
def q_profile(spark, sf_dir):
    return profile.profile_column(_listings(spark, sf_dir), "remarks")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
