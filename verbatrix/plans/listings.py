"""The property-listing plans: extraction, and remarks for tests made from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import random_sample

#: The listing table's columns and their new names.
COLUMNS = {"L_ListingID": "L_ListingID", "L_Address": "L_Address", "L_City": "L_City", "L_Keyword2": "beds", "LM_Dec_3": "bath", "L_SystemPrice": "price", "L_Remarks": "remarks"}


def extract_listings(listings: DataFrame, *, least_bytes: int = 50, sample: int | None = 1000, seed: int | None = None) -> DataFrame:
    """Seven renamed columns of the rows whose remarks have over ``least_bytes`` bytes, and a random sample of them."""
    rows = listings.where(F.octet_length("L_Remarks") > least_bytes).select(*[F.col(a).alias(b) for a, b in COLUMNS.items()])
    return rows if sample is None else random_sample(rows, sample, seed)


#: By p_partkey % 11; z, n, s are p_size, 100 + p_size, 100 * p_size. SQL that Spark and DuckDB both read.
REMARKS = {
    0: "'Cottage with ' || z || ' br and 3 ba over ' || s || ' sqft; offers from ' || n || 'k. W/ patio.'",
    1: "'Villa near the lake, $2.4m, doors of 8' || q || ', ' || z || '.5 acres &amp; a barn.'",
    2: "'Loft .75 mile from town: 12ft walls, 4\" shelf, was $7.5k more'",
    3: "'Estate at $2,345,678, ' || n || ',250 sq. ft. and ' || z || ' thousand vines'",
    4: "'Once $2,468k, court 30m x 6' || q || 'x8' || q || ', 7' || q || '9\" gate'",
    5: "'Field 3.5 acre, pond 1 acre, 40 sq m shed, a/c, w/d, w/o hoa'",
    6: "'<p>Corner&nbsp;unit &lt;i&gt;sunny&lt;/i&gt; &quot;' || z || ' yr&quot; B&amp;B</p>'",
    7: "'“Airy” 7’ hall – 3½ rooms … by 1２ elms'",
    8: "CAST(NULL AS STRING)",
    9: "'Elm Dr, 4br, w/cellar, 501k'",
    10: "'  Asking $ 640, or 1.5 Million for both, 900 Square   Feet in all  '",
}


def by_template(texts: dict[int, str], changed: dict[int, str] | None = None) -> str:
    return "CASE k " + " ".join(f"WHEN {t} THEN {x}" for t, x in (texts | (changed or {})).items()) + " END"


#: Columns that the expressions above name. ``q`` is an apostrophe.
PARTS = "SELECT p_partkey AS id, p_partkey % 11 AS k, CAST(p_size AS STRING) AS z, CAST(100 + p_size AS STRING) AS n, CAST(100 * p_size AS STRING) AS s, CAST(1000 * (100 + p_size) AS STRING) AS nk, CAST(1000 * p_size AS STRING) AS zk, {q} AS q FROM {part}"


def listings(part: DataFrame) -> DataFrame:
    """(id, remarks)."""
    rows = part.selectExpr("p_partkey AS id", "p_partkey % 11 AS k", "CAST(p_size AS STRING) AS z", "CAST(100 + p_size AS STRING) AS n", "CAST(100 * p_size AS STRING) AS s").withColumn("q", F.lit("'"))
    return rows.select("id", F.expr(by_template(REMARKS)).alias("remarks"))
