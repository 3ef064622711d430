"""Every registered query of the profiling engine against its SQL, on the small data set."""

import math
import os

import duckdb
import pytest

from verbatrix import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def cell(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return float(f"{float(x):.9g}") if not math.isnan(float(x)) else None

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.oracle_sql()[name])
    names, rows = [d[0] for d in want.description], want.fetchall()
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(rows, names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_all_abbreviations_of_documents(spark, tmp_path):
    from collections import Counter

    from verbatrix.functions.fixed import ABBREVIATIONS

    keys, rng = sorted(ABBREVIATIONS), __import__("random").Random(3)
    used = [[rng.choice(keys) for _ in range(i % 5)] for i in range(40)]
    texts = [", and ".join(["here", *(k.upper() if i % 2 else k for k in own), "there"]) for i, own in enumerate(used)]
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.abbr: r.n for r in catalog.queries()["q_abbrev_documents"](spark, str(tmp_path)).collect()}
    want = Counter(k for own in used for k in own)
    assert got == want and any(not k.isalpha() for k in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
