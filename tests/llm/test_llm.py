"""The training-data operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import functools
import html
import itertools
import math
import os
import re
import subprocess
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatrix.llm import packing, tokens, toxicity
from verbatrix.llm import queries as q
from verbatrix.llm.components import connected_components
from verbatrix.llm.embed_dedup import Quantised, near_duplicate_vectors
from verbatrix.llm.html_diff import common_lines, extract_main_text, lines_of, main_text
from verbatrix.llm.kd_topk import top_products
from verbatrix.llm.mixing import earliest_deadlines, mix_sources, schedule, whole_weights
from verbatrix.llm.packing import cuts, pack_documents, padding
from verbatrix.llm.quality_fm import FactorisationMachine, score_quality, train_quality
from verbatrix.llm.simhash import ball, fingerprint, fingerprint_links, links_of_bucket, simhash_groups
from verbatrix.llm.token_orc import SCHEMA, read_tokens, token_digests, write_token_orc
from verbatrix.llm.toxicity import score_toxicity, train_toxicity, windows_of
from verbatrix.llm.url_rules import judge_urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper kapok larch maple nettle oak pine quince rowan spruce teak".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text_of(rng, int(rng.integers(1, 60))), f"s{i % 3}" if i % 4 else "hot") for i in range(60)]
    rows += [(100, None, None), (101, "", "hot"), (102, " \t\n ", "hot"), (103, text_of(rng, 6000), "s1"), (104, "a  b\n\n c\t d ", "s1"), (None, "x y z", "s2"), (5, "again", "s2"), (5, "again", "s2")]
    return docs_of(spark, rows)


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = components(500, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def test_slots_are_those_of_earliest_deadlines():
    """Against a plain search over all blocks with fractions, and the deviation from the weights."""
    for weights in ([5, 3, 1, 1], [1.0], [100, 1, 1], [0, 0], [0.5, 1 / 3, 1e-3], [1e6, 100]):
        parts = whole_weights(weights)
        n, given = sum(parts), [0] * len(parts)
        share = [Fraction(a, n) for a in parts]
        for t, (i, k, release, due) in enumerate(itertools.islice(earliest_deadlines(parts), 400)):
            waiting = [(-(-Fraction(given[j] + 1) // f), j) for j, f in enumerate(share) if f and Fraction(given[j]) / f // 1 <= t]
            waiting = [(math.ceil((given[j] + 1) / share[j]), j) for _, j in waiting]
            assert (due, i) == min(waiting) and k == given[i] and release == math.floor(k / share[i]) <= t < due
            given[i] += 1
            assert all(abs(g - f * (t + 1)) < 1 for g, f in zip(given, share))
    parts = whole_weights([1e6, 100])
    small = [t for t, (i, *_) in enumerate(itertools.islice(earliest_deadlines(parts), 200_000)) if i]
    assert all(abs(k + 1 - (t + 1) * 100 / 1_000_100) < 1 for k, t in enumerate(small)) and len(small) in (19, 20)


def test_mixing(spark, docs):
    got = mix_sources(docs, {"hot": 1, "s0": 3}, block_docs=2, period=32).collect()
    assert sorted(r.mix_position for r in got) == list(range(docs.count()))
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert {r.mix_source for r in got} == {"hot", "s0", "s1", "s2", None}
    by_slot = sorted({(r.mix_slot, r.mix_source, r.mix_block) for r in got}, key=lambda x: x[0])
    assert [x[0] for x in by_slot] == list(range(len(by_slot)))
    for s in {x[1] for x in by_slot}:
        assert [x[2] for x in by_slot if x[1] == s] == sorted(x[2] for x in by_slot if x[1] == s)
    assert mix_sources(docs.limit(0)).count() == 0
    few = mix_sources(docs, block_docs=2, max_blocks=9).collect()
    assert sorted(r.mix_position for r in few) == list(range(docs.count())) and len({r.mix_slot for r in few}) <= 9 + 5
    odd = spark.createDataFrame([(None, s) for s in (None, "n", "\0null", "s", "")] * 3, "doc_id bigint, source string")
    assert {(r.mix_source, r["count"]) for r in mix_sources(odd, {None: 2, "n": 0}).groupBy("mix_source").count().collect()} == {(s, 3) for s in (None, "n", "\0null", "s", "")}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    assert sorted(r.mix_position for r in mix_sources(many).collect()) == list(range(3000))
    clash = mix_sources(docs.withColumns({"mix_slot": F.lit("x"), "src": F.lit(1), "rank": F.lit(2), "row": F.lit(3)}))
    assert dict(clash.dtypes)["mix_slot"] == "bigint" and clash.count() == docs.count()


def test_mixing_keeps_to_the_exact_weights():
    sizes = {f"s{i:02}": 64_000 if i else 640_000 for i in range(20)} | {"tiny": 64, "none": 130}
    weights = {s: n**0.5 for s, n in sizes.items()} | {"tiny": 1e-9, "none": 0.0}
    plan, short = schedule(sizes, weights, 64)
    total = sum(weights.values())
    first = min(p[0][-1] for p in plan.values()) + 1  # the first phase ends with the source that ends first
    assert first > 4 * 2048
    for s, (slots, releases, deadlines) in plan.items():
        own = np.searchsorted(np.array(slots), np.arange(first + 1))
        assert np.abs(own - weights[s] / total * np.arange(first + 1)).max() < 1 + 1e-6
        assert all(r <= t < d for t, r, d in zip(slots, releases, deadlines))
    assert sorted(t for p in plan.values() for t in p[0]) == list(range(sum(-(-n // 64) for n in sizes.values())))
    assert min(plan["none"][0]) > max(p[0][-1] for s, p in plan.items() if s != "none") and short == [(plan["none"][0][-1], 62)]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType())])


def vectors_of(spark, n=120, d=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, n, 3):
        x[i] = x[i // 9] + rng.normal(size=d).astype(np.float32) * 0.15
    x[50:70] = x[50]
    rows = [(i, [float(v) for v in x[i]], "n") for i in range(n)]
    rows += [(200, None, "n"), (201, [0.0] * d, "n"), (202, [float("nan")] * d, "n"), (203, [None] + [1.0] * (d - 1), "n"), (204, [1.0] * (d - 1), "n"), (205, [], "n"), (206, [float("inf")] * d, None)]
    return rows, spark.createDataFrame(rows, VECTORS)


def good(v, zero_too=False):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero_too or any(v))


def test_embedding_links(spark):
    rows, df = vectors_of(spark)
    ok = [r for r in rows if good(r[1]) and r[1]]
    pairs = []
    for a, b in itertools.combinations(ok, 2):
        if len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                pairs.append((a[0], b[0]))
    assert len(pairs) > 200
    want = components(300, pairs)
    for tile in (13, 1000):
        got = {r.vec_id: r for r in near_duplicate_vectors(df, tile_rows=tile).collect()}
        assert set(got) == {r[0] for r in rows}
        for i, r in got.items():
            assert (r.n_links, r.component_id, r.kept) == (sum(i in p for p in pairs), want[i], want[i] == i), i
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("vec", "tile", "copies", "component", "bytes")})
    assert sorted(map(tuple, near_duplicate_vectors(clash, tile_rows=13).collect())) == sorted(tuple(r) for r in got.values())


def test_embedding_links_at_any_size(spark):
    base = [[1.0, 2.0, -3.0, 0.5], [-1.0, 0.0, 2.0, 1.0]]
    rows = [(10 * i + j, [x * s for x in v]) for j, v in enumerate(base) for i, s in enumerate((1.0, 1e200, 1e-200, 1e-310, 5e307))]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, 4, i % 10) for i, _ in rows)


def test_quantised_bounds_are_safe():
    rng = np.random.default_rng(4)
    a, b = Quantised(rng.normal(size=(200, 32))), Quantised(rng.normal(size=(300, 32)) * 7)
    cos, product = a.unit @ b.unit.T, a.q.astype(int) @ b.q.astype(int).T
    for t in (-0.2, 0.1, 0.4):
        assert (product >= a.least_product(b, t)[:, None])[cos >= t].all()


def test_topk(spark):
    rows, df = vectors_of(spark)
    df = df.union(df.where("vec_id < 20"))
    ok = [(r[0], np.floor(256 * np.array(r[1], dtype=float)).astype(int)) for r in rows if good(r[1], True)]
    want = set()
    for i, x in ok:
        if i % 10 == 0:
            best = sorted((-int(x @ y), j) for j, y in ok if j != i and len(x) == len(y))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    for shard in (17, 5000):
        got = top_products(df, F.col("vec_id") % 10 == 0, shard_rows=shard, leaf=4, block=3)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert top_products(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(24)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 20), 1 << 20, 16)]) for i in range(40)]
    rows += [(50 + i, [float(1 << 23) if j == i else float(x) for j, x in enumerate(rng.integers(-30, 30, 16))]) for i in range(10)] + [(70, [1e300] + [0.0] * 15), (71, [5e6] * 16), (72, [0.0] * 16)]
    whole = {i: [int(np.floor(256 * x)) if abs(x) < 1e30 else int(x) * 256 for x in v] for i, v in rows}
    whole[70] = None
    want = {(i, k + 1, j, s) for i, x in whole.items() if i % 10 == 0 and x for k, (s, j) in enumerate(sorted(((sum(a * b for a, b in zip(x, y)), j) for j, y in whole.items() if y and j != i), key=lambda t: (-t[0], t[1]))[:5])}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in top_products(df.where("vec_id <> 70"), F.col("vec_id") % 10 == 0, shard_rows=17, leaf=4).collect()} == want
    with pytest.raises(Exception, match="doesn't fit a long"):
        top_products(df, F.col("vec_id") % 10 == 0).collect()


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path())


def plain_tokens(text):
    t = library()
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/orc"
    write_token_orc(docs, path, tokenizer_path=q.tokenizer_path())
    got = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    rows = docs.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id or -1, len(t := plain_tokens(r.text)), crc(t)) for r in rows)
    some = read_tokens(spark, path, [7, 103])
    assert sorted(r.doc_id for r in some.collect()) == [7, 103] and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    write_token_orc(docs.limit(0), f"{path}-empty", tokenizer_path=q.tokenizer_path())
    assert token_digests(spark, f"{path}-empty").count() == read_tokens(spark, f"{path}-empty").count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("tie", "task", "local_start", "token_ids", "order0")})
    write_token_orc(clash, f"{path}-clash", tokenizer_path=q.tokenizer_path())
    assert sorted(map(str, token_digests(spark, f"{path}-clash").collect())) == sorted(map(str, got))


def test_token_starts_over_many_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/orc"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        write_token_orc(docs, path, tokenizer_path=q.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "orc").glob("*.orc"))) >= 10
    at = 0
    for r in sorted(token_digests(spark, path).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for k, task in enumerate((9, 99999, 100000, 1234567)):
        spark.createDataFrame([(k, 0, 1, [k])], SCHEMA).coalesce(1).write.orc(f"{path}-{k}")
        next((tmp_path / f"orc-{k}").glob("*.orc")).rename((tmp_path / "many").mkdir(exist_ok=True) or tmp_path / "many" / f"part-{task:05}-x-c000.snappy.orc")
    assert sorted((r.doc_id, r.start) for r in token_digests(spark, f"file://{tmp_path}/many").collect()) == [(k, k) for k in range(4)]


def test_token_files_have_stripes_indexes_and_filters(spark, tmp_path):
    rng = np.random.default_rng(22)
    texts = [" ".join(rng.choice(WORDS, 150)) for _ in range(100)]
    rows = docs_of(spark, [(i, texts[i % 100], "s") for i in range(24_000)])
    write_token_orc(rows, f"file://{tmp_path}/orc", tokenizer_path=q.tokenizer_path(), stripe_mb=1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stripes = 0
    for f in (tmp_path / "orc").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        records = reader.rows()
        for stripe in reader.getStripes():
            footer = records.readStripeFooter(stripe).toString()
            assert "kind: ROW_INDEX" in footer and "kind: BLOOM_FILTER_UTF8" in footer
            stripes += 1
    assert stripes > len(list((tmp_path / "orc").glob("*.orc")))
    assert token_digests(spark, f"file://{tmp_path}/orc").count() == 24_000


def test_tokens_are_those_of_the_library(monkeypatch):
    t = tokens.CachedTokenizer(q.tokenizer_path())
    parts = ["a", "b.", "\n", " ", "'s", "é", "1", "“", "x(y)", "<|endoftext|>"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=4)] + ["hello <|endoftext|> world", "a\nb c\n\nd", "𝐢𝐝 ok", " " + "ñ" * 30, "it's we'll", "12,345.6 x", None, ""]
    for got, text in zip(t.documents(texts, 7), texts, strict=True):
        assert got.tolist() == [*plain_tokens(text)[:-1], 7], text
    assert 50256 in t.documents(["hello <|endoftext|> world"], 0)[0]
    rng = np.random.default_rng(23)
    long = " ".join("".join(rng.choice(list("abcdefgh\n.é"), int(rng.integers(1, 12)))).strip() or "x" for _ in range(3000))
    monkeypatch.setattr(tokens, "_AT_ONCE", 500)
    monkeypatch.setattr(tokens, "_PLACES", 1 << 10)  # forgets often
    small = tokens.CachedTokenizer(q.tokenizer_path())
    for got, text in zip(small.documents([long, "x", None, long[:100]], 0), [long, "x", None, long[:100]]):
        assert got.tolist() == plain_tokens(text)


def test_packing(spark, docs):
    got = pack_documents(docs, tokenizer_path=q.tokenizer_path(), chunk=3000).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(plain_tokens(r.text))
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
        assert any(crc(t[r.start : r.start + r.length]) == r.ids_crc32 and len(t) == r.doc_tokens for t in ids[r.doc_id])
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1] and sum(r.length for r in own) <= 1024
    assert sum(r.length for r in got) == sum(len(t) for ts in ids.values() for t in ts)
    assert set(pieces) == set(ids)
    pad = sum(padding(sum(r.length for r in own), 1024) for own in seqs.values())
    assert pad < 1024 * 5  # one short sequence a range
    clash = docs.withColumns({c: F.lit("x") for c in ("tie", "order0", "start", "sequence_id")})
    assert pack_documents(clash, tokenizer_path=q.tokenizer_path(), chunk=3000).agg(F.sum("length"), F.sum("ids_crc32")).first() == pack_documents(docs, tokenizer_path=q.tokenizer_path(), chunk=3000).agg(F.sum("length"), F.sum("ids_crc32")).first()
    assert pack_documents(docs.limit(0), tokenizer_path=q.tokenizer_path()).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        places = np.r_[0, np.cumsum(rng.integers(1, 9, 12))]
        costs = rng.integers(0, 6, 13).astype(float)
        got = cuts(places, costs, 16)

        def cost(path):
            return sum(costs[b] + packing.SEQUENCE + padding(int(places[b] - places[a]), 16) for a, b in zip(path, path[1:]))

        all_ = [[0, *c, 12] for n in range(12) for c in itertools.combinations(range(1, 12), n)]
        assert cost(got) == min(cost(p) for p in all_ if all(places[b] - places[a] <= 16 for a, b in zip(p, p[1:])))


def test_packing_is_the_cheapest(spark, docs):
    """One range and one chunk, against a quadratic search over the same places."""
    some = docs.where("doc_id is not null").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = pack_documents(some, tokenizer_path=q.tokenizer_path(), size=128).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    own = [np.array(plain_tokens(r.text), np.uint32) for r in sorted(some.withColumn("tie", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id, r.tie))]
    ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
    places, costs = packing.candidates(ids, ends, *tokens.sentence_ends(q.tokenizer_path()), 128)
    best = [0.0] + [np.inf] * (len(places) - 1)
    for i in range(1, len(places)):
        j = i - 1
        while j >= 0 and places[i] - places[j] <= 128:
            best[i] = min(best[i], best[j] + costs[i] + packing.SEQUENCE + padding(int(places[i] - places[j]), 128))
            j -= 1
    cost = dict(zip(places.tolist(), costs))
    lengths = {}
    for r in got:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    cut = np.cumsum([lengths[k] for k in sorted(lengths)]).tolist()
    assert sum(cost[p] + packing.SEQUENCE for p in cut) + sum(padding(n, 128) for n in lengths.values()) == pytest.approx(best[-1])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rng = np.random.default_rng(6)
    long = text_of(rng, 400).split()
    near = []
    for i in range(40):
        w = list(long)
        for _ in range(i % 4):
            w[int(rng.integers(400))] = "Éa"
        near.append((1000 + i, " ".join(w), "s"))
    df = docs.union(docs_of(spark, near))
    rows = df.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    assert all(fingerprint(r.text, step=7) == f for r, f in zip(rows, fps))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    label = components(len(rows), pairs)
    least = {c: min((rows[i].doc_id for i in range(len(rows)) if label[i] == c and rows[i].doc_id is not None), default=None) for c in set(label)}
    want = sorted((r.doc_id or -1, f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, label))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash_groups(df).collect()) == want
    assert simhash_groups(docs.limit(0)).count() == 0


def test_simhash_links_of_dense_groups(spark):
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    masks = ball(64, 2)
    fps = np.unique(np.concatenate([centre, *(c ^ rng.choice(masks, 60) ^ rng.choice(masks, 60) for c in centre), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    want = components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4])
    for variants in (1 << 21, 500):  # one bucket, and more than a hundred
        pairs = [(place[r.a], place[r.b]) for r in fingerprint_links(table, len(fps), bucket_variants=variants).collect()]
        assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in pairs)
        assert components(len(fps), pairs) == want
    flips = np.arange(len(ball(8, 2)), dtype="<u2")
    blob = len(fps).to_bytes(4, "little") + fps.astype("<u8").tobytes() + np.full(len(fps), len(flips), "<u2").tobytes() + np.tile(flips, len(fps)).tobytes()
    for at_once in (1 << 22, 4000):  # a bucket at once, and in parts
        links = links_of_bucket([blob], 4, 24, 8, 2, at_once)
        assert components(len(fps), [(place[int(a)], place[int(b)]) for a, b in links.view(np.int64)]) == want


def test_factorisation_machine_identity():
    rng = np.random.default_rng(8)
    m = FactorisationMachine(20, 3)
    m.w[:] = rng.normal(size=20)
    i, x = np.array([2, 5, 7, 11], np.int32), rng.normal(size=4).astype(np.float32)
    want = m.w0 + m.w[i] @ x + sum(m.v[a] @ m.v[b] * s * t for (a, s), (b, t) in itertools.combinations(zip(i, x), 2))
    assert abs(m.margin(i, x, np.array([0]))[0][0] - want) < 1e-4


def labelled(spark, rng, n=300):
    rows, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 1
        t = text_of(rng, 30)
        t = "!! ".join(t.upper().split()) if bad else t
        if rude:
            w = t.split()
            w.insert(int(rng.integers(len(w))), rng.choice(["blockhead", "bl-ockhead", "block.head", "blockxhead"]))
            t = " ".join(w)
        rows.append((i, t, "s"))
        labels.append((i, int(not bad), int(rude)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifiers(spark, docs):
    train, labels = labelled(spark, np.random.default_rng(9))
    test, truth = labelled(spark, np.random.default_rng(10), 100)
    truth = {r.doc_id: r for r in truth.collect()}
    model = train_quality(train, labels.union(spark.createDataFrame([(None, 1, 1), (7, None, None)], labels.schema)), F.lit(True))
    got = score_quality(test, model).collect()
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id].quality for r in got]) > 0.97
    tox = train_toxicity(train, labels, F.lit(True))
    got = score_toxicity(test, tox).collect()
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id].toxic for r in got]) > 0.95
    spelt = score_toxicity(docs_of(spark, [(1, "you b l o c k h e a d there", "s"), (2, "maple larch", "s"), (3, None, "s"), (4, "", "s")]), tox).collect()
    assert [r.score >= 0.5 for r in sorted(spelt, key=lambda r: r.doc_id)] == [True, False, False, False]
    for f, m in ((score_quality, model), (score_toxicity, tox)):
        out = f(docs.withColumn("score", F.lit("x")), m, keep=("doc_id", "lang", "score")).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        assert f(docs.limit(0), m).count() == 0 and f(docs, None).count() == docs.count()
    assert train_quality(train, labels.limit(0), F.lit(True)) is None and train_toxicity(train, labels.limit(0), F.lit(True)) is None


def counted(x):
    """The sum of weights of each subsequence of four symbols within six."""
    out = {}
    for c in itertools.combinations(range(len(x)), 4):
        if c[-1] - c[0] < 6:
            u = tuple(int(x[i]) for i in c)
            out[u] = out.get(u, 0) + 0.6 ** (c[-1] - c[0] - 3)
    return out


def cosine(a, b, q):
    product = lambda a, b: sum(v * b.get(u, 0) * q(u) for u, v in a.items())
    return product(a, b) / np.sqrt(product(a, a) * product(b, b))


def test_sentence_kernel_is_the_explicit_sum():
    rng = np.random.default_rng(17)
    texts = ["You, b.l.o.c.k and go! Get lost é now", "aaaa aaaa aaaa", " ".join(rng.choice(WORDS, 15))]
    w = windows_of(texts)
    place = lambda u: ((u[0] * 40 + u[1]) * 40 + u[2]) * 40 + u[3]
    rarity = rng.uniform(0.1, 1, 40**4).astype(np.float32)
    n = len(w.start)
    own = [counted(w.codes[a:b]) for a, b in zip(w.start, w.end)]
    kernel, used, phi = toxicity.landmark_map(w, np.arange(n), np.arange(0, n, 2), rarity)
    want = np.array([[cosine(a, b, lambda u: rarity[place(u)]) for b in own[::2]] for a in own])
    assert np.allclose(kernel, want, atol=1e-4) and np.allclose(np.diag(phi.T @ phi), 1, atol=1e-5)
    alpha = rng.normal(size=phi.shape[1])
    machine = toxicity.Machine(rarity)
    machine.table.real[used] = phi @ alpha * np.sqrt(rarity[used])
    sums = want @ alpha
    assert np.allclose(machine.margins(texts), [max(0, sums[w.text == i].max()) for i in range(3)], atol=1e-3)


def words_seen(text):
    w = windows_of([text])
    return ["".join(" " if c == 0 else chr(96 + c) if c < 27 else "?" for c in w.codes[a:b]) for a, b in zip(w.start, w.end)]


def test_sentences_are_cut_into_windows(monkeypatch):
    assert words_seen("One two!  Three-4\n\nfive.") == [" one two ", " threea ", " five "]
    assert words_seen("so i d. i. o t $tays é") == [" so idiot stays ? "]
    assert words_seen("") == words_seen(" .\n 99 -- ") == []
    assert words_seen("a bb cc dd ee ff gg hh ii jj") == [" a bb cc dd ee ff ", " dd ee ff gg hh ii ", " ee ff gg hh ii jj "]
    long = words_seen("x" * 90)
    assert [len(x) for x in long] == [92] and len(words_seen("y" * 400)) == 3
    machine = toxicity.Machine(np.ones(40**4, np.float32))
    rng = np.random.default_rng(3)
    machine.table.real = rng.normal(size=40**4)
    texts = [" ".join(rng.choice(WORDS, n)) for n in (400, 3, 90)] + [None, ""]
    want = machine.margins(texts)
    monkeypatch.setattr(toxicity, "AT_ONCE", 900)
    monkeypatch.setattr(toxicity, "OVERLAP", 300)
    assert np.abs(machine.margins(texts) - want).max() < 0.3 and want[3] == want[4] == 0  # windows begin elsewhere in a stretch


def test_toxicity_learns_phrases(spark):
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(WORDS, 40))
        rude = i % 4 == 0
        w[10:10] = ["get", "lost"] if rude else ["get"] if i % 4 == 1 else ["lost"]
        if i % 4 == 3:
            w[30:30] = ["get"]
        rows.append((i, " ".join(w) + ".", "s"))
        labels.append((i, 1, int(rude)))
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = train_toxicity(docs_of(spark, rows[:300]), labels, F.lit(True))
    got = [(r.score >= 0.5, r.doc_id % 4 == 0) for r in score_toxicity(docs_of(spark, rows[300:]), model).collect()]
    assert np.mean([p for p, rude in got if rude]) > 0.9 and np.mean([not p for p, rude in got if not rude]) > 0.9


def test_toxicity_crosses_white_space(spark):
    train, labels = labelled(spark, np.random.default_rng(9))
    texts = ["oak blo ckhead maple", "oak block\nhead maple", "oak bl ockh ead maple", "oak quince maple spruce teak", "elm fir oak"]
    got = score_toxicity(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), train_toxicity(train, labels, F.lit(True))).collect()
    assert [r.score >= 0.5 for r in sorted(got, key=lambda r: r.doc_id)] == [True, True, True, False, False]


def test_toxicity_tolerates_inserted_letters(spark):
    rng = np.random.default_rng(23)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(WORDS, 30))
        if i % 4 == 0:
            w.insert(int(rng.integers(len(w))), "blockhead")
        rows.append((i, " ".join(w) + ".", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    model = train_toxicity(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), F.lit(True))
    odd = [f"oak maple {'blockhead'[:k]}{c}{'blockhead'[k:]} spruce" for k in range(1, 9) for c in "xqe*_"]
    clean = [" ".join(rng.choice(WORDS, 8)) for _ in range(40)]
    got = sorted(score_toxicity(docs_of(spark, [(i, t, "s") for i, t in enumerate(odd + clean)]), model).collect(), key=lambda r: r.doc_id)
    assert all(r.score >= 0.5 for r in got[:40]) and not any(r.score >= 0.5 for r in got[40:])


def test_a_letter_is_inserted_in_the_worst_place():
    w = windows_of(["oak idiot elm", "maple"])
    place = lambda t: functools.reduce(lambda a, c: a * 40 + ord(c) - 96, t, 0)
    table = np.zeros(40**4, np.complex64)
    table[place("idio")] = 1
    more, copies = toxicity.inserted(w, np.array([0]), table, np.random.default_rng(1))
    a, b = more.start[copies[0]], more.end[copies[0]]
    x = "".join(" " if c == 0 else chr(96 + c) for c in more.codes[a:b])
    assert len(copies) == 1 and more.text[copies[0]] == 0 and x[:5] == " oak " and x[-5:] == " elm " and len(x) == len(" oak idiot elm ") + 1
    assert (more.start[:2] == w.start).all() and (more.codes[: len(w.codes)] == w.codes).all()


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "b.example.net", ""), ("block", "org", "/es/")]


def test_url_rules(spark):
    hosts = ["com", "Example.com", "www.example.com", "notexample.com", "example.community", "example.net", "a.b.example.net", "x.org", "", "org."]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/", "/en/7?x=/de/", "/en/71#a", "/de/", "/de/88/9", "/es/://x", "?q")] + [None, "", "nothing", "://", "http://com/en/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"rule": F.lit(1), "key": F.lit(2), "id": F.lit(3)})
    got = {r.page_id: r for r in judge_urls(df, RULES, keep=("page_id", "rule")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = sorted((len(h), len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
        want = fits[-1][2:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert judge_urls(df, []).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_common_lines_are_longest():
    rng = np.random.default_rng(11)
    for _ in range(60):
        a, b = ["".join(rng.choice(list("abc"), int(rng.integers(0, 9)))) for _ in range(2)]
        best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if re.search(".*".join(c), b)), default=0)
        got = common_lines(list(a), list(b))
        assert len(got) == best and re.search(".*".join(a[i] for i in got), b)


def test_common_lines_are_longest_at_every_size():
    rng = np.random.default_rng(15)
    for n, kinds in ((2400, 40), (2400, 1000)):
        a, b = ([str(x) for x in rng.integers(0, kinds, n)] for _ in range(2))
        a[700], b[1900] = "once", "once"  # an anchor that crosses the best alignment
        best = np.zeros(n + 1, np.int64)
        other = np.array(b)
        for t in a:  # one row of the table at a time
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(other == t, best[:-1] + 1, 0)))
        got = common_lines(a, b)
        assert len(got) == best[-1]
        rest = iter(b)
        assert got == sorted(set(got)) and all(a[i] in rest for i in got)


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div>Site &amp; name</div><div class='ad'>Buy</div>%s<div>All rights</div><footer>(c)</footer><script>var a='</p>';</script></body>"


def test_html(spark):
    article = "<article><h1>Head</h1><p>One &lt;b&gt;\n two<p>Three &nbsp; <b>four<br>five</article>"
    assert main_text(lines_of(PAGE % article), []) == "Head\n\nOne <b> two\n\nThree four five"
    plain = [PAGE % f"<div>Story {i} is told here at some length</div><p>And ends {i}</p>" for i in range(3)]
    rows = [(i, f"http://h.org/a/{i}", p, 0) for i, p in enumerate(plain)] + [(7, None, None, 0), (8, "http://x.org/", "", 0), (9, "http://y.org/z", PAGE % article, 0), (9, "http://y.org/z", PAGE % article, 0), (10, "http://z.org", "<p>cut <a href='", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").coalesce(1)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert [got[i] for i in range(3)] == [f"Story {i} is told here at some length\n\nAnd ends {i}" for i in range(3)]
    assert got[7] == got[8] == "" and got[9].startswith("Head") and got[10] == "cut"
    assert extract_main_text(df).count() == len(rows) and extract_main_text(df.limit(0)).count() == 0
    assert html.unescape("&amp;") == "&"


def plain_page(lines):
    return "".join(f"<div>{x}</div>" for x in lines)


SITE = [f"Template line {i} of this site, in which nothing is marked" for i in range(12)]


def test_html_looks_past_copies(spark):
    stories = [f"The story of {w} is told here: {w} grew tall, and {w} was cut in the end, as all {w} are" for w in WORDS]
    pages = [plain_page([*SITE, f"Copy {i}", *[f"{s}, chapter {k}" for k, s in enumerate(stories[:12])]]) for i in range(40)]  # near copies of one story
    rows = [(i, f"http://h.org/b/{i:03}", p) for i, p in enumerate(pages)]
    rows += [(100, "http://h.org/a", plain_page([*SITE, stories[15]])), (101, "http://h.org/c", plain_page([*SITE, stories[16]]))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert all(SITE[3] not in t for t in got.values()) and got[100] == stories[15] and got[101] == stories[16]
    assert all(got[i].startswith(f"Copy {i}\n") and got[i].count("chapter") == 12 for i in range(40))


def test_html_does_not_depend_on_the_ranges(spark):
    rows = []
    for i in range(61):
        host = f"h{i % 3}.org" if i % 4 else f"small{i // 8}.org"  # three large hosts and small ones of two pages
        copied = 5 <= i < 45 and i % 4 and i % 3 == 1
        story = "A story that many pages of this host tell in one and the same way" if copied else " ".join(f"{w}{i}" for w in WORDS[i % 8 :])
        rows.append((None if i == 9 else i, f"http://{host}/{i:03}", plain_page([f"{x} {host}" for x in SITE] + [story])))
    rows.append((99, "http://h1.org/030x", ""))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    held, texts = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 2, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            texts.append(sorted((r.url, r.page_id or -1, r.text) for r in extract_main_text(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert texts[0] == texts[1] == texts[2] == texts[3] and len(texts[0]) == len(rows)
    assert [u for u, _, t in texts[0] if SITE[0] in t] == []


def test_html_tells_short_articles_from_copies():
    long = [f"{x} or elsewhere on the many sites that our company runs" for x in SITE]
    a, b = ["Cats sleep most of the day and hunt mice and small birds by night"], ["Stock prices fell sharply on Monday morning, as brokers told us today"]
    of = lambda own: lines_of(plain_page([*long, *own]))
    assert main_text(of(a), [of(b)]) == a[0]
    assert main_text(of([*a, "12 May 10:31"]), [of([*a, "3 June 9:05"])]).startswith(long[0])  # a copy with another date
    assert main_text(of(a), [of(a)]).startswith(long[0])


def test_waiting_pages_go_to_a_file(monkeypatch):
    from verbatrix.llm import html_diff

    monkeypatch.setattr(html_diff, "HELD", 5_000)
    sweep, got = html_diff.Sweep(), []
    for i in range(50):
        got += sweep.page((i,), "h", lines_of(plain_page([*SITE, "one and the same story, " * 9])))
    assert not got and sweep.held.file
    got += [*sweep.page((50,), "h", lines_of(plain_page([*SITE, "another story altogether, " * 9]))), *sweep.end()]
    assert sorted(i for i, _ in got) == list(range(51)) and not any(SITE[0] in t for _, t in got)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(12)
    docs, labels = labelled(spark, rng)
    docs = docs.union(docs_of(spark, [(1000 + i, r.text, "s") for i, r in enumerate(docs.where("doc_id % 20 = 2").collect())]))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path), docs, labels


def test_pipeline(spark, corpus):
    import corpus_pipeline

    path, docs, labels = corpus
    got = corpus_pipeline.run(spark, path).collect()
    kept = {r.doc_id for r in got}
    truth = {r.doc_id: r for r in labels.collect()}
    assert not any(i >= 1000 for i in kept)
    assert np.mean([(i in kept) == bool(t.quality and not t.toxic) for i, t in truth.items()]) > 0.95
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "mixing", "packing"]


def test_pipeline_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls, empty tables, repeated ids and rows, clashing columns."""
    import corpus_pipeline

    path, docs, _ = corpus
    rng = np.random.default_rng(25)
    a, b, c = (text_of(rng, 40) for _ in range(3))
    rows = [(1, a, "en", "s", 3), (1, b, "en", "s", 3), (2, a, "en", "s", 3), (None, a, "en", "s", 3), (3, c, "en", "s", 3), (3, c, "en", "s", 3), (None, b, None, None, None), (7, None, None, None, None), (8, "", None, None, 0), (None, "", "en", "x", 0)]
    odd = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("x") for n in ("score", "group", "component_id", "__quality", "mix_slot", "text_", "fp")})
    kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, odd, path).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[4], rows[7]], key=str)  # of a, b, c and the empty texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == list(corpus_pipeline.COLUMNS) and set(map(tuple, out.collect())) <= set(rows)
        assert stage(spark, odd.limit(0), path).count() == 0
        if name == "mixing":
            assert out.count() == len(rows)
    odd.write.parquet(f"{tmp_path}/odd")
    packed = corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/odd"), path)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(plain_tokens(r[1])) for r in rows)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity):
        assert stage(spark, odd, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("stage", ["near_duplicates", "packing"])
def test_stages_run_in_applications_of_their_own(stage, tmp_path):
    """As after a restart: no stage before has sent the package, and the workers' path doesn't have it."""
    top = Path(__file__).resolve().parents[2]
    code = f"""if True:
        import sys
        sys.path.insert(0, {str(top)!r})
        import corpus_pipeline
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
        rows = [(1, "a b c d e", "en", "x", 9), (2, "a b c d e", "en", "x", 9), (3, None, "en", "y", 0)]
        spark.createDataFrame(rows, {DOCS!r}).write.parquet("docs")
        print("ROWS", corpus_pipeline.{stage}(spark, spark.read.parquet("docs"), ".").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert f"ROWS {2 if stage == 'near_duplicates' else 3}" in out.stdout, out.stderr[-2000:]


def test_shared_files_can_be_cleared(spark):
    from verbatrix.llm import common

    path = common.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.clear_shared(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert common.pinned(spark.range(2)).count() == 2
