"""Exact inner-product search with a KD-tree for each shard."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from fractions import Fraction
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned
from .vectors import matrix_rows

_LARGEST = 1 << 30


def _whole(scale: float):
    """vec_id, length, wide and floor(scale * x): 32-bit integers, or where a component needs more, pickled Python integers (wide). Vectors that take no part are left out."""

    def exact(x: float) -> int:
        return math.floor(Fraction(x) * Fraction(scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, size, wide, blob = [], [], [], []
            for i, v in enumerate(matrix_rows(batch.column(1))):
                if v is None:
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * v)
                large = bool(len(v)) and not np.abs(whole).max() < _LARGEST
                place.append(i)
                size.append(len(v))
                wide.append(large)
                blob.append(pickle.dumps([exact(x) for x in v.tolist()], 5) if large else whole.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(size, pa.int32()), pa.array(wide, pa.bool_()), pa.array(blob, pa.binary())], ["vec_id", "dim", "wide", "vec"])

    return run


def _row(blob: bytes, wide: bool) -> list[int]:
    return pickle.loads(blob) if wide else np.frombuffer(blob, "<i4").tolist()


def _exact(ids: list[int], rows: list[list[int]], query: list[int], own: int, k: int) -> list[tuple[int, int]]:
    """(score, -vec_id) of the ``k`` best rows, in Python's integers."""
    return heapq.nlargest(k, ((sum(map(mul, r, query)), -i) for i, r in zip(ids, rows) if i != own))


class KDTree:
    """Nodes in the order they were split; each has a tight box of its rows. Leaves are stretches of the rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 128):
        order = np.arange(len(x))
        self.span, self.kids, lows, highs = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = x[order[a:b]]
            low, high = rows.min(0), rows.max(0)
            me = len(self.span)
            self.span.append((a, b))
            self.kids.append([-1, -1])
            lows.append(low)
            highs.append(high)
            if parent >= 0:
                self.kids[parent][side] = me
            if b - a > leaf and (high > low).any():
                axis, mid = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.low, self.high = np.array(lows, np.float64), np.array(highs, np.float64)
        self.ids, self.rows = ids[order], np.ascontiguousarray(x[order])

    def best(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, kth: float) -> list[tuple[int, int]]:
        """(score, -vec_id) of the k best rows but ``own`` that may beat ``kth``, a score that k others are known to reach.

        Nodes are visited in the order of the largest product that their box allows, until it falls below the kth.
        """
        top: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            left, right = self.kids[node]
            if left >= 0:
                for kid in (left, right):
                    if bounds[kid] >= kth:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            a, b = self.span[node]
            scores = self.rows[a:b] @ query
            for i in np.flatnonzero(scores >= kth):
                if self.ids[a + i] != own:
                    item = (int(scores[i]), -int(self.ids[a + i]))
                    if len(top) < k:
                        heapq.heappush(top, item)
                    elif item > top[0]:
                        heapq.heapreplace(top, item)
            if len(top) == k:
                kth = max(kth, top[0][0])
        return top

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with a point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _build(leaf: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["vec_id"].to_numpy(np.int64)
        if frame["wide"].iloc[0]:
            tree = ids.tolist(), [_row(bytes(v), True) for v in frame["vec"]]
        else:
            x = np.frombuffer(b"".join(frame["vec"]), "<i4").reshape(len(frame), -1)
            tree = KDTree(ids, x if x.shape[1] else np.zeros((len(frame), 1), np.int32), leaf)
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "shard": frame["shard"].iloc[:1], "wide": frame["wide"].iloc[:1], "tree": [pickle.dumps(tree, 5)]})

    return run


def _searched(tree: KDTree, ids: list[int], vecs: list[bytes], known: list[float | None], k: int) -> Iterator[tuple[int, int, int]]:
    queries = np.array([np.frombuffer(v, "<i4") for v in vecs]).reshape(len(ids), -1).astype(np.float64)
    if not queries.shape[1]:
        queries = np.zeros((len(ids), 1))
    largest = int(max(np.abs(tree.low).max(), np.abs(tree.high).max())) * int(np.abs(queries).sum(1).max())
    bounds = tree.bounds(queries)
    if largest < 1 << 52:
        tree.rows = tree.rows.astype(np.float64)
    elif largest < 1 << 62:  # doubles would round: whole numbers, and bounds with room for the rounding
        tree.rows, queries = tree.rows.astype(np.int64), queries.astype(np.int64)
        bounds += np.abs(bounds) * 1e-9
    else:
        rows = tree.rows.tolist()
        for q, x in zip(ids, queries.astype(np.int64).tolist()):
            yield from ((q, -i, s) for s, i in _exact(tree.ids.tolist(), rows, x, q, k))
        return
    for q, x, b, t in zip(ids, queries, bounds, known):
        yield from ((q, -i, s) for s, i in tree.best(x, b, q, k, -np.inf if t is None or np.isnan(t) else t))


def _search(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob, wide, ids, vecs, broad, known in frame[["tree", "wide", "ids", "vecs", "broad", "known"]].itertuples(index=False):
                tree, vecs = pickle.loads(blob), [bytes(v) for v in vecs]
                if not wide and not broad:
                    out = list(_searched(tree, ids, vecs, known, k))
                else:  # some numbers need more than 30 bits: no tree, every row
                    mine, rows = tree if wide else (tree.ids.tolist(), tree.rows.tolist())
                    out = [(q, -i, s) for q, v in zip(ids, vecs) for s, i in _exact(mine, rows, _row(v, broad), q, k)]
                for q, _, s in out:
                    if not -(1 << 63) <= s < 1 << 63:
                        raise OverflowError(f"one of the best scores of query {q} doesn't fit a long: {s}")
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_products(vectors: DataFrame, is_query, *, key: str = "vec_id", vec: str = "embedding", k: int = 5, scale: float = 256.0, shard_rows: int = 8192, block: int = 512, leaf: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer products of floor(scale * x) for each row where ``is_query`` holds.

    Rows are dealt to shards, each with a KD-tree built once: median splits on the widest side, tight boxes. The
    stated queries go in blocks of ``block`` to every shard. They first search one shard, and the kth score
    they find there goes with them to the others, where it prunes boxes from the start. At most ``k`` rows for each
    query and shard are merged.

    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part, as
    query or candidate; those of another length are no candidates. A candidate that has the query's own id is
    left out; equal rows (id and vector) count once; rows with a null id take no part. Finite components of any size are
    exact: vectors with one of 2^30 or more after scaling are compared with every row in Python's integers. A best score beyond a long raises OverflowError. Fewer than ``k`` candidates give fewer rows; an empty table gives none; other
    columns are not read.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("v"))
    rows = pinned(rows.mapInArrow(_whole(scale), "vec_id bigint, dim int, wide boolean, vec binary").distinct())
    shards = max(1, -(-rows.count() // shard_rows))
    trees = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("dim", "shard", "wide").applyInPandas(_build(leaf), "dim int, shard int, wide boolean, tree binary")
    trees = pinned(trees)
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))

    def searched(queries: DataFrame, at: list[int]) -> DataFrame:
        dealt = queries.groupBy("dim", "block", F.col("wide").alias("broad")).agg(F.collect_list(F.struct("vec_id", "vec", "known")).alias("q"))
        dealt = dealt.select("dim", "broad", F.explode(F.array(*[F.lit(s) for s in at]) if len(at) < 2 else F.sequence(F.lit(at[0]), F.lit(at[-1]))).alias("shard"), F.col("q.vec_id").alias("ids"), F.col("q.vec").alias("vecs"), F.col("q.known").alias("known"))
        dealt = dealt.repartition(F.col("dim"), F.col("shard"))
        return dealt.join(trees, ["dim", "shard"]).select("tree", "wide", "ids", "vecs", "broad", "known").mapInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")

    found = pinned(searched(asked.withColumn("known", F.lit(None).cast("double")), [0]))
    if shards > 1:
        kth = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).cast("double").alias("known"))
        found = found.unionByName(searched(asked.join(kth, "vec_id", "left"), list(range(1, shards))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
