"""Near-duplicate vectors by int8 tile products with error bounds, and full precision where they can't tell."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned
from .components import component_least, connected_components
from .vectors import matrix_rows


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector's bytes (doubles), null for vectors that take no part."""
    for batch in batches:
        out = [None if v is None or not np.any(v) else (v + 0.0).tobytes() for v in matrix_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by powers of two first, so no finite row's squares over- or underflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantised:
    """Unit rows as int8 with one scale for the tile, and for each row the norms of what is stored and of the error."""

    def __init__(self, x: np.ndarray):
        self.unit = unit_rows(x)
        self.scale = 127 / np.abs(self.unit).max()
        self.q = np.rint(self.unit * self.scale).astype(np.int8)
        stored = self.q / self.scale
        self.size = np.linalg.norm(stored, axis=1)
        self.error = np.linalg.norm(self.unit - stored, axis=1)

    def packed(self) -> bytes:
        """Without the unit rows."""
        return pickle.dumps((self.scale, self.q, self.size.astype(np.float32), np.nextafter(self.error.astype(np.float32), np.float32(9))), 5)

    @classmethod
    def unpacked(cls, blob: bytes) -> Quantised:
        out = cls.__new__(cls)
        out.scale, out.q, out.size, out.error = pickle.loads(blob)
        return out

    def least_product(self, other: Quantised, threshold: float) -> np.ndarray:
        """For each row: an integer product with a row of ``other`` below this proves a cosine below ``threshold``.

        <u, v> = <u' + e, v' + f> <= <u', v'> + |u'||f| + |e||v'| + |e||f|, with |f| and |v'| at most ``other``'s largest.
        """
        most_f, most_v = other.error.max(), other.size.max()
        return (threshold - 1e-6 - self.size * most_f - self.error * most_v - self.error * most_f) * self.scale * other.scale - 0.5


def _products(a: Quantised, b: Quantised, threshold: float, same: bool, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, open pairs) by stretch of ``a``'s rows: those that the bounds don't rule out, where there are any.

    Products of int8 values are exact in single precision (up to 1,000 dimensions; else double is used).
    """
    kind = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qb, least = b.q.astype(kind).T, a.least_product(b, threshold)
    for lo in range(0, len(a.q), rows):
        open_ = a.q[lo : lo + rows].astype(kind) @ qb >= least[lo : lo + rows, None]
        if same:
            np.fill_diagonal(open_[:, lo:], False)
        if open_.any():
            yield lo, open_


def open_rows(a: Quantised, b: Quantised, threshold: float, same: bool, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that are in an open pair."""
    mine, theirs = np.zeros(len(a.q), bool), np.zeros(len(b.q), bool)
    for lo, open_ in _products(a, b, threshold, same, rows):
        mine[lo : lo + rows] |= open_.any(1)
        theirs |= open_.any(0)
    return np.flatnonzero(mine), np.flatnonzero(theirs)


def tile_links(a: Quantised, b: Quantised, threshold: float, same: bool, rows: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, links) by stretch of ``a``'s rows: a boolean block against all rows of ``b``, None where no link is.

    Open pairs are computed in double precision: one by one, or as a block where they are many.
    """
    for lo, open_ in _products(a, b, threshold, same, rows):
        count = np.count_nonzero(open_)
        if count * 50 > open_.size:
            open_ &= (a.unit[lo : lo + rows] @ b.unit.T) >= threshold
        else:
            i, j = np.nonzero(open_)
            for k in range(0, count, 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                open_[x, y] = np.einsum("ij,ij->i", a.unit[lo + x], b.unit[y]) >= threshold
        yield lo, open_


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    x = np.frombuffer(b"".join(frame["vec"]), "<f8").reshape(len(frame), -1)
    return pd.DataFrame({"bytes": frame["bytes"].iloc[:1], "tile": frame["tile"].iloc[:1], "nodes": [frame["node"].to_numpy()], "blob": [Quantised(x).packed()]})


def _screen(threshold: float):
    """For each pair of tiles: the nodes in open pairs, with their tile."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, one, two, nodes, blob, others, other in frame[["bytes", "tile", "with", "nodes", "blob", "others", "other"]].itertuples(index=False):
                tiles = [Quantised.unpacked(blob)] + ([Quantised.unpacked(other)] if one != two else [])
                mine, theirs = open_rows(tiles[0], tiles[-1], threshold, one == two)
                found = [(one, nodes[mine])] + ([(two, others[theirs])] if one != two else [])
                lo, hi = min(one, two), max(one, two)
                for tile, some in found:
                    if len(some):
                        yield pd.DataFrame({"bytes": np.int32(size), "lo": np.int32(lo), "hi": np.int32(hi), "tile": np.int32(tile), "node": some})

    return run


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        frame = frame.sort_values(["tile", "node"])
        x = np.frombuffer(b"".join(frame["vec"]), "<f8").reshape(len(frame), -1)
        first = (frame["tile"] == lo).to_numpy()
        nodes, copies, n = frame["node"].to_numpy(), frame["copies"].to_numpy(), int(first.sum())
        tiles = [Quantised(x[:n])] if lo == hi else [Quantised(x[:n]), Quantised(x[n:])] if 0 < n < len(x) else []
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        shift = 0 if lo == hi else n
        for start, block in tile_links(tiles[0], tiles[-1], threshold, lo == hi) if tiles else ():
            links[start : start + len(block)] += block @ copies[shift:]
            if shift:
                links[shift:] += copies[start : start + len(block)] @ block
            for i in np.flatnonzero(block.any(axis=1)):
                joined = np.unique(np.r_[label[start + i], label[shift:][block[i]]])
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        some = np.flatnonzero((links > 0) | (label != np.arange(len(x))))
        return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[label[some]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, *, key: str = "vec_id", vec: str = "embedding", threshold: float = 0.9, tile_rows: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per vector: vectors link at a cosine of ``threshold`` or more.

    Equal vectors are one node with a number of copies, so copies are never paired. The nodes are dealt to tiles
    of about ``tile_rows``, each a row of int8 values and error bounds. Every pair of tiles is screened in bounded memory by their
    integer products; of the nodes that are in a pair which the bounds leave open, and of those only, the doubles are then fetched, tile
    pair by tile pair. That returns each node's number of links and the edges of a spanning forest, not the pairs. All tiles meet,
    so the products grow with the square of the distinct vectors, and a byte a component is shuffled once for every tile.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; finite ones link however large or small. Vectors of
    different lengths don't link. Rows that repeat an id are vectors of their own; a null id counts as no id
    in component_id. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("v")).mapInArrow(_valid, "vec_id bigint, vec binary")
    rows = pinned(rows)
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = pinned(nodes.withColumn("node", F.monotonically_increasing_id()))
    tiles = max(1, -(-nodes.count() // tile_rows))
    tiled = nodes.select("node", "copies", "vec", F.length("vec").alias("bytes"), F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("tile"))
    blobs = pinned(tiled.groupBy("bytes", "tile").applyInPandas(_build, "bytes int, tile int, nodes array<bigint>, blob binary"))
    # tile t meets t, t + 1, ... half way round, so each has as many partners and only the left tile is sent to each of them
    left = blobs.select("bytes", "tile", "nodes", "blob", F.explode(F.sequence(F.lit(0), F.lit(tiles // 2))).alias("step")).withColumn("with", (F.col("tile") + F.col("step")) % tiles)
    left = left.where((2 * F.col("step") != tiles) | (F.col("tile") < F.col("with"))).drop("step")
    pairs = left.join(blobs.select("bytes", F.col("tile").alias("with"), F.col("nodes").alias("others"), F.col("blob").alias("other")).hint("shuffle_hash"), ["bytes", "with"])
    open_ = pinned(pairs.mapInPandas(_screen(threshold), "bytes int, lo int, hi int, tile int, node bigint"))
    fetched = open_.join(nodes.select("node", "copies", "vec"), "node")
    found = pinned(fetched.groupBy("bytes", "lo", "hi").applyInPandas(_compare(threshold), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = component_least(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), nodes.select("node", "least"))
    named = nodes.select("node", "vec", "copies", "least").join(links, "node", "left").join(parts, "node", "left")
    least = F.when(F.col("linked"), F.col("component_least")).otherwise(F.col("least"))
    named = named.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), least.alias("component_id"))
    linked = rows.where("vec is not null").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
