"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels: a source's name behind NAMED, or NO_SOURCE for null.
NAMED, NO_SOURCE = "s", "n"


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights (negative ones as 0); all equal if none is above 0."""
    ratios = [max(float(w), 0.0).as_integer_ratio() for w in weights]
    if not any(n for n, _ in ratios):
        return [1] * len(weights)
    most = max(d for _, d in ratios)  # powers of two
    whole = [n * (most // d) for n, d in ratios]
    common = math.gcd(*whole)
    return [n // common for n in whole]


def earliest_deadlines(parts: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of slots 0, 1, ... without end, earliest deadline first.

    With n = sum(parts), block k of a source with a parts is released at floor(k*n/a) and due by ceil((k+1)*n/a),
    in whole numbers, so every block meets its deadline and no source is ever a whole block ahead of or behind its
    share, however many slots there are. Sources with no part get no slot.
    """
    n = sum(parts)
    waiting = [(0, i, 0) for i, a in enumerate(parts) if a]
    ready: list[tuple[int, int, int, int]] = []
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-((k + 1) * n // -parts[i]), i, k, release))
        due, i, k, release = heapq.heappop(ready)
        yield i, k, release, due
        heapq.heappush(waiting, ((k + 1) * n // parts[i], i, k + 1))


def schedule(sizes: Mapping[str, int], weights: Mapping[str, float], block_docs: int) -> tuple[dict[str, tuple[array, array, array]], list[tuple[int, int]]]:
    """Slots, releases and deadlines of each source's blocks, and (slot, missing documents) of each short last block.

    A phase lasts until a source has no block left; the others go on with their weights in proportion.
    """
    left = {s: -(-n // block_docs) for s, n in sorted(sizes.items()) if n > 0}
    plan = {s: (array("q"), array("q"), array("q")) for s in left}
    short, at = [], 0
    while left:
        names = list(left)
        begun = at
        for i, _, release, due in earliest_deadlines(whole_weights([weights[s] for s in names])):
            s = names[i]
            for held, x in zip(plan[s], (at, begun + release, begun + due), strict=True):
                held.append(x)
            at += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                if sizes[s] % block_docs:
                    short.append((at - 1, block_docs - sizes[s] % block_docs))
                break
    return plan, short


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, temper: float = 0.5, key: str = "doc_id", source: str = "source", block_docs: int = 64, max_blocks: int = 1 << 20, period: int = 2048, seed: int = 20, prefix: str = "mix_") -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_slot, mix_release, mix_deadline and mix_position (from 0, without gaps).

    A source's documents, in the order of a seeded hash of ``key`` and the other columns, form blocks of ``block_docs``, or of more, so that there are
    about ``max_blocks`` blocks at most. Block k of a
    source takes the slot that :func:`earliest_deadlines` gives it by the exact weights, so after any number of slots
    of a phase each source's blocks differ from its weight's share by less than one; sources of weight 0 come last.
    ``weights``: by source (None: the null source; sources not named get the
    mean of those given); without them, a source weighs its number of documents to the power ``temper``. Every
    document is kept exactly once: when a source ends, the others share its slots.

    Scale: ranks come from counts by (source, one of 4096 hash ranges), so that no task holds a source. One
    count a source reaches the driver, which deals the slots one at a time and broadcasts 24 bytes a block: 25 MB at ``max_blocks``, however many
    documents there are, and 24 bytes a source where there are more sources than that.

    A null source is a source of its own; null and repeated keys are kept and spread by the other columns (equal rows in any order); an empty
    table gives an empty result; columns of ``docs`` named like a result are replaced.
    """
    spark = docs.sparkSession
    made = [prefix + c for c in ("source", "block", "slot", "release", "deadline", "position")]
    kept = [c for c in docs.columns if c not in made]
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    label = F.when(F.col(source).isNull(), F.lit(NO_SOURCE)).otherwise(F.concat(F.lit(NAMED), F.col(source).cast("string")))
    h = F.xxhash64(F.lit(seed), F.col(key), *[F.col(f"`{c}`") for c in plain])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), label.alias("src"), h.alias("h")).withColumn("part", F.shiftright("h", 52))
    counts = docs.select(label.alias("src"), F.shiftright(h, 52).alias("part")).groupBy("src", "part").agg(F.count("*").alias("n"))
    sizes = {r.src: r.n for r in counts.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    block_docs = max(block_docs, -(-sum(sizes.values()) // max_blocks))
    stated = {NO_SOURCE if k is None else NAMED + k: float(w) for k, w in (weights or {}).items()}
    mean = sum(stated.values()) / len(stated) if stated else 1.0
    target = {s: stated.get(s, mean) if weights is not None else float(n) ** temper for s, n in sizes.items()}
    slots, short = schedule(sizes, target, block_docs)
    dealt = [(src, lo // period, *(x[lo : lo + period] for x in three)) for src, three in slots.items() for lo in range(0, len(three[0]), period)]
    many = pa.list_(pa.int64())
    fields = [("src", pa.string()), ("stretch", pa.int64()), ("slots", many), ("releases", many), ("deadlines", many)]
    columns = list(zip(*dealt)) or [()] * len(fields)
    plan = spark.createDataFrame(pa.table([pa.array([x if isinstance(x, (str, int)) else x.tolist() for x in c], t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]))
    lacks = F.array(*[F.struct(F.lit(t).cast("long").alias("slot"), F.lit(n).cast("long").alias("missing")) for t, n in sorted(short)]) if short else F.array().cast("array<struct<slot: bigint, missing: bigint>>")
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("src", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_part = Window.partitionBy("src", "part").orderBy("h")
    ranked = rows.join(starts, ["src", "part"]).withColumn("rank", F.col("start") + F.row_number().over(in_part) - 1)
    ranked = ranked.withColumns({"block": F.floor(F.col("rank") / block_docs), "inside": F.col("rank") % block_docs})
    placed = ranked.withColumn("stretch", F.floor(F.col("block") / period)).join(F.broadcast(plan), ["src", "stretch"])
    inside = (F.col("block") - F.col("stretch") * period).cast("int")
    placed = placed.withColumns({n: F.get(n + "s", inside) for n in ("slot", "release", "deadline")})
    placed = placed.withColumn("missing", F.aggregate(lacks, F.lit(0).cast("long"), lambda s, x: s + F.when(x["slot"] < F.col("slot"), x["missing"]).otherwise(0)))
    out = {
        "source": F.when(F.col("src") != NO_SOURCE, F.substring("src", 1 + len(NAMED), 1 << 30)),
        "block": F.col("block"),
        "slot": F.col("slot"),
        "release": F.col("release"),
        "deadline": F.col("deadline"),
        "position": F.col("slot") * block_docs + F.col("inside") - F.col("missing"),
    }
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[v.cast("string" if n == "source" else "long").alias(prefix + n) for n, v in out.items()])
