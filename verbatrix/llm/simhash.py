"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned
from .components import component_least, connected_components

_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant: spreads keys over buckets
_ALL_PAIRS = 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """64 bits: each is 1 if set in over half the XXH64 values of the shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z only and cuts at \x20 and \x09-\x0D only
    if not words:
        return 0
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, step):
        some = words[lo : min(lo + step, n) + shingle - 1]
        shifted = [some[i:] for i in range(shingle)] if len(words) >= shingle else [some]
        grams = map(b" ".join, zip(*shifted)) if len(words) >= shingle else [b" ".join(some)]
        values = np.fromiter((h(g, seed) for g in grams), np.uint64)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and ``keep``): fp as a signed 64-bit integer."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    names = ["doc_id", "fp", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.empty(len(batch), np.uint64)
            for i, t in enumerate(batch.column(1)):
                fp[i] = fingerprint(t.as_py(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names)

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *keep).schema)


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` flipped bits among the ``bits`` low ones."""
    one = [np.uint64(1) << np.uint64(i) for i in range(bits)]
    masks = [np.uint64(0)]
    level = [(np.uint64(0), 0)]
    for _ in range(radius):
        level = [(m | one[i], i + 1) for m, lo in level for i in range(lo, bits)]
        masks += [m for m, _ in level]
    return np.array(masks, np.uint64)


def _emit(lead: int, radius: int, buckets: int, step: int):
    """Each fingerprint with the flips of its ``lead`` leading bits, in blobs by bucket: number of fingerprints, they, how many flips each has here, which."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = ball(lead, radius)
        for f in frames:
            fps = f["fp"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(fps), step):
                some = fps[lo : lo + step]
                bucket = (((some >> np.uint64(64 - lead))[:, None] ^ masks[None, :]).ravel() * _MIX >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
                bucket = bucket[order]
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                whose, mask = np.divmod(order, len(masks))
                out = []
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
                    own, times = np.unique(whose[i:j], return_counts=True)
                    out.append((int(bucket[i]), len(own).to_bytes(4, "little") + some[own].astype("<u8").tobytes() + times.astype("<u2").tobytes() + mask[i:j].astype("<u2").tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "blob"])

    return run


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _variants(fps: np.ndarray, which: np.ndarray, bits: int, lead: int, radius: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of the variants with the given leading flips and what flips of other bits are left to them; of ``parts`` that one."""
    leading, most = ball(lead, radius), np.cumsum([math.comb(lead, k) for k in range(radius + 1)])
    flips = np.searchsorted(most, which, side="right")
    keys, whose = [np.empty(0, np.uint32)], [np.empty(0, np.uint64)]
    for k in range(radius + 1):
        own, masks = np.flatnonzero(flips == k), ball(bits - lead, radius - k)
        step = max(1, (1 << 20) // len(masks))
        for lo in range(0, len(own), step):
            i = own[lo : lo + step]
            start = (fps[i] >> np.uint64(64 - bits)) ^ (leading[which[i]] << np.uint64(bits - lead))
            mixed = (start[:, None] ^ masks[None, :]).ravel() * _MIX
            mixed ^= mixed >> np.uint64(29)  # two variants that differ may share the lower half: links are verified
            fp = np.repeat(fps[i], len(masks))
            if parts > 1:
                mine = (mixed >> np.uint64(32)) % np.uint64(parts) == part
                mixed, fp = mixed[mine], fp[mine]
            keys.append(mixed.astype(np.uint32))
            whose.append(fp)
    return np.concatenate(keys), np.concatenate(whose)


def links_of_bucket(blobs: list[bytes], most: int, bits: int, lead: int, radius: int, at_once: int = 1 << 22) -> np.ndarray:
    """Pairs of fingerprints at ``most`` bits or fewer that connect all that such pairs among colliding variants connect.

    About ``at_once`` variants are held at a time: those of a larger bucket come in parts by their hash, so equal ones meet.
    """
    fps, which = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        fps.append(np.repeat(np.frombuffer(blob, "<u8", n, 4), np.frombuffer(blob, "<u2", n, 4 + 8 * n)))
        which.append(np.frombuffer(blob, "<u2", -1, 4 + 10 * n))
    fp, flip = np.concatenate(fps), np.concatenate(which)
    del fps, which
    each = np.repeat([sum(math.comb(bits - lead, j) for j in range(radius - k + 1)) for k in range(radius + 1)], [math.comb(lead, k) for k in range(radius + 1)])
    parts = max(1, -(-int(each[flip].sum()) // at_once))
    found = [_links(*_variants(fp, flip, bits, lead, radius, p, parts), most) for p in range(parts)]
    return np.unique(np.concatenate(found), axis=0)


def _links(key: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """Links among the fingerprints of each key, enough to connect those that links there connect."""
    if not len(key):
        return np.empty((0, 2), np.uint64)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[first, len(key)])
    found: list[np.ndarray] = []
    for off in range(1, min(_ALL_PAIRS, int(length.max()))):
        starts, runs = first[(length > off) & (length <= _ALL_PAIRS)], length[(length > off) & (length <= _ALL_PAIRS)]
        if not len(starts):
            continue
        reps = runs - off
        i = np.repeat(starts - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        a, b = fp[i], fp[i + off]
        ok = (a != b) & _close(a, b, most)
        found.append(np.unique(np.stack([np.maximum(a[ok], b[ok]), np.minimum(a[ok], b[ok])], 1), axis=0))
    big = np.flatnonzero(length > _ALL_PAIRS)
    if len(big):
        names = np.unique(np.concatenate([fp[first[r] : first[r] + length[r]] for r in big]))
        label = np.arange(len(names))
        for r in big:
            own = np.searchsorted(names, np.unique(fp[first[r] : first[r] + length[r]]))
            for pivot in own:  # what is joined already needs no comparison, so a large group costs a few pivots
                apart = own[label[own] != label[pivot]]
                if not len(apart):
                    if (label[own] == label[own[0]]).all():
                        break
                    continue
                near = apart[_close(names[apart], names[pivot], most)]
                if len(near):
                    joined, at = np.unique(label[near], return_index=True)
                    found.append(np.stack([np.maximum(names[near[at]], names[pivot]), np.minimum(names[near[at]], names[pivot])], 1))
                    label[np.isin(label, joined)] = label[pivot]
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)


def fingerprint_links(fps: DataFrame, n: int, *, most: int = 4, bucket_variants: int = 1 << 21) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` (fp) at ``most`` bits or fewer, enough to connect each component.

    Two such fingerprints have a variant in common when each flips at most half of ``most`` bits. Variants are
    compared by their leading bits only, which all variants with other trailing flips share; the bits kept grow with
    log2(n) so that chance collisions stay rare, and every collision is verified on all 64 bits. Variants meet in hash
    buckets, whose number grows with that of the variants (about ``bucket_variants`` each). A bucket is named by fewer
    leading bits still, so a fingerprint travels once for each way to flip those, packed, and the variants are made where they
    meet. Buckets are dealt to tasks of about 16 MB, and a bucket's variants are held in parts of bounded size.
    """
    bits = min(64, max(20, math.ceil(math.log2(max(n, 2))) + 14))
    radius = most // 2 + most % 2
    variants = sum(math.comb(bits, k) for k in range(radius + 1))
    buckets = min((1 << 31) - 1, n * variants // bucket_variants + 1)
    lead = min(bits, max(8, math.ceil(math.log2(buckets)) + 5))
    sent = sum(math.comb(lead, k) for k in range(radius + 1))
    step = max(256, min(1 << 14, (1 << 21) // sent))

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = links_of_bucket(list(frame["blob"]), most, bits, lead, radius).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    blobs = fps.select("fp").repartition(max(1, n * sent >> 21), "fp").mapInPandas(_emit(lead, radius, buckets, step), "bucket int, blob binary")
    dealt = blobs.repartition(max(1, 12 * n * sent >> 24), "bucket")
    return dealt.groupBy("bucket").applyInPandas(reduce, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = 4, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included), group and ``keep``, one row per document.

    group: a fingerprint of the component, the same for all its documents, never null.

    Documents of one fingerprint are one node, so copies cost nothing but their rows. Null and empty texts have
    fingerprint zero and are linked like any other; long texts are hashed whole, a stretch at a time; a null
    doc_id is ignored where another is in its group (else component_id is null); repeated rows stay; an empty
    table gives an empty result; columns but those of ``keep`` are not read.
    """
    own = pinned(fingerprints(docs, key=key, text=text, shingle=shingle, seed=seed, keep=keep))
    nodes = pinned(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(nodes, nodes.count(), most=most)
    linked = component_least(connected_components(links), nodes.select(F.col("fp").alias("node"), "least"))
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", F.when(F.col("linked"), F.col("component_least")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component", "fp").alias("group"))
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", *keep)
