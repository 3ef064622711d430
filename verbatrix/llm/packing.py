"""Order-preserving packing of token sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import sentence_ends, tokenizer

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Costs in tokens: of a cut after a sentence, of one inside a sentence, of each sequence, and, on top, of a cut in a document that fits one sequence.
SENTENCE, INSIDE, SEQUENCE, FITTING = 2.0, 8.0, 8.0, 64.0
#: Where no sentence ends for GAP tokens, cuts are allowed after every STEP, and a full sequence after the end of a document or of every fourth sentence,
#: or so that the next sequence ends with a document after SIZE, SIZE / 2 or SIZE / 4 tokens.
GAP, STEP = 64, 32


def padding(length: int, size: int) -> int:
    """Tokens that fill a sequence up to ``size``; a sequence at a power of two is left as it is."""
    return 0 if length & (length - 1) == 0 else size - length


def cuts(places: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """The cheapest cuts, as indices of ``places`` (ascending, from 0 to the end, no gap over ``size``).

    best[i] = costs[i] + SEQUENCE + min over j of best[j] + padding(places[i] - places[j]). Unless the length is a
    power of two the padding is size - places[i] + places[j], so the best j of the window is the one with the least
    best[j] + places[j]: a queue that is kept ascending has it in front. Lengths at powers of two are tried one by one.
    """
    at, cost, n = places.tolist(), costs.tolist(), len(places)
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    later, earlier = [], []  # pairs of places a power of two apart
    for w in (1 << k for k in range(size.bit_length())):
        q = np.searchsorted(places, places - w)
        hit = np.flatnonzero(places[q] == places - w)
        later.append(hit)
        earlier.append(q[hit])
    order = np.argsort(np.concatenate(later), kind="stable")
    later, earlier = [*np.concatenate(later)[order].tolist(), n], np.concatenate(earlier)[order].tolist()
    pair = 0
    for i in range(1, n):
        p = at[i]
        while at[queue[0][1]] < p - size:
            queue.popleft()
        least, j = queue[0]
        least += size - p
        while later[pair] == i:
            q = earlier[pair]
            if best[q] < least:
                least, j = best[q], q
            pair += 1
        best[i] = b = least + cost[i] + SEQUENCE
        back[i] = j
        b += p
        while queue and queue[-1][0] >= b:
            queue.pop()
        queue.append((b, i))
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, may_end: np.ndarray, may_begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut is allowed (with 0) and their costs. ``ends``: where documents end. The first document counts as what is left of it."""
    n = len(ids)
    known = ids < len(may_end)
    after = np.zeros(n + 1, bool)
    after[1:n] = may_end[np.where(known, ids, 0)][:-1] & known[:-1] & may_begin[np.where(known, ids, 0)][1:] & known[1:]
    cost = np.where(after, SENTENCE, np.inf)
    cost[0] = cost[n] = 0
    cost[ends] = 0
    places = np.flatnonzero(np.isfinite(cost))
    gaps = np.flatnonzero(np.diff(places) > GAP)
    if len(gaps):
        cost[np.concatenate([np.arange(places[g] + STEP, places[g + 1], STEP) for g in gaps])] = INSIDE
    full = np.concatenate([np.union1d(places[::4], np.r_[0, ends]) + size, *(ends - (size >> k) for k in range(3))])
    full = full[(full > 0) & (full < n)]
    cost[full] = np.minimum(cost[full], INSIDE)
    length = np.diff(np.r_[0, ends])
    inside = np.repeat(length <= size, length)
    inside[np.r_[0, ends[:-1]]] = False
    cost[:n][inside] += FITTING
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


def _pack(path: str, end_id: int, size: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (may_end, may_begin) = tokenizer(path), sentence_ends(path)
        sequence = (TaskContext.get().partitionId() << 33) - 1
        held: list[tuple] = []  # (doc_id, ids before, ids, ids of the whole document), not yet given to a sequence

        def packed(last: bool) -> Iterator[tuple]:
            nonlocal held, sequence
            if not held:
                return
            ids = np.concatenate([x[2] for x in held])
            ends = np.cumsum([len(x[2]) for x in held])
            places, costs = candidates(ids, ends, may_end, may_begin, size)
            path_ = [int(places[i]) for i in cuts(places, costs, size)]
            if not last and len(path_) > 2:
                path_.pop()
            elif not last:
                return
            d, lo = 0, 0  # the document and where it begins
            for a, b in zip(path_, path_[1:]):
                sequence += 1
                at = a
                while at < b:
                    if at >= lo + len(held[d][2]):
                        lo += len(held[d][2])
                        d += 1
                    doc, before, part, whole = held[d]
                    to = min(b, lo + len(part))
                    piece = part[at - lo : to - lo]
                    yield doc, before + at - lo, to - at, zlib.crc32(piece.tobytes()), whole, sequence, at - a
                    at = to
            rest = path_[-1]
            kept, lo = [], 0
            for doc, before, part, whole in held:
                cut = max(0, rest - lo)
                if cut < len(part):
                    kept.append((doc, before + cut, part[cut:], whole))
                lo += len(part)
            held = kept

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in SCHEMA.split(", ")])

        waiting = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts, docs = (batch.column(i).slice(lo, 256).to_pylist() for i in (1, 0))
                for doc, ids in zip(docs, encode.documents(texts, end_id)):
                    held.append((doc, 0, ids, len(ids)))
                    waiting += len(ids)
                    if waiting >= chunk:
                        if rows := list(packed(False)):
                            yield batch_of(rows)
                        waiting = 0
        if rows := list(packed(True)):
            yield batch_of(rows)

    return run


def pack_documents(docs: DataFrame, *, tokenizer_path: str, order: tuple = ("doc_id",), key: str = "doc_id", text: str = "text", end_id: int = 0, size: int = 1024, chunk: int = 262_144) -> DataFrame:
    """A row for each piece of a document in a sequence of at most ``size`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents keep the order of the columns ``order`` (equal ones by a hash of their texts). Sequences are cut at ends of
    documents or sentences, or, where neither comes for GAP tokens or a full sequence or the next document's end asks for it,
    inside one, so that padding plus the costs of cuts is least among these places. A document that fits one sequence is cut only where
    that saves FITTING tokens or so. Each range of the order is packed by one task, which holds about ``chunk`` tokens (and the document at hand): the cuts of
    a chunk are final but for its last sequence, which goes on into the next. A range ends with one short sequence.

    A null or empty text is just ``end_id``; null and repeated keys are kept; a document over ``size`` is cut into
    several pieces; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    at = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"order{i}" for i in range(len(at))] + ["tie"]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *[c.alias(n) for c, n in zip(at, names)], F.xxhash64(F.col(text)).alias("tie"))
    ranged = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    return ranged.mapInArrow(_pack(tokenizer_path, end_id, size, chunk), SCHEMA)
