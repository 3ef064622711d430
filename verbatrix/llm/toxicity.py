"""Toxicity: a support vector machine on a gapped-subsequence string kernel between sentences, with Nystroem landmarks."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scored_batches
from .quality_fm import labelled_sample

ORDER, SPAN, DECAY, SYMBOLS = 4, 6, 0.6, 40
#: A sentence of over WORDS words is compared in stretches of WORDS, each half over the one before; LONGEST letters count as a word.
WORDS, LONGEST = 6, 40
#: Characters read at a time; of a longer text that many, each stretch OVERLAP over the one before.
AT_ONCE, OVERLAP = 250_000, 4096
#: A subsequence that is in a share s of the clean texts counts 1 / (1 + s / RARE).
RARE = 0.01
#: What a toxic stretch with a letter inserted weighs against a text when the threshold is chosen.
INSERTED = 0.25
#: Fixed: digits and marks that stand for letters.
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SHAPES = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]
_WEIGHTS = np.array([DECAY ** (s[-1] - ORDER + 1) for s in _SHAPES], np.float32)
_SIZE = SYMBOLS**ORDER
_DROPPED, _STOP, _LINE = -1, -2, -3


def _symbol(c: str) -> int:
    """0 for white space, 1 to 26 for a to z, others for other letters; below 0 for what is left out, ends a sentence or a line."""
    if c == "\n":
        return _LINE
    if c in ".!?…":
        return _STOP
    if c.isspace():
        return 0
    c = _LOOKS.get(c, c).lower()[:1]
    return _DROPPED if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 27)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return np.array([_symbol(chr(c)) for c in range(1 << 16)], np.int8)


class Windows(NamedTuple):
    """Stretches of sentences: symbols of all texts, and for each stretch where it starts and ends there, and its text's number."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def windows_of(texts: list[str]) -> Windows:
    """The sentences of texts as symbols with one space between words and at either end, in stretches of at most WORDS words.

    A sentence ends with a full stop, question or exclamation mark or ellipsis before white space, or with the line. Marks inside words are left
    out, looks stand for letters, and three or more letters spelt one by one are a word.
    """
    flat = "\n" + "\n".join(texts) + "\n"
    point = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = point >= 1 << 16
    if high.any():
        symbol = _symbols()[np.where(high, 0, point)]
        symbol[high] = [_symbol(chr(c)) for c in point[high]]
    else:
        symbol = _symbols()[point]
    owner = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [len(t) + 1 for t in texts] + [1])
    cut = symbol == _LINE
    cut[1:] |= (symbol[1:] == 0) & (symbol[:-1] == _STOP)
    kept = (symbol >= 0) | (symbol == _LINE)
    symbol, owner, cut = np.maximum(symbol[kept], 0), owner[kept], cut[kept]
    space = symbol == 0
    first = space.copy()
    first[1:] &= ~space[:-1]
    group = np.cumsum(first) - 1
    cut = np.bincount(group[cut], minlength=int(first.sum())) > 0  # by run of white space
    kept = ~space | first
    codes, owner = symbol[kept], owner[kept]
    gaps = np.flatnonzero(codes == 0)
    single = np.diff(gaps) == 2
    if single.sum() > 2:  # letters spelt one by one are one word
        both = np.zeros(len(gaps), bool)
        both[1:-1] = single[1:] & single[:-1] & (owner[gaps[1:-1] - 1] == owner[gaps[1:-1] + 1])
        many = both & (np.r_[False, both[:-1]] | np.r_[both[1:], False])
        if many.any():
            kept = np.ones(len(codes), bool)
            kept[gaps[many]] = False
            codes, owner, cut = codes[kept], owner[kept], cut[~many]
            gaps = np.flatnonzero(codes == 0)
    if len(gaps) < 2:
        none = np.empty(0, np.int64)
        return Windows(codes, none, none, none)
    start, end, begins = gaps[:-1], gaps[1:] + 1, cut[:-1]
    parts = (end - start - 3) // LONGEST + 1
    if parts.max() > 1:  # long words in parts
        ends = np.cumsum(parts)
        inner = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
        last = inner == np.repeat(parts, parts) - 1
        begins = np.repeat(begins, parts) & (inner == 0)
        start, end = np.repeat(start, parts), np.repeat(end, parts)
        start, end = start + inner * LONGEST, np.where(last, end, start + (inner + 1) * LONGEST + 1)
    head = np.flatnonzero(begins)
    size = np.diff(np.r_[head, len(start)])
    more = np.maximum(size - WORDS, 0)
    step = WORDS // 2
    count = 1 + -(-more // step)
    ends = np.cumsum(count)
    j = np.arange(ends[-1]) - np.repeat(ends - count, count)
    a = np.repeat(head, count) + np.minimum(j * step, np.repeat(more, count))
    b = a + np.repeat(np.minimum(size, WORDS), count) - 1
    return Windows(codes, start[a], end[b], owner[start[a] + 1].astype(np.int64))


def window_sums(codes: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch, the sum over its weighted subsequences of the table's real part, and with squared weights of its imaginary part."""
    n = len(codes)
    padded = np.zeros(n + SPAN, np.int32)
    padded[:n] = codes
    pair = [None, *(padded[: len(padded) - d] * SYMBOLS + padded[d:] for d in range(1, SPAN - 2))]
    lead = [None, *(p[:n] * (SYMBOLS * SYMBOLS) for p in pair[1:])]
    got, square = np.zeros(len(start)), np.zeros(len(start))
    for far in range(ORDER - 1, SPAN):
        w = DECAY ** (far - ORDER + 1)
        value = np.zeros(n + 1, np.complex64)
        for _, i, j, k in _SHAPES:
            if k == far:
                value[1:] += table[lead[i] + pair[k - j][j : j + n]]
        running = np.cumsum(value, dtype=np.complex128)
        d = running[np.maximum(end - far, start)] - running[start]
        got += d.real * w
        square += d.imag * (w * w)
    return got, square


def occurrences(codes: np.ndarray) -> np.ndarray:
    """Codes of all subsequences of a row of symbols."""
    p, n = codes.astype(np.int32), len(codes)
    found = [((p[: n - k] * SYMBOLS + p[i : n - k + i]) * SYMBOLS + p[j : n - k + j]) * SYMBOLS + p[k:] for _, i, j, k in _SHAPES if n > k]
    return np.concatenate(found) if found else np.empty(0, np.int32)


def features(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches' distinct subsequences: stretch, code, and the sum of the weights of its occurrences there."""
    whose, code, weight = [], [], []
    padded = np.concatenate([codes.astype(np.int64), np.zeros(SPAN, np.int64)])
    for (_, i, j, k), w in zip(_SHAPES, _WEIGHTS.tolist(), strict=True):
        n = np.maximum(end - start - k, 0)
        at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        code.append(((padded[at] * SYMBOLS + padded[at + i]) * SYMBOLS + padded[at + j]) * SYMBOLS + padded[at + k])
        whose.append(np.repeat(np.arange(len(start)), n))
        weight.append(np.full(len(at), w, np.float32))
    key = np.concatenate(whose) * _SIZE + np.concatenate(code)
    order = np.argsort(key, kind="stable")
    key = key[order]
    if not len(key):
        return key, key, np.empty(0, np.float32)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    whose, code = np.divmod(key[first], _SIZE)
    return whose, code, np.add.reduceat(np.concatenate(weight)[order], first)


def margins(table: np.ndarray, w: Windows, texts: int) -> np.ndarray:
    """For each text the largest sum over a stretch, divided by the stretch's norm, or 0 if none is above.

    The norm is at least the root of the sum of squared weights, so stretches are taken in the order of that bound
    until none of a text's can be larger than what it has.
    """
    best = np.zeros(texts)
    raw, square = window_sums(w.codes, w.start, w.end, table)
    some = np.flatnonzero((raw > 1e-4) & (square > 1e-9))
    bound = raw[some] / np.sqrt(square[some]) * (1 + 1e-5) + 1e-6
    order = np.lexsort((-bound, w.text[some]))
    some, bound = some[order], bound[order]
    text = w.text[some]
    at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
    last, many = np.r_[at[1:], len(text)], 1
    while len(at):
        going = bound[at] > best[text[at]]
        at, last = at[going], last[going]
        n = np.minimum(last - at, many)
        for lo in range(0, len(at), 1024):
            reps = n[lo : lo + 1024]
            i = np.repeat(at[lo : lo + 1024] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            i = i[bound[i] > best[text[i]]]
            np.maximum.at(best, text[i], exact(table, w, some[i]))
        at, many = at + n, 2 * many
        more = at < last
        at, last = at[more], last[more]
    return best


def exact(table: np.ndarray, w: Windows, i: np.ndarray) -> np.ndarray:
    """The sums of stretches ``i`` divided by their norms."""
    whose, code, weight = features(w.codes, w.start[i], w.end[i])
    norm = np.bincount(whose, table.imag[code] * weight**2, len(i))
    value = np.bincount(whose, table.real[code] * weight, len(i))
    return value / np.sqrt(np.maximum(norm, 1e-9))


class Machine:
    """The machine in its primal form: a number for each subsequence that a landmark has.

    f(x) = sum over landmarks z of alpha_z K(x, z) / (|x| |z|), and K(x, z) = sum over subsequences u of q_u c_u(x) c_u(z), where c_u
    sums the weights of u's occurrences and q_u is smaller the more clean texts have u. So alpha, |z| and the landmarks fold
    into one number for each u, and a sentence costs as many look-ups as it has subsequences.
    """

    def __init__(self, rarity: np.ndarray):
        self.table = np.zeros(_SIZE, np.complex64)
        self.table.imag = rarity
        self.middle, self.slope = 0.0, 4.0

    def margins(self, texts: list[str | None]) -> np.ndarray:
        best = np.zeros(len(texts))
        for some, whose in _pieces(texts):
            np.maximum.at(best, whose, margins(self.table, windows_of(some), len(some)))
        return best

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.margins(texts) - self.middle), -30, 30)))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and whose they are, about AT_ONCE characters at a time."""
    some: list[str] = []
    whose: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t or "") - OVERLAP), AT_ONCE - OVERLAP):
            some.append((t or "")[lo : lo + AT_ONCE])
            whose.append(i)
            size += len(some[-1])
            if size > AT_ONCE:
                yield some, np.array(whose)
                some, whose, size = [], [], 0
    if some:
        yield some, np.array(whose)


def _all_windows(texts: list[str]) -> Windows:
    parts = [(windows_of(some), whose) for some, whose in _pieces(texts)]
    at = np.cumsum([0] + [len(p.codes) for p, _ in parts])
    places = [np.concatenate([(getattr(p, f) + b).astype(np.int32) for (p, _), b in zip(parts, at)]) for f in ("start", "end")]
    return Windows(np.concatenate([p.codes for p, _ in parts]), *places, np.concatenate([whose[p.text].astype(np.int32) for p, whose in parts]))


def _scores(table: np.ndarray, w: Windows, step: int = 5_000) -> np.ndarray:
    """About each stretch's margin: its norm without the products of occurrences of one subsequence."""
    out = np.empty(len(w.start))
    for lo in range(0, len(w.start), step):
        start, end = w.start[lo : lo + step], w.end[lo : lo + step]
        a = start.min()
        raw, square = window_sums(w.codes[a : end.max()], start - a, end - a, table)
        out[lo : lo + step] = raw / np.sqrt(np.maximum(square, 1e-9))
    return out


def landmark_map(w: Windows, rows: np.ndarray, landmarks: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel of ``rows`` with ``landmarks``, the landmarks' subsequences, and their normalised weights (a column a landmark)."""
    whose, code, weight = features(w.codes, w.start[landmarks], w.end[landmarks])
    used, place = np.unique(code, return_inverse=True)
    phi = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # the last row is for those of no landmark
    phi[place, whose] = weight * np.sqrt(rarity[code])
    phi /= np.sqrt(np.einsum("ij,ij->j", phi, phi))
    column = np.full(_SIZE, len(used), np.int32)
    column[used] = np.arange(len(used))
    kernel = np.zeros((len(rows), len(landmarks)))
    for lo in range(0, len(rows), 32):
        i = rows[lo : lo + 32]
        whose, code, weight = features(w.codes, w.start[i], w.end[i])
        value = weight * np.sqrt(rarity[code])
        at = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        kernel[lo + whose[at]] = np.add.reduceat(phi[column[code]] * value[:, None], at, dtype=np.float32)
        kernel[lo : lo + 32] /= np.sqrt(np.bincount(whose, value.astype(float) ** 2, len(i)))[:, None]
    return kernel, used, phi[:-1]


def inserted(w: Windows, i: np.ndarray, table: np.ndarray, rng: np.random.Generator) -> tuple[Windows, np.ndarray]:
    """``w`` with a copy of each stretch ``i`` that has one more letter, drawn at random, inside its most toxic subsequences; and the copies' numbers."""
    codes, size = [], len(w.codes)
    for a, b in zip(w.start[i], w.end[i]):
        x = w.codes[a:b]
        p, value = x.astype(np.int32), np.zeros(len(x))
        for (_, j, k, m), weight in zip(_SHAPES, _WEIGHTS, strict=True):
            n = len(x) - m
            if n > 0:
                value[:n] += weight * table.real[((p[:n] * SYMBOLS + p[j : n + j]) * SYMBOLS + p[k : n + k]) * SYMBOLS + p[m:]]
        codes.append(np.insert(x, min(int(value.argmax()) + int(rng.integers(2, ORDER)), len(x) - 1), rng.integers(1, 27)))
    end = (size + np.cumsum([0] + [len(c) for c in codes])).astype(w.end.dtype)
    both = [np.concatenate(c) for c in ((w.codes, *codes), (w.start, end[:-1]), (w.end, end[1:]), (w.text, w.text[i]))]
    return Windows(*both), len(w.start) + np.arange(len(i))


def _train(texts: list[str], toxic: np.ndarray, landmarks: int = 256, rounds: int = 2, cost: float = 5.0, seed: int = 9) -> Machine | None:
    """A toxic text's label holds for at least one of its stretches: which one, its witness, is chosen anew each round.

    The first choice is by how much more often a stretch's subsequences occur in toxic texts. Each round draws landmarks from the witnesses
    and the clean stretches, maps stretches to the span of the landmarks (Nystroem), and fits the machine there. Witnesses are also learned,
    and weigh INSERTED of a text in the threshold, with a letter inserted.
    """
    rng = np.random.default_rng(seed)
    w = _all_windows(texts)
    long = np.flatnonzero(w.end - w.start >= ORDER)
    w = Windows(w.codes, w.start[long], w.end[long], w.text[long])
    clean = np.flatnonzero(toxic[w.text] == 0)
    if not len(clean) or len(clean) == len(w.text):
        return None
    counts, last = np.zeros((2, _SIZE), np.uint16 if len(texts) < 1 << 16 else np.int32), np.zeros(_SIZE, np.int32)
    edges = np.flatnonzero(np.r_[True, w.text[1:] != w.text[:-1], True])
    for lo, hi in zip(edges, edges[1:]):
        found = occurrences(w.codes[w.start[lo] : w.end[hi - 1]])
        place = np.arange(len(found), dtype=np.int32)
        last[found] = place
        counts[toxic[w.text[lo]], found[last[found] == place]] += 1  # once a text
    many = toxic.sum(), (1 - toxic).sum()
    del last
    rarity = 1 / (1 + counts[0] / np.float32(RARE * many[1]))
    some = np.flatnonzero(counts[1] >= max(3, 0.02 * many[0]))
    odds = np.log((counts[1][some] + 0.5) / (many[0] + 1)) - np.log((counts[0][some] + 0.5) / (many[1] + 1))
    machine, bias = Machine(rarity), 0.0
    machine.table.real[some] = np.where(odds < 1.5, 0, np.clip(odds, 0, 6)) * rarity[some]
    del counts
    for _ in range(rounds):
        score = _scores(machine.table, w) + bias
        order = np.lexsort((-score, w.text))
        top = order[np.r_[True, w.text[order][1:] != w.text[order][:-1]]]  # of each text
        witness, hard = top[toxic[w.text[top]] == 1], top[toxic[w.text[top]] == 0]
        # a text without a likely stretch is taken as labelled wrongly
        witness = witness[score[witness] > 0] if (score[witness] > 0).any() else witness
        hard = hard[np.argsort(-score[hard], kind="stable")[:1500]]
        some = np.unique(np.r_[hard, rng.choice(clean, min(2500, len(clean)), replace=False)])
        z = np.concatenate([rng.choice(x, min(n, len(x)), replace=False) for x, n in ((witness, landmarks // 2), (hard, landmarks // 4), (clean, landmarks // 4))])
        del score, order, top
        more, copies = inserted(w, witness, machine.table, rng)
        used, weights, bias = _fitted(more, np.r_[witness, copies], some, z, rarity, cost)
        machine.table.real = 0
        machine.table.real[used] = weights
    got = np.r_[machine.margins(texts), np.maximum(exact(machine.table, more, copies), 0)]
    order = np.argsort(got, kind="stable")
    below = np.r_[got[order[0]] - 1, got[order], got[order[-1]] + 1]
    bad = np.r_[toxic, np.full(len(copies), INSERTED)][order]
    good = np.r_[1 - toxic, np.zeros(len(copies))][order]
    right = np.r_[0, np.cumsum(good)] + np.r_[np.cumsum(bad[::-1])[::-1], 0]  # with the threshold between below[i] and below[i + 1]
    right = np.where(below[1:] > below[:-1], right, -1)
    best = np.flatnonzero(right == right.max())
    machine.middle = float(below[best[0]] + below[best[-1] + 1]) / 2
    return machine


def _fitted(w: Windows, toxic: np.ndarray, clean: np.ndarray, landmarks: np.ndarray, rarity: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The machine fitted to stretches in the span of landmarks: its subsequences, their numbers, and the bias."""
    rows = np.r_[toxic, clean]
    kernel, used, phi = landmark_map(w, rows, landmarks, rarity)
    values, vectors = np.linalg.eigh(phi.T @ phi)
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.c_[kernel @ root, np.ones(len(rows))]
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    beta = _squared_hinge(x, y, cost * np.r_[np.full(len(toxic), len(clean) / len(toxic)), np.ones(len(clean))])
    return used, phi @ (root @ beta[:-1]).astype(np.float32) * np.sqrt(rarity[used]), float(beta[-1])


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method for half |beta|^2 + sum of cost * max(0, 1 - y x beta)^2; the last column's weight is free."""
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.zeros(len(x), bool)
    for _ in range(steps):
        now = y * (x @ beta) < 1
        if (now == active).all():
            break
        active = now
        a = x[active] * (2 * cost[active])[:, None]
        beta = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
    return beta


def train_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 4000, max_chars: int = 4_000) -> bytes | None:
    """A model fitted to the sentences of at most ``max_train`` labelled documents of at most ``max_chars`` characters; None without both labels.

    ``allowed``: a condition on the labels' rows. Null labels and ids are left out; of several labels of an id the largest holds, of several texts the
    least; null texts are empty; ties in the choice of documents are broken by id. Same tables, same model.
    """
    sample = labelled_sample(docs.where(F.length(F.coalesce(F.col(text), F.lit(""))) <= max_chars), labels, label, allowed, max_train, key)
    rows = sample.groupBy("labelled_id").agg(F.max("label").alias("label"), F.min(F.coalesce(F.col(text), F.lit(""))).alias("text")).collect()
    rows = sorted(rows, key=lambda r: r.labelled_id)
    if len({r.label > 0 for r in rows}) < 2:
        return None
    machine = _train([r.text for r in rows], np.array([int(r.label > 0) for r in rows]))
    if machine is None:
        return None
    rare = np.flatnonzero(machine.table.imag < 1).astype(np.int32)
    used = np.flatnonzero(machine.table.real).astype(np.int32)
    return zlib.compress(pickle.dumps((rare, machine.table.imag[rare], used, machine.table.real[used], machine.middle, machine.slope), 5), 1)


_loaded: dict[bytes, Machine] = {}


def _machine(model: bytes) -> Machine:
    if model not in _loaded:
        _loaded.clear()
        rare, rarity, used, weights, middle, slope = pickle.loads(zlib.decompress(model))
        machine = Machine(np.ones(_SIZE, np.float32))
        machine.table.imag[rare] = rarity
        machine.table.real[used] = weights
        machine.middle, machine.slope = middle, slope
        _loaded[model] = machine
    return _loaded[model]


def score_toxicity(docs: DataFrame, model: bytes | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``keep`` and ``score``, the probability of label 1, for every whole text: that of its worst sentence; 0 without a model.

    Sentences are compared letter by letter, and white space is a letter that may be skipped like any other, so an insult of several words, or one
    split by white space, is found. Null and empty texts and those without letters have the least score there is; words and texts
    of any length are scored whole; repeated rows stay; an empty table gives an empty result. A column of ``keep`` that has the name
    of ``score`` is replaced.
    """
    own = [c for c in keep if c != score]
    schema = docs.select(*own).withColumn(score, F.lit(0.0)).schema

    held = [f"__own{i}" for i in range(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def probability(texts: list[str | None]) -> np.ndarray:
            return _machine(model).probability(texts) if model else np.zeros(len(texts))

        for batch in scored_batches(batches, held, ["__text"], probability):
            yield batch.rename_columns(schema.names)

    columns = [F.col(c).alias(h) for c, h in zip(own, held)]
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema)
