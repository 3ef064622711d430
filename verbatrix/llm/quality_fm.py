"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scored_batches

HASHED = 1 << 14
#: Words that a worker remembers.
KNOWN = 200_000
#: Of a byte: lower-case letter, upper-case letter, digit, white space, full stop or comma, other punctuation, other.
_CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\r\x0b\x0c" else 4 if b in b".," else 5 if 32 < b < 127 else 6 for b in range(256)], np.uint8)
STATISTICS = ("upper", "digit", "space", "stop", "punctuation", "other", "word length", "distinct words", "top word", "repeated next word", "words a line", "distinct lines", "top line", "ends in a mark", "no letter", "log words", "n_chars", "n_chars against text", "one")
_MARK = re.compile(r"[^\w\s.,;:'\")\]][\s]")
_NO_LETTER = re.compile(r"(?<!\S)[\W\d_]+(?!\S)")


def statistics(text: str, n_chars: float | None) -> list[float]:
    """Shape of a text, each about 0 to 1; an empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_CLASS[raw], minlength=7) / n
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    own = Counter(lines)
    repeated = sum(map(str.__eq__, words, words[1:])) / m
    stated = len(text) if n_chars is None or not math.isfinite(n_chars) else max(0.0, float(n_chars))
    return [
        *share[1:].tolist(), min(1.0, len(text) / m / 20), len(counts) / m, max(counts.values(), default=0) / m, repeated, min(1.0, m / max(1, len(lines)) / 100), len(own) / max(1, len(lines)), max(own.values(), default=0) / max(1, len(lines)),
        min(1.0, len(_MARK.findall(text + " ")) / m), len(_NO_LETTER.findall(text)) / m, min(1.0, math.log1p(len(words)) / 10), min(1.0, math.log1p(stated) / 14), min(1.0, abs(math.log((stated + 1) / (len(text) + 1)))), 1.0,
    ]


def features(text: str | None, n_chars: float | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: distinct words hashed to HASHED places, as a unit vector, then the statistics."""
    text = text or ""
    words = set(text.lower().split())
    new = words.difference(known)
    if new:
        if len(known) > KNOWN:
            known.clear()
            new = words
        known.update((w, zlib.crc32(w.encode("utf-8", "replace")) % HASHED) for w in new)
    index = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    stats = statistics(text, n_chars)
    value = np.full(len(index) + len(stats), 0.5 / math.sqrt(max(1, len(index))), np.float32)
    value[len(index) :] = stats
    return np.concatenate([index, np.arange(HASHED, HASHED + len(stats), dtype=np.int32)]), value


class FactorisationMachine:
    """w0 + <w, x> + sum over i < j of <v_i, v_j> x_i x_j, the pairs by half of (sum v x)^2 - sum (v x)^2."""

    def __init__(self, size: int, rank: int = 8, seed: int = 6):
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row (its entries begin at ``starts``), and its sum of v x. Time is in proportion to the entries."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1), total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 6) -> FactorisationMachine:
        """Logistic loss, AdaGrad, rows in a seeded order."""
        rng, size = np.random.default_rng(seed), len(self.w)
        gw, gv, g0 = np.full(size, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                some = [rows[i] for i in order[lo : lo + batch]]
                lengths = np.array([len(i) for i, _ in some])
                index, value = np.concatenate([i for i, _ in some]), np.concatenate([v for _, v in some])
                margin, total = self.margin(index, value, np.r_[0, np.cumsum(lengths)[:-1]])
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[order[lo : lo + batch]]) / len(some)
                each = np.repeat(error, lengths) * value
                used, at = np.unique(index, return_inverse=True)
                dw = np.bincount(at, each) + decay * self.w[used]
                grad = each[:, None] * (np.repeat(total, lengths, 0) - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(at, grad[:, f]) for f in range(self.v.shape[1])], 1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                g0 += error.sum() ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * error.sum() / math.sqrt(g0)
        return self


def _feature_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for f in frames:
        found = [features(t if isinstance(t, str) else None, n, known) for t, n in zip(f["text"], f["n_chars"])]
        yield pd.DataFrame({"label": f["label"], "index": [i.tobytes() for i, _ in found], "value": [v.tobytes() for _, v in found]})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int, key: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids (doc_id, label), those with the least hash, joined to their documents. Ids with two labels count as the larger."""
    ids = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & allowed).groupBy(F.col(key).alias("labelled_id")).agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(bound)
    return docs.join(F.broadcast(ids), docs[key] == ids["labelled_id"])


def train_quality(docs: DataFrame, labels: DataFrame, allowed: Column, *, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", label: str = "quality", max_train: int = 4000, max_chars: int = 50_000) -> bytes | None:
    """A pickled model fitted to at most ``max_train`` labelled documents of at most ``max_chars`` characters; None without both labels.

    ``allowed``: a condition on the labels' rows; nothing else of them but the label is used. Only the sample's
    features reach the driver. Null labels and ids are left out; of several labels of an id the largest holds, of several texts the least;
    null texts are empty; ties in the choice of documents are broken by id. Same tables, same model.
    """
    sample = labelled_sample(docs.where(F.length(F.coalesce(F.col(text), F.lit(""))) <= max_chars), labels, label, allowed, max_train, key)
    size = F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")
    rows = sample.select("label", F.col(text).alias("text"), size.alias("n_chars"), F.col("labelled_id"))
    rows = rows.groupBy("labelled_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "n_chars", "label")).alias("r"))
    rows = rows.select("r.label", "r.text", "r.n_chars").mapInPandas(_feature_frames, "label int, index binary, value binary").collect()
    if len({r.label for r in rows}) < 2:
        return None
    data = sorted((bytes(r["index"]), bytes(r["value"]), r["label"]) for r in rows)
    machine = FactorisationMachine(HASHED + len(STATISTICS))
    machine.fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v, _ in data], np.array([float(x > 0) for *_, x in data]))
    return pickle.dumps(machine, 5)


def score_quality(docs: DataFrame, model: bytes | None, *, text: str = "text", n_chars: str | None = "n_chars", keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``keep`` and ``score``, the probability of label 1, for every whole text; 0.5 without a model.

    Null and empty texts are scored as texts without words; a null n_chars counts as the text's length; texts of
    any length are scored whole; repeated rows stay; an empty table gives an empty result. A column of ``keep``
    that has the name of ``score`` is replaced.
    """
    own = [c for c in keep if c != score]
    schema = docs.select(*own).withColumn(score, F.lit(0.0)).schema
    held = [f"__own{i}" for i in range(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = pickle.loads(model) if model else None, {}

        def probability(texts: list[str | None], sizes: list[float | None]) -> np.ndarray:
            if not machine:
                return np.full(len(texts), 0.5)
            found = [features(t, n, known) for t, n in zip(texts, sizes)]
            starts = np.cumsum([0] + [len(i) for i, _ in found])[:-1]
            margin, _ = machine.margin(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts)
            return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

        for batch in scored_batches(batches, held, ["__text", "__size"], probability):
            yield batch.rename_columns(schema.names)

    size = F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")
    columns = [F.col(c).alias(h) for c, h in zip(own, held)]
    return docs.select(*columns, F.col(text).alias("__text"), size.alias("__size")).mapInArrow(run, schema)
