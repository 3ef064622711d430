"""Token ids of whole texts by the tokenizers library, remembering the ids of pre-tokens already met."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_DOUBLE = re.compile(r" \s")
#: Bytes of a pre-token that the table keeps; longer ones are kept in a dictionary.
_LONGEST = 23
#: Places of the table, and characters read at a time.
_PLACES, _AT_ONCE = 1 << 21, 500_000
_OTHER, _LETTER, _MARK, _SPACE, _LINE = range(5)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: itself if it prints, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _cuts_at_spaces(text: str) -> bool:
    """Whether every space stands before a word: elsewhere a cut before a space isn't a cut of the pre-tokenizer."""
    if text[-1].isspace() or "  " in text or " \n" in text:
        return False
    return not _DOUBLE.search(text) if not text.isascii() else not any(" " + c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of the first 65,536 characters. An apostrophe is neither mark nor letter: pre-tokenizers treat some words after it apart."""
    kinds = np.array([_LETTER if chr(c).isalpha() else _OTHER for c in range(1 << 16)], np.uint8)
    kinds[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
    kinds[32], kinds[10] = _SPACE, _LINE
    return kinds


class _Table:
    """Numbers by byte strings of at most _LONGEST bytes, looked up many at a time: open addressing over arrays.

    A string is three words of eight bytes, the last byte being its length, so equal keys are equal strings.
    """

    def __init__(self, places: int):
        self.places = places
        self.keys = np.zeros((places, 3), np.uint64)
        self.clear()

    def clear(self) -> None:
        self.value = np.full(self.places, -1, np.int32)
        self.held = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[:, 2] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(self.places - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        at = self._place(keys)
        out = self.value[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys).any(1))
        while len(open_):
            at[open_] = now = (at[open_] + 1) & (self.places - 1)
            out[open_] = value = self.value[now]
            open_ = open_[(value >= 0) & (self.keys[now] != keys[open_]).any(1)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` must be new and differ."""
        open_, at = np.arange(len(keys)), self._place(keys)
        while len(open_):
            free = self.value[at] < 0
            self.value[at[free]] = values[open_[free]]
            won = free & (self.value[at] == values[open_])
            self.keys[at[won]] = keys[open_[won]]
            open_, at = open_[~won], (at[~won] + 1) & (self.places - 1)
        self.held += len(keys)


class CachedTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Byte-level pre-tokenizers never join text across the gap between a word and a following space, nor letters, marks and
    a single line end, so a text is cut there, all pieces are looked up at once, and those not met before are encoded
    by the library. Pieces with digits, apostrophes or other characters are cut at spaces only. Texts in which white space
    meets white space, those that hold a special token's string and all texts for tokenizers of other kinds are encoded whole
    by the library. The memory is bounded: about 100 MB, and forgotten when it is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table, self.long = _Table(_PLACES), {}
        self._forget()
        self.cuts = False
        sample = "Überall the_ 3 dogs, naïve.\nSo élan's (x) a-b"
        if self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel":
            self.cuts = True
            self.cuts = self.documents([sample], 0)[0][:-1].tolist() == self.tokenizer.encode(sample, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.table.clear()
        self.long.clear()
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0  # of all pieces, one after the other
        self.ends = np.zeros(1 << 18, np.int32)  # by piece: where its ids end
        self.pieces = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _one(self, piece: str) -> list[int]:
        """Letters are one pre-token, which the library's model takes as it stands, in the alphabet of byte-level vocabularies."""
        bare = piece[1:] if piece[0] == " " else piece
        if not bare.isalpha():
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        mapped = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(mapped)]

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Encodes pieces and gives them numbers."""
        got = [self._one(t) for t in texts]
        n = np.fromiter(map(len, got), np.int32, len(got))
        more = int(n.sum())
        if self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(more, self.used), np.uint32)])
        self.ids[self.used : self.used + more] = [i for x in got for i in x]
        if self.pieces + len(got) > len(self.ends) - 1:
            self.ends = np.concatenate([self.ends, np.zeros(max(len(got), len(self.ends)), np.int32)])
        self.ends[self.pieces + 1 : self.pieces + 1 + len(got)] = self.used + np.cumsum(n)
        self.used += more
        self.pieces += len(got)
        return np.arange(self.pieces - len(got), self.pieces, dtype=np.int32)

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has. Texts that aren't empty and can be cut."""
        flat = "".join(texts)
        point = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.frombuffer(flat.encode("utf-8", "surrogatepass") + bytes(32), np.uint8)
        if len(raw) - 32 == len(point):
            place, kind = None, _kinds()[point]
        else:
            place = np.cumsum(1 + (point >= 0x80).view(np.int8) + (point >= 0x800).view(np.int8) + (point >= 0x10000).view(np.int8), dtype=np.int64)
            kind = np.where(point < 1 << 16, _kinds()[np.minimum(point, 0xFFFF)], _OTHER)
        begin = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(point), bool)
        first[begin[:-1]] = True
        space = kind == _SPACE
        cut = kind[1:] != kind[:-1]
        cut = np.r_[True, cut & ~space[:-1]] | space | first
        line = np.flatnonzero(kind == _LINE)
        if len(line):
            near = np.r_[_OTHER, kind, _OTHER]
            plain = np.isin(near[line], (_LETTER, _MARK)) & np.isin(near[line + 2], (_LETTER, _MARK)) & ~first[line] & ~np.r_[first, True][line + 1]
            kind[line[~plain]] = _OTHER
        odd = kind == _OTHER
        if odd.any():  # the piece between spaces stays in one
            whose = np.cumsum(space | first)
            held = np.zeros(whose[-1] + 1, bool)
            held[whose[odd]] = True
            cut &= space | first | ~held[whose]
        start = np.flatnonzero(cut)
        counts = np.diff(np.searchsorted(start, begin))
        low = start if place is None else np.where(start > 0, place[start - 1], 0)
        size = np.diff(np.r_[low, len(raw) - 32])
        number = self._numbers(raw, low, size)
        to = self.ends[number + 1].astype(np.int64)
        n = to - self.ends[number]
        done = np.cumsum(n)
        ids = self.ids[np.arange(done[-1]) + np.repeat(to - done, n)]
        return ids, np.diff(np.r_[0, done[np.cumsum(counts) - 1]])

    def _numbers(self, raw: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of pieces, which are learnt if they are new."""
        if self.table.held + len(self.long) > _PLACES // 2:
            self._forget()
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        keys = np.empty((len(low), 3), np.uint64)
        mask = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        for i in range(3):
            keys[:, i] = eight[np.minimum(low + 8 * i, len(eight) - 1)] & mask[np.clip(size - 8 * i, 0, 8)]
        keys[:, 2] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        short = size <= _LONGEST
        number = self.table.find(keys) if short.all() else np.full(len(low), -1, np.int32)
        if not short.all():
            number[short] = self.table.find(keys[short])
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        data, new, known = raw.data, {}, self.long
        words = [bytes(data[a : a + n]) for a, n in zip(low[missing].tolist(), size[missing].tolist())]
        for i, w in zip(missing.tolist(), words):
            if w not in new and w not in known:
                new[w] = i
        if new:
            got = self._learn([w.decode("utf-8", "surrogatepass") for w in new])
            where = np.fromiter(new.values(), np.int64, len(new))
            fits = short[where]
            self.table.add(keys[where[fits]], got[fits])
            new = dict(zip(new, got.tolist()))
            known.update((w, k) for w, k in new.items() if len(w) > _LONGEST)
        number[missing] = [new[w] if w in new else known[w] for w in words]
        return number

    def documents(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """The ids of each text, with ``end_id`` after them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whose: list[int] = []
        some: list[str] = []
        held: dict[int, list[np.ndarray]] = {}  # of texts read in parts

        def read() -> None:
            if not some:
                return
            ids, n = self._fast(some)
            ends = np.full(len(ids) + len(n), end_id, np.uint32)
            ends[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            to = (np.cumsum(n) + np.arange(1, len(n) + 1)).tolist()
            for i, a, b in zip(whose, [0, *to], to):
                if i in held:
                    held[i].append(ends[a : b - 1])
                else:
                    out[i] = ends[a:b]
            whose.clear()
            some.clear()

        size, end = 0, np.array([end_id], np.uint32)
        for i, text in enumerate(texts):
            if not text:
                out[i] = end
            elif not self.cuts or not _cuts_at_spaces(text) or any(s in text for s in self.special):
                out[i] = np.r_[self._whole(text), end]
            else:
                parts = [text] if len(text) <= _AT_ONCE else list(_parts(text))
                if len(parts) > 1:
                    held[i] = []
                for part in parts:
                    some.append(part)
                    whose.append(i)
                    size += len(part)
                    if size > _AT_ONCE:
                        read()
                        size = 0
        read()
        for i, parts in held.items():
            out[i] = np.concatenate([*parts, end])
        return out


def _parts(text: str) -> Iterator[str]:
    """A long text cut before spaces."""
    lo = 0
    while len(text) - lo > _AT_ONCE:
        hi = text.rfind(" ", lo + 1, lo + _AT_ONCE)
        if hi < 0:
            hi = text.find(" ", lo + _AT_ONCE)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, so that its memory of pieces outlives a task."""
    return CachedTokenizer(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: may a sentence end after it, may one begin with it."""
    t = tokenizer(path).tokenizer
    words = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    ends = np.array([w[-1:] in ".!?…" and w != "" or "Ċ" in w for w in words])
    begins = np.array([w[:1] in ("Ġ", "Ċ") for w in words])
    return ends, begins
