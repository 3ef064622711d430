"""Main text of web pages by differencing each page with its nearest URLs."""

from __future__ import annotations

import html
import math
import pickle
import re
import tempfile
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned
from .url_rules import url_host, url_path

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: Fixed, of HTML: elements whose content isn't markup, without an end tag, that break a line, that hold prose.
_RAW = {"script", "style", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: Elements, roles and words of class names and ids that mark what isn't the article.
_DROPPED = set("nav footer aside form button select datalist dialog menu template svg math canvas object audio video head".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
_NAMES = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar skip".split())
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


class Line(NamedTuple):
    text: str  # of a marked line, which is never given out: MARK and a checksum
    article: bool  # inside <article>, <main> or role=main
    prose: bool  # of an element that holds prose
    marked: bool = False  # in an element that is marked as not of the article


MARK = "\0"


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element is marked as not of the article, and as the main content."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, False
    dropped = main = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                dropped |= bool(words) and (words[0] in _NAMES or words[-1] in _NAMES)
        elif name == "role":
            dropped |= value.lower() in _ROLES
            main |= value.lower() == "main"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            dropped = True
    return dropped, main


def lines_of(page: str | None) -> list[Line]:
    """The lines of a page; those of elements marked as not of the article come after what else their block has. Unclosed elements end with the one around them."""
    if not page:
        return []
    out: list[Line] = []
    words: list[str] = []
    aside: list[str] = []  # of marked elements
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, article: of the element or one around it
    prose = False

    def end_line() -> None:
        nonlocal prose
        if words and (text := " ".join(html.unescape("".join(words)).split())):
            out.append(Line(text.replace(MARK, ""), bool(stack) and stack[-1][2], prose))
        if aside and (text := " ".join(html.unescape("".join(aside)).split())):
            out.append(Line(f"{MARK}{zlib.crc32(text.encode('utf-8', 'replace')):x}", bool(stack) and stack[-1][2], False, True))
        words.clear()
        aside.clear()
        prose = any(n in _PROSE for n, *_ in stack)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        to = m.start() if m else n
        if to > at:
            (aside if stack and stack[-1][1] else words).append(page[at:to])
        if not m:
            break
        at = max(m.end(), to + 1)
        if m[0].startswith("<![CDATA["):
            continue
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name in _BLOCK:
                end_line()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body", "td") and name not in ("article", "main", "body", "html", "table"):
                    break
            if name in _BLOCK:
                prose = any(x in _PROSE for x, *_ in stack)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _BLOCK:
            end_line()
            while stack and name in _PROSE and stack[-1][0] == name:  # an unclosed <p> or <li> ends where the next begins
                stack.pop()
            while stack and stack[-1][0] not in _BLOCK and name not in ("p",):  # inline elements don't hold blocks
                stack.pop()
            if name != "p":
                while stack and stack[-1][0] == "p":
                    stack.pop()
        elif name == "br":
            (aside if stack and stack[-1][1] else words).append(" ")
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
            continue
        dropped, main = _marks(m[3])
        around = stack[-1] if stack else ("", False, False)
        inside = around[2] or name in ("article", "main") or main
        header = name == "header" and not around[2]
        stack.append((name, around[1] or name in _DROPPED or header or dropped and name not in ("html", "body", "article", "main"), inside))
        if name in _BLOCK:
            prose = any(x in _PROSE for x, *_ in stack)
    end_line()
    return out


def _bits(places: list[int], size: int) -> int:
    out = bytearray(size // 8 + 1)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(out, "little")


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence of two line lists, at every size.

    Common ends are taken first. A row of the table of the rest is an integer with a bit for each line of ``b``, 0 where
    the length grows; a row follows from the one below by one addition (Hyyrö). About every sqrt(n)th row is kept and
    those between are made again on the way back, so memory is sqrt(n) * m bits and time n * m by the word.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    kept = [*range(lo), *range(len(a) - hi, len(a))]
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x = [i for i in range(lo, len(a) - hi) if a[i] in both]
    y = [t for t in b[lo : len(b) - hi] if t in both]
    n, m = len(x), len(y)
    places: dict[str, list[int]] = {}
    for j, t in enumerate(y):
        places.setdefault(t, []).append(m - 1 - j)
    masks = {t: _bits(p, m) for t, p in places.items() if 64 * len(p) >= m}  # at most 64; the others are quick to make
    full, step = (1 << m) - 1, math.isqrt(n) + 1

    def rows(start: int, end: int, row: int) -> Iterator[int]:
        """Rows end - 1 to start, from row ``end``."""
        for i in range(end - 1, start - 1, -1):
            t = a[x[i]]
            hit = row & (masks[t] if t in masks else _bits(places[t], m))
            row = ((row + hit) | (row - hit)) & full
            yield row

    stored, row = {n: full}, full
    for i, row in zip(range(n - 1, -1, -1), rows(0, n, full)):
        if i % step == 0:
            stored[i] = row
    j, length = 0, m - row.bit_count()  # length: of the best from line i and line j on
    for start in range(0, n, step):
        end = min(start + step, n)
        block = [*rows(start, end, stored[end])][::-1] + [stored[end]]
        for i in range(start, end):
            if j == m:
                break
            here, below = (block[k - start].to_bytes(m // 8 + 1, "little") for k in (i, i + 1))
            left = m - j
            under = left - (block[i + 1 - start] & ((1 << left) - 1)).bit_count()
            while j < m and a[x[i]] != y[j]:
                p = m - 1 - j
                right = length - (~here[p >> 3] >> (p & 7) & 1)
                if under >= right:
                    break
                length, under, j = right, under - (~below[p >> 3] >> (p & 7) & 1), j + 1
            if j < m and a[x[i]] == y[j]:
                p = m - 1 - j
                kept.append(x[i])
                length, j = under - (~below[p >> 3] >> (p & 7) & 1), j + 1
            else:
                length = under
    return sorted(kept)


#: Letters that each of two pages must have and the other lack, so that they aren't copies though they share nine tenths.
OWN_LETTERS = 40
#: Runs of copies looked at on either side of a page, and letters of waiting pages held in memory.
LOOK, HELD = 4, 16_000_000


def _letters(lines: Iterable[str]) -> int:
    """Marked lines don't count: copies may come with other menus and adverts."""
    return sum(len(t) for t in lines if not t.startswith(MARK))


def _both_differ(a: list[str], b: list[str], same: list[int]) -> bool:
    """Whether each page has text that the other lacks, rather than other versions of the same lines."""
    shared = Counter(a[i] for i in same)
    mine, theirs = (Counter(w for t in (Counter(x) - shared).elements() for w in t.split()) for x in (a, b))
    own = [_letters(x.elements()) for x in (mine - theirs, theirs - mine)]
    return min(own) >= OWN_LETTERS and _letters((mine & theirs).elements()) < min(own)


def template_lines(own: list[str], other: list[str]) -> set[int] | None:
    """Indices of ``own`` that another page shares; None if that is a copy, which says nothing about the template.

    A copy shares nine tenths of the text, and not both pages have at least OWN_LETTERS of text that the other lacks:
    a short article in a large template has, and so has the page next to it.
    """
    same = common_lines(own, other)
    if _letters(own[i] for i in same) < 0.9 * _letters(own) or _both_differ(own, other, same):
        return set(same)
    return None


def same_run(a: list[str], b: list[str]) -> bool:
    """Whether two adjacent pages are copies of one another."""
    if a == b:
        return True
    least, some = 0.9 * max(_letters(a), _letters(b)), set(b)
    if _letters(t for t in a if t in some) < least:  # no need to align
        return False
    same = common_lines(a, b)
    return _letters(a[i] for i in same) >= least and not _both_differ(a, b, same)


def _text_without(page: list[Line], shared: set[int]) -> str:
    kept = [i for i, x in enumerate(page) if not x.marked and (i not in shared or x.article and x.prose)]
    if any(page[i].article for i in kept):
        kept = [i for i in kept if page[i].article]
    return "\n\n".join(page[i].text for i in kept)


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """The lines that no neighbour shares, in page order.

    Lines of elements that are marked as not of the article take part in the comparison but go even if unshared. Prose of a
    declared article stays even if shared, as articles quote one another; where an article is declared
    and has text, unshared lines outside it are dropped too. A neighbour that is a copy (:func:`template_lines`)
    isn't used.
    """
    own = [x.text for x in page]
    shared: set[int] = set()
    if any(not x.marked for x in page):
        for other in neighbours:
            shared |= template_lines(own, [x.text for x in other]) or set()
    return _text_without(page, shared)


def _has_text(page: list[Line]) -> bool:
    return any(not x.marked for x in page)


class _Waiting(NamedTuple):
    row: tuple
    page: list[Line]
    shared: set[int]
    looks: int  # runs after it that it may still be compared with


class _Held:
    """Pages that wait for one that differs. Beyond HELD letters they go to a file of the task's own."""

    def __init__(self) -> None:
        self.pages: list[_Waiting] = []
        self.size, self.file = 0, None

    def add(self, page: _Waiting) -> None:
        self.pages.append(page)
        self.size += 300 + sum(len(x.text) + 150 for x in page.page)
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.pages, self.file, 5)
            self.pages, self.size = [], 0

    def drain(self) -> Iterator[_Waiting]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
            self.file.close()
        yield from self.pages


class Sweep:
    """Pages in the order of their URLs, each given out with its main text as soon as both sides are known.

    Adjacent copies form a run. A page is compared with the nearest page outside its run on either side, and if that
    is a copy of it for its part (the page is all template, say), with that of the run beyond, LOOK runs in all.
    """

    def __init__(self) -> None:
        self.host: str | None = None
        self.last: list[str] | None = None  # the page before
        self.runs: deque[list[str]] = deque(maxlen=LOOK)  # the last pages of the runs before that one's, nearest first
        self.held = _Held()

    def begin(self, host: str | None, lines: list[str]) -> Iterator[tuple]:
        """Moves to the next page."""
        if host != self.host or self.last is None:
            yield from self.end()
            self.host, self.last = host, None
            self.runs.clear()
        elif not same_run(self.last, lines):
            self.runs.appendleft(self.last)
            held, self.held = self.held, _Held()
            for w in held.drain():
                got = template_lines([x.text for x in w.page], lines)
                if got is None and w.looks > 1:
                    self.held.add(w._replace(looks=w.looks - 1))
                else:
                    yield (*w.row, _text_without(w.page, w.shared | (got or set())))
        self.last = lines

    def page(self, row: tuple, host: str | None, page: list[Line]) -> Iterator[tuple]:
        """Takes a page; a page without unmarked lines is nobody's neighbour."""
        if not _has_text(page):
            yield (*row, "")
            return
        lines = [x.text for x in page]
        yield from self.begin(host, lines)
        before = next((got for r in self.runs if (got := template_lines(lines, r)) is not None), set())
        self.held.add(_Waiting(row, page, before, LOOK))

    def end(self) -> Iterator[tuple]:
        """Gives out what has no page after it that differs."""
        held, self.held = self.held, _Held()
        for w in held.drain():
            yield (*w.row, _text_without(w.page, w.shared))


class Edge(NamedTuple):
    """What the ranges around need of a range: the ends of its first and last host's runs."""

    first: str
    heads: list[list[str]]  # the first page of each of the first host's runs, LOOK + 1 at most
    whole: bool  # the range has one host only
    host: str
    last: list[str]
    runs: list[list[str]]  # as in Sweep


def edge_of(pages: Iterable[tuple[str, list[Line]]]) -> Edge | None:
    first = host = last = None
    heads: list[list[str]] = []
    runs: deque[list[str]] = deque(maxlen=LOOK)
    whole = True
    for now, page in pages:
        if not _has_text(page):
            continue
        lines = [x.text for x in page]
        if last is None:
            first, heads = now, [lines]
        elif now != host:
            whole = False
            runs.clear()
        elif not same_run(last, lines):
            runs.appendleft(last)
            if whole and len(heads) <= LOOK:
                heads.append(lines)
        host, last = now, lines
    return None if last is None else Edge(first, heads, whole, host, last, [*runs])


def around(edges: dict[int, Edge]) -> dict[int, tuple]:
    """By range: (last, runs) of the host it begins in, from before it, and the heads of the host it ends in, from after it; None where there are none."""
    before, after = {}, {}
    host, last, runs = None, None, []
    for r in sorted(edges):
        e = edges[r]
        if last is not None and host == e.first:
            before[r] = last, runs
            if e.whole:
                runs = [*e.runs, *([] if same_run(last, e.heads[0]) else [last]), *runs][:LOOK]
            else:
                runs = e.runs
        else:
            runs = e.runs
        host, last = e.host, e.last
    host, heads = None, []
    for r in sorted(edges, reverse=True):
        e = edges[r]
        if heads and host == e.host:
            after[r] = heads
            heads = [*e.heads, *heads[same_run(e.last, heads[0]) :]][: LOOK + 1] if e.whole else e.heads
        else:
            heads = e.heads
        host = e.first
    return {r: (before.get(r), after.get(r)) for r in before.keys() | after.keys()}


def _pack(x) -> bytes:
    return zlib.compress(pickle.dumps(x, 5), 1)


def _unpack(x: bytes):
    return pickle.loads(zlib.decompress(x))


def _pack_lines(page: list[Line]) -> bytes:
    """A text line each (they hold no line ends), and a last one of a digit each."""
    text = "\n".join([*(x.text for x in page), "".join(str(4 * x.marked + 2 * x.article + x.prose) for x in page)])
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 6)


def _unpack_lines(blob: bytes) -> list[Line]:
    *lines, marks = zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n")
    return [Line(t, m in "2367", m in "1357", m in "4567") for t, m in zip(lines, marks, strict=True)]


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[str, list[Line]]]:
    for host, blob in zip(batch.column("__host"), batch.column("__lines"), strict=True):
        yield host.as_py(), _unpack_lines(blob.as_py())


def extract_main_text(pages: DataFrame, *, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """``keep`` and ``out``, the main text of each whole page: blocks joined by two line ends, '' if there are none.

    Pages are read to lines and sorted by host and path over ranges of any host (a large host takes many ranges).
    Each is compared with the nearest page before and after it that is of the same host and no copy of it
    (:class:`Sweep`). Every range is handed the ends of the runs around it (at most 2 * LOOK + 2 pages, by way of the
    driver, and only where a host crosses its edge), so the texts don't depend on the number of ranges. Copies wait
    for the page after them, in a file if they are many.

    Lines of menus, adverts and the like, told by tag, role or class, are compared too and then dropped: which lines go is
    decided by both, neighbours and marks. Null pages and pages without text give '' and are nobody's neighbours; null urls have an empty host and are one
    another's neighbours; repeated rows stay; an empty table gives an empty result; broken markup is read as far as it
    goes; a column of ``keep`` named like ``out`` is replaced.
    """
    own = [c for c in keep if c != out]
    schema = pages.select(*own).withColumn(out, F.lit("").cast("string")).schema
    keys = ("__host", "__path", "__tie")
    rows = pages.select(*own, F.col(page).alias("__lines"), url_host(F.col(url)).alias("__host"), url_path(F.col(url)).alias("__path"))
    rows = rows.withColumn("__tie", F.xxhash64(*own, "__lines"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__lines")
            lines = pa.array([_pack_lines(lines_of(p.as_py())) for p in batch.column(at)], pa.binary())
            yield batch.set_column(at, pa.field("__lines", pa.binary()), lines)

    # not pinned before it is sorted: reading pages twice, as ranges are sampled, costs less than another copy on disk
    parsed = rows.mapInArrow(read, rows.withColumn("__lines", F.lit(b"")).schema)
    ranges = pinned(parsed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__path", "__tie"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = edge_of(x for batch in batches for x in _pages(batch))
        if edge:
            yield pa.RecordBatch.from_pydict({"range": pa.array([TaskContext.get().partitionId()], pa.int32()), "edge": [_pack(tuple(edge))]})

    met = ranges.select("__host", "__lines").mapInArrow(edges, "range int, edge binary").collect()
    context = {r: _pack(x) for r, x in around({r.range: Edge(*_unpack(bytes(r.edge))) for r in met}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, sweep, fields = TaskContext.get().partitionId(), Sweep(), []
        before, after = _unpack(context[r]) if r in context else (None, None)

        def results() -> Iterator[tuple]:
            started = before is None
            for batch in batches:
                fields[:] = [batch.schema.field(c) for c in own] + [pa.field(out, pa.string())]
                for values, (host, page) in zip(zip(*(batch.column(c) for c in own)) if own else repeat(()), _pages(batch)):
                    if not started and _has_text(page):
                        sweep.host, sweep.last, started = host, before[0], True
                        sweep.runs.extend(before[1])
                    yield from sweep.page(tuple(v.as_py() for v in values), host, page)
            for head in after or []:
                yield from sweep.begin(sweep.host, head)
            yield from sweep.end()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

        done: list[tuple] = []
        for row in results():
            done.append(row)
            if len(done) >= 256:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    return ranges.mapInArrow(run, schema)
