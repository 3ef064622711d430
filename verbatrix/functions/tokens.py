"""Words and bigrams, as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NOT_SPACE, SPACE, STOP_WORDS

_NEXT = r"(?![\p{L}\p{N}_])"
_BEFORE = r"(?<![\p{L}\p{N}_]"
#: Marks that stand alone and sentence ends, clitics, contractions: the strings one of which a text must have (none: any text), and (pattern, replacement) in order.
#: What is looked for begins a pattern, and what stands before it is looked at afterwards: most places are passed by one comparison.
_RULES = (
    ((), (
        (r"(?![a-zA-Z0-9 ,])([;@#$%&?!\[\](){}<>\"“”‘«»…—]|\.{2,}|--+|``|'')", " $1 "),
        (rf"([:,](?!\p{{Nd}})|\.(?<=[^.]\.)(?=[\])}}>\"']*(?:{SPACE}|\z|[:,](?!\p{{Nd}}))))", " $1 "),
    )),
    (("'",), (
        (rf"'(?:(?<=(?:{SPACE}|\A)')(?=\p{{L}})|(?={SPACE}|\z))", " ' "),
        (rf"(n't)(?<=\p{{L}}n't){_NEXT}", " $1"),
        (rf"('(?<=[\p{{L}}\p{{N}}]')(?:s|m|d|ll|re|ve)){_NEXT}", " $1"),
    )),
    (("cannot", "gimme", "lemme", "gonna", "wanna", "gotta"), (
        (rf"(c{_BEFORE}c)an)(not){_NEXT}", "$1 $2"),
        (rf"(g{_BEFORE}g)im|l{_BEFORE}l)em)(me){_NEXT}", "$1 $2"),
        (rf"(g{_BEFORE}g)on|w{_BEFORE}w)an)(na){_NEXT}", "$1 $2"),
        (rf"(g{_BEFORE}g)ot)(ta){_NEXT}", "$1 $2"),
    )),
)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def tokens(text: Column, *, mode: str = "treebank", lowercase: bool = True, strict: bool = True) -> Column:
    """The words of letters a-z only. ``treebank``: marks and clitics are split off first; ``space``: white space alone splits.

    ``strict=False`` keeps every token that begins with a letter (upper case too).
    """
    text = F.lower(text) if lowercase else text
    if mode == "treebank":
        for needed, rules in _RULES:
            text = F.transform(F.array(text), lambda t: F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in needed]), _replaced(t, rules)).otherwise(t))[0] if needed else _replaced(text, rules)
    if strict:
        return F.regexp_extract_all(text, F.lit(rf"(?<![a-z])(?<!{NOT_SPACE})[a-z]++(?!{NOT_SPACE})"), F.lit(0))
    return F.filter(F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0)), lambda w: F.lower(w).rlike(r"\A[A-Za-z]"))


def _replaced(text: Column, rules) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def bigrams(words: Column, stop_words=STOP_WORDS) -> Column:
    """Pairs of neighbours, joined by a space, neither of which is a stop word (stop words still part their neighbours)."""
    stops = list(stop_words)

    def pairs(w: Column) -> Column:
        both = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))
        kept = F.filter(both, lambda p: ~p["a"].isin(stops) & ~p["b"].isin(stops))
        return F.transform(kept, lambda p: F.concat_ws(" ", p["a"], p["b"]))

    return F.transform(F.array(words), pairs)[0]
