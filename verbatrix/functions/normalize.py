"""Normalisers of free text, as Column functions. A null stays null everywhere."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import ABBREVIATIONS, DIGIT, EDGE, END, SPACE, START, TAG_OR_EMPTY


def bound(text: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of ``text``, evaluated once however often the step names it: chained steps don't multiply."""
    return F.transform(F.array(text), lambda t: step(t))[0]


def replace_each(text: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``make`` of it, or left where that is null. Texts without a match are passed through."""

    def step(t: Column) -> Column:
        made = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(make(m), m))
        joined = F.array_join(F.zip_with(F.split(t, pattern, -1), made, lambda rest, new: F.concat(rest, F.coalesce(new, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return bound(text, step)


def unicode_fold(text: Column) -> Column:
    """NFKC, then curly quotes, dashes and no-break spaces to their plain forms."""
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)
    return F.translate(composed, "“”‘’–— ", "\"\"''-- ")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(text: Column, mode: str = "exact") -> Column:
    """HTML character references decoded: by HTML5's rules in an Arrow UDF, or ("fast") HTML 4's entities in the JVM."""
    if mode == "exact":
        return _unescape(text)
    return F.when(text.isNotNull(), F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG_OR_EMPTY, "")


def html_fold(text: Column, mode: str = "exact") -> Column:
    """References decoded, then anything between angle brackets removed, without a space in its place."""
    return strip_tags(unescape(text, mode))


def _number(token: Column) -> Column:
    return F.regexp_extract(token, rf"{DIGIT}+\.?{DIGIT}*", 0)


def _times(factor: int, exact: bool, sign: str = "") -> Callable[[Column], Column]:
    """The token's number times ``factor``, cut to a whole number after binary multiplication (``exact``: decimal); null if that can't be."""

    def make(token: Column) -> Column:
        n = _number(token)
        product = F.try_multiply(F.regexp_replace(n, r"\.$", "").try_cast("decimal(30,6)"), F.lit(factor)) if exact else n.try_cast("double") * factor
        return F.concat(F.lit(sign), product.try_cast("bigint").cast("string"))

    return make


def normalize_prices(text: Column, exact: bool = False) -> Column:
    """Eight ordered rules: ``$ 5`` closes up, thousands commas go, k, m, thousand and million become zeros."""
    n = rf"{DIGIT}+\.?{DIGIT}*"
    text = F.regexp_replace(text, rf"\${SPACE}+", r"\$")
    text = replace_each(text, rf"{START}{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})+{END}", lambda m: F.replace(m, F.lit(","), F.lit("")))
    for unit, factor in (("k", 1000), ("m", 1_000_000)):
        text = replace_each(text, rf"(?iu)\${n}{unit}{END}", _times(factor, exact, "$"))
    for unit, factor in (("k", 1000), ("m", 1_000_000)):
        text = replace_each(text, rf"(?iu){START}{n}{unit}{END}", _times(factor, exact))
    whole = lambda m: F.try_multiply(F.regexp_extract(m, rf"{DIGIT}+", 0).try_cast("bigint"), F.lit(1000)).cast("string")
    text = replace_each(text, rf"(?iu){START}{DIGIT}+{SPACE}+thousand{END}", whole)
    return replace_each(text, rf"(?iu){START}{n}{SPACE}+million{END}", _times(1_000_000, exact))


def normalize_measurements(text: Column) -> Column:
    """Leading decimals, feet, inches, square feet, acres and square meters in one way of writing. Order matters."""
    amount = rf"{START}({DIGIT}+(?:\.{DIGIT}+)?)"
    for pattern, new in ((rf"(?<!{DIGIT})\.({DIGIT})", "0.$1"), (rf"({DIGIT}+)'", "$1 foot"), (rf'({DIGIT}+)"', "$1 inch"), (rf"(?iu)({DIGIT}+)-?ft{END}", "$1 foot")):
        text = F.regexp_replace(text, pattern, new)
    grouped, unit = rf"{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})+", rf"(?:sq\.?{SPACE}*ft\.?|sqft|acres?)"

    def joined(m: Column) -> Column:
        return F.concat(F.replace(F.regexp_extract(m, grouped, 0), F.lit(","), F.lit("")), F.lit(" "), F.regexp_replace(m, rf"^{grouped}{SPACE}*", ""))

    text = replace_each(text, rf"(?iu){START}{grouped}{SPACE}*{unit}{EDGE}", joined)
    for pattern, new in (
        (rf"(?iu){amount}{SPACE}*sq\.?{SPACE}*ft\.?{EDGE}", "$1 square feet"),
        (rf"(?iu){amount}{SPACE}*square{SPACE}+feet{END}", "$1 square feet"),
        (rf"(?iu){amount}{SPACE}+acres?{END}", "$1 acres"),
        (rf"(?iu){amount}{SPACE}*sq\.?{SPACE}*m(?:eters?)?{END}", "$1 square meters"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def abbreviation_pattern(keys=ABBREVIATIONS) -> str:
    return rf"(?iu){START}(?:{'|'.join(map(re.escape, keys))}){END}"


def expand_abbreviations(text: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """One pass from left to right; the text put in isn't looked at again."""
    if not abbreviations:
        return text
    known = F.create_map(*[F.lit(x) for kv in abbreviations.items() for x in kv])
    return replace_each(text, abbreviation_pattern(abbreviations), lambda m: F.try_element_at(known, F.lower(m)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def clean_text(text: Column, *, html_mode: str = "exact", exact_prices: bool = False) -> Column:
    """Unicode, markup, prices, measurements, abbreviations, ends: each step works on what the one before left."""
    text = html_fold(unicode_fold(text), html_mode)
    for step in (lambda t: normalize_prices(t, exact_prices), normalize_measurements, expand_abbreviations, strip):
        text = bound(text, step)
    return text
