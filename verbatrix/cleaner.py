"""The public face: a cleaner whose methods work on columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .functions import normalize as n
from .operators import ngrams, profile, sampling


class TextCleaner:
    """Column methods take and return columns; table methods take a table and a column's name."""

    def __init__(self, html_mode: str = "exact", exact_prices: bool = False):
        self.html_mode, self.exact_prices = html_mode, exact_prices

    def clean_text(self, text: Column) -> Column:
        return n.clean_text(text, html_mode=self.html_mode, exact_prices=self.exact_prices)

    def normalize_unicode(self, text: Column) -> Column:
        return n.unicode_fold(text)

    def normalize_html(self, text: Column) -> Column:
        return n.html_fold(text, self.html_mode)

    def normalize_prices(self, text: Column) -> Column:
        return n.normalize_prices(text, self.exact_prices)

    def normalize_measurements(self, text: Column) -> Column:
        return n.normalize_measurements(text)

    def expand_abbreviations(self, text: Column) -> Column:
        return n.expand_abbreviations(text)

    def clean_column(self, df: DataFrame, column: str) -> DataFrame:
        return sampling.clean_column(df, column, html_mode=self.html_mode, exact_prices=self.exact_prices)

    def sample_compare(self, df: DataFrame, column: str, k: int = 10, seed: int | None = None) -> DataFrame:
        return sampling.sample_compare(df, column, k, seed, html_mode=self.html_mode, exact_prices=self.exact_prices)

    def profile_column(self, df: DataFrame, column: str, most_common_gram: int = 200, most_common_abbr: int = 10) -> DataFrame:
        return profile.profile_column(df, column, most_common_gram, most_common_abbr)

    @staticmethod
    def _counted(counts: DataFrame) -> tuple[int, dict[str, int]]:
        found = {r.label: r.n for r in counts.collect()}  # at most one row a pattern
        return sum(found.values()), found

    def _detect_price_mentions(self, df: DataFrame, column: str) -> tuple[int, dict[str, int]]:
        return self._counted(profile.detect_prices(df, column))

    def _detect_measurements(self, df: DataFrame, column: str) -> tuple[int, dict[str, int]]:
        return self._counted(profile.detect_measurements(df, column))

    def _detect_abbreviations(self, df: DataFrame, column: str, top_abbr: int = 10) -> list[tuple[str, int]]:
        return [(r.abbr, r.n) for r in profile.detect_abbreviations(df, column, top_abbr).collect()]

    def _detect_html(self, df: DataFrame, column: str) -> DataFrame:
        return profile.detect_html(df, column)

    def _detect_unicode(self, df: DataFrame, column: str) -> DataFrame:
        return profile.detect_unicode(df, column)

    def _extract_top_ngrams(self, df: DataFrame, column: str, top_n: int = 200) -> DataFrame:
        return ngrams.top_bigrams(df, column, top_n)
