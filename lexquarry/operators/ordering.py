"""Order by the reader's language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogs import EU_LANGUAGES

#: The languages by whose rules labels can be ordered, unless others are given.
LOCALES = ("en", *sorted(c for c, _, _ in EU_LANGUAGES if c != "en"))


def _language(locale: Column, locales: tuple[str, ...]) -> Column:
    """The language of a locale such as `de` or `de-AT`; the first one where it isn't among them."""
    own = F.lower(F.regexp_extract(locale, r"\A\s*([A-Za-z]+)", 1))
    return F.when(own.isin(*locales), own).otherwise(locales[0])


def positions(rows: DataFrame, by: list[str], *, locale: str = "locale", label: str = "label", code: str = "code", pinned: str = "EU", more: tuple[str, ...] = (), locales: tuple[str, ...] = LOCALES) -> DataFrame:
    """rows with position (from 1) among those of the same by and language: the pinned code first, then by label as the
    language orders base letters (neither case nor accents that aren't letters of their own count), by code, by more.

    A collation belongs to a column and not to a row, so each language has a sort key of its own, which is null in the
    rows of all others: one exchange and one sort serve any mixture of languages. Null labels come last; an unknown or
    null locale is the first of locales. A column `position` is replaced.
    """
    language = _language(F.col(locale), locales)
    keys = [F.when(language == c, F.collate(F.col(label), f"{c}_CI_AI")).asc_nulls_last() for c in locales]
    pin = F.coalesce(F.col(code) == pinned, F.lit(False)).desc()
    window = Window.partitionBy(*by, language).orderBy(pin, *keys, code, *more)
    return rows.withColumn("position", F.row_number().over(window))
