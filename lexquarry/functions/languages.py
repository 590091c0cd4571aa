"""Language identities: two letters in the interface, three in transport and index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogs import EU_LANGUAGES


def _map(a: int, b: int) -> Column:
    return F.create_map(*[F.lit(x) for row in EU_LANGUAGES for x in (row[a], row[b])])


def is_known(code: Column) -> Column:
    """One of the 24 official languages, by two letters."""
    return F.coalesce(code.isin(*[c for c, _, _ in EU_LANGUAGES]), F.lit(False))


def is_cellar(code: Column) -> Column:
    """Any three small letters: what transport admits."""
    return F.coalesce(code.rlike(r"\A[a-z]{3}\z"), F.lit(False))


def to_cellar(code: Column) -> Column:
    """Three letters: as they are if given so, by the table if known by two, else null."""
    return F.when(is_cellar(code), code).otherwise(F.try_element_at(_map(0, 1), code))


def from_cellar(code: Column) -> Column:
    return F.try_element_at(_map(1, 0), code)


def cache_token(code: Column) -> Column:
    """Two letters if known, unknown three as they are; German if none is given, null if it is none."""
    return F.when(code.isNull(), "de").when(is_known(code), code).when(is_cellar(code), F.coalesce(from_cellar(code), code))


def native_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(1, 2), code), F.try_element_at(_map(0, 2), code))


def default_language(locale: Column, stored: Column) -> Column:
    """The stored one if it is known, else the locale's first part if that is, else German."""
    primary = F.element_at(F.split(F.lower(F.coalesce(locale, F.lit(""))), "[-_]"), 1)
    return F.when(is_known(stored), stored).when(is_known(primary), primary).otherwise("de")


def source_variant(variant: Column) -> Column:
    return F.when(variant == "translation-en", variant).otherwise("official-de")
