"""Letters without their accents."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _plain() -> tuple[str, str]:
    """By rule: the letters that are one base letter with marks of U+0300 to U+036F."""
    found = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all("̀" <= m <= "ͯ" for m in marks):
            found[c] = base
    return "".join(found), "".join(found.values())


def unaccented(text: Column) -> Column:
    """text without accents, be they part of a letter or behind it. Stays in the JVM: a translation and a pattern."""
    source, target = _plain()
    return F.regexp_replace(F.translate(text, source, target), "[̀-ͯ]", "")
