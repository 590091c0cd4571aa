"""Character references of HTML, decoded in one scan by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_PIECE = r"(?is)&(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);|[^&]+|&"


def character(code: Column) -> Column:
    """The character of a code point; null if there is none."""
    valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decoded(text: Column, named: dict[str, str], *, any_case: bool = False) -> Column:
    """text with its references as characters. Names that aren't in the table, and numbers that are no character, stay
    as they are; what was decoded isn't looked at again."""
    table = F.create_map(*[F.lit(x) for k, v in named.items() for x in (k, v)])

    def one(piece: Column) -> Column:
        name = F.substring(piece, 2, F.length(piece) - 2)
        digits = F.regexp_replace(name, "(?i)^#x?0*(?=.)", "")
        code = F.when(name.rlike("(?i)^#x"), F.conv(digits, 16, 10)).otherwise(digits)
        number = F.when(F.length(digits) <= 8, character(code.try_cast("long")))
        key = F.lower(name) if any_case else name
        return F.when(piece.startswith("&#"), F.coalesce(number, piece)).when(piece.startswith("&"), F.coalesce(F.try_element_at(table, key), piece)).otherwise(piece)

    whole = lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), one), "")).otherwise(t)
    return let(text, whole)
