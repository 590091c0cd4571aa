"""Previews of sections, and order by the reader's language."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import present
from lexquarry.operators import ordering

_SECTION = "jurisdiction string, law_code string, law_title string, section string, subsection string, reference_type string, heading string, text string, variant string, language string, celex string, is_authoritative_text boolean, provider string, retrieved_at string, cache_status string"


def _preview(spark, footer=True, **given):
    base = {"jurisdiction": "DE", "law_code": "ABC", "section": "5", "reference_type": "section", "text": "a\n\nb", "provider": "P", "retrieved_at": "2024-01-02T03:04:05Z", "cache_status": "cached"} | given
    row = tuple(base.get(part.split()[0]) for part in _SECTION.split(", "))
    df = spark.createDataFrame([row], _SECTION)
    return df.select(present.preview(F.struct(*df.columns), footer).alias("p")).first().p


def test_preview(spark):
    p = _preview(spark, heading="Head")
    assert (p.title, p.paragraphs, p.metadata_lines) == ("§ 5 ABC – Head", ["a", "", "b"], ["Quelle: P, ABC, § 5, abgerufen am 2024-01-02.", "Cache: cached."])
    assert _preview(spark, False, heading="").title == "§ 5 ABC"
    assert _preview(spark, False).metadata_lines == []
    assert _preview(spark, text=None).paragraphs == [] and _preview(spark, text="").paragraphs == [""]


def test_notices_of_previews(spark):
    fi = [present.FINNISH_NOTICE]
    assert [_preview(spark, False, jurisdiction="FI", is_authoritative_text=a).metadata_lines for a in (True, False, None)] == [[], fi, fi]
    assert _preview(spark, False, jurisdiction="AT", variant="translation-en").metadata_lines == [present.ENGLISH_NOTICE, present.AUSTRIAN_NOTICE]
    assert _preview(spark, False, jurisdiction="EU", language="deu", celex="32016R0679").metadata_lines == ["Amtliche EU-Sprachfassung: Deutsch.", "CELEX: 32016R0679."]
    assert _preview(spark, False, jurisdiction="EU", language="xxx", celex="").metadata_lines == []
    assert _preview(spark, jurisdiction="NL", law_title=" ").metadata_lines[0] == "Quelle: P, § 5, abgerufen am 2024-01-02."


def _ordered(spark, rows, **how):
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, locale string, label string, code string")
    return [(r.code, r.label) for r in sorted(ordering.positions(df, ["g"], **how).collect(), key=lambda r: (r.locale or "", r.position))]


def test_order_by_locale(spark):
    labels = [("Zon", "Z"), ("Öst", "A"), ("Est", "E"), ("ost", "O"), ("Union", "EU")]
    assert [c for c, _ in _ordered(spark, [("sv", *x) for x in labels])] == ["EU", "E", "O", "Z", "A"]
    assert [c for c, _ in _ordered(spark, [("de-AT", *x) for x in labels])] == ["EU", "E", "A", "O", "Z"]  # one base letter, so by code
    both = _ordered(spark, [(loc, *x) for loc in ("de", "sv") for x in labels])
    assert [c for c, _ in both] == ["EU", "E", "A", "O", "Z", "EU", "E", "O", "Z", "A"]


def test_order_edges(spark):
    assert _ordered(spark, [(None, "b", "B"), (None, None, "N"), (None, "A", "Y"), (None, "a", None)]) == [(None, "a"), ("Y", "A"), ("B", "b"), ("N", None)]
    assert _ordered(spark, []) == []
    assert [c for c, _ in _ordered(spark, [("tlh", "b", "B"), ("tlh", "a", "A")], locales=("en", "de"))] == ["A", "B"]
