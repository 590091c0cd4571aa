"""Sections of Austrian and German law: one request each, or a second one where there is no English translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import element_by_class, html_text
from ..functions.languages import source_variant
from ..functions.laws import section_url
from ..functions.lines import ris_english, ris_heading, ris_text, translated_part, translation_lines
from ..functions.sections import section_row
from ..functions.text import let
from ..operators.hops import NOT_FOUND, OK, asked_once, decide, fetch

_ASKED = ["law_code", "section", "subsection", "reference_type", "variant"]


def _addressed(rows: DataFrame, catalog: DataFrame, jurisdiction: str) -> DataFrame:
    """rows with url, and what the catalog says of the law: display_code, title, law_kind."""
    own = catalog.where(F.col("jurisdiction") == jurisdiction).select(F.upper("law_code").alias("_code"), "display_code", "title", F.col("reference_type").alias("law_kind"))
    found = section_url(rows.withColumn("jurisdiction", F.lit(jurisdiction)), catalog).drop("jurisdiction")
    return found.withColumn("_code", F.upper("law_code")).join(own, "_code", "left").drop("_code")


def _ended(rows: DataFrame, made: Column) -> DataFrame:
    return rows.select("ref_id", F.coalesce("verdict", F.lit(OK)).alias("status"), F.when(F.col("verdict").isNull(), made).alias("section_row"))


def ris_sections(refs: DataFrame, payloads: DataFrame, catalog: DataFrame, retrieved_at: Column) -> DataFrame:
    """ref_id, status, section_row (of SECTION): Austrian law.

    refs: ref_id, law_code, section, subsection, reference_type, variant. payloads: request, status, body. English is
    there for the constitution alone; a page of it without the article is `not-found`. What a German page holds is
    taken as it is: whether it is the section's isn't checked, as the source's pages don't tell.
    """

    def chain(rows: DataFrame) -> DataFrame:
        rows = _addressed(rows, catalog, "AT")
        rows = fetch(rows, payloads, F.col("url"), "_page")
        english = F.coalesce(F.col("variant") == "translation-en", F.lit(False))
        rows = rows.withColumn("_english", ris_english(F.when(english, F.col("_page")), F.col("section")))
        rows = decide(rows, F.when(english & (F.col("_english.text") == ""), NOT_FOUND))
        german = F.when(~english, F.col("_page"))
        rows = rows.withColumns({"_heading": F.when(english, F.col("_english.heading")).otherwise(ris_heading(german)), "_text": F.when(english, F.col("_english.text")).otherwise(ris_text(german))})
        made = section_row(
            "ris", source_url=F.col("url"), law_code=F.col("display_code"), law_title=F.col("title"), section=F.col("section"), reference_type=F.col("law_kind"), source_variant=source_variant(F.col("variant")), jurisdiction=F.lit("AT"),
            heading=F.col("_heading"), text=F.col("_text"), retrieved_at=retrieved_at,
        )
        return _ended(rows, made)

    return asked_once(refs, _ASKED, chain)


def norm_of_article(page: Column, article: Column) -> Column:
    """Of a page with many norms the one whose heading, or its first span, is `Art` and the number; null if none is."""
    opening = r"(?is)(?=<[\w:-]+\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?jnnorm[\s\"'])"
    plain = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), "&nbsp;| ", " "), r"\s+", " ")))

    def title(chunk: Column) -> Column:
        head = F.regexp_extract(chunk, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1)
        span = r"(?is)<span\b[^>]*>(.*?)</span>"
        return let(head, lambda h: plain(F.when(h.rlike(span), F.regexp_extract(h, span, 1)).otherwise(h)))

    norms = F.filter(F.transform(F.split(page, opening), lambda c: element_by_class(c, "jnnorm")), lambda n: n.isNotNull())
    return F.try_element_at(F.filter(norms, lambda n: title(n) == F.concat(F.lit("art "), F.lower(F.trim(article)))), F.lit(1))


def _gii(rows: DataFrame, payloads: DataFrame, catalog: DataFrame, variant: str) -> DataFrame:
    """rows with what the page in one variant gives: verdict, and source_url, heading, text."""
    names = rows.columns
    rows = _addressed(rows.drop("source_url", "heading", "text").withColumn("variant", F.lit(variant)), catalog, "DE")
    rows = fetch(rows, payloads, F.col("url"), "_page")
    page = F.col("_page")
    if variant == "translation-en":
        lines = translation_lines(page)
        part = F.when(F.col("law_kind") == "article", translated_part(lines, F.col("section"), True)).otherwise(translated_part(lines, F.col("section"), False))
        rows = rows.withColumn("_part", part).withColumns({"heading": F.col("_part.heading"), "text": F.col("_part.text"), "_there": F.col("_part").isNotNull()})
    else:
        pure = (F.upper("law_code") == "EGBGB") & (F.col("reference_type") == "article") & (F.coalesce(F.trim("subsection"), F.lit("")) == "")
        rows = rows.withColumn("_norm", F.when(F.coalesce(pure, F.lit(False)), norm_of_article(page, F.col("section"))).otherwise(page))
        entitled = r"(?is)<span\b[^>]*class=[\"']jnentitel[\"'][^>]*>(.*?)</span>"
        heading = F.when(F.col("_norm").rlike(entitled), html_text(F.concat(F.lit("<body>"), F.regexp_extract("_norm", entitled, 1), F.lit("</body>")), "gii"))
        rows = rows.withColumns({"heading": heading, "text": html_text(F.col("_norm"), "gii"), "_there": F.col("_norm").isNotNull()})
    rows = decide(rows, F.when(~F.col("_there"), NOT_FOUND))
    return rows.withColumn("source_url", F.col("url")).select(*names, "display_code", "title", "law_kind")


def gii_sections(refs: DataFrame, payloads: DataFrame, catalog: DataFrame, retrieved_at: Column) -> DataFrame:
    """ref_id, status, section_row (of SECTION): German law.

    refs and payloads as for ris_sections. English that has no address, no page or not this part falls back to the
    German page; an answer that failed ends the lookup.
    """

    def chain(rows: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        rows = rows.withColumns({"_asked": source_variant(F.col("variant")), "source_url": none, "heading": none, "text": none})
        english = _gii(rows.where(F.col("_asked") == "translation-en"), payloads, catalog, "translation-en")
        again = english.where(F.col("verdict") == NOT_FOUND).withColumn("verdict", none)
        german = _gii(rows.where(F.col("_asked") != "translation-en").unionByName(again.select(*rows.columns)), payloads, catalog, "official-de")
        out = english.where(~F.coalesce(F.col("verdict") == NOT_FOUND, F.lit(False))).withColumn("_used", F.lit("translation-en")).unionByName(german.withColumn("_used", F.lit("official-de")))
        made = section_row(
            "gesetze-im-internet", source_url=F.col("source_url"), law_code=F.col("display_code"), law_title=F.col("title"), section=F.col("section"), reference_type=F.coalesce("reference_type", F.lit("section")), source_variant=F.col("_used"),
            subsection=F.col("subsection"), heading=F.col("heading"), text=F.col("text"), retrieved_at=retrieved_at,
        )
        return _ended(out, made)

    return asked_once(refs, _ASKED, chain)
