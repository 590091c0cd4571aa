"""Articles of European acts: an identifier notice, then the page of the work in a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import parse_celex
from ..functions.extract import element_by_class, element_by_id, html_text, without_class
from ..functions.languages import to_cellar
from ..functions.laws import eu_section_url
from ..functions.sections import section_row
from ..operators.hops import LANGUAGE_UNAVAILABLE, NOT_FOUND, OK, asked_once, decide, fetch
from ..operators.tables import stored
from .cellar import RESOURCE, notice_uuids

_ASKED = ["celex", "section", "language", "law_code", "law_title"]


def notice_request(celex: Column) -> Column:
    return F.concat(F.lit(f"https://{RESOURCE}celex/"), celex)


def page_request(uuid: Column, language: Column) -> Column:
    """The address and, behind a blank, the language that is asked for."""
    return F.concat(F.lit(f"https://{RESOURCE}cellar/"), uuid, F.lit(" "), language)


def usable(page: Column) -> Column:
    """Whether it is a page at all, and not one that asks who is there."""
    return page.rlike(r"(?i)<html\b") & page.rlike(r"(?i)<body\b") & ~page.rlike(r"(?i)captcha|access denied|just a moment")


def eurlex_sections(refs: DataFrame, payloads: DataFrame, retrieved_at: Column) -> DataFrame:
    """ref_id, status, and section (a row of SECTION where the status is `ok`).

    refs: ref_id, celex, section, language (two or three letters, null is German), law_code, law_title (what it is
    called if the page has no title). payloads: request, status, body. No such act, page or article is `not-found`;
    a notice without the page in the language `language-unavailable`; other failures are `unavailable`.
    """

    def chain(rows: DataFrame) -> DataFrame:
        act = parse_celex(F.col("celex"))
        rows = rows.withColumn("_language", to_cellar(F.coalesce("language", F.lit("de"))))
        rows = decide(rows, F.when(act.isNull() | F.col("_language").isNull() | ~F.coalesce(F.col("section").rlike(r"\A[0-9]+[A-Za-z]?\z"), F.lit(False)), NOT_FOUND))
        rows = stored(fetch(rows, payloads, notice_request(F.col("celex")), "_notice", successes=(200, 200)), "noticed")
        uuids = notice_uuids(rows.where("verdict is null").select("ref_id", "celex", F.col("_notice").alias("notice")))
        rows = decide(rows.drop("_notice").join(uuids, "ref_id", "left"), F.when(F.col("uuid").isNull(), NOT_FOUND))
        rows = fetch(rows, payloads, page_request(F.col("uuid"), F.col("_language")), "_page", absent=LANGUAGE_UNAVAILABLE, successes=(200, 200))
        rows = decide(rows, F.when(~usable(F.col("_page")), NOT_FOUND))
        article = element_by_id(F.when(F.col("verdict").isNull(), F.col("_page")), F.concat(F.lit("art_"), "section"))
        rows = rows.withColumn("_article", article)
        text = F.col("_article")
        for name in ("oj-ti-art", "oj-sti-art", "oj-art"):
            text = without_class(text, name)
        own = lambda markup: F.nullif(html_text(markup, "eurlex"), F.lit(""))
        rows = rows.withColumns({"_text": own(text), "_heading": own(element_by_class(F.col("_article"), "oj-sti-art")), "_title": F.coalesce(own(element_by_class(F.col("_page"), "oj-doc-ti")), F.nullif(F.col("law_title"), F.lit("")), F.col("law_code"))})
        rows = decide(rows, F.when(F.col("_text").isNull(), NOT_FOUND))
        url = eu_section_url(F.col("celex"), act["document_type"], act["year"], act["number"], F.lit("article"), F.col("_language"))
        made = section_row(
            "eur-lex", source_url=url, law_code=F.col("law_code"), law_title=F.col("_title"), section=F.col("section"), reference_type=F.lit("article"), jurisdiction=F.lit("EU"), language=F.col("language"), heading=F.col("_heading"), text=F.col("_text"),
            retrieved_at=retrieved_at, eu_celex=F.col("celex"), eu_document_type=act["document_type"],
        )
        return rows.select("ref_id", F.coalesce("verdict", F.lit(OK)).alias("status"), F.when(F.col("verdict").isNull(), made).alias("section"))

    return asked_once(refs, _ASKED, chain)
