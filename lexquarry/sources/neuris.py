"""Sections of German federal law from a search, the law's outline and the section's page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import html_text
from ..functions.sections import section_row
from ..operators.hops import NOT_FOUND, OK, UNAVAILABLE, asked_once, decide, fetch
from ..operators.resolve import exact_abbreviation
from ..operators.tables import stored
from ..operators.temporal import coverage

BASE = "https://testphase.rechtsinformationen.bund.de"
_PART = "struct<name:string,eId:string,headline:string,temporalCoverage:string>"
_EXPRESSION = "struct<name:string,abbreviation:string,temporalCoverage:string,encoding:array<struct<encodingFormat:string,contentUrl:string>>>"


def search_request(code: Column) -> Column:
    return F.concat(F.lit(f"{BASE}/v1/legislation?searchTerm="), F.url_encode(code), F.lit("&size=10&pageIndex=0"))


def outline(laws: DataFrame) -> DataFrame:
    """ref_id, place, name, part (the fields of a part): all parts below a law, at any depth.

    laws: ref_id, body (JSON with hasPart, whose elements have hasPart again). place has the ordinals from the top, so
    that places in their order are the outline's, parents first. One step a level, over all laws at once.
    """
    level = laws.select("ref_id", F.array().cast("array<int>").alias("place"), F.try_parse_json("body").alias("node"))
    found = None
    while True:
        parts = level.select("ref_id", "place", F.posexplode(F.try_variant_get("node", "$.hasPart", "array<variant>")).alias("at", "node"))
        parts = parts.select("ref_id", F.concat("place", F.array("at")).alias("place"), F.to_json("node").alias("json"))
        parts = stored(parts, "outline")
        if not parts.take(1):
            break
        found = parts if found is None else found.unionByName(parts)
        level = parts.select("ref_id", "place", F.try_parse_json("json").alias("node"))
    found = parts if found is None else found
    return found.select("ref_id", "place", F.from_json("json", _PART).alias("part")).select("ref_id", "place", "part.name", "part")


def first_part(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """ref_id, part: of each law the first part, in the outline's order, that has the name. wanted: ref_id, name."""
    return parts.join(wanted, ["ref_id", "name"]).groupBy("ref_id").agg(F.min_by("part", "place").alias("part"))


def neuris_sections(refs: DataFrame, payloads: DataFrame, retrieved_at: Column) -> DataFrame:
    """ref_id, status, section_row (of SECTION).

    refs: ref_id, law_code, section, variant. payloads: request, status, body. No law with just this abbreviation, no
    such section, no page of it or English is `not-found`; any answer that failed, or is no JSON, `unavailable`.
    """

    def chain(rows: DataFrame) -> DataFrame:
        rows = decide(rows, F.when(F.col("variant") == "translation-en", NOT_FOUND))
        rows = fetch(rows, payloads, search_request(F.col("law_code")), "_search", absent=UNAVAILABLE)
        members = F.try_variant_get(F.try_parse_json("_search"), "$.member", "array<variant>")
        rows = stored(decide(rows, F.when(F.col("verdict").isNull() & members.isNull(), UNAVAILABLE)), "searched")
        each = rows.where("verdict is null").select("ref_id", F.posexplode(members).alias("ordinal", "m"))
        results = each.select("ref_id", "ordinal", F.try_variant_get("m", "$.item.abbreviation", "string").alias("abbreviation"), F.try_variant_get("m", "$.item['@id']", "string").alias("address"))
        chosen = exact_abbreviation(rows.select("ref_id", "law_code"), "law_code", results).select("ref_id", "address")
        rows = rows.drop("_search").join(chosen, "ref_id", "left")
        rows = stored(fetch(rows, payloads, F.concat(F.lit(BASE), "address"), "_law", absent=UNAVAILABLE), "laws")
        name = F.concat(F.lit("§ "), "section")
        open_ = rows.where("verdict is null")
        found = first_part(outline(open_.select("ref_id", F.col("_law").alias("body"))), open_.select("ref_id", name.alias("name")))
        rows = rows.join(found, "ref_id", "left").withColumn("_expression", F.from_json("_law", _EXPRESSION))
        pages = F.filter("_expression.encoding", lambda e: (e["encodingFormat"] == "text/html") & e["contentUrl"].endswith(".html"))
        page = F.concat(F.lit(BASE), F.regexp_replace(F.try_element_at(pages, F.lit(1))["contentUrl"], r"[.]html\z", ""), F.lit("/"), F.nullif(F.col("part.eId"), F.lit("")), F.lit(".html"))
        rows = rows.withColumn("_url", page)
        rows = fetch(decide(rows, F.when(F.col("part").isNull(), NOT_FOUND)), payloads, F.col("_url"), "_page", absent=UNAVAILABLE)
        times = coverage(F.coalesce("part.temporalCoverage", "_expression.temporalCoverage"))
        made = section_row(
            "neuris", source_url=F.col("_url"), law_code=F.coalesce("_expression.abbreviation", "law_code"), law_title=F.col("_expression.name"), section=F.col("section"), heading=F.col("part.headline"), text=html_text(F.col("_page"), "neuris"), retrieved_at=retrieved_at,
            valid_from=times["from"], valid_to=times["to"],
        )
        return rows.select("ref_id", F.coalesce("verdict", F.lit(OK)).alias("status"), F.when(F.col("verdict").isNull(), made).alias("section_row"))

    return asked_once(refs, ["law_code", "section", "variant"], chain)
