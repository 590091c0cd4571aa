"""Dutch law: answers of the search service, and articles of a law's state, read in their rows as arrays of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sections import section_row
from ..functions.text import let
from ..operators.hops import CONTRACT, NOT_FOUND, OK, asked_once, decide, fetch
from ..operators.tables import stored
from . import nodes as N
from .boe import day_of
from .discovery import BWB_ID, MOST

KEYS = ["ref_id"]
SEARCH = "https://zoekservice.overheid.nl/sru/Search"
#: The fields of a record, and the forms of a state's name and address.
FIELDS = ("identifier", "title", "toestand", "locatie_toestand", "geldigheidsperiode_startdatum", "geldigheidsperiode_einddatum", "zichtperiode_startdatum", "zichtperiode_einddatum")
_STATE = rf"\Ahttps?://wetten\.overheid\.nl/id/({BWB_ID})/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/([0-9]+)\z"
_PLACE = rf"\Ahttps://repository\.officiele-overheidspublicaties\.nl/bwb/({BWB_ID})/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})_([0-9]+)/xml/\1_\2_\3\.xml\z"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def read_states(answers: DataFrame) -> DataFrame:
    """ref_id, records (how many), status (`results`, `no-results`, `malformed`), found: of a good answer number, title, state,
    place, the first of each number, eight at most. An answer is read in its row.

    answers: ref_id, day (yyyy-mm-dd), wanted (the law that was asked for, null for a search by title), xml. Every
    record has each field once, a state whose name and address agree, and both its intervals hold the day; one that
    hasn't, or two of a number that differ, make the whole answer malformed.
    """
    nodes = N.whole(answers.select(*KEYS, "day", "wanted", "xml"), "xml", levels=0)
    local = lambda x: N.local_name(x["name"])
    part = lambda c, p, i: F.regexp_extract(c, p, i)

    def fields(x: Column) -> Column:
        """Each field's text, if the record has it once."""
        own = F.filter(N.inside(x), lambda y: local(y).isin(*FIELDS))
        one = lambda c, n: let(F.filter(c, lambda y: local(y) == n), lambda f: F.when(F.size(f) == 1, _plain(F.coalesce(F.get(f, F.lit(0))["text"], F.lit("")))))
        return let(own, lambda c: F.struct(*[one(c, n).alias(n) for n in FIELDS]))

    def record(r: Column) -> Column:
        state, place = r["toestand"], r["locatie_toestand"]
        good = r["identifier"].rlike(rf"\A{BWB_ID}\z") & (r["title"] != "") & state.rlike(_STATE) & place.rlike(_PLACE) & (part(state, _STATE, 1) == r["identifier"]) & (F.col("wanted").isNull() | (F.col("wanted") == r["identifier"]))
        for i in (1, 2, 3):
            good = good & (part(state, _STATE, i) == part(place, _PLACE, i))
        for n in FIELDS[4:]:
            good = good & day_of(r[n]).isNotNull() & r[n].rlike("-")
        good = good & F.col("day").between(r[FIELDS[4]], r[FIELDS[5]]) & F.col("day").between(r[FIELDS[6]], r[FIELDS[7]])
        return F.struct(F.coalesce(good, F.lit(False)).alias("good"), F.struct(r["identifier"].alias("number"), r["title"].alias("title"), state.alias("state"), place.alias("place")).alias("x"))

    rows = nodes.select(
        *KEYS, "wanted", "day", F.transform(F.filter("nodes", lambda x: local(x) == "record"), fields).alias("fields"),
        N.local_name(F.get("nodes", F.lit(0))["name"]).alias("root"), F.filter("nodes", lambda x: local(x) == "numberOfRecords").alias("numbers"),
    )
    rows = rows.withColumn("all", F.transform("fields", record)).withColumn("found", F.array_distinct(F.transform("all", lambda r: r["x"])))
    told = F.trim(F.get("numbers", F.lit(0))["text"])
    framed = (F.col("root") == "searchRetrieveResponse") & (F.size("numbers") == 1) & told.rlike(r"\A[0-9]+\z")
    torn = F.size("found") > F.size(F.array_distinct(F.transform("found", lambda x: x["number"])))
    right = framed & F.forall("all", lambda r: r["good"]) & ~torn & ((F.size("all") > 0) | told.rlike(r"\A0+\z"))
    status = F.when(~F.coalesce(right, F.lit(False)), "malformed").when(F.size("all") == 0, "no-results").otherwise("results")
    out = rows.select(*KEYS, F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("records"), status.alias("status"), "found")
    return out.withColumn("found", F.when(F.col("status") == "results", F.slice("found", 1, MOST)))


def states(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What read_states says, and the records of good answers one by one: ref_id, position, number, title, state, place."""
    read = read_states(answers)
    return read.drop("found"), read.select(*KEYS, F.posexplode("found").alias("position", "x")).select(*KEYS, (F.col("position") + 1).alias("position"), "x.*")


def articles(documents: DataFrame) -> DataFrame:
    """ref_id, right (whether the document is the state of the law that was asked for, in Dutch), n (articles with the
    label), text (null where there isn't just one, or it has none). A document is read in its row.

    documents: ref_id, number, version, label, xml. The text of a line is what stands in it directly, then what stands
    in its parts, in their order.
    """
    nodes = N.whole(documents.select(*KEYS, "number", "version", "label", "xml"), "xml", ("label", "xml:lang", "lang", "bwb-id", "bwb-ng-vast-deel"), levels=0)
    local = lambda x: N.local_name(x["name"])
    langs = F.filter(F.transform(F.filter("nodes", lambda x: local(x) == "wetgeving"), lambda x: F.coalesce(x["@xml:lang"], x["@lang"])), lambda v: v.isNotNull())
    rows = nodes.withColumns({"root": F.get("nodes", F.lit(0)), "langs": langs, "found": F.filter("nodes", lambda x: (local(x) == "artikel") & (x["@label"] == F.col("label")))})
    words = lambda line: F.filter(F.transform(F.slice("nodes", line["at"], line["size"] + 1), lambda x: x["text"]), lambda t: t.isNotNull())
    lines = F.transform(F.filter(N.inside(F.col("article")), lambda x: local(x) == "al"), words)
    text = F.trim(F.array_join(F.transform(F.filter(lines, lambda w: F.size(w) > 0), lambda w: _plain(F.array_join(w, " "))), "\n"))
    rows = rows.withColumn("article", F.when(F.size("found") == 1, F.get("found", F.lit(0)))).withColumn("text", text)
    right = (N.local_name(F.col("root.name")) == "toestand") & (F.col("root.@bwb-id") == F.col("number")) & (F.col("root.@bwb-ng-vast-deel") == F.col("version")) & (F.col("langs") == F.array(F.lit("nl")))
    return rows.select(*KEYS, F.coalesce(right, F.lit(False)).alias("right"), F.coalesce(F.size("found"), F.lit(0)).alias("n"), F.nullif(F.col("text"), F.lit("")).alias("text"))


def search_request(code: Column, day: Column) -> Column:
    query = F.concat(F.lit("(identifier="), code, F.lit(" and geldigheidsdatum="), day, F.lit(" and zichtdatum="), day, F.lit(")"))
    return F.concat(F.lit(f"{SEARCH}?operation=searchRetrieve&version=2.0&x-connection=BWB&query="), F.url_encode(query), F.lit("&maximumRecords=8"))


def bwb_sections(refs: DataFrame, payloads: DataFrame, day: Column, retrieved_at: Column) -> DataFrame:
    """ref_id, status, section_row (of SECTION): the article of the state of a law that is in force on the day.

    refs: ref_id, law_code, section. payloads: request, status, body. Several states, a bad answer or another document
    are `contract`; no state, and no or several articles of the number, `not-found`.
    """

    def chain(rows: DataFrame) -> DataFrame:
        code, section = F.upper("law_code"), F.col("section")
        known = code.rlike(rf"\A{BWB_ID}\z") & section.rlike(r"\A[0-9]+(?:[:.][0-9]+|[A-Za-z])?\z")
        rows = decide(rows.withColumn("_code", code), F.when(~F.coalesce(known, F.lit(False)), NOT_FOUND))
        rows = stored(fetch(rows, payloads, search_request(F.col("_code"), day), "_search"), "searched")
        read = read_states(rows.where("verdict is null").select("ref_id", day.alias("day"), F.col("_code").alias("wanted"), F.col("_search").alias("xml")))
        state = F.array_min(F.transform("found", lambda x: F.struct(x["state"], x["place"], x["title"])))
        rows = rows.drop("_search").join(read.select("ref_id", F.col("status").alias("_told"), F.col("records").alias("_n"), state.alias("_s")), "ref_id", "left")
        rows = decide(rows, F.when((F.col("_told") == "malformed") | (F.col("_n") > 1), CONTRACT).when(F.col("_n") == 0, NOT_FOUND))
        rows = stored(fetch(rows, payloads, F.col("_s.place"), "_state"), "fetched")
        shown = F.when(section.rlike("[A-Z]\\z"), F.lower(section)).otherwise(section)
        asked = rows.where("verdict is null").select("ref_id", F.col("_code").alias("number"), F.col("_s.state").alias("version"), F.concat(F.lit("Artikel "), shown).alias("label"), F.col("_state").alias("xml"))
        rows = rows.drop("_state").join(articles(asked), "ref_id", "left")
        rows = decide(rows, F.when(~F.col("right"), CONTRACT).when(F.col("n") != 1, NOT_FOUND).when(F.col("text").isNull(), CONTRACT))
        made = section_row("bwb", source_url=F.col("_s.place"), law_code=F.col("_code"), law_title=F.col("_s.title"), section=shown, reference_type=F.lit("article"), jurisdiction=F.lit("NL"), language=F.lit("nl"), text=F.col("text"), retrieved_at=retrieved_at)
        return rows.select("ref_id", F.coalesce("verdict", F.lit(OK)).alias("status"), F.when(F.col("verdict").isNull(), made).alias("section_row"))

    return asked_once(refs, ["law_code", "section"], chain)
