"""Records of European acts: identifier notices and RDF descriptions of works, in their rows as arrays of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import nodes as N

#: Namespaces, and forms of addresses.
CDM, OWL, PURL = "http://publications.europa.eu/ontology/cdm#", "http://www.w3.org/2002/07/owl#", "http://purl.org/dc/elements/1.1/"
RESOURCE = "publications.europa.eu/resource/"
_UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_FIELDS = ("TYPE", "IDENTIFIER", "VALUE")
_PLACES = ("/NOTICE/URI", "/NOTICE/SAMEAS/URI")


def notice_uuids(notices: DataFrame) -> DataFrame:
    """ref_id, uuid: the number of the work that an identifier notice of the act names; null if it isn't such a notice.

    notices: ref_id, celex, notice (XML). The notice lists addresses, alone or as the same as another, and nothing
    else: each has one type, identifier and value. One of them, and only one, is the act's CELEX address, and one is
    the work's, whose number is its identifier.
    """
    nodes = N.whole(notices.select("ref_id", "celex", "notice"), "notice", ("type", "embargo-date"), leaves=True)
    fields = [f"{p}/{f}" for p in _PLACES for f in _FIELDS]
    bare = lambda x: x["@type"].isNull() & x["@embargo-date"].isNull() & (x["more"] == 0)
    root = lambda x: (x["path"] == "/NOTICE") & (x["@type"] == "identifier") & (x["more"] == 0)
    blank = lambda x: F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\s", "") == ""
    field = lambda x: x["path"].isin(*fields) & x["text"].isNotNull() & bare(x)
    outer = lambda x: (root(x) | (x["path"].isin("/NOTICE/SAMEAS", *_PLACES) & bare(x))) & blank(x)
    fits = F.forall("nodes", lambda x: F.coalesce(x["name"].isNotNull() & (field(x) | outer(x)), F.lit(False)))
    # a SAMEAS holds one address
    single = F.forall(F.filter("nodes", lambda x: x["name"] == "SAMEAS"), lambda x: F.size(F.filter(N.inside(x), lambda y: y["path"] == _PLACES[1])) == 1)

    def block(x: Column) -> Column:
        pick = lambda own, f: N.trimmed(F.get(F.filter(own, lambda y: y["name"] == f), F.lit(0))["text"]).alias(f.lower())
        own = F.filter(N.inside(x), lambda y: y["name"].isin(*_FIELDS))
        return let(own, lambda o: F.struct(*[pick(o, f) for f in _FIELDS], ((F.size(o) == 3) & (F.size(F.array_distinct(F.transform(o, lambda y: y["name"]))) == 3)).alias("whole")))

    rows = nodes.select("ref_id", "celex", (fits & single).alias("fits"), F.transform(F.filter("nodes", lambda x: x["name"] == "URI"), block).alias("blocks"))
    address = lambda b, kind: F.coalesce(b["value"].rlike(rf"\Ahttps?://{RESOURCE}{kind}/[^/]+\z"), F.lit(False))
    celexes = F.filter("blocks", lambda b: (b["type"] == "celex") | address(b, "celex"))
    works = F.filter("blocks", lambda b: (b["type"] == "cellar") | address(b, "cellar"))
    rows = rows.select("ref_id", "celex", (F.col("fits") & F.forall("blocks", lambda b: b["whole"]) & (F.size(celexes) == 1) & (F.size(works) == 1)).alias("fits"), F.get(celexes, F.lit(0)).alias("c"), F.get(works, F.lit(0)).alias("w"))
    c, w = F.col("c"), F.col("w")
    good_celex = address(c, "celex") & (c["type"] == "celex") & (c["identifier"] == F.col("celex")) & (F.regexp_replace(c["value"], r"\Ahttps?://", "") == F.concat(F.lit(f"{RESOURCE}celex/"), "celex"))
    good_work = (w["type"] == "cellar") & address(w, "cellar") & (F.substring_index(w["value"], "/", -1) == w["identifier"]) & w["identifier"].rlike(_UUID)
    return rows.select("ref_id", F.when(F.col("fits") & good_celex & good_work, w["identifier"]).alias("uuid"))


def rdf_works(records: DataFrame) -> DataFrame:
    """ref_id, celex, titles (by three letters of the language), languages (sorted): the works that RDF records describe.

    records: ref_id, celex, rdf. The work is every node that statements of sameness lead to from the act's address (or
    from a node with its number); one of them must have the act's document number, else the record has no row. Its
    languages are those of expressions that belong to it; titles are taken from all nodes, the last of a language.
    """
    nodes = N.whole(records.select("ref_id", "celex", "rdf"), "rdf", ("rdf:about", "rdf:resource", "xml:lang"), namespaces=True)
    act = F.get(F.filter("nodes", lambda x: (N.local_name(x["name"]) == "Description") & x["@rdf:about"].endswith(F.concat(F.lit("/celex/"), "celex"))), F.lit(0))["@rdf:about"]
    work = let(act, lambda a: F.when(a.isNotNull(), let(N.statements("nodes"), lambda said: _work(a, said))))
    # not filtered by what is made of the nodes, which Spark would then make twice
    rows = nodes.select("ref_id", "celex", F.explode_outer(F.array(work)).alias("work")).where(F.col("work").isNotNull())
    return rows.select("ref_id", "celex", "work.titles", "work.languages")


def _work(act: Column, said: Column) -> Column:
    """titles and languages of the work that has the node act, by the statements of its record; null if it isn't it."""
    of = lambda predicate: F.filter(said, lambda s: s["predicate"] == predicate)
    numbered = F.transform(F.filter(of(f"{CDM}id_celex"), lambda s: s["object"] == F.col("celex")), lambda s: s["subject"])
    same = F.filter(of(f"{OWL}sameAs"), lambda s: s["resource"].isNotNull())
    coded = F.filter(F.transform(of(f"{PURL}identifier"), lambda s: F.struct(s["subject"].alias("of"), s["at"].alias("at"), F.lower(s["object"]).alias("x"))), lambda c: c["x"].rlike(r"\A[a-z]{3}\z"))
    titled = F.filter(of(f"{CDM}title"), lambda s: (s["object"] != "") & s["lang"].rlike(r"\A[a-z]{3}\z"))
    titled = F.transform(titled, lambda s: F.struct(s["lang"].alias("of"), s["at"].alias("at"), s["object"].alias("x")))

    def spoken(work: Column) -> Column:
        own = F.transform(F.filter(of(f"{CDM}expression_belongs_to_work"), lambda s: s["resource"].isNotNull() & F.array_contains(work, s["resource"])), lambda s: s["node"])
        uses = let(own, lambda belongs: F.filter(of(f"{CDM}expression_uses_language"), lambda s: F.array_contains(belongs, s["node"])))
        codes = let(_last(coded), lambda known: F.transform(uses, lambda s: F.try_element_at(known, s["resource"])))
        return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())))

    def told(work: Column) -> Column:
        proven = F.exists(of(f"{CDM}work_id_document"), lambda s: (s["object"] == F.concat(F.lit("celex:"), "celex")) & F.array_contains(work, s["subject"]))
        return F.when(proven, F.struct(_last(titled).alias("titles"), spoken(work).alias("languages")))

    return let(_reached(F.array_distinct(F.concat(F.array(act), numbered)), same), told)


def _reached(seeds: Column, same: Column) -> Column:
    """All that statements of sameness lead to, either way, from the seeds. A path has no more steps than there are
    statements; once nothing new is found a step costs nothing."""
    def step(state: Column, statements: Column) -> Column:
        met = lambda here, there: F.transform(F.filter(statements, lambda s: F.array_contains(state["new"], s[here])), lambda s: s[there])
        found = F.array_except(F.concat(met("subject", "resource"), met("resource", "subject")), state["all"])
        return F.when(F.size(state["new"]) == 0, state).otherwise(let(found, lambda new: F.struct(F.concat(state["all"], new).alias("all"), new.alias("new"))))

    return let(same, lambda own: F.aggregate(own, F.struct(seeds.alias("all"), seeds.alias("new")), lambda state, _: step(state, own)))["all"]


def _last(told: Column) -> Column:
    """The map, sorted, from each `of` to the x of the last place."""
    def pick(own: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(own, lambda t: t["of"])))
        latest = lambda name: F.array_max(F.transform(F.filter(own, lambda t: t["of"] == name), lambda t: F.struct(t["at"], t["x"].alias("x"))))["x"]
        return F.map_from_entries(F.transform(names, lambda name: F.struct(name.alias("key"), latest(name).alias("value"))))

    return let(told, pick)
