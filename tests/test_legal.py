"""Catalogs, index, answers of sources: what has to be rejected, and what is left of it."""

import json

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import citations, extract, laws, references
from lexquarry.operators import acts, index, resolve
from lexquarry.plans import legal
from lexquarry.sources import discovery


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_references(spark):
    names = {"amp": "&", "uuml": "ü"}
    cases = {"&uuml;&#252;&#xFC;": "üüü", "&amp;lt;": "&lt;", "&nope; & &#55296; &#1114112; &#x110000;": "&nope; & &#55296; &#1114112; &#x110000;", "&#128512;": "\U0001f600", "&#00000065;": "A", "": "", "&Uuml;": "&Uuml;"}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", references.decoded(F.col("t"), names).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases | {None: None}


def test_norm_blocks(spark):
    page = "<body><p>menu</p><div class='jnhtml'><div class=\"jurAbsatz\">a <div>b</div></div><div class='jurAbsatz'>c</div></div></body>"
    rows = spark.createDataFrame([(0, page), (1, "<body>no norm</body>"), (2, None), (3, "plain jnhtml")], "i int, t string")
    got = rows.select("i", extract.html_text(F.col("t"), "gii").alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["a b\nc", "no norm", None, "plain jnhtml"]


def test_alias_of_two_acts_is_none(spark):
    table = spark.createDataFrame([("A", ["x", "y"]), ("B", ["Y "])], "canonical string, aliases array<string>")
    refs = spark.createDataFrame([(1, "X"), (2, "y"), (3, "z"), (4, None)], "canonical int, a string")
    got = sorted(map(tuple, resolve.resolve_alias(refs.withColumnRenamed("canonical", "i"), "a", table).collect()))
    assert got == [(1, "X", "A", True), (2, "y", None, False), (3, "z", "Z", False), (4, None, None, False)]


def test_a_literal_jurisdiction_plans_the_same(spark):
    texts = ["Art. 5 CELEX 32016R0679", "Art. 6 GDPR", "GDPR Art. 7", "Article 6 Regulation (EU) 2016/679", "§ 5 BGB", "Art. 1 GG", "", None, "32016R0679 § 3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    literal = citations.parse_citations(rows, "t", "EU", "r").collect()
    assert [r.r for r in literal] == [r.r for r in citations.parse_citations(rows, "t", F.lit("EU"), "r").collect()]


def test_stored_index(spark):
    entry = {"celex": "32016R0679", "documentType": "R", "year": "2016", "number": "0679", "titlesByLanguage": {"eng": "t"}, "availableLanguages": ["eng"]}
    whole = {"schemaVersion": 1, "lastSyncCheckpoint": None, "generatedAt": "x", "entries": [entry]}
    cases = [
        (whole, "ok"), (whole | {"schemaVersion": 2}, "version"), (whole | {"entries": [entry, entry]}, "duplicate"), (whole | {"lastSyncCheckpoint": "2024-01-01"}, "checkpoint"), (whole | {"lastSyncCheckpoint": "2024-01-01T00:00:00Z"}, "ok"),
        (whole | {"entries": [entry | {"titlesByLanguage": {"en": "t"}}]}, "entry-title-language"), (whole | {"entries": [entry | {"year": "2017"}]}, "entry-year"), (whole | {"entries": []}, "ok"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(len(cases), None)], "i int, raw string")
    got = {r.i: r.status for r in acts.parse_stored(rows, "raw", "i").collect()}
    assert got == dict(enumerate([s for _, s in cases])) | {len(cases): "malformed"}


def test_rebuild_refuses(spark):
    pages = lambda *c: spark.createDataFrame([(1, i, *x) for i, x in enumerate(c)], "run int, page int, work_id string, work string")
    records = spark.createDataFrame([(0, "32016R0679", {"eng": "a"}, ["eng"]), (1, "32016R0679", {"eng": "b"}, ["deu", "eng", "deu"])], "page int, celex string, titles map<string,string>, languages array<string>")
    good = pages(("a", "u"), ("b", "u"))
    got = acts.rebuilt(records, good).collect()
    assert [(r.celex, r.titles, r.languages) for r in got] == [("32016R0679", {"eng": "b"}, ["deu", "eng"])]
    for bad, rows in ((pages(("b", "u"), ("a", "u")), records), (pages(("a", None)), records), (good, records.limit(0))):
        with pytest.raises(ValueError):
            acts.rebuilt(rows, bad).collect()
    with pytest.raises(ValueError):
        acts.rebuilt(records, good, max_pages=2)


def test_a_changed_candidate_is_not_activated(spark, tmp_path):
    store = index.SlotStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "x")], "k int, v string")
    store.write_candidate(rows)
    store.activate()
    slot = store.write_candidate(spark.createDataFrame([(2, "y")], "k int, v string"))
    rows.write.mode("overwrite").parquet(f"{tmp_path}/{slot}")
    with pytest.raises(ValueError):
        store.activate()
    assert [tuple(r) for r in store.read().collect()] == [(1, "x")]
    store.discard()
    with pytest.raises(ValueError):
        store.activate()


def test_search_answers(spark):
    good = {"identificador": "boe-a-2000-1", "titulo": "t", "url_html_consolidada": "https://www.boe.es/buscar/act.php?id=BOE-A-2000-1"}
    answer = lambda data, code="200": json.dumps({"status": {"code": code}, "data": data})
    cases = [(answer([good, good]), "results", 1), (answer(""), "no-results", 0), (answer({}), "no-results", 0), (answer([good], "500"), "malformed", None), (answer([good | {"titulo": " "}]), "malformed", None), ("{", "malformed", None), (None, "malformed", None), (answer([good | {"url_html_consolidada": good["url_html_consolidada"] + "&x=1"}]), "malformed", None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = rows.select("i", discovery.boe_search(F.col("t")).alias("x")).orderBy("i").collect()
    assert [(r.x.status, None if r.x.entries is None else len(r.x.entries)) for r in got] == [c[1:] for c in cases]


def test_catalog_order(spark):
    got = [r.display_code for r in laws.supported_laws(laws.laws(spark)).where("jurisdiction = 'AT'").orderBy("position").collect()]
    assert got[:3] == ["ABGB", "AktG", "AVG"]  # by letters, not by capitals


def test_numbers_of_parts_meet_the_index(spark):
    got = legal.entry_by_celex(spark, "/root/testdata/sf0.001")
    assert got.where("title is not null").count() > 0
