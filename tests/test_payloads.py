import datetime as dt
import json

from pyspark.sql import functions as F

from lexquarry.operators import lookup
from lexquarry.sources import payloads

AKN = """<akomaNtoso xmlns="x"><act><meta><FRBRWork><FRBRuri value="/akn/fi/act/statute-consolidated/1889/39"/><FRBRcountry value="fi"/><FRBRsubtype value="statute-consolidated"/><FRBRnumber value="39"/><FRBRauthoritative value="%s"/></FRBRWork>
<FRBRExpression><FRBRuri value="/akn/fi/act/statute-consolidated/1889/39/fin@"/><FRBRlanguage language="fin"/></FRBRExpression></meta><preface><docTitle>Rikos<b>laki</b></docTitle></preface>
<body><section><num>4 §</num><p>Eka <i>toka</i> kolmas</p></section><section><num>5 §</num><p>a</p></section><section><num>5 §</num><p>b</p></section></body></act></akomaNtoso>"""


def results(spark, column, rows, schema):
    return [(r.s, r.t) for r in spark.createDataFrame(rows, schema).select(column.alias("x")).select(F.col("x.status").alias("s"), F.col("x.text").alias("t")).collect()]


def test_finlex(spark):
    good = AKN % "false"
    rows = [(good, "39/1889", "4", None), (good, "39/1889", "5", "fin"), (good, "40/1889", "4", "fin"), (good, "39/1889", "4", "swe"), (AKN % "true", "39/1889", "4", "fin"), (good[:-5], "39/1889", "4", "fin"), ("", "39/1889", "4", "fin"), (None, "39/1889", "4", "fin"), (good, "39/0000", "4", "fin")]
    got = results(spark, payloads.finlex_section(*[F.col(c) for c in "abcd"]), rows, "a string, b string, c string, d string")
    assert got[0] == ("ok", "Eka kolmas toka")
    assert [s for s, _ in got[1:]] == ["not-found", "contract", "contract", "contract", "contract", "contract", "not-found", "not-found"]


def test_bwb(spark):
    xml = '<toestand bwb-id="BWBR0001854" bwb-ng-vast-deel="s1"><wetgeving xml:lang="nl"><artikel label="Artikel 3a"><al>Een</al><al>Twee</al></artikel></wetgeving></toestand>'
    rows = [(xml, "BWBR0001854", "s1", "3A"), (xml, "BWBR0001854", "s2", "3a"), (xml, "BWBR0001854", "s1", "4"), (xml.replace("nl", "fr"), "BWBR0001854", "s1", "3a")]
    got = results(spark, payloads.bwb_article(*[F.col(c) for c in "abcd"]), rows, "a string, b string, c string, d string")
    assert got == [("ok", "Een\nTwee"), ("contract", None), ("not-found", None), ("contract", None)]


def test_normattiva(spark):
    def payload(**changes):
        act = {"titolo": "LEGGE", "annoGU": 1990, "meseGU": 8, "giornoGU": 7, "articoloDataInizioVigenza": "19900801", "articoloDataFineVigenza": "99999999", "articoloHtml": '<h2 class="article-num-akn" id="art_3">Art. 3</h2><p>Testo</p>'}
        return json.dumps({"data": {"atto": act | changes}})

    rows = [payload(), payload(titolo="ALTRA"), payload(articoloDataFineVigenza="20000101"), payload(articoloDataFineVigenza="20000230"), payload(articoloHtml="<p>x</p>"), "{"]
    got = results(spark, payloads.normattiva_article(F.col("p"), F.lit("1990-08-07"), F.lit("090G0294"), F.lit("LEGGE"), F.lit(3), F.lit("2020-01-01")), [(r,) for r in rows], "p string")
    assert [s for s, _ in got] == ["ok", "contract", "contract", "contract", "contract", "contract"]


def test_parts_elements_and_hits(spark):
    tree = json.dumps({"name": "x", "hasPart": [{"name": "Buch", "hasPart": [{"name": "§ 1", "text": "eins"}]}, {"name": "§ 1", "text": "zwei"}]})
    assert results(spark, payloads.neuris_part(F.col("p"), F.col("n")), [(tree, "§ 1"), (tree, "§ 2"), ("[", "§ 1")], "p string, n string") == [("ok", "eins"), ("not-found", None), ("contract", None)]
    page = '<div id="art_1"><div>a</div>b</div><div id="art_2"><div>'
    assert results(spark, payloads.eurlex_element(F.col("p"), F.col("n")), [(page, "1"), (page, "2"), (page, "3")], "p string, n string") == [("ok", "<div>a</div>b"), ("contract", None), ("not-found", None)]
    hits = json.dumps({"hits": {"hits": [{"inner_hits": {"frContent": {"hits": {"hits": [{"_source": {"id": "art_1", "title": "t", "content": "c"}}]}}}}]}})
    df = spark.createDataFrame([(hits, "fr"), (hits, "de"), (hits, "en"), ("x", "fr"), (None, None)], "p string, l string").select(payloads.fedlex_article(F.col("p"), F.col("l")).alias("x"))
    assert [r.x and r.x.content for r in df.collect()] == ["c", None, None, None, None]
    assert spark.createDataFrame([("321A",), ("5",)], "s string").select(payloads.fedlex_article_id(F.col("s"))).collect()[0][0] == "art_321_a"


def test_lookup_order(spark):
    refs = spark.createDataFrame([(1, "DE", ["a"]), (2, "DE", ["x", "b"]), (3, "IT", ["a"]), (4, "DE", ["old"]), (5, "DE", ["a"]), (6, None, ["bad"])], "ref_id int, jurisdiction string, keys array<string>")
    live = spark.createDataFrame([(1, 2, "ris", "ok", "second"), (1, 1, "neuris", "ok", "first"), (2, 1, "neuris", "not-found", None), (5, 1, "neuris", "unavailable", None), (5, 2, "ris", "ok", "late")], "ref_id int, priority int, provider string, status string, text string")
    cache = spark.createDataFrame([("a", "neuris", "2024-01-01T00:00:00Z", "A"), ("b", "fedlex", "2024-01-09T00:00:00Z", "B"), ("old", "ris", "2023-01-01T00:00:00Z", "O"), ("bad", "bwb", "2024-01-09T00:00:00Z", "N")], "key string, provider string, retrieved_at string, text string")
    got = {r.ref_id: (r.status, r.text) for r in lookup.look_up(refs, live, cache, F.lit(dt.datetime(2024, 1, 10)), 7).collect()}
    assert got == {1: ("live", "first"), 2: ("cached", "B"), 3: ("not-found", None), 4: ("not-found", None), 5: ("unavailable", None), 6: ("not-found", None)}
