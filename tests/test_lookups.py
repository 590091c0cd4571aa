"""Lookups in hops, the lines of pages, section rows, the cache, and answers that come too late."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import extract, laws, lines, sections
from lexquarry.operators import hops, index, lookup
from lexquarry.sources import german
from lexquarry.streaming import sync

PAGES = "request string, status int, body string"
REFS = "ref_id int, law_code string, section string, subsection string, reference_type string, variant string"


def _one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_balanced_elements(spark):
    page = '<div><p id="a">1</p><DIV class="x y" id=\'b\'>2<div>3</div><div/>4</DIV>5</div><div id="c">open'
    assert _one(spark, lambda p: extract.element_by_id(p, F.lit("a")), page) == '<p id="a">1</p>'
    assert _one(spark, lambda p: extract.element_by_class(p, "y"), page) == "<DIV class=\"x y\" id='b'>2<div>3</div><div/>4</DIV>"
    assert _one(spark, lambda p: extract.element_by_id(p, F.lit("c")), page) is None
    assert _one(spark, lambda p: extract.element_by_id(p, F.lit(".")), page) is None
    assert _one(spark, lambda p: extract.without_class(p, "y"), page) == '<div><p id="a">1</p>5</div><div id="c">open'
    assert _one(spark, lambda p: extract.without_class(p, "z"), page) == page
    assert _one(spark, lambda p: extract.without_class(p, "z"), None) is None


def test_verdicts_of_a_chain(spark):
    rows = spark.createDataFrame([("ok",), ("none",), ("bad",), ("lost",), (None,), ("ended",)], "r string").withColumn("verdict", F.when(F.col("r") == "ended", "contract"))
    pages = spark.createDataFrame([("ok", 200, "x"), ("none", 404, ""), ("bad", 503, ""), ("ended", 200, "y")], PAGES)
    got = {r.r: (r.verdict, r.page) for r in hops.fetch(rows, pages, F.col("r"), "page", absent="language-unavailable").collect()}
    assert got == {"ok": (None, "x"), "none": ("language-unavailable", None), "bad": ("unavailable", None), "lost": ("unavailable", None), None: ("not-found", None), "ended": ("contract", None)}


def test_a_chain_sees_each_row_once(spark):
    refs = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "a"), (4, "b", "")], "ref_id int, x string, y string")
    seen = []

    def chain(rows):
        seen.append(rows.count())
        return rows.select("ref_id", F.concat_ws("|", "x", "y").alias("z"))

    got = hops.asked_once(refs, ["x", "y"], chain).collect()
    assert seen == [3] and sorted((r.ref_id, r.z) for r in got) == [(1, "a"), (2, "a"), (3, "a"), (4, "b|")]


def test_section_rows(spark):
    r = _one(spark, lambda t: sections.section_row("fedlex", text=t, section=F.lit("1")), "T")
    assert (r.provider_label, r.is_authoritative_text, r.is_official_source, r.text, r.cache_status, r.heading) == ("Fedlex / Bundesrecht der Schweiz", True, True, "T", "live", None)
    assert len(r) == len(sections.SECTION) == 21
    with pytest.raises(ValueError):
        sections.section_row("boe", nonsense=F.lit(1))


def test_routes(spark):
    df = spark.createDataFrame([(j,) for j in ("DE", "EU", None, "DK")], "j string")
    assert [r.x for r in df.select(sections.routes(F.col("j")).alias("x")).collect()] == [["neuris", "gesetze-im-internet"], ["eur-lex"], ["neuris", "gesetze-im-internet"], []]
    assert [r.x for r in df.select(sections.routes(F.col("j"), ("boe", "gesetze-im-internet")).alias("x")).collect()] == [["gesetze-im-internet"], [], ["gesetze-im-internet"], []]
    assert df.select(sections.routes(F.col("j"), ("boe", "cache")).alias("x")).first().x == ["cache"]


def test_lines_that_are_text(spark):
    cases = {
        "Wer stiehlt, wird bestraft.": True, "Gesetzesnummer: 1": False, "gesetzesnummer": True, "Inhalt": False, "Inhaltsverzeichnis des ersten Teils": True, "§ 5": True, "Art. 5": True, "Paragraph 5,": False, "Seite 1 von 2": False, "Startseite x": False, "startseite x": True,
        "Typ": False, "Typisch": True, "'x": False, "// x": False, "a SmartPage_Context b": False, "WxePage_Init": False, "Sie sind dabei, die Seite zu verlassen": False, "Seitenbereiche:": False, "Seitenbereiche: x": True, "§ 5 heute": True, "§ 5 heute und morgen, so lange wie diese Zeile es sagt, also weit über sechzig Zeichen": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", lines.is_text(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases


def test_headings(spark):
    cases = {
        "§ 75 Mord": "Mord", "Art. 5a – Titel": "Titel", "Artikel 5 Freiheit": "Freiheit", "§ 5 Paragraph 5, Kopf": "Kopf", "§ 5. Paragraph 5": None, "§ 5": None, "Mord": None, "§ 5 Bundesrecht konsolidiert": None, "§ 1. Kopf": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", lines.numbered_heading(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases
    assert _one(spark, lines.ris_heading, "<h1>ABGB<br>Schadenersatz</h1>") == "Schadenersatz"
    assert _one(spark, lines.ris_heading, "<h1>Bundesrecht konsolidiert</h1><p>§ 3</p><p>Ein ganzer Satz steht hier.</p>") is None
    assert _one(spark, lines.ris_heading, None) is None


def test_pages_of_the_english_constitution(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    page = row("x", "<h3>Article 1</h3>") + row("de", "One.") + row("x", "<h4><b>Article</b> 1a.</h4>") + row("only") + row("de", "<p class='sr-only'>no</p>Two<br/>three") + row("x", "<h3>Article 2</h3>") + row("de", "End")
    assert tuple(_one(spark, lambda p: lines.ris_english(p, F.lit("1")), page)) == ("Article 1", "One.")
    assert tuple(_one(spark, lambda p: lines.ris_english(p, F.lit("1a")), page)) == ("Article 1a.", "Two\nthree")
    assert tuple(_one(spark, lambda p: lines.ris_english(p, F.lit("2")), page)) == ("Article 2", "End")
    assert tuple(_one(spark, lambda p: lines.ris_english(p, F.lit("3")), page)) == (None, "")


def test_slices_of_translations(spark):
    own = ["table of contents", "Section 1", "Section 2", "table of contents", "Section 1", "Scope", "(1) a", "b", "Section 2", "1. first", "table of contents", "x", "Section 3"]
    df = spark.createDataFrame([(own, ["Article 1", "[Dignity]", "Text", "Art. 2", "Art 2", "(1) Free"])], "s array<string>, a array<string>")
    take = lambda c, n, articles: (lambda r: r and tuple(r))(df.select(lines.translated_part(F.col(c), F.lit(n), articles).alias("x")).first().x)
    assert take("s", "1", False) == ("Scope", "(1) a\nb") and take("s", " 2 ", False) == (None, "1. first") and take("s", "3", False) is None
    assert take("a", "1", True) == ("Dignity", "Text") and take("a", "2", True) == ("Art 2", "(1) Free")


def test_norms_among_many(spark):
    page = '<div class="jnnorm"><h3><span>Art&nbsp;1</span> x</h3>A<div>b</div></div><div class="x jnnorm y"><h2>Art 12a</h2>B</div>'
    assert _one(spark, lambda p: german.norm_of_article(p, F.lit("1")), page) == '<div class="jnnorm"><h3><span>Art&nbsp;1</span> x</h3>A<div>b</div></div>'
    assert _one(spark, lambda p: german.norm_of_article(p, F.lit("12A")), page).endswith("B</div>") and _one(spark, lambda p: german.norm_of_article(p, F.lit("2")), page) is None


def test_lookups_without_pages(spark):
    refs = spark.createDataFrame([(1, "abgb", "1", None, None, None), (2, "nosuch", "1", None, None, None), (3, "ABGB", "1", None, None, "translation-en")], REFS)
    got = german.ris_sections(refs, spark.createDataFrame([], PAGES), laws.laws(spark), F.lit("t"))
    assert {r.ref_id: (r.status, r.section_row) for r in got.collect()} == {1: ("unavailable", None), 2: ("not-found", None), 3: ("not-found", None)}


def test_two_writers_cannot_publish_the_same_state(spark, tmp_path):
    one, two = (index.SlotStore(spark, str(tmp_path / "store")) for _ in range(2))
    rows = spark.createDataFrame([(1, "x")], "k int, v string")
    one.write_candidate(rows)
    seen, state = two._seen()
    one.activate()
    with pytest.raises(index.Conflict):
        two._point(seen, state)  # what two has read isn't the last state any more
    assert [tuple(r) for r in two.read().collect()] == [(1, "x")]


def test_sections_are_kept_by_key(spark, tmp_path):
    store = index.SlotStore(spark, str(tmp_path / "cache"))
    rows = lambda *xs: spark.createDataFrame(list(xs), "key string, provider string, retrieved_at string, text string")
    lookup.keep_sections(store, rows(("a", "ris", "2024-01-01", "old"), ("a", "ris", "2024-01-02", "new"), ("b", "bwb", "2024-01-01", "never"), (None, "ris", "2024-01-01", "no key"), ("c", "boe", "2024-01-01", "c")))
    lookup.keep_sections(store, rows(("c", "boe", "2024-01-03", "c2"), ("a", "ris", "2023-01-01", "older")))
    assert sorted(tuple(r) for r in store.read().select("key", "text").collect()) == [("a", "new"), ("c", "c2")]


def test_streamed_answers_are_the_batch(spark, tmp_path):
    rng = random.Random(4)
    start, rows, revision = dt.datetime(2024, 1, 1), [], {}
    for n in range(400):
        s, at = rng.choice("abc"), start + dt.timedelta(seconds=n * 7 + (3000 if n > 200 else 0))
        if rng.random() < 0.4 or s not in revision:
            revision.setdefault(s, []).append(n)
            rows.append((s, at, n, True, n))
        else:
            rows.append((s, at, n, False, rng.choice(revision[s][-2:])))
    schema = "session string, at timestamp, number long, request boolean, revision long"
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sync.current_answers_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60, "1 second")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    batch = lookup.current_answers(spark.createDataFrame(rows, schema), 60).select("session", "number")
    last, before, wanted = {}, {}, []
    for s, at, n, request, r in rows:  # by definition
        if s in before and (at - before[s]).total_seconds() > 60:
            last.pop(s, None)
        before[s] = at
        if request:
            last[s] = r
        elif last.get(s) == r:
            wanted.append((s, n))
    assert sorted(tuple(x) for x in batch.collect()) == sorted(wanted) and 20 < len(wanted) < 200
    assert sorted((x.session, x.number) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(wanted)


def test_references_are_not_sorted_to_be_asked_once(spark):
    refs = spark.createDataFrame([(i, "a", None if i % 2 else "b") for i in range(40)], "ref_id int, x string, y string")
    plans = []

    def chain(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.select("ref_id", F.concat_ws("|", "x", "y").alias("z"))

    got = hops.asked_once(refs, ["x", "y"], chain)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not any("Sort" in p for p in plans)
    assert sorted((r.ref_id, r.z) for r in got.collect()) == [(i, "a" if i % 2 else "a|b") for i in range(40)]
