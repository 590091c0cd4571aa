import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import extract, present
from lexquarry.operators import index, resolve, search, tables, temporal
from lexquarry.plans import legal
from lexquarry.streaming import sync


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_latest_as_of_drops_ties(spark):
    df = spark.createDataFrame([("a", "2020", 1), ("a", "2021", 2), ("a", "2031", 3), ("b", "2020", 4), ("b", "2020", 5), ("c", None, 6)], "k string, d string, v int")
    assert rows(temporal.latest_as_of(df, ["k"], "d", F.lit("2022"), ["v"])) == [("a", "2021", 2)]
    assert rows(temporal.latest_as_of(df.limit(0), ["k"], "d", F.lit("2022"), ["v"])) == []


def test_intervals(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), 1), ("a", dt.datetime(2021, 1, 1), 2)], "k string, d timestamp, v int")
    got = temporal.validity_intervals(df, ["k"], "d", ["v"])
    assert rows(got.select("v", "valid_from", "valid_to")) == [(1, "20200101", "20201231"), (2, "20210101", "99999999")]
    assert [r.v for r in got.where(temporal.in_force(F.lit("20201231"), F.col("valid_from"), F.col("valid_to"))).collect()] == [1]


def test_coverage(spark):
    df = spark.createDataFrame([("2020-01-01/..",), ("../2021-01-01",), ("2020-01-01",), (None,)], "c string").select(temporal.coverage(F.col("c")).alias("x")).select("x.from", "x.to")
    assert [tuple(r) for r in df.collect()] == [("2020-01-01", None), (None, "2021-01-01"), ("2020-01-01", None), (None, None)]


def test_upsert_keeps_what_is_missing(spark):
    old = spark.createDataFrame([(1, 1, "x"), (2, 5, "y")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 5, "z"), (3, 1, "w")], "k int, t int, v string")
    assert rows(index.upsert(old, new, ["k"], "t")) == [(1, 1, "x"), (2, 5, "z"), (3, 1, "w")]


def test_bijection(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "a")], "l int, r string")
    assert rows(index.bijection_violations(df, "l", "r")) == [("left", "2", 2), ("right", "a", 2)]


def test_reachable_in_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    assert [r.node for r in index.reachable(spark.createDataFrame([(1,)], "node long"), edges).orderBy("node").collect()] == [1, 2, 3]


def test_page(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    assert rows(index.page_after(df, ["a", "b"], (1, 1), 5)) == [(1, 2), (2, 1)]


def test_two_slots(spark, tmp_path):
    store = index.SlotStore(spark, str(tmp_path / "store"))
    assert store.read() is None
    store.write_candidate(spark.createDataFrame([(1, "x")], "k int, v string"))
    assert store.read() is None
    store.activate()
    store.write_candidate(spark.createDataFrame([(2, "y")], "k int, v string"))
    assert rows(store.read()) == [(1, "x")]
    store.discard()
    assert rows(store.read()) == [(1, "x")]
    with pytest.raises(ValueError):
        store.activate()


def test_streamed_upserts_are_the_batch(spark, tmp_path):
    schema = "k int, t int, v string"
    for i, batch in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 0, "old")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = index.SlotStore(spark, str(tmp_path / "store"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sync.upsert_stream(stream, store, ["k"], "t", str(tmp_path / "progress")).awaitTermination()
    assert rows(store.read()) == [(1, 2, "c"), (2, 1, "b")]


def test_sessions(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(1, at(0), 1), (1, at(1), 2), (1, at(30), 3), (2, at(0), 4)], "u int, ts timestamp, e int")
    assert rows(sync.last_of_sessions(df, "u", "ts", "10 minutes", "e").select("u", "n_events", "last")) == [(1, 1, 3), (1, 2, 2), (2, 1, 4)]


def test_unique_titles_and_priorities(spark):
    df = spark.createDataFrame([("A  b", 1), ("a B", 2), ("c", 3), ("c", 3), (None, 4), (" ", 5)], "t string, i int")
    assert rows(resolve.unique_titles(df, "t", "i")) == [("c", 3)]
    ranked = spark.createDataFrame([(1, 2, "x"), (1, 1, None), (2, 1, "y"), (2, 2, "z"), (3, 1, None)], "k int, p int, v string")
    assert rows(resolve.first_by_priority(ranked, ["k"], "p", ["v"])) == [(1, "x", 2), (2, "y", 1)]


ENTRIES = [
    ("EU", "32016R0679", "Regulation (EU) 2016/679", ["GDPR", "RGPD"], ["Data protection"], "32016R0679", "2016", "0679"),
    ("EU", "32022L2555", None, ["NIS2"], [], "32022L2555", "2022", "2555"),
    ("DE", "BGB", "Bürgerliches Gesetzbuch", ["BGB"], [], None, None, None),
    ("DE", "StGB", "Strafgesetzbuch", ["StGB"], [], None, None, None),
]


@pytest.mark.parametrize(
    ("query", "jurisdiction", "found"),
    [("gdpr", "EU", [("32016R0679", "exact-alias")]), ("gd", "EU", [("32016R0679", "title-prefix")]), ("protection", "EU", [("32016R0679", "title-contains")]), ("2016/679", "EU", [("32016R0679", "title-contains")]),
     ("2022/2555", "EU", [("32022L2555", "eu-technical")]), ("RL 2022", "EU", [("32022L2555", "eu-technical")]), ("VO 2022", "EU", []), ("gesetzbuch", "DE", [("BGB", "title-contains"), ("StGB", "title-contains")]), ("bg", "DE", []), ("b", "DE", []), (None, "DE", []), ("gdprr", "EU", [])],
)
def test_search(spark, query, jurisdiction, found):
    entries = spark.createDataFrame(ENTRIES, "jurisdiction string, canonical_input string, title string, aliases array<string>, alternate_titles array<string>, celex string, year string, number string")
    got = search.search_metadata(spark.createDataFrame([(1, query, jurisdiction)], "query_id int, query string, jurisdiction string"), entries)
    assert [(r.canonical_input, r.match_kind) for r in got.orderBy("position").collect()] == found


def test_extractors_differ(spark):
    page = "<p>a&nbsp;&amp;lt;b<br>c</p><script>x</script><!-- d --><div>e  f</div>"
    df = spark.createDataFrame([(page,), ("",), (None,)], "h string")
    got = {s: [r[0] for r in df.select(extract.html_text(F.col("h"), s)).collect()] for s in extract.RULES}
    assert got["normattiva"] == ["a &lt;b\nc\ne f", "", None]
    assert got["boe"] == ["a <b\nc\nxe f", "", None]
    assert got["eurlex"][0] == "a&nbsp;&lt;b c\ne f"
    assert "x" in got["neuris"][0] and "x" not in got["gii"][0]


def test_presentation(spark):
    df = spark.createDataFrame([("a\nb", None), (None, None)], "t string, n string")
    assert [r[0] for r in df.select(present.quoted(F.col("t"))).collect()] == ["> a\n> b", None]
    null, lit = F.lit(None).cast("string"), F.lit
    key = lambda j, celex=null, lang=null, kind=lit("article"), sub=null, variant=null: spark.range(1).select(present.cache_key(lit("bgb"), lit(" 5A "), kind, j, celex, sub, lang, variant)).first()[0]
    assert key(null) == "BGB:art:5a:official-de"
    assert key(lit("AT"), kind=null) == "AT:BGB:5a:official-de"
    assert key(lit("EU"), lit("32016r0679"), lit("en"), sub=lit("2")) == "EU:32016R0679:art:5a:sec:2:en"
    assert key(lit("EU"), lit("x")) is None
    assert key(lit("CH"), lang=lit("en")) is None
    assert key(lit("FI"), lang=lit("swe")) == "FI:BGB:art:5a:official-sv"


def test_versions_are_held_in_bounded_parts(spark, monkeypatch):
    df = spark.createDataFrame([("a", "2021", 1), ("a", "2020", 2), ("b", "2021", 1), ("b", "2021", 1)], "k string, d string, v int").withColumn("d", F.to_date("d"))
    got = temporal.latest_as_of(df, ["k"], "d", F.lit("2022-01-01"), ["v"])
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.v) for r in got.collect()] == [("a", 1)]
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = legal.block_version_asof(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {-(-lines // 100)}), REPARTITION_BY_NUM") == 2
