"""Learned operators: held-out accuracy and edge cases; extraction and mixing by their definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import html, language, mixing, quality, toxicity
from lexquarry.llm.common import remainder

DATA = "/root/testdata/sf0.01"
rng = random.Random(3)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    out = remainder(F.col("doc_id"), 4) == 2
    model = quality.train_quality(docs, labels.where(~out))
    assert model.rules and all(abs(w) > 0 for w in model.weights)
    got = quality.score_quality(docs, model).join(labels.where(out), "doc_id").select((F.col("score") >= 0.7).cast("int").alias("p"), "quality").collect()
    assert np.mean([r.p == r.quality for r in got]) > 0.93


def test_quality_edges(spark, docs, tables):
    model = quality.train_quality(*tables)
    got = quality.score_quality(docs([None, "", " ", "\n\n", "a" * 300000]), model)
    assert got.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in got.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(docs(["x"]), quality.train_quality(docs([]), none)).first().score == pytest.approx(0.5)


def test_lasso_drops_what_says_nothing():
    x = np.random.default_rng(1).random((800, 4))
    model = quality.fit_rules(x, (x[:, 2] > 0.4).astype(float), list("abcd"), penalty=0.01)
    used = {s for r, w in zip(model.rules, model.weights, strict=True) for s, *_ in r if abs(w) > 0.3}
    assert "c" in used


TOXIC = ["blarg", "snorf", "grumpf"]


def speech(n, toxic):
    w = ["".join(rng.choice(["ba", "ne", "ti", "lo", "sur"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(max(2, n // 20)):
            w[rng.randrange(n)] = rng.choice(TOXIC)
    return " ".join(w)


def test_toxicity_held_out(spark, docs):
    y = [int(i % 4 == 0) for i in range(500)]
    texts = [speech(rng.randint(40, 200), v) for v in y]
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i < 350], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs(texts), labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(texts), model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y[i]) for i in range(350, 500)]) > 0.97


def test_toxicity_edges(spark, docs):
    model = toxicity.train_toxicity(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs([None, "", "x " * 100000]), model)
    assert got.columns.count("score") == 1
    assert all(0 <= r.score < 0.5 for r in got.collect())


def test_language_held_out(spark, tables):
    docs = tables[0]
    out = remainder(F.col("doc_id"), 4) == 2
    got = language.identify_languages(docs, language.train_languages(docs.where(~out))).where(out).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_edges(spark, docs, tables):
    model = language.train_languages(tables[0])
    got = {r.doc_id: r for r in language.identify_languages(docs([None, "", "123 !?", "que la ciudad de los", "the of and"]), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_languages(docs(["abc"]), language.train_languages(docs([]))).first().lang_pred == "und"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
<header class="masthead"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout"><div class="%s" id="post-17"><h1>Head &amp; line</h1><p>First   <b>bold</b>\n text &#233;&nbsp;x.<br>Next line<p>Second &lt;b&gt;
<div class="ad">Buy now</div><ul><li>one<li>two</ul><form><input value="q">Search</form><blockquote>Quote</blockquote></div>
<aside>Side text that is long enough to be seen as something</aside><div class="comments"><p>A reader says a lot of things that are long, longer, and longest of all on the page.</p></div></div>
<footer>&copy; me</footer></body></html>"""
TEXT = "Head & line\nFirst bold text é x.\nNext line\nSecond <b>\none\ntwo\nQuote"


def test_extraction(spark):
    rows = [(1, "http://www.a.org/1", PAGE % "post-body p1"), (2, "https://a.org:80/2", PAGE % "post-body p2"), (3, "http://a.org/3", "<p>alone"), (4, None, None), (5, "x", ""), (6, "http://b.org", "<nav>only</nav>"), (1, "http://www.a.org/1", PAGE % "post-body p1"), (7, "http://c.org", "plain &amp text"), (8, "http://d.org", "<div>" * 3000 + "deep")]
    got = html.extract_main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].text == by[2].text == TEXT
    assert by[1].main_path == by[2].main_path == "/html/body/div.layout/div.p#.post-body"
    assert [by[i].text for i in (3, 4, 5, 6, 7, 8)] == ["alone", "", "", "", "plain & text", "deep"]
    assert all(r.n_chars == len(r.text) for r in got)


def test_host_consensus_outvotes_a_page(spark):
    body = "<div class='story'><p>%s</p></div><div class='extra'><p>%s</p></div>"
    rows = [(i, "http://h.org/", body % ("story " * 40, "more " * 5)) for i in range(4)] + [(4, "http://h.org/", body % ("story " * 5, "more " * 60))]
    got = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "story story story story story"


def test_raking_reaches_the_margins(spark):
    cells = [(s, l, t, rng.randint(1, 500)) for s in "abc" for l in ("en", None) for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "topic": {"x": 0.6, "y": 0.4}}
    frames = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in targets.items()}
    got = mixing.rake(df, frames, rounds=5, tolerance=1e-3).collect()
    assert sum(r.weight for r in got) == pytest.approx(1)
    for d, t in targets.items():
        for v, share in t.items():
            assert sum(r.weight for r in got if r[d] == v) == pytest.approx(share, abs=1e-2)


def brute_rake(cells, targets, rounds):
    w = {k: v / sum(cells.values()) for k, v in cells.items()}
    for _ in range(rounds):
        for d, t in targets.items():
            m = {}
            for k, v in w.items():
                m[k[d]] = m.get(k[d], 0) + v
            w = {k: v * t.get(k[d], m[k[d]]) / m[k[d]] if m[k[d]] else 0.0 for k, v in w.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def test_raking_is_iterative_proportional_fitting(spark):
    cells = {(s, "en", t): rng.randint(0, 50) for s in "abcd" for t in "xyz"}
    targets = {0: {"a": 0.4, "b": 0.4, "c": 0.2}, 2: {"x": 0.2, "y": 0.2, "z": 0.6}}
    frames = {d: spark.createDataFrame(list(targets[k].items()), "value string, share double") for d, k in (("source", 0), ("topic", 2))}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, frames, rounds=2, tolerance=0).collect()}
    expected = brute_rake(cells, targets, 2)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in cells)


def test_mixing_edges(spark, docs):
    got = mixing.mixing_weights(docs([None, "", "a b", "word " * 50000])).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0, 2, 50000]
    assert all(0 <= r.probability <= 1 for r in got)
    assert mixing.mix(docs([])).count() == 0
    sample = mixing.mix(docs(["a b c"] * 3000), keep=0.4).count()
    assert 1050 < sample < 1350


def test_quality_beside_columns_named_as_its_own(spark):
    model = quality.fit_rules(np.array([[float(i), float(i % 7)] for i in range(60)]), np.array([float(i > 30) for i in range(60)]), list(quality.statistics(F.lit("")))[:2])
    rows = spark.createDataFrame([(1, "a text of words", "p", 2, 3, 0.5), (2, None, "q", 4, 5, 0.5)], "doc_id long, text string, _chars string, _row long, row long, score double")
    got = quality.score_quality(rows, model)
    assert got.columns == ["doc_id", "text", "_chars", "_row", "row", "score"] and [r._chars for r in got.orderBy("doc_id").collect()] == ["p", "q"]
    kept = quality.keep_quality(rows, model, 0.0)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
