"""Places where an operator once did less than the whole job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lexquarry.llm import jaccard, mixing


def test_sample_has_the_targets(spark):
    rows = [(i, "word " * 50, s, "en", "x") for i, s in enumerate("a" * 60 + "b" * 4 + "c")]
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "value string, share double")}
    got = mixing.mixing_weights(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string"), targets=targets).collect()
    assert max(r.weight for r in got) > 2
    assert max(r.probability for r in got) == pytest.approx(1)
    total = sum(r.probability * r.n_tokens for r in got)
    for v, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert sum(r.probability * r.n_tokens for r in got if r.source == v) / total == pytest.approx(share)


def test_default_targets_by_definition(spark):
    for sums in ({"a": 900_000, "b": 90_000, None: 9_000, "d": 900, "e": 90, "f": 0}, {"a": 400, "b": 100}, {"a": 7}, {}):
        df = spark.createDataFrame([("s", "en", v, n) for v, n in sums.items()], "source string, lang string, topic string, tokens long")
        got = {r.value: r.share for r in mixing.balanced_targets(df, "topic").collect()}
        own = {v: n / sum(sums.values()) for v, n in sums.items() if n}
        low, high = 0.0, 1e9  # brute force: halve the interval of the one factor with which the limited shares sum to 1
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(mid * x**0.5, mixing.LIFT * x) for x in own.values()) < 1 else (low, mid)
        assert got == {v: pytest.approx(min(high * x**0.5, mixing.LIFT * x)) for v, x in own.items()}


def test_one_odd_document_does_not_shrink_the_sample(spark):
    rows = [(i, "word " * 700, "s", "en") for i in range(2000)] + [(2000, "| a | b |", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert mixing.mix(docs).count() > 0.8 * 2001 / mixing.LIFT


def test_jaccard_join_keeps_every_link(spark, docs):
    words = [f"w{i}" for i in range(120)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (0, 40, 80)]  # any two are similar
    texts = [" ".join(words), *near, near[1].upper(), "alone here", "", None]
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs(texts)).collect()}
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if (w := (t or "").lower().split()) else None for t in texts]
    similar = lambda a, b: a != b and 100 * len(a & b) >= 85 * len(a | b)
    for k, s in enumerate(sets):
        assert got[k].n_links == (len({x for x in sets if x and similar(s, x)}) if s else 0)
    assert [got[k].class_id for k in range(8)] == [0, 1, 2, 3, 2, 5, 6, 7]
    assert [got[k].component_id for k in range(8)] == [0, 0, 0, 0, 0, 5, 6, 7]
    assert got[1].n_links == 3


def test_frame_of_many_blocks(spark, docs, monkeypatch):
    """Blocks of a few sets each, in tiles of two by two: every link of one large group is counted, and each pair listed once."""
    monkeypatch.setattr(jaccard, "FRAME_BYTES", 4096)
    monkeypatch.setattr(jaccard, "TILE", 2)
    words = [f"w{i}" for i in range(140)]
    texts = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 96, 2)] + [" ".join(words)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    links = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert len(links) > 1000
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs(texts)).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: sum(k in p for p in links) for k in range(len(sets))}
    assert {r.component_id for r in got.values()} == {0}
    assert sorted(tuple(r) for r in jaccard.jaccard_links(docs(texts)).collect()) == sorted(links)


def test_hashes_of_more_buckets_than_16_bits_name():
    h = np.random.default_rng(3).integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 8, 65_536, 65_537, 6_500_000):
        of = jaccard._bucket(h, n)
        got = np.array([jaccard._whole(h[k : k + 1] & np.uint64((1 << 48) - 1), int(of[k]), n)[0] for k in range(len(h))])
        assert len(np.unique(got)) == len(h) and (of.max() < n)
    n = 1 << 20
    words = [" ".join(f"v{i}" for i in range(k, k + 40)) for k in (0, 0, 5)]
    ids, text = pa.array([0, 1, 2], pa.int64()), pa.array([f"x{k} {t}".encode() for k, t in enumerate(words)], pa.binary())
    posts = pa.Table.from_batches(list(jaccard._post(n, 4)(iter([pa.RecordBatch.from_arrays([ids, text], names=["id", "text"])]))))
    posts = posts.filter(pc.is_valid(posts.column("blob")))
    kept = set()
    for b in posts.column("bucket").unique().to_pylist():
        assert b < n
        shared = jaccard._shared(n)(posts.filter(pc.equal(posts.column("bucket"), b)))
        for blob in shared.column("blob").drop_null():
            kept |= set(jaccard._unpacked(blob.as_py(), "V16", "<u4", "<u4", "<u8", "<u4")[3].tolist())
    assert len(kept) == 37  # what the first two texts share; the third one's others are its own


def test_every_template_is_found_whole_and_against_brute_force(spark, docs):
    """A text with each template, one with most of it, one with half: containment by brute force over all windows."""
    import re

    from lexquarry.llm import licenses

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    names = sorted(licenses.TEMPLATES)
    filler = " ".join(f"word{i}" for i in range(700))
    texts = [f"{filler} {licenses.TEMPLATES[n].upper()} {filler}" for n in names]
    texts += [" ".join(words(licenses.TEMPLATES[n])[len(words(licenses.TEMPLATES[n])) // 2 :]) for n in names] + [texts[0], None, "", filler * 8]
    got = {(r.doc_id, r.license_id): r.containment for r in licenses.scan_licenses(docs(texts), licenses.template_table(spark)).collect()}
    sets = {n: grams(words(licenses.TEMPLATES[n])) for n in names}
    for i, t in enumerate(texts):
        own = grams(words(t))
        for n in names:  # the fillers are longer than any window: a template lies in one place at most
            share = len(sets[n] & own) / len(sets[n])
            if share >= licenses.THRESHOLD:
                assert got.pop((i, n)) == pytest.approx(share)
    assert not got


def test_deep_pages_take_time_by_their_length():
    import time

    from lexquarry.llm import html

    spent = []
    for n in (4000, 16000):
        page = "<html><body>" + "<div class=a>x" * n + "</b>" * n
        began = time.process_time()
        html.vote(page)
        spent.append(time.process_time() - began)
    assert spent[1] < 12 * max(spent[0], 0.02)


def test_links_at_any_depth_are_links():
    from lexquarry.llm import html

    deep = "<a href=x><b><i><u><span><em>" + "menu words here " * 30 + "</em></span></u></i></b></a>"
    page = f"<html><body><div class=list>{deep}</div><div class=text><p>{'The article itself. ' * 20}</p></div></body></html>"
    assert html.extract(page, None)[0].startswith("The article itself.")
