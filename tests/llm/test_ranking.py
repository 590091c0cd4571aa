"""Ranked search against its definition, and the steps of the accumulation."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexquarry.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(FOLD))


def _expected(docs, items, top=50):
    held = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    by = {}
    for i, t in items:
        by.setdefault(i, set()).update(_terms(t))
    out = []
    for item, own in by.items():
        found = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def _run(spark, docs, items, **how):
    docs = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in docs], "doc_id long, text string, _id string, score int, item_id string")
    items = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.ranked_search(docs, items, **how).collect()], key=str)


def _random(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "ÜNÏ", "the", "THE"]
    return [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"top": 3, "triples": 7}, {"block_bytes": 1}])
def test_ranks_by_definition(spark, how):
    docs, items = _random(300, 1), _random(12, 2)
    assert _run(spark, docs, items, **how) == _expected(docs, items, how.get("top", 50))


def test_edges(spark):
    docs = [(5, "same text here"), (3, "same text here"), (3, "same text here"), (None, "same text here"), (-7, "SAME\ttext, here!"), (1, None), (2, ""), (4, " .!? "), (6, "other " * 400_000 + "rare"), (8, "same")]
    items = [(1, "same text"), (2, None), (3, ""), (None, "rare here"), (4, "absent"), (5, "same"), (5, "text")]
    assert _run(spark, docs, items) == _expected(docs, items)
    assert _run(spark, docs, []) == [] and _run(spark, [], items) == []


def test_frequent_terms_without_weight_find_nothing(spark):
    docs = [(i, "all") for i in range(5)]  # the logarithm of 12/11 is not 0 yet, floor(1000 ln) is 87
    assert [r[3] > 0 for r in _run(spark, docs, [(1, "all")])] == [True] * 5


def test_terms_of_pieces_are_those_of_the_text(monkeypatch):
    text = "A1 b-c ünï, D " * 50 + "z" * 40
    monkeypatch.setattr(ranking, "PIECE", 11)
    assert [w.decode() for p in ranking.terms(text.encode()) for w in p] == _terms(text)


def test_radix_order():
    rng = np.random.default_rng(1)
    for high in (1, 70_000, 1 << 33, 1 << 50):
        keys = rng.integers(0, high, 5000).astype(np.uint64)
        assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranking.radix_order(np.array([], np.uint64))) == 0
