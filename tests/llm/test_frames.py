"""Copies of one text, each changed in its own way, gather in a frame."""

import random

from lexquarry.llm import jaccard

from .test_exact import brute_components


def test_differently_changed_copies_are_one_frame(docs, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=300)
    # changes are taken from a few alternatives, so that some sets share them and lead each other's lists
    copies = [[rng.choice((f"x{i}", f"y{i}")) if rng.random() < 0.03 else w for i, w in enumerate(base)] for _ in range(90)]
    texts = [" ".join(c) for c in copies]
    made = []
    crossing = jaccard._crossing
    monkeypatch.setattr(jaccard, "_crossing", lambda *a: made.append(crossing(*a)) or made[-1])
    got = jaccard.jaccard_components(docs(texts), size=5, percent=80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, c) for i, *_, c in brute_components(list(enumerate(texts)), 5, 80)}
    assert made[0].count() <= 9  # the pairs of frames that meet; all pairs of copies are 4,005
