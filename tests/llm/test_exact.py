"""Operators with an exact result, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import components, decontaminate, fingerprint, jaccard, licenses, suffixes

rng = random.Random(5)
WORDS = ["the", "of", "Lex", "ius", "été", "naïve", "x1", "und", "Recht", "a", "b", "c"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


# decontamination


def brute_hits(text, items, window=10):
    toks = decontaminate.words((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        w = decontaminate.words((body or "").encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(toks) - n + 1):
                if toks[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(toks), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, docs, block_bytes):
    items = [(i, prose(rng.choice([3, 9, 10, 14, 40]))) for i in range(12)] + [(12, None), (13, ""), (None, "the of Lex"), (14, "a a a a a a a a a a a a"), (12, "ius und")]
    texts = [prose(60) + " " + (rng.choice(items)[1] or "") + " " + prose(20) for _ in range(25)] + [None, "", "... !", "a " * 30, prose(20000)]
    got = decontaminate.digest(decontaminate.find_contamination(docs(texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)).collect()
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, hit, found = brute_hits(texts[r.doc_id], known)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert len(got) == len(texts)


def test_decontaminated_texts(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, {item.upper()}; after that come many other words that are not of the item at all.", item, "clean  text\n", None, "", f"x {item}"]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(texts), spark.createDataFrame([(1, item)], "item_id long, text string"), n_chars="n_chars").collect()}
    assert got[0].text == "Before, ; after that come many other words that are not of the item at all."
    assert got[0].n_chars == len(got[0].text)
    assert sorted(got) == [0, 2, 3, 4]
    assert got[2].text == "clean  text\n"
    assert got[0].bucket == "x"


def test_no_items_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs(["a b"]), none).first().hit_items == []
    assert decontaminate.find_contamination(docs([]), none).count() == 0


# suffixes


def brute_removed(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark, docs):
    shared = [prose(14) for _ in range(4)]
    texts = [prose(rng.randint(0, 60)) + rng.choice(shared) + prose(rng.randint(0, 30)) + rng.choice(["", rng.choice(shared)[: rng.randint(40, 60)]]) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5][7:], texts[5][:-3] + "é", "a" * 300, "a" * 49, "a" * 50, "b" + "a" * 120, "ab" * 100, None, "", "é" * 40, "é" * 60, "xé" + "é" * 60, "\0" * 90, "\0" * 70, prose(9000)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    # rows of one id: the same text again, and another text
    texts += [texts[10], texts[11] + shared[0]]
    ids += [ids[10], ids[11]]
    rows = list(zip(ids, texts, strict=True))
    got = sorted((tuple(r) for r in suffixes.digest(docs(texts, ids)).collect()), key=str)
    assert got == brute_removed(rows)


def test_suffix_dedup_without_ids_or_rows(spark, docs):
    t = prose(40)
    got = sorted(tuple(r)[:3] for r in suffixes.digest(docs([t, t, t], [None, 7, 7])).collect() if r.doc_id is not None)
    assert got == [(7, len(t.encode()), 0)] * 2
    assert suffixes.digest(docs([t, t], [None, 7])).where("doc_id is null").first().n_removed == len(t.encode())
    assert suffixes.digest(docs([])).count() == 0


def test_without_repeats(spark, docs):
    a, b = prose(40), prose(30)
    got = {r.doc_id: r for r in suffixes.without_repeats(docs([a, "intro " + a, a, None, "", b]), n_chars="n_chars").collect()}
    assert sorted(got) == [0, 1, 3, 4, 5]
    assert (got[0].text, got[1].text, got[3].text, got[5].text) == (a, "intro ", None, b)
    assert got[1].n_chars == 6


def test_loser_tree_never_compares_known_prefixes():
    runs, listed = [], []
    for k in range(7):
        own = sorted(prose(6).encode()[:30].ljust(30, b"x") for _ in range(rng.randint(0, 40)))
        listed += own
        if own:
            lcp, rest, data = suffixes.front_code(own)
            assert sum(lcp.tolist()) + len(data) == sum(map(len, own))
            runs.append(suffixes.Run(len(runs), lcp, rest, data))
    got = list(suffixes.merge(runs))
    assert [e for e, *_ in got] == sorted(listed)
    for (x, *_), (y, lcp, *_) in zip(got, got[1:], strict=False):
        assert lcp == len(next((x[:i] for i in range(len(x) + 1) if i == len(x) or x[i] != y[i]), b""))


def test_every_window_has_an_anchor():
    data = np.frombuffer((prose(200) + "a" * 100).encode(), np.uint8)
    at, _ = suffixes.anchors(data, np.array([300, len(data)]))
    for i in range(len(data) - 49):
        if not i < 300 < i + 50:
            assert ((at >= i) & (at <= i + suffixes.BEFORE)).any()


# similar sets


def brute_components(rows, size, percent):
    def own(t):
        w = [x for x in (t or "").encode().translate(jaccard._LOWER).split()]
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [own(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, docs, size, percent):
    def edited(t, n):
        w = t.split(" ")
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(99))
        return " ".join(w)

    bases = [prose(n) for n in (3, 4, 12, 60, 150, 400)]
    texts = [edited(b, rng.choice([0, 1, 1, 2, 4])) for b in bases for _ in range(12)]
    chain = [prose(120)]
    for _ in range(12):  # neighbours are similar, the ends are not
        chain.append(edited(chain[-1], 1))
    texts += chain + [bases[3].upper(), bases[3].replace(" ", "\n\t"), "a", "A", "a b", "b a", "", None, "   ", prose(15000)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs(texts, ids), size=size, percent=percent).collect())
    assert got == brute_components(list(zip(ids, texts, strict=True)), size, percent)


def test_without_near_copies(spark, docs):
    t = prose(100)
    got = jaccard.without_near_copies(docs([t, t + " end", "other", None, "", t], [5, 3, 4, 6, 7, 9]), size=5, percent=80)
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 6, 7]
    assert jaccard.without_near_copies(docs([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (100, 101), *[(500, 501 + i) for i in range(50)]]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(500, 551), 500)}


# fingerprints


def test_fingerprint_pairs(spark, docs):
    texts = ["One. Two. Three.\nFour.", "x", "", None, "äö\nü. ß", prose(300), "One. Two. Three.\nFour."]
    ids = [3, 1, 7, 2, 10, 4, 11]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(docs(texts, ids)).collect()}
    order = sorted(ids, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[ids.index(i)] or "", texts[ids.index(order[(k + 1) % len(order)])] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[11].fingerprint != got[1].fingerprint
    assert got[7].fingerprint == got[2].fingerprint
    assert fingerprint.edited_pairs(docs([])).count() == 0
    assert fingerprint.edited_pairs(docs(["One. Two."])).first().near_next == 1.0


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("One.\nTwo.", "Three. Four.", "Four.\nTwo. One. Three.")], "a string, b string, both string")
    df = df.select(*[fingerprint.pieces(F.col(c)).alias(c) for c in df.columns]).select(*[fingerprint.vector_sum(F.col(c)).alias(c) for c in df.columns])
    df = df.select("a", "both", fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("both"), F.col("b"), -1).alias("rest"))
    r = df.select(*[fingerprint.digest(fingerprint.components(F.col(c))).alias(c) for c in df.columns]).first()
    assert r["sum"] == r["both"] and r["rest"] == r["a"] != r["both"]


# licences


def test_license_scan(spark, docs):
    texts = [f"{prose(30)}\n{t}\n{prose(rng.randint(0, 40))}" for t in licenses.TEMPLATES.values()] + [licenses.TEMPLATES["MIT-text"].replace("free", "without").replace("copy", "one"), prose(50), None, "", "MIT"]
    got = {}
    for r in licenses.scan_licenses(docs(texts), licenses.template_table(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
        assert r.containment >= 0.8 and r.n_windows >= 1
    for k, name in enumerate(licenses.TEMPLATES):
        assert name in got[k]
    assert not {len(licenses.TEMPLATES) + 1, len(licenses.TEMPLATES) + 2} & set(got)
    assert licenses.scan_licenses(docs([]), licenses.template_table(spark)).count() == 0
    assert licenses.scan_licenses(docs(texts), licenses.template_table(spark, {"none": "!"})).count() == 0


def test_windows_of_many_entries_are_those_of_few(monkeypatch):
    texts = [prose(rng.randint(4, 30)).encode() for _ in range(80)]
    body = prose(12).encode()
    entries = {}
    for k, t in enumerate(texts):
        data = np.frombuffer(t[: rng.randint(0, 30)] + body + texts[k // 3][: rng.randint(0, 40)], np.uint8)
        at = data.tobytes().index(body)
        entries.setdefault(suffixes.entries_at(data, np.array([at]))[0].tobytes(), []).append((rng.randint(0, 60), k, at))
    group = sorted(entries.items())
    assert len(group) >= suffixes.MANY
    many = sorted(suffixes.covered(group))
    monkeypatch.setattr(suffixes, "MANY", 10_000)
    assert many == sorted(suffixes.covered(group))


def test_long_run_of_one_byte(spark, docs):
    texts = ["a" * 400_000, "b" + "a" * 1000, "a" * 120 + "c"]
    got = [tuple(r)[1:4] for r in suffixes.digest(docs(texts)).orderBy("doc_id").collect()]
    assert got == [(400_000, 0, 0), (1001, 1000, 1), (121, 120, 1)]
