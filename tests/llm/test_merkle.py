"""The manifest against a tree built in Python."""

from __future__ import annotations

import hashlib

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from lexquarry.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, _id string, leaf string, proof string, _tree string, root string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(nodes):
    """The root, and for each node the (left, right) texts of its steps."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            steps[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        nodes = [_h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], steps


def _expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _leaf(r)))
    made = {s: (sorted(v), *_tree([x[2] for x in sorted(v)])) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, top = _tree([made[s][1] for s in order])
    out = []
    for s, outer in zip(order, top, strict=True):
        for (there, i, leaf), own in zip(made[s][0], made[s][2], strict=True):
            out.append((i if there else None, leaf, made[s][1], root, tuple(own + outer)))
    return sorted(out, key=str)


def _run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], DOCS)
    return merkle.merkle_manifest(docs, merkle.row_digest(*[F.col(f) for f in FIELDS]), **how)


def _rows(n, source, start=0):
    return [(i, source, "en", i, f"text {i}") for i in range(start, start + n)]


@pytest.mark.parametrize(
    "rows",
    [
        _rows(1, "a"),
        _rows(17, "a") + _rows(1, "b", 100) + _rows(16, "c", 200) + _rows(257, "ä", 300) + _rows(3, None, 900) + _rows(2, "", 950),
        [(None, None, None, None, None), (None, "a", None, None, ""), (3, "a", None, 0, None), (3, "a", None, 0, None), (3, "a", "é", 5, "ünï\x00"), (-1, "B", "x", 1, "y" * 300_000)],
        [r for k in range(40) for r in _rows(2, f"s{k}", 10 * k)],
    ],
)
def test_manifest_equals_a_tree(spark, rows):
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.proof)) for r in _run(spark, rows).collect()]
    assert sorted(got, key=str) == _expected(rows)


def test_tree_of_several_buckets(spark):
    rows = _rows(2 * merkle.SPAN + 1, "a") + _rows(5, "b", 10**6)  # the last bucket of a has one leaf
    got = _run(spark, rows)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.proof)) for r in got.collect()], key=str) == _expected(rows)


def test_more_sources_than_a_run_of_runs(spark):
    rows = [(i, f"{i:04}", "en", 1, "t") for i in range(300)]
    assert {r.root for r in _run(spark, rows).collect()} == {_expected(rows)[0][3]}


def test_proofs_lead_to_the_root_and_tampering_does_not(spark):
    got = _run(spark, _rows(40, "a") + _rows(3, None, 100), other=F.when(F.col("doc_id") % 2 == 0, merkle.row_digest(F.lit("other"))), other_col="other")
    got = got.select("doc_id", "root", merkle.folded(F.col("leaf"), F.col("proof")).alias("good"), merkle.folded(F.col("other"), F.col("proof")).alias("bad")).collect()
    assert len(got) == 43
    for r in got:
        assert r.good == r.root
        assert (r.bad is None) == (r.doc_id % 2 == 1) and r.bad != r.root


def test_empty_table(spark):
    assert _run(spark, []).collect() == []


def test_digest_verifies_what_is_untouched(spark):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(["UPPER", "lower", None, "", "Mixed Ü"] * 8)]
    got = {r.doc_id: r for r in merkle.digest(spark.createDataFrame(rows, DOCS.split(", _id")[0])).collect()}
    import zlib

    for i, _, _, _, t in rows:
        hit = zlib.crc32(str(i).encode()) % 5 == 0 and t is not None and any("A" <= c <= "Z" for c in t)
        assert got[i].verified == (not hit) and (got[i].folded_root == got[i].root) == (not hit)


def test_buckets_are_taken_by_their_leaves():
    rows = pa.array([[0] * n for n in (merkle.SPAN, 5, merkle.SPAN - 5, 1, 2, merkle.SPAN)])
    parts = list(merkle._parts(iter([pa.record_batch([rows], names=["_rows"]), pa.record_batch([rows[:2]], names=["_rows"])])))
    assert [[len(r) for r in p["_rows"]] for p in parts] == [[merkle.SPAN], [5, merkle.SPAN - 5], [1, 2, merkle.SPAN], [merkle.SPAN], [5]]
