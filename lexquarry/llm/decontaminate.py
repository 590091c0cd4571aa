"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items of a block form one automaton (each item is inserted from the root). The words of a
document are streamed through it, and at each word the automaton knows the longest run of words, ending there,
that some item contains. A run as long as the window, or a whole shorter item, is an occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

WINDOW = 10
#: Bytes of item text in one automaton; more items make more automata, each in a pass of its own over the rows.
BLOCK_BYTES = 4 << 20

#: Bytes outside words become spaces, A-Z become a-z. UTF-8 bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton over word numbers, and what its windows belong to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if not seq:
                continue
            last = 0
            for c in seq:
                last = self._extend(last, c)
            n = min(window, len(seq))
            for i in range(len(seq) - n + 1):
                self.owners.setdefault(tuple(seq[i : i + n]), set()).add(item)
        self.sizes = sorted({len(k) for k in self.owners})

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # another item had this run of words already
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def matches(self, toks: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans [from, to) of words that occurrences cover, and the items they are of."""
        if not self.sizes or len(toks) < self.sizes[0]:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, toks, repeat(-1)), np.int32, len(toks))
        # an occurrence has known words only: only runs of them are streamed
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans, items = [], set()
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= self.sizes[0]:
                self._stream(ids[a:b].tolist(), int(a), spans, items)
        return spans, items

    def _stream(self, ids: list[int], at: int, spans: list, items: set) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.sizes[0]
        state = run = 0
        for j, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            if run >= least:
                for n in self.sizes:
                    if n <= run and (found := self.owners.get(tuple(ids[j + 1 - n : j + 1]))):
                        items |= found
                        spans.append((at + j + 1 - n, at + j + 1))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of a bounded size, so that neither the driver nor a broadcast grows with the table."""
    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, bytes(r.t)) for r in part.collect()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns hit_words (array of [from, to) word spans, disjoint, in order), hit_items (sorted ids) and n_words.

    Null and empty texts have no words, no spans, no items. Rows are kept as they are, repeated ones too; null ids
    or texts of items count for nothing; without items nothing is hit. Columns of docs that have these names are
    replaced.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    names = ["hit_words", "hit_items", "n_words"]
    span = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = docs.drop(*names).withColumns({"hit_words": F.array().cast(span), "hit_items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")})
    schema = out.schema
    at = [schema.fieldNames().index(n) for n in names]
    for block in item_blocks(items, item_id, item_text, block_bytes):
        built = sc.broadcast(Automaton(block, window))

        def scan(batches: Iterator[pa.RecordBatch], built=built) -> Iterator[pa.RecordBatch]:
            automaton = built.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                spans, found, counts = [], [], []
                old = batch.column(at[0]), batch.column(at[1])
                for i, text in enumerate(texts.cast(pa.binary()) if len(texts) else ()):
                    toks = words(text.as_py() or b"")
                    s, f = automaton.matches(toks)
                    if len(old[0][i]):
                        s = [(x["begin"], x["end"]) for x in old[0][i].as_py()] + s
                    spans.append([{"begin": a, "end": b} for a, b in merged(s)])
                    found.append(sorted(f | set(old[1][i].as_py())))
                    counts.append(len(toks))
                cols = list(batch.columns)
                for k, v in zip(at, (spans, found, counts), strict=True):
                    cols[k] = pa.array(v, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

        out = out.mapInArrow(scan, schema)
    return out


def removed(text: bytes, spans: list[tuple[int, int]], margin: int) -> bytes:
    """The text without the words of the spans, widened by margin words on both sides, and what separates them."""
    begins, ends, gap = [], [], True
    folded = text.translate(_FOLD)
    for i, b in enumerate(folded):
        if (b == 32) != gap:
            (ends if not gap else begins).append(i)
            gap = not gap
    if not gap:
        ends.append(len(text))
    out, at = [], 0
    for a, b in merged([(max(0, a - margin), min(len(begins), b + margin)) for a, b in spans]):
        out.append(text[at : begins[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", max_coverage: float = 0.5, margin: int = 0, n_chars: str | None = None, **how) -> DataFrame:
    """docs without the passages of items; a document goes when over max_coverage of its words are hit.

    Rows without hits keep their text byte for byte. n_chars names a column of lengths to keep true.
    """
    names, schema = docs.columns, docs.schema
    found = find_contamination(docs, items, text_col=text_col, **how)
    hit = F.aggregate("hit_words", F.lit(0), lambda a, s: a + s["end"] - s["begin"])
    found = found.where(hit <= F.col("n_words") * F.lit(max_coverage))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = batch.column(k)
            if any(len(s) for s in batch.column("hit_words")):
                texts = pa.array([removed(t.as_py().encode(), [(x["begin"], x["end"]) for x in s.as_py()], margin).decode(errors="ignore") if len(s) else t.as_py() for t, s in zip(texts, batch.column("hit_words"), strict=True)], texts.type)
            cols = [texts if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(n) for n in names]))

    out = found.mapInArrow(clean, schema)
    return out.withColumn(n_chars, F.length(text_col).cast(schema[n_chars].dataType)) if n_chars else out


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
