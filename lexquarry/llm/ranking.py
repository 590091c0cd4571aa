"""Ranked lexical search of many queries over all documents, by sort-based accumulation.

Documents are read once: of each, its length and how often it holds the queries' terms are kept, packed. When the
terms' frequencies are known, each task turns its documents into (item, document, impact) triples, concatenated over
the documents and their terms; packed keys of item and document are radix sorted, reduceat sums the impacts of equal
keys, and a heap for each item keeps the best. What the tasks keep is dealt by ranges of the item and the document,
selected again and ranked.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, partitions, small_batches, written

#: Results of an item; bytes of query text in a block (each block is a pass over the documents); triples sorted at once.
TOP, BLOCK_BYTES, TRIPLES = 50, 4 << 20, 4 << 20
#: A long text is split into terms in pieces of about so many bytes.
PIECE = 1 << 20
#: An id that is null is ordered as this one, after all others.
NO_ID = np.iinfo(np.int64).max

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
POSTINGS = "_id long, _n long, _terms array<int>, _counts array<int>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists: runs of letters, digits and whatever is not ASCII, A-Z lower-cased."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_FOLD)
        while end < len(text):  # the last term may go on
            more = text[end : end + 4096].translate(_FOLD)
            space = more.find(b" ")
            piece += more if space < 0 else more[:space]
            end += len(more) if space < 0 else space
            if space >= 0:
                break
        yield piece.split()
        at = end


@dataclass
class Block:
    """Some items: their ids, their terms, and the items of each term (as offsets into a list)."""

    ids: list
    terms: dict[bytes, int]
    first: np.ndarray
    items: np.ndarray


def _block(held: list[tuple[object, set[bytes]]]) -> Block:
    numbers: dict[bytes, int] = {}
    pairs = [(numbers.setdefault(t, len(numbers)), i) for i, (_, own) in enumerate(held) for t in sorted(own)]
    pairs.sort()
    of = np.array([p[0] for p in pairs], np.int64)
    return Block([i for i, _ in held], numbers, np.searchsorted(of, np.arange(len(numbers) + 1)), np.array([p[1] for p in pairs], np.int64))


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[Block]:
    """Items in blocks of about block_bytes of text; rows of one id are one item, which never is in two blocks."""
    held: list[tuple[object, set[bytes]]] = []
    size = 0
    for r in items.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("t")).orderBy("i").toLocalIterator(prefetchPartitions=False):
        own = {t for found in terms(bytes(r.t)) for t in found}
        if held and held[-1][0] == r.i:
            held[-1][1].update(own)
        else:
            if size >= block_bytes:
                yield _block(held)
                held, size = [], 0
            held.append((r.i, own))
        size += len(r.t)
    if held:
        yield _block(held)


def _postings(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """Of each document with terms, how many it has and which of the block's, how often."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.value.terms.get
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1):
                n, own = 0, Counter()
                for words in terms(text.as_py() or b""):
                    n += len(words)
                    own.update(map(number, words))
                own.pop(None, None)
                sizes.append(n)
                found.append(list(own))
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["_id", "_n", "_terms", "_counts"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(take, POSTINGS).where("_n > 0")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys, digit by digit of 16 bits from the lowest (numpy sorts those by radix)."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    shift = 16
    while len(keys) and int(keys.max()) >> shift:
        order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Best:
    """The best of each item: a heap of (score, -id), the worst on top."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # no lower score can enter the item's heap

    def offer(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.least[item])
        item, ids, score = item[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, item))
        item, ids, score = item[order], ids[order], score[order]
        within = np.arange(len(item)) - np.searchsorted(item, item)
        for i, d, s in zip(*(x[within < self.top].tolist() for x in (item, ids, score)), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, heap in enumerate(self.heaps):
            for s, d in heap:
                yield i, -d, s


def _accumulated(best: Best, block: Block, weight: np.ndarray, ids: np.ndarray, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, triples: int) -> None:
    """Offer the scores of some documents: owner, term and tf say which document holds which term how often."""
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
    fan = block.first[term + 1] - block.first[term]
    upto = np.cumsum(fan)
    ends = np.flatnonzero(np.diff(owner, append=-1)) + 1  # where a document's terms end
    at = 0
    while at < len(term):
        base = upto[at - 1] if at else 0
        k = np.searchsorted(upto[ends - 1], base + triples, side="right")
        end = max(int(ends[max(0, k - 1)]), int(ends[np.searchsorted(ends, at, side="right")]))  # whole documents, one at least
        f = fan[at:end]
        total = int(f.sum())
        offset = np.repeat(block.first[term[at:end]] - (np.cumsum(f) - f), f) + np.arange(total)
        docs = np.repeat(owner[at:end], f)
        low = int(owner[at])
        width = int(owner[end - 1]) - low + 1
        keys = (block.items[offset] * width + (docs - low)).astype(np.uint64)
        order = radix_order(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        found = keys[starts].astype(np.int64)
        best.offer(found // width, ids[found % width + low], np.add.reduceat(np.repeat(impact[at:end], f)[order], starts))
        at = end


def _candidates(postings: DataFrame, block, weight, n: int, length: int, item_type: T.DataType, top: int, triples: int) -> DataFrame:
    """The best of each task, (item_id, _id, score)."""
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("_id", T.LongType()), T.StructField("score", T.LongType())])
    arrow_type = to_arrow_type(item_type)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = block.value, weight.value
        best = Best(len(own.ids), top)
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            size = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            m = 50 + np.array([50 * int(x) * n // length for x in size], np.int64)  # of any size, exactly
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            _accumulated(best, own, w, ids, m, owner, term, tf, triples)
        rows = list(best.rows())
        for k in range(0, len(rows), 65536):
            i, d, s = (list(x) for x in zip(*rows[k : k + 65536], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([own.ids[x] for x in i], arrow_type), pa.array([None if x == NO_ID else x for x in d], pa.int64()), pa.array(s, pa.int64())], names=["item_id", "_id", "score"])

    return postings.mapInArrow(take, schema)


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES, triples: int = TRIPLES) -> DataFrame:
    """item_id, rank (from 1), id_col and score of the top documents of each item with a score above 0.

    The score is a sum of whole numbers: floor(1000 ln((2N+2)/(2df+1))) times a saturated term frequency that is
    normalised by the document's length (N documents that have terms). Equal scores rank by ascending id. Ids are
    whole numbers; a null id is ranked after all others of its score, and repeated rows are ranked each. Null and
    empty texts hold nothing and aren't found; an item without terms has no rows. Items of any number: each block of
    block_bytes of query text is a pass over the documents, and its terms are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    item_type = items.schema[item_id].dataType
    best = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("_id", T.LongType()), T.StructField("score", T.LongType())]))
    for found in item_blocks(items, item_id, item_text, block_bytes):
        block = spark.sparkContext.broadcast(found)
        postings = written(_postings(docs, block, id_col, text_col), "postings")
        n, length = postings.agg(F.count("*"), F.sum("_n")).first()
        df = np.zeros(len(found.terms), np.int64)
        for r in postings.select(F.explode("_terms").alias("t")).groupBy("t").count().collect():  # a row for each of the block's terms
            df[r.t] = r["count"]
        weight = spark.sparkContext.broadcast(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))
        kept = written(_candidates(postings, block, weight, n, length or 1, item_type, top, triples), "candidates")
        discard(postings)
        best = best.unionByName(kept)
    # an item's candidates are many at scale: ranges of them are selected from first
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last()]
    dealt = best.repartitionByRange(partitions(spark), "item_id", "_id").withColumn("_range", F.spark_partition_id())
    first = dealt.mapInArrow(_heap_selected(item_type, top), best.schema)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_id), "rank", F.col("_id").alias(id_col), "score")


def _heap_selected(item_type: T.DataType, top: int):
    """The best of each item among the rows of a task."""
    arrow_type = to_arrow_type(item_type)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {}
        for batch in batches:
            ids = batch.column(1).fill_null(int(NO_ID))
            for i, d, s in zip(batch.column(0).to_pylist(), ids.to_pylist(), batch.column(2).to_pylist(), strict=True):
                heap = heaps.setdefault(i, [])
                if len(heap) < top:
                    heapq.heappush(heap, (s, -d))
                else:
                    heapq.heappushpop(heap, (s, -d))
        for i, heap in heaps.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(heap), arrow_type), pa.array([None if -d == NO_ID else -d for _, d in heap], pa.int64()), pa.array([s for s, _ in heap], pa.int64())], names=["item_id", "_id", "score"])

    return take
