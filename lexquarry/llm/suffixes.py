"""Deduplication of byte strings with a sparse suffix array, sorted by a distributed merge sort.

A string of LENGTH bytes holds at least one anchor: a position whose GRAM-gram hash is the smallest of all that start
in some LENGTH-byte window. Copies of a string have the same anchors, so only suffixes at anchors are sorted.

1. The hashes of all anchors, with a byte for each side's neighbours, are exchanged as packed blocks; anchors whose
   gram no other text has, with the same neighbours on one side, are dropped. Equal texts count as one.
2. Each task sorts the suffixes at its anchors that are left (LENGTH bytes after, and the bytes before in reverse)
   and front-codes the runs: each entry has the length of its common prefix with the one before, and the rest.
3. Runs are exchanged by the hash of the gram and merged by a loser tree that knows the common prefix of each run's
   head with the last output: heads with different ones are never compared, others only behind it.
4. Suffixes that share enough bytes around the anchor, with a smaller document among them, cover bytes; these
   intervals go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, discard, small_batches, written

LENGTH, GRAM = 50, 24
BEFORE = LENGTH - GRAM
#: A string of LENGTH bytes around a gram goes on for so many on one of its sides at least.
SIDE = BEFORE // 2
#: Entries of a run at most, and bytes of text whose anchors make a block: bounds of a task's memory.
RUN_ENTRIES, BLOCK_BYTES = 150_000, 1 << 20
#: Entries of a gram from which on its windows are compared as arrays.
MANY = 48
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling; the last GRAM - 1 positions have none."""
    power = lambda k: np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
    h = {1: _TABLE[data]}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][: len(h[k]) - k] * power(k) + h[k][k:]
    n = len(data) - GRAM + 1
    out = h[16][:n] * power(8) + h[8][16 : 16 + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out | np.uint64(1)


def _sides(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte that the SIDE bytes before, and one that those behind each gram hash to; 0 where the text has fewer."""
    power = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SIDE)], np.uint64)
    begins = np.concatenate(([0], ends[:-1]))[np.searchsorted(ends, at, side="right")]
    limit = ends[np.searchsorted(ends, at, side="right")]
    out = []
    for first, fits in ((at - SIDE, at - SIDE >= begins), (at + GRAM, at + GRAM + SIDE <= limit)):
        h = np.zeros(len(at), np.uint64)
        own = np.where(fits, first, 0)
        for k in range(SIDE):
            h += _TABLE[data[own + k]] * power[k]
        h ^= h >> np.uint64(31)
        out.append(np.where(fits, h * _MIX % np.uint64(255) + np.uint64(1), 0).astype(np.uint8))
    return out[0], out[1]


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of width neighbours."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that lie one after another and end at ends."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    low = _sliding(h, BEFORE + 1, np.minimum)  # of the window that starts here
    for end in ends[:-1]:  # windows over the end of a text are none
        low[max(0, end - LENGTH + 1) : end] = 0
    pad = np.zeros(BEFORE, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), BEFORE + 1, np.maximum)
    at = np.flatnonzero(high == h)
    return at, h[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple[int, int], bytes]]]:
    """The rows (order, key, text) in blocks of a bounded size."""
    rows, size = [], 0
    for batch in batches:
        for o, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = t.as_py()
            rows.append(((o, k), text))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstd.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of anchors are small, being the smallest of their windows: mixed once more they are dealt evenly."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """The 40 low bits: with the bucket enough to tell grams apart; a false partner only costs a comparison."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _long(short: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(short) // 5, 8), np.uint8)
    wide[:, :5] = short.reshape(-1, 5)
    return wide.view("<u8").ravel()


def _slices(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values of a sorted array."""
    if not len(keys):
        return []
    edge = np.flatnonzero(np.diff(keys)) + 1
    return [(int(keys[a]), int(a), int(b)) for a, b in zip([0, *edge], [*edge, len(keys)], strict=True)]


_PACKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=_PACKED)


def _post(n: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            data = np.frombuffer(b"".join(t for _, t in block), np.uint8)
            ends = np.cumsum([len(t) for _, t in block])
            at, h = anchors(data, ends)
            doc = np.searchsorted(ends, at, side="right").astype(np.uint32)
            bucket = _bucket(h, n)
            sides = _sides(data, at, ends) if len(at) else (np.zeros(0, np.uint8),) * 2
            both = sides[0].astype(np.uint16) << np.uint16(8) | sides[1]
            order = np.lexsort((both, doc, h, bucket))
            h, doc, bucket, both = h[order], doc[order], bucket[order], both[order]
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (both[1:] != both[:-1]))) if len(h) else np.zeros(0, bool)
            h, doc, bucket, both = h[first], doc[first], bucket[first], both[first]  # the same of a document counts once
            orders, keys = np.array([k[0] for k, _ in block], np.int64), np.array([k[1] for k, _ in block], np.int64)
            out = []
            for b, i, j in _slices(bucket):
                used, own = np.unique(doc[i:j], return_inverse=True)
                out.append((b, _pack(_short(h[i:j]), own.astype(np.uint16 if len(used) < 65536 else np.uint32), orders[used], keys[used], np.array([len(used)], np.int64), both[i:j])))
            if out:
                yield _rows(out)
        pa.default_memory_pool().release_unused()

    return post


def _doc_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return np.mod(keys, n)  # keys are hashes


def _shared(n: int, n_docs: int):
    """A bucket's hashes that several documents have, sent to these documents: (order, key, hash) by document bucket."""

    def shared(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        hs, ids, orders, keys, sides, base = [], [], [], [], [], 0
        for blob in group.column("blob"):
            raw = blob.as_py()
            short, _, o, k, count, both = _unpack(raw, np.uint8, np.uint8, np.int64, np.int64, np.int64, np.uint16)
            own = _unpack(raw, np.uint8, np.uint16 if count[0] < 65536 else np.uint32)[1]
            hs.append(_long(short))
            ids.append(own.astype(np.int64) + base)
            orders.append(o)
            keys.append(k)
            sides.append(both)
            base += len(o)
        h, doc, o, k, both = (np.concatenate(x) for x in (hs, ids, orders, keys, sides))
        # equal texts are one
        same = np.lexsort((o, k))
        first = np.concatenate(([True], (k[same][1:] != k[same][:-1]) | (o[same][1:] != o[same][:-1])))
        one = np.empty(len(k), np.int64)
        one[same] = same[np.flatnonzero(first)][np.cumsum(first) - 1]
        doc = one[doc]
        keep = np.zeros(len(h), bool)
        for side in (both >> np.uint16(8), both & np.uint16(255)):
            order = np.lexsort((doc, side, h))
            hh, ss, dd = h[order], side[order], doc[order]
            alike = (hh[1:] == hh[:-1]) & (ss[1:] == ss[:-1]) & (ss[1:] > 0)
            other = alike & (dd[1:] != dd[:-1])
            # runs of alike ones that hold several texts
            run = np.concatenate(([0], np.cumsum(~alike)))
            many = np.zeros(run[-1] + 1, bool)
            many[run[1:][other]] = True
            keep[order[many[run]]] = True
        h, doc = h[keep], doc[keep]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
        h, doc = h[first], doc[first]
        to = _doc_bucket(k, n_docs)[doc]
        order = np.lexsort((doc, to))
        h, doc, to = h[order], doc[order], to[order]
        found = []
        for b, i, j in _slices(to):
            used, own = np.unique(doc[i:j], return_inverse=True)
            found.append((b, _pack(_short(h[i:j]), own.astype(np.uint32), o[used], k[used], np.array([bucket], np.int64))))
        return pa.Table.from_batches([_rows(found)])

    return shared


#: Bytes of an entry: the suffix, the bytes before it in reverse, the lengths of both. What a text lacks is 0.
WIDTH = LENGTH + BEFORE + 2


def entries_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries of a text's suffixes at the places, a row of WIDTH bytes each."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, :LENGTH] = padded[at[:, None] + np.arange(BEFORE, BEFORE + LENGTH)]
    out[:, LENGTH : LENGTH + BEFORE] = padded[at[:, None] + np.arange(BEFORE - 1, -1, -1)]
    out[:, -2] = np.minimum(BEFORE, at)
    out[:, -1] = np.minimum(LENGTH, len(data) - at)
    return out


def front_code(entries: np.ndarray | list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the entry before, length of the rest, and the rests of sorted entries of one length."""
    if isinstance(entries, list):
        entries = np.frombuffer(b"".join(entries), np.uint8).reshape(len(entries), -1)
    lcp = np.zeros(len(entries), np.int64)
    differ = entries[1:] != entries[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), entries.shape[1])
    rests = entries[np.arange(entries.shape[1]) >= lcp[:, None]]
    return lcp.astype(np.uint8), (entries.shape[1] - lcp).astype(np.uint8), rests.tobytes()


class Run:
    """A front-coded run that is read entry by entry: lcp is that of the head with the entry before it."""

    __slots__ = ("_at", "_byte", "_data", "_lcp", "_rest", "head", "index", "lcp", "number")

    def __init__(self, number: int, lcp: np.ndarray, rest: np.ndarray, data: bytes):
        self.number, self._lcp, self._rest, self._data = number, lcp.tolist(), rest.tolist(), data
        self._at = self._byte = 0
        self.head: bytes | None = b""
        self.lcp = self.index = 0
        self.advance()

    def advance(self) -> None:
        if self._at >= len(self._lcp):
            self.head, self.lcp = None, -1
            return
        self.index, self.lcp = self._at, self._lcp[self._at]
        end = self._byte + self._rest[self._at]
        self.head = self.head[: self.lcp] + self._data[self._byte : end]
        self._at, self._byte = self._at + 1, end


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, int, int]]:
    """(entry, common prefix with the last output, run, index) of all entries in order, by a loser tree.

    Of each head the common prefix with the last output is known. The longer one is the smaller entry; only equal
    ones are compared, from there on, and the loser then knows its common prefix with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    if not runs:
        return
    done = Run(-1, np.zeros(0, np.uint8), np.zeros(0, np.uint8), b"")
    leaves = [*runs, *[done] * (size - len(runs))]

    def play(a: Run, b: Run) -> tuple[Run, Run]:
        """Winner and loser."""
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        if a.head is None or b.head is None:
            return (b, a) if a.head is None else (a, b)
        x, y, k = a.head, b.head, a.lcp
        n = min(len(x), len(y))
        if x == y:
            k = n
        else:
            while k < n and x[k] == y[k]:
                k += 1
        if k == len(x) or (k < n and x[k] < y[k]):
            b.lcp = k
            return a, b
        a.lcp = k
        return b, a

    for r in leaves:
        if r.head is not None:
            r.lcp = 0
    losers: list[Run] = [done] * size
    level = leaves
    while len(level) > 1:  # the first games, from the leaves up
        up = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[(len(level) + i) // 2] = lost
            up.append(w)
        level = up
    winner = level[0]
    place = {id(r): i for i, r in enumerate(runs)}
    while winner.head is not None:
        yield winner.head, winner.lcp, winner.number, winner.index
        node = (size + place[id(winner)]) // 2
        winner.advance()
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _runs(n: int):
    """Sorted, front-coded runs of the suffixes at the marked anchors of (order, key, text, marks)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        docs: list[tuple[int, int]] = []
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            entries, bucket, places = (np.concatenate(x) for x in zip(*held, strict=True))
            owners = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[0]) for x in held])
            order = np.argsort(np.ascontiguousarray(entries).view(f"S{WIDTH}").ravel(), kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            entries, bucket, places, owners = entries[order], bucket[order], places[order], owners[order]
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (entries[1:] != entries[:-1]).any(1)))
            out = []
            for b, i, j in _slices(bucket):
                starts = np.flatnonzero(new[i:j])
                lcp, rest, data = front_code(entries[i:j][starts])
                used, own = np.unique(owners[i:j], return_inverse=True)
                counts = np.diff(np.append(starts, j - i)).astype(np.uint32)
                out.append((b, _pack(lcp, rest, np.frombuffer(data, np.uint8), counts, own.astype(np.uint32), places[i:j], np.array([docs[u][0] for u in used], np.int64), np.array([docs[u][1] for u in used], np.int64))))
            yield _rows(out)

        for batch in batches:
            for o, k, t, marks in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                data, all_ = np.frombuffer(t, np.uint8), np.frombuffer(marks, np.uint32)
                bucket = _bucket(gram_hashes(data)[all_], n)
                # a text of very many anchors fills several runs
                for i in range(0, len(all_), RUN_ENTRIES):
                    at = all_[i : i + RUN_ENTRIES]
                    held.append((entries_at(data, at.astype(np.int64)), bucket[i : i + RUN_ENTRIES], at))
                    docs.append((o, k))
                    many += len(at)
                    if many >= RUN_ENTRIES:
                        yield from flush()
                        held, docs, many = [], [], 0
        if many:
            yield from flush()
        pa.default_memory_pool().release_unused()

    return runs


def covered(group: list[tuple[bytes, list[tuple[int, int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """(order, key, from, to) that one gram's entries cover: entries as of entries_at, with the places (order, key,
    position) of each."""
    if not group:
        return
    if len(group) == 1:
        entry, places = group[0]
        first = min(places)[0]
        low, high = LENGTH - entry[-1], entry[-2]
        if low <= high:
            for order, key, at in places:
                if order > first:
                    yield order, key, at - high, at - low + LENGTH
        return
    firsts = [min(places)[0] for _, places in group]
    if min(firsts) == max(p[0] for _, places in group for p in places):
        return
    for (entry, places), lows in zip(group, _lows(group, firsts), strict=True):
        low, high = LENGTH - entry[-1], entry[-2]
        if low > high:
            continue
        most, fewest = max(lows), min(lows)
        for order, key, at in places:
            if order > most:  # all windows
                yield order, key, at - high, at - low + LENGTH
            elif order > fewest:
                begin = None
                for o, first in enumerate(lows, low):
                    if first < order:
                        begin = o if begin is None else begin
                        last = o
                    elif begin is not None:
                        yield order, key, at - last, at - begin + LENGTH
                        begin = None
                if begin is not None:
                    yield order, key, at - last, at - begin + LENGTH


def _lows(group: list[tuple[bytes, list[tuple[int, int, int]]]], firsts: list[int]) -> list[list[int]]:
    """Of each entry the smallest document that has the window, for each window that the entry holds."""
    if len(group) < MANY:
        least: dict[tuple[int, bytes], int] = {}
        keys = []
        for (entry, _), first in zip(group, firsts, strict=True):
            before = entry[LENGTH:-2]
            own = [(o, entry[: LENGTH - o] + before[:o]) for o in range(LENGTH - entry[-1], entry[-2] + 1)]
            keys.append(own)
            for k in own:
                if least.get(k, first) >= first:
                    least[k] = first
        return [[least[k] for k in own] for own in keys]
    rows = np.frombuffer(b"".join(e for e, _ in group), np.uint8).reshape(len(group), WIDTH)
    first, high, low = np.array(firsts, np.int64), rows[:, -2].astype(np.int64), LENGTH - rows[:, -1].astype(np.int64)
    # numbers of equal suffixes and of equal bytes before, by length: a window is a pair of them
    after, before = _numbers(rows[:, :LENGTH]), _numbers(rows[:, LENGTH : LENGTH + BEFORE])
    out: list[list[int]] = [[] for _ in group]
    for o in range(BEFORE + 1):
        has = np.flatnonzero((low <= o) & (o <= high))
        if len(has):
            same = after[LENGTH - o][has] * len(group) + (before[o][has] if o else 0)
            order = np.argsort(same, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
            lows = np.empty(len(has), np.int64)
            lows[order] = np.repeat(np.minimum.reduceat(first[has][order], edge), np.diff(np.append(edge, len(has))))
            for k, v in zip(has.tolist(), lows.tolist(), strict=True):
                out[k].append(v)
    return out


def _numbers(rows: np.ndarray) -> list[np.ndarray]:
    """For each length a number for each row, the same where the first so many bytes are."""
    order = np.lexsort(rows.T[::-1])
    sorted_ = rows[order]
    differ = sorted_[1:] != sorted_[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    out = []
    for n in range(rows.shape[1] + 1):
        number = np.empty(len(rows), np.int64)
        number[order] = np.concatenate(([0], np.cumsum(lcp < n)))
        out.append(number)
    return out


def _merged(n_docs: int):
    def merged(key: tuple, table: pa.Table) -> pa.Table:
        runs, payload = [], []
        for blob in table.column("blob"):
            lcp, rest, data, counts, own, places, orders, keys = _unpack(blob.as_py(), np.uint8, np.uint8, np.uint8, np.uint32, np.uint32, np.uint32, np.int64, np.int64)
            runs.append(Run(len(runs), lcp, rest, data.tobytes()))
            upto = [0, *np.cumsum(counts.astype(np.int64)).tolist()]
            payload.append((upto, own, places, orders, keys))
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple[bytes, list[tuple[int, int, int]]]] = []
        for entry, lcp, run, index in merge(runs):
            if lcp < GRAM and group:
                out.extend(covered(group))
                group = []
            upto, own, places, orders, keys = payload[run]
            i, j = upto[index], upto[index + 1]
            owners = own[i:j]
            found = list(zip(orders[owners].tolist(), keys[owners].tolist(), places[i:j].tolist(), strict=True))
            if group and lcp == len(entry) == len(group[-1][0]):
                group[-1][1].extend(found)
            else:
                group.append((entry, found))
        out.extend(covered(group))
        a = np.array(out, np.int64).reshape(-1, 4)
        to = _doc_bucket(np.ascontiguousarray(a[:, 1]), n_docs)
        order = np.lexsort((a[:, 2], a[:, 1], to))
        a, to = a[order], to[order]
        return pa.Table.from_batches([_rows([(b, _pack(np.ascontiguousarray(a[i:j, 0]), np.ascontiguousarray(a[i:j, 1]), a[i:j, 2].astype(np.uint32), a[i:j, 3].astype(np.uint32))) for b, i, j in _slices(to)])])

    return merged


_MARKED = "order long, key long, text binary, marks binary"


def _mark(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket first the blobs, then the texts: those that have one of the hashes, with their places."""
    wanted: dict[tuple[int, int], list[np.ndarray]] = {}
    bucket = None
    for batch in batches:
        out = []
        for b, blob, o, k, t, twin in zip(batch.column("bucket").to_pylist(), batch.column("blob"), batch.column("order").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), batch.column("twin").to_pylist(), strict=True):
            if b != bucket:
                bucket, wanted = b, {}
            if blob.is_valid:
                short, own, orders, keys, of = _unpack(blob.as_py(), np.uint8, np.uint32, np.int64, np.int64, np.int64)
                order = np.argsort(own, kind="stable")
                h = (_long(short) | np.uint64(int(of[0]) << 40))[order]
                for d, i, j in _slices(own[order]):
                    wanted.setdefault((int(orders[d]), int(keys[d])), []).append(h[i:j])
            elif found := wanted.pop((twin, k), None):  # the first of equal texts, that of the smallest id
                text = t.as_py()
                at, h = anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))
                full = h & np.uint64((1 << 40) - 1) | _bucket(h, n).astype(np.uint64) << np.uint64(40)
                out.append((o, k, text, at[np.isin(full, np.concatenate(found))].astype(np.uint32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["order", "key", "text", "marks"])


def union_of(spans: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint, not touching spans that cover the same, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Of each bucket first the intervals, then the texts: what they keep."""
    spans: dict[tuple[int, int], list[np.ndarray]] = {}
    done: set[tuple[int, int]] = set()
    bucket = None
    for batch in batches:
        out = []
        for b, blob, o, k, t in zip(batch.column("bucket").to_pylist(), batch.column("blob"), batch.column("order").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
            if b != bucket:
                bucket, spans, done = b, {}, set()
            if blob.is_valid:
                orders, keys, begin, end = _unpack(blob.as_py(), np.int64, np.int64, np.uint32, np.uint32)
                for _, i, j in _slices(keys):
                    for o2 in set(orders[i:j].tolist()):
                        own = orders[i:j] == o2
                        spans.setdefault((o2, int(keys[i])), []).append(np.stack([begin[i:j][own], end[i:j][own]], 1).astype(np.int64))
            elif (found := spans.get((o, k))) and (o, k) not in done:
                done.add((o, k))  # a row that is there several times has one result
                text, parts, at = t.as_py(), [], 0
                cuts = union_of(np.concatenate(found))
                for i, j in cuts:
                    parts.append(text[at:i])
                    at = j
                kept = b"".join([*parts, text[at:]])
                out.append((o, k, len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if texts else None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["order", "key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _by_bucket(blobs: DataFrame, docs: DataFrame, n: int, passed) -> DataFrame:
    """Blobs and the documents they are for meet in a task, the blobs of each bucket first, and are streamed through."""
    own = docs.select(F.pmod("key", F.lit(n)).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("blob"), "order", "key", "text", "twin", F.lit(1).alias("kind"))  # as _doc_bucket
    zero = F.lit(0).cast("long")
    both = blobs.select("bucket", "blob", zero.alias("order"), zero.alias("key"), F.lit(None).cast("binary").alias("text"), zero.alias("twin"), F.lit(0).alias("kind")).unionByName(own)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "order").mapInArrow(*passed)


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts those alone whose id is smaller than all before in this task: a hot text is exchanged a few times
    a task, and its first document always is."""
    least: dict[tuple[int, int], int] = {}
    for batch in batches:
        keep = []
        for o, k, twin in zip(*[batch.column(c).to_pylist() for c in ("order", "key", "twin")], strict=True):
            keep.append(least.get((twin, k), o + 1) > o)
            if keep[-1]:
                least[twin, k] = o
        yield batch.filter(pa.array(keep, pa.bool_()))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """order, key, digest, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left), kept (these as text,
    without characters that were cut in two; null where the text stays whole or goes whole, or if texts aren't asked
    for) for each row.

    Null texts are empty. Texts that a smaller document has whole go whole, and only one of each is sorted. Rows with
    the same id never remove from each other; null ids count as larger than all. Texts of under LENGTH bytes stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("order"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    firsts = written(rows.where(f"n_bytes >= {LENGTH}").groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n")), "first-copies")
    copies = firsts.where("n > 1").select("digest", "first")
    sha = F.sha2(text, 256)
    own = docs.where(F.octet_length(text) >= LENGTH).select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("order"), F.xxhash64(sha, F.lit(1)).alias("key"), text.alias("text"), F.xxhash64(sha, F.lit(2)).alias("twin"))
    n = buckets(docs, text_col)
    # the blocks of postings know texts by two hashes of their digest: equal texts are one from here on
    posts = own.select(F.col("twin").alias("order"), "key", "text").mapInArrow(_post(n), "bucket int, blob binary")
    shared = posts.repartition(n, "bucket").groupBy("bucket").applyInArrow(_shared(n, n), "bucket int, blob binary")
    firsts_only = own.mapInArrow(_fewer, "order long, key long, text binary, twin long")
    marked = written(_by_bucket(shared, firsts_only, n, (_marker(n), _MARKED)), "suffixes")
    runs = marked.mapInArrow(_runs(n), "bucket int, blob binary")
    cover = runs.repartition(n, "bucket").groupBy("bucket").applyInArrow(_merged(n), "bucket int, blob binary")
    cut = written(_by_bucket(cover, marked.select("order", "key", "text", F.lit(0).cast("long").alias("twin")), n, (lambda batches: _cut(batches, texts), "order long, key long, n_removed long, n_spans long, kept_sha256 string, kept string")), "kept")
    discard(marked)
    out = rows.join(copies, "digest", "left").withColumn("key", F.xxhash64("digest", F.lit(1)))
    out = out.join(cut, ["order", "key"], "left")
    gone = F.col("first").isNotNull() & (F.col("order") > F.col("first"))
    return out.select(
        "order", "key", "digest", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"), F.when(~gone, F.col("kept")).alias("kept"),
    )


def _marker(n: int):
    def marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _mark(batches, n)

    return marker


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    kind = docs.schema[id_col].dataType
    out = repeated_spans(docs, id_col=id_col, text_col=text_col, texts=False)
    return out.select(F.when(F.col("order") < (1 << 63) - 1, F.col("order")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = None) -> DataFrame:
    """docs without the bytes that smaller documents have; those of which nothing is left go, texts that were empty
    before stay. A character that is cut in two goes whole. n_chars names a column of lengths to keep true."""
    big = F.lit((1 << 63) - 1)
    changed = repeated_spans(docs, id_col=id_col, text_col=text_col).where("n_removed > 0")
    changed = changed.select("order", "digest", "kept", (F.col("n_removed") == F.col("n_bytes")).alias("whole")).dropDuplicates(["order", "digest"]).select(F.struct("order", "digest").alias("of"), "kept", "whole")
    # the caller's columns stay in a struct, so that none of their names can clash
    row = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.coalesce(F.col(id_col).cast("long"), big).alias("order"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest")).alias("own"))
    out = row.join(changed, F.col("own") == F.col("of"), "left").where("whole is null or not whole")
    new = {text_col: F.coalesce(F.col("kept"), F.col(f"row.`{text_col}`"))}
    if n_chars:
        old = F.col(f"row.`{n_chars}`")
        new[n_chars] = F.when(F.col("kept").isNull(), old).otherwise(F.length("kept")).cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
