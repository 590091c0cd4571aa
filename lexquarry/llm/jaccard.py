"""Set similarity join on word n-grams, exact, by the relations between sets.

1. Texts are shingled once. A set's hashes are exchanged in packed buckets, where each learns how many sets have it, and
   those that several have go back to their sets. A set of which fewer than the needed share are with others at all has
   no partner; with natural text nearly all go here, and only hashes that somebody shares are kept of the others.
2. Sets gather in frames: each is compared with the first sets of the index lists of its rarest and its least hashes, and
   joins one that it is broadly like. Rare hashes lead to sets changed in the same way, the least ones, a sketch that copies
   share, to all copies of a text, however they were changed. Frames are cut into blocks of a bounded size.
3. Index lists of first hashes (prefixes, rarest first) hold a row for each frame, not for each set. Cut by bands of
   sizes, and skipped by size and position of their blocks, they tell which different frames can have links.
4. Two blocks meet in a task, which has the answers of one set, its counts with all sets of the other block, and derives
   those of each similar set from them: only the hashes in which both differ from it are looked up. Links leave the task
   as a sum and a root for each set, never as pairs, so a large group of near copies costs rows by its size. A frame of
   one block is compared where it lies; of a larger one, tiles of TILE by TILE blocks are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, discard, partitions, small_batches, written
from .components import connected_components

SHINGLE, PERCENT = 4, 85
#: Similarity, in percent, with the first set of a frame that makes a set join it. It changes the cost and no result.
FRAME = 50
#: A set looks for frames in the lists of so many of its first hashes, and of its least ones.
LEADING, LEAST = 2, 6
#: Bytes of hashes in a block of a frame, entries of an index list that meet in one task, blocks that follow another.
FRAME_BYTES, LIST_ENTRIES, FOLLOWERS = 2 << 20, 4096, 64
#: Blocks of one frame that a task holds while others of it pass: a block is copied once for so many that it meets.
TILE = 16
#: Hashes that a task holds before it hands its buckets on.
HELD = 1_000_000
CACHED_WORDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _Hashes(dict):
    """Hashes of words, made when they are first met."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """The set of a text: sorted, distinct hashes."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self._known = size, _Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        toks = text.translate(_LOWER).split()
        if not toks:
            return np.zeros(0, np.uint64)
        if len(self._known) > CACHED_WORDS:
            self._known.clear()
        h = np.fromiter(map(self._known.__getitem__, toks), np.uint64, len(toks))
        n = min(self.size, len(h))
        m = len(h) - n + 1
        out = np.full(m, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + m]) * _ODD[k % 4]
            out ^= out >> np.uint64(31)
        out *= _ODD[0]
        out ^= out >> np.uint64(32)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def node_of(own: np.ndarray) -> bytes | None:
    """The same for equal sets; none for empty ones."""
    return xxhash.xxh128_digest(own.tobytes()) if len(own) else None


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """So many hashes of a set of n at least are in every similar set."""
    return (percent * n + 99) // 100


# the exchange of hashes


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _whole(low: np.ndarray, bucket: int, n: int) -> np.ndarray:
    """Hashes from the low bits that travelled and their bucket of n, which stands for the high ones: 16 bits, or as many
    more as there are buckets, which then tell as much as the bits whose place they take."""
    bits = max(16, (n - 1).bit_length())
    return low & np.uint64((1 << 64 - bits) - 1) | np.uint64(bucket << 64 - bits)


def _packed(arrays: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(len(x := a.tobytes()).to_bytes(8, "little") + x for a in arrays)


def _unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)])) if len(sorted_) else np.zeros(1, np.int64)


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


_OUT = ("bucket", "id", "node", "n", "blob", "first", "heads")


def _rows(schema: pa.Schema, **cols: list) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(list(zip(_OUT, (pa.int32(), id_type, pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)))


def _post(n: int, size: int):
    """A row (id, node, n) for each document, dealt out evenly, and the hashes of different sets in packed buckets."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, schema, dealt = Shingles(size), None, 0
        held: dict[bytes, np.ndarray] = {}
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            own = list(held.values())
            h = np.concatenate(own)
            owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
            bucket = _bucket(h, n)
            order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
            h, owner, bucket = h[order], owner[order], bucket[order]
            names, sizes = np.frombuffer(b"".join(held), "V16"), np.array([len(x) for x in own], np.uint32)
            edge, blobs, to = _edges(bucket), [], []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                e = _edges(owner[i:j])
                used = owner[i:j][e[:-1]]
                low = np.ascontiguousarray(h[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])  # the bucket tells the rest apart
                blobs.append(_packed((names[used], sizes[used], np.diff(e).astype(np.uint32), low)))
                to.append(int(bucket[i]))
            yield _rows(schema, bucket=to, blob=blobs)

        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            own = [shingles(t.as_py() or b"") for t in batch.column(1)]
            nodes = [node_of(s) for s in own]
            yield _rows(schema, bucket=[(dealt + k) % n for k in range(len(own))], id=batch.column(0), node=nodes, n=[len(s) for s in own])
            dealt += len(own)
            for node, s in zip(nodes, own, strict=True):
                if node is not None and node not in held:
                    held[node] = s
                    many += len(s)
                    if many >= HELD:
                        yield from flush()
                        held, many = {}, 0
        if held:
            yield from flush()

    return post


def _shared(n: int):
    """Of a bucket's hashes those that several sets have, with their number, back to the sets' own buckets."""

    def shared(group: pa.Table) -> pa.Table:
        rows = [group.filter(pa.compute.is_null(group.column("blob")))]
        blobs = group.column("blob").drop_null()
        if len(blobs):
            names, sizes, counts, lows = (np.concatenate(p) for p in zip(*[_unpacked(b.as_py(), "V16", "<u4", "<u4", "u1") for b in blobs], strict=True))
            wide = np.zeros((len(lows) // 6, 8), np.uint8)
            wide[:, :6] = lows.reshape(-1, 6)
            h = _whole(wide.view("<u8").ravel(), group.column("bucket")[0].as_py(), n)
            del wide, lows
            # a set that several tasks met counts once
            _, first = np.unique(names, return_index=True)
            first.sort()
            starts = np.cumsum(counts) - counts
            counts = counts[first].astype(np.int64)
            h = h[_gathered(starts[first].astype(np.int64), counts)]
            names, sizes = names[first], sizes[first]
            order = np.argsort(h, kind="stable")
            edge = _edges(h[order])
            often = np.empty(len(h), np.uint32)
            often[order] = np.repeat(np.diff(edge), np.diff(edge))
            keep = often > 1
            owner = np.repeat(np.arange(len(names)), counts)[keep]
            h, often = h[keep], often[keep]
            edge = _edges(owner)
            used, lengths = owner[edge[:-1]], np.diff(edge)
            to = names[used].view("<u8")[::2] % np.uint64(n) if len(used) else np.zeros(0, np.uint64)
            order = np.argsort(to, kind="stable")
            place = _edges(to[order])
            out_to, out = [], []
            for i, j in zip(place[:-1], place[1:], strict=True):
                mine = order[i:j]
                at = _gathered(edge[mine], lengths[mine])
                out_to.append(int(to[mine[0]]))
                out.append(_packed((names[used[mine]], sizes[used[mine]], lengths[mine].astype(np.uint32), h[at], often[at])))
            rows.append(pa.Table.from_batches([_rows(group.schema, bucket=out_to, blob=out)]))
        return pa.concat_tables(rows)

    return shared


def _viable(percent: int):
    """The sets of a bucket that can have partners: their shared hashes, rarest first, as first those of which every
    similar set has one, and as heads those in whose lists they look for frames."""

    def viable(group: pa.Table) -> pa.Table:
        rows = [group.filter(pa.compute.is_null(group.column("blob")))]
        blobs = group.column("blob").drop_null()
        if len(blobs):
            names, sizes, counts, h, often = (np.concatenate(p) for p in zip(*[_unpacked(b.as_py(), "V16", "<u4", "<u4", "<u8", "<u4") for b in blobs], strict=True))
            starts = np.cumsum(counts.astype(np.int64)) - counts
            order = np.argsort(names.view("<u8").reshape(-1, 2)[:, 0], kind="stable") if len(names) else np.zeros(0, np.int64)
            own: dict[bytes, list[int]] = {}
            for k in order.tolist():
                own.setdefault(names[k].tobytes(), []).append(k)
            nodes, ns, tokens, firsts, heads = [], [], [], [], []
            for node, parts in own.items():
                size = int(sizes[parts[0]])
                least, has = needed(size, percent), int(counts[parts].sum())
                if has < least:
                    continue
                at = np.concatenate([np.arange(starts[k], starts[k] + counts[k]) for k in parts])
                mine = h[at][np.lexsort((h[at], often[at]))]
                nodes.append(node)
                ns.append(size)
                tokens.append(mine.tobytes())
                firsts.append(mine[: has - least + 1].view(np.int64))
                heads.append(np.unique(np.concatenate((firsts[-1][:LEADING], np.sort(mine)[:LEAST].view(np.int64)))))
            rows.append(pa.Table.from_batches([_rows(group.schema, node=nodes, n=ns, blob=tokens, first=firsts, heads=heads)]))
        return pa.concat_tables(rows)

    return viable


# blocks of sets against blocks of sets


class Block:
    """Sets of a block by size: names, sizes and hashes."""

    def __init__(self, members: list[dict]):
        members = sorted(members, key=lambda m: (m["n"], m["node"]))
        self.names = [m["node"] for m in members]
        self.sizes = np.array([m["n"] for m in members], np.int64)
        own = [np.frombuffer(m["tokens"], "<u8") for m in members]
        self.tokens, self.owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.base = np.sort(own[0])

    def against(self, base: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each set its count with base, the places of base that it lacks, and its hashes that base lacks."""
        k, m = len(self.names), len(base)
        at = np.searchsorted(base, self.tokens)
        inside = base[np.minimum(at, m - 1)] == self.tokens if m else np.zeros(len(at), bool)
        has = np.zeros((k, m), bool)
        has[self.owner[inside], at[inside]] = True
        more = np.split(self.tokens[~inside], np.searchsorted(self.owner[~inside], np.arange(1, k)))
        return has.sum(1), [np.flatnonzero(~row) for row in has], more


def _lists(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An index: the values, where each one's list begins, and the lists, of numbers of parts."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    edge = _edges(values[order])
    return values[order][edge[:-1]], edge, owner[order]


def _looked_up(index: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    known, edge, owner = index
    if not len(known) or not len(values):
        return owner[:0]
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    at = at[known[at] == values]
    return owner[_gathered(edge[at], edge[at + 1] - edge[at])]


def matches(x: Block, y: Block, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set of x the sets of y that are similar; within one block the later ones alone.

    The answers of x's first set are counted once: how many of its hashes each set of y has. Another set's count is
    that, less what it lacks, and more what it and the sets of y both lack of the first one or both have beyond it.
    Sets of y lie by size, so those of no fitting size are skipped as blocks.
    """
    has_x, lacks_x, more_x = x.against(x.base)
    has_y, lacks_y, more_y = (has_x, lacks_x, more_x) if x is y else y.against(x.base)
    lack, more = _lists(lacks_y), _lists(more_y)
    for i in range(len(x.names)):
        n = x.sizes[i]
        lo = i + 1 if x is y else int(np.searchsorted(y.sizes, needed(n, percent)))
        hi = int(np.searchsorted(y.sizes, 100 * n // percent, side="right"))
        if lo >= hi:
            continue
        same = has_y - len(lacks_x[i])
        both = np.concatenate((_looked_up(lack, lacks_x[i]), _looked_up(more, more_x[i])))
        same = (same + np.bincount(both, minlength=len(y.names)))[lo:hi]
        found = np.flatnonzero(100 * same >= percent * (n + y.sizes[lo:hi] - same))
        if len(found):
            yield i, found + lo


def _counted(x: Block, y: Block, percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(node, the smallest node that links reach within the two blocks, number of links) of each set that has any."""
    first = len(x.names)
    names = [*x.names, *(() if x is y else y.names)]
    rank = np.argsort(np.argsort(np.array(names, object), kind="stable"))  # roots are compared as names are
    label, links = rank.copy(), np.zeros(len(names), np.int64)
    for i, found in matches(x, y, percent):
        other = found if x is y else found + first
        links[i] += len(other)
        links[other] += 1
        roots = np.unique(np.append(label[other], label[i]))
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]
    by_rank = np.argsort(rank)
    for k in np.flatnonzero(links).tolist():
        yield names[k], names[by_rank[label[k]]], int(links[k])


def _paired(x: Block, y: Block, percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    for i, found in matches(x, y, percent):
        for j in found.tolist():
            yield x.names[i], y.names[j], 1


def _alike(x: Block, y: Block, percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    """As _paired, for what is only to be broadly alike: the hashes that nobody else has don't count."""
    x.sizes, y.sizes = np.bincount(x.owner, minlength=len(x.names)), np.bincount(y.owner, minlength=len(y.names))
    has, _, _ = y.against(x.base)
    for j in np.flatnonzero(100 * has >= percent * (len(x.base) + y.sizes - has)).tolist():
        yield x.names[0], y.names[j], 1


_FOUND = "x binary, y binary, n long"


def _found(out: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["x", "y", "n"])


def _meet(how, percent: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group first a block, then those that it is to meet."""
        key = left = None
        for batch in batches:
            out: list[tuple[bytes, bytes, int]] = []
            for a, salt, b, members in zip(*[batch.column(c).to_pylist() for c in ("a", "salt", "b")], batch.column("members"), strict=True):
                if b is None:
                    key, left = (a, salt), Block(members.as_py())
                elif key == (a, salt):
                    out.extend(how(left, Block(members.as_py()), percent))
            yield _found(out)

    return meet


def _compared(pairs: DataFrame, blocks: DataFrame, how, percent: int) -> DataFrame:
    """x, y, n of all pairs (a, b) of blocks. A block that meets many is copied to a group for each FOLLOWERS of them."""
    often = pairs.groupBy("a").agg(F.count("*").alias("often"))
    salts = F.ceil(F.col("often") / FOLLOWERS).cast("int")
    right = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    right = right.join(blocks.withColumnRenamed("block", "b"), "b").select("a", "salt", "b", "members")
    left = often.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(blocks.withColumnRenamed("block", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "members")
    both = left.unionByName(right).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(_meet(how, percent), _FOUND)


def _alone(how, percent: int):
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block with itself."""
        for batch in batches:
            for members in batch.column("members"):
                block = Block(members.as_py())
                yield _found(list(how(block, block, percent)))

    return alone


def _tile(how, percent: int):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each tile first the blocks that are held, then those that pass; a tile of the diagonal has held ones alone."""
        key, held = None, []
        for batch in batches:
            for frame, row, col, passing, members in zip(*[batch.column(c).to_pylist() for c in ("frame", "row", "col", "passing")], batch.column("members"), strict=True):
                if key != (frame, row, col):
                    key, held = (frame, row, col), []
                block, out = Block(members.as_py()), []
                if passing or row == col:
                    for left in held:
                        out.extend(how(left, block, percent))
                if not passing:
                    if row == col:
                        out.extend(how(block, block, percent))
                    held.append(block)
                yield _found(out)

    return tile


def _within(blocks: DataFrame, how, percent: int) -> DataFrame:
    """x, y, n of all pairs of blocks of the same frame, and of each block with itself."""
    own = blocks.where("chunks = 1 and k > 1").select("members").mapInArrow(_alone(how, percent), _FOUND)
    many = blocks.where("chunks > 1").withColumn("at", F.floor(F.col("chunk") / TILE).cast("int"))
    last = F.floor((F.col("chunks") - 1) / TILE).cast("int")
    held = many.select("frame", F.col("at").alias("row"), F.explode(F.sequence("at", last)).alias("col"), F.lit(False).alias("passing"), "members")
    passing = many.where("at > 0").select("frame", F.explode(F.sequence(F.lit(0), F.col("at") - 1)).alias("row"), F.col("at").alias("col"), F.lit(True).alias("passing"), "members")
    tiles = held.unionByName(passing).repartition(partitions(blocks.sparkSession), "frame", "row", "col").sortWithinPartitions("frame", "row", "col", "passing")
    return own.unionByName(tiles.mapInArrow(_tile(how, percent), _FOUND))


# frames


def _single(sets: DataFrame) -> DataFrame:
    """Each set as a block of its own."""
    return sets.select(F.col("node").alias("block"), F.array(F.struct("node", "n", "tokens")).alias("members"))


def _frames(sets: DataFrame) -> DataFrame:
    """node, frame (the node of its first set) of each set."""
    heads = sets.select("node", "n", F.explode("heads").alias("token"))
    leaders = heads.groupBy("token").agg(F.min("node").alias("a"))
    pairs = heads.join(leaders, "token").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    blocks = _single(sets)
    near = cut(_compared(cut(pairs), blocks, _alike, FRAME).select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = near.select("a").distinct().join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    home = near.join(roots, "a").groupBy("b").agg(F.min("a").alias("frame"))
    # whoever is near sets of a frame alone is compared with its first set
    lost = near.join(home.select("b"), "b", "left_anti").join(home.select(F.col("b").alias("a"), "frame"), "a").select(F.col("frame").alias("a"), "b").distinct()
    more = _compared(cut(lost), blocks, _alike, FRAME).groupBy(F.col("y").alias("b")).agg(F.min("x").alias("frame"))
    found = home.unionByName(more).withColumnRenamed("b", "node")
    return cut(sets.select("node").join(found, "node", "left").select("node", F.coalesce("frame", "node").alias("frame")))


def _blocks(sets: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, block, chunk (its number), chunks (of the frame), k, members: the sets of a frame in blocks of about
    FRAME_BYTES."""
    size = F.octet_length("tokens") + 64
    chunks = sets.join(frames, "node").groupBy("frame").agg(F.ceil(F.sum(size) / FRAME_BYTES).cast("int").alias("chunks"))
    own = sets.join(frames, "node").join(chunks, "frame").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    # dealt by both: after the join a frame's sets lie in one task
    packed = own.repartition(partitions(sets.sparkSession), "frame", "chunk").groupBy("frame", "chunk").agg(F.max("chunks").alias("chunks"), F.collect_list(F.struct("node", "n", "tokens")).alias("members"))
    return packed.select("frame", F.concat("frame", F.hex("chunk").cast("binary")).alias("block"), F.col("chunk").cast("int").alias("chunk"), "chunks", F.size("members").alias("k"), "members")


def _frame_pairs(percent: int):
    def frame_pairs(table: pa.Table) -> pa.Table:
        """The different frames of a cell's index lists that can have links: lists by size, whose entries are skipped
        where sizes or positions rule a link out."""
        order = [(c, "ascending") for c in ("token", "band", "cell", "lo")]
        t = table.sort_by(order)
        cell = np.unique(np.stack([t.column(c).to_numpy() for c in ("token", "band", "cell")], 1), axis=0, return_inverse=True)[1].ravel() if len(t) else np.zeros(0, np.int64)
        lo, hi, room, guest, half = (t.column(c).to_numpy() for c in ("lo", "hi", "room", "guest", "half"))
        names = t.column("frame").to_pylist()
        _, number = np.unique(np.array(names, object), return_inverse=True)
        edge, found = _edges(cell), []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            for k in range(i, j - 1):
                upto = k + 1 + int(np.searchsorted(lo[k + 1 : j], 100 * hi[k] // percent, side="right"))  # behind it all are too large
                s = slice(k + 1, upto)
                good = (100 * hi[s] >= percent * lo[k]) & ((100 + percent) * np.minimum(room[s], room[k]) >= percent * (lo[s] + lo[k])) & (number[s] != number[k]) & ~(guest[s] & guest[k])
                if half[k] >= 0:
                    good &= (half[s] != half[k]) | (half[s] < 0)
                at = np.flatnonzero(good) + k + 1
                if len(at):
                    found.append(np.stack([np.minimum(number[at], number[k]), np.maximum(number[at], number[k])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        by_number = dict(zip(number.tolist(), names, strict=True))
        return pa.table({"a": pa.array([by_number[x] for x in pairs[:, 0].tolist()], pa.binary()), "b": pa.array([by_number[x] for x in pairs[:, 1].tolist()], pa.binary())})

    return frame_pairs


def _crossing(sets: DataFrame, frames: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: the pairs of different frames that can have links, each once.

    An entry of a list stands in the band of its size and, as a guest, in the next one, so similar sets meet. A list of
    over LIST_ENTRIES entries in a band is cut into parts that meet by twos, each pair of parts in a cell of its own.
    """
    width = math.log(100 / percent) * 1.000001 if percent < 100 else 1.0
    entries = sets.join(frames, "node").select("frame", "n", F.size("first").alias("k"), (F.col("n") - F.octet_length("tokens") / 8).cast("long").alias("alone"), F.posexplode("first").alias("place", "token"))
    room = (F.col("n") - F.col("alone") - F.col("place")).cast("long")
    own = entries.select("token", "frame", "n", room.alias("room"), F.floor(F.log("n") / width).cast("int").alias("band"))
    both = own.select("token", "frame", "n", "room", F.explode(F.array(F.struct("band", F.lit(False).alias("guest")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("guest")))).alias("at"))
    rows = both.groupBy("token", "at.band", "frame", "at.guest").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room"))
    rows = cut(rows)
    long_ = rows.groupBy("token", "band").agg(F.count("*").alias("many"), F.count_if(~F.col("guest")).alias("hosts")).where("many > 1 and hosts > 0")
    rows = rows.join(long_, ["token", "band"]).withColumn("parts", F.ceil(F.col("many") / LIST_ENTRIES).cast("int"))
    part = F.pmod(F.xxhash64("frame"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    # in a cell of two parts only entries of different parts meet; a part meets itself in a cell of its own
    rows = rows.select("token", "band", "frame", "guest", "lo", "hi", "room", cell.alias("cell"), F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("half"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("token", "band", "cell"), F.lit(n)).cast("int"))
    return rows.groupBy("bucket").applyInArrow(_frame_pairs(percent), "a binary, b binary").distinct()


def _similar(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, how) -> tuple[DataFrame, DataFrame]:
    """id, node, n of each row, and what how says of all pairs of blocks that can have links."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    n = buckets(rows, "text")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"bucket int, id {kind}, node binary, n long, blob binary, first array<long>, heads array<long>"
    posts = rows.mapInArrow(_post(n, size), schema).repartition(n, "bucket")
    shared = posts.groupBy("bucket").applyInArrow(_shared(n), schema).repartition(n, "bucket")
    passed = written(shared.groupBy("bucket").applyInArrow(_viable(percent), schema), "sets")
    sets = passed.where("blob is not null").select("node", "n", F.col("blob").alias("tokens"), "first", "heads")
    frames = _frames(sets)
    blocks = written(_blocks(sets, frames), "blocks")
    keys = blocks.select("frame", "block", "k")
    across = cut(_crossing(sets, frames, n, percent)).join(keys.select(F.col("frame").alias("a"), F.col("block").alias("x"), F.col("k").alias("kx")), "a").join(keys.select(F.col("frame").alias("b"), F.col("block").alias("y"), F.col("k").alias("ky")), "b")
    across = across.select(F.when(F.col("kx") >= F.col("ky"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("kx") >= F.col("ky"), F.col("y")).otherwise(F.col("x")).alias("b"))  # the smaller one travels
    met = _compared(cut(across), blocks.select("block", "members"), how, percent)
    found = written(_within(blocks, how, percent).unionByName(met), "links")
    discard(blocks)
    return passed.where("blob is null").select("id", "node", "n"), found


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """class_a, class_b (class_a < class_b): the links between different sets, each once. Equal sets are a class, named
    by its smallest id. The rows are as many as the links: the square of a large group of different near copies."""
    sets, links = _similar(docs, id_col, text_col, size, percent, _paired)
    firsts = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("id"))
    named = links.join(firsts.select(F.col("node").alias("x"), F.col("id").alias("_x")), "x").join(firsts.select(F.col("node").alias("y"), F.col("id").alias("_y")), "y")
    return named.select(F.least("_x", "_y").alias("class_a"), F.greatest("_x", "_y").alias("class_b"))


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach, its own included), class_id (the smallest id of
    an equal set) and n_links (with how many other sets its set is linked) for each row.

    Null and empty texts have no shingles, no links, and their own id. Rows of the same id and text have the same
    result. A row without an id links with nothing of its own; it has the class and component of rows with its very
    set, else null. Sets are known by hashes of 128 bits, shingles by such of 48 and more.
    """
    sets, found = _similar(docs, id_col, text_col, size, percent, _counted)
    degree = found.groupBy(F.col("x").alias("node")).agg(F.sum("n").alias("n_links"))
    linked = cut(connected_components(found.where("x <> y"), "x", "y"))
    firsts = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("class_id"))
    at = firsts.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = at.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_node = at.join(least, "component").join(degree, "node", "left").select("node", "class_id", "component_id", "n_links")
    out = sets.join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_shingles, component_id of jaccard_join."""
    return jaccard_join(docs, id_col=id_col, **how).select(id_col, "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each component, that of the smallest id. Rows that share an id stay or go together;
    rows without an id or without words stay."""
    found = jaccard_components(docs, id_col=id_col, **how)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct()
    return docs.alias("docs").join(gone.alias("gone"), F.col(f"docs.`{id_col}`") == F.col("gone.id"), "left_anti")
