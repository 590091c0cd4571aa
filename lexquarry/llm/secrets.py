"""Secret scans: fixed patterns, and the novelty of candidates to a primed compressor.

Three patterns find the usual forms. For what they miss, every long run of key characters, with letters and digits,
that has a sensitive word near it is measured: a zstandard compressor, primed with the corpus' most frequent identifiers, compresses the
surrounding text with and without the candidate. The difference is what the candidate adds: a name, a path or a word
that the identifiers or the surroundings explain adds little, a random string adds about all its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: The dictionary's identifiers and how long they are; the level of compression.
IDENTIFIERS, SHORTEST, LONGEST, LEVEL = 4096, 4, 24, 9
#: Groups that the counted identifiers are ranked in.
GROUPS = 16
#: Bytes on both sides that a candidate is compressed with, and in which a sensitive word makes it one.
AROUND, NEAR = 192, 64
#: A novel candidate adds so many compressed bytes, and so large a share of its own (random strings of 20 characters
#: add 0.65 to 1.5, four joined words 0.3 to 0.75); a longer one is measured in pieces of PIECE bytes.
LEAST_BYTES, LEAST_SHARE, PIECE = 12, 0.7, 4096

#: The patterns of the three kinds, over text whose A-Z is lower-cased for the first, and what a match
#: needs at least (characters of the value for the first, of the match for the others).
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal: a shorter one would fail
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

_KEYS = (b"passw", b"secret", b"token", b"api")
#: Words beside which a long string is suspicious.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key", "access key", "access_key", "accesskey", "private key", "private_key", "credential", "authorization", "bearer", "client_id", "signing key", "encryption key", "ssh-rsa", "connection string", "webhook")
_SENSITIVE = tuple(w.encode() for w in SENSITIVE)
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~-]{16,}")
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
KINDS = ("assign", "access", "hex", "novel")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("added_bytes", T.IntegerType())])


def identifiers(docs: DataFrame, *, text_col: str = "text", most: int = IDENTIFIERS) -> list[str]:
    """The runs of letters that most rows' texts have, counted over all texts; ties in their order. A run that a key
    of letters and digits contains is short, so that a key in many copies doesn't make itself known."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"[A-Za-z]{{{SHORTEST},}}"), F.lit(0)))).alias("w"))
    counted = found.where(F.length("w") <= LONGEST).groupBy("w").count()
    order = [F.col("count").desc(), F.col("w")]
    # the best of each of GROUPS groups, so that what reaches the driver doesn't grow with the number of tasks
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(GROUPS))).orderBy(*order))).where(F.col("k") <= most)
    return [r.w for r in best.orderBy(*order).limit(most).collect()]


class Novelty:
    """Compressed bytes that a candidate adds to what is around it. Pickled as the dictionary's bytes."""

    def __init__(self, words: list[str]):
        self.words = " ".join(reversed(words)).encode()  # the most frequent at the end, where matches are nearest
        self._made: zstd.ZstdCompressor | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _length(self, piece: bytes) -> int:
        if self._made is None:
            own = zstd.ZstdCompressionDict(self.words.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self._made = zstd.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(self._made.compress(piece))

    def added(self, text: bytes, start: int, end: int) -> int:
        own = text[start:end]  # where it stands a second time it doesn't explain itself
        before = text[max(0, start - AROUND - len(own)) : start].replace(own, b"")[-AROUND:]
        after = text[end : end + AROUND + len(own)].replace(own, b"")[:AROUND]
        total = 0
        for at in range(start, end, PIECE):
            piece = text[at : min(end, at + PIECE)]
            total += max(0, self._length(before + piece + after) - self._length(before + after))
            before = piece[-AROUND:]
        return total


def _patterns(text: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what the three patterns find."""
    out = []
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _novel(text: bytes, low: bytes, known: list[tuple[int, int, int]], novelty: Novelty) -> Iterator[tuple[int, int, int, int]]:
    """Candidates that no pattern has reached, beside a sensitive word, and that compress badly: (start, kind, end,
    bytes added)."""
    if not any(w in low for w in _SENSITIVE):
        return
    k, reached = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(known) and known[k][0] < end:
            reached = max(reached, known[k][2])
            k += 1
        if reached > start or not (_DIGIT.search(text, start, end) and _LETTER.search(text, start, end)):
            continue
        near = low[max(0, start - NEAR) : start] + b" " + low[end : end + NEAR]
        if any(w in near for w in _SENSITIVE):
            added = novelty.added(text, start, end)
            if added >= LEAST_BYTES and added >= LEAST_SHARE * (end - start):
                yield start, 3, end, added


def spans(text: bytes, novelty: Novelty) -> list[dict]:
    """All spans of a text, in code points, by start and then in the order of the kinds."""
    low = text.lower()  # of bytes: A-Z alone
    known = _patterns(text, low)
    found = sorted([(s, k, e, None) for s, k, e in known] + list(_novel(text, low, known, novelty)))
    out, at, chars = [], 0, 0  # positions in code points are counted from one span to the next
    for s, k, e, added in found:
        chars += len(text[at:s].decode(errors="replace"))
        at = s
        value = text[s:e].decode()  # these spans are ASCII
        out.append({"kind": KINDS[k], "start": chars, "end": chars + len(value), "value": value, "added_bytes": added})
    return out


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """id_col and secrets: for each row of docs the spans (kind, start, end, value, added_bytes) of its whole text.

    Kinds are `assign` (the whole match of name, sign and value), `access`, `hex` and `novel`; a pattern's span stays
    whatever its novelty is, and a novel one never overlaps a pattern's. Positions are code points, the end exclusive.
    Null and empty texts have none; rows and repeated ids stay as they are. words primes the compressor, the most
    frequent first; they are counted over docs where none are given.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Novelty(identifiers(docs, text_col=text_col) if words is None else words))  # at most IDENTIFIERS words of LONGEST bytes
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("secrets", T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("added_bytes", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = shared.value
        for batch in batches:
            found = [spans(t.as_py() or b"", novelty) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=[id_col, "secrets"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(scan, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    found = find_secrets(docs)
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
