"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its pieces (sentences of paragraphs). Each piece is hashed to a wide vector of small
numbers, and the fingerprint is their sum modulo a power of two: the order of pieces doesn't matter, and pieces are
inserted and deleted by adding and subtracting their vectors. As the vectors of different pieces are almost
orthogonal, the cosine of two fingerprints estimates that of the multisets. Everything is Spark expressions.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Longs that are summed; each holds two lanes, and each lane is one component.
LONGS = 32
#: Components are summed modulo 2**BITS; a piece adds 0..255 to each, and 128 is taken off for each piece at the end.
BITS = 16
#: Bits of a lane of the running sum, and where the upper lane starts: the sum stays exact modulo 2**BITS.
_LANE, _UPPER = (1 << 24) - 1, 31
_BYTES = 0xFF | 0xFF << _UPPER
_LANES = _LANE | _LANE << _UPPER


def pieces(text: Column) -> Column:
    """Trimmed, not empty pieces: a line break or the white space after . ! or ? ends one. Null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?])\s+"), lambda p: p != "")


def vector_sum(parts: Column) -> Column:
    """The sums of the pieces' vectors, two components to a long, and as the last element the number of pieces."""
    of = lambda k: F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: (a + F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(_BYTES))).bitwiseAND(F.lit(_LANES)))
    return F.array(*[of(k) for k in range(LONGS)], F.size(parts).cast("long"))


def components(sums: Column) -> Column:
    """The 2 * LONGS components modulo 2**BITS, from -2**(BITS-1) to 2**(BITS-1) - 1."""
    n = F.element_at(sums, -1)
    half, mod = 1 << (BITS - 1), 1 << BITS
    # 128 n is a multiple of 2**BITS for every n * 128 that wraps: pmod is exact here
    lane = lambda x, shift: F.pmod(F.shiftright(x, shift).bitwiseAND(F.lit(_LANE)) - n * 128 + half, F.lit(mod)) - half
    longs = F.slice(sums, 1, LONGS)
    return F.flatten(F.transform(longs, lambda x: F.array(lane(x, 0), lane(x, _UPPER))))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The sums of two multisets together, or of a without b (sign -1): insertion and deletion of pieces."""
    lanes = lambda x, y: (x.bitwiseAND(F.lit(_LANE)) + y.bitwiseAND(F.lit(_LANE)) * sign).bitwiseAND(F.lit(_LANE))
    both = lambda x, y: lanes(x, y).bitwiseOR(F.shiftleft(lanes(F.shiftright(x, _UPPER), F.shiftright(y, _UPPER)), _UPPER))
    return F.concat(F.zip_with(F.slice(a, 1, LONGS), F.slice(b, 1, LONGS), both), F.array(F.element_at(a, -1) + F.element_at(b, -1) * sign))


def digest(comps: Column) -> Column:
    """The components as hex digits."""
    width = BITS // 4
    return F.array_join(F.transform(comps, lambda c: F.lower(F.lpad(F.hex(F.pmod(c, F.lit(1 << BITS))), width, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The cosine of two fingerprints' components, 0 if negative; of two texts without pieces 1, of one and another 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    aa, bb = dot(a, a), dot(b, b)
    return F.when(a == b, 1.0).when((aa == 0) | (bb == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(aa * bb))))


def fingerprint(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint; a column of that name is replaced. Null and empty texts: that of no pieces."""
    own = docs.drop(out_col).columns
    rows = docs.drop(out_col).withColumn("_pieces", pieces(F.col(text_col))).select(*own, vector_sum(F.col("_pieces")).alias("_sums"))
    return rows.select(*own, components(F.col("_sums")).alias("_own")).select(*own, digest(F.col("_own")).alias(out_col))


def with_next(docs: DataFrame, *, id_col: str, carried: list[str]) -> DataFrame:
    """docs with next_<c> for each carried column: of the next row in descending order of the id, of the first row
    after the last. Null ids come last; rows of one id follow each other in the order of the carried columns.

    Rows are dealt by ranges of the id. The last row of a range needs the first one of the next: those rows go to
    both, so that no task sees more than its range.
    """
    key = F.col(id_col)
    n = max(1, partitions(docs.sparkSession))
    bounds = sorted(set(docs.where(key.isNotNull()).approxQuantile(id_col, [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    cuts = [int(b) for b in bounds]
    bucket = F.when(key.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<long>"), lambda c: c < key)))
    dealt = docs.withColumn("_bucket", bucket.cast("int"))
    firsts = {r[0]: r[1] for r in dealt.groupBy("_bucket").agg(F.max(id_col)).collect()}  # a row for each range
    order = sorted(firsts, reverse=True)
    if not order:
        return dealt.drop("_bucket").withColumns({f"next_{c}": F.col(c) for c in carried})
    # the first row of each range is also seen, as a helper, by the range before it; that of the first by the last
    before = dict(itertools.pairwise([order[-1], *order]))
    to = {b: a for a, b in before.items()}
    helper = F.lit(None).cast("int")
    for b in order:
        same = key == F.lit(firsts[b]) if firsts[b] is not None else key.isNull()
        helper = F.when((F.col("_bucket") == b) & same, F.lit(to[b])).otherwise(helper)
    return _lead(dealt.withColumn("_to", helper), id_col, carried, n)


def _lead(dealt: DataFrame, id_col: str, carried: list[str], n: int) -> DataFrame:
    from pyspark.sql import Window

    own = [c for c in dealt.columns if c not in ("_bucket", "_to")]
    rows = dealt.withColumn("_copies", F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("h")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("h")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("h")))))
    rows = rows.withColumn("_copy", F.explode("_copies")).select(*own, F.col("_copy.b").alias("_bucket"), F.col("_copy.h").alias("_helper"))
    ordered = [F.col("_helper"), F.col(id_col).desc_nulls_last(), *[F.col(c) for c in carried if c != id_col]]
    w = Window.partitionBy("_bucket").orderBy(*ordered)
    out = rows.repartition(n, "_bucket").withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return out.where("_helper = 0").drop("_bucket", "_helper")


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points replaced by as many (or all) of the first of the next text.
    A null text is empty; a single row is its own next one.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # each step is a column of its own, so that no lambda makes it again for every element
    rows = rows.withColumn("_pieces", pieces(F.col("_text"))).select("_id", "_text", vector_sum(F.col("_pieces")).alias("_sums"))
    rows = with_next(rows, id_col="_id", carried=["_text", "_sums"])
    half = F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 2) as int))"), F.col("next__text").substr(F.lit(1), half))
    rows = rows.select("_id", F.length("_text").cast("long").alias("n_chars"), edited.alias("_edited"), components(F.col("_sums")).alias("_own"), components(F.col("next__sums")).alias("_next"))
    rows = rows.select("*", pieces(F.col("_edited")).alias("_pieces")).select("_id", "n_chars", "_edited", "_own", "_next", vector_sum(F.col("_pieces")).alias("_sums"))
    rows = rows.select("_id", "n_chars", "_edited", "_own", "_next", components(F.col("_sums")).alias("_new"))
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("_own")).alias("fingerprint"),
        digest(F.col("_new")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
