"""A Merkle manifest of a dataset.

A row's leaf is the digest of its fields. The leaves of a source, in the order of their ids, are the lowest level of
a tree in which every ARITY consecutive nodes become the digest of their concatenation, until one is left; the roots
of the sources are the leaves of the last tree. Spark makes the leaves (a text is read once and never exchanged),
finds their places and packs aligned buckets of ARITY**HEIGHT of them. DuckDB runs the levels within buckets in the
executors, as ordered string_agg and sha256 over Arrow. Spark combines the buckets' roots and joins the outer steps
of the proofs.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, partitions, small_batches, written

#: Nodes that become one node, levels within a bucket, and levels that are counted at most (16**15 rows).
ARITY, HEIGHT, MOST_LEVELS = 16, 3, 15
SPAN = ARITY**HEIGHT

STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def row_digest(*fields: Column) -> Column:
    """SHA-256, in hex, of the fields one after another: each is its number of UTF-8 bytes, a colon and the value as
    text; null is a hyphen."""
    as_text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in as_text]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as one text, from the leaf's level to the root, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(n: Column) -> Column:
    """How often n nodes are combined until one is left."""
    out = F.lit(0)
    for k in range(MOST_LEVELS):
        out = out + (n > ARITY**k).cast("int")
    return out


def _placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows, as a written table, with _pos (the place within the group, from 0) and _n (the group's rows).

    Rows are dealt by ranges of the group and the order, so that a large group has many tasks; what is counted of
    each range and group gives the places. Rows that are equal in all of that are told apart by where they are read.
    """
    keys = [group, *order]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys, "_read").sortWithinPartitions(*keys, "_read")
    kept = written(dealt.select(*rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name)
    counts = kept.groupBy("_part", group).agg(F.count("*").alias("_own"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_own").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_own").over(Window.partitionBy(group)).alias("_n"))
    return kept.join(counts, ["_part", group]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _combined(nodes: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (_tree, _pos, _m nodes in the tree, _h), of at most top levels: the trees' roots (_tree,
    _h) and each node's steps (_tree, _pos, _steps)."""
    steps = nodes.select("_tree", "_pos", F.col("_pos").alias("_p"), F.lit(None).cast(STEPS).alias("_steps")).withColumn("_steps", F.array().cast(STEPS))
    for _ in range(top):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_h"))), lambda x: x["_h"]), "")
        runs = nodes.groupBy("_tree", F.expr(f"_pos div {ARITY}").alias("_up")).agg(joined.alias("_run"), F.max("_m").alias("_m"))
        alone = F.col("_m") == 1  # the tree has its root already
        runs = runs.select("_tree", "_up", "_run", "_m", F.when(alone, F.col("_run")).otherwise(F.sha2(F.col("_run").cast("binary"), 256)).alias("_h"))
        at = F.pmod(F.col("_p"), F.lit(ARITY)).cast("int") * 64
        own = F.struct(F.col("_run").substr(F.lit(1), at).alias("left"), F.col("_run").substr(at + 65, F.lit(64 * ARITY)).alias("right"))
        steps = steps.withColumn("_up", F.expr(f"_p div {ARITY}")).join(runs.select("_tree", "_up", "_run", "_m"), ["_tree", "_up"])
        steps = steps.select("_tree", "_pos", F.col("_up").alias("_p"), F.when(F.col("_m") == 1, F.col("_steps")).otherwise(F.concat("_steps", F.array(own))).alias("_steps"))
        nodes = runs.select("_tree", F.col("_up").alias("_pos"), F.ceil(F.col("_m") / ARITY).cast("long").alias("_m"), "_h")
    return nodes.select("_tree", "_h"), steps.select("_tree", "_pos", "_steps")


def _most(n: DataFrame, col: str) -> int:
    return int(n.agg(F.max(_levels(F.col(col)))).first()[0] or 0)


def _engine() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    return con


#: The leaves of the batch's buckets; _b numbers the buckets of the batch, _inner says how many levels they have.
_LEAVES = f"l0 AS MATERIALIZED (SELECT _b, _inner, CAST(r._pos % {SPAN} AS INT) AS p, lower(hex(r._leaf)) AS h, r FROM (SELECT _b, _inner, unnest(_rows) AS r FROM batch))"


def _level_queries() -> str:
    """For each level the runs r<k> of its nodes, and the nodes l<k> that they become. A bucket whose tree is lower
    keeps its only node."""
    return ", ".join(
        f"r{k} AS MATERIALIZED (SELECT _b, _inner, p // {ARITY} AS p, string_agg(h, '' ORDER BY p) AS run FROM l{k - 1} GROUP BY ALL), "
        f"l{k} AS (SELECT _b, _inner, p, CASE WHEN _inner >= {k} THEN sha256(run) ELSE run END AS h FROM r{k})"
        for k in range(1, HEIGHT + 1)
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of buckets that hold about SPAN leaves together, at most twice as many: a leaf's proof is many
    times its size, so what is made at once is bounded by leaves."""
    for got in batches:
        begun, held = 0, 0
        for i, n in enumerate(pc.list_value_length(got["_rows"]).to_pylist()):
            held += n
            if held >= SPAN or i == got.num_rows - 1:
                yield got.slice(begun, i + 1 - begun)
                begun, held = i + 1, 0


def _bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    for got in _parts(batches):
        batch = pa.table({"_b": pa.array(range(got.num_rows), pa.int64()), "_tree": got["_tree"], "_pos": got["_bucket"], "_m": got["_buckets"], "_inner": got["_inner"], "_rows": got["_rows"]})
        con.register("batch", batch)
        out = con.sql(f"WITH {_LEAVES}, {_level_queries()} SELECT batch._tree, batch._pos, batch._m, l{HEIGHT}.h AS _h FROM l{HEIGHT} JOIN batch USING (_b)").to_arrow_table()
        con.unregister("batch")
        yield from out.to_batches()


def _bucket_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    at = [f"64 * ((l0.p // {ARITY ** (k - 1)}) % {ARITY})" for k in range(1, HEIGHT + 1)]
    step = [f"CASE WHEN l0._inner >= {k} THEN [{{'left': left(r{k}.run, {a}), 'right': substr(r{k}.run, {a} + 65)}}] ELSE [] END" for k, a in enumerate(at, 1)]
    joins = " ".join(f"JOIN r{k} ON r{k}._b = l0._b AND r{k}.p = l0.p // {ARITY**k}" for k in range(1, HEIGHT + 1))
    for got in _parts(batches):
        batch = pa.table({"_b": pa.array(range(got.num_rows), pa.int64()), **{c: got[c] for c in ("_inner", "_rows", "_steps", "_subroot", "_root")}})
        con.register("batch", batch)
        out = con.sql(f"""WITH {_LEAVES}, {_level_queries()}
            SELECT l0.r._id AS _id, l0.h AS leaf, l0.r._other AS _other, _subroot AS subroot, _root AS root, list_concat({", ".join(step)}, _steps) AS proof
            FROM l0 {joins} JOIN batch ON batch._b = l0._b""").to_arrow_table()
        con.unregister("batch")
        yield from out.to_batches(max_chunksize=1024)


def merkle_manifest(docs: DataFrame, leaf: Column, *, id_col: str = "doc_id", source_col: str = "source", other: Column | None = None, other_col: str = "other") -> DataFrame:
    """id_col, leaf, subroot (of the source), root, and proof: an array of (left, right), the digests beside the
    node on its way from the leaf to the root. A node without neighbours adds a step with two empty texts.

    leaf is a row's digest in hex (see row_digest). other, another digest in hex of the same row, is carried as
    other_col, for instance to see whether it leads to the same root (see folded). The leaves of a source ascend by
    id, null first; rows of one id by their leaf. The null source comes before all others, which go by their bytes.
    An empty table has no rows and no root.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))  # in the order of the sources, never null
    rows = docs.select(tree.alias("_tree"), F.col(id_col).alias("_id"), F.unhex(leaf).alias("_leaf"), (F.lit(None).cast("string") if other is None else other).alias("_other"))
    leaves = written(rows, "leaves")  # from here on nothing reads a text
    placed = _placed(leaves, "_tree", ["_id", "_leaf"], "placed")
    packed = placed.groupBy("_tree", F.expr(f"_pos div {SPAN}").alias("_bucket")).agg(F.max("_n").alias("_n"), F.collect_list(F.struct("_pos", "_id", "_leaf", "_other")).alias("_rows"))
    levels = _levels(F.col("_n"))
    packed = packed.select("_tree", "_bucket", F.ceil(F.col("_n") / SPAN).cast("long").alias("_buckets"), F.least(levels, F.lit(HEIGHT)).alias("_inner"), "_rows")
    packed = written(packed, "buckets")
    discard(leaves)
    discard(placed)

    roots = written(packed.mapInArrow(_bucket_roots, "_tree string, _pos long, _m long, _h string"), "bucket-roots")
    subroots, inner_steps = _combined(roots, _most(roots, "_m"))
    tops = _placed(subroots.withColumn("_all", F.lit(0)), "_all", ["_tree"], "subroots")
    nodes = tops.select(F.col("_all").alias("_tree"), "_pos", F.col("_n").alias("_m"), "_h")
    top, outer_steps = _combined(nodes, _most(tops, "_n"))
    of_source = tops.join(outer_steps.select("_pos", F.col("_steps").alias("_outer")), "_pos").join(top.select(F.col("_tree").alias("_all"), F.col("_h").alias("_root")), "_all")
    of_source = of_source.select("_tree", F.col("_h").alias("_subroot"), "_outer", "_root")
    steps = inner_steps.join(of_source, "_tree").select("_tree", F.col("_pos").alias("_bucket"), F.concat("_steps", "_outer").alias("_steps"), "_subroot", "_root")
    schema = T.StructType([T.StructField("_id", id_type), *[T.StructField(c, T.StringType()) for c in ("leaf", "_other", "subroot", "root")], T.StructField("proof", STEPS)])
    out = packed.join(steps, ["_tree", "_bucket"]).select("_inner", "_rows", "_steps", "_subroot", "_root").mapInArrow(_bucket_proofs, schema)
    carried = [] if other is None else [F.col("_other").alias(other_col)]
    return out.select(F.col("_id").alias(id_col), "leaf", "subroot", "root", "proof", *carried)


def digest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """The query's rows: every fifth row (by crc32 of the id) is verified with its text's A-Z lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, row_digest(*[lowered if f == "text" else F.col(f) for f in fields]))
    got = merkle_manifest(docs.select(*fields), row_digest(*[F.col(f) for f in fields]), other=tampered, other_col="tampered")
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))
