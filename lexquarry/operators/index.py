"""The act index: integrity, upserts, pages, and publication by two slots."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bijection_violations(rows: DataFrame, left: str, right: str) -> DataFrame:
    """side, value, partners: values of either side that stand for several of the other."""
    pairs = rows.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).distinct()
    one = pairs.groupBy(F.col("l").alias("value")).agg(F.count("*").alias("partners")).select(F.lit("left").alias("side"), "value", "partners")
    two = pairs.groupBy(F.col("r").alias("value")).agg(F.count("*").alias("partners")).select(F.lit("right").alias("side"), "value", "partners")
    return one.unionByName(two).where("partners > 1")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order of each key; keys without changes stay, nothing is deleted. Equal orders: the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def page_after(rows: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next rows in the order of keys after the cursor: a filter and a bounded top."""
    if cursor is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(c).alias(k) for c, k in zip(cursor, keys, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


def reachable(seeds: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys and node: all that undirected edges (a, b) lead to from the seeds (node), in each graph for itself: keys
    name the graph in both tables. Steps until nothing new is found, for all graphs at once; each step writes its new
    nodes to the shared folder and rewrites none of the earlier ones."""
    spark = seeds.sparkSession
    home = f"{shared_folder(spark)}/reachable-{uuid.uuid4().hex}"
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{home}/edges")
    both = spark.read.parquet(f"{home}/edges")
    own = [*keys, "node"]
    schema, step = seeds.select(*own).schema, 0
    seeds.select(*own).distinct().write.parquet(f"{home}/nodes/step=0")
    while True:
        frontier = spark.read.schema(schema).parquet(f"{home}/nodes/step={step}")
        if not frontier.take(1):
            return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/nodes")
        seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/nodes")
        new = frontier.join(both.withColumnRenamed("a", "node"), own).select(*keys, F.col("b").alias("node")).distinct().join(seen, own, "left_anti")
        step += 1
        new.write.parquet(f"{home}/nodes/step={step}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local master, whose executors are one process, has
    one of its own where none is named."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexquarry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def _kept(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Conflict(Exception):
    """Another writer was first."""


class SlotStore:
    """Two slots and a pointer in one folder: a candidate is written and read back before it becomes the active one.

    The pointer is a row of numbered files, of which the last one counts; a new state is a new file, renamed into its
    place, so that a crash at any time leaves the state before or behind it. A number is taken once: the renaming
    fails where another writer has published a state since this one read its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"pointer-([0-9]+)[.]json", n)))

    def _pointer(self) -> dict:
        return self._seen()[1]

    def _seen(self) -> tuple[int, dict]:
        """The number of the state that counts (0: there is none yet), and the state."""
        known = self._pointers()
        return (known[-1], json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/pointer-{known[-1]:09d}.json").collect()))) if known else (0, {})

    def _point(self, seen: int, state: dict) -> None:
        """Publish the state that follows the one with the number seen."""
        jvm = self.spark._jvm
        name = f"{self.path}/pointer-{seen + 1:09d}.json"
        fs, p = self._fs(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(p, self._fs(name)[1], self.spark.sparkContext._gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"another writer has published state {seen + 1}") from None
            raise
        for k in self._pointers():
            if k < seen:  # the state before stays
                fs.delete(self._fs(f"{self.path}/pointer-{k:09d}.json")[1], False)

    def read(self) -> DataFrame | None:
        active = self._pointer().get("active")
        return self.spark.read.parquet(f"{self.path}/{active}") if active else None

    @staticmethod
    def _sum(rows: DataFrame, columns: list[str]) -> list:
        """Number and hash sum of the rows, in any order: what tells a damaged copy."""
        own = F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in rows.select(*columns).dtypes])
        r = rows.agg(F.count("*"), F.sum(own.cast("decimal(38,0)"))).first()
        return [int(r[0]), str(r[1])]

    def write_candidate(self, rows: DataFrame) -> str:
        """Into the slot that isn't active; what is read back has to be what was written."""
        seen, state = self._seen()
        slot = "b" if state.get("active") == "a" else "a"
        rows = _kept(rows)
        rows.write.mode("overwrite").parquet(f"{self.path}/{slot}")
        wanted = self._sum(rows, rows.columns)
        if self._sum(self.spark.read.parquet(f"{self.path}/{slot}"), rows.columns) != wanted:
            raise ValueError("the candidate differs from what was written")
        self._point(seen, state | {"candidate": slot, "sum": wanted, "columns": rows.columns})
        return slot

    def activate(self) -> None:
        """The candidate becomes the active one if it still is what was written."""
        seen, state = self._seen()
        slot = state.get("candidate")
        if not slot:
            raise ValueError("there is no candidate")
        if self._sum(self.spark.read.parquet(f"{self.path}/{slot}"), state["columns"]) != state["sum"]:
            raise ValueError("the candidate changed since it was written")
        self._point(seen, {"active": slot})

    def discard(self) -> None:
        """Never touches the active slot."""
        seen, state = self._seen()
        slot = state.get("candidate")
        if slot and slot != state.get("active"):
            fs, p = self._fs(f"{self.path}/{slot}")
            fs.delete(p, True)
        self._point(seen, {k: v for k, v in state.items() if k not in ("candidate", "sum", "columns")})
