"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import math
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts reach Python in batches of at most so many rows: the longest texts bound the memory, not the average.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, for columns of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where none is named a local master, whose
    executors are one process, has one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexquarry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: lineage ends here and lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut, as a Parquet table: column pruning and filters reach the later scans."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that was written, once all that reads it has been written itself."""
    spark = df.sparkSession
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over: Spark deletes them when the driver's garbage is collected,
    which in a long job may be much later than needed. What has just ended is still known to Spark's listeners for a
    moment, so they are waited for."""
    gc.collect()
    with contextlib.suppress(Py4JError):  # a wait for tidying up that takes too long is none of the caller's business
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row. A null id has the fold of the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text, at most about, whose hashes one bucket gets.
BUCKET_BYTES = 16 << 20


def buckets(docs: DataFrame, text_col: str) -> int:
    """As many as keep a bucket's share of the texts small, whatever the setting for shuffles is."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), math.ceil(size / BUCKET_BYTES))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    text = F.concat_ws("\x1f", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


__all__ = ["BATCH_ROWS", "buckets", "cut", "discard", "partitions", "release", "remainder", "shared_dir", "small_batches", "table", "uniform", "written"]
