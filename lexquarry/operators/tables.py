"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame

from .index import shared_folder


#: Rows, about, that a task has of a table whose rows are sorted or held by their keys.
TASK_ROWS = 1 << 19


def parts(table: DataFrame) -> int:
    """So many partitions as keep a task's share of a table small, whatever the setting for shuffles is. Of a table in
    Parquet files the rows are counted by the files' footers."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(table.count() / TASK_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once: what reads them several times doesn't make them again, nor does a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
