"""Versions in force at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the end of an interval that has none.
OPEN_END = "99999999"


def latest_as_of(versions: DataFrame, keys: list[str], date_col: str, as_of: Column, payload: list[str]) -> DataFrame:
    """The one version of each key with the largest date up to as_of; keys where several have it are left out.

    A maximum and the number of rows that have it, summed up before the exchange: no key's rows are sorted. Of a key the
    second aggregation sees a date once, so columns are picked one by one, and values of fixed width need no sort either.
    """
    d = F.col(date_col)
    own = versions.where(d <= as_of)
    grouped = own.groupBy(*keys, date_col).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in payload])
    best = grouped.groupBy(*keys).agg(F.max_by("_n", d).alias("_n"), F.max(d).alias("_d"), *[F.max_by(c, d).alias(c) for c in payload])
    return best.where("_n = 1").select(*keys, F.col("_d").alias(date_col), *payload)


def validity_intervals(versions: DataFrame, keys: list[str], date_col: str, ties: list[str]) -> DataFrame:
    """versions with valid_from, valid_to (yyyymmdd, both inclusive); the last one's end is open. ties orders versions
    of one date: the earlier of them end before they begin, and are never in force."""
    w = Window.partitionBy(*keys).orderBy(date_col, *ties)
    following = F.lead(date_col).over(w)
    out = versions.withColumn("valid_from", F.date_format(date_col, "yyyyMMdd"))
    return out.withColumn("valid_to", F.when(following.isNull(), OPEN_END).otherwise(F.date_format(F.date_sub(following.cast("date"), 1), "yyyyMMdd")))


def in_force(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Both ends are included; the open end is none. Days are yyyymmdd."""
    return (valid_from <= day) & ((valid_to == OPEN_END) | (valid_to >= day))


def coverage(value: Column) -> Column:
    """from and to of `from/to`; `..` is open."""
    part = lambda i: F.nullif(F.nullif(F.try_element_at(F.split(value, "/"), F.lit(i)), F.lit("..")), F.lit(""))
    return F.struct(part(1).alias("from"), part(2).alias("to"))
