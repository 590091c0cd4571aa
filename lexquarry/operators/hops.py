"""Lookups in several requests over tables of captured answers.

A chain is a table with a verdict for each row: null while it goes on. An answer that is missing or failed ends it as
`unavailable`, one that says there is nothing as what that means at this hop; later hops leave ended rows alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

OK, NOT_FOUND, LANGUAGE_UNAVAILABLE, UNAVAILABLE, CONTRACT = "ok", "not-found", "language-unavailable", "unavailable", "contract"


def decide(rows: DataFrame, verdict: Column) -> DataFrame:
    """The verdict of rows that have none yet; null leaves them open."""
    return rows.withColumn("verdict", F.coalesce("verdict", verdict))


def fetch(rows: DataFrame, payloads: DataFrame, request: Column, into: str, *, absent: str = NOT_FOUND, successes: tuple[int, int] = (200, 299)) -> DataFrame:
    """rows with the body of their request's answer as into. payloads: request, status, body; a request once.

    A row without a request is `not-found`; without an answer, as where transport failed, `unavailable`.
    """
    asked = rows.withColumn("_request", F.when(F.col("verdict").isNull(), request))
    answers = payloads.select(F.col("request").alias("_request"), F.col("status").alias("_status"), F.col("body").alias("_body"))
    out = asked.join(answers, "_request", "left")
    told = F.when(F.col("_request").isNull(), NOT_FOUND).when(F.col("_status").isNull(), UNAVAILABLE).when(F.col("_status") == 404, absent).when(~F.col("_status").between(*successes), UNAVAILABLE)
    out = out.withColumn("verdict", F.coalesce("verdict", told))
    return out.select(*rows.columns, F.when(F.col("verdict").isNull(), F.col("_body")).alias(into))


def asked_once(refs: DataFrame, asked: list[str], chain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ref_id and what the chain says of its row. The chain sees each different row of the asked columns once, with
    ref_id (its text) and an open verdict: a law that a third of all references name is looked up once."""
    key = F.to_json(F.struct(*asked))
    # different by all columns, so that what a task holds is what is asked, not rows sorted to find the first of each
    rows = refs.select(*asked).distinct().select(key.alias("ref_id"), "*").withColumn("verdict", F.lit(None).cast("string"))
    # both are tables, whose sizes are known: where they are small, the references aren't sorted, or sent around, to meet them
    found = stored(chain(stored(rows, "asked")), "found").withColumnRenamed("ref_id", "_asked")
    return refs.select("ref_id", key.alias("_asked")).join(found, "_asked").drop("_asked")
