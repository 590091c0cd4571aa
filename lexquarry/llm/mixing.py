"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked, one margin after the
other, until the weighted margins are the targets; a document is then kept with a probability in proportion to its
cell's factor, with one constant for all cells, so that the sample has these margins too. Only cells, never documents,
take part in the iterations, and all of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, uniform, written

DIMENSIONS = ("source", "lang", "topic")
#: The relative error of the margins that is good enough, and rounds without a better one after which it won't fall.
TOLERANCE, PATIENCE = 1e-3, 5
#: How many times its own share of the tokens a default target may be.
LIFT = 8.0


def n_tokens(text: Column) -> Column:
    """White-space separated words; null and blank texts have none."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def form_topic(text: Column) -> Column:
    """A topic for corpora that have none: what form a text has."""
    n = F.length(F.coalesce(text, F.lit("")))
    bars = n - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("")))
    return F.when(bars * 50 > n, "table").when(n < 600, "note").when(n < 4000, "article").otherwise("book")


def balanced_targets(cells: DataFrame, dimension: str, power: float = 0.5, lift: float = LIFT) -> DataFrame:
    """value, share: each value's share of the tokens raised to power, so that large values give way to small ones, but
    never over lift times its own share: what that takes from the smallest values goes to the others in proportion.

    The margins of a sample without repeats are met only as far as the rarest value's documents go. Without the limit
    one short document that is alone in its topic would make the whole sample as small as itself, the more so the more
    documents there are. Rounds take the values over their limit out until no other one passes it: two sums each.
    """
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    total = _total(sums, "tokens") or 1.0
    raised = written(sums.select("value", F.pow("tokens", F.lit(power)).alias("raised"), (F.col("tokens") * F.lit(max(lift, 1.0) / total)).alias("most")), "targets")
    factor, limited = 0.0, -1
    while True:
        over = F.col("raised") * F.lit(factor) > F.col("most")
        found = raised.agg(F.sum(F.when(over, F.col("most"))).alias("held"), F.sum(F.when(~over, F.col("raised"))).alias("free"), F.count_if(over).alias("limited")).first()
        if found.limited == limited or not found.free:  # the limits only take values out, so the rounds end
            return raised.select("value", F.least(F.col("raised") * F.lit(factor), F.col("most")).alias("share"))
        factor, limited = (1 - (found.held or 0.0)) / found.free, found.limited


def _total(df: DataFrame, column: str) -> float:
    """A sum, as a number: no join of its one row."""
    return float(df.agg(F.sum(column).cast("double")).first()[0] or 0.0)


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with weight, raked tokens whose margins have the targets' shares and whose sum is 1, and margin_error, the
    largest relative error of a margin that is left.

    cells: the dimensions and tokens, a row for each. Shares of a margin should sum to 1; values without a target keep
    their weight, cells without tokens have the weight 0. The shares are joined to the cells once. A margin is a small
    aggregation, joined back; a round ends in a table, whose size Spark knows, so that no estimate is multiplied from
    round to round. It goes on until the error is within the tolerance or, where the targets can't all be met, has
    hardly fallen over PATIENCE rounds (or for so many rounds, if a number is given): margin_error tells.
    """
    dims = [d for d in DIMENSIONS if d in targets]
    now = cells.withColumn("weight", F.col("tokens") / F.lit(_total(cells, "tokens") or 1.0))
    for d in dims:
        aim = targets[d].select(F.col("value").alias("_w"), F.col("share").alias(f"_s_{d}"))
        now = now.join(aim, now[d].eqNullSafe(aim["_w"]), "left").drop("_w")
    now = written(now, "raking")
    best, waited, done = None, 0, 0
    while True:
        step = now.drop("margin_error")
        for d in dims:
            margin = step.groupBy(F.col(d).alias("_v")).agg(F.sum("weight").alias("_m"))
            step = step.join(margin, step[d].eqNullSafe(margin["_v"]))
            factor = F.when(F.col("_m") > 0, F.coalesce(F.col(f"_s_{d}") / F.col("_m"), F.lit(1.0))).otherwise(0.0)
            step = step.withColumn("_f", factor).withColumn("weight", F.col("weight") * F.col("_f")).withColumn(f"_e_{d}", F.when(F.col("_f") > 0, F.abs(1 - 1 / F.col("_f"))).otherwise(0.0)).drop("_v", "_m")
        step = step.withColumn("margin_error", F.greatest(*[F.col(f"_e_{d}") for d in dims], F.lit(0.0), F.lit(0.0))).select(*now.drop("margin_error").columns, "margin_error")
        before, now = now, written(step, "raking")
        error = now.agg(F.max("margin_error")).first()[0]
        discard(before)
        done += 1
        if error is None or error <= tolerance or done == rounds:
            break
        waited = 0 if best is None or error < best * 0.99 else waited + 1
        best = error if best is None else min(best, error)
        if waited >= PATIENCE:
            break
    return now.withColumn("weight", F.col("weight") / F.lit(_total(now, "weight") or 1.0)).withColumn("margin_error", F.lit(float(error or 0.0))).drop(*[f"_s_{d}" for d in dims])


def measured(docs: DataFrame, *, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """docs with n_tokens, and topic if one is given or there is none yet (n_tokens is replaced)."""
    topic = topic if topic is not None else (F.col("topic") if "topic" in docs.columns else form_topic(F.col(text_col)))
    return docs.withColumns({"topic": topic, "n_tokens": n_tokens(F.col(text_col))})


def mixing_weights(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = 0.5, lift: float = LIFT, counted: bool = False) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and margin_error (columns of these names are replaced).

    keep is the share of all tokens that the sample is to have at most: the factor of a cell is its raked share over
    its share of the tokens, a probability keep times that. Where the largest factor would pass 1 by that, all cells
    have the same smaller constant in place of keep, 1 over the largest factor: no probability is cut off, the margins
    of probability times tokens stay the targets, and the cell that needs it most is kept whole. Targets that are given
    are taken as they are; the default ones are balanced_targets, none over lift times its own share. Null sources and
    languages are values of their own. A document without tokens has the probability of its cell, 0 if the whole cell
    has no tokens. counted says that docs has topic and n_tokens, by measured(), and needs no text.
    """
    docs = docs.drop("weight", "probability", "margin_error")
    rows = docs if counted else measured(docs, text_col=text_col, topic=topic)
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = targets or {d: balanced_targets(cells, d, lift=lift) for d in DIMENSIONS}
    raked = rake(cells, targets)
    raked = raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(_total(cells, "tokens")) / F.col("tokens")).otherwise(0.0))
    largest = raked.agg(F.max("weight")).first()[0] or 0.0
    raked = raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(min(float(keep), 1 / largest) if largest else 0.0)))
    cell = F.struct(*DIMENSIONS)
    raked = written(raked.select(cell.alias("cell"), F.struct("weight", "probability", "margin_error").alias("found")), "raked")
    # the caller's columns stay in a struct, so that none of their names can clash with the cells'
    both = rows.select(F.struct(*rows.columns).alias("row"), cell.alias("own")).join(raked, F.col("own").eqNullSafe(F.col("cell")), "left")
    return both.select("row.*", "found.*")


def sampled(id_col: Column, probability: Column, seed: str = "mix") -> Column:
    """Whether a document is in the sample: depends on its id, the seed and its probability alone. Null ids are one id."""
    return uniform(F.coalesce(id_col.cast("string"), F.lit("")), seed) < probability


def mix(docs: DataFrame, *, id_col: str = "doc_id", seed: str = "mix", **how) -> DataFrame:
    """The sample, with topic, n_tokens, weight, probability and margin_error. Rows that share an id stay or go together
    if they are of one cell; an empty table gives an empty one."""
    out = mixing_weights(docs, id_col=id_col, **how)
    return out.where(sampled(F.col(id_col), F.col("probability"), seed))
