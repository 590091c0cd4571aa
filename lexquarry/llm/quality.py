"""Quality classification by a sparse rule ensemble.

Shallow trees are grown on statistics of the texts; each path from a root is a conjunctive rule. A logistic model
with an L1 penalty gives most rules the weight 0; the others become one Spark column expression, so that scoring
is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import uniform

#: The classifier is fitted on at most about so many labelled rows, drawn by a hash of the id.
MAX_TRAINING_ROWS = 6000

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which hold


def statistics(text: Column) -> dict[str, Column]:
    """What the rules look at. Null counts as the empty text; ratios of empty texts are 0."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.split(F.regexp_replace(text, r"[\s]+", " "), " ")
    lines = F.split(text, "\n")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "word_length": n / n_words,
        "line_length": n / n_lines,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "symbols": without("#$%&*+<=>@[]^_{|}~\\/") / n,
        "stops": without(".,;:") / n,
        "shouts": without("!?") / n,
        "digits": without("0123456789") / n,
        "upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "beyond_ascii": (F.octet_length(text) - F.length(text)) / n,
    }


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        held = lambda rule: reduce(and_, [F.col(f"_{s}") <= t if op == "<=" else F.col(f"_{s}") > t for s, op, t in rule])
        z = reduce(add, [F.when(held(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)], F.lit(self.bias))
        return 1.0 / (1.0 + F.exp(-z))


def _bins(x: np.ndarray, n: int = 32) -> list[np.ndarray]:
    """Thresholds between neighbouring values at the quantiles of each column."""
    out = []
    for col in x.T:
        v = np.unique(np.quantile(col, np.linspace(0, 1, n + 1), method="lower"))
        out.append(((v[1:] + v[:-1]) / 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, least: int) -> list[list[tuple[int, str, float]]]:
    """The paths to all nodes but the root of a tree that lowers the squared error greedily."""
    paths: list[list[tuple[int, str, float]]] = []

    def split(rows: np.ndarray, path: list) -> None:
        if path:
            paths.append(path)
        if len(path) >= depth or len(rows) < 2 * least:
            return
        best = (1e-9, -1, 0.0)
        total, n = y[rows].sum(), len(rows)
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            if not len(cuts[f]):
                continue
            at = np.searchsorted(cuts[f], x[rows, f], side="left")  # x <= cuts[k] for all k >= at
            left_n = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
            left = np.cumsum(np.bincount(at, weights=y[rows], minlength=len(cuts[f]) + 1))[:-1]
            ok = (left_n >= least) & (n - left_n >= least)
            if ok.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float(cuts[f][k]))
        if best[1] >= 0:
            _, f, t = best
            under = x[rows, f] <= t
            split(rows[under], [*path, (f, "<=", t)])
            split(rows[~under], [*path, (f, ">", t)])

    split(np.arange(len(y)), [])
    return paths


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of a logistic model by accelerated proximal gradient steps; the bias bears no penalty."""
    n, m = a.shape
    full = np.hstack([a, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(full @ v) ** 2 / n + 1e-9)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ z, -30, 30))) - y) / n
        new = z - rate * grad
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:m], float(w[m])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Without rows of both labels the model has no rules, and its score is the share of label 1 (0.5 without rows)."""
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(set(y.tolist())) < 2:
        return RuleModel((), (), prior)
    rng = np.random.default_rng(seed)
    cuts = _bins(x)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, int(0.6 * len(y))), replace=False)
        for path in _grow(x[rows], y[rows], cuts, rng, depth, max(2, len(y) // 200)):
            rules[tuple(sorted({(names[f], op, t) for f, op, t in path}))] = None
    held = np.ones((len(y), len(rules)))
    for k, rule in enumerate(rules):
        for s, op, t in rule:
            held[:, k] *= (x[:, names.index(s)] <= t) if op == "<=" else (x[:, names.index(s)] > t)
    seen: dict[bytes, int] = {}
    own = [k for k in range(held.shape[1]) if 0 < held[:, k].mean() < 1 and seen.setdefault(held[:, k].tobytes(), k) == k]
    if not own:
        return RuleModel((), (), prior)
    listed = list(rules)
    w, bias = _lasso(held[:, own], y, penalty)
    kept = [(listed[k], float(v)) for k, v in zip(own, w, strict=True) if abs(v) > 1e-6]
    return RuleModel(tuple(r for r, _ in kept), tuple(v for _, v in kept), bias)


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> RuleModel:
    """Fit on a sample of the labelled rows of bounded size; only statistics, never texts, reach the driver.

    Rows without id, label or document teach nothing. An id that is there several times counts as often.
    """
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).where("_id is not null and _label in (0, 1)")
    n = labelled.count()
    sample = labelled if n <= max_rows else labelled.where(uniform(F.col("_id"), "quality") < max_rows / n)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id")
    rows = texts.select("_label", *[c.alias(f"_{s}") for s, c in statistics(F.col("_text")).items()]).collect()
    names = list(statistics(F.lit("")))
    rows.sort()
    data = np.array([list(r) for r in rows], float).reshape(len(rows), len(names) + 1)
    return fit_rules(data[:, 1:], data[:, 0], names)


def score_quality(docs: DataFrame, model: RuleModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score in [0, 1]; a column of that name is replaced. Null and empty texts are scored as empty."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != score_col])  # so that no name can clash with a statistic's
    with_stats = docs.select(own.alias("row"), *[c.alias(f"_{s}") for s, c in statistics(F.col(text_col)).items()])
    return with_stats.select("row.*", model.score().alias(score_col))


def keep_quality(docs: DataFrame, model: RuleModel, threshold: float, *, text_col: str = "text") -> DataFrame:
    """docs that score threshold or more.

    A filter on the score would be pushed below the statistics, and every rule would make its own again; it stops at
    a projection with a row number, which it therefore looks at.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    with_stats = docs.select(own, F.monotonically_increasing_id().alias("_row"), *[c.alias(f"_{s}") for s, c in statistics(F.col(text_col)).items()])
    return with_stats.where((model.score() >= threshold) & (F.col("_row") >= 0)).select("row.*")
