"""Toxicity by compression distance.

A text is rewritten as word codes (a digest of each word's stem and one of the word), so that a match in a
dictionary is a match of words and not of letters. Two zstandard dictionaries are made from labelled texts: one of
ordinary text, one of the same and, behind it, of the codes that toxic text has far more often. The window of a
text that compresses shorter with the toxic dictionary has toxic words; a logistic threshold over the gains of all
windows is calibrated on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, uniform
from .compression import Compressors, logistic

#: The dictionaries and the threshold are learned from at most about so many labelled rows, drawn by a hash of the id.
MAX_TRAINING_ROWS = 9000
#: Letters of a stem, words of a window, and what makes a code distinctive: the G statistic and the ratio of shares.
STEM, WINDOW_WORDS, LEAST_G, LEAST_LIFT = 5, 32, 24.0, 8.0
#: Codes in each dictionary at most, and words whose codes a worker keeps.
ORDINARY_CODES, TOXIC_CODES, CACHED_WORDS = 400, 1000, 200_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class WordCodes:
    def __init__(self) -> None:
        self._known: dict[bytes, bytes] = {}

    def __call__(self, text: bytes) -> list[bytes]:
        known, out = self._known, []
        for w in text.translate(_LETTERS).split():
            c = known.get(w)
            if c is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                c = known[w] = xxhash.xxh64_digest(w.decode(errors="ignore")[:STEM].encode() + b"*") + xxhash.xxh64_digest(w)
            out.append(c)
        return out


def _doc_counts(texts: list[bytes], codes: WordCodes) -> Counter:
    """In how many different texts each half code is: copies count once."""
    out: Counter = Counter()
    for t in sorted(set(texts)):
        own = set(codes(t))
        out.update({c[:8] for c in own} | {c[8:] for c in own})
    return out


def _g(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    both = (a + b) / (na + nb)
    part = lambda x, n: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / (n * both)), 0)
    return 2 * (part(a, na) + part(b, nb))


def dictionaries(toxic: list[bytes], ordinary: list[bytes], codes: WordCodes) -> list[bytes]:
    a, b = _doc_counts(toxic, codes), _doc_counts(ordinary, codes)
    na, nb = max(1, len(set(toxic))), max(1, len(set(ordinary)))
    common = b"".join(c for c, _ in sorted(b.items(), key=lambda x: (-x[1], x[0]))[:ORDINARY_CODES][::-1])
    listed = sorted(a)
    x, y = np.array([a[c] for c in listed], float), np.array([b[c] for c in listed], float)
    keep = (x / na >= LEAST_LIFT * (y + 0.5) / nb) & (_g(x, y, na, nb) >= LEAST_G) if listed else np.zeros(0, bool)
    own = sorted((int(n), c) for n, c, k in zip(x, listed, keep, strict=True) if k)[-TOXIC_CODES:]
    return [common + b"".join(c for _, c in own) or b"\0" * 8, common or b"\0" * 8]


def gains(text: bytes, codes: WordCodes, compressors: Compressors) -> list[float]:
    """What the score looks at: the best window, all windows, gain a word, length; of all windows of the text."""
    own = codes(text)
    best = total = 0
    for i in range(0, len(own), WINDOW_WORDS):
        toxic, ordinary = compressors.lengths(b"".join(own[i : i + WINDOW_WORDS]))
        best, total = max(best, ordinary - toxic), total + max(0, ordinary - toxic)
    return [float(np.log1p(best)), float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(own)))), float(np.log1p(len(own)))]


@dataclass(frozen=True)
class ToxicityModel:
    compressors: Compressors
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def score(self, features: list[float]) -> float:
        z = sum(w * (x - m) / s for w, x, m, s in zip(self.weights, features, self.mean, self.scale, strict=False)) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_toxicity(rows: list[tuple[str, bytes, int]]) -> ToxicityModel:
    """rows of (order, text, label). Half the rows make the dictionaries, the other half the threshold.

    Without rows of both labels every text has the share of label 1 as its score (0 without rows).
    """
    rows = sorted(rows)
    codes, learn, adjust = WordCodes(), rows[::2], rows[1::2] or rows
    compressors = Compressors(dictionaries([t for _, t, y in learn if y], [t for _, t, y in learn if not y], codes), raw=True)
    y = np.array([v for _, _, v in adjust], float)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel(compressors, (0.0,) * 4, (1.0,) * 4, (0.0,) * 4 + (float(np.log(share / (1 - share))),))
    x = np.array([gains(t, codes, compressors) for _, t, _ in adjust])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return ToxicityModel(compressors, tuple(mean), tuple(scale), tuple(logistic((x - mean) / scale, y)))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Rows without id, label or document teach nothing; a null text counts as empty."""
    labelled = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    n = labelled.count()
    order = uniform(F.col("_id"), "toxicity")
    sample = labelled if n <= max_rows else labelled.where(order < max_rows / n)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(sample, "_id")
    return fit_toxicity([(f"{r[0]:.15f}", bytes(r[1] or b""), r[2]) for r in texts.select(order, "_text", "_label").toLocalIterator()])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score in [0, 1] of each whole text; a column of that name is replaced, null is scored as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    out = docs.drop(score_col)
    schema = T.StructType([*out.schema.fields, T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = shared.value, WordCodes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            values = [model.score(gains(t.as_py() or b"", codes, model.compressors)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, score_col])

    return out.mapInArrow(score, schema)
