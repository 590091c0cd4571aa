"""Language identification by compression.

Each language has a dictionary of raw text. All windows of a text are compressed with each, and the language with
the smallest sum wins; where the next one is hardly larger, the prediction is marked as rejected. Texts are reduced
to small letters first, so that capitals, figures and decoration neither help nor hide a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, uniform
from .compression import Compressors, windows

#: Rows of a language that its dictionary is made from (about), and bytes of the window that is drawn from each, at a
#: place by chance within its whole text: all that is drawn is in the dictionary.
TRAINING_ROWS, ROW_BYTES = 128, 512
WINDOW_BYTES = 2048
#: From this zstandard level on matches of few letters are found, which tell related languages apart.
LEVEL = 9

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A margin, in bytes, that is too narrow to tell languages apart.
NARROW = 2
#: What a text without letters has.
UNDETERMINED = "und"


def letters(text: str) -> bytes:
    """The words of a text in small letters, a space between them."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


class LanguageModel:
    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        self.compressors = Compressors([b" ".join(samples[k]) or b"\0" * 8 for k in self.languages], raw=True, level=LEVEL)

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """The language, the score in [0, 1] and whether the margin is narrow."""
        decoded = text.decode(errors="ignore")
        if not self.languages or not any(c.isalpha() for c in decoded):
            return UNDETERMINED, 0.0, True
        text = letters(decoded)
        total = np.zeros(len(self.languages))
        for w in windows(text, WINDOW_BYTES):
            total += self.compressors.lengths(w)
        order = np.argsort(total, kind="stable")
        more = total - total[order[0]]
        margin = more[order[1]] if len(order) > 1 else float("inf")
        return self.languages[order[0]], float(1 / np.exp(-np.minimum(more, 600) / 4).sum()), bool(margin < NARROW)


def train_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS) -> LanguageModel:
    """A dictionary for each language that any row names, from a bounded sample of its rows.

    Rows without text or language teach nothing. The number of rows of a language sets the share that is drawn, by a hash
    of id and text, so no language's rows meet in one task, and rows that share an id aren't drawn together.
    """
    own = docs.select(F.col(lang_col).alias("_lang"), uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col), "language").alias("_u"), F.col(text_col).alias("_text")).where("_lang is not null and _text is not null and _text <> ''")
    counts = {r[0]: r[1] for r in own.groupBy("_lang").count().collect()}
    if not counts:
        return LanguageModel({})
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(rows / n))])
    raw, at = F.col("_text").cast("binary"), uniform(F.col("_u"), "window")
    begin = F.floor(at * F.greatest(F.lit(1), F.octet_length(raw) - ROW_BYTES + 1)).cast("int") + 1
    drawn = own.where(F.col("_u") < share[F.col("_lang")]).select("_lang", "_u", F.substr(raw, begin, F.lit(ROW_BYTES)).alias("_text"))
    samples: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted((r._lang, r._u, bytes(r._text)) for r in drawn.collect()):
        samples[r[0]].append(letters(r[2].decode(errors="ignore")))
    return LanguageModel(samples)


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced); whole texts decide.

    Null, empty and letterless texts, and all texts if nothing was learned, have `und`, 0.0 and true. Ties go to the
    first language by name.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about TRAINING_ROWS * ROW_BYTES for each language
    out = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            found = [model.predict(t.as_py() or b"") for t in texts]
            more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return out.mapInArrow(identify, schema)
