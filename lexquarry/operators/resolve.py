"""Identity resolution: names to acts, only where that is unambiguous."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def resolve_alias(refs: DataFrame, code_col: str, acts: DataFrame) -> DataFrame:
    """refs with canonical (the act whose alias, in any case, the code is; else the code itself) and curated.

    acts: canonical, aliases. A code that is an alias of several acts has neither act: canonical is null, curated
    false. Every row of refs comes out once.
    """
    alias = acts.select("canonical", F.explode("aliases").alias("a")).select("canonical", F.upper(F.trim("a")).alias("a"))
    alias = alias.groupBy("a").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high")).select(F.struct("a", "low", (F.col("low") == F.col("high")).alias("one")).alias("_alias"))
    code = F.upper(F.trim(F.col(code_col)))
    joined = refs.join(alias, code == F.col("_alias.a"), "left")
    canonical = F.when(F.col("_alias").isNull(), code).when(F.col("_alias.one"), F.col("_alias.low"))
    return joined.select(*[refs[c] for c in refs.columns], canonical.alias("canonical"), F.coalesce(F.col("_alias.one"), F.lit(False)).alias("curated"))


def unique_titles(entries: DataFrame, title_col: str, id_col: str) -> DataFrame:
    """title, id: the normalised titles that one id alone has."""
    norm = F.regexp_replace(F.lower(F.trim(F.col(title_col))), r"\s+", " ")
    return entries.groupBy(norm.alias("title")).agg(F.min(id_col).alias("id"), F.max(id_col).alias("_hi")).where("title <> '' and id = _hi").select("title", "id")


def first_by_priority(rows: DataFrame, keys: list[str], priority: str, payload: list[str]) -> DataFrame:
    """For each key the payload of the lowest priority that has one (its first column is not null)."""
    return rows.where(F.col(payload[0]).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*payload, priority), F.col(priority)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in payload], F.col(f"_x.{priority}").alias(priority))


def marked_title(text: Column, languages: Sequence[Sequence[str]]) -> Column:
    """section and title of a citation: a marker, the article's number and the title, or the title first; else the whole
    text as the title, without section.

    languages: the markers of each language. The first language of which one form fits decides, the marker ahead of the
    title first; case and a dot behind the marker don't matter.
    """
    def cut(own: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("section"), own.alias("title"))
        for words in reversed(languages):
            mark = "(?:" + "|".join(re.escape(w) for w in words) + ")[.]?"
            forms = (rf"(?iu)\A{mark}\s*([0-9]+[a-z]?)\s+(.*)\z", 1, 2), (rf"(?iu)\A(.*?)\s+{mark}\s*([0-9]+[a-z]?)\z", 2, 1)
            for form, section, title in reversed(forms):
                out = F.when(own.rlike(form), F.struct(F.regexp_extract(own, form, section).alias("section"), F.regexp_extract(own, form, title).alias("title"))).otherwise(out)
        return out

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), cut)


def title_citations(refs: DataFrame, text_col: str, titles: DataFrame, languages: Sequence[Sequence[str]]) -> DataFrame:
    """refs with section and title_id: citations of an act, or of an article of it, by the act's official title.

    titles: title, id, as unique_titles makes them. languages: see marked_title. Null where nobody or several have the
    title; a title alone has no section.
    """
    own = marked_title(F.col(text_col), languages)
    out = refs.withColumn("_cited", own).withColumn("_title", F.nullif(F.lower(F.trim(F.regexp_replace(F.col("_cited.title"), r"\s+", " "))), F.lit("")))
    known = titles.select(F.struct("title", "id").alias("_t"))
    out = out.join(known, F.col("_title") == F.col("_t.title"), "left")
    return out.select(*refs.columns, F.when(F.col("_t").isNotNull(), F.col("_cited.section")).alias("section"), F.col("_t.id").alias("title_id"))


def exact_abbreviation(refs: DataFrame, code_col: str, results: DataFrame) -> DataFrame:
    """ref_id, and of its results the first, in their order, whose abbreviation is the code in any case.

    results: ref_id, ordinal, abbreviation, and whatever is to be taken over.
    """
    rest = [c for c in results.columns if c not in ("ref_id", "ordinal")]
    same = results.join(refs.select("ref_id", F.upper(F.col(code_col)).alias("_code")), "ref_id").where(F.upper("abbreviation") == F.col("_code"))
    best = same.groupBy("ref_id").agg(F.min_by(F.struct(*rest), "ordinal").alias("_x"))
    return best.select("ref_id", *[F.col(f"_x.{c}").alias(c) for c in rest])
