"""The EU act index: entries from pages of works, their checks, the stored form, and what reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import parse_celex
from ..functions.languages import is_cellar

SCHEMA_VERSION = 1
ENTRY = "celex string, documentType string, year string, number string, titlesByLanguage map<string,string>, availableLanguages array<string>"
STORED = f"schemaVersion int, lastSyncCheckpoint string, generatedAt string, entries array<struct<{ENTRY.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array')}>>"
_WORK = r"\Ahttps?:[^<>\s]+\z"


def entry_violation(celex: Column, document_type: Column, year: Column, number: Column, titles: Column, languages: Column) -> Column:
    """Why an entry isn't admitted, by the first rule that it breaks; null if it is."""
    parsed = parse_celex(celex)
    return (
        F.when(celex.isNull(), "celex").when(parsed.isNull(), "scope").when(~F.coalesce(document_type == parsed["document_type"], F.lit(False)), "document-type")
        .when(~F.coalesce(year == parsed["year"], F.lit(False)), "year").when(~F.coalesce(number == parsed["number"], F.lit(False)), "number")
        .when(titles.isNull() | F.exists(F.map_keys(titles), lambda k: ~is_cellar(k)), "title-language").when(F.exists(F.map_values(titles), lambda t: t.isNull()), "title")
        .when(languages.isNull() | F.exists(languages, lambda c: ~is_cellar(c)), "language")
    )


def entry_of(celex: Column, titles: Column, languages: Column) -> Column:
    """The entry of an act: type, year and number from its CELEX number, languages distinct and sorted."""
    parsed = parse_celex(celex)
    return F.struct(celex.alias("celex"), parsed["document_type"].alias("documentType"), parsed["year"].alias("year"), parsed["number"].alias("number"), titles.alias("titlesByLanguage"), F.array_sort(F.array_distinct(languages)).alias("availableLanguages"))


def is_checkpoint(value: Column) -> Column:
    """Null, or a time in ISO form with a T."""
    return value.isNull() | (value.contains("T") & value.try_cast("timestamp").isNotNull())


def parse_stored(rows: DataFrame, raw: str, key: str) -> DataFrame:
    """key, status, last_sync, entries of each stored index (JSON): `ok`, or why it can't be loaded (entries is null then).

    An index is taken whole or not at all: one bad entry, two of one CELEX number, another version or a checkpoint that
    is no time reject it. Whoever wants the last known good one falls back on null.
    """
    parsed = rows.select(F.col(key), F.from_json(raw, STORED).alias("x"))
    e = lambda c: entry_violation(c["celex"], c["documentType"], c["year"], c["number"], c["titlesByLanguage"], c["availableLanguages"])
    bad = F.try_element_at(F.filter(F.transform("x.entries", e), lambda v: v.isNotNull()), F.lit(1))
    celexes = F.transform("x.entries", lambda c: c["celex"])
    status = (
        F.when(F.col("x").isNull(), "malformed").when(~F.col("x.schemaVersion").eqNullSafe(SCHEMA_VERSION), "version").when(F.col("x.entries").isNull(), "entries").when(bad.isNotNull(), F.concat(F.lit("entry-"), bad))
        .when(F.size(F.array_distinct(celexes)) < F.size(celexes), "duplicate").when(~is_checkpoint(F.col("x.lastSyncCheckpoint")), "checkpoint").otherwise("ok")
    )
    out = parsed.select(key, status.alias("status"), "x")
    return out.select(key, "status", F.col("x.lastSyncCheckpoint").alias("last_sync"), F.when(F.col("status") == "ok", F.col("x.entries")).alias("entries"))


def stored(entries: DataFrame, last_sync: Column, generated_at: Column) -> DataFrame:
    """stored: one row, the index as JSON, entries by CELEX number. For files that one reader takes whole."""
    own = entries.agg(F.array_sort(F.collect_list(F.struct("celex", "documentType", "year", "number", "titlesByLanguage", "availableLanguages")), lambda a, b: F.when(a["celex"] < b["celex"], -1).otherwise(1)).alias("entries"))
    return own.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), last_sync.alias("lastSyncCheckpoint"), generated_at.alias("generatedAt"), "entries")).alias("stored"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of those that several rows have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def enriched_works(identities: DataFrame, rows: DataFrame) -> DataFrame:
    """page, status, work, celex, document_type, year, number, languages.

    identities: page, work, work_id (`celex:` and the number). rows: page, work, language (any case). Works without
    rows have no languages. A bad identity, a language of other than three letters, or a row of a work that the page
    doesn't have, makes the whole page `contract`, with no languages.
    """
    celex = F.when(F.col("work_id").startswith("celex:"), F.substring("work_id", 7, 64))
    own = identities.select("page", "work", celex.alias("celex")).withColumn("_p", parse_celex(F.col("celex")))
    own = own.withColumn("_bad", ~F.coalesce(F.col("work").rlike(_WORK) & F.col("_p").isNotNull(), F.lit(False)))
    known = own.select("page", F.col("work").alias("_w")).distinct()
    lang = F.lower("language")
    seen = rows.join(known, (rows["page"] == known["page"]) & (rows["work"] == known["_w"]), "left").select(rows["page"], rows["work"], lang.alias("language"), (F.col("_w").isNull() | ~is_cellar(lang)).alias("_bad"))
    by_work = seen.groupBy("page", "work").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    bad = own.select("page", "_bad").unionByName(seen.select("page", "_bad")).groupBy("page").agg(F.max("_bad").alias("_any"))
    out = own.join(by_work, ["page", "work"], "left").join(bad, "page")
    languages = F.coalesce("languages", F.array().cast("array<string>"))
    return out.select("page", F.when(F.col("_any"), "contract").otherwise("ok").alias("status"), "work", "celex", F.col("_p.document_type").alias("document_type"), F.col("_p.year").alias("year"), F.col("_p.number").alias("number"), F.when(~F.col("_any"), languages).alias("languages"))


def merged_records(bindings: DataFrame) -> DataFrame:
    """celex, titles, languages: repeated rows of a work as one.

    bindings: ordinal, celex, languages (codes with white space between), title, title_language. Languages are united;
    of a language's titles the last row's counts; a title without a language of three letters counts as English on the
    work's first row only. Codes that aren't three letters are passed over.
    """
    codes = F.filter(F.transform(F.split(F.lower(F.coalesce("languages", F.lit(""))), r"\s+"), lambda c: F.trim(c)), is_cellar)
    first = bindings.groupBy("celex").agg(F.min("ordinal").alias("_first"))
    titled = bindings.join(first, "celex").where("title <> ''")
    own = is_cellar(F.col("title_language"))
    key = F.when(own, F.col("title_language")).when(F.col("ordinal") == F.col("_first"), "eng")
    titles = titled.select("celex", key.alias("k"), "title", "ordinal").where("k is not null").groupBy("celex", "k").agg(F.max_by("title", "ordinal").alias("title"))
    maps = titles.groupBy("celex").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "title")))).alias("titles"))
    spoken = bindings.select("celex", codes.alias("c")).groupBy("celex").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("languages"))
    return spoken.join(maps, "celex", "left").select("celex", F.coalesce("titles", F.from_json(F.lit("{}"), "map<string,string>")).alias("titles"), "languages")


def cursor_regressions(pages: DataFrame) -> DataFrame:
    """page, problem: pages whose cursor (work_id, work) is missing or doesn't go on strictly behind the one before."""
    w = Window.partitionBy("run").orderBy("page")
    cursor = F.when(F.col("work_id").isNotNull() & F.col("work").isNotNull(), F.struct("work_id", "work"))
    both = pages.withColumn("_now", cursor).withColumn("_before", F.lag("_now").over(w))
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("_before").isNotNull() & ~(F.col("_now") > F.col("_before")), "regressed")
    return both.select("run", "page", problem.alias("problem")).where("problem is not null")


def rebuilt(records: DataFrame, pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The entries (celex, document_type, year, number, titles, languages) of a traversal, the last page's for each act.

    Raises where a page's cursor is missing or regressed, pages reach the limit, an entry isn't admitted, or nothing is
    there: an index is never replaced by an empty or partial one. records: page, celex, titles, languages.
    """
    if pages.join(cursor_regressions(pages), ["run", "page"], "left_semi").take(1):
        raise ValueError("a continuation cursor is missing or regressed")
    if max_pages is not None and pages.count() >= max_pages:
        raise ValueError("the page limit was reached")
    parsed = parse_celex(F.col("celex"))
    full = records.select("page", "celex", parsed["document_type"].alias("document_type"), parsed["year"].alias("year"), parsed["number"].alias("number"), "titles", F.array_sort(F.array_distinct("languages")).alias("languages"))
    if full.where(entry_violation(*[F.col(c) for c in ("celex", "document_type", "year", "number", "titles", "languages")]).isNotNull()).take(1):
        raise ValueError("an entry isn't admitted")
    if not full.take(1):
        raise ValueError("the index would be empty")
    rest = ["document_type", "year", "number", "titles", "languages"]
    return full.groupBy("celex").agg(F.max_by(F.struct(*rest), "page").alias("_x")).select("celex", *[F.col(f"_x.{c}").alias(c) for c in rest])


def is_fresh(last_sync: Column, now: Column, hours: int = 24) -> Column:
    """Whether the checkpoint is at most so many hours old; false if there is none or it can't be read."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_sync.try_cast("timestamp")) <= hours * 3_600_000_000, F.lit(False))


def entries_by_celex(refs: DataFrame, celex: Column, index: DataFrame) -> DataFrame:
    """refs joined with the entry of the number, in any case and with spaces around; entries are null if there is none."""
    entry = index.select(F.struct(*index.columns).alias("entry"), F.col("celex").alias("_key"))
    return refs.withColumn("_probe", F.upper(F.trim(celex))).join(entry, F.col("_probe") == F.col("_key"), "left").drop("_probe", "_key")


def search_index(index: DataFrame, query: str) -> DataFrame:
    """The entries that have the text in their number, year, CELEX number or a title, in any case; none for a blank text."""
    text = query.strip().lower()
    if not text:
        return index.where(F.lit(False))
    return index.where(F.lower("celex").contains(text) | F.col("year").contains(text) | F.col("number").contains(text) | F.exists(F.map_values("titles"), lambda t: F.lower(t).contains(text)))


def resolve_identity(refs: DataFrame, acts: DataFrame) -> DataFrame:
    """refs with act_celex and act_type: the act that all of a reference's marks agree on; null where they conflict.

    refs: jurisdiction, celex, law_code, document_type. acts: celex, aliases (codes and names), in any case. A number
    that no act of the table has stands for itself.
    """
    names = acts.select("celex", F.explode(F.array_union("aliases", F.array("celex"))).alias("a")).select("celex", F.upper(F.trim("a")).alias("_a")).distinct()
    unique = names.groupBy("_a").agg(F.min("celex").alias("_c"), F.count("*").alias("_n")).where("_n = 1").select("_a", "_c")
    code, number = F.upper(F.trim(refs["law_code"])), F.upper(F.trim(refs["celex"]))
    out = refs.withColumns({"_code": code, "_number": F.when(number != "", number)}).join(unique, F.col("_code") == F.col("_a"), "left")
    valid = lambda c: F.when(parse_celex(c).isNotNull(), c)
    by_code = F.coalesce(F.col("_c"), valid(F.col("_code")))
    found = F.when(F.col("_number").isNotNull(), valid(F.col("_number"))).otherwise(by_code)
    agrees = F.coalesce(by_code == found, F.lit(True)) & (F.col("document_type").isNull() | (F.substring(found, 6, 1) == F.col("document_type")))
    celex = F.when((F.col("jurisdiction") == "EU") & agrees, found)
    return out.select(*refs.columns, celex.alias("act_celex"), F.substring(celex, 6, 1).alias("act_type"))


def names_by_celex(acts: DataFrame) -> DataFrame:
    """celex, names: all aliases of an act, sorted."""
    return acts.select("celex", F.explode("aliases").alias("a")).groupBy("celex").agg(F.array_sort(F.collect_set("a")).alias("names"))
