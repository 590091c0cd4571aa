"""Metadata search: tiers of matches, the first that applies, and a deterministic top k for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import collapsed, document_type_of, is_organisation, normalised, parse_celex


def structured_query(text: Column) -> Column:
    """document_type, year, number of a query like `2016/679`, `2016 679`, `Regulation 2016/679/EU` or `VO 2016`."""
    text = collapsed(text)
    sep = r"(?: ?[/-] ?| )"
    org = r"(?: ?/ ?([\p{L}\p{M}0-9]+))?"
    plain, typed = rf"\A([0-9]{{4}}){sep}([0-9]{{1,6}}){org}\z", rf"\A(.+?) ([0-9]{{4}})(?:{sep}([0-9]{{1,6}}){org})?\z"
    take = lambda p, i: F.regexp_extract(text, p, i)
    label = F.regexp_replace(normalised(take(typed, 1)), r"\.\z", "")
    kind = F.when(label == "vo", "R").when(label == "rl", "L").otherwise(document_type_of(take(typed, 1)))
    known = lambda c: (c == "") | is_organisation(c)
    parts = lambda k, y, n: F.struct(k.cast("string").alias("document_type"), y.alias("year"), F.nullif(n, F.lit("")).alias("number"))
    return F.when(text.rlike(plain), F.when(known(take(plain, 3)), parts(F.lit(None), take(plain, 1), take(plain, 2)))).when(text.rlike(typed) & known(take(typed, 4)) & kind.isNotNull(), parts(kind, take(typed, 2), take(typed, 3)))


def search_metadata(queries: DataFrame, entries: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, position, canonical_input, match_kind, rank, matched_title: the limit best entries of each query.

    queries: query_id, query, jurisdiction. entries: jurisdiction, canonical_input, title, aliases, alternate_titles,
    celex, year, number. Queries of under two characters find nothing, nor does a limit that isn't positive. The few
    queries go to all entries of their jurisdiction (an equi-join); a query's best entries are kept task by task
    before they meet. Ties are told apart by the canonical input.
    """
    q = queries.select("query_id", F.col("jurisdiction").alias("_j"), normalised(F.col("query")).alias("_q"), structured_query(F.col("query")).alias("_s")).where(F.length("_q") >= 2)
    norm = lambda xs: F.transform(F.coalesce(F.col(xs), F.array().cast("array<string>")), lambda x: F.struct(normalised(x).alias("n"), x.alias("t")))
    title = F.when(F.col("title").isNotNull(), F.array(F.struct(normalised(F.col("title")).alias("n"), F.col("title").alias("t")))).otherwise(F.array().cast("array<struct<n:string,t:string>>"))
    e = entries.select("*", norm("aliases").alias("_a"), F.concat(title, norm("alternate_titles")).alias("_t"), normalised(F.col("canonical_input")).alias("_c"))
    both = e.join(q, e["jurisdiction"] == q["_j"])
    eu = F.col("jurisdiction") == "EU"
    first = lambda xs, test: F.try_element_at(F.filter(xs, lambda x: test(x["n"])), F.lit(1))["t"]
    starts, within = (lambda n: n.startswith(F.col("_q"))), (lambda n: n.contains(F.col("_q")))
    exact = (F.col("_c") == F.col("_q")) | F.exists("_a", lambda x: x["n"] == F.col("_q"))
    technical = F.exists(F.array("celex", "year", "number"), lambda x: F.coalesce(F.lower(x).contains(F.col("_q")), F.lit(False)))
    number = F.col("_s.number").isNull() | (F.col("number").try_cast("int") == F.col("_s.number").try_cast("int"))
    structured = eu & F.col("_s").isNotNull() & (F.col("year") == F.col("_s.year")) & parse_celex(F.col("celex")).isNotNull() & (F.col("_s.document_type").isNull() | (F.substring("celex", 6, 1) == F.col("_s.document_type"))) & number
    hit = lambda rank, kind, matched: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), matched.cast("string").alias("matched"))
    alias_prefix, title_prefix = first("_a", starts), first("_t", starts)
    alias_within, title_within = first("_a", within), first("_t", within)
    found = (
        F.when(exact, hit(1, "exact-alias", F.lit(None)))
        .when(eu & alias_prefix.isNotNull(), hit(2, "title-prefix", alias_prefix))
        .when(title_prefix.isNotNull(), hit(2, "title-prefix", title_prefix))
        .when(eu & alias_within.isNotNull(), hit(3, "title-contains", alias_within))
        .when(title_within.isNotNull(), hit(3, "title-contains", title_within))
        .when(structured | (eu & technical), hit(4, "eu-technical", F.lit(None)))
    )
    ranked = both.select("query_id", "canonical_input", "_c", "title", found.alias("m")).where("m is not null")
    ranked = ranked.withColumn("_k", normalised(F.coalesce("m.matched", "title", F.lit(""))))
    w = Window.partitionBy("query_id").orderBy("m.rank", "_k", "_c", "canonical_input")
    top = ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max(0, limit))  # kept by task: a limit within the window's group
    return top.select("query_id", "position", "canonical_input", F.col("m.kind").alias("match_kind"), F.col("m.rank").alias("rank"), F.col("m.matched").alias("matched_title"))
