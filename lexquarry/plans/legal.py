"""Queries over laws, the act index and the answers of sources, composed from the driver's tables, and the same in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalogs, languages, laws, present, text
from ..operators import acts, lookup, ordering, resolve, tables, temporal
from ..sources import boe, bwb, discovery
from .registry import _query, _table


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_LAWS = f"laws(jurisdiction, law_code, source_id, display_code, reference_type, example, english, title) AS (VALUES {_values(laws._rows())})"
_LANGUAGES = f"languages(code, eli, name) AS (VALUES {_values(catalogs.EU_LANGUAGES)})"


@_query(f"""WITH {_LAWS}, x AS (SELECT *, CASE WHEN law_code = 'EGBGB' THEN 'Art. 1 EGBGB|EGBGB Art. 1|Art. 229 § 6 EGBGB|EGBGB Artikel 246a § 1' WHEN jurisdiction = 'CH' THEN 'Art. 1 ' || display_code || '|' || display_code || ' Art. 1'
              WHEN reference_type = 'article' THEN 'Art. ' || example || ' ' || display_code || '|' || display_code || ' Art. ' || example || '|Artikel ' || example || ' ' || display_code || '|' || display_code || ' Artikel ' || example
              ELSE '§ ' || example || ' ' || display_code || '|' || display_code || ' § ' || example || '|' || example || ' ' || display_code || '|' || display_code || ' ' || example END AS examples FROM laws)
, k AS (SELECT *, row_number() OVER (ORDER BY jurisdiction, display_code) - 1 AS i FROM x)
            SELECT p_partkey, jurisdiction, display_code, title, reference_type, examples FROM part JOIN k ON p_partkey % (SELECT count(*) FROM k) = i""")
def law_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalogs show of the law that each part asks for."""
    known = sorted((r[0], r[3]) for r in laws._rows())
    asked = F.array(*[F.struct(F.lit(j).alias("jurisdiction"), F.lit(d).alias("display_code")) for j, d in known])
    part = _table(spark, sf_dir, "part").select("p_partkey", F.element_at(asked, (F.col("p_partkey") % len(known) + 1).cast("int")).alias("a")).select("p_partkey", "a.*")
    got = part.join(laws.supported_laws(laws.laws(spark)), ["jurisdiction", "display_code"])
    return got.select("p_partkey", "jurisdiction", "display_code", "title", "reference_type", F.array_join("example_inputs", "|").alias("examples"))


_INDEX = """idx AS (SELECT '3' || CAST(year(o_orderdate) AS VARCHAR) || 'R' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS celex, CAST(year(o_orderdate) AS VARCHAR) AS y,
            lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS n, o_orderpriority AS t, o_orderkey FROM orders WHERE o_orderkey % 1000000 > 0)"""


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").where("o_orderkey % 1000000 > 0")
    year, number = F.year("o_orderdate").cast("string"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")
    titles = F.create_map(F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("fr"), F.col("o_orderpriority"), F.lit("x"), F.lit("other"))
    return orders.select("o_orderkey", F.concat(F.lit("3"), year, F.lit("R"), number).alias("celex"), year.alias("year"), number.alias("number"), titles.alias("titles"))


@_query(f"""WITH {_LAWS}, {_INDEX}, e AS (SELECT jurisdiction, display_code AS canonical_input, title, 1 AS n_aliases, CASE WHEN law_code = 'BV' THEN 2 ELSE 0 END AS n_titles FROM laws
            UNION ALL SELECT 'EU', celex, t, CASE WHEN celex IN (SELECT celex FROM idx WHERE o_orderkey % 3 = 0) THEN 2 ELSE 0 END, 2 FROM idx) SELECT * FROM e""")
def law_search_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _acts(spark, sf_dir)
    aliases = own.where("o_orderkey % 3 = 0").select("celex", F.array(F.lit("a"), F.lit("b")).alias("aliases")).dropDuplicates(["celex"])
    titles = spark.createDataFrame([(laws.SWISS_BASE + "1999/404", ["Constitution", "Costituzione"])], "source_id string, titles array<string>")
    got = laws.search_entries(laws.laws(spark), own.drop("o_orderkey"), aliases, titles)
    return got.select("jurisdiction", "canonical_input", "title", F.size("aliases").alias("n_aliases"), F.size("alternate_titles").alias("n_titles"))


@_query(f"""WITH {_LAWS}, k AS (SELECT *, row_number() OVER (ORDER BY jurisdiction, law_code) - 1 AS i FROM laws), r AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS VARCHAR) || CASE WHEN o_orderkey % 9 = 0 THEN 'a' ELSE '' END AS s, CASE WHEN o_orderkey % 6 = 1 THEN 'article' WHEN o_orderkey % 6 = 2 THEN 'section' END AS rt,
              o_orderkey % 7 = 0 AS en, CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderkey % 5 AS VARCHAR) END AS sub, o_orderkey % (SELECT count(*) FROM k) AS i FROM orders)
            SELECT o_orderkey, CASE k.jurisdiction
              WHEN 'DE' THEN CASE WHEN en THEN CASE WHEN coalesce(rt, 'section') = k.reference_type THEN 'https://www.gesetze-im-internet.de/' || english || '/' || english || '.html' END
                WHEN law_code = 'EGBGB' THEN CASE WHEN rt = 'article' THEN CASE WHEN sub IS NULL THEN 'https://www.gesetze-im-internet.de/bgbeg/BJNR006049896.html' ELSE 'https://www.gesetze-im-internet.de/bgbeg/art_' || s || '__' || sub || '.html' END END
                WHEN coalesce(rt, 'section') = k.reference_type THEN 'https://www.gesetze-im-internet.de/' || source_id || CASE WHEN rt = 'article' THEN '/art_' ELSE '/__' END || s || '.html' END
              WHEN 'AT' THEN CASE WHEN en THEN CASE WHEN law_code = 'B-VG' THEN 'https://www.ris.bka.gv.at/Dokumente/Erv/ERV_1930_1/ERV_1930_1.html' END
                ELSE 'https://www.ris.bka.gv.at/NormDokument.wxe?Abfrage=Bundesnormen&Gesetzesnummer=' || source_id || CASE WHEN law_code = 'B-VG' THEN '&Artikel=' || s WHEN law_code = 'DSG' THEN '&Artikel=' || CASE WHEN s = '1' THEN '1' ELSE '2' END || '&Paragraf=' || s ELSE '&Paragraf=' || s END END
              WHEN 'CH' THEN CASE WHEN rt IS DISTINCT FROM 'section' THEN source_id END END AS url FROM r JOIN k USING (i)""")
def section_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = laws.laws(spark)
    known = sorted((r[0], r[1]) for r in laws._rows())
    table = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(c).alias("c")) for j, c in known])
    key = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").withColumn("law", F.element_at(table, (key % len(known) + 1).cast("int")))
    section = F.concat((key % 40).cast("string"), F.when(key % 9 == 0, "A").otherwise(""))
    section = F.when(F.col("law.j") == "DE", section).otherwise(F.lower(section))
    refs = orders.select("o_orderkey", F.col("law.j").alias("jurisdiction"), F.lower("law.c").alias("law_code"), section.alias("section"), F.when(key % 11 == 0, (key % 5).cast("string")).alias("subsection"), F.when(key % 6 == 1, "article").when(key % 6 == 2, "section").alias("reference_type"), F.when(key % 7 == 0, "translation-en").alias("variant"))
    return laws.section_url(refs, catalog).select("o_orderkey", "url")


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ABC' WHEN 1 THEN 'BOE-A-2020-' || CAST(o_orderkey % 1000 AS VARCHAR) WHEN 2 THEN 'XYZ' END AS law,
                  CASE o_orderkey % 4 WHEN 0 THEN '§ ' || CAST(o_orderkey % 50 AS VARCHAR) WHEN 1 THEN 'Artículo ' || CAST(o_orderkey % 50 AS VARCHAR) WHEN 2 THEN 'Art. ' || CAST(o_orderkey % 50 AS VARCHAR) END AS reference FROM orders""")
def input_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    n, form = (key % 50).cast("string"), key % 4
    line = F.when(form == 0, laws.composed(F.lit(" ABC "), F.concat(F.lit("§ "), n, F.lit(" ")))).when(form == 1, F.concat(F.lit("Artículo "), n, F.lit(" BOE-A-2020-"), (key % 1000).cast("string"))).when(form == 2, F.concat(F.lit("Art. "), n, F.lit(" XYZ"))).otherwise(F.concat(n, F.lit(" only")))
    got = _table(spark, sf_dir, "orders").select("o_orderkey", laws.decomposed(line, F.when(form == 1, "ES").otherwise("DE")).alias("x"))
    # with a mark at its end too, the line splits before the last one only
    return got.select("o_orderkey", F.col("x.law").alias("law"), F.col("x.reference").alias("reference"))


@_query(f"""WITH {_LANGUAGES}, r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN l.code WHEN 1 THEN l.eli WHEN 2 THEN 'xyz' WHEN 3 THEN 'Q1' END AS c, l.* FROM orders JOIN (SELECT *, row_number() OVER (ORDER BY code) - 1 AS i FROM languages) l ON o_orderkey % 24 = l.i)
            SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN eli WHEN 1 THEN eli WHEN 2 THEN 'xyz' END AS cellar, CASE o_orderkey % 5 WHEN 0 THEN code WHEN 1 THEN code WHEN 2 THEN 'xyz' WHEN 4 THEN 'de' END AS token,
                   CASE WHEN o_orderkey % 5 < 2 THEN name END AS name, CASE WHEN o_orderkey % 5 = 0 THEN code ELSE 'de' END AS standard FROM r""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e, _ in sorted(catalogs.EU_LANGUAGES)])
    key = F.col("o_orderkey")
    own = F.element_at(table, (key % 24 + 1).cast("int"))
    code = F.when(key % 5 == 0, own["c"]).when(key % 5 == 1, own["e"]).when(key % 5 == 2, "xyz").when(key % 5 == 3, "Q1")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", code.alias("c"))
    c = F.col("c")
    return rows.select("o_orderkey", languages.to_cellar(c).alias("cellar"), languages.cache_token(c).alias("token"), languages.native_name(c).alias("name"), languages.default_language(F.concat(c, F.lit("-XX")), F.lit("??")).alias("standard"))


@_query("""SELECT o_custkey, CASE WHEN o_custkey % 11 = 1 THEN 'version' WHEN bad > 0 THEN 'entry-number' WHEN n > d THEN 'duplicate' WHEN o_custkey % 13 = 2 THEN 'checkpoint' ELSE 'ok' END AS status,
                  CASE WHEN o_custkey % 11 <> 1 AND bad = 0 AND n = d AND o_custkey % 13 <> 2 THEN n END AS n_entries
           FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT (year(o_orderdate), o_orderkey % 10000)) AS d, count(*) FILTER (o_orderkey % 97 = 0) AS bad FROM orders WHERE o_orderkey % 10000 > 0 GROUP BY 1)""")
def stored_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    year, number = F.year("o_orderdate").cast("string"), F.lpad((key % 10000).cast("string"), 4, "0")
    entry = F.struct(F.concat(F.lit("3"), year, F.lit("L"), number).alias("celex"), F.lit("L").alias("documentType"), year.alias("year"), F.when(key % 97 == 0, "9").otherwise(number).alias("number"), F.create_map(F.lit("eng"), F.lit("t")).alias("titlesByLanguage"), F.array(F.lit("eng")).alias("availableLanguages"))
    grouped = _table(spark, sf_dir, "orders").where("o_orderkey % 10000 > 0").groupBy("o_custkey").agg(F.collect_list(entry).alias("entries"))
    time = F.when(F.col("o_custkey") % 13 == 2, "2024-01-01").otherwise("2024-01-01T00:00:00Z")
    raw = F.to_json(F.struct(F.when(F.col("o_custkey") % 11 == 1, 2).otherwise(1).alias("schemaVersion"), time.alias("lastSyncCheckpoint"), time.alias("generatedAt"), "entries"))
    got = acts.parse_stored(grouped.select("o_custkey", raw.alias("raw")), "raw", "o_custkey")
    return got.select("o_custkey", "status", F.when(F.col("entries").isNotNull(), F.size("entries").cast("long")).alias("n_entries"))


@_query("""WITH i AS (SELECT o_custkey % 50 AS page, o_orderkey AS work, '3' || CAST(year(o_orderdate) AS VARCHAR) || 'D' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS celex, o_orderkey % 10000 AS k FROM orders),
           l AS (SELECT DISTINCT l_orderkey AS work, CASE l_linenumber % 3 WHEN 0 THEN 'deu' WHEN 1 THEN 'eng' ELSE 'fra' END AS lang FROM lineitem WHERE l_orderkey % 3 <> 0),
           b AS (SELECT page, max(k = 0) AS bad FROM i GROUP BY 1), g AS (SELECT work, string_agg(lang, ',' ORDER BY lang) AS langs FROM l GROUP BY 1)
           SELECT i.page, work, CASE WHEN bad OR i.page = 7 THEN 'contract' ELSE 'ok' END AS status, celex, CASE WHEN NOT bad AND i.page <> 7 THEN coalesce(langs, '') END AS languages FROM i JOIN b USING (page) LEFT JOIN g USING (work)""")
def works_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of pages with the languages of their expressions; a page with a bad row has none."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("page"), "o_orderdate")
    uri = lambda c: F.concat(F.lit("http://x/"), F.col(c).cast("string"))
    number = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    identities = orders.select("page", uri("o_orderkey").alias("work"), F.concat(F.lit("celex:3"), F.year("o_orderdate").cast("string"), F.lit("D"), number).alias("work_id"))
    lines = _table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    code = F.when(F.col("l_linenumber") % 3 == 0, "DEU").when(F.col("l_linenumber") % 3 == 1, "ENG").otherwise("FRA")
    stray = spark.createDataFrame([(7, "http://x/none", "DEU")], "page long, work string, language string")
    got = acts.enriched_works(identities, lines.select("page", uri("l_orderkey").alias("work"), code.alias("language")).unionByName(stray))
    return got.select("page", F.substring("work", 10, 20).cast("long").alias("work"), "status", "celex", F.array_join("languages", ",").alias("languages"))


@_query("""WITH b AS (SELECT event_id AS o, user_id % 500 AS c, CASE event_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'deu' END AS k, event_type AS t FROM events),
           f AS (SELECT c, min(o) AS o FROM b GROUP BY 1), x AS (SELECT b.c, coalesce(k, CASE WHEN b.o = f.o THEN 'eng' END) AS k, t, b.o FROM b JOIN f USING (c)), m AS (SELECT c, k, arg_max(t, o) AS t FROM x WHERE k IS NOT NULL GROUP BY ALL)
           SELECT c AS work, string_agg(k || '=' || t, ',' ORDER BY k) AS titles, 'deu,eng' AS languages FROM m GROUP BY 1""")
def merged_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    n = F.col("event_id") % 3
    rows = events.select(F.col("event_id").alias("ordinal"), (F.col("user_id") % 500).cast("string").alias("celex"), F.lit("DEU x9 \t ENG").alias("languages"), F.col("event_type").alias("title"), F.when(n == 0, "eng").when(n == 1, "deu").otherwise("E").alias("title_language"))
    got = acts.merged_records(rows)
    titles = F.array_join(F.transform(F.array_sort(F.map_entries("titles")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return got.select(F.col("celex").cast("long").alias("work"), titles.alias("titles"), F.array_join("languages", ",").alias("languages"))


@_query("""WITH p AS (SELECT o_custkey AS run, o_orderkey AS page, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS w FROM orders),
           q AS (SELECT *, lag(w) OVER (PARTITION BY run ORDER BY page) AS b FROM p) SELECT run, page, CASE WHEN w IS NULL THEN 'missing' ELSE 'regressed' END AS problem FROM q WHERE w IS NULL OR (b IS NOT NULL AND w <= b)""")
def cursor_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    cursor = F.when(F.col("o_orderkey") % 41 != 0, F.date_format("o_orderdate", "yyyyMMdd"))
    return acts.cursor_regressions(orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("page"), cursor.alias("work_id"), F.lit("w").alias("work")))


@_query("SELECT event_id, event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-14 00:00:00' AS fresh FROM events")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 14 == 0, "none").when(F.col("event_id") % 7 != 0, F.col("ts").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", acts.is_fresh(value, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("fresh"))


@_query(f"""WITH {_INDEX}, u AS (SELECT celex, min(t) AS t FROM idx GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, celex, t AS title FROM part LEFT JOIN u ON celex = '3' || CAST(1995 + p_size % 7 AS VARCHAR) || 'R' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0')""")
def entry_by_celex(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _acts(spark, sf_dir)
    once = own.join(acts.duplicate_keys(own, ["celex"]), "celex", "left_anti").select("celex", "titles")
    celex = F.concat(F.lit(" 3"), (F.col("p_size") % 7 + 1995).cast("string"), F.lit("r"), F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0"))
    got = acts.entries_by_celex(_table(spark, sf_dir, "part").select("p_partkey", celex.alias("c")), F.col("c"), once)
    return got.select("p_partkey", F.col("entry.celex").alias("celex"), F.when(F.col("entry").isNotNull(), laws.official_title(F.col("entry.titles"), F.lit(None).cast("string"))).alias("title"))


@_query(f"WITH {_INDEX} SELECT o_orderkey FROM idx WHERE contains(lower(celex), '1-u') OR contains(y, '1-u') OR contains(n, '1-u') OR contains(lower(t), '1-u')")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts.search_index(_acts(spark, sf_dir), " 1-U ").select("o_orderkey")


@_query("""WITH a AS (SELECT DISTINCT upper(p_brand) AS a, '32016R' || lpad(CAST(CAST(substr(p_brand, 7) AS INT) AS VARCHAR), 4, '0') AS c FROM part),
           r AS (SELECT p_partkey, upper(p_brand) AS a, CASE p_size % 4 WHEN 1 THEN '32016R0011' WHEN 2 THEN '32016L0099' END AS n, p_size FROM part),
           f AS (SELECT p_partkey, a.c, coalesce(n, a.c) AS found, p_size FROM r JOIN a USING (a))
           SELECT p_partkey, CASE WHEN found = c AND p_size % 5 <> 0 THEN found END AS act_celex FROM f""")
def act_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    celex = F.concat(F.lit("32016R"), F.lpad(F.substring("p_brand", 7, 9).cast("int").cast("string"), 4, "0"))
    table = part.select(celex.alias("celex"), F.array("p_brand").alias("aliases")).distinct()
    size = F.col("p_size")
    refs = part.select("p_partkey", F.lit("EU").alias("jurisdiction"), F.when(size % 4 == 1, " 32016r0011").when(size % 4 == 2, "32016L0099").alias("celex"), F.lower("p_brand").alias("law_code"), F.when(size % 5 == 0, "D").when(size % 5 == 1, "R").alias("document_type"))
    return acts.resolve_identity(refs, table).select("p_partkey", "act_celex")


@_query("""WITH u AS (SELECT lower(p_name || ' ' || p_brand) AS t, min(p_partkey) AS id FROM part GROUP BY 1 HAVING min(p_partkey) = max(p_partkey))
           SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 AND id IS NOT NULL THEN CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 6 = 3 THEN 'A' ELSE '' END END AS section, CASE WHEN p_partkey % 6 <> 5 THEN id END AS title_id FROM part LEFT JOIN u ON t = lower(p_name || ' ' || p_brand)""")
def citation_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in the words of a language that changes from part to part: the marker ahead of the title (0, 1), behind
    it (2, 3), a title alone (4), and with a word that is no marker (5)."""
    part = _table(spark, sf_dir, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_brand"))
    titles = resolve.unique_titles(part, "t", "p_partkey")
    words = [w[1] for w in catalogs.CITATION_WORDS]
    f, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    marks = F.element_at(F.array(*[F.array(*[F.lit(x) for x in own]) for own in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    mark = F.element_at(marks, (F.col("p_partkey") % 5 % F.size(marks) + 1).cast("int"))
    title = F.concat(F.upper("p_name"), F.lit("   "), "p_brand")
    text = (
        F.when(f == 0, F.concat(mark, F.lit(" "), n, F.lit("  "), title, F.lit(" "))).when(f == 1, F.concat(F.lit(" "), F.upper(mark), F.lit("."), n, F.lit(" "), title)).when(f == 2, F.concat(title, F.lit(" "), mark, F.lit(" "), n))
        .when(f == 3, F.concat(title, F.lit("  "), mark, F.lit(". "), n, F.lit("A "))).when(f == 4, title).otherwise(F.concat(F.lit("see "), n, F.lit(" "), title))
    )
    return resolve.title_citations(part.select("p_partkey", text.alias("c")), "c", titles, words).select("p_partkey", "section", "title_id")


@_query("SELECT o_custkey AS ref_id, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders WHERE o_orderstatus = CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'F' END GROUP BY 1")
def abbreviation_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_custkey").alias("ref_id"), F.when(F.col("o_custkey") % 2 == 0, "o").otherwise("f").alias("code")).distinct()
    return resolve.exact_abbreviation(refs, "code", orders.select(F.col("o_custkey").alias("ref_id"), F.struct("o_orderdate", "o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("abbreviation"), "o_orderkey")).select("ref_id", "o_orderkey")


@_query("SELECT p_type AS celex, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names FROM part GROUP BY 1")
def names_of_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("celex"), "p_size").agg(F.collect_set("p_brand").alias("aliases"))
    return acts.names_by_celex(part).select("celex", F.array_join("names", ",").alias("names"))


@_query("""WITH c AS (SELECT unnest(string_split('AktG ArbGG AsylG AufenthG BetrVG BUrlG EStG FamFG GewStG GmbHG GwG InsO KSchG KStG PAuswG StAG StGB StPO TzBfG UmwG UStG VwGO VwVfG WpHG', ' ')) AS d, unnest(range(0, 24)) AS i)
           SELECT p_partkey, coalesce(d, CASE p_size % 3 WHEN 0 THEN ' xyz ' WHEN 1 THEN 'XYZ' ELSE 'Xyz' END) AS display_code FROM part LEFT JOIN c ON p_partkey % 26 = i""")
def display_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in small letters and blanks, in capitals, or with a capital; two of 26 are no German ones."""
    own = F.element_at(F.array(*[F.lit(c) for c in (*laws.DISPLAY_CODES, "xyz", "xyz")]), (F.col("p_partkey") % 26 + 1).cast("int"))
    code = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.lower(own), F.lit(" "))).when(F.col("p_size") % 3 == 1, F.upper(own)).otherwise(F.initcap(own))
    return _table(spark, sf_dir, "part").select("p_partkey", laws.display_code(code).alias("display_code"))


_BOE_OK = "o_orderkey % 17 <> 0 AND o_custkey % 23 <> 0"


@_query(f"""WITH r AS (SELECT o_custkey, 'BOE-A-2000-' || CAST(o_orderkey % 300 AS VARCHAR) AS id, min(o_orderkey) AS o, max(o_orderkey % 17 = 0) AS bad FROM orders GROUP BY ALL), b AS (SELECT o_custkey, max(bad) AS bad FROM r GROUP BY 1)
            SELECT o_custkey, CASE WHEN o_custkey % 23 = 0 OR any_value(b.bad) THEN 'malformed' ELSE 'results' END AS status, CASE WHEN o_custkey % 23 <> 0 AND NOT any_value(b.bad) THEN array_to_string(list_slice(list(id ORDER BY o), 1, 8), ',') END AS ids
            FROM r JOIN b USING (o_custkey) GROUP BY o_custkey""")
def boe_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers, one for each customer, of which some have a bad status or a bad entry."""
    number = F.concat(F.lit("BOE-A-2000-"), (F.col("o_orderkey") % 300).cast("string"))
    url = F.concat(F.when(F.col("o_orderkey") % 17 == 0, "http").otherwise("https"), F.lit("://www.boe.es/buscar/act.php?id="), number)
    entry = F.struct("o_orderkey", F.lower(number).alias("identificador"), F.concat(F.lit(" "), "o_orderpriority").alias("titulo"), url.alias("url_html_consolidada"))
    grouped = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("data"))
    code = F.when(F.col("o_custkey") % 23 == 0, "500").otherwise("200")
    got = grouped.select("o_custkey", discovery.boe_search(F.to_json(F.struct(F.struct(code.alias("code")).alias("status"), "data"))).alias("x"))
    return got.select("o_custkey", F.col("x.status").alias("status"), F.array_join(F.transform("x.entries", lambda e: e["canonical_input"]), ",").alias("ids"))


@_query("""WITH k AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0), g AS (SELECT o_custkey, array_to_string(list_slice(list('normattiva:2001-02-03:' || CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), 1, 8), ',') AS ids FROM k GROUP BY 1)
           SELECT o_custkey, CASE WHEN o_custkey % 19 = 0 THEN 'malformed' WHEN g.ids IS NULL THEN 'no-results' ELSE 'results' END AS status, CASE WHEN o_custkey % 19 <> 0 THEN coalesce(g.ids, '') END AS ids FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN g USING (o_custkey)""")
def normattiva_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose fields are in several places; those that lack a number or have an impossible date are passed over."""
    key = F.col("o_orderkey")
    made = F.when(key % 5 == 0, "2001-02-30").otherwise("2001-02-01T00:00:00")
    code = key.cast("string")
    act = F.struct(F.lit("2001-02-03").alias("dataGU"), F.when(key % 2 == 0, code).alias("codiceRedazionale"), F.when(key % 3 != 0, "12").alias("numeroProvvedimento"))
    entry = F.struct(key.alias("k"), F.when(key % 2 == 1, code).alias("codiceRedazionale"), F.lit("t").alias("titolo"), F.lit("d").alias("descrizioneAtto"), F.lit("LEGGE").alias("denominazioneAtto"), made.alias("dataAtto"), act.alias("atto"))
    grouped = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["k"] - b["k"]).cast("int")).alias("l"))
    own, other = F.to_json(F.struct(F.struct(F.col("l").alias("risultati")).alias("data"))), F.to_json(F.struct(F.col("l").alias("listaAtti")))
    payload = F.when(F.col("o_custkey") % 19 == 0, F.lit('{"data": {"other": []}}')).when(F.col("o_custkey") % 2 == 0, own).otherwise(other)
    got = grouped.select("o_custkey", discovery.normattiva_search(payload).alias("x"))
    return got.select("o_custkey", F.col("x.status").alias("status"), F.array_join(F.transform("x.entries", lambda e: e["canonical_input"]), ",").alias("ids"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'malformed' WHEN strftime(o_orderdate, '%Y-%m-%d') > '1998-06-30' THEN 'malformed' ELSE 'results' END AS status FROM orders""")
def bwb_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in force and visible at a day; one of another identity or outside its intervals spoils the answer."""
    code, day = F.format_string("BWBR%07d", (F.col("o_custkey") % 10000000).cast("int")), F.date_format("o_orderdate", "yyyy-MM-dd")
    other = F.when(F.col("o_orderkey") % 13 == 0, F.lit("BWBR9999999")).otherwise(code)
    field = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    record = F.concat(
        F.lit("<record>"), field("identifier", code), field("title", F.col("o_orderpriority")), field("toestand", F.concat(F.lit("http://wetten.overheid.nl/id/"), code, F.lit("/"), day, F.lit("/0"))),
        field("locatie_toestand", F.concat(F.lit("https://repository.officiele-overheidspublicaties.nl/bwb/"), other, F.lit("/"), day, F.lit("_0/xml/"), other, F.lit("_"), day, F.lit("_0.xml"))),
        field("geldigheidsperiode_startdatum", day), field("geldigheidsperiode_einddatum", F.lit("9999-12-31")), field("zichtperiode_startdatum", day), field("zichtperiode_einddatum", F.lit("9999-12-31")), F.lit("</record>"),
    )
    xml = F.concat(F.lit("<searchRetrieveResponse>"), field("numberOfRecords", F.lit("2")), record, record, F.lit("</searchRetrieveResponse>"))
    answers = _dealt(_table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("ref_id"), F.lit("1998-06-30").alias("day"), code.alias("wanted"), xml.alias("xml"))
    return bwb.read_states(answers).select(F.col("ref_id").alias("o_orderkey"), "status")


@_query("""SELECT p_partkey, 'titulo:' || replace(replace(p_brand, '-', '\\-'), '#', '#') || ' AND numero_oficial:' || CAST(p_size AS VARCHAR) || '\\/2015 AND titulo:' || CAST(p_partkey AS VARCHAR) || '*' AS query FROM part""")
def boe_title_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  "), "p_brand", F.lit("  "), F.col("p_size").cast("string"), F.lit("/2015 "), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", discovery.boe_query(line).alias("query"))


@_query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS position FROM f) SELECT * FROM n WHERE position <= 3""")
def first_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.first_of_each(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey", 3)


@_query("SELECT o_custkey, o_orderpriority FROM orders GROUP BY ALL HAVING count(DISTINCT (o_orderstatus, year(o_orderdate))) > 1")
def conflicting_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.conflicting(_table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "o_custkey", "o_orderpriority", ["o_orderstatus", "y"])


@_query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts.duplicate_keys(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@_query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_shipdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 60 DAY), m AS (SELECT l_orderkey, max(d) AS d FROM o GROUP BY 1)
           SELECT o.l_orderkey, min(l_linenumber) AS l_linenumber FROM o JOIN m ON o.l_orderkey = m.l_orderkey AND o.d = m.d GROUP BY o.l_orderkey HAVING count(*) = 1""")
def block_version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block the one version that is the last up to the date of its law."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    n = tables.parts(lines)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 60 days")).alias("day")).repartition(n, "o_orderkey")
    versions = lines.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "day")
    return temporal.latest_as_of(versions, ["l_orderkey"], "l_shipdate", F.col("day"), ["l_linenumber"]).select("l_orderkey", "l_linenumber")


_IDLE = 6 * 3600


@_query(f"""WITH e AS (SELECT user_id, event_id, ts, event_id % 2 = 0 AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
            r AS (SELECT a.user_id, a.event_id, a.i, a.ts, max(b.i) AS last FROM e a JOIN e b ON a.user_id = b.user_id AND b.q AND b.i < a.i WHERE NOT a.q GROUP BY ALL),
            g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY i) AS before FROM e), w AS (SELECT user_id, i FROM g WHERE ts > before + INTERVAL {_IDLE} SECOND)
            SELECT r.user_id, r.event_id FROM r WHERE r.event_id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = r.user_id AND w.i > r.last AND w.i <= r.i)""")
def current_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are still wanted. Even events are requests; odd ones answer the last request, or the one before it."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), (F.col("event_id") % 2 == 0).alias("request"))
    by = Window.partitionBy("session").orderBy("at", "number").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.collect_list(F.when(F.col("request"), F.col("number"))).over(by.rowsBetween(-64, -1))  # composed of the requests shortly before
    last = F.max(F.when(F.col("request"), F.struct("at", "number"))).over(by)["number"]
    older = F.try_element_at(asked, F.lit(-2))
    rows = events.withColumn("revision", F.when(F.col("request"), F.col("number")).when(F.col("number") % 4 == 1, last).otherwise(older))
    return lookup.current_answers(rows, _IDLE).select(F.col("session").alias("user_id"), F.col("number").alias("event_id"))


@_query("""SELECT doc_id, strip_accents(text) AS plain FROM documents""")
def unaccented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.unaccented(F.col("text")).alias("plain"))


@_query(f"""WITH {_LANGUAGES}, d AS (SELECT doc_id, doc_id % 6 AS f, CAST(doc_id % 300 AS VARCHAR) AS s, text FROM documents)
            SELECT doc_id, '> **' || CASE WHEN f = 1 THEN 'Art. ' || s || ' § 2' ELSE '§ ' || s END || CASE f WHEN 4 THEN ' Il titolo' WHEN 5 THEN '' ELSE ' ABC' END || CASE WHEN f = 2 THEN ' – Kopf' ELSE '' END || '**' || chr(10) || '>' || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ')
              || CASE f WHEN 0 THEN chr(10) || chr(10) || 'Textvariante: Englischer Gesetzestext von Gesetze im Internet (nicht amtlich).' WHEN 2 THEN chr(10) || chr(10) || 'Bundesrecht konsolidiert; Informationsfassung, rechtlich unverbindlich.'
                   WHEN 3 THEN chr(10) || chr(10) || 'Amtliche EU-Sprachfassung: ' || (SELECT name FROM languages WHERE eli = 'deu') || '.' || chr(10) || 'CELEX: 32016R0679.' ELSE '' END
              || chr(10) || chr(10) || 'Quelle: p' || CASE f WHEN 4 THEN ', Il titolo' WHEN 5 THEN '' ELSE ', ABC' END || ', ' || CASE WHEN f = 1 THEN 'Art. ' || s || ' § 2' ELSE '§ ' || s END || ', abgerufen am 2024-05-06.' || chr(10) || 'Cache: live.' AS markdown FROM d""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("doc_id") % 6
    none = F.lit(None).cast("string")
    s = F.struct(
        F.when(f == 2, "AT").when(f == 3, "EU").when(f == 4, "IT").when(f == 5, "NL").otherwise("DE").alias("jurisdiction"), F.lit("ABC").alias("law_code"), F.when(f == 4, " Il titolo ").otherwise("").alias("law_title"),
        (F.col("doc_id") % 300).cast("string").alias("section"), F.when(f == 1, "2").alias("subsection"), F.when(f == 1, "article").otherwise("section").alias("reference_type"), F.when(f == 2, "Kopf").otherwise(none).alias("heading"),
        F.col("text"), F.when(f == 0, "translation-en").alias("variant"), F.when(f == 3, "deu").alias("language"), F.when(f == 3, "32016R0679").alias("celex"), F.lit("p").alias("provider"), F.lit("2024-05-06T07:08:09Z").alias("retrieved_at"), F.lit("live").alias("cache_status"),
    )
    return _table(spark, sf_dir, "documents").select("doc_id", present.markdown_section(s).alias("markdown"))


@_query(f"""WITH {_LANGUAGES}, d AS (SELECT doc_id, doc_id % 7 AS f, CAST(doc_id % 300 AS VARCHAR) AS s, text FROM documents)
            SELECT doc_id, CASE WHEN f = 1 THEN 'Art. ' || s || ' § 2' ELSE '§ ' || s END || CASE f WHEN 4 THEN ' Il titolo' WHEN 5 THEN '' ELSE ' ABC' END || CASE WHEN f = 2 THEN ' – Kopf' ELSE '' END AS title,
              CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS n_paragraphs, md5(text) AS text_md5,
              CASE f WHEN 0 THEN 'Textvariante: Englischer Gesetzestext von Gesetze im Internet (nicht amtlich).|' WHEN 2 THEN 'Bundesrecht konsolidiert; Informationsfassung, rechtlich unverbindlich.|'
                     WHEN 3 THEN 'Amtliche EU-Sprachfassung: ' || (SELECT name FROM languages WHERE eli = 'deu') || '.|CELEX: 32016R0679.|'
                     WHEN 6 THEN CASE WHEN doc_id % 2 = 0 THEN 'Finlex consolidated text from an official source; the retrieved consolidated expression is marked non-authoritative.|' ELSE '' END ELSE '' END
              || 'Quelle: p' || CASE f WHEN 4 THEN ', Il titolo' WHEN 5 THEN '' ELSE ', ABC' END || ', ' || CASE WHEN f = 1 THEN 'Art. ' || s || ' § 2' ELSE '§ ' || s END || ', abgerufen am 2024-05-06.|Cache: ' || CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'live' END || '.' AS metadata FROM d WHERE text IS NOT NULL""")
def section_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("doc_id") % 7
    s = F.struct(
        F.when(f == 2, "AT").when(f == 3, "EU").when(f == 4, "IT").when(f == 5, "NL").when(f == 6, "FI").otherwise("DE").alias("jurisdiction"), F.lit("ABC").alias("law_code"), F.when(f == 4, " Il titolo ").otherwise("").alias("law_title"),
        (F.col("doc_id") % 300).cast("string").alias("section"), F.when(f == 1, "2").alias("subsection"), F.when(f == 1, "article").otherwise("section").alias("reference_type"), F.when(f == 2, "Kopf").alias("heading"), F.col("text"),
        F.when(f == 0, "translation-en").alias("variant"), F.when(f == 3, "deu").alias("language"), F.when(f == 3, "32016R0679").alias("celex"), (F.col("doc_id") % 2 == 1).alias("is_authoritative_text"),
        F.lit("p").alias("provider"), F.lit("2024-05-06T07:08:09Z").alias("retrieved_at"), F.when(F.col("doc_id") % 5 == 0, "stale").otherwise("live").alias("cache_status"),
    )
    got = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", present.preview(s).alias("p"))
    return got.select("doc_id", "p.title", F.size("p.paragraphs").alias("n_paragraphs"), F.md5(F.array_join("p.paragraphs", "\n").cast("binary")).alias("text_md5"), F.array_join("p.metadata_lines", "|").alias("metadata"))


#: Names of jurisdictions as readers of three languages see them.
_NAMES = {
    "en": {"EU": "European Union", "DE": "Germany", "AT": "Austria", "CH": "Switzerland", "ES": "Spain", "FI": "Finland", "IT": "Italy", "NL": "Netherlands"},
    "de": {"EU": "Europäische Union", "DE": "Deutschland", "AT": "Österreich", "CH": "Schweiz", "ES": "Spanien", "FI": "Finnland", "IT": "Italien", "NL": "Niederlande"},
    "sv": {"EU": "Europeiska unionen", "DE": "Tyskland", "AT": "Österrike", "CH": "Schweiz", "ES": "Spanien", "FI": "Finland", "IT": "Italien", "NL": "Nederländerna"},
}


@_query(f"""WITH n(i, locale, code, label) AS (VALUES {", ".join(f"({i}, '{loc}', '{c}', '{n}')" for loc, own in _NAMES.items() for i, (c, n) in enumerate(own.items()))}),
           r AS (SELECT o_custkey, o_orderkey, locale, code, CASE WHEN o_orderkey % 3 = 0 THEN upper(label) ELSE label END AS label FROM orders
                 JOIN n ON i = o_orderkey // 4 % 8 AND locale = CASE o_custkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'sv' ELSE 'en' END)
           SELECT o_custkey, o_orderkey, locale, label, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY code <> 'EU',
             CASE locale WHEN 'sv' THEN replace(replace(lower(label), 'ä', '|'), 'ö', '}}') ELSE strip_accents(lower(label)) END, code, o_orderkey) AS INT) AS position FROM r""")
def jurisdictions_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions in the order of the reader's language: Austria is last in Swedish, behind the Netherlands in German."""
    key, locale = F.col("o_orderkey"), F.when(F.col("o_custkey") % 3 == 0, "de").when(F.col("o_custkey") % 3 == 1, "sv").otherwise("en")
    codes = F.array(*[F.lit(c) for c in _NAMES["en"]])
    names = F.create_map(*[x for loc, own in _NAMES.items() for c, n in own.items() for x in (F.lit(f"{loc}:{c}"), F.lit(n))])
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", locale.alias("locale"), F.element_at(codes, (F.floor(key / 4) % 8 + 1).cast("int")).alias("code"))
    name = names[F.concat_ws(":", "locale", "code")]
    rows = rows.withColumn("label", F.when(key % 3 == 0, F.upper(name)).otherwise(name))
    return ordering.positions(rows, ["o_custkey"], more=("o_orderkey",), locales=("en", "de", "sv")).drop("code")


def _dealt(orders: DataFrame) -> DataFrame:
    """The orders that answers are composed of, in as many tasks as exchanges have: they are small, the answers aren't."""
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").repartition(n, "o_orderkey")


def _boe_case(orders: DataFrame) -> DataFrame:
    """ref_id, f and what the composed answers of a Spanish law have in common."""
    key = F.col("o_orderkey")
    code = F.concat(F.lit("BOE-A-2000-"), (key % 90000).cast("string"))
    return orders.select(
        key.alias("ref_id"), (key % 20).alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyyMMdd").alias("compact"), code.alias("code"),
        F.concat(F.lit("https://www.boe.es/eli/es/l/2000/01/02/"), key.cast("string")).alias("work"), F.concat(F.lit("https://www.boe.es/buscar/act.php?id="), code).alias("url"),
    )


def _eli(case: DataFrame) -> Column:
    """A description of two versions, the one of the day and one long ago; by f another law, work, language, or day twice."""
    f, work = F.col("f"), F.col("work")
    about = lambda day: F.concat(work, F.lit("/con/"), day)
    def version(day: Column, compact: Column) -> Column:
        return F.concat(
            F.lit('<eli:LegalResource rdf:about="'), about(compact), F.lit('"><eli:id_local>'), F.when(f == 3, "BOE-A-1999-1").otherwise(F.col("code")), F.lit('</eli:id_local><eli:version_date>'), day, F.lit('</eli:version_date><eli:is_member_of rdf:resource="'), work, F.when(f == 4, "9").otherwise(""),
            F.lit('"/><eli:is_realized_by><eli:LegalExpression rdf:about="'), about(compact), F.lit('/spa"><eli:language rdf:resource="http://www.elidata.es/mdr/authority/language/'), F.when(f == 5, "cat").otherwise("spa"), F.lit('"/><eli:realizes rdf:resource="'), about(compact),
            F.lit('"/></eli:LegalExpression></eli:is_realized_by></eli:LegalResource>'),
        )
    own = version(F.col("day"), F.col("compact"))
    inner = F.concat(F.lit('<eli:LegalResource rdf:about="'), work, F.lit('"><eli:has_member>'), own, F.lit("</eli:has_member><eli:has_member>"), version(F.lit("1980-01-01"), F.lit("19800101")), F.lit("</eli:has_member>"), F.when(f == 6, F.concat(F.lit("<eli:has_member>"), own, F.lit("</eli:has_member>"))).otherwise(""), F.lit("</eli:LegalResource>"))
    return F.concat(F.lit("<response><data><metadata-eli><rdf:RDF>"), inner, F.when(f == 7, "").otherwise("</rdf:RDF>"), F.lit("</metadata-eli></data></response>"))


@_query("""SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 20 BETWEEN 3 AND 7 THEN CASE WHEN o_orderkey % 20 IN (3, 4, 5, 6) THEN strftime(o_orderdate, '%Y-%m-%d') END ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
                  o_orderkey % 20 NOT BETWEEN 3 AND 7 AS "right" FROM orders""")
def eli_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force by composed descriptions of works."""
    case = _boe_case(_dealt(_table(spark, sf_dir, "orders")))
    return boe.version_days(case.select("ref_id", "code", "work"), case.select("ref_id", _eli(case).alias("body")), F.lit("2020-01-01"))


@_query("""WITH o AS (SELECT o_orderkey, o_orderkey % 20 AS f, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
           s AS (SELECT *, CASE f WHEN 1 THEN 'not-found' WHEN 2 THEN 'contract' WHEN 3 THEN 'contract' WHEN 4 THEN 'contract' WHEN 5 THEN 'contract' WHEN 6 THEN 'contract' WHEN 7 THEN 'contract' WHEN 8 THEN 'not-found' WHEN 9 THEN 'contract'
                    WHEN 10 THEN 'contract' WHEN 11 THEN 'contract' WHEN 12 THEN 'unavailable' WHEN 13 THEN 'not-found' WHEN 14 THEN 'contract' WHEN 15 THEN 'not-found' ELSE 'ok' END AS status FROM o)
           SELECT o_orderkey AS ref_id, status, CASE WHEN status = 'ok' THEN 'Artículo 5. Objeto & más.' END AS heading, CASE WHEN status = 'ok' THEN 'Texto <b> ' || CAST(o_orderkey AS VARCHAR) || chr(10) || 'Fin' END AS text, CASE WHEN status = 'ok' THEN d END AS valid_from FROM s""")
def boe_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections from composed answers: right ones, and by f another law (1), another permanent address (2), another
    version (3 to 7), no such article (8), an index with one twice (9) or with an article that has no title (10), two
    versions of a day (11), a failed answer (12), a block that isn't there (13) or is of another article (14), no law (15)."""
    case = _boe_case(_dealt(_table(spark, sf_dir, "orders")))
    f, key = F.col("f"), F.col("ref_id").cast("string")
    metadata = F.to_json(F.struct(F.array(F.struct(F.when(f == 1, "BOE-A-1999-1").otherwise(F.col("code")).alias("identificador"), F.lit("Ley").alias("titulo"), F.col("url").alias("url_html_consolidada"), F.col("work").alias("url_eli"))).alias("data")))
    record = F.concat(F.lit('<dl><dt>Rango:</dt><dd>Ley</dd><dt class="x"> Permalink ELI: </dt> <dd><a class="y" href="'), F.col("work"), F.when(f == 2, "/x").otherwise(""), F.lit('/con">x</a></dd></dl>'))
    entry = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("titulo"))
    index = F.to_json(F.struct(F.struct(F.array(entry("no", F.lit("")), entry("a6", F.lit("Disposición adicional primera. Artículo 5")), entry("a5", F.when(f == 8, "Artículo 6").otherwise("Artículo 5. Objeto de la ley.")), F.struct(F.when(f == 9, "a5").otherwise("a7").alias("id"), F.lit("Art. 7").alias("titulo"))).alias("bloque")).alias("data")))
    version = lambda d, t: F.concat(F.lit('<version id_norma="BOE-A-2000-1" fecha_publicacion="20000101" fecha_vigencia="'), d, F.lit('"><p class="centro articulo">Artículo 5. Objeto &amp; más.</p><p>'), t, F.lit("</p><blockquote><p>Nota</p></blockquote></version>"))
    block = lambda name, kind, title, inner: F.concat(F.lit(f'<response><data><bloque id="{name}" tipo="'), kind, F.lit('"'), title, F.lit(">"), inner, F.lit("</bloque></data></response>"))
    own = version(F.col("compact"), F.concat(F.lit("Texto &amp;lt;b&gt;  "), key, F.lit("<br/>Fin")))
    versions = F.concat(version(F.lit("19000101"), F.lit("viejo")), own, F.when(f == 11, own).otherwise(""), version(F.lit("20990101"), F.lit("futuro")))
    status = lambda k: F.when((f == 12) & (F.lit(k) == "index"), 500).when((f == 13) & (F.lit(k) == "block"), 404).when((f == 15) & (F.lit(k) == "metadata"), 404).otherwise(200)
    answer = lambda what, number, body: case.select("ref_id", F.lit(what).alias("what"), F.lit(number).cast("string").alias("number"), status(what if number != "no" else "").alias("status"), body.alias("body"))
    captured = functools.reduce(DataFrame.unionByName, [  # each kind of answer is composed once, where it is read
        answer("metadata", None, metadata), answer("record", None, record), answer("eli", None, _eli(case)), answer("index", None, index),
        answer("block", "no", block("no", F.when(f == 10, "precepto").otherwise("nota_inicial"), F.lit(""), version(F.lit("20000101"), F.lit("x")))),
        answer("block", "a5", block("a5", F.lit("precepto"), F.when(f == 14, ' titulo="Artículo 6"').otherwise(' titulo="Artículo 5. Objeto"'), versions)),
    ])
    got = boe.boe_sections(case.select("ref_id", F.lower("code").alias("code"), F.lit(" 5 ").alias("section")), captured, F.lit("2020-01-01"))
    return got.select("ref_id", "status", "heading", "text", "valid_from")
