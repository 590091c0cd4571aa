"""The queries over the driver's tables, by name, and the same in SQL.

The tables hold no legal text, so citations, versions and acts are composed from their columns, with some that have
to be rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs, citations, extract, present
from ..operators import index, lookup, resolve, search, temporal
from ..sources import payloads
from ..streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation_acts(spark, sf_dir)


def _celex_of_orders(orders: DataFrame) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "R").when(F.col("o_orderstatus") == "F", "L").otherwise("D")
    year = F.year("o_orderdate") + F.when(F.col("o_orderkey") % 7 == 0, 100).otherwise(0)
    number = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    return orders.select("o_orderkey", F.concat(F.lit("3"), year.cast("string"), kind, number).alias("celex"))


_CELEX = """SELECT o_orderkey, '3' || CAST(year(o_orderdate) + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS VARCHAR) ||
            CASE o_orderstatus WHEN 'O' THEN 'R' WHEN 'F' THEN 'L' ELSE 'D' END || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS celex FROM orders"""
_VALID = "CAST(substr(celex, 2, 4) AS INT) BETWEEN 1952 AND 2099 AND CAST(substr(celex, 7) AS INT) >= 1"


@_query(f"""WITH c AS ({_CELEX}) SELECT o_orderkey, celex, CASE WHEN {_VALID} THEN substr(celex, 2, 4) END AS act_year,
            CASE WHEN {_VALID} THEN substr(celex, 6, 1) END AS document_type, CASE WHEN {_VALID} THEN substr(celex, 7) END AS act_number FROM c""")
def celex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _celex_of_orders(_table(spark, sf_dir, "orders")).withColumn("x", citations.parse_celex(F.col("celex")))
    return rows.select("o_orderkey", "celex", F.col("x.year").alias("act_year"), F.col("x.document_type").alias("document_type"), F.col("x.number").alias("act_number"))


@_query(f"""WITH c AS ({_CELEX}) SELECT CASE WHEN {_VALID} THEN substr(celex, 6, 1) END AS document_type, count(*) AS n_citations,
            count(DISTINCT CASE WHEN {_VALID} THEN celex END) AS n_acts FROM c GROUP BY 1""")
def citation_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by CELEX number, parsed and resolved to acts, counted by document type."""
    rows = _celex_of_orders(_table(spark, sf_dir, "orders")).select(F.concat(F.lit("Art. 5 CELEX "), "celex").alias("citation"))
    parsed = citations.parse_citations(rows, "citation", "EU", "r")
    return parsed.groupBy(F.col("r.eu_document_type").alias("document_type")).agg(F.count("*").alias("n_citations"), F.countDistinct("r.eu_celex").alias("n_acts"))


@_query("""WITH c AS (SELECT l_linenumber % 7 AS form, 'AB' || CAST(l_suppkey % 9 AS VARCHAR) AS code, CAST(l_partkey % 50 AS VARCHAR) AS n FROM lineitem)
           SELECT CASE WHEN form IN (3, 6) THEN NULL WHEN form = 4 THEN 'GG' WHEN form = 5 THEN 'SGB XII' ELSE code END AS law_code,
                  CASE WHEN form IN (3, 6) THEN NULL ELSE n END AS section, CASE form WHEN 4 THEN 'article' WHEN 5 THEN 'section' END AS reference_type,
                  CASE form WHEN 2 THEN 'AT' END AS jurisdiction, count(*) AS n_rows FROM c GROUP BY ALL""")
def citation_article_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    form, code, n = F.col("l_linenumber") % 7, F.concat(F.lit("ab"), (F.col("l_suppkey") % 9).cast("string")), (F.col("l_partkey") % 50).cast("string")
    text = (
        F.when(form == 0, F.concat(code, F.lit(" § "), n)).when(form == 1, F.concat(F.lit("  §"), n, F.lit("\t"), code)).when(form == 2, F.concat(code, F.lit(" AT "), n))
        .when(form == 3, F.concat(F.lit("EGBGB "), n)).when(form == 4, F.concat(F.lit("artikel"), n, F.lit(" gg"))).when(form == 5, F.concat(F.lit("§ "), n, F.lit(" sgb xii"))).otherwise(F.concat(F.lit("see "), code))
    )
    parsed = li.select(text.alias("t")).select(citations.parse_general(F.col("t")).alias("r"))
    return parsed.groupBy(F.col("r.law_code").alias("law_code"), F.col("r.section").alias("section"), F.col("r.reference_type").alias("reference_type"), F.col("r.jurisdiction").alias("jurisdiction")).agg(F.count("*").alias("n_rows"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ACT-' || upper(p_brand) ELSE 'X-' || CAST(p_size AS VARCHAR) END AS canonical, p_size % 3 = 0 AS curated FROM part""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    acts = part.groupBy("p_brand").agg(F.array(F.col("p_brand"), F.concat(F.col("p_brand"), F.lit(" act"))).alias("aliases")).select(F.concat(F.lit("ACT-"), F.upper("p_brand")).alias("canonical"), "aliases")
    refs = part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lower("p_brand"), F.when(F.col("p_size") % 2 == 0, " Act").otherwise(""))).otherwise(F.concat(F.lit("x-"), F.col("p_size").cast("string"))).alias("code"))
    return resolve.resolve_alias(refs, "code", acts).select("p_partkey", "canonical", "curated")


@_query("""SELECT lower(p_name || ' ' || p_brand) AS title, min(p_partkey) AS id FROM part GROUP BY 1 HAVING min(p_partkey) = max(p_partkey)""")
def title_exact_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unique_titles(_table(spark, sf_dir, "part").withColumn("t", F.concat(F.lit(" "), "p_name", F.lit("  "), F.upper("p_brand"))), "t", "p_partkey")


_SEARCHES = [(1, "brand#11", "DE"), (2, "an", "DE"), (3, "x", "DE"), (4, "2017", "EU"), (5, "regulation 2017/12/eu", "EU"), (6, "brand#2", "EU")]


@_query("""WITH e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'EU' ELSE 'DE' END AS j, CAST(p_partkey AS VARCHAR) AS c, lower(p_name) AS t, p_name, lower(p_brand) AS a, p_brand,
                             CASE WHEN p_partkey % 2 = 0 THEN '2017' END AS y, CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_size AS VARCHAR), 4, '0') END AS n FROM part),
           q(query_id, q, j, sy, sn) AS (VALUES (1, 'brand#11', 'DE', NULL, NULL), (2, 'an', 'DE', NULL, NULL), (4, '2017', 'EU', NULL, NULL), (5, 'regulation 2017/12/eu', 'EU', '2017', 12), (6, 'brand#2', 'EU', NULL, NULL)),
           m AS (SELECT *, CASE WHEN c = q OR a = q THEN 1 WHEN e.j = 'EU' AND starts_with(a, q) THEN 2 WHEN starts_with(t, q) THEN 2.5 WHEN e.j = 'EU' AND contains(a, q) THEN 3 WHEN contains(t, q) THEN 3.5
                                WHEN e.j = 'EU' AND (contains('3' || y || 'r' || n, q) OR contains(n, q) OR (sy = y AND sn = CAST(n AS INT))) THEN 4 END AS r FROM e JOIN q USING (j)),
           k AS (SELECT *, CASE r WHEN 2 THEN p_brand WHEN 2.5 THEN p_name WHEN 3 THEN p_brand WHEN 3.5 THEN p_name END AS matched FROM m WHERE r IS NOT NULL),
           p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(r), lower(coalesce(matched, p_name)), c) AS pos FROM k)
           SELECT query_id, CAST(pos AS INT) AS position, c AS canonical_input, CASE floor(r) WHEN 1 THEN 'exact-alias' WHEN 2 THEN 'title-prefix' WHEN 3 THEN 'title-contains' ELSE 'eu-technical' END AS match_kind,
                  CAST(floor(r) AS INT) AS rank, matched AS matched_title FROM p WHERE pos <= 8""")
def metadata_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    eu = F.col("p_partkey") % 2 == 0
    number = F.lpad(F.col("p_size").cast("string"), 4, "0")
    entries = _table(spark, sf_dir, "part").select(
        F.when(eu, "EU").otherwise("DE").alias("jurisdiction"), F.col("p_partkey").cast("string").alias("canonical_input"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"),
        F.array().cast("array<string>").alias("alternate_titles"), F.when(eu, F.concat(F.lit("32017R"), number)).alias("celex"), F.when(eu, "2017").alias("year"), F.when(eu, number).alias("number"),
    )
    queries = spark.createDataFrame(_SEARCHES, "query_id int, query string, jurisdiction string")
    return search.search_metadata(queries, entries)


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'R' WHEN o_orderkey % 4 = 2 THEN 'L' END AS document_type,
                  CASE WHEN o_orderkey % 4 <> 3 THEN CAST(year(o_orderdate) AS VARCHAR) END AS act_year, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderkey % 1000000 AS VARCHAR) END AS act_number FROM orders""")
def structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, number = F.year("o_orderdate").cast("string"), (F.col("o_orderkey") % 1000000).cast("string")
    form = F.col("o_orderkey") % 4
    text = F.when(form == 0, F.concat(year, F.lit(" / "), number)).when(form == 1, F.concat(F.lit("Verordnung "), year, F.lit("/"), number, F.lit("/EU"))).when(form == 2, F.concat(F.lit("RL "), year)).otherwise(F.concat(F.lit("Beschluss "), year, F.lit("/"), number, F.lit("/XX")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", search.structured_query(F.col("t")).alias("s"))
    return rows.select("o_orderkey", F.col("s.document_type").alias("document_type"), F.col("s.year").alias("act_year"), F.col("s.number").alias("act_number"))


@_query("""WITH s AS (SELECT o_custkey AS k, 1 AS p, max(o_totalprice) AS v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1
                      UNION ALL SELECT o_custkey, 2, max(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
                      UNION ALL SELECT c_custkey, 3, c_acctbal FROM customer WHERE c_acctbal > 0)
           SELECT k AS c_custkey, arg_min(v, p) AS amount, CAST(min(p) AS INT) AS priority FROM s GROUP BY k""")
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount"), "o_orderstatus", "o_orderpriority")
    best = lambda rows, p: rows.groupBy("c_custkey").agg(F.max("amount").alias("amount")).withColumn("priority", F.lit(p))
    last = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("amount"), F.lit(3).alias("priority"))
    rows = best(orders.where("o_orderpriority like '1%'"), 1).unionByName(best(orders.where("o_orderstatus = 'F'"), 2)).unionByName(last)
    return resolve.first_by_priority(rows, ["c_custkey"], "priority", ["amount"])


@_query("""WITH o AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'), m AS (SELECT o_custkey, max(o_orderdate) AS d FROM o GROUP BY 1)
           SELECT o.o_custkey, min(o.o_orderkey) AS o_orderkey, strftime(m.d, '%Y-%m-%d') AS version_date FROM o JOIN m ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.d GROUP BY o.o_custkey, m.d HAVING count(*) = 1""")
def latest_version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.latest_as_of(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", F.lit("1998-06-30").cast("timestamp"), ["o_orderkey"])
    return out.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("version_date"))


@_query("""WITH v AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m%d') AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
           i AS (SELECT o_custkey, o_orderkey, valid_from, CASE WHEN nxt IS NULL THEN '99999999' ELSE strftime(CAST(nxt AS DATE) - 1, '%Y%m%d') END AS valid_to FROM v)
           SELECT * FROM i WHERE valid_from <= '19980630' AND valid_to >= '19980630'""")
def validity_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    own = temporal.validity_intervals(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return own.where(temporal.in_force(F.lit("19980630"), F.col("valid_from"), F.col("valid_to"))).select("o_custkey", "o_orderkey", "valid_from", "valid_to")


@_query("""WITH p AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) || ':' || strftime(o_orderdate, '%Y-%m-%d') AS l, CAST(o_orderkey AS VARCHAR) AS r FROM orders)
           SELECT 'left' AS side, l AS value, count(*) AS partners FROM p GROUP BY l HAVING count(*) > 1 UNION ALL SELECT 'right', r, count(*) FROM p GROUP BY r HAVING count(*) > 1""")
def bijection_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.concat_ws(":", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("l"), F.col("o_orderkey").alias("r"))
    return index.bijection_violations(rows, "l", "r")


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (50, 100) ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return index.page_after(rows.withColumns({"o_custkey": F.col("o_custkey").cast("long")}), ["o_custkey", "o_orderkey"], (50, 100), 50)


@_query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    half = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    last = lambda rows: rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "event_id", "value"), "ts").alias("x")).select("user_id", "event_type", "x.*")
    return index.upsert(last(events.where(F.col("ts") < half)), last(events.where(F.col("ts") >= half)), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


@_query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(DISTINCT lang) AS n_languages FROM documents GROUP BY source")
def languages_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("x"))
    return got.select("source", F.array_join("x", ",").alias("languages"), F.size("x").cast("long").alias("n_languages"))


@_query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey % 5 <> 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
           r(node) AS (SELECT * FROM (VALUES (CAST(4 AS BIGINT)), (CAST(77 AS BIGINT))) UNION SELECT u.b FROM r JOIN u ON r.node = u.a) SELECT node FROM r""")
def sameas_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).cast("long").alias("b"))
    return index.reachable(spark.createDataFrame([(4,), (77,)], "node long"), edges)


@_query("""SELECT event_id, 'U' || CAST(user_id AS VARCHAR) || ':' || CASE WHEN event_id % 2 = 0 THEN 'art:' ELSE '' END || CAST(event_id % 9 AS VARCHAR) || ':official-de' AS cache_key,
                  ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20' AS fresh FROM events""")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    key = present.cache_key(F.concat(F.lit("u"), F.col("user_id").cast("string")), (F.col("event_id") % 9).cast("string"), F.when(F.col("event_id") % 2 == 0, "article"), null, null, null, null, null)
    return _table(spark, sf_dir, "events").select("event_id", key.alias("cache_key"), lookup.fresh(F.col("ts").cast("string"), F.to_timestamp(F.lit("2024-01-20 00:00:00")), 7).alias("fresh"))


@_query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
           n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
           SELECT user_id, min(ts) AS session_start, count(*) AS n_events, arg_max(event_id, ts) AS last FROM n GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.last_of_sessions(_table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "event_id").drop("session_end")


#: White space of all scripts, and what is put into every page: references, a quote, tags.
_SQL_SPACE = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PLANTED = ("<p>&#252; &#xE4;&uuml;&Auml;&sect; &amp;lt; &apos;&nope; &nbsp;x &#1114112; &AMP;</p><blockquote>n<br>o</blockquote><p> A  <b>b</b>&#", ";</p>")
_NORM = '<div class="x jnhtml"><div class="jurAbsatz">(1) Wer &uuml;ber <div>&sect;</div></div><p>no</p><div class="jurAbsatz">(2) b<br/>c</div></div>'


def _page_sql(silent: str, ends: str, tag: str, names: dict[str, str], *, br: bool = True, comments: bool = False, body: bool = False, lines: bool = True, first: bool = False, any_case: bool = False, boe: bool = False, norm: bool = False) -> str:
    page = f"('<html><head><title>t</title></head><body class=\"b\">{_PLANTED[0]}' || CAST(1000 + page_id AS VARCHAR) || '{_PLANTED[1]}' || html || '</body><p>behind</p>')"
    key = "lower(t)" if any_case else "t"
    named = " ".join(f"WHEN {key} = '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in names.items())
    hexa, deci = "TRY_CAST('0x' || substr(t, 4, length(t) - 4) AS INT)", "TRY_CAST(substr(t, 3, length(t) - 3) AS INT)"
    one = f"CASE WHEN t ILIKE '&#x%' THEN coalesce(CASE WHEN {hexa} <= 1114111 THEN chr({hexa}) END, t) WHEN t LIKE '&#%' THEN coalesce(CASE WHEN {deci} <= 1114111 THEN chr({deci}) END, t) {named} ELSE t END"
    if boe:  # decimal numbers, then one name after the other
        one = f"CASE WHEN regexp_full_match(t, '&#[0-9]+;') THEN coalesce(CASE WHEN {deci} <= 1114111 THEN chr({deci}) END, t) ELSE t END"
    decode = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '(?is)&(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);|[^&]+|&'), lambda t: {one}), '')"
    out = page
    if comments:
        out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    for s in silent.split():
        out = f"regexp_replace({out}, '(?is)<{s}\\b[^>]*>.*?</{s}\\s*>', '', 'g')"
    if body:
        out = f"regexp_extract({out}, '(?is)<body\\b[^>]*>(.*?)</body>', 1)"
    if first:
        out = decode(out)
    if br:
        out = f"regexp_replace({out}, '(?i)<br\\s*/?\\s*>', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)</(?:{ends})\\s*>', chr(10), 'g'), '<[^>]+>', '{tag}', 'g')"
    if not first:
        out = decode(out)
    if boe:
        for k, v in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
            out = f"regexp_replace({out}, '(?i)&{k};', '{v}', 'g')"
    if lines:
        text = f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(regexp_replace(x, '{_SQL_SPACE}+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
    else:
        text = f"regexp_replace(regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), '{_SQL_SPACE}*\\n{_SQL_SPACE}*', chr(10), 'g'), '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')"
    if norm:
        text = f"CASE WHEN page_id % 2 = 1 THEN '(1) Wer über &sect;' || chr(10) || '(2) b' || chr(10) || 'c' ELSE {text} END"
    return f"SELECT page_id, {text} AS text FROM pages"


def _page_text(source: str):
    def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
        norm = F.when(F.col("page_id") % 2 == 1, _NORM).otherwise("") if source == "gii" else F.lit("")
        page = F.concat(F.lit('<html><head><title>t</title></head><body class="b">' + _PLANTED[0]), (F.col("page_id") + 1000).cast("string"), F.lit(_PLANTED[1]), norm, "html", F.lit("</body><p>behind</p>"))
        if source == "fedlex":
            page = F.concat(F.lit(f"<title>t</title>{_PLANTED[0]}"), (F.col("page_id") + 1000).cast("string"), F.lit(_PLANTED[1]), "html", F.lit("<p></p>" + _SWISS_FORMS[0]))
        return _table(spark, sf_dir, "pages").select("page_id", extract.html_text(page, source).alias("text"))

    page_text.__name__ = f"page_text_{source}"
    return page_text


#: What the Swiss rules are about: lists of terms, cells, articles, escaped tags; and its text.
_SWISS_FORMS = ("<dl><dt>a.</dt><dd>Text</dd><dt>b.</dt><dd>Mehr</dd></dl><table><tr><th>k</th><td>x</td><td>y</td></tr></table><article>p</article>q&lt;/p&gt;r<sup>2</sup>", "a. Text\nb. Mehr\nk x y\np\nqr2")


def _fedlex_sql() -> str:
    """By what stands where: the text of the planted forms is given, that of the rest is made with single replacements."""
    page = f"('<title>t</title>{_PLANTED[0]}' || CAST(1000 + page_id AS VARCHAR) || '{_PLANTED[1]}' || html)"
    out = f"regexp_replace({page}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    for tag, into in [("<dt>", "chr(10)"), ("<dd>", "' '"), *[(f"</{t}>", "chr(10)") for t in ("dd", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "section", "article", "ol", "ul", "tr")], ("</td>", "' '"), ("</th>", "' '"), ("<br>", "chr(10)"), ("<br/>", "chr(10)"), ("<br />", "chr(10)")]:
        out = f"replace({out}, '{tag}', {into})"
    named = " ".join(f"WHEN t = '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in (_SQL_GERMAN | {"apos": "'", "sect": "§"}).items())
    number = lambda digits: f"coalesce(CASE WHEN {digits} <= 1114111 THEN chr({digits}) END, t)"
    one = f"CASE WHEN t ILIKE '&#x%' THEN {number("TRY_CAST('0x' || substr(t, 4, length(t) - 4) AS INT)")} WHEN t LIKE '&#%' THEN {number('TRY_CAST(substr(t, 3, length(t) - 3) AS INT)')} {named} ELSE t END"
    out = f"array_to_string(list_transform(regexp_extract_all({out}, '(?is)&(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);|[^&]+|&'), lambda t: {one}), '')"
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g'), '{_SQL_SPACE}*\\n{_SQL_SPACE}*', chr(10), 'g')"
    forms = _SWISS_FORMS[1].replace("\n", "' || chr(10) || '")
    return f"SELECT page_id, regexp_replace({out}, '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g') || chr(10) || '{forms}' AS text FROM pages"


_SQL_BASIC = {"amp": "&", "lt": "<", "gt": ">", "quot": '"'}
_SQL_GERMAN = _SQL_BASIC | {"nbsp": " ", "szlig": "ß", "auml": "ä", "Auml": "Ä", "ouml": "ö", "Ouml": "Ö", "uuml": "ü", "Uuml": "Ü"}
_SQL_ITALIAN = _SQL_BASIC | {"apos": "'", "nbsp": " ", "agrave": "à", "egrave": "è", "igrave": "ì", "ograve": "ò", "ugrave": "ù", "eacute": "é", "ocirc": "ô"}
_query(_page_sql("", "h[1-6]|p|div|section|li|dt|dd|ol|ul", " ", _SQL_GERMAN, body=True, lines=False))(_page_text("neuris"))
_query(_page_sql("script style", "h[1-6]|p|div|li|dt|dd|dl", " ", _SQL_GERMAN, comments=True, body=True, lines=False, norm=True))(_page_text("gii"))
_query(_page_sql("script style nav", "p|div|li|br|tr|h[0-9]", " ", _SQL_BASIC | {"apos": "'"}, br=False, comments=True, any_case=True))(_page_text("eurlex"))
_query(_fedlex_sql())(_page_text("fedlex"))
_query(_page_sql("blockquote", "p|tr|td|th|div|li", "", {}, boe=True))(_page_text("boe"))
_query(_page_sql("script style", "div|p|h[1-6]|li|tr|section|article", "", _SQL_ITALIAN, any_case=True))(_page_text("normattiva"))


@_query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
                  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages""")
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", extract.page_title(F.col("html")).alias("title"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), F.try_parse_url(url, F.lit("QUERY")).alias("query"))


@_query("SELECT doc_id, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM documents")
def markdown_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", present.quoted(F.col("text")).alias("quoted"))


@_query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.code') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events")
def json_field_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.code").try_cast("long"), F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


@_query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, merged into a two-slot index: what index_upsert makes in a batch."""
    home = f"{index.shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    # the table is a file or a folder of files, among other tables
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque[t]").select("user_id", "event_type", "ts", "event_id", "value")
    store = index.SlotStore(spark, f"{home}/store")
    sync.upsert_stream(events, store, ["user_id", "event_type"], "ts", f"{home}/progress").awaitTermination()
    return store.read().select("user_id", "event_type", "event_id", "value")


@_query("""WITH a(celex, kind) AS (VALUES ('32016R0679', 'R'), ('32022L2555', 'L'), ('32099D1234', 'D'))
           SELECT celex, kind AS document_type, count(*) AS n_orders FROM a JOIN orders ON o_orderkey % 3 = CASE kind WHEN 'R' THEN 0 WHEN 'L' THEN 1 ELSE 2 END GROUP BY ALL""")
def citation_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts cited by name, in a language that changes from order to order."""
    acts = [(0, 2016, 679, 2), (1, 2022, 2555, 3), (2, 2099, 1234, 4)]
    forms = [(i, rest, w[1][0], f"{w[kind]} ({w[-1]}) {year}/{number}") for i, w in enumerate(catalogs.CITATION_WORDS) for rest, year, number, kind in acts]
    table = F.broadcast(spark.createDataFrame(forms, "i int, rest int, mark string, act string"))  # three rows a language
    orders = _table(spark, sf_dir, "orders")
    cited = orders.join(table, (F.floor(orders["o_orderkey"] / 3) % len(catalogs.CITATION_WORDS) == table["i"]) & (orders["o_orderkey"] % 3 == table["rest"]))
    texts = cited.select(F.concat_ws(" ", "mark", (F.col("o_orderkey") % 90 + 1).cast("string"), "act").alias("t"))
    rows = citations.parse_citations(texts, "t", "EU", "r")
    return rows.groupBy(F.col("r.eu_celex").alias("celex"), F.col("r.eu_document_type").alias("document_type")).agg(F.count("*").alias("n_orders"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'contract' WHEN o_orderkey % 5 = 3 THEN 'ok' ELSE 'not-found' END AS status,
                  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 = 3 THEN o_orderpriority END AS text FROM orders""")
def strict_xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of composed documents, of which some are broken or of another identity."""
    orders = _table(spark, sf_dir, "orders")
    code = F.format_string("BWBR%07d", "o_custkey")
    article = F.concat(F.lit('<artikel label="Artikel '), (F.col("o_orderkey") % 5).cast("string"), F.lit('"><al>'), F.col("o_orderpriority"), F.lit("</al></artikel>"))
    end = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("</wetgeving></toestand>")
    xml = F.concat(F.lit('<toestand bwb-id="'), F.when(F.col("o_orderkey") % 13 == 0, "BWBR0").otherwise(code), F.lit('" bwb-ng-vast-deel="1"><wetgeving xml:lang="nl">'), article, end)
    got = orders.select("o_orderkey", payloads.bwb_article(xml, code, F.lit("1"), F.lit("3")).alias("x"))
    return got.select("o_orderkey", F.col("x.status").alias("status"), F.col("x.text").alias("text"))
