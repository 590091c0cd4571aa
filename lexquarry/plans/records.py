"""Queries over captured records: notices, descriptions, lookups in hops; composed from orders, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import laws
from ..operators import tables
from ..sources import bwb, cellar, eurlex, german, neuris
from .registry import _CELEX, _VALID, _celex_of_orders, _query, _table

_UUID_SQL = "printf('%08x-0000-4000-8000-%012x', o_orderkey, o_orderkey * 7)"


def _uuid(key: Column) -> Column:
    return F.format_string("%08x-0000-4000-8000-%012x", key, key * 7)


def _notice(key: Column, f: Column, celex: Column) -> Column:
    """An identifier notice; by f with another act, two works, another number, and forms that aren't one."""
    block = lambda kind, identifier, value: F.concat(F.lit(f"<URI>\n<TYPE>{kind}</TYPE><IDENTIFIER>"), identifier, F.lit("</IDENTIFIER><VALUE>"), value, F.lit("</VALUE></URI>"))
    base = "publications.europa.eu/resource"
    act = F.when(f == 1, "32000R00001").otherwise(celex)
    work = F.concat(F.lit(f"http://{base}/cellar/"), _uuid(key), F.when(f == 3, "x").otherwise(""))
    same = lambda inner: F.concat(F.lit("<SAMEAS> "), inner, F.lit("</SAMEAS>"))
    return F.concat(
        F.when(f == 4, "<NOTICE>").when(f == 5, '<NOTICE type="identifier" lang="en">').otherwise('<?xml version="1.0"?>\n<NOTICE embargo-date="2000-01-01" type="identifier">'),
        block("cellar", _uuid(key), work), F.when(f == 2, same(block("cellar", _uuid(key + 1), F.concat(F.lit(f"http://{base}/cellar/"), _uuid(key + 1))))).otherwise(""),
        F.when(f == 6, "<!-- note -->").when(f == 7, "text").when(f == 8, "<SAMEAS/>").when(f == 9, "<URI><TYPE>x</TYPE><TYPE>x</TYPE><IDENTIFIER>y</IDENTIFIER><VALUE>z</VALUE></URI>").when(f == 10, "<URI><TYPE></TYPE><IDENTIFIER>y</IDENTIFIER><VALUE>z</VALUE></URI>").otherwise("\n"),
        same(block("celex", act, F.concat(F.lit(f"https://{base}/celex/"), act))), block("oj", F.lit("L_1"), F.lit("http://x/y")), F.when(f == 11, "").otherwise("</NOTICE>"),
    )


@_query(f"""WITH c AS ({_CELEX}) SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 16 NOT BETWEEN 1 AND 11 THEN {_UUID_SQL} END AS uuid FROM c""")
def identifier_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by composed notices, one for each order, of which most are wrong in one way."""
    acts = _celex_of_orders(_table(spark, sf_dir, "orders")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # they are small, the notices aren't
    key = F.col("o_orderkey")
    return cellar.notice_uuids(acts.select(key.alias("ref_id"), "celex", _notice(key, key % 16, F.col("celex")).alias("notice")))


def _description(key: Column, f: Column, celex: Column) -> Column:
    """An RDF record whose nodes have the same names in every record; by f without number, sameness, or address."""
    node = lambda about, inner: F.concat(F.lit('<rdf:Description rdf:about="'), about, F.lit('">'), inner, F.lit("</rdf:Description>"))
    act = F.concat(F.lit("http://publications.europa.eu/resource/celex/"), F.when(f == 3, "0").otherwise(celex))
    work, other = F.lit("http://x/work"), F.lit("http://x/other")
    uses = lambda lang, of: F.concat(F.lit('<cdm:expression_belongs_to_work rdf:resource="'), of, F.lit(f'"/><cdm:expression_uses_language rdf:resource="http://x/{lang}"/>'))
    named = lambda lang: F.lit(f"<dc:identifier> {lang} </dc:identifier>")
    title = lambda lang, text: F.concat(F.lit(f'<cdm:title xml:lang="{lang}">'), text, F.lit("</cdm:title>"))
    return F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:cdm="http://publications.europa.eu/ontology/cdm#" xmlns:dc="http://purl.org/dc/elements/1.1/">'),
        node(act, F.concat(F.lit('<owl:sameAs rdf:resource="http://x/middle"/>'), title("ENG", F.concat(F.lit("Act &amp; "), key.cast("string"))))), node(work, F.concat(F.when(f == 2, "").otherwise('<owl:sameAs rdf:resource="http://x/middle"/>'), F.lit("<cdm:year>2000</cdm:year>"))),
        node(F.lit("http://x/middle"), F.concat(F.lit("<cdm:work_id_document>celex:"), F.when(f == 1, "1").otherwise(celex), F.lit("</cdm:work_id_document>"))), node(F.lit("http://x/DEU"), named("DEU")), node(F.lit("http://x/fra"), named("fra")), node(F.lit("http://x/zz"), named("zz")),
        node(F.lit("http://x/e1"), F.concat(uses("DEU", work), title("deu", F.lit("Alt")), title("deu", F.lit("Akt")), title("de", F.lit("no")))), node(F.lit("http://x/e2"), uses("fra", F.when(f == 4, other).otherwise(work))), node(F.lit("http://x/e3"), uses("zz", work)), node(other, F.lit('<owl:sameAs rdf:resource="http://x/apart"/>')),
        F.lit("</rdf:RDF>"),
    )


@_query(f"""WITH c AS ({_CELEX}) SELECT o_orderkey AS ref_id, celex, 'deu=Akt;eng=Act & ' || o_orderkey AS titles, CASE WHEN o_orderkey % 8 = 2 THEN '' WHEN o_orderkey % 8 = 4 THEN 'deu' ELSE 'deu,fra' END AS languages
            FROM c WHERE o_orderkey % 8 NOT IN (1, 3)""")
def rdf_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by composed RDF records, one for each order; all use the same names of nodes."""
    acts = _celex_of_orders(_table(spark, sf_dir, "orders")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # they are small, the records aren't
    key = F.col("o_orderkey")
    got = cellar.rdf_works(acts.select(key.alias("ref_id"), "celex", _description(key, key % 8, F.col("celex")).alias("rdf")))
    titles = F.array_join(F.transform(F.map_entries("titles"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return got.select("ref_id", "celex", titles.alias("titles"), F.array_join("languages", ",").alias("languages"))


def _page(act: Column, f: Column) -> Column:
    """The page of an act with two articles, of which one holds elements of its own name; by f a page to keep robots out."""
    article = lambda n, inner: F.concat(F.lit(f'<div class="eli-subdivision" id="art_{n}"><p class="oj-ti-art">Article {n}</p><div class="x eli-title"><p class="oj-sti-art">Heading &amp; more</p></div>'), inner, F.lit("</div>"))
    body = F.concat(F.lit("<div>(1) Text of <b>"), act, F.lit("</b><br/>is<div>\n  nested </div></div><script>no()</script><p>&#x45;nd</p>"))
    return F.concat(F.when(f == 6, "<p>Just a moment</p>").otherwise(""), F.lit('<html><body><p class="oj-doc-ti">Act of '), act, F.lit("</p>"), article("1", F.lit("<p>One</p>")), article("2", body), F.lit("</body></html>"))


@_query(f"""WITH c AS ({_CELEX}), x AS (SELECT *, CAST(substr(celex, 7) AS INT) % 9 AS f, o_orderkey % 4 AS s FROM c),
            y AS (SELECT *, CASE WHEN NOT ({_VALID}) OR s = 3 OR f IN (1, 4) THEN 'not-found' WHEN f IN (2, 3) THEN 'unavailable' WHEN s = 2 THEN CASE WHEN f IN (5, 7) THEN 'ok' ELSE 'language-unavailable' END
                      WHEN f = 5 THEN 'language-unavailable' WHEN f = 7 THEN 'unavailable' WHEN f = 6 OR f = 8 AND s = 0 THEN 'not-found' ELSE 'ok' END AS status FROM x)
            SELECT o_orderkey AS ref_id, status, CASE WHEN status = 'ok' THEN 'Heading & more' END AS heading, CASE WHEN status = 'ok' THEN CASE WHEN s = 1 THEN 'One' ELSE '(1) Text of ' || celex || ' is' || chr(10) || 'nested' || chr(10) || 'End' END END AS text,
                   CASE WHEN status = 'ok' THEN 'Act of ' || celex END AS law_title FROM y""")
def eurlex_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by two requests. By the act's number f: no notice (1), a failed one (2), none captured (3), another act's
    (4), pages in French only (5, 7; German is absent or failed), a page for robots (6), without article 2 (8). By the
    order s: article 2, 1, article 2 in French, no article number."""
    acts = _celex_of_orders(_table(spark, sf_dir, "orders")).withColumn("f", F.substring("celex", 7, 4).cast("int") % 9)
    s = F.col("o_orderkey") % 4
    refs = acts.select(F.col("o_orderkey").alias("ref_id"), "celex", F.when(s == 1, "1").when(s == 3, "x").otherwise("2").alias("section"), F.when(s == 2, "fr").alias("language"), F.col("celex").alias("law_code"), F.lit("").alias("law_title"))
    once = acts.groupBy("celex", "f").agg(F.min("o_orderkey").alias("key"))
    f = F.col("f")
    answer = lambda request, status, body: F.struct(request.alias("request"), status.cast("int").alias("status"), body.alias("body"))
    notice = answer(eurlex.notice_request(F.col("celex")), F.when(f == 1, 404).when(f == 2, 503).otherwise(200), _notice(F.col("key"), F.when(f == 4, 1).otherwise(0), F.col("celex")))
    page = answer(eurlex.page_request(_uuid(F.col("key")), F.when(f.isin(5, 7), "fra").otherwise("deu")), F.lit(200), F.when(f == 8, F.replace(_page(F.col("celex"), f), F.lit("art_2"), F.lit("art_3"))).otherwise(_page(F.col("celex"), f)))
    bad = answer(eurlex.page_request(_uuid(F.col("key")), F.when(f.isin(5, 7), "deu").otherwise("fra")), F.when(f == 7, 500).otherwise(404), F.lit(""))
    payloads = tables.stored(once.where("f <> 3").select(F.explode(F.array(notice, page, bad)).alias("a")).select("a.*"), "payloads")
    got = eurlex.eurlex_sections(refs, payloads, F.lit("2024-05-06T07:08:09Z"))
    return got.select("ref_id", "status", "section.heading", "section.text", "section.law_title")


def _captured(refs: DataFrame, jurisdiction: str, catalog: DataFrame, variant: str | None, status: Column, body: Column) -> DataFrame:
    """The answers to the requests of refs, each once. They are composed for what is asked, not for every reference."""
    own = refs.select("law_code", "section", "subsection", "reference_type").distinct().withColumns({"jurisdiction": F.lit(jurisdiction), "variant": F.lit(variant).cast("string")})
    return laws.section_url(own, catalog).where("url is not null").select(F.col("url").alias("request"), status.cast("int").alias("status"), body.alias("body")).dropDuplicates(["request"])


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS f, o_orderkey % 300 AS n FROM orders)
           SELECT o_orderkey AS ref_id, CASE f WHEN 5 THEN 'not-found' WHEN 6 THEN 'unavailable' ELSE 'ok' END AS status,
                  CASE f WHEN 0 THEN 'Kopf von ' || n WHEN 1 THEN 'Mord' WHEN 2 THEN 'Inhalt' WHEN 4 THEN 'Article ' || n || '.' END AS heading,
                  CASE f WHEN 0 THEN '§ ' || n || ' – Kopf von ' || n || chr(10) || '(1) Ärger & § 2 gilt.' || chr(10) || '(2) Ende ' || n || '.' WHEN 1 THEN 'Wer tötet, wird bestraft.' || chr(10) || 'Besonderer Teil' WHEN 2 THEN 'Eine Zeile' || chr(10) || '§ ' || n || chr(10) || 'Inhalt des Rechts, der länger als dreißig ist'
                    WHEN 3 THEN 'Nur so.' WHEN 4 THEN 'The Court ' || n || chr(10) || 'decides.' END AS text FROM x""")
def ris_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Austrian sections. By the order f: a page with labels (0), with a title and parts (1), a marked part (2), neither
    (3), the English constitution (4), no page (5), a failed one (6)."""
    key = F.col("o_orderkey")
    f, n = key % 7, (key % 300).cast("string")
    orders = _table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    refs = orders.select(key.alias("ref_id"), F.element_at(F.array(*[F.lit(c) for c in ("ABGB", "stgb", "ZPO", "JN", "B-VG", "EO", "UGB")]), (f + 1).cast("int")).alias("law_code"), n.alias("section"), none.alias("subsection"), none.alias("reference_type"), F.when(f == 4, "translation-en").alias("variant"))
    own, s = F.lower("law_code"), F.col("section")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    page = (
        F.when(own == "abgb", text("<html><body><script>Text</script><h1>Bundesrecht konsolidiert</h1><div>Startseite<br>Kurztitel</div><p>Text</p><p>Allgemeiner Teil</p><p>§ ", s, " – Kopf von ", s, "</p><p>§ ", s, "</p><p>(1) &Auml;rger &amp;<b>&sect; 2</b>gilt.</p><p>SmartPage_Context()</p><p>(2) Ende ", s, ".</p><p>Schlagworte</p><p>weg</p></body></html>"))
        .when(own == "stgb", text("<body><h1>AT-StGB<br>Mord</h1><p>Kurztitel</p><p>Besonderer Teil</p><p>§ ", s, ".</p><p>Wer tötet, wird bestraft.</p><p>Besonderer Teil</p><p>Dokumentnummer</p></body>"))
        .when(own == "zpo", text('<body><p>x</p><div id="tabContent"><p>Inhalt</p><p>Eine Zeile</p><p>§ ', s, "</p><p>Seite 1 von 2</p><p>Inhalt des Rechts, der länger als dreißig ist</p></div><p>y</p></body>"))
        .when(own == "jn", text("<p>Impressum</p><p>Nur so.</p><p>Kontakt</p>")).otherwise(text("<p>z</p>"))
    )
    status = F.when(own == "eo", 404).when(own == "ugb", 500).otherwise(200)
    catalog = laws.laws(spark)
    row = lambda k, inner: F.concat(F.lit("<tr><td><h3>Artikel "), k, F.lit("</h3>DE</td><td>"), inner, F.lit("</td></tr>"))
    article = lambda k: F.concat(row(k, F.concat(F.lit("<h3>Article&nbsp;"), k, F.lit(".</h3>"))), row(k, F.concat(F.lit('<span class="sr-only">Paragraph 1,</span>The Court '), k, F.lit("<br/>decides."))))
    # the English constitution is one page with all articles
    english = spark.range(1).select(F.lit(laws.AUSTRIAN_ENGLISH).alias("request"), F.lit(200).alias("status"), F.concat(F.lit("<table>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: article(F.replace(i.cast("string"), F.lit(" "), F.lit("")))), ""), F.lit("</table>")).alias("body"))
    english = english.withColumn("body", F.replace("body", F.lit("&nbsp;"), F.lit(" ")))
    payloads = tables.stored(_captured(refs.where("variant is null"), "AT", catalog, None, status, page).unionByName(english), "payloads")
    got = german.ris_sections(refs, payloads, catalog, F.lit("2024-05-06T07:08:09Z"))
    return got.select("ref_id", "status", "section_row.heading", "section_row.text")


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS f, o_orderkey % 300 AS n FROM orders)
           SELECT o_orderkey AS ref_id, CASE f WHEN 4 THEN 'not-found' WHEN 5 THEN 'unavailable' ELSE 'ok' END AS status, CASE f WHEN 0 THEN 'translation-en' WHEN 2 THEN 'translation-en' WHEN 1 THEN 'official-de' WHEN 3 THEN 'official-de' END AS source_variant,
                  CASE f WHEN 0 THEN 'Heading ' || n WHEN 2 THEN 'Dignity ' || n WHEN 1 THEN 'Titel' WHEN 3 THEN 'Norm ' || n END AS heading, CASE f WHEN 0 THEN '(1) Text ' || n || chr(10) || '(2) more' WHEN 2 THEN 'Human' WHEN 1 THEN 'Absatz ' || n WHEN 3 THEN 'Artikel ' || n END AS text FROM x""")
def gii_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German sections. By the order f: an English one behind a list of contents (0), one that only the German page has
    (1), an English article with its heading in brackets (2), a norm among many (3), no page (4), a failed one (5)."""
    key = F.col("o_orderkey")
    f, n = key % 6, (key % 300).cast("string")
    none = F.lit(None).cast("string")
    orders = _table(spark, sf_dir, "orders")
    refs = orders.select(
        key.alias("ref_id"), F.element_at(F.array(*[F.lit(c) for c in ("BGB", "STGB", "GG", "EGBGB", "HGB", "ZPO")]), (f + 1).cast("int")).alias("law_code"), n.alias("section"), none.alias("subsection"),
        F.when(f.isin(2, 3), "article").alias("reference_type"), F.when(f < 3, "translation-en").alias("variant"),
    )
    code, s = F.col("law_code"), F.col("section")
    every = lambda form: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: form(i.cast("string"))), "")
    line = lambda *xs: F.concat(F.lit("<p>"), *[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit("</p>"))
    contents = every(lambda i: line("Section ", i))
    sections = every(lambda i: F.concat(line("Section ", i), line("Heading ", i), line("(1) Text ", i), line("(2) more")))
    articles = every(lambda i: F.concat(line("Article ", i), line("[Dignity ", i, "]"), line("Human"), F.lit("<ul><li>table of contents</li></ul>")))
    norms = every(lambda i: F.concat(F.lit('<div class="jnnorm"><h3><span class="x">Art&nbsp;'), i, F.lit('</span> <span class="jnentitel">Norm '), i, F.lit('</span></h3><div class="jnhtml"><div class="jurAbsatz">Artikel '), i, F.lit("</div></div></div>")))
    catalog = laws.laws(spark)
    body = F.when(code == "BGB", F.concat(contents, F.lit("<p>table of contents</p>"), sections)).when(code == "GG", articles).otherwise("<p>Section x</p>")
    # an English page holds all sections of its law: one of them names it
    english = _captured(refs.where("variant is not null").withColumn("section", F.lit("1")), "DE", catalog, "translation-en", F.lit(200), body)
    page = F.when(code == "EGBGB", norms).otherwise(F.concat(F.lit('<span class="jnentitel">Titel</span><div class="jnhtml"><div class="jurAbsatz">Absatz '), s, F.lit("</div></div>")))
    own = _captured(refs.where("law_code <> 'BGB' and law_code <> 'GG'"), "DE", catalog, None, F.when(code == "HGB", 404).when(code == "ZPO", 500).otherwise(200), page)
    payloads = tables.stored(english.unionByName(own), "payloads")
    got = german.gii_sections(refs, payloads, catalog, F.lit("2024-05-06T07:08:09Z"))
    return got.select("ref_id", "status", "section_row.source_variant", "section_row.heading", "section_row.text")


@_query("""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS f, o_orderkey % 300 AS n FROM orders)
           SELECT o_orderkey AS ref_id, CASE WHEN f IN (2, 5) OR f < 2 AND n % 50 = 49 THEN 'not-found' WHEN f IN (3, 4) OR f < 2 AND n % 50 = 48 THEN 'unavailable' ELSE 'ok' END AS status,
                  CASE WHEN f < 2 AND n % 50 < 48 THEN 'Kopf ' || n END AS heading, CASE WHEN f < 2 AND n % 50 < 48 THEN 'Absatz ' || n || ' & mehr' END AS text, CASE WHEN f < 2 AND n % 50 < 48 THEN CASE WHEN n % 2 = 0 THEN '2002-01-01' ELSE '1900-01-01' END END AS valid_from FROM x""")
def neuris_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German sections by three requests. By the order f: two laws (0, 1), one that the search hasn't (2), a search that
    failed (3) or is no JSON (4), English (5); some sections are missing, some pages failed."""
    key = F.col("o_orderkey")
    f, n = key % 6, (key % 300).cast("string")
    none = F.lit(None).cast("string")
    refs = _table(spark, sf_dir, "orders").select(key.alias("ref_id"), F.element_at(F.array(*[F.lit(c) for c in ("bgb", "HGB", "XYZ", "ERR", "BAD", "BGB")]), (f + 1).cast("int")).alias("law_code"), n.alias("section"), F.when(f == 5, "translation-en").alias("variant"))
    # the outline has books, in them titles, in them sections; a later part has the name of an earlier one
    section = lambda i: F.concat(F.lit('{"name": "§ '), i, F.lit('", "eId": "art-'), i, F.lit('", "headline": "Kopf '), i, F.lit('"'), F.when(i.cast("int") % 2 == 0, ', "temporalCoverage": "2002-01-01/.."').otherwise(""), F.lit("}"))
    book = lambda b: F.concat(F.lit('{"name": "Buch", "hasPart": [{"name": "Titel", "hasPart": ['), F.array_join(F.transform(F.sequence(b * 50, b * 50 + 48), lambda i: section(i.cast("string"))), ","), F.lit(']}, {"name": "§ '), (b * 50).cast("string"), F.lit('", "eId": "other"}]}'))
    law = F.concat(F.lit('{"name": "Gesetz", "abbreviation": "'), F.upper("law_code"), F.lit('", "temporalCoverage": "1900-01-01/..", "encoding": [{"encodingFormat": "application/xml", "contentUrl": "/x.xml"}, {"encodingFormat": "text/html", "contentUrl": "/v1/'), F.lower("law_code"), F.lit('.html"}], "hasPart": ['), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), book), ","), F.lit("]}"))
    search = F.when(F.col("law_code") == "BAD", "no").otherwise(F.concat(F.lit('{"member": [{"item": {"@id": "/v1/0"}}, {"item": {"@id": "/v1/1", "abbreviation": "BGBEG"}}, {"item": {"@id": "/v1/law/bgb", "abbreviation": "BGB"}}, {"item": {"@id": "/v1/law/hgb", "abbreviation": "Hgb"}}, {"item": {"@id": "/v1/2", "abbreviation": "BGB"}}]}')))
    answer = lambda request, status, body: F.struct(request.alias("request"), F.lit(status).cast("int").alias("status") if isinstance(status, int) else status.cast("int").alias("status"), body.alias("body"))
    codes = refs.select("law_code").distinct()
    laws_ = codes.where("law_code in ('bgb', 'HGB')").select(answer(F.concat(F.lit(f"{neuris.BASE}/v1/law/"), F.lower("law_code")), 200, law).alias("a"))
    pages = refs.where("law_code in ('bgb', 'HGB')").select("law_code", "section").distinct()
    page = F.concat(F.lit("<html><body><p>Absatz "), F.col("section"), F.lit(" &amp; mehr</p></body></html>"))
    pages = pages.select(answer(F.concat(F.lit(f"{neuris.BASE}/v1/"), F.lower("law_code"), F.lit("/art-"), "section", F.lit(".html")), F.when(F.col("section").cast("int") % 50 == 48, 502).otherwise(200), page).alias("a"))
    searches = codes.select(answer(neuris.search_request(F.col("law_code")), F.when(F.col("law_code") == "ERR", 503).otherwise(200), search).alias("a"))
    payloads = tables.stored(searches.unionByName(laws_).unionByName(pages).select("a.*"), "payloads")
    got = neuris.neuris_sections(refs, payloads, F.lit("2024-05-06T07:08:09Z"))
    return got.select("ref_id", "status", "section_row.heading", "section_row.text", "section_row.valid_from")


@_query("""WITH x AS (SELECT o_orderkey, o_custkey % 9 AS f, o_custkey AS c, o_orderkey % 4 AS s FROM orders)
           SELECT o_orderkey AS ref_id, CASE WHEN f IN (1, 6) OR s = 3 AND f NOT IN (2, 3, 4, 5, 7) THEN 'not-found' WHEN f IN (2, 3, 4, 7) THEN 'contract' WHEN f = 5 THEN 'unavailable' WHEN s = 2 THEN 'contract' ELSE 'ok' END AS status,
                  CASE WHEN f IN (0, 8) AND s < 2 THEN CASE s WHEN 0 THEN 'Eerste ' || c || ' lid nadruk' || chr(10) || 'Tweede' ELSE 'Los' END END AS text, CASE WHEN f IN (0, 8) AND s < 2 THEN 'Wet & meer' END AS law_title FROM x""")
def bwb_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dutch articles by two requests. By the law f: no state (1), two of them (2), one of another law (3) or day (4), a
    failed answer (5), no document (6), another document (7). By the order s: articles 1a, 2, 3 (without text), 4 (twice)."""
    orders = _table(spark, sf_dir, "orders")
    code = F.format_string("BWBR%07d", (F.col("o_custkey") % 10000000).cast("int"))
    s = F.col("o_orderkey") % 4
    refs = orders.select(F.col("o_orderkey").alias("ref_id"), F.lower(code).alias("law_code"), F.when(s == 0, "1A").otherwise((s + 1).cast("string")).alias("section"))
    once = orders.select((F.col("o_custkey") % 9).alias("f"), code.alias("code"), F.col("o_custkey").cast("string").alias("c")).distinct()
    f, day = F.col("f"), "2000-06-30"
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value if not isinstance(value, str) else F.lit(value), F.lit(f"</{name.split(' ')[0]}>"))
    state = F.concat(F.lit("http://wetten.overheid.nl/id/"), "code", F.lit("/2000-01-01/0"))
    other = F.when(f == 3, "BWBR9999999").otherwise(F.col("code"))
    place = F.concat(F.lit("https://repository.officiele-overheidspublicaties.nl/bwb/"), other, F.lit("/2000-01-01_0/xml/"), other, F.lit("_2000-01-01_0.xml"))
    record = tag("srw:record", F.concat(
        tag("dcterms:identifier", F.col("code")), tag("dcterms:title", " Wet  &amp; meer"), tag("overheidbwb:toestand", state), tag("overheidbwb:locatie_toestand", place), tag("overheidbwb:geldigheidsperiode_startdatum", "2000-01-01"),
        tag("overheidbwb:geldigheidsperiode_einddatum", F.when(f == 4, "2000-06-29").otherwise(day)), tag("overheidbwb:zichtperiode_startdatum", day), tag("overheidbwb:zichtperiode_einddatum", "9999-12-31"),
    ))
    count = F.when(f == 1, 0).when(f == 2, 2).otherwise(1)
    search = tag("srw:searchRetrieveResponse", F.concat(tag("srw:numberOfRecords", count.cast("string")), F.array_join(F.array_repeat(record, count), "")))
    article = lambda label, inner: F.concat(F.lit(f'<artikel label="Artikel {label}">'), inner if not isinstance(inner, str) else F.lit(inner), F.lit("</artikel>"))
    text = F.concat(article("1a", F.concat(F.lit("<kop>x</kop><lid><al>Eerste "), "c", F.lit(" <nadruk>nadruk</nadruk>lid</al></lid><lid><al> Tweede </al></lid>"))), article("2", "<al>Los</al>"), article("3", "<kop>y</kop>"), article("4", "<al>z</al>"), article("4", "<al>z</al>"))
    document = F.concat(F.lit('<?xml version="1.0"?><toestand bwb-id="'), F.when(f == 7, "BWBR0").otherwise(F.col("code")), F.lit('" bwb-ng-vast-deel="'), state, F.lit('"><wetgeving xml:lang="nl">'), text, F.lit("</wetgeving></toestand>"))
    answer = lambda request, status, body: F.struct(request.alias("request"), status.cast("int").alias("status"), body.alias("body"))
    both = F.array(answer(bwb.search_request(F.col("code"), F.lit(day)), F.when(f == 5, 500).otherwise(200), search), answer(place, F.when(f == 6, 404).otherwise(200), document))
    payloads = tables.stored(once.select(F.explode(both).alias("a")).select("a.*").where("request not like '%9999999%'"), "payloads")
    got = bwb.bwb_sections(refs, payloads, F.lit(day), F.lit("2024-05-06T07:08:09Z"))
    return got.select("ref_id", "status", "section_row.text", "section_row.law_title")
