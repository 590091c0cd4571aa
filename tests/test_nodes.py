"""Documents as tables of nodes, and what is read from them by joins."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from lexquarry.operators import index
from lexquarry.sources import boe, bwb, cellar, nodes


def _shred(spark, docs, **how):
    return nodes.shred(spark.createDataFrame(list(enumerate(docs)), "k int, x string"), ["k"], "x", **how)


def _random_tree(rng, depth=0):
    inner = "".join(rng.choice([lambda: "tëxt &amp; ", lambda: _random_tree(rng, depth + 1), lambda: "<!--c-->", lambda: "<e/>"])() for _ in range(rng.randrange(4))) if depth < 5 else "x"
    name = rng.choice("abc")
    return f'<{name} q="1">{inner}</{name}>'


def test_nodes_are_those_of_the_tree(spark):
    rng = random.Random(3)
    docs = [_random_tree(rng) for _ in range(60)]
    rows = {}
    for r in _shred(spark, docs, markup_of=("a",)).collect():
        rows.setdefault(r.k, []).append(r)
    for k, doc in enumerate(docs):
        own = sorted(rows[k], key=lambda r: r.pre)
        assert [r.pre for r in own] == list(range(len(own)))
        assert sorted(r.post for r in own) == list(range(len(own)))
        by = {r.pre: r for r in own}
        root = ET.fromstring(doc)
        elements = [r for r in own if r.kind == "element"]
        assert [(r.name, r.text or "") for r in elements] == [(e.tag, (e.text or "") + "".join(c.tail or "" for c in e)) for e in root.iter()]
        for r in own:
            if r.parent is not None:
                p = by[r.parent]
                assert p.pre < r.pre and p.post > r.post and p.depth == r.depth - 1
                assert r.path == p.path + (f"/{r.name}" if r.kind == "element" else "")
            inside = [d for d in own if d.pre > r.pre and d.post < r.post]
            if r.kind == "element":
                tree = [e for e in root.iter()][elements.index(r)]
                assert "".join(d.text for d in inside if d.kind == "text") == "".join(tree.itertext())
            if r.name == "a" and r.kind == "element":
                assert "".join(ET.fromstring(f"<a>{r.markup}</a>").itertext()) == "".join(tree.itertext())


def test_what_cannot_be_read_is_an_error(spark):
    docs = ["", "<a>", "<a></b>", "<a x='1' x='2'/>", "<!DOCTYPE a><a/>", "<a>&nosuch;</a>", "no document", "<a/><b/>"]
    assert sorted((r.k, r.kind) for r in _shred(spark, docs).collect()) == [(i, "error") for i in range(len(docs))]


def test_declarations_prefixes_and_null(spark):
    rows = _shred(spark, ['<?xml version="1.0" encoding="ISO-8859-1"?><p:a xmlns:p="urn:x" xmlns="urn:d"><b c="é>"/><![CDATA[<z>]]></p:a>', None], markup_of=("p:a",)).orderBy("pre").collect()
    assert [(r.k, r.kind, r.name, r.namespace) for r in rows] == [(0, "element", "p:a", "urn:x"), (0, "element", "b", "urn:d"), (0, "text", None, None)]
    assert rows[0].markup == '<b c="é>"/><![CDATA[<z>]]>' and rows[0].text == "<z>" and rows[1].attributes == {"c": "é>"} and "xmlns:p" in rows[0].attributes


def test_graphs_with_the_same_names_stay_apart(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "b", "c"), (3, "a", "a")], "g int, a string, b string")
    seeds = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "g int, node string")
    assert sorted((r.g, r.node) for r in index.reachable(seeds, edges, ["g"]).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a")]


def test_titles_of_articles(spark):
    cases = {
        "Artículo 5": "5", "Artículo 5. Objeto de la ley.": "5", "Art. 5: Ámbito": "5", "Art 172 ter": "172 ter", "ARTÍCULO 1": "1", " Artículo   5 bis. X. Y": "5 bis",
        "Artículo 5.": "articulo 5.", "Artículo 5:x": "articulo 5:x", "Disposición final": "disposicion final", "Artículos 5": "articulos 5", "Arte 5": "arte 5", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", boe.normal_title(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_permanent_addresses(spark):
    good = "https://www.boe.es/eli/es/l/2015/10/01/40/con"
    entry = lambda name, url: f"<dt>{name}</dt>\n<dd class='z'> <a target=x href=\"{url}\">t</a></dd>"
    cases = [
        (entry("Permalink ELI:", good), good), (entry("Rango:", good), None), (entry("Permalink ELI:", good) * 2, None), (entry("Rango:", "x") + entry(" permalink eli: ", good), good), (entry("Permalink ELI:", good + "?x"), None),
        (entry("Permalink ELI:", good.replace("https", "http")), None), (entry("Permalink ELI:", good[:-4]), None), (entry("Permalink ELI:", good.replace("boe.es", "boe.es:80")), None), ("", None), (None, None),
    ]
    got = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "k int, p string").select("k", boe.permalink(F.col("p")).alias("u")).orderBy("k").collect()
    assert [r.u for r in got] == [c[1] for c in cases]


def test_days(spark):
    cases = {"20240229": "2024-02-29", "20230229": None, "2024-02-30": None, "2024-1-1": None, "00000101": None, "2024-12-31": "2024-12-31", None: None, "x": None}
    assert {r.v: r.d for r in spark.createDataFrame([(v,) for v in cases], "v string").select("v", boe.day_of(F.col("v")).alias("d")).collect()} == cases


def _sections(spark, cases):
    """The section of a law by answers that are right but for what each case (change, section, dropped) says."""
    code, work = "BOE-A-2015-10566", "https://www.boe.es/eli/es/l/2015/10/01/40"
    version = lambda day, text: f'<version id_norma="{code}" fecha_vigencia="{day}" fecha_publicacion="{day}"><p class="articulo">Artículo 103</p><p class="parrafo">{text}</p><blockquote><p class="articulo">Nota</p></blockquote></version>'
    block = lambda i, kind, title, inner: f'<response><status><code>200</code></status><data><bloque id="{i}" tipo="{kind}" titulo="{title}">{inner}</bloque></data></response>'
    answers = {
        ("metadata", None): f'{{"data": [{{"identificador": "{code}", "titulo": "Ley 40/2015", "url_html_consolidada": "https://www.boe.es/buscar/act.php?id={code}", "url_eli": "{work}"}}]}}',
        ("record", None): f'<dl><dt>Permalink ELI:</dt><dd><a href="{work}/con">x</a></dd></dl>',
        ("eli", None): f'<response><data><metadata-eli><rdf:RDF><eli:LegalResource rdf:about="{work}"><eli:has_member><eli:LegalResource rdf:about="{work}/con/20240802"><eli:id_local rdf:datatype="s">{code}</eli:id_local><eli:version_date>2024-08-02</eli:version_date><eli:is_member_of rdf:resource="{work}"/><eli:is_realized_by><eli:LegalExpression rdf:about="{work}/con/20240802/spa"><eli:language rdf:resource="http://www.elidata.es/mdr/authority/language/spa"/><eli:realizes rdf:resource="{work}/con/20240802"/></eli:LegalExpression></eli:is_realized_by></eli:LegalResource></eli:has_member></eli:LegalResource></rdf:RDF></metadata-eli></data></response>',
        ("index", None): '{"data": {"bloque": [{"id": "a1", "titulo": "Artículo 1"}, {"id": "a103", "titulo": "Artículo 103. Fines"}, {"id": "no", "titulo": " "}]}}',
        ("block", "a103"): block("a103", "precepto", "Artículo 103", version("20200101", "old") + version("20240101", "El &amp;amp; texto<br/>dos") + version("20250101", "future")),
        ("block", "no"): block("no", "nota_inicial", "", version("20240101", "x")),
    }
    rows, requests = [], []
    for i, (change, section, dropped) in enumerate(cases):
        own = dict(answers)
        if change:
            key, old, new = change
            assert old in own[key]
            own[key] = own[key].replace(old, new)
        requests.append((i, code.lower(), section))
        rows += [(i, what, number, 200, body) for (what, number), body in own.items() if (what, number) != dropped]
    got = boe.boe_sections(spark.createDataFrame(requests, "ref_id int, code string, section string"), spark.createDataFrame(rows, "ref_id int, what string, number string, status int, body string"), F.lit("2026-01-01"))
    return {r.ref_id: r for r in got.collect()}


WRONG = [
    (("metadata", None), 'BOE-A-2015-10566", "titulo', 'BOE-A-1-1", "titulo', "not-found"), (("metadata", None), '"titulo": "Ley 40/2015"', '"titulo": 7', "contract"), (("metadata", None), "}]", "}, {}]", "contract"),
    (("eli", None), "<eli:realizes", "<eli:other", "contract"), (("eli", None), "2024-08-02<", "2024-08-03<", "contract"), (("eli", None), "<metadata-eli>", "<x/><metadata-eli>", "ok"), (("index", None), '"id": "no"', '"id": "a1"', "contract"),
    (("index", None), 'Artículo 1"', 'Art. 103"', "contract"), (("index", None), '"titulo": " "', '"titulo": 1', "contract"), (("block", "no"), "nota_inicial", "precepto", "contract"), (("block", "no"), 'fecha_publicacion="20240101"', "", "contract"),
    (("block", "a103"), 'id="a103"', 'id="a104"', "contract"), (("block", "a103"), "20200101", "20240101", "contract"), (("block", "a103"), '<p class="parrafo">old</p>', "<version/>", "contract"), (("block", "a103"), "</bloque>", "<p/></bloque>", "contract"),
]


def test_a_section_of_five_answers(spark):
    missing = [("7", None, "not-found"), ("103", ("index", None), "unavailable"), ("103", ("block", "no"), "unavailable")]
    got = _sections(spark, [(None, "103", None), *[(w[:3], "103", None) for w in WRONG], *[(None, section, drop) for section, drop, _ in missing]])
    r = got[0]
    assert (r.status, r.title, r.heading, r.text, r.valid_from) == ("ok", "Ley 40/2015", "Artículo 103", "El &amp; texto\ndos", "2024-01-01")
    assert [got[i].status for i in range(1, len(got))] == [*[w[3] for w in WRONG], *[m[2] for m in missing]]
    assert all((r.text is None) == (r.status != "ok") for r in got.values())


def test_notices_and_records_without_rows(spark):
    assert cellar.notice_uuids(spark.createDataFrame([(1, "32016R0679", None), (2, None, "<NOTICE type='identifier'/>")], "ref_id int, celex string, notice string")).where("uuid is not null").count() == 0
    assert cellar.rdf_works(spark.createDataFrame([(1, "32016R0679", None), (2, "32016R0679", "<x/>")], "ref_id int, celex string, rdf string")).count() == 0


def test_nodes_of_a_row_are_those_of_the_table(spark):
    rng = random.Random(5)
    docs = [*[_random_tree(rng) for _ in range(40)], "<a>", "<!DOCTYPE a><a/>", '<p:a xmlns:p="urn:x" z="1"><b q="2" c="é>"/><?x y?></p:a>', None]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, x string")
    got = {r.k: r.nodes for r in nodes.whole(df, "x", ("q",), ("/a",), namespaces=True).collect()}
    table = {}
    for r in nodes.shred(df, ["k"], "x", ("a",), only_elements=True).where("kind = 'element'").orderBy("k", "pre").collect():
        table.setdefault(r.k, []).append(r)
    for k in range(len(docs)):
        own = table.get(k, [])
        assert [(n.name, n.path, n.namespace, n.text, n.depth, n["@q"], n.more) for n in got[k]] == [(r.name, r.path, r.namespace, r.text, r.depth, r.attributes.get("q"), len(r.attributes) - ("q" in r.attributes)) for r in own]
        assert [(n.at, n.size) for n in got[k]] == [(i, sum(d.pre > r.pre and d.post < r.post for d in own)) for i, r in enumerate(own, 1)]
        assert [n.markup for n in got[k]] == [r.markup if r.path == "/a" else None for r in own]
    leaves = nodes.whole(spark.createDataFrame([("<!--c--><a>t<?p?><b/></a>",)], "x string"), "x", levels=1, leaves=True).first().nodes
    assert [(n.name, n.path, n.depth, n.size) for n in leaves] == [(None, "", 0, 0), ("a", "/a", 0, 2), (None, None, 1, 0), ("b", None, 1, 0)]


def test_descriptions_are_read_without_joins_of_nodes(spark, tmp_path):
    laws = spark.createDataFrame([(1, "BOE-A-2015-1", "w")], "ref_id int, code string, work string")
    got = boe.version_days(laws, spark.createDataFrame([(1, "<a/>")], "ref_id int, body string"), F.lit("2026-01-01"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan and [tuple(r) for r in got.collect()] == [(1, None, False)]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dutch_answers_are_read_without_joins_of_nodes(spark):
    answers = spark.createDataFrame([(1, "2024-01-01", None, "<r/>"), (2, "2024-01-01", None, "<searchRetrieveResponse><numberOfRecords>0</numberOfRecords></searchRetrieveResponse>")], "ref_id int, day string, wanted string, xml string")
    got = bwb.states(answers)[0]
    assert "Join " not in _optimized(got) and sorted(tuple(r) for r in got.collect()) == [(1, 0, "malformed"), (2, 0, "no-results")]
    got = bwb.articles(spark.createDataFrame([(1, "n", "v", "Artikel 1", '<toestand bwb-id="n" bwb-ng-vast-deel="v"><wetgeving xml:lang="nl"><artikel label="Artikel 1"><al>a <b>c</b> d</al><al/><al>e</al></artikel></wetgeving></toestand>')], "ref_id int, number string, version string, label string, xml string"))
    assert "Join " not in _optimized(got) and [tuple(r) for r in got.collect()] == [(1, True, 1, "a d c\ne")]


def test_notices_are_read_without_joins_of_nodes(spark):
    own = lambda kind, name: f"<URI><VALUE>http://publications.europa.eu/resource/{kind}/{name}</VALUE><IDENTIFIER>{name}</IDENTIFIER><TYPE>{kind}</TYPE></URI>"
    uuid, celex = "0a1b2c3d-0000-1111-2222-333344445555", "32016R0679"
    notice = f'<NOTICE type="identifier">{own("cellar", uuid)} <SAMEAS>{own("celex", celex)}</SAMEAS></NOTICE>'
    wrong = [notice.replace("</SAMEAS>", "<!--c--></SAMEAS>"), notice.replace("<SAMEAS>", "<SAMEAS>x"), notice.replace("<SAMEAS>", '<SAMEAS a="1">'), notice.replace("<SAMEAS>", "<SAMEAS/><SAMEAS>"), notice.replace("<TYPE>celex</TYPE>", "<TYPE/>")]
    got = cellar.notice_uuids(spark.createDataFrame([(i, celex, n) for i, n in enumerate([notice, *wrong])], "ref_id int, celex string, notice string"))
    assert "Join " not in _optimized(got) and [r.uuid for r in got.orderBy("ref_id").collect()] == [uuid, *[None] * len(wrong)]


def test_records_are_read_without_joins_of_nodes(spark):
    about = lambda node, inner: f'<rdf:Description rdf:about="{node}">{inner}</rdf:Description>'
    to = lambda name, node: f'<{name} rdf:resource="{node}"/>'
    chain = "".join(about(f"n{i}", to("owl:sameAs", f"n{i + 1}")) for i in reversed(range(9)))  # it is met from its far end
    record = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:cdm="http://publications.europa.eu/ontology/cdm#" xmlns:dc="http://purl.org/dc/elements/1.1/">' + about(
        "http://x/celex/32016R0679", to("owl:sameAs", "n0")
    ) + chain + about("n9", "<cdm:work_id_document> celex:32016R0679 </cdm:work_id_document>") + about("e", to("cdm:expression_belongs_to_work", "n4") + to("cdm:expression_uses_language", "d") + '<cdm:title xml:lang="DEU">A</cdm:title><cdm:title xml:lang="deu">B</cdm:title>') + about("d", "<dc:identifier>DEU</dc:identifier>") + "</rdf:RDF>"
    docs = [record, record.replace('rdf:resource="n5"', 'rdf:resource="m"'), record.replace('rdf:resource="d"', 'rdf:resource="q"'), record.replace("cdm:title", "cdm:name"), record.replace("/celex/", "/x/"), "<a"]
    got = cellar.rdf_works(spark.createDataFrame([(i, "32016R0679", d) for i, d in enumerate(docs)], "ref_id int, celex string, rdf string"))
    assert "Join " not in _optimized(got)
    assert sorted((r.ref_id, r.titles, r.languages) for r in got.collect()) == [(0, {"deu": "B"}, ["deu"]), (2, {"deu": "B"}, []), (3, {}, ["deu"])]


_PICK = (
    nodes.Counts(("/a", "/a/b")), nodes.First("/a", ("@x", "text", "children", nodes.Inside("c"))),
    nodes.Found("/a", "b", ("@x", "text", nodes.One("c", ("@x", "text")))), nodes.Found("/a/b", None, ("text", "markup", nodes.Each("c", ("@x", "markup")))),
)


def _added(picker, doc):
    before = [len(c) for c in picker.columns]
    picker.add(doc)
    return [c[k:] for c, k in zip(picker.columns, before, strict=True)]


def test_documents_of_a_form_are_read_once():
    picker, reads = nodes._Picker(_PICK, frozenset(("/a/b", "/a/b/c"))), []
    read = picker.whole.read
    picker.whole.read = lambda xml: reads.append(read(xml))
    for i in range(200):
        got = _added(picker, f'<a x="{i}"><b x="{i}%">p{i}q &amp;lt; {i}é<c x="">"{i}"</c></b><b/></a>')
        assert got[0] == [[1, 2]] and got[1] == [str(i)] and got[6] == [f"{i}%", None] and got[7] == [f"p{i}q &lt; {i}é", None], i
        assert f'p{i}q &amp;lt; {i}é<c x="">"{i}"</c>' in got[13], i
    assert len(reads) <= 4  # a new form, one that comes again, and its marks


def test_a_form_reads_what_the_parser_reads():
    rng, plain = random.Random(11), nodes._Picker(_PICK, frozenset(("/a/b", "/a/b/c")))
    bits = ['"', "'", "<", ">", "&", ";", "=", '="', "&amp;", "&lt;", "&#65;", " ", "\n", "\t", "\r", "]]", "%", "%s", "\x01", "\x00", "\ufffe", "\ue0001\ue001", "é", "7", " x=", "/>", "<c/>", "<!--", "-->", "<?p?>", ""]
    bases = [
        '<a x="1"><b x="2">t<c x="3">u</c></b></a>', "<a x = \"x=\" y=\"z\"><b>t</b></a>", "<a x='q=\"1\"'><b>t=\"v\"</b></a>", '<a x="a&amp;b" y="c&lt;d"><b>a&amp;b;c&gt;d</b></a>',
        '<a x=">t&amp;"><b y=">u">v</b></a>', "<a><b>s&ampt</b></a>", "<a><b>]]&gt;x</b>y</a>", "<a><b>1</b></a>t<a/>", "<a><B>1</B><b><C>x</C><c/></b></a>",
    ]
    for base in bases:
        picker = nodes._Picker(_PICK, frozenset(("/a/b", "/a/b/c")))
        for _ in range(400):
            at = rng.randrange(len(base) + 1)
            doc = base[:at] + rng.choice(bits) + base[at + rng.randint(0, 1) :]
            for d in (doc, base):
                assert _added(picker, d) == plain._read(d), d
    assert _added(plain, None) == _added(plain, "<a>") == _added(plain, "<!DOCTYPE a><a/>")
