"""The queries of this subpackage: operators applied to whole tables, their results in a fixed form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html, jaccard, language, licenses, merkle, mixing, quality, ranking, secrets, suffixes, toxicity
from .common import remainder, table, written


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = quality.train_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(mixing.measured(table(spark, sf_dir, "documents")).drop("text"), "counted")  # texts are read once
    out = mixing.mixing_weights(counted, counted=True)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "margin_error", mixing.sampled(F.col("doc_id"), F.col("probability")).alias("sampled"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "main_path")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.train_languages(docs.where(~held_out))
    out = language.identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_benchmark_decontamination, op3_quality_classifier, op4_suffix_dedup, op5_toxicity, op6_source_mixing, op7_html_extraction, op8_language_id, op9_jaccard_join, op10_fingerprints, op11_merkle_manifest, op12_ranked_search, op13_secret_scan)}

#: The letters that are folded, and what separates words.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql() -> str:
    """Trees of at most 16**6 leaves: each level is a query of its own, and so is each step of a proof."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in (*fields[:-1], text)) + ")"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"  # a byte, and eight shifts
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    sql = [f"l AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(_LOWER.format('text'))} ELSE {leaf('text')} END AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS p FROM documents)"]
    sql.append("a0 AS (SELECT source, p, leaf AS h, count(*) OVER (PARTITION BY source) AS m FROM l)")

    def tree(a: str, g: str, levels: int) -> None:
        for k in range(1, levels + 1):
            sql.append(f"{a}r{k} AS MATERIALIZED (SELECT {g}, p // 16 AS p, any_value(m) AS m, string_agg(h, '' ORDER BY p) AS run FROM {a}{k - 1} GROUP BY {g}, p // 16)")
            sql.append(f"{a}{k} AS (SELECT {g}, p, CASE WHEN m > 1 THEN sha256(run) ELSE run END AS h, (m + 15) // 16 AS m FROM {a}r{k})")

    def steps(rows: str, a: str, g: str, levels: int, place: str) -> str:
        for k in range(1, levels + 1):
            at, low = f"64 * ({rows}.{place} // {16 ** (k - 1)} % 16)", f"{rows}.{g} IS NOT DISTINCT FROM r.{g} AND r.p = {rows}.{place} // {16**k}"
            sql.append(f"{a}s{k} AS MATERIALIZED (SELECT {rows}.* REPLACE (CASE WHEN m > 1 THEN sha256(left(run, {at}) || f || substr(run, {at} + 65)) ELSE f END AS f, CASE WHEN m > 1 THEN proof || left(run, {at}) || substr(run, {at} + 65) ELSE proof END AS proof) FROM {rows} JOIN {a}r{k} r ON {low})")
            rows = f"{a}s{k}"
        return rows

    tree("a", "source", 6)
    sql.append("b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, h, count(*) OVER () AS m FROM a6)")
    tree("b", "g", 6)
    sql.append("s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sp, 0 AS g FROM a6)")
    sql.append("x AS (SELECT l.*, '' AS proof, subroot, sp, g, b6.h AS root FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN b6 USING (g))")
    last = steps(steps("x", "a", "source", 6, "p"), "b", "g", 6, "sp")
    return f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
        f AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY k, t),
        v AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM f, s GROUP BY t, n),
        m AS (SELECT k, doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * n) // l AS m FROM d, s WHERE len(w) > 0),
        r AS (SELECT item_id, k, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id FROM b JOIN f USING (t) JOIN v USING (t) JOIN m USING (k) GROUP BY item_id, k)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50""",
    "op2_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
        lengths AS (SELECT DISTINCT n FROM sized),
        doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
        f AS (SELECT g, min(doc_id) AS m FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT doc_id, i FROM s JOIN f USING (g) WHERE m < doc_id),
        b AS (SELECT d.doc_id, p, substr(h, 2 * p + 1, 2) AS x, hit.i IS NOT NULL AS starts FROM (SELECT *, unnest(range(0, length(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM hit)) d LEFT JOIN hit ON hit.doc_id = d.doc_id AND hit.i = p),
        c AS (SELECT *, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
        r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM w),
        c AS (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
        t AS (SELECT class_id, n, unnest(s) AS t FROM c),
        m AS (SELECT t FROM t GROUP BY t HAVING count(*) > 1),
        v AS (SELECT class_id, n, t FROM t JOIN m USING (t) QUALIFY 100 * count(*) OVER (PARTITION BY class_id) >= 85 * n),
        e AS (SELECT a.class_id AS a, b.class_id AS b FROM v a JOIN v b ON a.t = b.t AND a.class_id <> b.class_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
              GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        k AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a), g AS (SELECT a AS class_id, count(*) AS n_links FROM e GROUP BY a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component_id, class_id, s.doc_id) AS component_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
        FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k USING (class_id) LEFT JOIN g USING (class_id)""",
}
