"""Answers of the sources' search services to uniform entries, each with its source's own strictness.

Each function is a column of structs: status (`results`, `no-results`, `malformed`), reason, and entries of
canonical_input, title, source_url, in the answer's order, without repeated ones, eight at most.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from datetime import date
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .payloads import Contract, _finlex_identity, _local, _named, tree_text

#: Entries of an answer at most; forms of identities; keys under which lists and fields may be.
MOST = 8
BOE_ID, BWB_ID = r"BOE-A-[0-9]{4}-[0-9]{1,5}", r"BWBR[0-9]{7}"
LISTS_IN_DATA, LISTS = ("lista", "risultati", "results", "atti"), ("listaAtti", "lista", "risultati", "results", "atti")
RESULT = "status string, reason string, entries array<struct<canonical_input:string,title:string,source_url:string>>"

Entry = tuple[str, str, str | None]


def _column(take: Callable[..., list[Entry]], *args: Column) -> Column:
    def one(*values) -> tuple:
        values = [None if v is None or v != v else v for v in values]
        try:
            found = take(*values)
        except (Contract, ET.ParseError, ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
            return "malformed", str(e)[:200], None
        entries = [dict(zip(("canonical_input", "title", "source_url"), x, strict=True)) for x in found[:MOST]]
        return ("results" if entries else "no-results"), None, entries

    @F.pandas_udf(RESULT)
    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(*r) for r in rows.itertuples(index=False, name=None)], columns=["status", "reason", "entries"])

    return batch(F.struct(*[a.alias(f"c{i}") for i, a in enumerate(args)]))


def canonical_record_url(url: object, number: str) -> bool:
    """Whether it is the one official address of a record: host, path and a single parameter, nothing else."""
    if not isinstance(url, str):
        return False
    try:
        u = urlsplit(url)
        return (u.scheme, u.netloc, u.path, u.fragment) == ("https", "www.boe.es", "/buscar/act.php", "") and parse_qsl(u.query, keep_blank_values=True) == [("id", number)]
    except ValueError:
        return False


def _boe(payload: str) -> list[Entry]:
    root = json.loads(payload)
    if root["status"].get("code") not in ("200", 200):
        raise Contract("status")
    data = root.get("data")
    if data in ("", {}):
        return []
    if not isinstance(data, list):
        raise Contract("data")
    out: dict[str, Entry] = {}
    for x in data:
        number = x["identificador"].strip().upper()
        if not re.fullmatch(BOE_ID, number):
            raise Contract("identifier")
        if not isinstance(x.get("titulo"), str) or not x["titulo"].strip():
            raise Contract("title")
        if not canonical_record_url(x.get("url_html_consolidada"), number):
            raise Contract("address")
        out.setdefault(number, (number, x["titulo"].strip(), x["url_html_consolidada"]))
    return list(out.values())


def _text(*values: object) -> str | None:
    """The first that is a text and not blank."""
    return next((v for v in values if isinstance(v, str) and v.strip()), None)


def _number(*values: object) -> int | None:
    """The first that is a positive whole number, or its digits."""
    for v in values:
        n = v if isinstance(v, int) and not isinstance(v, bool) else int(v) if isinstance(v, str) and re.fullmatch("[0-9]+", v) else int(v) if isinstance(v, float) and v.is_integer() else 0
        if 0 < n < 1 << 53:
            return n
    return None


def _day(*values: object) -> str | None:
    for v in values:
        if isinstance(v, str):
            return v[:10]
    return None


def _is_day(value: str | None) -> bool:
    try:
        return bool(value and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value) and date.fromisoformat(value))
    except ValueError:
        return False


def normattiva_candidate(source: object) -> Entry | None:
    """An act from whatever of several fields a candidate has; none if anything that identifies it is missing."""
    if not isinstance(source, dict):
        return None
    act = source["atto"] if isinstance(source.get("atto"), dict) else source
    day, code = _text(source.get("dataGU"), act.get("dataGU")), _text(source.get("codiceRedazionale"), act.get("codiceRedazionale"))
    title = _text(source.get("titoloAtto"), source.get("titolo"), source.get("title"), act.get("titolo"), act.get("titoloAtto"))
    formal = _text(source.get("descrizioneAtto"))
    kind = _text(source.get("denominazioneAtto"), source.get("tipoProvvedimentoDescrizione"), act.get("tipoProvvedimentoDescrizione"), act.get("denominazioneAtto"))
    made = _day(source.get("dataEmanazione"), source.get("dataAtto"), source.get("dataProvvedimento"), act.get("dataAtto"), act.get("dataProvvedimento"))
    for x in (source, act):
        parts = [x.get(k) for k in ("annoProvvedimento", "meseProvvedimento", "giornoProvvedimento")]
        if made is None and all(isinstance(p, int) and not isinstance(p, bool) for p in parts):
            made = "{:04d}-{:02d}-{:02d}".format(*parts)
    number = _number(source.get("numeroProvvedimento"), act.get("numeroProvvedimento"))
    if not (_is_day(day) and code and re.fullmatch("[0-9A-Z]+", code.upper()) and title and formal and kind and _is_day(made) and number):
        return None
    return f"normattiva:{day}:{code.upper()}", title.strip(), None


def _normattiva(payload: str) -> list[Entry]:
    root = json.loads(payload)
    data = root.get("data")
    if isinstance(data, list):
        found = data
    else:
        at, keys = (data, LISTS_IN_DATA) if isinstance(data, dict) else (root, LISTS)
        found = next((at[k] for k in keys if isinstance(at.get(k), list)), None)
    if found is None:
        raise Contract("list")
    return [x for c in found if (x := normattiva_candidate(c))]


def _finlex_document(xml: str, code: str) -> list[Entry]:
    number, year = code.split("/")
    title = _finlex_identity(ET.fromstring(xml), number, year, "fin")
    return [(code, title, f"/akn/fi/act/statute-consolidated/{year}/{number}/fin@latest")]


def boe_search(payload: Column) -> Column:
    return _column(_boe, payload)


def normattiva_search(payload: Column) -> Column:
    """Candidates that lack something are passed over; an answer without a list is malformed."""
    return _column(_normattiva, payload)


def finlex_documents(xml: Column, code: Column) -> Column:
    return _column(_finlex_document, xml, code)


def boe_query(text: Column) -> Column:
    """The query for a title: law numbers by their field, other figures by prefix, words as they are, all of them."""
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    escaped = lambda t: F.regexp_replace(t, r"""([+\-=&|><!(){}\[\]^"~*?:\\/])""", r"\\$1")
    one = lambda t: F.when(t.rlike(r"\A[0-9]{1,4}/[0-9]{4}\z"), F.concat(F.lit("numero_oficial:"), escaped(t))).when(t.rlike(r"\A[0-9]+\z"), F.concat(F.lit("titulo:"), escaped(t), F.lit("*"))).otherwise(F.concat(F.lit("titulo:"), escaped(t)))
    return F.array_join(F.transform(tokens, one), " AND ")


def first_of_each(rows: DataFrame, group: str, key: str, ordinal: str, most: int = MOST) -> DataFrame:
    """rows with position: of each group the first row of each key, in order, so many at most."""
    rest = [c for c in rows.columns if c not in (group, key)]
    first = rows.groupBy(group, key).agg(F.min_by(F.struct(*rest), ordinal).alias("_x")).select(group, key, *[F.col(f"_x.{c}").alias(c) for c in rest])
    w = Window.partitionBy(group).orderBy(ordinal)
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def conflicting(rows: DataFrame, group: str, key: str, payload: list[str]) -> DataFrame:
    """group, key: keys whose rows differ in their payload."""
    return rows.groupBy(group, key).agg(F.min(F.struct(*payload)).alias("_a"), F.max(F.struct(*payload)).alias("_b")).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(group, key)
