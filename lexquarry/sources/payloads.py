"""Captured payloads to sections: XML and JSON documents whose identity is checked before anything is taken out.

Each function is a column of structs: status (`ok`, `not-found`, `contract`), reason, title, text. A payload that
can't be read, or is of another document, is `contract`; a section that isn't there, or is there twice, is
`not-found`. One bad payload never fails a batch. Trees need Python: rows reach it in Arrow batches.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.citations import parse_celex

RESULT = "status string, reason string, title string, text string"
OPEN_END = "99999999"


class Contract(Exception):
    """The payload isn't what it has to be."""


class Missing(Exception):
    """The payload is right, but has no such section."""


def _column(take: Callable[..., tuple[str | None, str]], *args: Column) -> Column:
    def one(*values) -> dict:
        values = [None if v is None or v != v else v for v in values]
        try:
            if values[0] is None:
                raise Missing("no payload")
            title, text = take(*values)
            return {"status": "ok", "reason": None, "title": title, "text": text}
        except Missing as e:
            return {"status": "not-found", "reason": str(e), "title": None, "text": None}
        except (Contract, ET.ParseError, ValueError, KeyError, TypeError, RecursionError) as e:
            return {"status": "contract", "reason": str(e)[:200], "title": None, "text": None}

    # the number of columns differs: they go as one struct
    @F.pandas_udf(RESULT)
    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(*r) for r in rows.itertuples(index=False, name=None)], columns=["status", "reason", "title", "text"])

    return batch(F.struct(*[a.alias(f"c{i}") for i, a in enumerate(args)]))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if x is not node and _local(x.tag) == name]


def _only(found: list, what: str):
    if len(found) != 1:
        raise Contract(f"{what}: {len(found)} of them")
    return found[0]


def _attribute(node: ET.Element, name: str) -> str:
    value = {_local(k): v for k, v in node.attrib.items()}.get(name)
    if not value:
        raise Contract(f"{name} is missing")
    return value


def tree_text(node: ET.Element) -> str:
    """A node's own text, all of it, before that of its children: the order of mixed content is not kept."""
    own = "".join([node.text or "", *[c.tail or "" for c in node]])
    return " ".join(" ".join([own, *[tree_text(c) for c in node]]).split())


def _finlex_identity(root: ET.Element, number: str, year: str, language: str) -> str:
    """The title of a document that is in all respects the one that was asked for."""
    work, expression = _only(_named(root, "FRBRWork"), "work"), _only(_named(root, "FRBRExpression"), "expression")
    value = lambda node, name, key="value": _attribute(_only(_named(node, name), name), key)
    base = f"/akn/fi/act/statute-consolidated/{year}/{number}"
    facts = {
        "work": value(work, "FRBRuri") == base, "expression": re.fullmatch(re.escape(base) + rf"/{re.escape(language)}@[0-9A-Za-z]*", value(expression, "FRBRuri")) is not None, "country": value(work, "FRBRcountry").lower() == "fi",
        "subtype": value(work, "FRBRsubtype") == "statute-consolidated", "number": value(work, "FRBRnumber") == number, "language": language in ("fin", "swe") and value(expression, "FRBRlanguage", "language").lower() == language, "authority": value(work, "FRBRauthoritative") == "false",
    }
    if wrong := [k for k, ok in facts.items() if not ok]:
        raise Contract("not the same " + ", ".join(wrong))
    title = tree_text(_only(_named(root, "docTitle"), "title"))
    if not title:
        raise Contract("title is missing")
    return title


def _finlex(xml: str, code: str, section: str, language: str | None) -> tuple[str, str]:
    asked = re.fullmatch(r"([1-9][0-9]{0,5})/((?!0000)[0-9]{4})", code or "")
    if not asked:
        raise Missing("no such code")
    root = ET.fromstring(xml)
    title = _finlex_identity(root, asked[1], asked[2], language or "fin")
    number = lambda s: [tree_text(c) for c in s if _local(c.tag) == "num"]
    found = [s for s in _named(root, "section") if number(s) == [f"{section} §"]]
    if len(found) != 1:
        raise Missing(f"{len(found)} sections")
    return title, " ".join(t for c in found[0] if _local(c.tag) != "num" and (t := tree_text(c)))


def _bwb(xml: str, code: str, state: str, section: str) -> tuple[None, str]:
    root = ET.fromstring(xml)
    if _local(root.tag) != "toestand" or root.get("bwb-id") != code or root.get("bwb-ng-vast-deel") != state:
        raise Contract("another document")
    languages = [v for n in _named(root, "wetgeving") for k, v in n.attrib.items() if _local(k) == "lang"]
    if languages != ["nl"]:
        raise Contract("language")
    label = "Artikel " + re.sub(r"[A-Z]\Z", lambda m: m[0].lower(), section)
    found = [a for a in _named(root, "artikel") if a.get("label") == label]
    if len(found) != 1:
        raise Missing(f"{len(found)} articles")
    text = "\n".join(tree_text(a) for a in _named(found[0], "al")).strip()
    if not text:
        raise Contract("no text")
    return None, text


def _compact(value: object) -> str:
    if not isinstance(value, str) or not re.fullmatch(r"[0-9]{8}", value):
        raise Contract("validity")
    return date(int(value[:4]), int(value[4:6]), int(value[6:])).isoformat()


def _normattiva(payload: str, day: str, code: str, title: str, article: int, as_of: str) -> tuple[str, str]:
    data = json.loads(payload)["data"]
    act = data["atto"]
    if data.get("lista"):
        raise Contract("ambiguous")
    if ("dataGU" in act) != ("codiceRedazionale" in act) or ("dataGU" in act and (act["dataGU"], act["codiceRedazionale"]) != (day, code)) or act.get("titolo") != title:
        raise Contract("another act")
    if date(act["annoGU"], act["meseGU"], act["giornoGU"]).isoformat() != day:
        raise Contract("another date")
    begin, end = _compact(act.get("articoloDataInizioVigenza")), act.get("articoloDataFineVigenza")
    if begin > as_of or (end != OPEN_END and as_of > _compact(end)):
        raise Contract("not in force")
    body = act.get("articoloHtml") or ""
    marks = re.findall(r"(?is)<([a-z][\w:-]*)\b([^>]*\bclass=[\"'][^\"']*\barticle-num-akn\b[^>]*)>(.*?)</\1>", body)
    if len(marks) != 1 or not re.search(rf"\bid=[\"']art_{article}[\"']", marks[0][1]) or not re.fullmatch(rf"Art\.?\s*{article}", re.sub(r"<[^>]*>", "", marks[0][2]).strip()):
        raise Contract("article marker")
    return title, body


def _neuris(payload: str, name: str) -> tuple[str | None, str]:
    """The first part of that name, depth first; its own text or address."""
    open_ = [json.loads(payload)]
    while open_:
        node = open_.pop()
        if node.get("name") == name:
            return node.get("headline"), node.get("text") or node.get("@id") or ""
        open_.extend(reversed(node.get("hasPart") or []))
    raise Missing("no such part")


def _by_id(page: str, wanted: str) -> tuple[None, str]:
    """The inner markup of the element with that id, by the balance of its tags; none if it never ends or is there twice."""
    starts = [m for m in re.finditer(r"<([a-zA-Z][\w:-]*)\b[^>]*?\bid\s*=\s*[\"']([^\"']*)[\"'][^>]*>", page) if m[2] == wanted]
    if len(starts) != 1:
        raise Missing(f"{len(starts)} elements")
    depth, begin = 1, starts[0].end()
    for m in re.finditer(rf"<(/?){re.escape(starts[0][1])}\b[^>]*?(/?)>", page[begin:], re.I):
        depth += -1 if m[1] else 0 if m[2] else 1
        if depth == 0:
            return None, page[begin : begin + m.start()]
    raise Contract("the element has no end")


def finlex_section(xml: Column, code: Column, section: Column, language: Column) -> Column:
    return _column(_finlex, xml, code, section, language)


def bwb_article(xml: Column, code: Column, state: Column, section: Column) -> Column:
    return _column(_bwb, xml, code, state, section)


def normattiva_article(payload: Column, day: Column, code: Column, title: Column, article: Column, as_of: Column) -> Column:
    """text is the article's markup: the text rules of the source apply to it."""
    return _column(_normattiva, payload, day, code, title, article, as_of)


def neuris_part(payload: Column, name: Column) -> Column:
    return _column(_neuris, payload, name)


def eurlex_element(page: Column, section: Column) -> Column:
    """text is the markup of the article's element."""
    return _column(_by_id, page, F.concat(F.lit("art_"), section))


def fedlex_article(payload: Column, language: Column) -> Column:
    """id, title, content of the first inner hit of the first hit, in de, fr or it; null if there is none."""
    source = "struct<id:string,title:string,content:string>"
    hit = f"struct<hits:struct<hits:array<struct<_source:{source}>>>>"
    schema = f"struct<hits:struct<hits:array<struct<inner_hits:struct<deContent:{hit},frContent:{hit},itContent:{hit}>>>>>"
    inner = F.try_element_at(F.from_json(payload, schema)["hits"]["hits"], F.lit(1))["inner_hits"]
    first = lambda name: F.try_element_at(inner[name]["hits"]["hits"], F.lit(1))["_source"]
    found = F.when(F.coalesce(language, F.lit("de")) == "de", first("deContent")).when(language == "fr", first("frContent")).when(language == "it", first("itContent"))
    return F.when(found["id"].isNotNull() & (found["id"] != ""), found)


def fedlex_article_id(section: Column) -> Column:
    """`321A` is `art_321_a`."""
    pattern = r"\A([0-9]+)([a-zA-Z])\z"
    return F.when(section.rlike(pattern), F.concat(F.lit("art_"), F.regexp_extract(section, pattern, 1), F.lit("_"), F.lower(F.regexp_extract(section, pattern, 2)))).otherwise(F.concat(F.lit("art_"), section))


def language_expression(notice_status: Column, page_status: Column, celex: Column) -> Column:
    """What two steps of a lookup amount to: no notice is `not-found`, a notice without the page `language-unavailable`."""
    fine = lambda s: s.between(200, 299)
    return F.when(parse_celex(celex).isNull() | (notice_status == 404), "not-found").when(~fine(notice_status), "unavailable").when(page_status == 404, "language-unavailable").when(~fine(page_status), "unavailable").otherwise("ok")
