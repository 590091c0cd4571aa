"""Payload text: HTML of several sources to plain text, each with its source's own rules, as Spark expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .citations import SPACE
from .references import decoded
from .text import let


@dataclass(frozen=True)
class TextRules:
    """What goes with its content, what ends a line, what other tags become, what is decoded and when, how lines are made."""

    silent: tuple[str, ...]
    line_ends: tuple[str, ...]
    line_break: bool
    tag: str
    names: dict[str, str]
    any_case: bool = False
    decode_first: bool = False
    comments: bool = False
    by_line: bool = True
    body: bool = False
    #: Tags that become something else than a line's end or what other tags become, as (tag, replacement).
    special: tuple[tuple[str, str], ...] = ()


#: Named references by source.
_GERMAN = {"amp": "&", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "szlig": "ß", "auml": "ä", "Auml": "Ä", "ouml": "ö", "Ouml": "Ö", "uuml": "ü", "Uuml": "Ü"}
_SWISS = _GERMAN | {"apos": "'", "sect": "§"}
_PLAIN = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ITALIAN = _PLAIN | {"nbsp": " ", "agrave": "à", "egrave": "è", "igrave": "ì", "ograve": "ò", "ugrave": "ù", "eacute": "é", "ocirc": "ô"}

RULES = {
    "neuris": TextRules((), ("h[1-6]", "p", "div", "section", "li", "dt", "dd", "ol", "ul"), True, " ", _GERMAN, by_line=False, body=True),
    "gii": TextRules(("script", "style"), ("h[1-6]", "p", "div", "li", "dt", "dd", "dl"), True, " ", _GERMAN, comments=True, by_line=False),
    "eurlex": TextRules(("script", "style", "nav"), ("p", "div", "li", "br", "tr", "h[0-9]"), False, " ", _PLAIN, any_case=True, comments=True),
    "fedlex": TextRules(
        ("script", "style", "noscript"), ("h[1-6]", "p", "div", "section", "article", "li", "dd", "ol", "ul", "tr"), True, "", _SWISS, decode_first=True, comments=True, by_line=False,
        special=(("<dt>", "\n"), ("<dd>", " "), ("</td>", " "), ("</th>", " ")),
    ),
    "boe": TextRules(("blockquote",), ("p", "tr", "td", "th", "div", "li"), True, "", {}),
    "normattiva": TextRules(("script", "style"), ("div", "p", "h[1-6]", "li", "tr", "section", "article"), True, "", _ITALIAN, any_case=True),
}
_BODY = r"(?is)<body\b[^>]*>(.*?)</body>"


def html_text(page: Column, source: str) -> Column:
    """The text of a page by the rules of a source. References that its table lacks stay as they are; null is null."""
    rules = RULES[source]
    out = page
    if rules.comments:
        out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for tag in rules.silent:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    if source == "gii":
        out = norm_content(out)
    if rules.body:
        out = body_of(out)
    for tag, replacement in rules.special:
        out = F.regexp_replace(out, f"(?i){tag}", replacement)
    if rules.line_break:
        out = F.regexp_replace(out, r"(?i)<br\s*/?\s*>", "\n")
    out = F.regexp_replace(out, rf"(?i)</(?:{'|'.join(rules.line_ends)})\s*>", "\n")
    if rules.decode_first:  # before other tags go, so that escaped tags go with them
        out = _characters(out, source, rules)
    out = F.regexp_replace(out, r"<[^>]+>", rules.tag)
    if not rules.decode_first:
        out = _characters(out, source, rules)
    if rules.by_line:
        lines = F.transform(F.split(F.replace(out, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
        return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), rf"{SPACE}*\n{SPACE}*", "\n")
    return F.regexp_replace(out, rf"\A{SPACE}+|{SPACE}+\z", "")


def body_of(page: Column) -> Column:
    """What is in the body; the whole page if it has none."""
    return F.when(page.rlike(_BODY), F.regexp_extract(page, _BODY, 1)).otherwise(page)


def _characters(text: Column, source: str, rules: TextRules) -> Column:
    if source != "boe":
        return decoded(text, rules.names, any_case=rules.any_case)
    # this source decodes one kind after the other, so that &amp;lt; ends as <
    numbers = lambda own: F.replace(decoded(F.regexp_replace(own, r"&(?!#[0-9]+;)", "&\u0000"), {}), F.lit("\u0000"), F.lit(""))
    text = let(text, lambda own: F.when(own.contains("&#"), numbers(own)).otherwise(own))

    def named(own: Column) -> Column:
        for name, value in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
            own = F.regexp_replace(own, f"(?i)&{name};", value)
        return own

    return let(text, lambda own: F.when(own.contains("&"), named(own)).otherwise(own))


def elements_of_class(page: str, name: str) -> list[str]:
    """The inner markup of the outermost elements that have the class, by the balance of their tags, in page order."""
    out, at = [], 0
    start = re.compile(r"<([a-zA-Z][\w:-]*)\b[^>]*?\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>")
    while m := start.search(page, at):
        at = m.end()
        if name not in (m[2] or m[3] or "").split():
            continue
        depth = 1
        for t in re.finditer(rf"<(/?){re.escape(m[1])}\b[^>]*?(/?)>", page[m.end() :], re.I):
            depth += -1 if t[1] else 0 if t[2] else 1
            if depth == 0:
                out.append(page[m.end() : m.end() + t.start()])
                at = m.end() + t.end()
                break
    return out


@F.pandas_udf(T.StringType())
def _norm_blocks(page: pd.Series) -> pd.Series:
    def one(p: str | None) -> str | None:
        if p is None or not (found := elements_of_class(p, "jnhtml")) or not found[0]:
            return None
        return "\n".join(elements_of_class(found[0], "jurAbsatz")) or found[0]

    return page.map(one).astype(object)


def norm_content(page: Column) -> Column:
    """The paragraphs of the first norm, else the norm, else the body. Pages without a norm never reach Python."""
    marked = F.when(page.contains("jnhtml"), page)
    return F.coalesce(F.when(page.contains("jnhtml"), _norm_blocks(marked)), body_of(page))


def page_title(page: Column) -> Column:
    """The trimmed content of the first title element; null if there is none."""
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    return F.when(page.rlike(pattern), F.trim(F.regexp_extract(page, pattern, 1)))


def element(page: Column, opening: Column) -> Column:
    """The first element whose opening tag matches (a pattern for what is inside the tag, behind its name), with its
    tags, up to where they are balanced; null if there is none or it never ends."""
    from_start = F.call_function("regexp_extract", page, F.concat(F.lit(r"(?is)(<[\w:-]+\b"), opening, F.lit(r"[^>]*>.*)\z")), F.lit(1))
    rest = F.when(from_start != "", from_start)
    return let(rest, _balanced)


def _balanced(rest: Column) -> Column:
    tag = F.concat(F.lit(r"(?i)</?\Q"), F.regexp_extract(rest, r"\A<([\w:-]+)", 1), F.lit(r"\E\b[^>]*>"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
        seen = s["seen"] + 1
        return F.struct(depth.alias("depth"), seen.alias("seen"), F.when((s["end"] == 0) & (depth == 0), seen).otherwise(s["end"]).alias("end"))

    def cut(parts: Column) -> Column:
        joined = F.array_join(F.zip_with(F.slice(parts["tokens"], F.lit(1), parts["end"]), F.slice(parts["pieces"], F.lit(1), parts["end"]), lambda t, p: F.concat(p, t)), "")
        return F.when(parts["end"] > 0, joined)

    tokens = F.regexp_extract_all(rest, tag, F.lit(0))
    parts = let(tokens, lambda t: F.struct(t.alias("tokens"), F.split(rest, tag).alias("pieces"), F.aggregate(t, start, step)["end"].alias("end")))
    return let(parts, cut)


def element_by_id(page: Column, value: Column) -> Column:
    return element(page, F.concat(F.lit(r"[^>]*?\bid\s*=\s*[\"']\Q"), value, F.lit(r"\E[\"']")))


def element_by_class(page: Column, name: str) -> Column:
    return element(page, F.lit(rf"[^>]*?\bclass\s*=\s*[\"'](?:[^\"']*\s)?{re.escape(name)}(?:\s[^\"']*)?[\"']"))


def without_class(page: Column, name: str) -> Column:
    """page without the first element of the class."""
    cut = lambda p: let(element_by_class(p, name), lambda e: F.when(e.isNull(), p).otherwise(F.overlay(p, F.lit(""), F.position(e, p), F.length(e))))
    return let(page, cut)
