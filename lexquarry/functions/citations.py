"""Citations: free text to structured references, as Spark expressions.

Rules are templates, tried in order: `{code}` and `{n}` are what is taken out, `[§]` may be there, `Art` is an
article marker, other words stand for themselves. The first rule that matches wins. A reference that isn't certain
is null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogs import CITATION_WORDS, EU_ACTS, SOCIAL_CODE_PARTS, SWISS_CODES
from .text import let

#: What white space is, and the forms of codes, sections and markers.
SPACE = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CODE = r"[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß0-9-]*"
SECTION = r"[0-9]+[A-Za-z]?"
MARKER = r"(?:Art\.?|Artikel)"
SPANISH_MARKER, SPANISH_SECTION = r"(?:Art\.?|Artículo)", r"[0-9]+(?:[A-Za-z]|\s+(?:bis|ter|quater|quinquies|sexies))?"
CELEX = r"\A3([0-9]{4})([RLD])([0-9]{4,6})\z"

REFERENCE = "struct<law_code:string,section:string,reference_type:string,jurisdiction:string,subsection:string,eu_celex:string,eu_document_type:string>"

#: (template, any case, jurisdiction, reference type) in the order of the rules.
_PARTS = "(?:" + "|".join(SOCIAL_CODE_PARTS) + ")"
GENERAL = [
    ("AT {code} [§]{n}", False, "AT", None),
    ("AT [§]{n} {code}", False, "AT", None),
    ("[§]{n} {code} AT", False, "AT", None),
    ("{code} AT [§]{n}", False, "AT", None),
    ("AT Art{n} {code}", True, "AT", "article"),
    ("AT {code} Art{n}", True, "AT", "article"),
    ("Art{n} {code} AT", True, "AT", "article"),
    ("{code} Art{n} AT", True, "AT", "article"),
    ("Art{n} {GG}", True, None, "article"),
    ("{GG} Art{n}", True, None, "article"),
    ("Art{n} §{m} {EGBGB}", True, None, "article"),
    ("{EGBGB} Art{n} §{m}", True, None, "article"),
    ("Art{n} {EGBGB}", True, None, "article"),
    ("{EGBGB} Art{n}", True, None, "article"),
    ("{SGB} [§]{n}", True, None, "section"),
    ("[§]{n} {SGB}", True, None, "section"),
    ("{FreizügG/EU} [§]{n}", True, None, "section"),
    ("[§]{n} {FreizügG/EU}", True, None, "section"),
    ("{code} [§]{n}", False, None, None),
    ("[§]{n} {code}", False, None, None),
]


def collapsed(text: Column) -> Column:
    """Trimmed, every run of white space (of any script) one space."""
    return F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", ""), rf"{SPACE}+", " ")


def normalised(text: Column) -> Column:
    """Trimmed small letters; inner white space stays. Callers with compatibility characters apply NFKC before."""
    return F.lower(F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", ""))


def _pattern(template: str, any_case: bool) -> tuple[str, list[str]]:
    """The regular expression of a template, and the names of its groups in order."""
    out, names = [], []
    for word in template.split(" "):
        piece = ""
        for part in re.findall(r"\[§\]|§|Art|\{[^}]+\}|.+", word):
            if part == "[§]":
                piece += r"(?:§ ?)?"
            elif part == "§":
                piece += "§ ?"
            elif part == "Art":
                piece += MARKER + " ?"
            elif part.startswith("{"):
                name = part[1:-1]
                names.append({"n": "section", "m": "subsection"}.get(name, "code"))
                piece += {"code": f"({CODE})", "n": f"({SECTION})", "m": f"({SECTION})", "SGB": f"(SGB {_PARTS})"}.get(name, f"({re.escape(name)})")
            else:
                piece += part
        out.append(piece)
    return ("(?iu)" if any_case else "") + r"\A" + " ".join(out) + r"\z", names


def _reference(code: Column, section: Column, kind: str | None, jurisdiction: str | None, subsection: Column | None = None, celex: Column | None = None, document: Column | None = None) -> Column:
    none, text = F.expr("cast(null as string)"), lambda x: F.expr(f"cast({'null' if x is None else repr(x)} as string)")
    values = [code, section, text(kind), text(jurisdiction), *[none if x is None else x for x in (subsection, celex, document)]]
    return F.struct(*values).cast(REFERENCE)


def _nothing() -> Column:
    return F.lit(None).cast(REFERENCE)


def _by_rule(text: Column, template: str, any_case: bool, jurisdiction: str | None, kind: str | None) -> tuple[Column, Column]:
    pattern, names = _pattern(template, any_case)
    got = {n: F.regexp_extract(text, pattern, i + 1) for i, n in enumerate(names)}
    return text.rlike(pattern), _reference(F.upper(got["code"]), got["section"], kind, jurisdiction, got.get("subsection"))


def parse_general(text: Column) -> Column:
    """The reference of a citation of any but the EU, Spanish, Finnish, Italian and Dutch forms; null if none."""
    return _general(collapsed(text))


def _general(text: Column) -> Column:
    out = None
    for rule in GENERAL:
        matches, found = _by_rule(text, *rule)
        if rule[0] in ("{code} [§]{n}", "[§]{n} {code}"):  # that code is cited by article only
            found = F.when(found["law_code"] != "EGBGB", found)
        out = F.when(matches, found) if out is None else out.when(matches, found)
    return out


def parse_celex(value: Column) -> Column:
    """sector, year, document_type, number (all strings) of a CELEX number of an act; null if it isn't one."""
    year, number = F.regexp_extract(value, CELEX, 1), F.regexp_extract(value, CELEX, 3)
    good = value.rlike(CELEX) & year.try_cast("int").between(1952, 2099) & (number.try_cast("int") >= 1)
    return F.when(good, F.struct(F.lit("3").alias("sector"), year.alias("year"), F.regexp_extract(value, CELEX, 2).alias("document_type"), number.alias("number")))


def padded_number(number: Column) -> Column:
    """A number of 1 to 6 digits, at least 1, with zeros up to four digits; longer ones as they are."""
    good = number.rlike(r"\A[0-9]{1,6}\z") & (number.try_cast("int") >= 1)
    return F.when(good, F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def _map_sql(pairs: dict[str, str]) -> str:
    """A map literal; as SQL text it is one call to the JVM and not one for each value. Values have no quotes."""
    return "map(" + ", ".join(f"'{x}'" for kv in pairs.items() for x in kv) + ")"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.expr(_map_sql(pairs))


def celex_of_alias(code: Column) -> Column:
    """The CELEX number of the curated act that has this name, in any case; null if there is none."""
    return F.try_element_at(_literal_map({a.upper(): c for c, _, aliases, _ in EU_ACTS for a in aliases}), F.upper(F.regexp_replace(code, rf"\A{SPACE}+|{SPACE}+\z", "")))


def code_of_celex(celex: Column) -> Column:
    """The code of a curated act; another act's number is its own code."""
    return F.coalesce(F.try_element_at(_literal_map({c: k for c, k, _, _ in EU_ACTS}), celex), celex)


def _eu_reference(celex: Column, section: Column) -> Column:
    return let(celex, lambda c: F.when(parse_celex(c).isNotNull(), _reference(code_of_celex(c), section, "article", "EU", None, c, F.substring(c, 6, 1))))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that covers the whole text, in one match; null if it doesn't. Groups hold no U+0001."""
    taken = F.regexp_replace(text, pattern, "\u0001".join(["", *[f"${i}" for i in range(1, n + 1)], ""]))
    return let(taken, lambda t: F.when(t.startswith("\u0001"), F.split(t, "\u0001")))


def _first_of(*branches: tuple[Column, Column]) -> Column:
    out = F.when(*branches[0])
    for b in branches[1:]:
        out = out.when(*b)
    return out


def _eu_celex_article(text: Column) -> Column:
    number = r"(?:CELEX ?:? ?)?(3[0-9]{4}[RLD][0-9]{4,6})"
    a, b = rf"(?iu)\A{number} {MARKER} ?({SECTION})\z", rf"(?iu)\A{MARKER} ?({SECTION}) {number}\z"
    take = lambda p, i: F.regexp_extract(text, p, i)
    return _first_of((text.rlike(a), _eu_reference(F.upper(take(a, 1)), take(a, 2))), (text.rlike(b), _eu_reference(F.upper(take(b, 2)), take(b, 1))))


def _eu_alias_article(text: Column) -> Column:
    names = "|".join(re.escape(a).replace(r"\ ", " ") for _, _, aliases, _ in EU_ACTS for a in aliases)
    a, b = rf"(?iu)\A({names}) {MARKER} ?({SECTION})\z", rf"(?iu)\A{MARKER} ?({SECTION}) ({names})\z"
    take = lambda p, i: F.regexp_extract(text, p, i)
    return _first_of((text.rlike(a), _eu_reference(celex_of_alias(take(a, 1)), take(a, 2))), (text.rlike(b), _eu_reference(celex_of_alias(take(b, 2)), take(b, 1))))


def _type_of_words(words: Column) -> Column:
    """R, L or D for `marker|name of the act|code` in small letters, all of one language; null if there is none."""
    types: dict[str, str] = {}
    for _, marks, r, l, d, org in CITATION_WORDS:
        for mark in marks:
            for kind, name in (("R", r), ("L", l), ("D", d)):
                types.setdefault(f"{mark}|{name}|{org}".lower(), kind)
    return F.try_element_at(_literal_map(types), words)


def document_type_of(label: Column) -> Column:
    """R, L or D by the name of such an act in any language; null if languages disagree or none has it."""
    types: dict[str, set[str]] = {}
    for _, _, r, l, d, _ in CITATION_WORDS:
        for kind, name in (("R", r), ("L", l), ("D", d)):
            types.setdefault(name.lower(), set()).add(kind)
    return F.try_element_at(_literal_map({k: min(v) for k, v in types.items() if len(v) == 1}), F.lower(F.regexp_replace(label, r"\.\z", "")))


def is_organisation(code: Column) -> Column:
    return F.lower(F.regexp_replace(code, r"\.\z", "")).isin(sorted({org.lower() for *_, org in CITATION_WORDS}))


def _eu_named_article(text: Column) -> Column:
    """`Article 6 Regulation (EU) 2016/679` in 24 languages: marker, name and code of one language."""
    word, act = r"([\p{L}\p{M}]+)", r"(?:\(([\p{L}\p{M}]+)\) ([0-9]{4})/([0-9]{1,6})|([0-9]{4})/([0-9]{1,6})/([\p{L}\p{M}0-9]+))"
    a, b = rf"\A{word}\.? ?({SECTION}) {word} {act}\z", rf"\A{word} {act} {word}\.? ?({SECTION})\z"

    def branch(p: str, mark: int, section: int, label: int, first: int) -> Column:
        def made(g: Column) -> Column:
            either = lambda i, j: F.when(g[i] != "", g[i]).otherwise(g[j])
            kind = _type_of_words(F.lower(F.concat_ws("|", g[mark], g[label], either(first, first + 5))))
            return _eu_reference(F.concat(F.lit("3"), either(first + 1, first + 3), kind, padded_number(either(first + 2, first + 4))), g[section])

        return let(_groups(text, p, 9), made)

    return F.coalesce(branch(a, 1, 2, 3, 4), branch(b, 8, 9, 1, 2))


def is_eu_alias(text: Column) -> Column:
    """Whether an article of a curated EU act is cited by one of its names."""
    return _eu_alias_article(collapsed(text)).isNotNull()


def _dutch(text: Column) -> Column:
    code, article = r"(BWBR[0-9]{7})", rf"{MARKER} ?([0-9]+(?:[:.][0-9]+|[A-Za-z])?)"
    a, b = rf"(?iu)\A{code} {article}\z", rf"(?iu)\A{article} {code}\z"
    take = lambda p, i: F.regexp_extract(text, p, i)
    return _first_of((text.rlike(a), _reference(F.upper(take(a, 1)), take(a, 2), "article", "NL")), (text.rlike(b), _reference(F.upper(take(b, 2)), take(b, 1), "article", "NL")))


def _italian(text: Column) -> Column:
    code, article = r"(normattiva:([0-9]{4}-[0-9]{2}-[0-9]{2}):[^\s:]+)", r"Art\.? ?([0-9]+)"
    a, b = rf"\A{code} {article}\z", rf"\A{article} {code}\z"
    take = lambda p, i: F.regexp_extract(text, p, i)

    def good(date: Column, section: Column) -> Column:
        return F.try_to_date(date, "yyyy-MM-dd").isNotNull() & (F.substring(date, 1, 4) != "0000") & section.rlike("[1-9]")

    return _first_of((text.rlike(a) & good(take(a, 2), take(a, 3)), _reference(take(a, 1), take(a, 3), "article", "IT")), (text.rlike(b) & good(take(b, 3), take(b, 1)), _reference(take(b, 2), take(b, 1), "article", "IT")))


def _finnish(text: Column) -> Column:
    code = r"([0-9]{1,6}/[0-9]{4})"
    a, b = rf"\A{code} § ?([0-9]+)\z", rf"\A§ ?([0-9]+) {code}\z"
    take = lambda p, i: F.regexp_extract(text, p, i)
    return _first_of((text.rlike(a), _reference(take(a, 1), take(a, 2), "section", "FI")), (text.rlike(b), _reference(take(b, 2), take(b, 1), "section", "FI")))


def _spanish(text: Column) -> Column:
    code, article = r"(BOE-A-[0-9]{4}-[0-9]{1,5})", rf"{SPANISH_MARKER} ?({SPANISH_SECTION})"
    a, b = rf"(?iu)\A{article} {code}\z", rf"(?iu)\A{code} {article}\z"
    take = lambda p, i: F.regexp_extract(text, p, i)
    own = lambda s: F.when(s.contains(" "), F.lower(s)).otherwise(s)  # noqa: E731  a suffix word is in small letters
    return _first_of((text.rlike(a), _reference(F.upper(take(a, 2)), own(take(a, 1)), "article", "ES")), (text.rlike(b), _reference(F.upper(take(b, 1)), own(take(b, 2)), "article", "ES")))


def _with(ref: Column, **changes: Column) -> Column:
    return reduce(lambda r, kv: r.withField(*kv), changes.items(), ref)


def parse_citation(text: Column, jurisdiction: Column) -> Column:
    """The reference that a citation means to a reader of that jurisdiction; null if there is none or it isn't certain.

    As one expression; parse_citations has the same in steps, which plan and run faster.
    """
    clean = collapsed(text)
    return _in_jurisdiction(clean, jurisdiction, _general(clean), _eu_alias_article(clean))


def parse_citations(rows: DataFrame, text_col: str, jurisdiction: Column | str, out: str = "reference") -> DataFrame:
    """rows with the reference of each citation. The clean text and what several rules need are columns of their own,
    made once for each row. A jurisdiction that is the same for all rows is best given as a text: only its rules are
    planned then, and for the EU the others wait for the number's."""
    own = rows.columns
    step = rows.withColumn("_clean", collapsed(F.col(text_col)))
    if isinstance(jurisdiction, str) and jurisdiction == "EU":
        step = step.withColumn("_celex", _eu_celex_article(F.col("_clean")))
        open_ = F.col("_celex").isNull()
        step = step.withColumns({"_general": F.when(open_, _general(F.col("_clean"))), "_alias": F.when(open_, _eu_alias_article(F.col("_clean")))})
        named = F.when(open_ & F.col("_alias").isNull(), _eu_named_article(F.col("_clean")))
        return step.select(*own, F.coalesce("_celex", "_alias", named, _as_eu(F.col("_general"))).alias(out))
    step = step.withColumn("_jurisdiction", F.lit(jurisdiction) if isinstance(jurisdiction, str) else jurisdiction)
    step = step.withColumns({"_general": _general(F.col("_clean")), "_alias": _eu_alias_article(F.col("_clean"))})
    return step.select(*own, _in_jurisdiction(F.col("_clean"), F.col("_jurisdiction"), F.col("_general"), F.col("_alias")).alias(out))


def _as_eu(general: Column) -> Column:
    """What the general rules found, as an article of an EU act, if no jurisdiction is named and the code is one's alias."""
    code = celex_of_alias(general["law_code"])
    return F.when(general["jurisdiction"].isNotNull(), general).when((general["reference_type"] == "article") & code.isNotNull(), _eu_reference(code, general["section"]))


def _in_jurisdiction(clean: Column, jurisdiction: Column, general: Column, alias: Column) -> Column:
    none_yet = general["jurisdiction"].isNull()
    eu_code = celex_of_alias(general["law_code"])
    swiss = (general["reference_type"] == "article") & general["law_code"].isin(SWISS_CODES)
    as_swiss = F.when(~none_yet, general).when(swiss, _with(general, jurisdiction=F.lit("CH")))
    a, b = rf"(?iu)\A{MARKER} ?({SECTION}) ({CODE})\z", rf"(?iu)\A({CODE}) {MARKER} ?({SECTION})\z"
    take = lambda p, i: F.regexp_extract(clean, p, i)
    swiss_article = _first_of(
        (clean.rlike(a) & F.upper(take(a, 2)).isin(SWISS_CODES), _reference(F.upper(take(a, 2)), take(a, 1), "article", "CH")),
        (clean.rlike(b) & F.upper(take(b, 1)).isin(SWISS_CODES), _reference(F.upper(take(b, 1)), take(b, 2), "article", "CH")),
    )
    foreign = F.when(general.isNotNull(), none_yet & eu_code.isNotNull()).otherwise(alias.isNotNull())  # an EU act, elsewhere
    return (
        F.when(jurisdiction == "NL", _dutch(clean))
        .when(jurisdiction == "IT", _italian(clean))
        .when(jurisdiction == "ES", _spanish(clean))
        .when(jurisdiction == "FI", _finnish(clean))
        .when(jurisdiction == "EU", F.coalesce(_eu_celex_article(clean), alias, _eu_named_article(clean), _as_eu(general)))
        .when(foreign, _nothing())
        .when(jurisdiction == "AT", F.when(general.isNotNull(), F.when(none_yet, _with(general, jurisdiction=F.lit("AT"))).otherwise(general)).otherwise(_general(F.concat(F.lit("AT "), clean))))
        .when(jurisdiction == "CH", F.when(general.isNotNull(), as_swiss).otherwise(swiss_article))
        .otherwise(general)
    )


def reference_label(kind: Column, section: Column, subsection: Column | None = None) -> Column:
    """`§ n`, `Art. n` or `Art. n § m`."""
    more = F.when(subsection.isNotNull() & (subsection != ""), F.concat(F.lit(" § "), subsection)).otherwise("") if subsection is not None else F.lit("")
    return F.when(kind == "article", F.concat(F.lit("Art. "), section, more)).otherwise(F.concat(F.lit("§ "), section))
