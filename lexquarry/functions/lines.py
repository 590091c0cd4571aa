"""Lines of payload pages: what is text and what is the page's own, by ordered rules over the lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import SPACE
from .references import decoded
from .text import let

#: How lines begin (whole words) that end the text of a RIS page.
STOPS = ("Schlagworte", "Zuletzt aktualisiert", "Gesetzesnummer", "Dokumentnummer", "Alte Dokumentnummer", "European Legislation Identifier", "https://www.ris.bka.gv.at/eli", "http://www.ris.bka.gv.at/eli", "Zum Seitenanfang", "Über diese Seite")
#: How lines begin (whole words) that are the page's, not the law's.
OWN_BEGINNINGS = ("Zum Inhalt", "Zur Navigationsleiste", "Impressum", "Sitemap", "English", "Druckansicht", "Gesamte Rechtsvorschrift", "Alle Fassungen", "Begleitende Dokumente", "Hauptdokument", "Kurztitel", "Kundmachungsorgan", "Typ", "§/Artikel/Anlage", "Inkrafttretensdatum", "Außerkrafttretensdatum", "Abkürzung", "Index", "Materialien", "Rechtssätze")
#: Whole lines of the page, with a colon or without.
OWN_LINES = ("Seitenbereiche", "Navigationsleiste")
#: Words of the page's scripts.
SCRIPT_WORDS = ("SmartPage_Initialize", "SmartPage_Context", "StyleUtility", "eventHandlers", "trackedControls", "synchronousPostBackCommands")
SCRIPT_STEMS = ("BasePage_On", "WxePage_")
#: Beginnings, in any case, of lines that are never text.
NEVER_TEXT = ("BUNDESRECHT KONSOLIDIERT", "INFORMATION ZUM DOKUMENT", "GESETZESNUMMER:", "DOKUMENTNUMMER:", "ALTE DOKUMENTNUMMER:", "ZULETZT AKTUALISIERT AM:", "ZULETZT AKTUALISIERT:", "PRÄAMBEL/PROMULGATIONSKLAUSEL")
#: Beginnings, as written, of lines that are not text unless they name an article.
NOT_TEXT = ("Startseite", "RIS Dokument", "Datenschutz", "Barrierefreiheit", "Kontakt")
#: Named references of RIS pages.
RIS_NAMES = {"amp": "&", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "apos": "'", "sect": "§", "szlig": "ß", "auml": "ä", "Auml": "Ä", "ouml": "ö", "Ouml": "Ö", "uuml": "ü", "Uuml": "Ü"}

_ARTICLE = r"(?:§|Art(?:ikel)?[.]?)"


def _words(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def _is(line: Column, pattern: str) -> Column:
    return line.rlike(f"(?iu){pattern}")


def is_stop(line: Column) -> Column:
    return _is(line, rf"\A(?:{_words(STOPS)})(?![A-Za-z0-9_])") | _is(line, r"\A©\s*[0-9]{4}") | _is(line, "Bundeskanzleramt der Republik Österreich")


def is_own(line: Column) -> Column:
    """A line of the page itself: its scripts, menus and labels."""
    begins = _is(line, rf"\A(?:{_words(OWN_BEGINNINGS)})(?![A-Za-z0-9_])") | _is(line, rf"\A(?:{_words(OWN_LINES)}):?\z") | _is(line, r"\ASie sind dabei, die Seite zu verlassen") | line.rlike(r"\A(?://|['\"`)])")
    return begins | _is(line, rf"(?<![A-Za-z0-9_])(?:(?:{_words(SCRIPT_WORDS)})(?![A-Za-z0-9_])|{_words(SCRIPT_STEMS)})") | _is(line, r"\A§\s*[0-9]+\s+(?:am|heute|gültig)")


def is_marker(line: Column) -> Column:
    """The number of an article or paragraph alone."""
    return _is(line, r"\AParagraph\s*[0-9]+[,.]?\s*\z") | _is(line, rf"\A{_ARTICLE}\s*[0-9]+[a-z]?\s*(?:[.]?\s*Paragraph\s*[0-9]+,?)?\s*[,.;:]?\s*\z")


def is_structure(line: Column) -> Column:
    """A heading of a part of the law."""
    return _is(line, r"\A(?:Allgemeiner|Besonderer)\s+Teil\z") | _is(line, r"\A[A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]+\s+Abschnitt\z") | _is(line, r"\AStrafbare Handlungen(?![A-Za-z0-9_])")


def is_text(line: Column) -> Column:
    """The rules in their order: the first that applies says whether the line is text."""
    rules = [
        (_is(line, rf"\A(?:{_words(NEVER_TEXT)})") | _is(line, "EUROPEAN LEGISLATION IDENTIFIER"), False),
        (_is(line, r"\Ainhalt") & (F.length(line) < 30), False),
        (_is(line, r"\A(?:§\s*[0-9]+|artikel\s*[0-9]+|art[.]?\s*[0-9]+)") & (F.length(line) < 60), True),
        (line.rlike(rf"\ASeite\s+[0-9]+\s+von|\A(?:{_words(NOT_TEXT)})"), False),
        (is_marker(line) | is_own(line), False),
    ]
    out = line != ""
    for test, answer in rules[::-1]:
        out = F.when(test, answer).otherwise(out)
    return out


def page_lines(page: Column) -> Column:
    """The lines of markup that aren't blank: blocks and breaks end them, tags are spaces."""
    broken = F.regexp_replace(F.regexp_replace(page, r"(?i)</(?:h[1-6]|p|div|section|li|dt|dd|ol|ul|table|tr|td|th)>", "\n"), r"(?i)<br\s*/?>", "\n")
    text = decoded(F.regexp_replace(broken, r"<[^>]+>", " "), RIS_NAMES)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")), lambda x: x != "")


def without_code(page: Column) -> Column:
    return F.regexp_replace(page, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", "\n")


def _first(lines: Column, test) -> Column:
    """The place of the first line that passes, from 1; 0 if none does."""
    return F.array_position(F.transform(lines, test), True).cast("int")


def _from(lines: Column, place: Column) -> Column:
    return F.slice(lines, place, F.greatest(F.size(lines) - place + 1, F.lit(0)))


def ris_region(lines: Column) -> Column:
    """The text of a page whose parts aren't marked: from behind the label `Text`, else from the first article's number,
    up to what ends it; without the page's own lines, headings of parts ahead of the text, and numbers alone."""

    def cut(own: Column) -> Column:
        label = _first(own, lambda x: _is(x, r"\AText\z"))
        article = _first(own, lambda x: _is(x, rf"\A{_ARTICLE}\s*[0-9]+[a-z]?"))
        return let(F.when((label > 0) & (label < F.size(own)), label + 1).otherwise(article), lambda begin: F.when(begin == 0, own).otherwise(inside(_from(own, begin))))

    def inside(rest: Column) -> Column:
        body = let(rest, lambda r: let(_first(r, is_stop), lambda end: F.when(end == 0, r).otherwise(F.slice(r, F.lit(1), end - 1))))
        body = let(F.filter(body, lambda x: ~is_own(x)), lambda b: let(_first(b, lambda x: ~is_structure(x)), lambda at: F.when(at == 0, F.array().cast("array<string>")).otherwise(_from(b, F.greatest(at, F.lit(1))))))
        return F.filter(body, lambda x: ~is_marker(x))

    return F.filter(let(lines, cut), is_text)


def _part(page: Column) -> Column:
    """What is in the part that holds the text, up to the first end of a div; null if the page has no such part."""
    forms = [r"<div[^>]*id=[\"']tabContent[\"'][^>]*>(.*?)</div>"] + [rf"<div[^>]*class=[\"'][^\"']*{c}[^\"']*[\"'][^>]*>(.*?)</div>" for c in ("tocContent", "docText")]
    return F.coalesce(*[F.when(page.rlike(f"(?is){f}"), F.regexp_extract(page, f"(?is){f}", 1)) for f in forms])


def _body(page: Column) -> Column:
    form = r"(?is)<body\b[^>]*>(.*?)</body>"
    return F.when(page.rlike(form), F.regexp_extract(page, form, 1)).otherwise(page)


def ris_lines(page: Column) -> Column:
    """The lines of the text of a page."""
    return let(_body(without_code(page)), lambda b: let(_part(b), lambda part: F.when(part.isNotNull(), F.filter(page_lines(part), is_text)).otherwise(ris_region(page_lines(b)))))


def ris_text(page: Column) -> Column:
    return F.array_join(ris_lines(page), "\n")


def _generic(line: Column) -> Column:
    """A heading that every page of a law has."""
    own = F.regexp_replace(line, r"\s+", " ")
    return _is(own, r"\ABundesrecht konsolidiert(?![A-Za-z0-9_])") | _is(own, r"\A[^-–—:]*(?<![A-Za-z0-9_])(?:Art[.]?|Artikel)\s*[0-9]+[a-z]?\s*(?:,?\s*tagesaktuelle\s+Fassung)?\z") | _is(own, r"\A[^-–—:]*[A-Za-z0-9_]§\s*[0-9]+[a-z]?\s*(?:,?\s*tagesaktuelle\s+Fassung)?\z")


def numbered_heading(line: Column) -> Column:
    """What stands behind an article's number, if that is a heading; else null."""
    form = r"(?iu)\A(?:§[.]?\s*[0-9]+[a-z]?(?:[.]?\s*Paragraph\s*[0-9]+,?)?|Art(?:ikel)?[.]?\s*[0-9]+[a-z]?)\s+(.+)\z"
    rest = F.trim(F.regexp_replace(F.regexp_extract(line, form, 1), r"\A[-–—:,\s]+", ""))
    return let(F.when(line.rlike(form), rest), lambda h: F.when((h != "") & ~_generic(h) & ~_is(h, r"\AParagraph\s*[0-9]+"), h))


def _first_value(lines: Column, value) -> Column:
    return F.try_element_at(F.filter(F.transform(lines, value), lambda x: x.isNotNull()), F.lit(1))


def ris_heading(page: Column) -> Column:
    """The heading of the article: from the page's first heading, else from the text's first eight lines; null if none."""
    form = r"(?is)<h1[^>]*>(.*?)</h1>"

    def from_title(lines: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        plain = F.when(~_is(last, r"\A(?:§[.]?\s*[0-9]+|Art(?:ikel)?[.]?\s*[0-9]+)") & ~_generic(last), last)
        return F.coalesce(_first_value(F.reverse(lines), numbered_heading), plain)

    def likely(line: Column) -> Column:
        fits = ~_generic(line) & ~is_marker(line) & ~is_stop(line) & ~is_own(line) & ~is_structure(line) & (F.length(line) <= 80) & (F.size(F.split(line, r"\s+")) <= 8) & ~line.rlike(r"[.!?]\z")
        return F.when(fits, line)

    def from_lines(lines: Column) -> Column:
        return let(F.slice(lines, 1, 8), lambda own: F.coalesce(_first_value(own, numbered_heading), _first_value(own, likely)))

    def whole(clean: Column) -> Column:
        title = F.when(clean.rlike(form), let(page_lines(F.regexp_extract(clean, form, 1)), from_title))
        region = let(_body(clean), lambda b: let(_part(b), lambda part: F.when(part.isNotNull(), page_lines(part)).otherwise(ris_region(page_lines(b)))))
        return F.coalesce(title, let(region, from_lines))

    return let(without_code(page), whole)


def ris_metadata(page: Column) -> Column:
    """number of the law, number of the document, and the day of the last change, as the page says; null where it doesn't."""
    take = lambda p: F.nullif(F.trim(F.regexp_extract(_body(page), f"(?i){p}", 1)), F.lit(""))
    return F.struct(take(r"Gesetzesnummer:\s*([^\s<]+)").alias("law_number"), take(r"Dokumentnummer:\s*([^\s<]+)").alias("document_number"), take(r"Zuletzt aktualisiert(?:\sam)?:\s*([^<]+)").alias("updated"))


def ris_english(page: Column, article: Column) -> Column:
    """The heading and text of an article of the English constitution: the second cells of the table's rows from the row
    of the article's heading up to that of the next one. Text is empty, and heading null, where there is no such article."""
    title = r"(?i)\AArticle\s+([0-9]+[a-z]?)[.]?\z"
    heading = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"

    def titles(chunk: Column) -> Column:
        plain = F.transform(F.regexp_extract_all(chunk, F.lit(heading), F.lit(1)), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", " "), rf"{SPACE}+", " ")))
        return F.filter(plain, lambda t: t.rlike(title))

    number = lambda t: F.regexp_extract(t, title, 1)

    def take(rows: Column) -> Column:
        marks = F.flatten(F.transform(rows, lambda r, i: F.transform(r["titles"], lambda t: F.struct(i.alias("row"), number(t).alias("n"), t.alias("t")))))
        return let(marks, lambda m: let(_first(m, lambda x: x["n"] == F.trim(article)), lambda at: F.when(at > 0, between(rows, m, at))))

    def between(rows: Column, marks: Column, at: Column) -> Column:
        later = F.filter(_from(marks, at + 1), lambda x: x["n"] != F.trim(article))
        begin = F.element_at(marks, at)["row"]
        end = F.coalesce(F.try_element_at(later, F.lit(1))["row"], F.size(rows))
        cells = F.transform(F.slice(rows, begin + 1, F.greatest(end - begin, F.lit(0))), lambda r: cell(r["chunk"]))
        body = F.regexp_replace(F.array_join(F.filter(cells, lambda c: c.isNotNull()), "\n"), r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>", " ")
        body = F.regexp_replace(body, r"(?is)<(?:span|div|p|li|ol|ul)[^>]*class=[\"'][^\"']*sr-only[^\"']*[\"'][^>]*>.*?</(?:span|div|p|li|ol|ul)>", " ")
        return F.struct(F.element_at(marks, at)["t"].alias("heading"), F.array_join(F.filter(page_lines(body), is_text), "\n").alias("text"))

    def cell(chunk: Column) -> Column:
        row = F.regexp_extract(chunk, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)
        return F.coalesce(F.try_element_at(F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), F.lit(2)), F.lit(""))

    rows = F.transform(F.split(without_code(page), "(?=<tr)"), lambda c: F.struct(c.alias("chunk"), titles(c).alias("titles")))
    return F.coalesce(let(rows, take), F.struct(F.lit(None).cast("string").alias("heading"), F.lit("").alias("text")))


def translation_lines(page: Column) -> Column:
    """The lines of an English translation of a German law."""
    clean = F.regexp_replace(F.regexp_replace(page, r"(?s)<!--.*?-->", " "), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    broken = F.regexp_replace(F.regexp_replace(_body(clean), r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:h[1-6]|p|div|li|dt|dd|dl|ul|ol|table|tr|section|article|nav)>", "\n")
    text = lambda x: F.regexp_replace(F.regexp_replace(decoded(F.regexp_replace(x, r"<[^>]+>", " "), GII_NAMES), r"[ \t]+", " "), rf"\A{SPACE}+|{SPACE}+\z", "")
    return F.filter(F.transform(F.split(broken, "\n"), text), lambda x: x != "")


#: Named references of German pages.
GII_NAMES = {"amp": "&", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "szlig": "ß", "auml": "ä", "Auml": "Ä", "ouml": "ö", "Ouml": "Ö", "uuml": "ü", "Uuml": "Ü"}
CONTENTS = "table of contents"


def translated_part(lines: Column, number: Column, articles: bool) -> Column:
    """heading and text of a section (or article) between its number's line and the next one, or a list of contents.

    The number stands in a list of contents too: a place with nothing behind it is passed over. The line behind the
    number is the heading unless it begins like a paragraph; an article's may be in brackets. Null if nothing is found.
    """
    mark = rf"(?i)\A(?:{'Article|Art[.]?' if articles else 'Section'})\s+([0-9]+[a-z]?)\z"
    wanted = F.lower(F.trim(number))

    def take(own: Column) -> Column:
        places = F.filter(F.transform(own, lambda x, i: F.when(F.lower(F.regexp_extract(x, mark, 1)) == wanted, i + 1)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(own, lambda x, i: F.when(x.rlike(mark) | (x == CONTENTS), i + 1)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.try_element_at(F.filter(F.transform(places, lambda i: part(own, e, i)), lambda p: F.size(p["lines"]) > 0), F.lit(1)))

    def part(own: Column, ends: Column, i: Column) -> Column:
        behind = F.try_element_at(own, (i + 1).cast("int"))
        head = F.when(~behind.rlike(r"(?i)\A(?:\([0-9]+[a-z]?\)|[0-9]+[.])\s+"), behind)
        begin = F.when(head.isNotNull(), i + 2).otherwise(i + 1)
        end = F.coalesce(F.array_min(F.filter(ends, lambda e: e >= begin)), F.size(own) + 1)
        shown = F.when(behind.rlike(r"\A\[.*\]\z"), F.substring(behind, 2, F.length(behind) - 2)).otherwise(head) if articles else head
        return F.struct(shown.alias("heading"), F.slice(own, begin, F.greatest(end - begin, F.lit(0))).alias("lines"))

    return let(let(lines, take), lambda p: F.when(p.isNotNull(), F.struct(p["heading"].alias("heading"), F.array_join(p["lines"], "\n").alias("text"))))
