"""Presentation: quotes, labels and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import parse_celex, reference_label
from .languages import native_name

#: The notices and the footer of a formatted section.
ENGLISH_NOTICE = "Textvariante: Englischer Gesetzestext von Gesetze im Internet (nicht amtlich)."
AUSTRIAN_NOTICE = "Bundesrecht konsolidiert; Informationsfassung, rechtlich unverbindlich."
FINNISH_NOTICE = "Finlex consolidated text from an official source; the retrieved consolidated expression is marked non-authoritative."
LANGUAGE_NOTICE = "Amtliche EU-Sprachfassung: %s."
CELEX_NOTICE = "CELEX: %s."
SOURCE_NOTICE, CACHE_NOTICE = "Quelle: %s%s, %s, abgerufen am %s.", "Cache: %s."


def quoted(text: Column) -> Column:
    """A Markdown block quote: `> ` before every line."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")


def cache_key(law_code: Column, section: Column, kind: Column, jurisdiction: Column, celex: Column, subsection: Column, language: Column, variant: Column) -> Column:
    """The key under which a section is kept; null where it can't be kept (no valid CELEX number, another language)."""
    own = lambda c: F.lower(F.trim(c))
    sub = F.coalesce(own(subsection), F.lit(""))
    article = F.concat(F.lit("art:"), own(section), F.when(sub != "", F.concat(F.lit(":sec:"), sub)).otherwise(""))
    part = F.when(kind == "article", article).otherwise(own(section))
    plain = F.concat(F.upper(F.trim(law_code)), F.lit(":"), part)
    number = F.upper(F.trim(celex))
    source = F.when(variant == "translation-en", variant).otherwise("official-de")
    return (
        F.when(jurisdiction == "EU", F.when(parse_celex(number).isNotNull(), F.concat(F.lit("EU:"), number, F.lit(":"), part, F.lit(":"), F.coalesce(F.lower(language), F.lit("de")))))
        .when(jurisdiction == "FI", F.when(F.coalesce(language, F.lit("fin")).isin("fin", "swe"), F.concat(F.lit("FI:"), plain, F.lit(":official-"), F.when(language == "swe", "sv").otherwise("fi"))))
        .when(jurisdiction == "CH", F.when(F.coalesce(language, F.lit("de")).isin("de", "fr", "it"), F.concat(F.lit("CH:"), plain, F.lit(":official-"), F.coalesce(language, F.lit("de")))))
        .otherwise(F.concat(F.when(jurisdiction.isin("AT", "ES"), F.concat(jurisdiction, F.lit(":"))).otherwise(""), plain, F.lit(":"), source))
    )


def law_label(jurisdiction: Column, law_code: Column, title: Column) -> Column:
    """What a law is called: its title where codes are technical (null if it has none), else its code."""
    return F.when(jurisdiction.isin("IT", "NL"), F.nullif(F.trim(title), F.lit(""))).otherwise(law_code)


def markdown_section(s: Column, footer: bool = True) -> Column:
    """A section as Markdown: heading and text as a quote, notices of its source, and where it is from.

    s: struct of jurisdiction, law_code, law_title, section, subsection, reference_type, heading, text, variant,
    language, celex, provider, retrieved_at, cache_status. Null headings, languages and numbers leave their part out.
    """
    label, law = reference_label(s["reference_type"], s["section"], s["subsection"]), law_label(s["jurisdiction"], s["law_code"], s["law_title"])
    optional = lambda c, form: F.when(c.isNotNull() & (c != ""), F.format_string(form, c)).otherwise("")
    no = F.array().cast("array<string>")
    when = lambda test, *lines: F.when(F.coalesce(test, F.lit(False)), F.array(*lines)).otherwise(no)
    eu, blank = s["jurisdiction"] == "EU", F.lit("")
    head = F.concat(F.lit("> **"), label, optional(law, " %s"), optional(s["heading"], " – %s"), F.lit("**"))
    name = native_name(s["language"])
    parts = [
        F.array(head, F.lit(">")), F.transform(F.split(s["text"], "\n"), lambda line: F.concat(F.lit("> "), line)),
        when(s["variant"] == "translation-en", blank, F.lit(ENGLISH_NOTICE)), when(s["jurisdiction"] == "AT", blank, F.lit(AUSTRIAN_NOTICE)),
        when(eu & name.isNotNull(), blank, F.format_string(LANGUAGE_NOTICE, name)), when(eu & (s["celex"] != ""), F.format_string(CELEX_NOTICE, s["celex"])),
    ]
    if footer:
        parts.append(F.array(blank, F.format_string(SOURCE_NOTICE, s["provider"], optional(law, ", %s"), label, F.substring(s["retrieved_at"], 1, 10)), F.format_string(CACHE_NOTICE, s["cache_status"])))
    return F.array_join(F.concat(*parts), "\n")


def preview(s: Column, footer: bool = True) -> Column:
    """A section as it is shown before it is taken over: struct of title, paragraphs (the lines of its text) and
    metadata_lines (notices, and with footer where it is from).

    s as for markdown_section, with is_authoritative_text; a Finnish text has a notice unless that is true. A null text
    has no paragraphs, an empty one has one that is empty.
    """
    label, law = reference_label(s["reference_type"], s["section"], s["subsection"]), law_label(s["jurisdiction"], s["law_code"], s["law_title"])
    has = lambda c: F.coalesce(c != "", F.lit(False))
    after = lambda c, mark: F.when(has(c), F.concat(F.lit(mark), c)).otherwise("")
    name, eu = native_name(s["language"]), s["jurisdiction"] == "EU"
    lines = [
        F.when(s["variant"] == "translation-en", ENGLISH_NOTICE), F.when(s["jurisdiction"] == "AT", AUSTRIAN_NOTICE),
        F.when((s["jurisdiction"] == "FI") & ~F.coalesce(s["is_authoritative_text"], F.lit(False)), FINNISH_NOTICE),
        F.when(eu & name.isNotNull(), F.format_string(LANGUAGE_NOTICE, name)), F.when(eu & has(s["celex"]), F.format_string(CELEX_NOTICE, s["celex"])),
    ]
    if footer:
        lines += [F.format_string(SOURCE_NOTICE, s["provider"], after(law, ", "), label, F.substring(s["retrieved_at"], 1, 10)), F.format_string(CACHE_NOTICE, s["cache_status"])]
    title = F.concat(label, after(law, " "), after(s["heading"], " – "))
    return F.struct(title.alias("title"), F.coalesce(F.split(s["text"], "\n"), F.array().cast("array<string>")).alias("paragraphs"), F.array_compact(F.array(*lines)).alias("metadata_lines"))
