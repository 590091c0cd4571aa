"""Section rows: one form for the results of all sources, with what is fixed of each source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of each source its label and whether its text is authoritative.
SOURCES = {
    "eur-lex": ("EUR-Lex", True),
    "fedlex": ("Fedlex / Bundesrecht der Schweiz", True),
    "neuris": ("Rechtsinformationen des Bundes", True),
    "gesetze-im-internet": ("Gesetze im Internet", False),
    "ris": ("RIS / Rechtsinformationssystem des Bundes", False),
    "boe": ("BOE / Agencia Estatal Boletín Oficial del Estado", False),
    "finlex": ("Finlex", False),
    "normattiva": ("Normattiva", False),
    "bwb": ("BWB / Wetten.nl", False),
}
#: The sources of each jurisdiction, in the order in which they are asked. Without one it is Germany.
ROUTES = {"EU": ("eur-lex",), "DE": ("neuris", "gesetze-im-internet"), "AT": ("ris",), "CH": ("fedlex",), "ES": ("boe",), "FI": ("finlex",), "IT": ("normattiva",), "NL": ("bwb",)}

_TEXTS = "provider_id provider_label source_url law_code law_title section reference_type source_variant jurisdiction language subsection heading text retrieved_at valid_from valid_to cache_status".split()
SECTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField("is_official_source", T.BooleanType()), T.StructField("is_authoritative_text", T.BooleanType()), T.StructField("eu_celex", T.StringType()), T.StructField("eu_document_type", T.StringType())]
)


def section_row(provider: str, **fields: Column) -> Column:
    """A struct of SECTION: the source's fixed values, a live official text, and the given fields; others are null."""
    label, authoritative = SOURCES[provider]
    known = {"provider_id": F.lit(provider), "provider_label": F.lit(label), "cache_status": F.lit("live"), "is_official_source": F.lit(True), "is_authoritative_text": F.lit(authoritative)} | fields
    if wrong := set(known) - set(SECTION.fieldNames()):
        raise ValueError(f"no fields of a section: {sorted(wrong)}")
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SECTION.fields])


def routes(jurisdiction: Column, providers: tuple[str, ...] = tuple(SOURCES)) -> Column:
    """The sources to ask, in order: those of the jurisdiction that there are. Where there is a cache, it alone."""
    if "cache" in providers:
        return F.array(F.lit("cache"))
    table = F.create_map(*[x for j, own in ROUTES.items() for x in (F.lit(j), F.array(*[F.lit(p) for p in own if p in providers]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(table, F.coalesce(jurisdiction, F.lit("DE"))), F.array().cast("array<string>"))
