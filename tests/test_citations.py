import pytest
from pyspark.sql import functions as F

from lexquarry.functions import catalogs, citations

CASES = [
    # input, jurisdiction, (law code, section, reference type, jurisdiction, subsection, celex)
    ("BGB § 433", "DE", ("BGB", "433", None, None, None, None)),
    ("  §433\t bgb ", "DE", ("BGB", "433", None, None, None, None)),
    ("§ 433 BGB", "DE", ("BGB", "433", None, None, None, None)),
    ("Art 1 GG", "DE", ("GG", "1", "article", None, None, None)),
    ("Art. 14 § 2 EGBGB", "DE", ("EGBGB", "14", "article", None, "2", None)),
    ("EGBGB 14", "DE", None),
    ("SGB iv 7", "DE", ("SGB IV", "7", "section", None, None, None)),
    ("SGB XIII 7", "DE", None),
    ("Art 6", "DE", ("ART", "6", None, None, None, None)),
    ("AT ABGB 879", "DE", ("ABGB", "879", None, "AT", None, None)),
    ("ABGB 879", "AT", ("ABGB", "879", None, "AT", None, None)),
    ("Art. 8 EMRK", "AT", ("EMRK", "8", "article", "AT", None, None)),
    ("Art 28 ZGB", "CH", ("ZGB", "28", "article", "CH", None, None)),
    ("Art 28 XYZ", "CH", None),
    ("Art. 6 GDPR", "EU", ("DSGVO", "6", "article", "EU", None, "32016R0679")),
    ("GDPR Artikel 6a", "EU", ("DSGVO", "6a", "article", "EU", None, "32016R0679")),
    ("Art. 6 GDPR", "DE", None),
    ("CELEX: 32016r0679 Art 6", "EU", ("DSGVO", "6", "article", "EU", None, "32016R0679")),
    ("32031R0000 Art 2", "EU", None),
    ("31951R0001 Art 2", "EU", None),
    ("Regulation 2016/679/EU Article 6", "EU", ("DSGVO", "6", "article", "EU", None, "32016R0679")),
    ("Article 6 Verordnung (EU) 2016/679", "EU", None),
    ("Art. 14 BIS BOE-A-1978-31229", "ES", ("BOE-A-1978-31229", "14 bis", "article", "ES", None, None)),
    ("39/1889 § 4", "FI", ("39/1889", "4", "section", "FI", None, None)),
    ("BWBR0001854 Artikel 3:84", "NL", ("BWBR0001854", "3:84", "article", "NL", None, None)),
    ("normattiva:1990-08-07:090G0294 Art. 3", "IT", ("normattiva:1990-08-07:090G0294", "3", "article", "IT", None, None)),
    ("normattiva:1990-02-30:090G0294 Art. 3", "IT", None),
    ("normattiva:1990-08-07:090G0294 Art. 0", "IT", None),
    ("", "DE", None),
    (None, "EU", None),
    ("x" * 20000, "DE", None),
]


def parsed(spark, rows):
    df = spark.createDataFrame([(i, t, j) for i, (t, j) in enumerate(rows)], "i int, t string, j string")
    got = citations.parse_citations(df, "t", F.col("j"), "r").collect()
    return {r.i: r.r and (r.r.law_code, r.r.section, r.r.reference_type, r.r.jurisdiction, r.r.subsection, r.r.eu_celex) for r in got}


def test_citations(spark):
    got = parsed(spark, [(t, j) for t, j, _ in CASES])
    assert [got[i] for i in range(len(CASES))] == [e for *_, e in CASES]


def test_one_expression_is_the_same(spark):
    df = spark.createDataFrame([(t, j) for t, j, _ in CASES[:12]], "t string, j string")
    steps = citations.parse_citations(df, "t", F.col("j"), "r")
    assert steps.withColumn("e", citations.parse_citation(F.col("t"), F.col("j"))).where("not (r <=> e)").count() == 0


def test_citations_of_all_languages(spark):
    rows = [(f"{marks[0]} 6 {act} ({org}) 2016/679", "EU") for _, marks, act, _, _, org in catalogs.CITATION_WORDS]
    rows += [(f"{act} ({org}) 2022/2555 {marks[-1]}. 3", "EU") for _, marks, _, act, _, org in catalogs.CITATION_WORDS]
    got = parsed(spark, rows)
    assert [got[i] for i in range(24)] == [("DSGVO", "6", "article", "EU", None, "32016R0679")] * 24
    assert [got[i] for i in range(24, 48)] == [("NIS2", "3", "article", "EU", None, "32022L2555")] * 24


@pytest.mark.parametrize(("number", "padded"), [("1", "0001"), ("679", "0679"), ("12345", "12345"), ("123456", "123456"), ("1234567", None), ("0", None), ("x", None), (None, None)])
def test_padding(spark, number, padded):
    assert spark.createDataFrame([(number,)], "n string").select(citations.padded_number(F.col("n"))).first()[0] == padded


def test_tables(spark):
    acts = catalogs.eu_acts(spark)
    assert acts.count() == 24
    assert acts.selectExpr("sum(size(aliases))").first()[0] == 68
    assert catalogs.eu_languages(spark).count() == 24
