"""The acts, codes and words that citations are made of, and small tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: EU acts: CELEX number, code, all names that stand for it, official title ---
EU_ACTS = [
    ("32016R0679", "DSGVO", ["DSGVO", "GDPR", "RGPD", "RODO"], "Regulation (EU) 2016/679"),
    ("32024R1689", "AIACT", ["AIACT", "AI_ACT", "AIA", "AI-ACT", "AI ACT", "EU AI ACT", "Artificial Intelligence Act", "AI-GESETZ", "KI-VO", "AI-VO"], "Regulation (EU) 2024/1689"),
    ("32023R2854", "DATA_ACT", ["DATA_ACT", "DATA ACT"], "Regulation (EU) 2023/2854"),
    ("32022L2555", "NIS2", ["NIS2", "NIS-2", "NIS 2"], "Directive (EU) 2022/2555"),
    ("32022R2065", "DSA", ["DSA", "DIGITAL SERVICES ACT"], "Regulation (EU) 2022/2065"),
    ("32022R1925", "DMA", ["DMA", "DIGITAL MARKETS ACT"], "Regulation (EU) 2022/1925"),
    ("32022R2554", "DORA", ["DORA"], "Regulation (EU) 2022/2554"),
    ("32024R2847", "CRA", ["CRA", "CYBER RESILIENCE ACT"], "Regulation (EU) 2024/2847"),
    ("32022R0868", "DGA", ["DGA", "DATA GOVERNANCE ACT"], "Regulation (EU) 2022/868"),
    ("32022L2557", "CER", ["CER", "CER DIRECTIVE", "CRITICAL ENTITIES RESILIENCE DIRECTIVE"], "Directive (EU) 2022/2557"),
    ("32024R1183", "EIDAS2", ["EIDAS2", "EIDAS 2", "EIDAS-2", "EUROPEAN DIGITAL IDENTITY FRAMEWORK"], "Regulation (EU) 2024/1183"),
    ("32023R1114", "MICA", ["MICA", "MI-CA", "MARKETS IN CRYPTO-ASSETS"], "Regulation (EU) 2023/1114"),
    ("32023R1113", "TFR", ["TFR", "TRANSFER OF FUNDS REGULATION"], "Regulation (EU) 2023/1113"),
    ("32019L1024", "OPEN_DATA", ["OPEN_DATA", "OPEN DATA", "OPEN DATA DIRECTIVE"], "Directive (EU) 2019/1024"),
    ("32019L0790", "DSM_COPYRIGHT", ["DSM_COPYRIGHT", "DSM COPYRIGHT", "DSM COPYRIGHT DIRECTIVE"], "Directive (EU) 2019/790"),
    ("32019L0770", "DCD", ["DCD", "DIGITAL CONTENT DIRECTIVE"], "Directive (EU) 2019/770"),
    ("32019L0771", "SGD", ["SGD", "SALE OF GOODS DIRECTIVE"], "Directive (EU) 2019/771"),
    ("32019L2161", "OMNIBUS", ["OMNIBUS", "OMNIBUS DIRECTIVE"], "Directive (EU) 2019/2161"),
    ("32018R1807", "FFNPD", ["FFNPD", "FREE FLOW OF NON-PERSONAL DATA"], "Regulation (EU) 2018/1807"),
    ("32021R0784", "TCO", ["TCO", "TERRORIST CONTENT ONLINE", "TERRORIST CONTENT ONLINE REGULATION"], "Regulation (EU) 2021/784"),
    ("32023R1543", "E_EVIDENCE_REG", ["E_EVIDENCE_REG", "E-EVIDENCE REGULATION", "E EVIDENCE REGULATION"], "Regulation (EU) 2023/1543"),
    ("32023L1544", "E_EVIDENCE_DIR", ["E_EVIDENCE_DIR", "E-EVIDENCE DIRECTIVE", "E EVIDENCE DIRECTIVE"], "Directive (EU) 2023/1544"),
    ("32020R1503", "ECSP", ["ECSP", "CROWDFUNDING REGULATION", "EUROPEAN CROWDFUNDING SERVICE PROVIDERS"], "Regulation (EU) 2020/1503"),
    ("32023R0988", "GPSR", ["GPSR", "GENERAL PRODUCT SAFETY REGULATION"], "Regulation (EU) 2023/988"),
]

# --- fixed values: language, article markers, names of regulation, directive and decision, organisation code ---
CITATION_WORDS = [
    ("bg", ["член", "чл"], "Регламент", "Директива", "Решение", "ЕС"),
    ("es", ["artículo", "art"], "Reglamento", "Directiva", "Decisión", "UE"),
    ("cs", ["článek", "čl"], "Nařízení", "Směrnice", "Rozhodnutí", "EU"),
    ("da", ["artikel", "art"], "Forordning", "Direktiv", "Afgørelse", "EU"),
    ("de", ["artikel", "art"], "Verordnung", "Richtlinie", "Beschluss", "EU"),
    ("et", ["artikkel", "art"], "Määrus", "Direktiiv", "Otsus", "EL"),
    ("el", ["άρθρο", "άρθ"], "Κανονισμός", "Οδηγία", "Απόφαση", "ΕΕ"),
    ("en", ["article", "art"], "Regulation", "Directive", "Decision", "EU"),
    ("fr", ["article", "art"], "Règlement", "Directive", "Décision", "UE"),
    ("ga", ["airteagal", "alt"], "Rialachán", "Treoir", "Cinneadh", "AE"),
    ("hr", ["članak", "čl"], "Uredba", "Direktiva", "Odluka", "EU"),
    ("it", ["articolo", "art"], "Regolamento", "Direttiva", "Decisione", "UE"),
    ("lv", ["pants", "p"], "Regula", "Direktīva", "Lēmums", "ES"),
    ("lt", ["straipsnis", "str"], "Reglamentas", "Direktyva", "Sprendimas", "ES"),
    ("hu", ["cikk", "c"], "Rendelet", "Irányelv", "Határozat", "EU"),
    ("mt", ["artikolu", "art"], "Regolament", "Direttiva", "Deċiżjoni", "UE"),
    ("nl", ["artikel", "art"], "Verordening", "Richtlijn", "Besluit", "EU"),
    ("pl", ["artykuł", "art"], "Rozporządzenie", "Dyrektywa", "Decyzja", "UE"),
    ("pt", ["artigo", "art"], "Regulamento", "Diretiva", "Decisão", "UE"),
    ("ro", ["articol", "art"], "Regulament", "Directiva", "Decizie", "UE"),
    ("sk", ["článok", "čl"], "Nariadenie", "Smernica", "Rozhodnutie", "EÚ"),
    ("sl", ["člen", "čl"], "Uredba", "Direktiva", "Odločitev", "EU"),
    ("fi", ["artikla", "art"], "Asetus", "Direktiivi", "Päätös", "EU"),
    ("sv", ["artikel", "art"], "Förordning", "Direktiv", "Beslut", "EU"),
]

# --- fixed values: EU languages by their two and three letters and own name ---
EU_LANGUAGES = [
    ("bg", "bul", "Български"), ("es", "spa", "Español"), ("cs", "ces", "Čeština"), ("da", "dan", "Dansk"),
    ("de", "deu", "Deutsch"), ("et", "est", "Eesti"), ("el", "ell", "Ελληνικά"), ("en", "eng", "English"),
    ("fr", "fra", "Français"), ("ga", "gle", "Gaeilge"), ("hr", "hrv", "Hrvatski"), ("it", "ita", "Italiano"),
    ("lv", "lav", "Latviešu"), ("lt", "lit", "Lietuvių"), ("hu", "hun", "Magyar"), ("mt", "mlt", "Malti"),
    ("nl", "nld", "Nederlands"), ("pl", "pol", "Polski"), ("pt", "por", "Português"), ("ro", "ron", "Română"),
    ("sk", "slk", "Slovenčina"), ("sl", "slv", "Slovenščina"), ("fi", "fin", "Suomi"), ("sv", "swe", "Svenska"),
]

# --- fixed values: Swiss codes that citations may name; the parts of the German social code; sources by jurisdiction ---
SWISS_CODES = "BV ZGB OR STGB ZPO STPO SCHKG VWVG BGG DSG IPRG DBG STHG AHVG IVG ATSG ARG SVG AIG KG URG PATG MSCHG".split()
SOCIAL_CODE_PARTS = "I II III IV V VI VII VIII IX X XI XII XIV".split()


def eu_acts(spark: SparkSession) -> DataFrame:
    """celex, document_type, law_code, aliases, title; checked for unique numbers, codes and aliases."""
    names = [a.upper() for _, _, aliases, _ in EU_ACTS for a in aliases]
    if len({c for c, *_ in EU_ACTS}) != len(EU_ACTS) or len({k for _, k, *_ in EU_ACTS}) != len(EU_ACTS) or len(set(names)) != len(names):
        raise ValueError("acts, codes and aliases have to be unique")
    return spark.createDataFrame([(c, c[5], k, a, t) for c, k, a, t in EU_ACTS], "celex string, document_type string, law_code string, aliases array<string>, title string")


def eu_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EU_LANGUAGES, "code string, eli_code string, name string")
