"""Guardrail queries over whole documents.

Each document is scanned twice: as written, and with an order reference
appended (``' Order ggg-nnnnnnn-iiiiiii'`` built from doc_id and n_chars), so
the order-id rule and the PII priority order are exercised on every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions import guardrails as G
from ticketlens.operators.guardrail_ops import guardrail_profile, pii_hits, with_guardrails
from ticketlens.plans.registry import query
from ticketlens.sources.adapters import read_table

# A caller lexicon made of words that occur in the synthetic documents.
PRESENT_WORDS_LEXICON = [
    ("license", "License text found"),
    ("token", "Credential-like token"),
    ("free", "Promotional language"),
]


def _with_variants(docs):
    idp = F.lpad(F.col("doc_id").cast("string"), 10, "0")
    ref = F.concat(F.col("text"), F.lit(" Order "), F.substring(idp, 8, 3), F.lit("-"),
                   F.lpad(F.col("n_chars").cast("string"), 7, "0"), F.lit("-"),
                   F.substring(idp, 4, 7))
    return docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit("raw").alias("variant"), F.col("text").alias("t")),
        F.struct(F.lit("ref").alias("variant"), ref.alias("t")))).alias("v")).select(
        "doc_id", "v.variant", "v.t")


VARIANTS_SQL = r"""
variants AS (
  SELECT doc_id, 'raw' AS variant, text AS t FROM documents
  UNION ALL
  SELECT doc_id, 'ref', text || ' Order ' || substr(lpad(CAST(doc_id AS VARCHAR), 10, '0'), 8, 3)
         || '-' || lpad(CAST(n_chars AS VARCHAR), 7, '0')
         || '-' || substr(lpad(CAST(doc_id AS VARCHAR), 10, '0'), 4, 7)
  FROM documents
)"""

# RE2 forms of the four patterns (equal to the Java ones of functions/guardrails.py on this data).
RE_ORDER = r"\b\d{3}-\d{7}-\d{7}\b"
RE_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
RE_CARD = r"\b(?:\d[ -]?){12,15}\d\b"
RE_PHONE = r"\+?\d[\d\s-]{7,}\d"


def _kw_case(col, lexicon, value="reason"):
    whens = " ".join(
        f"WHEN strpos(lower({col}), '{kw}') > 0 THEN '{(reason if value == 'reason' else kw)}'"
        for kw, reason in lexicon)
    return f"CASE {whens} END"


def _pii_case(col):
    return ("CASE " + " ".join(
        f"WHEN regexp_matches({col}, '{p}') THEN '{r}'"
        for p, (_, _, r) in zip([RE_ORDER, RE_EMAIL, RE_CARD, RE_PHONE], G.PII_RULES)) + " END")


def _legal_sql(col):
    return "(" + " OR ".join(f"strpos(lower({col}), '{k}') > 0" for k in G.LEGAL_KEYWORDS) + ")"


SCAN_SQL = "WITH" + VARIANTS_SQL + f""",
s AS (
  SELECT doc_id, variant, t,
         coalesce(regexp_matches(t, '{RE_ORDER}'), false) AS has_order_id,
         coalesce(regexp_matches(t, '{RE_EMAIL}'), false) AS has_email,
         coalesce(regexp_matches(t, '{RE_CARD}'), false) AS has_card,
         coalesce(regexp_matches(t, '{RE_PHONE}'), false) AS has_phone,
         {_pii_case('t')} AS pii_reason,
         {_kw_case('t', G.SEVERE_KEYWORDS)} AS keyword_reason,
         {_kw_case('t', G.SEVERE_KEYWORDS, 'kw')} AS keyword
  FROM variants
)
SELECT doc_id, variant, has_order_id, has_email, has_card, has_phone, pii_reason,
       keyword_reason IS NOT NULL AS severe_keyword, keyword, keyword_reason,
       (t IS NOT NULL AND t <> '' AND coalesce(pii_reason, keyword_reason) IS NOT NULL) AS flag,
       CASE WHEN t IS NULL OR t = '' THEN '' ELSE coalesce(pii_reason, keyword_reason, '') END AS reason,
       coalesce({_legal_sql('t')}, false) AS is_legal,
       CASE WHEN coalesce({_legal_sql('t')}, false) THEN 'legal_regulatory_churn'
            ELSE 'account_access_security' END AS escalation_intent,
       CASE WHEN t IS NULL OR t = '' THEN false
            ELSE has_order_id OR has_email OR has_card OR has_phone END AS pii_leak
FROM s
"""


@query("guardrail_scan", SCAN_SQL,
       covers=["G1", "G2", "G3", "G4", "G5", "G6", "G7", "G8", "G9", "G10", "G11"])
def guardrail_scan(spark, sf_dir):
    v = _with_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    v, low, fl = with_guardrails(v, "t")
    t = F.col("t")
    kw = fl["kw"]
    g = G.check_escalation(t, low=low, flags=fl, hits=kw)
    return v.select(
        "doc_id", "variant",
        fl["order_id"].alias("has_order_id"), fl["email"].alias("has_email"),
        fl["card"].alias("has_card"), fl["phone"].alias("has_phone"),
        G.pii_reason(t, flags=fl).alias("pii_reason"), G.severe_keyword(t, low=low, hits=kw).alias("severe_keyword"),
        G.matched_keyword(t, low=low, hits=kw).alias("keyword"),
        G.keyword_reason(t, low=low, hits=kw).alias("keyword_reason"),
        g["flag"].alias("flag"), g["reason"].alias("reason"),
        G.is_legal(t, low=low, hits=kw).alias("is_legal"),
        G.escalation_intent(t, low=low, hits=kw).alias("escalation_intent"),
        G.pii_leak(t, flags=fl).alias("pii_leak"))


def _hits_sql():
    """The ends of matches are running sums over the text's pieces, in which every second one is a match."""
    parts = []
    for kind, pat in [("order_id", RE_ORDER), ("email", RE_EMAIL), ("card", RE_CARD),
                      ("phone", RE_PHONE)]:
        parts.append(f"""SELECT doc_id, variant, '{kind}' AS kind, generate_subscripts(m, 1) AS ordinal, unnest(m) AS match,
       unnest(list_transform(string_split_regex(t, '{pat}')[:len(m)], lambda p: length(p))) AS gap
FROM (SELECT *, regexp_extract_all(t, '{pat}') AS m FROM variants)""")
    return "WITH" + VARIANTS_SQL + ",\nhits AS (" + "\nUNION ALL\n".join(parts) + """),
ends AS (SELECT *, sum(gap + length(match)) OVER (PARTITION BY doc_id, variant, kind ORDER BY ordinal) AS e FROM hits)
SELECT doc_id, kind, CAST(ordinal AS INTEGER) AS ordinal, CAST(e - length(match) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", match
FROM ends"""


@query("guardrail_hits", _hits_sql(), covers=["G12"])
def guardrail_hits(spark, sf_dir):
    v = _with_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return pii_hits(v, "doc_id", "t")


def _profile_sql():
    def one(name, lexicon):
        return f"""SELECT '{name}' AS lexicon, flag, reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT (text IS NOT NULL AND text <> '' AND coalesce({_pii_case('text')}, {_kw_case('text', lexicon)}) IS NOT NULL) AS flag,
         CASE WHEN text IS NULL OR text = '' THEN ''
              ELSE coalesce({_pii_case('text')}, {_kw_case('text', lexicon)}, '') END AS reason
  FROM documents) GROUP BY flag, reason"""
    return one("default", G.SEVERE_KEYWORDS) + "\nUNION ALL\n" + one("present_words",
                                                                     PRESENT_WORDS_LEXICON)


@query("guardrail_profile", _profile_sql(), covers=["G13", "G7"])
def guardrail_profile_q(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("text")
    a = guardrail_profile(docs, "text").select(F.lit("default").alias("lexicon"), "*")
    b = guardrail_profile(docs, "text", PRESENT_WORDS_LEXICON).select(
        F.lit("present_words").alias("lexicon"), "*")
    return a.unionByName(b)
