"""Sampling and gold-label queries over whole ``documents``.

documents(doc_id, text, lang) plays the pairs table: customer_text = text,
customer_lang = lang, the row id = doc_id. To texts of some ids an order id or a word of an intent's
lexicon is added, so that every bucket has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions import labels as Lb
from ticketlens.functions.guardrails import SEVERE_KEYWORDS
from ticketlens.operators import gold as Gd
from ticketlens.operators import sampling as Sm
from ticketlens.plans.q_guardrails import RE_CARD, RE_EMAIL, RE_ORDER, RE_PHONE
from ticketlens.plans.registry import query
from ticketlens.sources.adapters import read_table
from ticketlens.sources.io import first_rows

MULTI = ["ja", "es", "fr", "pt", "hi"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(col, words):
    return "(" + " OR ".join(f"strpos(lower({col}), {q(w)}) > 0" for w in words) + ")"


def bucket_sql(col):
    parts = [f"WHEN regexp_matches({col}, '{RE_ORDER}') THEN 'pii_leak'"]
    parts += [f"WHEN {_any_sql(col, words)} THEN {q(name)}" for name, words in Lb.INTENT_BUCKETS]
    return "CASE " + " ".join(parts) + " ELSE 'general_inquiry' END"


def md5key(col):
    return f"md5(CAST({col} AS VARCHAR) || ':42')"


# by doc_id % 12: an order id, then the first and the last word of every bucket's lexicon
TAILS = ["Order 123-4567890-1234567", *[w for _, words in Lb.INTENT_BUCKETS for w in (words[0], words[-1])]]
DOCS_CTE = f"""docs AS (SELECT doc_id, lang, text || coalesce(' ' || list_extract([{", ".join(map(q, TAILS))}], CAST(doc_id % 12 + 1 AS INTEGER)), '')
                  AS text FROM documents)"""


def _docs(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % 12).cast("int"))
    text = F.concat("text", F.coalesce(F.concat(F.lit(" "), tail), F.lit("")))
    return read_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang")


# --------------------------------------------------------------------------- golden set
def _quota_values():
    quotas = {f"en:{k}": v for k, v in Gd.ENGLISH_QUOTAS.items()}
    quotas.update(Gd.NON_ENGLISH_QUOTAS)
    return ", ".join(f"({q(k)}, {v}, {i})" for i, (k, v) in enumerate(quotas.items()))


GOLDEN_CTE = f"""WITH {DOCS_CTE},
b AS (SELECT doc_id, text, lang, {bucket_sql('text')} AS bucket FROM docs),
src AS (
  SELECT doc_id, text AS input_tweet, lang AS expected_language,
         CASE WHEN lang = 'en' THEN 'en:' || bucket ELSE lang END AS stratum,
         CASE WHEN lang = 'en' THEN bucket ELSE lang END AS source_intent
  FROM b
),
quotas AS (SELECT * FROM (VALUES {_quota_values()}) t(stratum, quota, ord)),
ranked AS (
  SELECT s.*, qt.quota, qt.ord,
         row_number() OVER (PARTITION BY s.stratum ORDER BY {md5key('s.doc_id')}, s.doc_id) AS rk
  FROM src s JOIN quotas qt USING (stratum)
),
golden AS (
  SELECT row_number() OVER (ORDER BY ord, rk) AS test_id, doc_id, input_tweet, expected_language,
         source_intent
  FROM ranked WHERE rk <= quota
)"""


@query("sample_golden_set", GOLDEN_CTE + "\nSELECT test_id, doc_id, expected_language, source_intent FROM golden",
       covers=["A1", "A2", "A10"])
def sample_golden_set(spark, sf_dir):
    g = Gd.build_golden_set(_docs(spark, sf_dir), "text", "lang", "doc_id")
    return g.select("test_id", "doc_id", "expected_language", "source_intent")


@query("sample_composition", GOLDEN_CTE + """
SELECT expected_language, source_intent, count(*) AS n FROM golden
GROUP BY ROLLUP (expected_language, source_intent)""", covers=["A15"])
def sample_composition(spark, sf_dir):
    g = Gd.build_golden_set(_docs(spark, sf_dir), "text", "lang", "doc_id")
    return Sm.composition(g, ["expected_language", "source_intent"])


@query("sample_shortfall", GOLDEN_CTE + """
SELECT qt.stratum, qt.quota, coalesce(c.available, 0) AS available,
       least(CAST(qt.quota AS BIGINT), coalesce(c.available, 0)) AS taken,
       qt.quota - least(CAST(qt.quota AS BIGINT), coalesce(c.available, 0)) AS short
FROM quotas qt LEFT JOIN (SELECT stratum, count(*) AS available FROM src GROUP BY stratum) c USING (stratum)""",
       covers=["A13"])
def sample_shortfall(spark, sf_dir):
    d = _docs(spark, sf_dir)
    b = Lb.classify_intent(F.col("text"))
    strat = d.select(F.when(F.col("lang") == "en", F.concat(F.lit("en:"), b))
                     .otherwise(F.col("lang")).alias("stratum"))
    quotas = {f"en:{k}": v for k, v in Gd.ENGLISH_QUOTAS.items()}
    quotas.update(Gd.NON_ENGLISH_QUOTAS)
    return Sm.quota_shortfall(strat, "stratum", quotas).select(
        "stratum", F.col("quota").cast("int").alias("quota"), "available", "taken",
        F.col("short").cast("long").alias("short"))


# --------------------------------------------------------------------------- smart KB sample
DEDUP_CTE = DOCS_CTE + """,
d AS (
  SELECT doc_id, text, lang FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM docs) WHERE rn = 1
)"""

SMART_SQL = f"""WITH {DEDUP_CTE},
multi AS (
  SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS len_bucket FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {md5key('doc_id')}, doc_id) AS rk
    FROM d WHERE lang IN ('ja', 'es', 'fr', 'pt', 'hi')) WHERE rk <= 300
),
en AS (SELECT doc_id, lang, length(text) AS l FROM d WHERE lang = 'en'),
edges AS (SELECT round(quantile_cont(l, 1.0 / 3), 6) AS q1, round(quantile_cont(l, 2.0 / 3), 6) AS q2 FROM en),
enb AS (SELECT en.*, CASE WHEN l <= q1 THEN 'short' WHEN l <= q2 THEN 'medium' ELSE 'detailed' END AS b
        FROM en, edges),
ens AS (
  SELECT doc_id, lang, b AS len_bucket FROM (
    SELECT *, row_number() OVER (PARTITION BY b ORDER BY {md5key('doc_id')}, doc_id) AS rk FROM enb)
  WHERE rk <= (5000 - (SELECT count(*) FROM multi)) // 3
)
SELECT * FROM multi UNION ALL SELECT * FROM ens"""


@query("sample_smart_kb", SMART_SQL, covers=["K11", "A3", "A4", "A5", "A6", "A7"])
def sample_smart_kb(spark, sf_dir):
    s = Sm.smart_kb_sample(_docs(spark, sf_dir), "text", "lang", "doc_id", [F.col("doc_id")])
    return s.select("doc_id", "lang", "len_bucket")


# --------------------------------------------------------------------------- fixed 350 + 150 gold set
def _pii_sql(col):
    return (f"(regexp_matches({col}, '{RE_ORDER}') OR regexp_matches({col}, '{RE_EMAIL}') "
            f"OR regexp_matches({col}, '{RE_CARD}') OR regexp_matches({col}, '{RE_PHONE}'))")


FIXED_CTE = f"""WITH {DEDUP_CTE},
pools AS (
  SELECT *, 'en' AS pool FROM d WHERE lang = 'en'
  UNION ALL
  SELECT *, 'multi' FROM d WHERE lang IN ('ja', 'es', 'fr', 'pt', 'hi')
),
picked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {md5key('doc_id')}, doc_id) AS rk FROM pools)
  WHERE rk <= CASE pool WHEN 'en' THEN 350 ELSE 150 END
),
flags AS (
  SELECT *, {_pii_sql('text')} AS pii, {_any_sql('text', [k for k, _ in SEVERE_KEYWORDS])} AS severe
  FROM picked
),
fixed AS (
  SELECT row_number() OVER (ORDER BY {md5key('doc_id')}, doc_id) AS test_id, doc_id,
         text AS input_tweet, lang AS expected_language, source_intent, gold_intent,
         CASE WHEN pii OR severe OR risky THEN 'ESCALATE' ELSE 'AUTO_REPLY' END AS gold_decision,
         CASE WHEN pii OR severe OR risky THEN 'PII_OR_SEVERE_SECURITY' ELSE 'NONE' END AS gold_reason,
         CASE WHEN pii THEN 'PII_PRESENT' WHEN severe THEN 'SEVERE_KEYWORD_TRIGGER' WHEN risky THEN 'HIGH_RISK_INTENT'
              ELSE 'NONE' END AS gold_reason_fine
  FROM (SELECT *, gold_intent IN ({", ".join(map(q, Lb.HIGH_RISK_INTENTS))}) AS risky FROM (
    SELECT *, coalesce(CASE {" ".join(f"WHEN source_intent = {q(k)} THEN {q(v)}" for k, v in Lb.INTENT_MAP.items())} END,
                       'general_inquiry') AS gold_intent
    FROM (SELECT *, CASE WHEN doc_id % 9 = 4 THEN 'account_access_security' ELSE {bucket_sql('text')} END AS source_intent FROM flags)))
)"""


def _fixed_gold(spark, sf_dir):
    d = Sm.dedup_first(_docs(spark, sf_dir), ["text"], [F.col("doc_id")])
    s = Sm.fixed_sample(d, [("en", F.col("lang") == "en", 350),
                            ("multi", F.col("lang").isin(*MULTI), 150)], "doc_id")
    s = Sm.assert_size(s, 350 + 150)  # A14: the fixed set must be complete
    s = Sm.shuffle_number(s, "doc_id").select(
        F.col("test_id").cast("long"), "doc_id", F.col("text").alias("input_tweet"),
        F.col("lang").alias("expected_language"),
        # an intent that no bucket gives, as an annotator may type it in
        F.when(F.col("doc_id") % 9 == 4, "account_access_security").otherwise(Lb.classify_intent("text")).alias("source_intent"))
    g = Gd.derive_gold_labels(s, coarse=True)
    return g.withColumn("gold_reason_fine", Lb.gold_reason(F.col("input_tweet"), F.col("gold_intent")))


@query("sample_fixed_gold", FIXED_CTE + """
SELECT test_id, doc_id, expected_language, source_intent, gold_intent, gold_decision, gold_reason,
       gold_reason_fine FROM fixed""", covers=["A8", "A9", "A3", "A14", "H1", "H2", "H3", "H4"])
def sample_fixed_gold(spark, sf_dir):
    return _fixed_gold(spark, sf_dir).select(
        "test_id", "doc_id", "expected_language", "source_intent", "gold_intent", "gold_decision",
        "gold_reason", "gold_reason_fine")


@query("gold_label_counts", FIXED_CTE + """
SELECT 'gold_decision' AS field, gold_decision AS label, count(*) AS n FROM fixed GROUP BY gold_decision
UNION ALL
SELECT 'gold_reason_fine', gold_reason_fine, count(*) FROM fixed GROUP BY gold_reason_fine
UNION ALL
SELECT 'available_intent', NULL, count(gold_intent) FROM fixed
UNION ALL
SELECT 'available_decision', NULL, count(gold_decision) FROM fixed""", covers=["H5", "M15"])
def gold_label_counts(spark, sf_dir):
    g = _fixed_gold(spark, sf_dir)
    a = Gd.label_counts(g, "gold_decision").select(F.lit("gold_decision").alias("field"), "label", "n")
    b = Gd.label_counts(g, "gold_reason_fine").select(F.lit("gold_reason_fine").alias("field"), "label", "n")
    av = Gd.gold_availability(g)
    c = av.select(F.lit("available_intent").alias("field"), F.lit(None).cast("string").alias("label"),
                  F.col("intent").alias("n"))
    d = av.select(F.lit("available_decision").alias("field"), F.lit(None).cast("string").alias("label"),
                  F.col("decision").alias("n"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@query("sample_balanced", FIXED_CTE + f"""
SELECT test_id, gold_decision FROM (
  SELECT *, row_number() OVER (PARTITION BY gold_decision ORDER BY {md5key('test_id')}, test_id) AS rk
  FROM fixed WHERE gold_decision IS NOT NULL) WHERE rk <= 10""", covers=["A11"])
def sample_balanced(spark, sf_dir):
    return Sm.balanced_sample(_fixed_gold(spark, sf_dir), "gold_decision", 20, "test_id").select(
        "test_id", "gold_decision")


@query("sample_subset", f"""
SELECT doc_id, lang FROM documents ORDER BY {md5key('doc_id')}, doc_id LIMIT 50""", covers=["A12"])
def sample_subset(spark, sf_dir):
    return Sm.subset(_docs(spark, sf_dir), 50, "doc_id").select("doc_id", "lang")


@query("sample_first_rows", """
SELECT doc_id, lang, length(text) AS chars FROM documents ORDER BY doc_id LIMIT 50""", covers=["S2"])
def sample_first_rows(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    return first_rows(d, 50, ["doc_id"])


PARSE_SQL = r"""
SELECT conv_id, turn, CAST(len(items) AS INTEGER) AS n_items, items[1] AS first_item,
       items[len(items)] AS last_item
FROM (
  SELECT conv_id, turn,
         list_filter(list_transform(string_split(coalesce(text, ''), ','),
                                    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
                     lambda x: x <> '') AS items
  FROM conversations)"""


@query("gold_parse_lists", PARSE_SQL, covers=["H7"])
def gold_parse_lists(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    items = Lb.parse_list(F.col("text"))
    return c.select("conv_id", "turn", F.size(items).alias("n_items"),
                    F.element_at(items, 1).alias("first_item"),
                    F.element_at(items, -1).alias("last_item"))
