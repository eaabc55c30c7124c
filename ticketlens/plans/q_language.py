"""Language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions import language as Lf
from ticketlens.operators.language import detect_language, train_and_detect, train_language_profiles
from ticketlens.operators.pairs import build_pairs, language_distribution
from ticketlens.plans.registry import query
from ticketlens.sources.adapters import BRAND, read_table, tweets_from_conversations


def profile_sql(train_table: str = "documents") -> str:
    """DuckDB CTEs: ``profile(lang, gram, hit_logp, base_logp)`` trained on ``train_table``."""
    return rf"""
train_norm AS (
  SELECT lang, ' ' || regexp_replace(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'),
                                     '^ +| +$', '', 'g') || ' ' AS t
  FROM {train_table} WHERE lang IS NOT NULL
),
train_grams AS (
  SELECT lang, unnest(list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i + 1] || ch[i + 2])) AS gram
  FROM (SELECT lang, string_split(t, '') AS ch FROM train_norm)
),
counts AS (SELECT lang, gram, count(*) AS c FROM train_grams GROUP BY lang, gram),
vocab AS (SELECT count(DISTINCT gram) AS v FROM counts),
bases AS (SELECT lang, -ln(sum(c) + (SELECT v FROM vocab)) AS base_logp FROM counts GROUP BY lang),
profile AS (
  SELECT c.lang, c.gram, ln(c.c + 1) AS hit_logp, b.base_logp FROM counts c JOIN bases b USING (lang)
)"""


def detect_sql(source: str, id_col: str, text_col: str) -> str:
    """DuckDB CTEs ending in ``detected(id, lang)`` for texts of ``source``."""
    return rf"""
q_norm AS (
  SELECT {id_col} AS id, {text_col} AS raw,
         ' ' || regexp_replace(regexp_replace(lower(coalesce({text_col}, '')), '\s+', ' ', 'g'),
                               '^ +| +$', '', 'g') || ' ' AS t
  FROM {source}
),
q_grams AS (
  SELECT id, gram, count(*) AS k FROM (
    SELECT id, unnest(list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i + 1] || ch[i + 2])) AS gram
    FROM (SELECT id, string_split(t, '') AS ch FROM q_norm)) GROUP BY id, gram
),
q_matched AS (
  SELECT g.id, p.lang, sum(g.k * p.hit_logp) AS m
  FROM q_grams g JOIN profile p USING (gram) GROUP BY g.id, p.lang
),
q_scored AS (
  SELECT m.id, m.lang, m.m + greatest(length(n.t) - 2, 0) * b.base_logp AS score
  FROM q_matched m JOIN q_norm n USING (id) JOIN (SELECT DISTINCT lang, base_logp FROM profile) b USING (lang)
),
q_best AS (
  SELECT id, lang FROM (
    SELECT id, lang, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, lang) AS r
    FROM q_scored) WHERE r = 1
),
detected AS (
  SELECT n.id, coalesce(CASE WHEN regexp_matches(n.raw, '[\p{{Hiragana}}\p{{Katakana}}]') THEN 'ja'
                             WHEN regexp_matches(n.raw, '\p{{Devanagari}}') THEN 'hi' END,
                        b.lang, 'unknown') AS lang
  FROM q_norm n LEFT JOIN q_best b USING (id)
)"""


SUPPORTED_SQL = ("CASE WHEN split_part(coalesce({c}, ''), '-', 1) IN ('en','ja','pt','es','fr','hi') "
                 "THEN split_part(coalesce({c}, ''), '-', 1) ELSE 'other' END")


def _names_case(c):
    return "coalesce(CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'"
                                       for k, v in Lf.LANGUAGE_NAMES.items()) + f" END, {c})"


def _sig_case(c):
    first = {k: v[0] for k, v in Lf.SIGNATURES.items()}
    return "coalesce(CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in first.items()) + " END, '')"


def _pick_sig_case(lang, key):
    src = f"(CASE WHEN {lang} = 'other' THEN 'en' ELSE {lang} END)"
    arr = "CASE " + " ".join(
        f"WHEN {src} = '{k}' THEN [{', '.join(repr(s) for s in v)}]" for k, v in Lf.SIGNATURES.items()
    ) + f" ELSE [{', '.join(repr(s) for s in Lf.SIGNATURES['en'])}] END"
    idx = f"CAST(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 8))::UBIGINT AS BIGINT)"
    return f"({arr})[({idx} % len({arr})) + 1]"


DETECT_DOCS_SQL = "WITH" + profile_sql() + "," + detect_sql("documents", "doc_id", "text") + f"""
SELECT d.id AS doc_id, d.lang AS detected, docs.lang AS labelled,
       {SUPPORTED_SQL.format(c='d.lang')} AS supported,
       {_names_case(SUPPORTED_SQL.format(c='d.lang'))} AS language_name,
       {_sig_case(SUPPORTED_SQL.format(c='d.lang'))} AS signature,
       {_pick_sig_case(SUPPORTED_SQL.format(c='d.lang'), 'd.id')} AS picked_signature
FROM detected d JOIN documents docs ON docs.doc_id = d.id
"""


@query("language_detect", DETECT_DOCS_SQL, covers=["L1", "L2", "L3", "L4", "L5", "L7"])
def language_detect(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    det = train_and_detect(docs, "doc_id", "text", "lang", keep=["lang"], out="detected")
    sup = Lf.supported_language(F.col("detected"))
    return det.withColumnRenamed("lang", "labelled").select(
        "doc_id", "detected", "labelled", sup.alias("supported"),
        Lf.language_name(sup).alias("language_name"), Lf.signature_for(sup).alias("signature"),
        Lf.pick_signature(sup, F.col("doc_id")).alias("picked_signature"))


def _pairs_lang_sql():
    from ticketlens.plans.q_pairs import TWEETS_SQL
    pairs = TWEETS_SQL + r""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY reply_to
            ORDER BY ts NULLS LAST, agent_tweet_id, customer_id, customer_text) AS rn
  FROM flagged WHERE NOT signoff
),
pairs AS (
  SELECT customer_text, reply_to AS tweet_id FROM ranked
  WHERE rn = 1 AND length(regexp_replace(customer_text, '^\s+|\s+$', '', 'g')) > 0
    AND length(agent_text) > 0
)"""
    return ("WITH" + pairs + "," + profile_sql() + "," + detect_sql("pairs", "tweet_id", "customer_text")
            + """,
dist AS (SELECT lang, count(*) AS n FROM detected GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM dist""")


@query("pairs_language_distribution", _pairs_lang_sql(), covers=["P11", "P12", "L3"])
def pairs_language_distribution(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    prof = train_language_profiles(docs, "text", "lang")
    tweets = tweets_from_conversations(read_table(spark, sf_dir, "conversations"))
    pairs = build_pairs(tweets, BRAND)
    det = detect_language(pairs, "tweet_id", "customer_text", prof)
    return language_distribution(det, "lang")


def _canned_sql():
    cases = " ".join(f"WHEN l = '{k}' THEN '{v}'" for k, v in Lf.CANNED_REPLIES.items())
    return f"""SELECT lang AS code, {SUPPORTED_SQL.format(c='lang')} AS supported,
       coalesce(CASE {cases.replace("l = ", SUPPORTED_SQL.format(c='lang') + " = ")} END,
                '{Lf.CANNED_REPLIES['en']}') AS canned, CAST(count(*) AS BIGINT) AS n
FROM documents GROUP BY lang"""


@query("language_canned_reply", _canned_sql(), covers=["L6", "L2"])
def language_canned_reply(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    sup = Lf.supported_language(F.col("code"))
    return docs.groupBy(F.col("lang").alias("code")).agg(F.count(F.lit(1)).alias("n")).select(
        "code", sup.alias("supported"), Lf.canned_reply(sup).alias("canned"), "n")
