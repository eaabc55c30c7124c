"""Evaluation-assembly queries.

Predictions for the scorecard come from ``labels`` joined to ``documents``:
gold decision = toxic -> ESCALATE, predicted decision = guardrail flag, draft
reply = the document text (so the leak check scans whole texts). Nulls, errors and a third label are put in by rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ticketlens.functions import labels as Lb
from ticketlens.operators import metrics as M
from ticketlens.operators.judge import JUDGE_USER_TEMPLATE, judge_messages
from ticketlens.operators.scorecard import JUDGE, read_scorecard, write_with_scorecard
from ticketlens.plans.q_metrics import ESC_CTE, _escalation_frame
from ticketlens.plans.q_sampling import RE_CARD, RE_EMAIL, RE_ORDER, RE_PHONE
from ticketlens.plans.registry import query, template_sql
from ticketlens.session import checkpoint_dir
from ticketlens.sources import io
from ticketlens.sources.adapters import read_table

LEAK_SQL_EXPR = (f"(text IS NOT NULL AND text <> '' AND (regexp_matches(text, '{RE_ORDER}') "
                 f"OR regexp_matches(text, '{RE_EMAIL}') OR regexp_matches(text, '{RE_CARD}') "
                 f"OR regexp_matches(text, '{RE_PHONE}')))")


def _predictions(spark, sf_dir):
    """Predictions (T9) over ``labels`` and their documents. Gold intents follow the language (none for Spanish), a third
    gold decision counts as AUTO_REPLY, predicted intents follow the length; every eleventh document has an error instead of a
    prediction and every seventh no gold decision."""
    j = _escalation_frame(spark, sf_dir)
    i, lang, n = F.col("doc_id"), F.col("lang"), F.length(F.coalesce("text", F.lit("")))
    failed = i % 11 == 0
    intent = F.element_at(F.array(*map(F.lit, SAID)), (n % len(SAID) + 1).cast("int"))
    return j.select(
        F.col("doc_id").alias("test_id"), F.when(lang == "en", "order_status").when(lang == "fr", "refund_related")
        .when(lang == "de", "general_inquiry").alias("gold_intent"),
        F.when(i % 7 != 0, F.when(i % 13 == 0, "REVIEW").otherwise(F.col("y_true"))).alias("gold_decision"),
        F.when(~failed, F.struct(intent.alias("intent"), F.col("y_pred").alias("decision"), F.col("text").alias("draft_reply"))).alias("pred"),
        F.when(failed, F.concat(F.lit("timeout "), i.cast("string"))).alias("error"))


SAID = ["order_status", "refund_related", "general_inquiry", "payments_billing"]
PRED_CTE = ESC_CTE + f""",
p AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'order_status' WHEN 'fr' THEN 'refund_related' WHEN 'de' THEN 'general_inquiry' END AS gi,
         CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 13 = 0 THEN 'AUTO_REPLY' ELSE y_true END END AS gd,
         doc_id % 11 <> 0 AS has, [{", ".join(repr(x) for x in SAID)}][length(coalesce(text, '')) % {len(SAID)} + 1] AS pi, y_pred AS pd,
         {LEAK_SQL_EXPR} AS leak
  FROM j
)"""

LEAKS_SQL = """count(*) FILTER (WHERE has AND leak) AS pii_leakage_count, count(*) FILTER (WHERE has) AS num_drafts,
       count(*) FILTER (WHERE NOT has) AS num_errors,
       round_even(count(*) FILTER (WHERE has AND leak) / greatest(count(*) FILTER (WHERE has), 1), 4) AS pii_leakage_rate"""


@query("eval_leak_summary", PRED_CTE + f" SELECT {LEAKS_SQL} FROM p", covers=["M11", "G11"])
def eval_leak_summary(spark, sf_dir):
    return M.leak_summary(_predictions(spark, sf_dir))


SCORECARD_SQL = PRED_CTE + f""",
x AS (SELECT gi AS t, pi AS p, count(*) AS n FROM p WHERE has AND gi IS NOT NULL GROUP BY ALL),
k AS (SELECT l AS label, coalesce(sum(n) FILTER (WHERE t = l), 0) AS support, coalesce(sum(n) FILTER (WHERE t = l AND p = l), 0) AS tp,
             coalesce(sum(n) FILTER (WHERE p = l AND t <> l), 0) AS fp, coalesce(sum(n) FILTER (WHERE t = l AND p <> l), 0) AS fn
      FROM (SELECT t AS l FROM x UNION SELECT p FROM x), x GROUP BY l),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM k),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM r),
i AS (SELECT CAST(sum(tp) / sum(support) AS DOUBLE) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
             string_agg(label || ' ' || support || ' ' || tp || ' ' || fp || ' ' || fn, ', ' ORDER BY label) AS classes FROM f),
e AS (
  SELECT count(*) FILTER (WHERE gd <> 'ESCALATE' AND pd <> 'ESCALATE') AS tn, count(*) FILTER (WHERE gd <> 'ESCALATE' AND pd = 'ESCALATE') AS fp,
         count(*) FILTER (WHERE gd = 'ESCALATE' AND pd <> 'ESCALATE') AS fn, count(*) FILTER (WHERE gd = 'ESCALATE' AND pd = 'ESCALATE') AS tp
  FROM p WHERE has AND gd IS NOT NULL
),
c AS (SELECT count(*) AS num_samples, count(gi) AS gold_intents, count(gd) AS gold_decisions, {LEAKS_SQL} FROM p)
SELECT c.*, 'labels' AS dataset, '2024-01-01 00:00:00' AS timestamp, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(weighted_f1, 6) AS weighted_f1, classes, CAST(e.fn / greatest(e.fn + e.tp, 1) AS DOUBLE) AS fnr,
       e.tn || ' ' || e.fp || ' ' || e.fn || ' ' || e.tp AS matrix, c.num_drafts AS judged, c.num_errors AS judge_failures
FROM c, i, e"""


@query("eval_scorecard", SCORECARD_SQL, covers=["M17", "M2", "M8", "M15", "M9", "M10", "M11", "S11"])
def eval_scorecard(spark, sf_dir):
    """The nested record, written as JSON and read back."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/scorecard-{uuid.uuid4().hex}"
    p = _predictions(spark, sf_dir)
    judge = p.agg(F.count("pred").alias("evaluated"), F.count("error").alias("failures"), *[
        F.lit(None).cast("double").alias(c) for c in JUDGE.fieldNames()[2:]])
    io.write_scorecard(write_with_scorecard(p, base + "-predictions", "labels", "2024-01-01 00:00:00", judge=judge), base)
    c, intent, esc = F.col("core_metrics"), F.col("core_metrics.intent_metrics"), F.col("core_metrics.escalation_fnr")
    return read_scorecard(spark, base).select(
        "num_samples", F.col("gold_labels_available.intent").alias("gold_intents"), F.col("gold_labels_available.decision").alias("gold_decisions"),
        *[c[x].alias(x) for x in ("pii_leakage_count", "num_drafts", "num_errors", "pii_leakage_rate")], "dataset", "timestamp",
        *[F.round(intent[x], 6).alias(x) for x in ("accuracy", "macro_f1", "weighted_f1")],
        F.array_join(F.transform(intent["per_class"], lambda x: F.concat_ws(" ", x["label"], x["support"], x["tp"], x["fp"], x["fn"])), ", ")
        .alias("classes"), esc["fnr"].alias("fnr"), F.array_join(F.flatten(esc["confusion_matrix"]).cast("array<string>"), " ").alias("matrix"),
        F.col("judge_metrics.evaluated").alias("judged"), F.col("judge_metrics.failures").alias("judge_failures"))


FALLBACK_SQL = r"""
WITH c AS (
  SELECT CASE role WHEN 'user' THEN '' WHEN 'assistant' THEN 'order_status' END AS gold_intent,
         role AS source_intent,
         CASE WHEN length(text) > 200 THEN 'ESCALATE' ELSE '' END AS gold_decision,
         CASE role WHEN 'user' THEN ' Yes' WHEN 'assistant' THEN 'no ' ELSE 'maybe' END AS cell
  FROM conversations
)
SELECT coalesce(nullif(gold_intent, ''), nullif(source_intent, ''), 'general_inquiry') AS intent,
       coalesce(nullif(gold_decision, ''), 'AUTO_REPLY') AS decision,
       CASE lower(regexp_replace(cell, '^\s+|\s+$', '', 'g'))
            WHEN 'true' THEN true WHEN '1' THEN true WHEN 'yes' THEN true
            WHEN 'false' THEN false WHEN '0' THEN false WHEN 'no' THEN false END AS flag,
       count(*) AS n
FROM c GROUP BY ALL"""


@query("eval_gold_fallback", FALLBACK_SQL, covers=["M3", "H8"])
def eval_gold_fallback(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    role = F.col("role")
    gi = F.when(role == "user", "").when(role == "assistant", "order_status")
    gd = F.when(F.length("text") > 200, "ESCALATE").otherwise("")
    cell = F.when(role == "user", " Yes").when(role == "assistant", "no ").otherwise("maybe")
    intent, decision = Lb.gold_with_fallback(gi, role, gd)
    return c.select(intent.alias("intent"), decision.alias("decision"), Lb.parse_bool(cell).alias("flag")) \
        .groupBy("intent", "decision", "flag").agg(F.count(F.lit(1)).alias("n"))


JUDGE_SYSTEM = "You grade support replies for tone, policy safety, privacy and language. Answer in JSON."

JUDGE_SQL = r"""
SELECT a.conv_id * 1000 + a.turn AS pair_id,
       md5(""" + template_sql(JUDGE_USER_TEMPLATE, inquiry="coalesce(b.text, '')", reply="coalesce(a.text, '')") + r""") AS user_md5,
       2 AS n_messages
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
WHERE a.role = 'assistant' AND a.turn > 0"""


@query("judge_prompts", JUDGE_SQL, covers=["J1"])
def judge_prompts(spark, sf_dir):
    from ticketlens.plans.q_extras import _turn_pairs
    p = judge_messages(_turn_pairs(spark, sf_dir), "hyp", "ref", JUDGE_SYSTEM)
    return p.select("pair_id", F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
                    F.size("messages").alias("n_messages"))
