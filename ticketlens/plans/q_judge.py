"""Judge run over whole calibration data.

Calibration rows (T11) are the conversations' (user turn, agent reply) pairs;
the human labels are derived from the texts so the oracle can recompute them.
The judge is a deterministic stand-in called through ``generate`` exactly like
a real client: it scores from the length of the prompt it is shown, answers
in prose (no JSON) for every 7th length and with an out-of-range score for
every 11th, so failed judgments reach validation (J3), are counted (J2, M16)
and dropped before agreement (J5).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ticketlens.functions.model_output import parse_verdict
from ticketlens.operators.decisions import generate
from ticketlens.operators.judge import (JUDGE_USER_TEMPLATE, _one_row, calibration_agreement, check_required, drop_failed,
                                        judge_messages, judge_summary)
from ticketlens.operators.metrics import align
from ticketlens.plans.q_extras import _turn_pairs
from ticketlens.plans.q_metrics import _kappa_sql
from ticketlens.plans.registry import query, template_sql

JUDGE_SYSTEM = ("You grade a support reply for tone and policy. Return one JSON object with "
                "brand_voice_score, brand_voice_justification, factual_policy_adherence, "
                "pii_safety_pass and language_match_pass.")


def length_judge(messages: list) -> str:
    """Deterministic judge stand-in (see module doc)."""
    u = messages[-1]["content"] if messages else ""
    n = len(u)
    if n % 7 == 0:
        return "I am unable to grade this reply."
    return json.dumps({
        "brand_voice_score": 1 + n % 5,
        "brand_voice_justification": f"length {n}",
        "factual_policy_adherence": 6 if n % 11 == 0 else 1 + (n // 5) % 5,
        "pii_safety_pass": "@" not in u,
        "language_match_pass": n % 2 == 0,
    })


def _calibration_rows(spark, sf_dir):
    p = _turn_pairs(spark, sf_dir)
    ref, hyp = F.coalesce(F.col("ref"), F.lit("")), F.coalesce(F.col("hyp"), F.lit(""))
    return p.select("pair_id", F.col("hyp").alias("inquiry"), F.col("ref").alias("response"),
                    (1 + F.length(ref) % 5).alias("human_brand_voice_score"),
                    (1 + F.length(hyp) % 5).alias("human_policy_adherence"),
                    (~ref.contains("@")).alias("human_pii_safety_pass"),
                    F.lit(True).alias("human_language_match_pass"))


OUT = ["evaluated", "failures", "avg_brand_voice_score", "avg_factual_policy_adherence",
       "pii_safety_pass_rate", "language_match_pass_rate", "n", "brand_voice_kappa",
       "policy_kappa", "pii_accuracy", "lang_accuracy"]


def _judge_sql():
    u = template_sql(JUDGE_USER_TEMPLATE, inquiry="coalesce(hyp, '')", reply="coalesce(ref, '')")
    return f"""
WITH p AS (
  SELECT a.conv_id * 1000 + a.turn AS pair_id, b.text AS hyp, a.text AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
  WHERE a.role = 'assistant' AND a.turn > 0
),
c AS (
  SELECT pair_id, 1 + length(coalesce(ref, '')) % 5 AS hb, 1 + length(coalesce(hyp, '')) % 5 AS hp,
         strpos(coalesce(ref, ''), '@') = 0 AS hpii, true AS hlang,
         length({u}) AS n, strpos({u}, '@') = 0 AS jpii
  FROM p
),
v AS (SELECT *, (n % 7 <> 0 AND n % 11 <> 0) AS ok, 1 + n % 5 AS jb, 1 + (n // 5) % 5 AS jp,
             n % 2 = 0 AS jlang FROM c),
okv AS (SELECT * FROM v WHERE ok),
kb AS {_kappa_sql('hb', 'jb', 'okv')},
kp AS {_kappa_sql('hp', 'jp', 'okv')},
acc AS (SELECT avg(CASE WHEN hpii = jpii THEN 1.0 ELSE 0.0 END) AS pii_accuracy,
               avg(CASE WHEN hlang = jlang THEN 1.0 ELSE 0.0 END) AS lang_accuracy FROM okv),
summ AS (
  SELECT count(*) AS evaluated, count(*) FILTER (WHERE NOT ok) AS failures,
         round_even(avg(jb) FILTER (WHERE ok), 3) AS avg_brand_voice_score,
         round_even(avg(jp) FILTER (WHERE ok), 3) AS avg_factual_policy_adherence,
         round_even(avg(CAST(jpii AS DOUBLE)) FILTER (WHERE ok), 3) AS pii_safety_pass_rate,
         round_even(avg(CAST(jlang AS DOUBLE)) FILTER (WHERE ok), 3) AS language_match_pass_rate
  FROM v
)
SELECT summ.*, kb.n, kb.kappa AS brand_voice_kappa, kp.kappa AS policy_kappa,
       acc.pii_accuracy, acc.lang_accuracy
FROM summ, kb, kp, acc"""


@query("judge_calibration_run", _judge_sql(),
       covers=["J1", "J2", "J3", "J4", "J5", "J6", "J7", "J8", "M1", "M16", "M18"])
def judge_calibration_run(spark, sf_dir):
    cal = check_required(_calibration_rows(spark, sf_dir))                       # J4
    msgs = judge_messages(cal.select("pair_id", "inquiry", "response"), "inquiry", "response",
                          JUDGE_SYSTEM)                                           # J1
    raw = generate(msgs.select("pair_id", "messages"), length_judge)             # J2
    verdicts = raw.select("pair_id", parse_verdict(F.col("raw"))["value"].alias("verdict"))  # J3
    summary = judge_summary(align(verdicts, cal.select("pair_id"), "pair_id"))   # M1, M18, M16
    judged = drop_failed(cal, verdicts, "pair_id").select(                       # J5
        "*", *[F.col(f"verdict.{c}").alias(c) for c in
               ("brand_voice_score", "factual_policy_adherence", "pii_safety_pass", "language_match_pass")])
    agree = calibration_agreement(judged)                                        # J6-J8
    return _one_row([summary, agree]).select(*OUT)
