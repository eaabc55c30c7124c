"""Metric, kappa and judge-summary queries.

Gold/prediction pairs come from the driver tables:
* escalation: ``labels`` joined to ``documents``; gold = toxic -> ESCALATE,
  prediction = the guardrail flag on the document text;
* multi-class: gold = the labelled language, prediction = the supported
  language code of the trigram scorer (so 'de' -> 'other' is an error class);
* kappa / judge: two raters derived from ``orders`` (priority digit and
  price quintile band; an odd-label variant proves index weights).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions import guardrails as G
from ticketlens.functions import language as Lf
from ticketlens.operators import metrics as M
from ticketlens.operators.judge import calibration_agreement, judge_summary, quadratic_kappa
from ticketlens.operators.language import train_and_detect
from ticketlens.plans.q_guardrails import _kw_case, _pii_case
from ticketlens.plans.q_language import SUPPORTED_SQL, detect_sql, profile_sql
from ticketlens.plans.registry import query
from ticketlens.sources.adapters import read_table


def _escalation_frame(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    g = G.check_escalation(F.col("text"))
    return labels.join(docs, "doc_id").select(
        "doc_id", "lang", "text",
        F.when(F.col("toxic") == 1, F.lit("ESCALATE")).otherwise(F.lit("AUTO_REPLY")).alias("y_true"),
        F.when(g["flag"], F.lit("ESCALATE")).otherwise(F.lit("AUTO_REPLY")).alias("y_pred"))


ESC_CTE = f"""WITH j AS (
  SELECT d.doc_id, d.lang, d.text,
         CASE WHEN l.toxic = 1 THEN 'ESCALATE' ELSE 'AUTO_REPLY' END AS y_true,
         CASE WHEN d.text IS NOT NULL AND d.text <> ''
                   AND coalesce({_pii_case('d.text')}, {_kw_case('d.text', G.SEVERE_KEYWORDS)}) IS NOT NULL
              THEN 'ESCALATE' ELSE 'AUTO_REPLY' END AS y_pred
  FROM labels l JOIN documents d USING (doc_id)
)"""

ESC_SQL = ESC_CTE + """
SELECT count(*) FILTER (WHERE y_true <> 'ESCALATE' AND y_pred <> 'ESCALATE') AS tn,
       count(*) FILTER (WHERE y_true <> 'ESCALATE' AND y_pred = 'ESCALATE') AS fp,
       count(*) FILTER (WHERE y_true = 'ESCALATE' AND y_pred <> 'ESCALATE') AS fn,
       count(*) FILTER (WHERE y_true = 'ESCALATE' AND y_pred = 'ESCALATE') AS tp,
       count(*) FILTER (WHERE y_true = 'ESCALATE') AS total_true_escalations,
       coalesce(CAST(count(*) FILTER (WHERE y_true = 'ESCALATE' AND y_pred <> 'ESCALATE') AS DOUBLE)
                / nullif(count(*) FILTER (WHERE y_true = 'ESCALATE'), 0), 0.0) AS fnr,
       avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) * 100.0 AS accuracy_pct
FROM j"""


@query("metrics_escalation", ESC_SQL, covers=["M2", "M8", "M9", "M10", "M13"])
def metrics_escalation(spark, sf_dir):
    j = M.with_gold(_escalation_frame(spark, sf_dir), "y_true", "y_pred")
    t, p = F.col("y_true") == "ESCALATE", F.col("y_pred") == "ESCALATE"
    # one aggregate pass gives the matrix and the accuracy together
    agg = j.agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
                F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"),
                M.decision_accuracy("y_true", "y_pred").alias("accuracy_pct"))
    return agg.select("tn", "fp", "fn", "tp", (F.col("fn") + F.col("tp")).alias("total_true_escalations"),
                      F.coalesce(F.try_divide(F.col("fn").cast("double"),
                                              (F.col("fn") + F.col("tp")).cast("double")),
                                 F.lit(0.0)).alias("fnr"), "accuracy_pct")


@query("metrics_escalation_matrix", ESC_SQL.replace(
    ",\n       avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) * 100.0 AS accuracy_pct", ""),
    covers=["M8", "M9", "M10"])
def metrics_escalation_matrix(spark, sf_dir):
    return M.escalation_matrix(_escalation_frame(spark, sf_dir), "y_true", "y_pred")


def _lang_frame(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    det = train_and_detect(docs, "doc_id", "text", "lang", keep=["lang"], out="detected")
    return det.select("doc_id", F.col("lang").alias("y_true"), Lf.supported_language(F.col("detected")).alias("y_pred"))


LANG_CTE = "WITH" + profile_sql() + "," + detect_sql("documents", "doc_id", "text") + f""",
pairs AS (
  SELECT docs.lang AS y_true, {SUPPORTED_SQL.format(c='d.lang')} AS y_pred
  FROM detected d JOIN documents docs ON docs.doc_id = d.id
),
conf AS (SELECT y_true, y_pred, count(*) AS n FROM pairs GROUP BY y_true, y_pred),
cells AS (
  SELECT y_true AS label, n AS support, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp,
         CASE WHEN y_true <> y_pred THEN n ELSE 0 END AS fn, 0 AS fp FROM conf
  UNION ALL
  SELECT y_pred, 0, 0, 0, CASE WHEN y_true <> y_pred THEN n ELSE 0 END FROM conf
),
per AS (
  SELECT label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(tp) AS BIGINT) AS tp,
         CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM cells GROUP BY label
),
report AS (
  SELECT label, support, tp, fp, fn,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall
  FROM per
),
report_f1 AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM report
)"""


@query("metrics_class_report", LANG_CTE + "\nSELECT label, precision, recall, support, tp, fp, fn, f1 FROM report_f1",
       covers=["M4", "M5"])
def metrics_class_report(spark, sf_dir):
    return M.class_report(_lang_frame(spark, sf_dir), "y_true", "y_pred")


@query("metrics_confusion", LANG_CTE + "\nSELECT y_true, y_pred, n FROM conf", covers=["M4"])
def metrics_confusion(spark, sf_dir):
    return M.confusion(_lang_frame(spark, sf_dir), "y_true", "y_pred")


@query("metrics_report_summary", LANG_CTE + """
SELECT coalesce(sum(tp) / nullif(sum(support), 0), 0.0) AS accuracy,
       avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
       coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0) AS weighted_precision,
       coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0) AS weighted_recall,
       coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0) AS weighted_f1,
       CAST(sum(support) AS BIGINT) AS support
FROM report_f1""", covers=["M6", "M7"])
def metrics_report_summary(spark, sf_dir):
    return M.report_summary(M.class_report(_lang_frame(spark, sf_dir), "y_true", "y_pred"))


BY_LANG_SQL = ESC_CTE + f"""
SELECT lang, count(*) AS n,
       avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) * 100.0 AS accuracy_pct,
       count(*) FILTER (WHERE y_true = 'ESCALATE' AND y_pred = 'ESCALATE') AS tp,
       count(*) FILTER (WHERE y_true = 'ESCALATE' AND y_pred <> 'ESCALATE') AS fn,
       count(*) FILTER (WHERE y_true <> 'ESCALATE' AND y_pred = 'ESCALATE') AS fp,
       count(*) FILTER (WHERE y_true <> 'ESCALATE' AND y_pred <> 'ESCALATE') AS tn,
       avg(CASE WHEN text IS NOT NULL AND text <> '' AND (
             regexp_matches(text, '\\b\\d{{3}}-\\d{{7}}-\\d{{7}}\\b')
             OR regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+')
             OR regexp_matches(text, '\\b(?:\\d[ -]?){{12,15}}\\d\\b')
             OR regexp_matches(text, '\\+?\\d[\\d\\s-]{{7,}}\\d')) THEN 0.0 ELSE 1.0 END) * 100.0 AS pii_pass_pct,
       coalesce(CAST(count(*) FILTER (WHERE y_true = 'ESCALATE' AND y_pred <> 'ESCALATE') AS DOUBLE)
                / nullif(count(*) FILTER (WHERE y_true = 'ESCALATE'), 0), 0.0) AS fnr
FROM j GROUP BY lang"""


@query("metrics_by_language", BY_LANG_SQL, covers=["M19", "M12", "M13"])
def metrics_by_language(spark, sf_dir):
    j = _escalation_frame(spark, sf_dir)
    return M.metrics_by(j, ["lang"], "y_true", "y_pred", reply_col="text")


LATENCY_SQL = """
SELECT count(*) FILTER (WHERE event_type <> 'error' OR event_type IS NULL) AS n,
       count(*) FILTER (WHERE event_type = 'error') AS failed,
       avg(value) FILTER (WHERE event_type <> 'error' OR event_type IS NULL) AS avg_latency,
       quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error' OR event_type IS NULL) AS p50_latency,
       quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error' OR event_type IS NULL) AS p95_latency,
       (max(epoch_us(ts)) FILTER (WHERE event_type <> 'error' OR event_type IS NULL)
        - min(epoch_us(ts)) FILTER (WHERE event_type <> 'error' OR event_type IS NULL)) / 1e6 AS wall_s,
       count(*) FILTER (WHERE event_type <> 'error' OR event_type IS NULL)
        / nullif((max(epoch_us(ts)) FILTER (WHERE event_type <> 'error' OR event_type IS NULL)
        - min(epoch_us(ts)) FILTER (WHERE event_type <> 'error' OR event_type IS NULL)) / 1e6, 0) AS throughput
FROM events"""


@query("metrics_latency", LATENCY_SQL, covers=["M14"])
def metrics_latency(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return M.latency_summary(ev, "value", "ts", F.col("event_type") == "error")


def _raters(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus")
    a = F.substring("o_orderpriority", 1, 1).cast("int")
    b = F.least(F.lit(5), F.lit(1) + F.floor(F.col("o_totalprice") / 100000).cast("int"))
    return o.select(a.alias("a"), b.alias("b"), "o_orderstatus", "o_totalprice")


RATERS_CTE = """WITH r AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a,
         least(5, 1 + CAST(floor(o_totalprice / 100000) AS INTEGER)) AS b,
         o_orderstatus, o_totalprice
  FROM orders
)"""


def _kappa_sql(a, b, src="r"):
    return f"""(
  WITH labels AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS idx FROM (
                    SELECT {a} AS label FROM {src} UNION SELECT {b} FROM {src}) WHERE label IS NOT NULL),
       x AS (SELECT CAST(la.idx AS DOUBLE) AS i, CAST(lb.idx AS DOUBLE) AS j FROM {src}
             JOIN labels la ON la.label = {a} JOIN labels lb ON lb.label = {b}),
       s AS (SELECT count(*) AS n, sum((i - j) * (i - j)) AS wo, sum(i * i) AS a2, sum(j * j) AS b2,
                    sum(i) AS a1, sum(j) AS b1 FROM x)
  SELECT n, CASE WHEN abs(a2 + b2 - 2 * a1 * b1 / n) > 1e-12
                 THEN 1 - wo / (a2 + b2 - 2 * a1 * b1 / n) END AS kappa FROM s)"""


ODD = "CASE WHEN {c} <= 2 THEN 1 WHEN {c} = 3 THEN 3 ELSE 5 END"

KAPPA_SQL = RATERS_CTE + f""",
r_odd AS (SELECT {ODD.format(c='a')} AS a, {ODD.format(c='b')} AS b FROM r)
SELECT 'scale_1_5' AS variant, n, kappa FROM {_kappa_sql('a', 'b')}
UNION ALL
SELECT 'labels_1_3_5', n, kappa FROM {_kappa_sql('a', 'b', 'r_odd')}
UNION ALL
SELECT 'identical', n, kappa FROM {_kappa_sql('a', 'a')}"""


def _odd(c):
    return F.when(F.col(c) <= 2, 1).when(F.col(c) == 3, 3).otherwise(5)


@query("judge_kappa", KAPPA_SQL, covers=["J6"])
def judge_kappa(spark, sf_dir):
    r = _raters(spark, sf_dir)
    k1 = quadratic_kappa(r, "a", "b").select(F.lit("scale_1_5").alias("variant"), "n", "kappa")
    odd = r.select(_odd("a").alias("a"), _odd("b").alias("b"))
    k2 = quadratic_kappa(odd, "a", "b").select(F.lit("labels_1_3_5").alias("variant"), "n", "kappa")
    same = r.select("a", F.col("a").alias("a2"))
    k3 = quadratic_kappa(same, "a", "a2").select(F.lit("identical").alias("variant"), "n", "kappa")
    return k1.unionByName(k2).unionByName(k3)


def _calibration(spark, sf_dir):
    r = _raters(spark, sf_dir)
    return r.select(
        F.col("a").alias("human_brand_voice_score"), F.col("b").alias("brand_voice_score"),
        F.col("b").alias("human_policy_adherence"), _odd("a").alias("factual_policy_adherence"),
        (F.col("o_orderstatus") == "F").alias("human_pii_safety_pass"),
        (F.col("o_totalprice") < 250000).alias("pii_safety_pass"),
        (F.col("o_orderstatus") != "P").alias("human_language_match_pass"),
        F.lit(True).alias("language_match_pass"))


AGREE_SQL = RATERS_CTE + f""",
c AS (SELECT a AS hb, b AS jb, b AS hp, {ODD.format(c='a')} AS jp,
             o_orderstatus = 'F' AS hpii, o_totalprice < 250000 AS jpii,
             o_orderstatus <> 'P' AS hlang, true AS jlang FROM r),
kb AS {_kappa_sql('hb', 'jb', 'c')},
kp AS {_kappa_sql('hp', 'jp', 'c')},
acc AS (SELECT avg(CASE WHEN hpii = jpii THEN 1.0 ELSE 0.0 END) AS pii_accuracy,
               avg(CASE WHEN hlang = jlang THEN 1.0 ELSE 0.0 END) AS lang_accuracy FROM c),
s AS (SELECT kb.n, kb.kappa AS brand_voice_kappa, kp.kappa AS policy_kappa, acc.pii_accuracy,
             acc.lang_accuracy FROM kb, kp, acc)
SELECT *, (coalesce(brand_voice_kappa, 0.0) + coalesce(policy_kappa, 0.0))
          / nullif(CAST(brand_voice_kappa IS NOT NULL AS INTEGER) + CAST(policy_kappa IS NOT NULL AS INTEGER), 0) AS avg_kappa,
       (pii_accuracy + lang_accuracy) / 2 AS avg_accuracy,
       CASE WHEN avg_kappa >= 0.8 THEN 'strong' WHEN avg_kappa >= 0.6 THEN 'moderate'
            WHEN avg_kappa IS NOT NULL THEN 'weak' END AS strength
FROM s"""


@query("judge_agreement", AGREE_SQL, covers=["J6", "J7", "J8"])
def judge_agreement(spark, sf_dir):
    return calibration_agreement(_calibration(spark, sf_dir))


JUDGE_SUMMARY_SQL = RATERS_CTE + """,
v AS (SELECT o_orderstatus <> 'P' AS ok, a, b, o_orderstatus = 'F' AS pii, a <> 5 AS lang FROM r)
SELECT count(*) AS evaluated, count(*) FILTER (WHERE NOT ok) AS failures,
       round_even(avg(a) FILTER (WHERE ok), 3) AS avg_brand_voice_score,
       round_even(avg(b) FILTER (WHERE ok), 3) AS avg_factual_policy_adherence,
       round_even(avg(CAST(pii AS DOUBLE)) FILTER (WHERE ok), 3) AS pii_safety_pass_rate,
       round_even(avg(CAST(lang AS DOUBLE)) FILTER (WHERE ok), 3) AS language_match_pass_rate
FROM v"""


@query("judge_summary", JUDGE_SUMMARY_SQL, covers=["M16", "J2", "J5"])
def judge_summary_q(spark, sf_dir):
    r = _raters(spark, sf_dir)
    verdict = F.when(F.col("o_orderstatus") != "P", F.struct(
        F.col("a").alias("brand_voice_score"), F.col("b").alias("factual_policy_adherence"),
        (F.col("o_orderstatus") == "F").alias("pii_safety_pass"),
        (F.col("a") != 5).alias("language_match_pass")))
    return judge_summary(r.select(verdict.alias("verdict")))
