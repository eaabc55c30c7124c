"""The evaluation scorecard in one pass over the predictions.

The counts behind every figure are observed while the predictions are written
(``DataFrame.observe``), so the table is scanned once, and not at all if it is being made anyway. The
record is put together from these counts: class figures from the confusion counts of the
known labels, which are as many as the square of the labels.

The observing node stands in the stage that writes, whose tasks count once each, however often one is
started again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.guardrails import pii_leak
from ticketlens.functions.labels import ESCALATE
from ticketlens.functions.model_output import INTENTS
from ticketlens.operators.metrics import confusion, report_from_counts, summary_columns

_L, _D, _S = T.LongType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CLASS = _struct(label=_S, precision=_D, recall=_D, f1=_D, support=_L, tp=_L, fp=_L, fn=_L)
INTENT = _struct(accuracy=_D, macro_precision=_D, macro_recall=_D, macro_f1=_D, weighted_f1=_D, support=_L, per_class=T.ArrayType(CLASS))
ESCALATION = _struct(fnr=_D, false_negatives=_L, true_positives=_L, false_positives=_L, true_negatives=_L,
                     confusion_matrix=T.ArrayType(T.ArrayType(_L)))
JUDGE = _struct(evaluated=_L, failures=_L, avg_brand_voice_score=_D, avg_factual_policy_adherence=_D, pii_safety_pass_rate=_D,
                language_match_pass_rate=_D)
# T12
SCORECARD = _struct(
    num_samples=_L, dataset=_S, gold_labels_available=_struct(intent=_L, decision=_L),
    core_metrics=_struct(intent_metrics=INTENT, escalation_fnr=ESCALATION, pii_leakage_count=_L, pii_leakage_rate=_D, num_drafts=_L, num_errors=_L),
    judge_metrics=JUDGE, timestamp=_S)


def counts_of(labels: list[str]) -> list[Column]:
    """The counts of predictions (T9: ``gold_intent, gold_decision, pred, error``) that the scorecard is made of."""
    has = F.col("pred").isNotNull()
    judged = has & F.col("gold_decision").isNotNull()
    gold, said = F.col("gold_decision") == ESCALATE, F.coalesce(F.col("pred.decision") == ESCALATE, F.lit(False))
    t, p = F.col("gold_intent"), F.col("pred.intent")
    known = has & t.isin(*labels) & p.isin(*labels)
    cells = [F.count_if(known & (t == a) & (p == b)).alias(f"c{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    return [
        F.count(F.lit(1)).alias("rows"), F.count("gold_intent").alias("intents"), F.count("gold_decision").alias("decisions"),
        F.count_if(judged & gold & said).alias("tp"), F.count_if(judged & gold & ~said).alias("fn"),
        F.count_if(judged & ~gold & said).alias("fp"), F.count_if(judged & ~gold & ~said).alias("tn"),
        F.count_if(has & t.isNotNull() & ~F.coalesce(t.isin(*labels) & p.isin(*labels), F.lit(False))).alias("unlisted"),
        F.count_if(has).alias("drafts"), F.count_if(has & pii_leak(F.col("pred.draft_reply"))).alias("leaks"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"), *cells]


def write_with_scorecard(predictions: DataFrame, path: str, dataset: str, timestamp: str, labels: list[str] = INTENTS,
                         judge: DataFrame | None = None) -> DataFrame:
    """Writes ``predictions`` to ``path`` (Parquet) and gives their scorecard, one nested row.

    Null gold labels are left out of the metrics that need them, rows without a prediction out of all but the counts of
    samples and errors. Without any gold label a metric is null. If a label is not among ``labels``, the confusion
    counts are taken from the written table instead. ``judge`` is the one row of ``judge_summary``."""
    spark, seen = predictions.sparkSession, Observation()
    predictions.observe(seen, *counts_of(labels)).write.mode("overwrite").parquet(path)
    n = seen.get
    if n["unlisted"]:
        cells = confusion(spark.read.schema(predictions.schema).parquet(path).where("pred IS NOT NULL AND gold_intent IS NOT NULL"),
                          "gold_intent", "pred.intent")
    else:
        cells = spark.createDataFrame([(a, b, n[f"c{i}_{j}"]) for i, a in enumerate(labels) for j, b in enumerate(labels) if n[f"c{i}_{j}"]],
                                      "y_true string, y_pred string, n long")
    classes = report_from_counts(cells).agg(*summary_columns(), F.array_sort(F.collect_list(F.struct(*CLASS.fieldNames()))).alias("per_class"))
    intent = classes.select(*INTENT.fieldNames()).first()  # a row per label at most
    judged, positive = n["tp"] + n["fn"] + n["fp"] + n["tn"], n["tp"] + n["fn"]
    escalation = (n["fn"] / positive if positive else 0.0, n["fn"], n["tp"], n["fp"], n["tn"], [[n["tn"], n["fp"]], [n["fn"], n["tp"]]])
    core = (intent if intent["per_class"] else None, escalation if judged else None, n["leaks"],
            round(n["leaks"] / max(n["drafts"], 1), 4), n["drafts"], n["errors"])
    verdicts = judge.select(*[F.col(f.name).cast(f.dataType) for f in JUDGE.fields]).first() if judge is not None else None
    return spark.createDataFrame([(n["rows"], dataset, (n["intents"], n["decisions"]), core, verdicts, timestamp)], SCORECARD)


def read_scorecard(spark: SparkSession, path: str) -> DataFrame:
    """What ``sources.io.write_scorecard`` wrote."""
    return spark.read.schema(SCORECARD).option("mode", "FAILFAST").json(path)
