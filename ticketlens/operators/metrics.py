"""Evaluation metrics as aggregates.

Classification metrics start from the confusion counts (M4): one
``groupBy(true, pred)`` with map-side partial aggregation, after which every
per-class figure is computed on at most |labels|^2 rows. Nothing is collected
to the driver; one-row summaries are DataFrames the caller can write or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.guardrails import pii_leak
from ticketlens.functions.labels import AUTO_REPLY, ESCALATE, binarise_decision
from ticketlens.operators.quantiles import exact_quantiles


def _div0(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 (the reference's zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def align(pred: DataFrame, gold: DataFrame, key: str = "test_id") -> DataFrame:
    """M1 + M18: predictions joined to gold on ``key``; unequal row
    counts and keys without a partner raise.

    The reference zips two lists positionally; with a key the join is exact
    and independent of partition order.
    """
    n_pred, n_gold = pred.count(), gold.count()
    if n_pred != n_gold:
        raise ValueError(f"predictions ({n_pred}) and gold ({n_gold}) must have equal length")
    if not (pred.select(key).join(gold.select(key), key, "left_anti").isEmpty()
            and gold.select(key).join(pred.select(key), key, "left_anti").isEmpty()):
        raise ValueError(f"predictions and gold must have the same values of {key}")
    return pred.join(gold, key, "inner")


def with_gold(df: DataFrame, gold_col: str, pred_col: str) -> DataFrame:
    """M2: keep rows that have a prediction and a string gold label."""
    return df.filter(F.col(pred_col).isNotNull() & F.col(gold_col).isNotNull())


def confusion(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """M4: (y_true, y_pred, n)."""
    return df.groupBy(F.col(true_col).alias("y_true"), F.col(pred_col).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """M5: per-label precision, recall, F1 and support over the union of labels.

    0/0 -> 0.
    """
    return report_from_counts(confusion(df, true_col, pred_col))


def report_from_counts(c: DataFrame) -> DataFrame:
    """M5 from confusion counts (y_true, y_pred, n): each cell adds n
    to support(t), and to tp(t) when t == p, else to fn(t) and fp(p)."""
    cells = c.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fn"),
                 F.lit(0).cast("long").alias("fp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"),
                 F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fp")),
    )).alias("x")).select("x.*")
    per = cells.groupBy("label").agg(*[F.sum(k).cast("long").alias(k)
                                       for k in ("support", "tp", "fn", "fp")])
    p = _div0(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div0(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.select("label", p.alias("precision"), r.alias("recall"), "support", "tp", "fp", "fn") \
        .withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"),
                                F.col("precision") + F.col("recall")))


def macro_avg(report: DataFrame) -> DataFrame:
    """M6: unweighted mean over the labels of the report."""
    return report.agg(F.avg("precision").alias("macro_precision"),
                      F.avg("recall").alias("macro_recall"),
                      F.avg("f1").alias("macro_f1"),
                      F.count(F.lit(1)).alias("n_labels"))


def report_summary(report: DataFrame) -> DataFrame:
    """M6 + M7: macro and support-weighted averages and accuracy from a class report."""
    return report.agg(*summary_columns())


def summary_columns() -> list[Column]:
    """The aggregates of ``report_summary``."""
    s = F.sum("support")
    return [
        _div0(F.sum("tp"), s).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _div0(F.sum(F.col("precision") * F.col("support")), s).alias("weighted_precision"),
        _div0(F.sum(F.col("recall") * F.col("support")), s).alias("weighted_recall"),
        _div0(F.sum(F.col("f1") * F.col("support")), s).alias("weighted_f1"),
        s.cast("long").alias("support")]


def escalation_matrix(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Binarised 2x2 counts (labels AUTO_REPLY, ESCALATE), total true escalations, FNR."""
    t, p = binarise_decision(F.col(true_col)), binarise_decision(F.col(pred_col))
    pos_t, pos_p = t == ESCALATE, p == ESCALATE
    m = df.agg(F.count_if(~pos_t & ~pos_p).alias("tn"), F.count_if(~pos_t & pos_p).alias("fp"),
               F.count_if(pos_t & ~pos_p).alias("fn"), F.count_if(pos_t & pos_p).alias("tp"))
    return m.select("tn", "fp", "fn", "tp", (F.col("fn") + F.col("tp")).alias("total_true_escalations"),
                    _div0(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))


def leak_summary(pred: DataFrame, reply_col: str = "pred.draft_reply",
                 pred_col: str = "pred", error_col: str = "error") -> DataFrame:
    """Leaking drafts, leak rate (4 dp, half-even), drafts and errors."""
    has_pred = F.col(pred_col).isNotNull()
    leaks = F.count_if(has_pred & pii_leak(F.col(reply_col)))
    drafts = F.count_if(has_pred)
    return pred.agg(leaks.alias("pii_leakage_count"), drafts.alias("num_drafts"),
                    F.count_if(F.coalesce(F.col(error_col), F.lit("")) != "").alias("num_errors")) \
        .withColumn("pii_leakage_rate",
                    F.bround(F.col("pii_leakage_count") / F.greatest(F.col("num_drafts"), F.lit(1)), 4))


def pii_pass_rate(df: DataFrame, reply_col: str) -> Column:
    """M12 (aggregate expression): percent of replies without PII; empty reply counts as clean."""
    return F.avg(F.when(pii_leak(F.col(reply_col)), 0.0).otherwise(1.0)) * 100.0


def decision_accuracy(true_col: str, pred_col: str) -> Column:
    """M13 (aggregate expression): percent of equal labels."""
    return F.avg(F.when(F.col(true_col) == F.col(pred_col), 1.0).otherwise(0.0)) * 100.0


def latency_summary(df: DataFrame, latency_col: str, ts_col: str, failed: Column) -> DataFrame:
    """Mean / p50 / p95 latency, wall time and throughput over successful rows.

    Failed rows are excluded from every denominator. Percentiles are exact
    (rank selection by histogram refinement: counters of a fixed number, no map of values).
    """
    ok = ~F.coalesce(failed, F.lit(False))
    lat = F.when(ok, F.col(latency_col))
    p50, p95 = exact_quantiles(df, lat, [0.5, 0.95])
    ts = F.when(ok, F.unix_micros(F.col(ts_col).cast("timestamp")))
    wall = (F.max(ts) - F.min(ts)) / 1e6
    return df.agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("failed"),
                  F.avg(lat).alias("avg_latency"),
                  F.lit(p50).cast("double").alias("p50_latency"),
                  F.lit(p95).cast("double").alias("p95_latency"),
                  wall.alias("wall_s")) \
        .withColumn("throughput", F.try_divide(F.col("n").cast("double"), F.col("wall_s")))


def metrics_by(df: DataFrame, keys: list[str], true_col: str, pred_col: str,
               reply_col: str | None = None) -> DataFrame:
    """Decision metrics per slice (e.g. language)."""
    t, p = binarise_decision(F.col(true_col)), binarise_decision(F.col(pred_col))
    pos_t, pos_p = t == ESCALATE, p == ESCALATE
    aggs = [F.count(F.lit(1)).alias("n"),
            decision_accuracy(true_col, pred_col).alias("accuracy_pct"),
            F.count_if(pos_t & pos_p).alias("tp"), F.count_if(pos_t & ~pos_p).alias("fn"),
            F.count_if(~pos_t & pos_p).alias("fp"), F.count_if(~pos_t & ~pos_p).alias("tn")]
    if reply_col:
        aggs.append(pii_pass_rate(df, reply_col).alias("pii_pass_pct"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn("fnr", _div0(F.col("fn"), F.col("fn") + F.col("tp")))


__all__ = ["align", "with_gold", "confusion", "class_report", "macro_avg", "report_summary",
           "escalation_matrix", "leak_summary", "pii_pass_rate", "decision_accuracy",
           "latency_summary", "metrics_by", "AUTO_REPLY", "ESCALATE"]
