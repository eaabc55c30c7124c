"""The KB table under repeated and partial batches; the scorecard against the single metrics; snapshots of streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import decisions as D
from ticketlens.operators.kb_table import ensure_kb_table, merge_kb, read_kb
from ticketlens.operators.metrics import class_report, escalation_matrix, report_summary
from ticketlens.operators.scorecard import read_scorecard, write_with_scorecard
from ticketlens.sources import io
from ticketlens.streaming import triage_stream as S


def pairs(spark, rows):
    return spark.createDataFrame([(i, t, f"reply {t}", f"u{i}") for i, t in rows], "tweet_id long, customer_text string, agent_text string, customer_id string")


def content(spark, path):
    return {(r.id, r.document, r.metadata.agent_text) for r in read_kb(spark, path).collect()}


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_kb_batches(spark, tmp_out):
    path = os.path.join(tmp_out, "kb")
    assert content(spark, path) == set()
    first = pairs(spark, [(i, f"text {i}") for i in range(200)])
    assert ensure_kb_table(spark, path, first, buckets=16) == {"added": 200, "replaced": 0, "rewritten": 16}
    assert ensure_kb_table(spark, path, pairs(spark, [(999, "late")]), buckets=16)["added"] == 0
    before, at = content(spark, path), files(path)
    batch = pairs(spark, [(3, "other"), (500, "new"), (500, "new too"), (None, "no id")])
    got = merge_kb(spark, path, batch, buckets=16)
    assert got == {"added": 1, "replaced": 0, "rewritten": 1}
    assert content(spark, path) == before | {("500", "new", "reply new")}
    untouched = {f for f in at if f in files(path)}
    assert len({os.path.dirname(f) for f in untouched}) == 15  # the other folders keep their files
    for _ in range(2):  # as a job that was started again
        assert merge_kb(spark, path, batch, buckets=16) == {"added": 0, "replaced": 0, "rewritten": 0}
    got = merge_kb(spark, path, batch, upsert=True, buckets=16)
    assert (got["added"], got["replaced"]) == (0, 1)
    assert ("3", "other", "reply other") in content(spark, path) and ("3", "text 3", "reply text 3") not in content(spark, path)
    assert merge_kb(spark, path, batch, upsert=True, buckets=16)["rewritten"] == 0
    assert merge_kb(spark, path, pairs(spark, []), buckets=16) == {"added": 0, "replaced": 0, "rewritten": 0}


PRED = "test_id int, gold_intent string, gold_decision string, pred struct<intent:string,decision:string,draft_reply:string>, error string"


def predictions(spark, odd="billing"):
    rows = []
    for i in range(120):
        pred = None if i % 10 == 3 else (["order_status", "refund_related", odd][i % 3], "ESCALATE" if i % 4 == 0 else "AUTO_REPLY",
                                         None if i % 9 == 0 else "mail a@b.co" if i % 5 == 0 else "fine")
        rows.append((i, None if i % 8 == 0 else ["order_status", "refund_related"][i % 2], None if i % 7 == 0 else "ESCALATE" if i % 6 == 0 else "REVIEW",
                     pred, "timeout" if pred is None else ""))
    return spark.createDataFrame(rows, PRED)


@pytest.mark.parametrize("odd", ["general_inquiry", "not in the list"])
def test_scorecard_equals_single_metrics(spark, tmp_out, odd):
    p = predictions(spark, odd)
    out = os.path.join(tmp_out, "pred")
    card = write_with_scorecard(p, out, "rows", "now")
    assert spark.read.parquet(out).count() == 120
    c = card.first()
    ok = p.where("pred IS NOT NULL")
    e = escalation_matrix(ok.where("gold_decision IS NOT NULL").select("gold_decision", F.col("pred.decision").alias("d")), "gold_decision", "d").first()
    s = c.core_metrics.escalation_fnr
    assert (s.true_negatives, s.false_positives, s.false_negatives, s.true_positives, s.fnr) == (e.tn, e.fp, e.fn, e.tp, e.fnr)
    assert s.confusion_matrix == [[e.tn, e.fp], [e.fn, e.tp]]
    report = class_report(ok.where("gold_intent IS NOT NULL").select("gold_intent", F.col("pred.intent").alias("i")), "gold_intent", "i")
    want = report_summary(report).first()
    i = c.core_metrics.intent_metrics
    assert (i.accuracy, i.support) == (want.accuracy, want.support) and i.macro_f1 == pytest.approx(want.macro_f1)
    assert {(x.label, x.tp, x.fp, x.fn) for x in i.per_class} == {(x.label, x.tp, x.fp, x.fn) for x in report.collect()}
    assert (c.num_samples, c.core_metrics.num_drafts, c.core_metrics.num_errors) == (120, 108, 12)
    assert c.judge_metrics is None and c.gold_labels_available.intent == 105
    io.write_scorecard(card, out + "-card")
    assert read_scorecard(spark, out + "-card").first() == c
    text = "".join(r.value for r in spark.read.text(out + "-card").collect())
    assert set(json.loads(text)) == {"num_samples", "dataset", "gold_labels_available", "core_metrics", "judge_metrics", "timestamp"}


def test_scorecard_without_gold(spark, tmp_out):
    p = predictions(spark).withColumn("gold_intent", F.lit(None).cast("string")).withColumn("gold_decision", F.lit(None).cast("string"))
    for i, d in enumerate((p, p.limit(0))):
        c = write_with_scorecard(d, os.path.join(tmp_out, f"p{i}"), "rows", "now").first()
        assert c.core_metrics.intent_metrics is None and c.core_metrics.escalation_fnr is None
        assert c.core_metrics.pii_leakage_rate == (0.0 if i else c.core_metrics.pii_leakage_rate)


TICKETS = "ticket_id long, text string, lang string, at timestamp"


def batch_file(spark, folder, n, ids):
    rows = spark.createDataFrame([(i, f"ticket {i} about parcel {i % 5}", "en") for i in ids], "ticket_id long, text string, lang string") \
        .withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + n)))
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_one_snapshot_for_all_batches_and_no_second_answer(spark, tmp_out, monkeypatch):
    built, answered = [], []
    whole = S.kb_snapshot
    monkeypatch.setattr(S, "kb_snapshot", lambda kb: built.append(1) or whole(kb))
    monkeypatch.setattr(D, "kb_snapshot", lambda kb: pytest.fail("a batch must not build its own"))
    kb = D.kb_from_pairs(pairs(spark, [(i, f"parcel {i} is late") for i in range(10)]))
    src, out = os.path.join(tmp_out, "src"), [os.path.join(tmp_out, x, "same") for x in "ab"]
    batch_file(spark, src, 0, [1, 2, 3, 2])
    stream = spark.readStream.schema(TICKETS).option("maxFilesPerTrigger", 1).parquet(src)

    def run(o, key):
        S.start_triage_stream(stream, kb, D.echo_model, "ticket_id", "text", "lang", o, key=key, time_col="at", trigger_once=True).awaitTermination()
        answered.append(sorted(r.ticket_id for r in spark.read.parquet(o).collect()))

    run(out[0], "k1")
    batch_file(spark, src, 60, [3, 4, 4, 5])
    batch_file(spark, src, 90, [1, 6])
    run(out[0], "k1")  # goes on: the ids of the first run are known
    run(out[1], "k2")  # another key, the same base name: a stream of its own
    assert answered == [[1, 2, 3], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]]
    assert len(built) == 3
    texts = {r.ticket_id: r.pred.draft_reply for r in spark.read.parquet(out[0]).collect()}
    assert texts == {r.ticket_id: r.pred.draft_reply for r in spark.read.parquet(out[1]).collect()} and all(texts.values())
