import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from ticketlens.operators.gold import normalise_annotations
from ticketlens.operators.judge import calibration_agreement
from ticketlens.schemas import CALIBRATION
from ticketlens.sources import io
from ticketlens.streaming.triage_stream import triage_columns


def test_tweets_csv(spark, tmp_out):
    p = os.path.join(tmp_out, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n")
        f.write('1,u1,True,Tue Oct 31 22:10:47 +0000 2017,"line one\nline, two ""quoted""",2,\n')
        f.write("2,brand,False,2017-10-31T22:12:00Z,hello,,1.0\n")
    rows = io.read_tweets(spark, p).orderBy("tweet_id").collect()
    assert rows[0].text == 'line one\nline, two "quoted"'
    assert rows[0].created_at is not None and rows[1].in_response_to_tweet_id == 1


def test_tweets_that_cannot_be_read(spark, tmp_out):
    head = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
    for i, (row, why) in enumerate([("1,u,True,someday,x,,\n", "not a timestamp: someday"), ("1,u,True,2017-10-31T22:12:00Z,x,,abc\n", "abc"),
                                    ("1,u,maybe,2017-10-31T22:12:00Z,x,,\n", None)]):
        p = os.path.join(tmp_out, f"bad{i}.csv")
        with open(p, "w", encoding="utf-8") as f:
            f.write(head + row)
        with pytest.raises(Exception, match=why):
            io.read_tweets(spark, p).collect()
    p = os.path.join(tmp_out, "big.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(head + "1,u,True,,x,,9007199254740993.0\n2,u,True,,x,,\n")
    t = io.convert_tweets(spark, p, os.path.join(tmp_out, "t.parquet"), files=2).orderBy("tweet_id").collect()
    assert [r.in_response_to_tweet_id for r in t] == [9007199254740993, None] and t[0].created_at is None


def test_annotation_template(spark, tmp_out):
    from ticketlens.schemas import GOLDEN
    rows = [(2, ' "say"\r\nit, now ', "en", None, None, None, None, [], "x, y"), (1, "日本 'q'", "ja", None, None, None, None, [], None)]
    p = os.path.join(tmp_out, "template")
    io.write_annotation_template(io.annotation_template(spark.createDataFrame(rows, GOLDEN)), p, ["Read me", "and me"])
    name, = [n for n in os.listdir(p) if n.endswith(".txt")]
    with open(os.path.join(p, name), "rb") as f:
        raw = f.read()
    assert raw.startswith("\ufeff# Read me\n# and me\ntest_id,input_tweet,".encode())
    with open(os.path.join(p, name), encoding="utf-8-sig") as f:
        body = [x for x in csv.reader(x for x in f if not x.startswith("#"))]
    assert body[1:] == [["1", "日本 'q'", "ja", *[""] * 7], ["2", "'say'  it, now", "en", *[""] * 6, "x, y"]]
    back = io.read_annotations(spark, p).orderBy("test_id").collect()
    assert [(r.test_id, r.input_tweet, r.source_intent) for r in back] == [("1", "日本 'q'", None), ("2", "'say'  it, now", "x, y")]
    with open(os.path.join(tmp_out, "short.csv"), "w", encoding="utf-8") as f:
        f.write(",".join(body[0]) + "\n1,only two\n")
    with pytest.raises(Exception):
        io.read_annotations(spark, os.path.join(tmp_out, "short.csv")).collect()


def test_annotations_bom_comments(spark, tmp_out):
    d = os.path.join(tmp_out, "ann")
    os.makedirs(d)
    with open(os.path.join(d, "batch1.csv"), "w", encoding="utf-8-sig") as f:
        f.write("# instructions\n# more\n")
        f.write("test_id,input_tweet,expected_language,gold_intent,gold_decision,gold_reason,"
                "required_routing,forbidden_elements,agent_notes,source_intent\n")
        f.write("1,hi,en, order_status ,escalate,,  ,\"a, b,,c\",,x\n")
    df = normalise_annotations(io.read_annotations(spark, d))
    r = df.first()
    assert (r.test_id, r.gold_intent, r.gold_decision, r.gold_reason) == (1, "order_status", "ESCALATE", None)
    assert r.required_routing == [] and r.forbidden_elements == ["a", "b", "c"]
    out = os.path.join(tmp_out, "conv")
    io.convert_annotations(spark, d, out)
    assert any(n.startswith("source_file=batch1") for n in os.listdir(out))


def test_jsonl_and_report(spark, tmp_out):
    p = os.path.join(tmp_out, "cal.jsonl")
    recs = [{"inquiry": "q", "response": "r", "human_brand_voice_score": s, "human_policy_adherence": s,
             "human_pii_safety_pass": True, "human_language_match_pass": True} for s in (3, 4, 5, 4)]
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n\n")
    cal = io.read_jsonl(spark, p, CALIBRATION)
    assert cal.count() == 4
    j = cal.select("*", F.col("human_brand_voice_score").alias("brand_voice_score"),
                   F.col("human_policy_adherence").alias("factual_policy_adherence"),
                   F.col("human_pii_safety_pass").alias("pii_safety_pass"),
                   F.lit(True).alias("language_match_pass"))
    agr = calibration_agreement(j)
    lines = [r.value for r in io.calibration_report_lines(agr).collect()]
    assert lines == ["n=4", "brand_voice_kappa=1.0000", "policy_kappa=1.0000", "pii_accuracy=1.0000",
                     "lang_accuracy=1.0000"]


def test_streaming_rules(spark, tmp_out):
    src = os.path.join(tmp_out, "docs")  # the file source watches a directory
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    q = (triage_columns(stream, "doc_id", "text", "lang").writeStream.format("memory")
         .queryName("triage_mem").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    n = spark.sql("select count(*) from triage_mem").first()[0]
    batch = triage_columns(spark.read.parquet(src), "doc_id", "text", "lang")
    assert n == batch.count()
    assert spark.sql("select count(*) from triage_mem where flag").first()[0] == batch.filter("flag").count()
