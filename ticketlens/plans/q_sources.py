"""Source, sink and streaming queries.

Each query writes a table that Spark derives from the driver tables with the
library's writer into the session's shared scratch folder
(``spark.checkpoint.dir``, see ``session.checkpoint_dir``), reads it back with
the library's reader and returns the read side. The oracle is the SQL of the
same in-memory computation, so a reader or writer that loses, splits or
alters rows fails the check. Every call writes to a fresh folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators import gold as Gd
from ticketlens.operators.judge import calibration_agreement
from ticketlens.operators.pairs import build_pairs
from ticketlens.plans.q_metrics import AGREE_SQL, _calibration
from ticketlens.functions import guardrails as G
from ticketlens.plans.q_guardrails import RE_CARD, RE_EMAIL, RE_ORDER, RE_PHONE, _kw_case, _legal_sql, _pii_case
from ticketlens.plans.q_pairs import PAIRS_SQL
from ticketlens.plans.q_sampling import FIXED_CTE, GOLDEN_CTE, _docs, _fixed_gold
from ticketlens.plans.registry import query
from ticketlens.schemas import GOLDEN, GOLDEN_ANNOTATED
from ticketlens.session import checkpoint_dir
from ticketlens.sources import io
from ticketlens.streaming.triage_stream import start_rule_stream, start_triage_stream
from ticketlens.sources.adapters import BASE_EPOCH, BRAND, read_table, tweets_from_conversations

# Fixed value: the tweet timestamp layout as the raw export writes it.
TWITTER_TS_OUT = "EEE MMM dd HH:mm:ss Z yyyy"


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tweets_csv_frame(tweets):
    """T1 rows in the raw export's CSV shape: Twitter-layout timestamps for
    agent tweets, ISO for the rest (both must parse), reply-to as a float."""
    ts = F.when(F.col("inbound"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format("created_at", TWITTER_TS_OUT))
    return tweets.select("tweet_id", "author_id", "inbound", ts.alias("created_at"), "text",
                         F.lit(None).cast("string").alias("response_tweet_id"),
                         F.col("in_response_to_tweet_id").cast("double").alias("in_response_to_tweet_id"))


@query("sources_tweets_csv_pairs", PAIRS_SQL, covers=["S1", "S3", "S4", "S5", "P14"])
def sources_tweets_csv_pairs(spark, sf_dir):
    tweets = tweets_from_conversations(read_table(spark, sf_dir, "conversations"))
    csv_dir, tw_dir, pq_dir = _scratch(spark, "tweets-csv"), _scratch(spark, "tweets-parquet"), _scratch(spark, "pairs-parquet")
    (tweets_csv_frame(tweets).write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(csv_dir))
    pairs = build_pairs(io.convert_tweets(spark, csv_dir, tw_dir), BRAND)
    io.write_parquet(pairs, pq_dir)
    return io.read_parquet(spark, pq_dir, ["customer_text", "agent_text", "agent_text_raw",
                                           "customer_id", "tweet_id", "agent_tweet_id"])


TS_SQL = """
SELECT conv_id, turn,
       CASE WHEN turn % 5 = 4 THEN NULL
            ELSE CAST(1704067200 + (conv_id * 1000 + turn * 10) * 60 AS BIGINT) END AS epoch
FROM conversations"""


@query("sources_timestamp_parse", TS_SQL, covers=["S3"])
def sources_timestamp_parse(spark, sf_dir):
    """S3 over one timestamp per chat turn, written in the raw export's three
    shapes (Twitter layout, ISO with a space, ISO with 'T' and 'Z') plus a
    non-date every fifth turn, which must come back null (and be reported)."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    ts = F.timestamp_seconds(F.lit(BASE_EPOCH) + (F.col("conv_id") * 1000 + F.col("turn") * 10) * 60)
    raw = (F.when(F.col("turn") % 5 == 4, F.concat(F.lit("turn "), F.col("turn").cast("string")))
           .when(F.col("turn") % 3 == 0, F.date_format(ts, TWITTER_TS_OUT))
           .when(F.col("turn") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
           .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")))
    r = c.select("conv_id", "turn", raw.alias("created_at"))
    return r.select("conv_id", "turn",
                    F.unix_seconds(io.parse_created_at("created_at")).alias("epoch"))


GOLDEN_RT_SQL = GOLDEN_CTE + """
SELECT test_id, doc_id, expected_language, source_intent, CAST(NULL AS VARCHAR) AS gold_intent,
       0 AS n_forbidden, input_tweet FROM golden"""


@query("sources_golden_jsonl", GOLDEN_RT_SQL, covers=["S6", "S7"])
def sources_golden_jsonl(spark, sf_dir):
    g = Gd.build_golden_set(_docs(spark, sf_dir), "text", "lang", "doc_id")
    path = _scratch(spark, "golden-jsonl")
    io.write_jsonl(g, path)
    schema = T.StructType(GOLDEN.fields + [T.StructField("doc_id", T.LongType())])
    back = io.read_jsonl(spark, path, schema)
    return back.select("test_id", "doc_id", "expected_language", "source_intent", "gold_intent",
                       F.size("forbidden_elements").alias("n_forbidden"), "input_tweet")


def annotated_template(gold):
    """What an annotator hands back: the S9 template with the gold columns typed in
    by hand — decision in lower case with stray blanks, routing as a comma list
    with an empty item, forbidden elements left blank."""
    t = io.annotation_template(gold)
    g = gold.select(F.col("test_id").cast("string").alias("_tid"), F.col("gold_intent").alias("_gi"),
                    F.col("gold_decision").alias("_gd"), F.col("gold_reason").alias("_gr"))
    return t.join(g, t.test_id == g._tid).select(
        "test_id", "input_tweet", "expected_language",
        F.concat(F.lit(" "), "_gi", F.lit(" ")).alias("gold_intent"),
        F.concat(F.lit("  "), F.lower("_gd")).alias("gold_decision"),
        F.col("_gr").alias("gold_reason"),
        F.concat_ws(", ", "_gi", F.lit(""), "_gr").alias("required_routing"),
        F.lit("").alias("forbidden_elements"), "agent_notes", "source_intent")


ANNOT_SQL = FIXED_CTE + """
SELECT test_id, regexp_replace(translate(regexp_replace(input_tweet, '[\\r\\n]', ' ', 'g'), '"', ''''), '^\\s+|\\s+$', '', 'g') AS input_tweet,
       expected_language, gold_intent, gold_decision, gold_reason, 2 AS n_routing,
       gold_reason AS last_routing, 0 AS n_forbidden
FROM fixed"""


@query("sources_annotations_roundtrip", ANNOT_SQL, covers=["S8", "S9", "S10", "H6", "H7"])
def sources_annotations_roundtrip(spark, sf_dir):
    gold = _fixed_gold(spark, sf_dir)
    csv_dir, out_dir = _scratch(spark, "annotations-csv"), _scratch(spark, "annotations-jsonl")
    io.write_annotation_template(annotated_template(gold), csv_dir)
    io.convert_annotations(spark, csv_dir, out_dir)
    back = spark.read.schema(GOLDEN_ANNOTATED).json(out_dir)
    return back.select("test_id", "input_tweet", "expected_language", "gold_intent", "gold_decision", "gold_reason",
                       F.size("required_routing").alias("n_routing"),
                       F.element_at("required_routing", -1).alias("last_routing"),
                       F.size("forbidden_elements").alias("n_forbidden"))


REPORT_SQL = "WITH agree AS (" + AGREE_SQL + """)
SELECT line FROM (
  SELECT 'n=' || CAST(n AS VARCHAR) AS line FROM agree
  UNION ALL SELECT 'brand_voice_kappa=' || coalesce(printf('%.4f', brand_voice_kappa), 'nan') FROM agree
  UNION ALL SELECT 'policy_kappa=' || coalesce(printf('%.4f', policy_kappa), 'nan') FROM agree
  UNION ALL SELECT 'pii_accuracy=' || coalesce(printf('%.4f', pii_accuracy), 'nan') FROM agree
  UNION ALL SELECT 'lang_accuracy=' || coalesce(printf('%.4f', lang_accuracy), 'nan') FROM agree)"""


@query("sources_calibration_report", REPORT_SQL, covers=["S12"])
def sources_calibration_report(spark, sf_dir):
    path = _scratch(spark, "calibration-report")
    io.write_report(calibration_agreement(_calibration(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --------------------------------------------------------------------------- streaming
def _glob(path: str) -> str:
    """A file source watches a directory or glob; make a single-file table path a
    glob matching just that file (first character in brackets)."""
    head, name = path.rsplit("/", 1)
    return f"{head}/[{name[0]}]{name[1:]}"


STREAM_RULES_SQL = f"""
WITH s AS (
  SELECT doc_id, text AS t,
         {_pii_case('text')} AS pii_reason,
         {_kw_case('text', G.SEVERE_KEYWORDS)} AS keyword_reason,
         coalesce({_legal_sql('text')}, false) AS legal,
         (regexp_matches(text, '{RE_ORDER}') OR regexp_matches(text, '{RE_EMAIL}')
          OR regexp_matches(text, '{RE_CARD}') OR regexp_matches(text, '{RE_PHONE}')) AS anypii
  FROM documents
)
SELECT doc_id,
       (t IS NOT NULL AND t <> '' AND coalesce(pii_reason, keyword_reason) IS NOT NULL) AS flag,
       CASE WHEN t IS NULL OR t = '' THEN '' ELSE coalesce(pii_reason, keyword_reason, '') END AS reason,
       CASE WHEN t IS NOT NULL AND t <> '' AND coalesce(pii_reason, keyword_reason) IS NOT NULL
            THEN CASE WHEN legal THEN 'legal_regulatory_churn' ELSE 'account_access_security' END END
         AS escalation_intent,
       CASE WHEN t IS NULL OR t = '' THEN false ELSE coalesce(anypii, false) END AS text_has_pii
FROM s"""


@query("stream_triage_rules", STREAM_RULES_SQL, covers=["D15", "G8", "G10", "G11"])
def stream_triage_rules(spark, sf_dir):
    """The stateless rule half of triage on a file stream of the documents
    table (Structured Streaming, drained once), read back from its sink."""
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(_glob(path)).select("doc_id", "text", "lang")
    sink = _scratch(spark, "stream-rules")
    start_rule_stream(stream, "doc_id", "text", "lang", sink, uuid.uuid4().hex, trigger_once=True).awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "flag", "reason", "escalation_intent", "text_has_pii")


def _stream_triage_sql():
    from ticketlens.plans.q_retrieval import _triage_sql
    return "SELECT ticket_id, language, decision, intent, reply, error FROM (" + _triage_sql() + ")"


@query("stream_triage_full", _stream_triage_sql(), covers=["D15", "D14"])
def stream_triage_full(spark, sf_dir):
    """Full triage (language, retrieval, model, validation) of a
    stream of user turns, each of which comes twice and is answered once."""
    from ticketlens.operators.decisions import echo_model, kb_from_pairs
    from ticketlens.plans.q_retrieval import _pairs, _profiles
    path = f"{sf_dir.rstrip('/')}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    ticket = F.col("conv_id") * 1000 + F.col("turn") * 10
    at = F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("turn"))
    stream = spark.readStream.schema(schema).parquet(_glob(path)).filter(F.col("role") == "user").select(
        ticket.alias("ticket_id"), "text", F.lit(None).cast("string").alias("lang"),
        F.explode(F.array(at, F.timestamp_add("SECOND", F.lit(30), at))).alias("at"))
    out = _scratch(spark, "stream-triage")
    q = start_triage_stream(stream, kb_from_pairs(_pairs(spark, sf_dir)), echo_model, "ticket_id", "text", "lang", out,
                            key=uuid.uuid4().hex, time_col="at", profiles=_profiles(spark, sf_dir), trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("ticket_id", F.col("pred.detected_language").alias("language"), F.col("pred.decision").alias("decision"),
                                          F.col("pred.intent").alias("intent"), F.col("pred.draft_reply").alias("reply"), "error")
