"""Physical-plan shape of headline queries: column pruning and filters reach the
Parquet scan, top-k and quota windows are cut before the shuffle."""

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pairs_plan(spark):
    """The plan of pair building itself; the query stores the pairs before it detects their language."""
    from ticketlens.operators.pairs import build_pairs
    from ticketlens.sources.adapters import BRAND, read_table, tweets_from_conversations
    df = build_pairs(tweets_from_conversations(read_table(spark, SF, "conversations")), BRAND)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


def test_guardrail_scan_prunes_columns(spark):
    p = plan(spark, "guardrail_scan")
    schemas = read_schemas(p)
    assert schemas and all("lang" not in s and "source" not in s for s in schemas)
    assert "Exchange hashpartitioning" not in p  # a pure projection: no shuffle by key


def test_pairs_push_role_filter_into_scan(spark):
    p = pairs_plan(spark)
    assert re.search(r"PushedFilters: \[[^\]]*role", p)


def test_pairs_aggregate_before_the_join(spark):
    """Replies and customer rows are each cut to a row per tweet id map-side: a
    partial aggregate stands below every exchange, and the join adds none."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = pairs_plan(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in p and "Window" not in p
    assert len(re.findall(r"Functions \[\d+\]: \[[^\n]*partial_min", p)) == 2
    assert len(re.findall(r"Arguments: hashpartitioning\(", p)) == 2


def test_quota_sample_limits_before_exchange(spark):
    p = plan(spark, "sample_golden_set")
    assert re.search(r"WindowGroupLimit.*Partial", p, re.S)


def test_subset_is_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "sample_subset")


def test_language_scoring_broadcasts_bounded_profile(spark):
    p = plan(spark, "language_detect")
    assert "BroadcastHashJoin LeftOuter" in p  # trigram rows meet the pivoted profile


def test_spread_only_when_coarse(spark):
    from ticketlens.sources.adapters import read_table, spread
    par = spark.sparkContext.defaultParallelism
    coarse = spark.range(100).repartition(1)
    assert spread(coarse).rdd.getNumPartitions() == par
    fine = spark.range(0, 100, 1, par * 2)
    assert spread(fine) is fine
    docs = read_table(spark, SF, "documents").filter("lang = 'en'").select("doc_id")
    text = spark._jvm.PythonSQLUtils.explainString(docs._jdf.queryExecution(), "formatted")
    assert re.search(r"PushedFilters: \[[^\]]*lang", text)
    assert all(s == "doc_id:bigint,lang:string" for s in read_schemas(text))
