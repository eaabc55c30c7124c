from pyspark.sql import functions as F

from ticketlens.operators import sampling as S
from ticketlens.operators.gold import build_golden_set, derive_gold_labels


def data(spark, n=200):
    rows = [(i, f"text {i} " + ("x" * (i % 37)), "en" if i % 3 else "fr") for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, lang string")


def test_quota_sample_bounds_and_reproducible(spark):
    df = data(spark)
    a = S.quota_sample(df, "lang", {"en": 10, "fr": 500, "de": 3}, "id")
    counts = {r.lang: r["count"] for r in a.groupBy("lang").count().collect()}
    assert counts == {"en": 10, "fr": df.filter("lang = 'fr'").count()}
    b = S.quota_sample(df.repartition(7), "lang", {"en": 10, "fr": 500}, "id")
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())


def test_quantile_bucket(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "id long, v double")
    out = {r.len_bucket: r["count"] for r in S.quantile_bucket(df, "v").groupBy("len_bucket").count().collect()}
    assert sum(out.values()) == 100 and set(out) == {"short", "medium", "detailed"}


def test_dedup_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, text string")
    assert sorted(r.id for r in S.dedup_first(df, ["text"], ["id"]).collect()) == [1, 2]


def test_golden_and_gold_labels(spark):
    rows = [(1, "my lawyer will call", "en"), (2, "tracking says nothing", "en"),
            (3, "order 123-4567890-1234567", "en"), (4, "bonjour", "fr"), (5, "hola", "es")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    g = build_golden_set(df, "text", "lang", "id").orderBy("test_id").collect()
    assert [r.source_intent for r in g] == ["order_tracking_delay", "legal_regulatory_churn", "pii_leak", "es", "fr"]
    assert [r.test_id for r in g] == [1, 2, 3, 4, 5]
    lab = derive_gold_labels(build_golden_set(df, "text", "lang", "id"))
    got = {r.id: (r.gold_intent, r.gold_decision, r.gold_reason) for r in lab.collect()}
    assert got[1] == ("legal_regulatory_churn", "ESCALATE", "SEVERE_KEYWORD_TRIGGER")
    assert got[3] == ("general_inquiry", "ESCALATE", "PII_PRESENT")
    assert got[2] == ("order_status", "AUTO_REPLY", "NONE")
    assert got[4] == ("general_inquiry", "AUTO_REPLY", "NONE")


def test_subset_is_top_n(spark):
    df = data(spark)
    assert S.subset(df, 5, "id").count() == 5
    assert S.balanced_sample(df.withColumn("d", F.when(F.col("id") < 5, "ESCALATE").otherwise("AUTO_REPLY")),
                             "d", 20, "id").count() == 15
