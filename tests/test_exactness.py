"""Exact neighbours under ties and offsets, grouped kappa, alignment, model calls."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlens.operators.decisions import generate
from ticketlens.operators.judge import quadratic_kappa
from ticketlens.operators.metrics import align
from ticketlens.operators.retrieval import _dense_group_fn, ensure_kb, knn_ids


def nearest(q, kb, k):
    d = ((kb - q) ** 2).sum(axis=1)
    return sorted(range(len(kb)), key=lambda i: (d[i], i))[:k]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_ties_and_offsets(offset):
    rng = np.random.default_rng(1)
    kb = np.vstack([np.tile(rng.normal(size=4), (40, 1)), rng.normal(size=(40, 4)) * 1e-3]) + offset
    queries = kb[[0, 45, 60]] + np.array([1e-4, 0, 0, 0])
    out = _dense_group_fn(5, False)(pd.DataFrame({"qid": range(3), "vec": list(queries)}),
                                    pd.DataFrame({"kid": range(len(kb)), "vec": list(kb)}))
    for i, q in enumerate(queries):
        assert out[out.qid == i].kid.tolist() == nearest(q, kb, 5)


def test_duplicated_vectors_end_to_end(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(5).collect()
    rows = [(10 * c + i, [float(x) for x in e[i].embedding]) for c in range(40) for i in range(5)]
    kb = spark.createDataFrame(rows, "id long, v array<double>")
    got = knn_ids(kb.where("id < 5").withColumnRenamed("id", "q"), kb, 3, "q", "v", "id", "v", q_block_rows=2, kb_shard_rows=7)
    for r in got.groupBy("qid").agg(F.sort_array(F.collect_list("kid")).alias("k")).collect():
        assert r.k == [r.qid, r.qid + 10, r.qid + 20]


def test_kappa_uses_the_labels_of_its_group(spark):
    rows = [("x", 1, 1), ("x", 3, 3), ("x", 1, 3), ("x", 3, 3), ("y", 1, 2), ("y", 2, 2), ("y", 5, 5), (None, 4, 4)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    grouped = {r.g: r.kappa for r in quadratic_kappa(df, "a", "b", ["g"]).collect()}
    for g in ("x", "y"):
        assert grouped[g] == pytest.approx(quadratic_kappa(df.where(F.col("g") == g), "a", "b").first().kappa)
    assert grouped[None] is None


def test_align_raises_on_keys_without_partner(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "test_id int") for ids in ([1, 2], [1, 3]))
    with pytest.raises(ValueError, match="test_id"):
        align(a, b)
    assert align(a, a).count() == 2


def test_model_is_asked_once_a_row_and_bad_answers_are_errors(spark, tmp_path):
    calls = str(tmp_path)

    def model(messages):
        n = messages[0]["content"]
        with open(os.path.join(calls, n), "a") as f:
            f.write("x")
        return {"1": {"no": "text"}, "2": "\ud800"}.get(n, f"answer {n}")

    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content")))
    out = generate(spark.range(6).withColumn("messages", msgs), model)
    for _ in range(2):
        rows = {r.id: r for r in out.collect()}
    assert [os.path.getsize(os.path.join(calls, str(i))) for i in range(6)] == [1] * 6
    assert rows[0].raw == "answer 0" and rows[0].model_error is None
    assert rows[1].raw is None and "dict" in rows[1].model_error
    assert rows[2].raw is None and "UnicodeEncodeError" in rows[2].model_error


def test_ensure_kb_takes_all_pairs(spark):
    pairs = spark.range(2500).selectExpr("'c' customer_text", "'a' agent_text", "'u' customer_id", "id tweet_id")
    assert ensure_kb(None, pairs).count() == 2500
    assert ensure_kb(None, pairs, cap=7).count() == 7
