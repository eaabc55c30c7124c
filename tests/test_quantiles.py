"""Rank selection against numpy, over values that even bins do not cut well."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators.metrics import latency_summary
from ticketlens.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]


def rows_of(name):
    rng = random.Random(4)
    return {"even": [rng.random() for _ in range(900)],
            "magnitudes": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(900)],
            "ends": [-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1e-323] * 30,
            "ties": [float(rng.choice([1, 1, 1, 2, 1e12])) for _ in range(900)],
            "close": [1.0 + i * 2.0 ** -52 for i in range(500)],
            "one": [3.5], "two": [1.0, 2.0]}[name]


@pytest.mark.parametrize("name", ["even", "magnitudes", "ends", "ties", "close", "one", "two"])
@pytest.mark.parametrize("bins,leaf", [(4096, 4096), (64, 3)])
def test_exact(spark, name, bins, leaf):
    v = rows_of(name)
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 5, "x double")
    got = exact_quantiles(df, "x", FRACTIONS, bins, leaf)
    s = sorted(v)
    for f, g in zip(FRACTIONS, got):
        p = (len(s) - 1) * f
        a, b = s[math.floor(p)], s[math.ceil(p)]
        want = a if a == b or p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b
        assert g == want


def test_equals_percentile_and_numpy(spark):
    v = np.random.default_rng(1).lognormal(3, 4, 5000)
    df = spark.createDataFrame([(float(x),) for x in v], "x double").repartition(7)
    got = exact_quantiles(df, "x", FRACTIONS, leaf_rows=50)
    assert got == pytest.approx(list(np.quantile(v, FRACTIONS)), rel=1e-12)
    assert got == pytest.approx(df.agg(F.percentile("x", F.array(*map(F.lit, FRACTIONS)))).first()[0], rel=1e-12)


def test_no_values_and_no_numbers(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    assert exact_quantiles(spark.createDataFrame([], "x int"), "x", [0.5]) == [None]
    inf, nan = float("inf"), float("nan")
    got = exact_quantiles(spark.createDataFrame([(x,) for x in [nan, -inf, 1.0, inf, 2.0]], "x double"), "x", [0, .25, .5, .75, 1])
    assert got[:4] == [-inf, 1.0, 2.0, inf] and math.isnan(got[4])


def test_latency_leaves_failed_rows_out(spark):
    rows = [(float(i), i, i % 10 == 0) for i in range(101)] + [(None, 5, False), (9e9, 6, None)]
    df = spark.createDataFrame(rows, "ms double, at int, bad boolean").withColumn("at", F.timestamp_seconds("at"))
    r = latency_summary(df, "ms", "at", F.col("bad")).first()
    ok = [x for x, _, bad in rows if not bad and x is not None]
    assert (r.n, r.failed) == (92, 11)
    assert r.p50_latency == np.quantile(ok, 0.5) and r.p95_latency == pytest.approx(np.quantile(ok, 0.95))
    assert latency_summary(df.limit(0), "ms", "at", F.col("bad")).first().p50_latency is None
