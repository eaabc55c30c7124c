"""Reproducible stratified sampling.

Every sample is an exact, seeded top-n per stratum:
``row_number() over (partition by stratum order by md5(id || ':' || seed), id) <= quota``.
The filter uses a literal bound (the largest quota), which Spark plans as a
partial WindowGroupLimit before the shuffle, so even a stratum holding a
third of all rows ships at most ``quota`` rows per map task. Per-stratum
quotas are a caller dict inlined as a map literal (no join).
Numbering a finished sample (A9/A10) uses a global window on purpose: its
input is the sample itself, bounded by the sum of quotas.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators.quantiles import exact_quantiles

SEED = 42


def sample_key(id_col: str | Column, seed: int = SEED) -> Column:
    """Seeded order key; equal hex strings in Spark and DuckDB."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


NO_STRATUM = "\u0000"  # stands for a null stratum (never has a quota)


def quota_sample(df: DataFrame, stratum_col: str, quotas: dict, id_col: str,
                 seed: int = SEED, rank_col: str = "sample_rank") -> DataFrame:
    """A2: up to ``quotas[stratum]`` rows per stratum, without replacement; other strata dropped."""
    if not quotas:
        return df.limit(0).withColumn(rank_col, F.lit(None).cast("int"))
    w = Window.partitionBy(stratum_col).orderBy(sample_key(id_col, seed), F.col(id_col))
    # No pre-filter on the stratum: a derived stratum (e.g. a text classifier)
    # would be pushed into the scan as a predicate and evaluated there with its
    # inputs inlined. Strata without a quota get a null bound and are dropped
    # by the last filter; the partial WindowGroupLimit caps every stratum at
    # max(quota) rows per map task before the exchange.
    # A null stratum becomes a sentinel without a quota, so the column is not
    # nullable and no IS NOT NULL on it is inferred and pushed down either.
    if isinstance(df.schema[stratum_col].dataType, T.StringType):
        df = df.withColumn(stratum_col, F.coalesce(F.col(stratum_col), F.lit(NO_STRATUM)))
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked.filter(F.col(rank_col) <= max(quotas.values())) \
        .filter(F.col(rank_col) <= _map_lit(quotas)[F.col(stratum_col)])


def cap_per_group(df: DataFrame, group_col: str, n: int, id_col: str, seed: int = SEED,
                  groups: list | None = None) -> DataFrame:
    """A4: at most ``n`` rows per group (all groups, or only ``groups``)."""
    src = df if groups is None else df.filter(F.col(group_col).isin(*groups))
    w = Window.partitionBy(group_col).orderBy(sample_key(id_col, seed), F.col(id_col))
    return src.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= n)


def dedup_first(df: DataFrame, key_cols: list[str], order_cols: list[Column | str]) -> DataFrame:
    """A3: one row per key, the first by ``order_cols`` (never an arbitrary row)."""
    w = Window.partitionBy(*key_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def tercile_edges(df: DataFrame, value_col: str) -> tuple[float, float, float, float]:
    """(min, q1/3, q2/3, max) with linear interpolation, rounded to 6 dp: exact, by rank selection
    over counters of a fixed number. Four numbers come back to the driver."""
    edges = exact_quantiles(df, value_col, [0.0, 1 / 3, 2 / 3, 1.0])
    if edges[0] is None:
        raise ValueError("no values to bucket")
    return tuple(round(e, 6) for e in edges)


def quantile_bucket(df: DataFrame, value_col: str, labels=("short", "medium", "detailed"),
                    out: str = "len_bucket") -> DataFrame:
    """A5: right-closed tercile bins, lowest value included; duplicate edges raise."""
    lo, q1, q2, hi = tercile_edges(df, value_col)
    if not (lo < q1 < q2 < hi):
        raise ValueError(f"bin edges must be unique: {[lo, q1, q2, hi]}")
    v = F.col(value_col)
    return df.withColumn(out, F.when(v <= q1, F.lit(labels[0])).when(v <= q2, F.lit(labels[1]))
                         .otherwise(F.lit(labels[2])))


def smart_kb_sample(pairs: DataFrame, text_col: str, lang_col: str, id_col: str,
                    order_cols: list, target: int = 5000, per_language: int = 300,
                    languages=("ja", "es", "fr", "pt", "hi"), english: str = "en",
                    seed: int = SEED) -> DataFrame:
    """K11 = A3..A7: dedup texts, cap each listed language, fill the rest of
    ``target`` evenly over English length terciles ((target - others) // 3 each,
    remainder dropped, capped at bucket size)."""
    d = dedup_first(pairs, [text_col], order_cols)
    multi = cap_per_group(d, lang_col, per_language, id_col, seed, list(languages)).drop("sample_rank")
    n_multi = multi.count()
    en = d.filter(F.col(lang_col) == english).withColumn("_len", F.length(text_col))
    en = quantile_bucket(en, "_len", out="_bucket")
    per_bucket = max((target - n_multi) // 3, 0)
    en_s = quota_sample(en, "_bucket", {b: per_bucket for b in ("short", "medium", "detailed")},
                        id_col, seed).drop("sample_rank")
    return multi.withColumn("len_bucket", F.lit(None).cast("string")).unionByName(
        en_s.withColumnRenamed("_bucket", "len_bucket").drop("_len"))


def fixed_sample(df: DataFrame, pools: list[tuple[str, Column, int]], id_col: str,
                 seed: int = SEED, strict: bool = True) -> DataFrame:
    """Fixed-size draws from named pools; ``strict`` raises when a pool is short."""
    tagged = None
    quotas = {}
    for name, cond, n in pools:
        part = df.filter(cond).withColumn("_pool", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
        quotas[name] = n
    # the draw is bounded by sum(quotas) rows: keep it after the first pass so the
    # shortage check and later size checks do not recompute the source
    out = quota_sample(tagged, "_pool", quotas, id_col, seed).persist()
    if strict:
        got = {r["_pool"]: r["n"] for r in out.groupBy("_pool").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = {k: (got.get(k, 0), v) for k, v in quotas.items() if got.get(k, 0) < v}
        if short:
            raise ValueError(f"pools too small (got, wanted): {short}")
    return out.drop("sample_rank")


def shuffle_number(sample: DataFrame, id_col: str, seed: int = SEED, out: str = "test_id") -> DataFrame:
    """Seeded shuffle of a finished sample, numbered 1..n (sample-sized window)."""
    w = Window.orderBy(sample_key(id_col, seed), F.col(id_col))
    return sample.withColumn(out, F.row_number().over(w))


def number_entries(sample: DataFrame, order_cols: list, out: str = "test_id") -> DataFrame:
    """A10: sequential ids in stratum order (sample-sized window)."""
    return sample.withColumn(out, F.row_number().over(Window.orderBy(*order_cols)))


def balanced_sample(df: DataFrame, label_col: str, size: int, id_col: str, seed: int = SEED,
                    labels=("AUTO_REPLY", "ESCALATE")) -> DataFrame:
    """Size // 2 per class (capped at class size); unlabelled rows dropped."""
    return quota_sample(df.filter(F.col(label_col).isNotNull()), label_col,
                        {lab: size // 2 for lab in labels}, id_col, seed)


def subset(df: DataFrame, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """Seeded random subset of at most n rows (a top-n by hash key)."""
    return df.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(n)


def quota_shortfall(df: DataFrame, stratum_col: str, quotas: dict) -> DataFrame:
    """(stratum, quota, available, taken, short) for every requested stratum."""
    spark = df.sparkSession
    q = spark.createDataFrame([(k, int(v)) for k, v in quotas.items()], "stratum string, quota int")
    counts = df.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count(F.lit(1)).alias("available"))
    j = q.join(counts, "stratum", "left").fillna(0, ["available"])
    taken = F.least(F.col("quota").cast("long"), F.col("available"))
    return j.select("stratum", "quota", "available", taken.alias("taken"),
                    (F.col("quota") - taken).alias("short"))


def assert_size(df: DataFrame, expected: int) -> DataFrame:
    """Raise unless the frame has exactly ``expected`` rows."""
    n = df.count()
    if n != expected:
        raise RuntimeError(f"expected {expected} entries, got {n}")
    return df


def composition(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key combination plus per-key subtotals and the total (ROLLUP)."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))
