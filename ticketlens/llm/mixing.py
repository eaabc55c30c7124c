"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled order (MD5 of the id, a seed and
the text's MD5, so that rows that share an id, or have none, do not stand together). Every copy of a document gets a virtual finish time: the source's words
up to and including it, divided by the source's target. Copies of all sources
are served in order of finish time until the total budget is used up, so every
source advances through its target at the same pace.

Scale: one shuffle of (id, source, size) by (source, hash bucket) for the
running totals, so that a source with a third of all rows is spread over up to
4,096 buckets. The cut in the global order is found from range buckets of the
finish time and the rows of the one bucket it falls in; nothing else is sorted.
Whole rows are not shuffled at all: what a source serves in a pass ends at one code,
which every row compares with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import bucket_count, rows_where, stored, text_of, unheld, words_of
from ticketlens.operators.joins import dimension_join

EPOCHS = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.size(words_of(text_of(text))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, rank, target)`` of a table with a row per source
    (``source``, ``source_size``). Weights repeat over the sources by code
    point, null last. Targets share the sum of all sizes by weight; a target
    stops at ``epochs`` times its source's size and the excess is shared again,
    until none is above. That is one water level: sources are capped in order
    of ``epochs * size / weight``, and the level of the rest is what the capped
    ones leave, over the weights of the rest. One row per source: the windows
    here run over the list of sources, not over documents."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.select("source", "source_size", F.row_number().over(by).alias("rank"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    t = t.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs)
    level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("rank"))
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
                 F.sum("w").over(after).alias("rest"), F.sum("source_size").over(every).alias("budget"))
    # the first source (by level) that is not capped sets the level of it and all later ones
    fits = F.col("cap") * F.col("rest") >= F.col("w") * (F.col("budget") - F.col("capped"))
    t = t.withColumn("fits", fits)
    first = F.first(F.when(F.col("fits"), F.struct("capped", "rest")), ignorenulls=True).over(every)
    t = t.withColumn("at", first)
    share = F.col("w") * (F.col("budget") - F.col("at.capped")) / F.col("at.rest")
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")) \
        .otherwise(F.least(F.col("cap").cast("double"), share.cast("double")))
    return t.select("source", "source_size", "rank", target.alias("target"), "budget")


def taken_copies(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
                 weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, row: str | None = None) -> DataFrame:
    """One row per row of ``df``: ``doc_id, size, source_size, target, copies,
    taken``; with ``row`` instead ``copies`` and the whole row as a struct of that name.

    A null text has size 0, a null source is a source of its own (last). Equal
    rows are interchangeable. Documents of size 0 and all documents of a source
    of size 0 are taken 0 words. An empty table gives no rows. Reruns agree:
    the order depends on the id, the text and the seed only.
    """
    code = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)), F.md5(text_of(text))))
    own = [F.col(source).alias("source"), code.alias("code"), F.substring(code, 1, 3).alias("part")]
    sized = stored(df.select(F.col(key).alias("doc_id"), *own, n_words(F.col(text)).alias("size")), "mix")  # narrow; read four times below
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, epochs)
    # at most 4,096 parts a source
    up = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(up), F.lit(0)).alias("start"))
    starts = starts.join(sources, starts.source.eqNullSafe(sources.source)).select(
        starts["*"], "source_size", "rank", "target", "budget")
    starts = stored(starts, "mix-starts")
    m = running(sized, starts)
    cut = cut_at_budget(m, sized.count(), epochs)
    served = [_served(cut, e, m.schema["doc_id"].dataType) for e in range(epochs)]
    if row is None:
        return m.select("doc_id", "size", "source_size", "target", sum(served, F.lit(0).cast("long")).alias("copies")) \
            .withColumn("taken", F.col("copies") * F.col("size"))
    whole = df.select(*own[:2], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))
    return _by_last_served(whole, m, served).select("copies", row)


def _by_last_served(whole: DataFrame, m: DataFrame, served: list[Column]) -> DataFrame:
    """``whole`` (``source``, ``code`` and other columns) with ``copies``. A source serves each pass in
    the order of codes, so its last served code decides for all its rows, and rows need no
    exchange beside the lookup by source. Rows of one code (repeated rows) of which a pass serves
    only some are numbered; they alone are shuffled."""
    place = Window.partitionBy("source", "part", "code").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    m = m.withColumn("nth", F.row_number().over(place))
    dim = m.groupBy("source").agg(
        *[F.max(F.when(s > 0, F.struct("code", "nth"))).alias(f"last{e}") for e, s in enumerate(served)],
        *[F.min(F.when(s == 0, F.col("code"))).alias(f"next{e}") for e, s in enumerate(served)])
    cut_inside = F.lit(False)
    for e in range(len(served)):
        cut_inside = cut_inside | F.coalesce(F.col(f"next{e}") == F.col(f"last{e}.code"), F.lit(False))
    dim = stored(dim.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), cut_inside.alias("_cut"),
                            *[F.col(f"last{e}.{c}").alias(f"{c}{e}") for e in range(len(served)) for c in ("code", "nth")]), "mix-last")
    d = whole.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    d = dimension_join(d, dim, ["_s", "_n"], how="left", salt_source=F.xxhash64("code"))
    at_last = F.lit(False)
    for e in range(len(served)):
        at_last = at_last | F.coalesce(F.col("code") == F.col(f"code{e}"), F.lit(False))
    if dim.where("_cut").isEmpty():
        d = d.withColumn("nth", F.lit(0))
    else:
        d = stored(d.withColumn("_tied", at_last & F.col("_cut")), "mix-tied")
        d = d.where("NOT coalesce(_tied, false)").withColumn("nth", F.lit(0)).unionByName(
            d.where("_tied").withColumn("nth", F.row_number().over(Window.partitionBy("source", "code").orderBy(F.lit(0)))))
    copies = F.lit(0).cast("long")
    for e in range(len(served)):
        here = (F.col("code") < F.col(f"code{e}")) | ((F.col("code") == F.col(f"code{e}")) & (F.col("nth") <= F.col(f"nth{e}")))
        copies = copies + F.coalesce(here, F.lit(False)).cast("long")
    return d.withColumn("copies", copies)


def running(d: DataFrame, starts: DataFrame) -> DataFrame:
    """``d`` with its source's figures and ``upto``, the source's words up to and including the row."""
    inner = Window.partitionBy("source", "part").orderBy("code", F.col("doc_id").asc_nulls_first(), "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.join(starts, d.source.eqNullSafe(starts.source) & (d.part == starts.part))
            .select(d["*"], "start", "source_size", "rank", "target", "budget")
            .withColumn("upto", F.col("start") + F.sum("size").over(inner)))


def _finish(epoch: int) -> Column:
    """Virtual finish time of the copy of pass ``epoch``; null without a target."""
    return F.when(F.col("target") > 0, (F.col("source_size") * epoch + F.col("upto")) / F.col("target"))


def _slot(finish: Column, n: int) -> Column:
    """Range bucket of a finish time: steps of 2 / n up to 2, one bucket for all beyond."""
    return F.least(F.floor(finish * (n // 2)), F.lit(n)).cast("long")


def cut_at_budget(m: DataFrame, rows: int, epochs: int) -> dict | None:
    """Where the running total of sizes, in order of (finish, source, order in
    the source, pass), passes the budget: the range bucket and the last copy in
    it that is served. None if the budget covers every copy."""
    n = bucket_count(rows * epochs)
    copy = F.explode(F.array(*[F.struct(_finish(e).alias("f"), F.lit(e).alias("e")) for e in range(epochs)]))
    copies = (m.select("size", "rank", "code", "doc_id", "budget", copy.alias("c"))
              .where(F.col("c.f").isNotNull() & (F.col("size") > 0))
              .select("size", "budget", "rank", "code", "doc_id", "c.f", "c.e", _slot(F.col("c.f"), n).alias("b")))
    # a row per range bucket, n + 1 of them at most
    sums = copies.groupBy("b").agg(F.sum("size").alias("s"), F.max("budget").alias("budget"))
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = sums.withColumn("upto", F.sum("s").over(up)).where(F.col("upto") > F.col("budget"))
    at = over.agg(F.min_by(F.struct("b", (F.col("upto") - F.col("s")).alias("before")), "b").alias("x")).first()["x"]
    if at is None:
        return None
    # rows of the one bucket in which the budget ends
    order = ["f", "rank", "code", "doc_id", "size", "e"]
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (copies.where(F.col("b") == at["b"])
            .withColumn("run", F.sum("size").over(run) + F.lit(at["before"]))
            .where(F.col("run") <= F.col("budget")).agg(F.max(F.struct(*order)).alias("x")).first()["x"])
    return {"n": n, "b": at["b"], "last": last}


def _served(cut: dict | None, epoch: int, id_type) -> Column:
    """1 if the row's copy of pass ``epoch`` stands no later than the cut, else 0."""
    if cut is None:
        return F.when(F.col("target") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    n, last, f = cut["n"], cut["last"], _finish(epoch)
    inside = F.lit(False)
    if last is not None:
        inside = F.struct(f.alias("f"), "rank", "code", "doc_id", "size", F.lit(epoch).alias("e")) <= F.struct(
            F.lit(last["f"]).alias("f"), F.lit(last["rank"]).alias("rank"), F.lit(last["code"]).alias("code"),
            F.lit(last["doc_id"]).cast(id_type).alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"),
            F.lit(last["e"]).alias("e"))
    return F.coalesce((_slot(f, n) < cut["b"]) | ((_slot(f, n) == cut["b"]) & inside), F.lit(False)).cast("long")


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed table: every row of ``df`` as often as the mix takes it."""
    rows = rows_where(taken_copies(df, row="__row", **options), F.col("copies") > 0)
    return (rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*unheld("__row", df.columns)))
