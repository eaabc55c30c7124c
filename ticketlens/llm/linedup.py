"""Line dedup by an exact set-similarity join.

The words of a line are a set. Two lines match at a Jaccard similarity of
``threshold`` or more; a line is removed if it matches an earlier one (by
document id, then line number), whether or not that one is itself removed.

1. Rarity: words are counted over all lines in ``2 ** SKETCH_BITS`` counters.
   A word's order key is its counter's level above 47 bits of its hash, so that
   sorting the keys puts rare words first, in one order for all lines.
2. Lines with equal sets are one class, of which only the first line can stay.
3. Prefix filter: of a pair's shorter class the first ``n - ceil(2t/(1+t) * n) + 1``
   keys and of its longer class the first ``n - ceil(t * n) + 1`` share one, or they
   cannot match. Classes are joined on those keys, under the length filter, the
   positional filter (from the first shared key on both need enough words, so a pair
   passes at that key or not at all) and a bitmap filter (each word flips one of 128
   bits; the bits that differ are no more than the words that differ). Sets of under
   four words (at 0.8) match equal sets only.
4. Candidates fetch their sets - only lines that are candidates are tokenised
   again - and, if a wider bitmap of both does not rule the pair out, Jaccard is
   verified exactly.

Steps 3 and 4 run more than once. First each class meets only the earliest class
under each of its last ``LEADING`` prefix keys, the ones a group of near copies
shares: a row per key, so a group decides most of its members without pairing them.
Then the classes left under a crowded key meet ``LEADERS`` early ones of those.
The classes not removed by that meet all earlier classes, removed ones included.

Scale: a row per prefix key, not per word; pairs only between classes, so a
line that a third of all documents hold is one row. The joins are sort-merge
joins, whose hot keys Spark splits; the sketch has a fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import SPACE, stored, text_of

THRESHOLD = 0.8
SKETCH_BITS = 18
LEADING = 3
CROWD, LEADERS = 32, 64  # classes that make a key crowded, and the leaders that each of them meets there
ROUNDING = 1e-6
WIDE = 4  # longs of the bitmap before sets are compared
BROADCAST_BYTES = 32 << 20


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int")


def _words(line: Column) -> Column:
    """Lower-case words of a line. Split at a plain space, which takes no pattern, unless it has another separator."""
    low = F.lower(line)
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(low, SPACE)).otherwise(F.split(low, " ")), "")


def levels(df: DataFrame, text: str) -> Column:
    """Rarity level of each counter (eight levels a doubling of its count), as an
    array literal of fixed length."""
    word = df.select(F.explode(F.split(text_of(text), "\n")).alias("line")).select(F.explode(_words(F.col("line"))).alias("w"))
    counts = word.groupBy(_slot(F.xxhash64("w")).alias("slot")).agg(F.floor(8 * F.log2(F.count(F.lit(1)))).alias("level"))
    blocks = counts.groupBy(F.shiftright("slot", 10).alias("block")).agg(
        F.collect_list("slot").alias("slots"), F.collect_list("level").alias("levels"))
    got = [0] * (1 << SKETCH_BITS)
    for r in blocks.collect():  # a number for each counter at most, whatever the input
        for slot, level in zip(r.slots, r.levels):
            got[slot] = level
    return F.from_json(F.lit("[" + ",".join(map(str, got)) + "]"), "array<int>")


def lines_of(df: DataFrame, text: str, key: str) -> DataFrame:
    """``doc, line_no, line`` of every line with a word."""
    d = df.select(F.col(key).alias("doc"), F.posexplode_outer(F.split(text_of(text), "\n")).alias("line_no", "line"))
    return d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def with_keys(lines: DataFrame, table: Column) -> DataFrame:
    """``lines`` with ``keys``: the order keys of its distinct words, rarest first."""
    def order_key(h):
        level = F.coalesce(F.get(table, _slot(h)), F.lit(0)).cast("long")
        return F.shiftleft(level, 47).bitwiseOR(F.shiftrightunsigned(h, 17))
    # one hash a word, and elements that are never null: sort_array then runs on plain longs
    hashes = F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))
    return lines.withColumn("keys", F.sort_array(F.array_distinct(F.transform(hashes, order_key))))


def _up(x: Column) -> Column:
    """Least integer not below ``x``, rounding errors aside (a bound that is too low
    keeps a filter right; ``round`` of doubles costs far more)."""
    return F.ceil(x - ROUNDING).cast("int")


def prefix_length(n: Column, threshold: float = THRESHOLD) -> Column:
    return n - _up(n * threshold) + 1


def _least_overlap(n: Column, m: Column, threshold: float) -> Column:
    """Common words that sets of these sizes need."""
    return _up((n + m) * (threshold / (1 + threshold)))


def _can_match(n: Column, m: Column, apart: Column, threshold: float) -> Column:
    """Length and bitmap filter for sets of ``n`` and ``m`` words with ``apart``
    different bits; never holds for a negative size."""
    return ((F.least(n, m) >= F.greatest(n, m) * threshold - ROUNDING)
            & (apart <= n + m - 2 * _least_overlap(n, m, threshold)))


def _bitmap(keys: str, longs: int) -> list[Column]:
    """``b0, b1, ...``: ``longs`` (a power of 2) times 64 bits, of which each key flips one."""
    return [F.expr(f"aggregate({keys}, 0L, (b, k) -> CASE WHEN (shiftright(k, 6) & {longs - 1}) = {i} "
                   "THEN b ^ shiftleft(1L, cast(k & 63 AS INT)) ELSE b END)").alias(f"b{i}") for i in range(longs)]


def _differing(a: str, b: str, longs: int) -> Column:
    return reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(longs)])


def _narrow(keys: str) -> list[Column]:
    """A bitmap of 128 bits as ``m0``, one bit flipped by each key, and ``m1``, the
    same of the keys of the upper half alone."""
    return [F.expr(f"aggregate({keys}, 0L, (m, k) -> m ^ shiftleft(1L, cast(k & 63 AS INT)))").alias("m0"),
            F.expr(f"aggregate({keys}, 0L, (m, k) -> m ^ shiftleft(shiftright(k, 6) & 1L, cast(k & 63 AS INT)))").alias("m1")]


def _narrow_differing(a: str, b: str) -> Column:
    both, upper = (F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}")) for m in ("m0", "m1"))
    return F.bit_count(both.bitwiseXOR(upper)) + F.bit_count(upper)


def _sets(pairs: DataFrame, table: Column, df: DataFrame, text: str, key: str) -> DataFrame:
    """The places of ``pairs`` (x, y) as ``at``, and of their lines the word ``set``, its size ``n`` and a bitmap."""
    col = F.col
    wanted = stored(pairs.select(F.explode(F.array("x", "y")).alias("at")).distinct(), "line-ends")
    if wanted.count() * 40 <= BROADCAST_BYTES:
        # texts without such a line are not cut into lines
        df = df.join(F.broadcast(wanted.select(col("at.doc").alias("__wanted")).distinct()), col(key).eqNullSafe(col("__wanted")), "left_semi")
        wanted = F.broadcast(wanted)
    lines = lines_of(df, text, key).alias("l").join(wanted.alias("w"), col("l.doc").eqNullSafe(col("w.at.doc")) & (col("l.line_no") == col("w.at.line_no")))
    sets = with_keys(lines.select("at", "line"), table).select("at", col("keys").alias("set")).dropDuplicates(["at"])
    # a wider bitmap, so that few pairs carry their sets along
    return stored(sets.select("at", "set", F.size("set").alias("n"), *_bitmap("set", WIDE)), "line-sets")


def _matching(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``y`` of those ``pairs`` (x, y) whose Jaccard similarity, of the whole word
    sets, reaches ``threshold``."""
    col = F.col
    wide = sets.drop("set")
    near = stored(pairs.join(wide.alias("a"), col("x") == col("a.at")).join(wide.alias("b"), col("y") == col("b.at"))
                  .where(_can_match(col("a.n"), col("b.n"), _differing("a", "b", WIDE), threshold)).select("x", "y"), "near-pairs")
    both = F.size(F.array_intersect("xs", "ys"))
    return (near.join(sets.select(col("at").alias("x"), col("set").alias("xs")), "x")
            .join(sets.select(col("at").alias("y"), col("set").alias("ys")), "y")
            .where(both >= F.round(threshold * (F.size("xs") + F.size("ys") - both), 6)).select("y").distinct())


def _led(entries: DataFrame, threshold: float, leaders: int = 1) -> DataFrame:
    """Pairs (x, y): each of ``entries`` as ``y`` and as ``x`` the earliest under its
    token, or the earliest of each of ``leaders`` parts of that token's."""
    col = F.col
    leads = entries.groupBy("token", F.pmod(F.xxhash64("first"), F.lit(leaders)).alias("part")).agg(F.min(F.struct("first", "n", "m0", "m1")).alias("b"))
    pairs = entries.alias("a").join(leads.drop("part"), "token").where((col("b.first") < col("a.first"))
                                                                       & _can_match(col("a.n"), col("b.n"), _narrow_differing("a", "b"), threshold))
    return stored(pairs.select(col("b.first").alias("x"), col("a.first").alias("y")).distinct(), "led-pairs")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of places, broadcast while it is small."""
    return F.broadcast(df) if df.count() * 40 <= BROADCAST_BYTES else df


def _decided(classes: DataFrame, table: Column, df: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """``y``: places of the classes that a leader decides."""
    col = F.col
    tail = F.slice("prefix", -F.least(F.size("prefix"), F.lit(LEADING)), F.lit(LEADING))
    entries = classes.select("first", "n", "m0", "m1", F.explode(tail).alias("token"))
    led = _led(entries, threshold)
    late = stored(_matching(led, _sets(led, table, df, text, key), threshold), "led")
    crowded = stored(entries.groupBy("token").count().where(col("count") >= CROWD).select("token"), "crowded")
    entries = stored(entries.join(_small(crowded), "token", "left_semi").join(_small(late), col("first") == col("y"), "left_anti"), "undecided")
    led = _led(entries, threshold, LEADERS)
    return late.union(stored(_matching(led, _sets(led, table, df, text, key), threshold), "led"))


def removed_lines(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc, line_no)`` of the lines that match an earlier one. Rows of one
    ``key`` have to have one text."""
    col = F.col
    n = F.size("keys")
    # the low bits of a key are those of the word's hash
    short = F.transform(F.slice("keys", 1, prefix_length(n, threshold)), lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int"))
    table = levels(df, text)
    slim = stored(with_keys(lines_of(df, text, key), table).select(
        "doc", "line_no", F.xxhash64("keys").alias("class"), n.alias("n"), *_narrow("keys"), short.alias("prefix")), "lines")
    place = F.struct("doc", "line_no")
    classes = slim.groupBy("class").agg(F.min(F.struct("doc", "line_no", "n", "m0", "m1", "prefix")).alias("r"), F.count(F.lit(1)).alias("lines"))
    classes = stored(classes.select("class", F.struct("r.doc", "r.line_no").alias("first"), "r.n", "r.m0", "r.m1", "r.prefix", "lines"), "line-classes")
    # the smallest size that can match a set of another size
    least = next(i for i in range(1, 1000) if i / (i + 1) >= threshold - 1e-9)
    several = classes.where(col("n") >= least)
    late = _decided(several, table, df, text, key, threshold)

    # One exchange serves both sides, so both use the same columns and no filter is one side's
    # alone: a class that is decided already has a negative size, which no set can match as ``a``.
    known = late.select(col("y"), F.lit(True).alias("__late"))
    marked = several.join(_small(known), col("first") == col("y"), "left")
    every = marked.select("first.doc", "first.line_no", F.when(col("__late"), -col("n")).otherwise(col("n")).alias("n"), "m0", "m1",
                          F.posexplode("prefix").alias("at", "token"))
    every = every.select("token", "doc", "line_no", "n", (F.abs("n") - col("at")).alias("rest"), "m0", "m1")
    a, b = every.alias("a"), every.alias("b")
    an, bn = col("a.n"), F.abs("b.n")
    # positional filter: the words from the pair's first shared key on suffice in both
    fits = ((F.least("a.rest", "b.rest") >= _least_overlap(an, bn, threshold))
            & _can_match(an, bn, _narrow_differing("a", "b"), threshold)
            & (F.struct("b.doc", "b.line_no") < F.struct("a.doc", "a.line_no")))
    pairs = stored(a.join(b, (col("a.token") == col("b.token")) & fits)
                   .select(F.struct("b.doc", "b.line_no").alias("x"), F.struct("a.doc", "a.line_no").alias("y")).distinct(), "line-pairs")
    late = late.union(_matching(pairs, _sets(pairs, table, df, text, key), threshold)).withColumn("late", F.lit(True))
    cut = (classes.join(late, col("first") == col("y"), "left").where(col("late").isNotNull() | (col("lines") > 1)).select("class", "first", "late"))
    return slim.select("doc", "line_no", "class").join(cut, "class").where(col("late").isNotNull() | (place != col("first"))).select("doc", "line_no")


def _told_apart(df: DataFrame, text: str, key: str) -> DataFrame:
    """``df`` with ``__doc``, the same only for rows of one id and one text, and
    ``__copy``, true for all rows of a ``__doc`` but one. While ids are unique, ``__doc`` is
    the id; else the id and a 128-bit hash of the text."""
    if not df.groupBy(F.col(key).alias("id")).count().where("count > 1").limit(1).count():
        return df.withColumn("__doc", F.col(key)).withColumn("__copy", F.lit(False))
    t = text_of(text)
    d = df.withColumn("__doc", F.struct(F.col(key).alias("id"), F.xxhash64(t).alias("h0"), F.xxhash64(F.lit(1), t).alias("h1")))
    several = stored(d.groupBy("__doc").count().where("count > 1").select(F.col("__doc").alias("__id")), "several")
    same = F.col("__doc").eqNullSafe(F.col("__id"))
    # only rows that are there more than once are written, so that their numbers hold
    rows = stored(d.join(several, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "repeated-rows")
    first = rows.groupBy(F.col("__doc").alias("__id")).agg(F.min("__row").alias("__first"))
    copies = rows.join(first, same).withColumn("__copy", F.col("__row") != F.col("__first")).drop("__id", "__row", "__first")
    return d.join(several, same, "left_anti").withColumn("__copy", F.lit(False)).union(copies)


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``clean_text`` (without the removed lines), ``n_lines`` and
    ``n_removed`` (lines with a word, and those of them removed).

    Lines without a word stay. A null text is empty; null ids come first. Rows
    that share an id, or have none, are documents of their own, in the order of
    a hash of their texts; of rows that share the text too, all but one lose every
    line. An empty table stays empty. Columns of these names are replaced.
    """
    df = _told_apart(df.drop("clean_text", "n_lines", "n_removed", "__id", "__cut", "__all", "__doc", "__copy", "__row", "__first"), text, key)
    cuts = removed_lines(df.select("__doc", text), text, "__doc", threshold).groupBy("doc").agg(F.collect_set("line_no").alias("__cut"))
    cuts = stored(cuts.select(F.col("doc").alias("__id"), "__cut"), "cuts")
    size = cuts.select(F.sum(40 + 8 * F.size("__cut")).alias("b")).first()["b"] or 0
    d = df.join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, F.col("__doc").eqNullSafe(F.col("__id")), "left")
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    d = d.withColumn("__all", F.split(text_of(text), "\n"))
    places = F.sequence(F.lit(0), F.size("__all") - 1)
    d = d.withColumn("__cut", F.when(F.col("__copy"), F.filter(places, lambda i: worded(F.get("__all", i))))
                     .otherwise(F.coalesce("__cut", F.array().cast("array<int>"))))
    kept = F.transform(F.array_except(places, "__cut"), lambda i: F.get("__all", i))
    return (d.withColumn("n_lines", F.size(F.filter("__all", worded)).cast("long"))
            .withColumn("n_removed", F.size("__cut").cast("long"))
            .withColumn("clean_text", F.when(F.size("__cut") > 0, F.array_join(kept, "\n")).otherwise(text_of(text)))
            .drop("__id", "__cut", "__all", "__doc", "__copy"))
