"""Quality rules: line-first cleaning.

Every line is held against three kinds of rules - punctuation (runs of symbols,
shouting), navigation (menu separators close together, lists of links) and boilerplate (fixed
phrases in short lines). Failing lines are removed, then a document that lost
too large a part of its characters is rejected.

A pure projection beside the scan: no shuffle, whole texts, JVM only. The
eight-word windows are compared by 64-bit hashes within their own text (a window's hash is that of the hashes of its halves).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import text_of, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOSS = 0.3

# Runs of symbols close to each other, or shouted marks.
SYMBOL_RUNS = "[#*$%&<>=~^]{2,}" + "[^#*$%&<>=~^]{1,60}[#*$%&<>=~^]{2,}" * 4
SHOUTING = "[!?]{2,}[^!?]+[!?]{2,}[^!?]+[!?]{2,}"
# Three separators of menu entries.
MENU = "[|»›•·][^|»›•·]*[|»›•·][^|»›•·]*[|»›•·]"
# A line of those is a menu or shouting only if they are close together: at most so many characters of it for each.
SPACING = 80
SEPARATORS, SHOUTS = "[|»›•·]", "[!?]{2,}"
# Quotation marks in pairs, the French way and then the German one, separate nothing.
QUOTES = ("«([^«»]*)»", "»([^«»]*)«", "‹([^‹›]*)›", "›([^‹›]*)‹")
TABLE_ROW = r"^[\x20\x09-\x0D]*\|.*\|[\x20\x09-\x0D]*$"
MARKS = "[#*$%&<>=~^!?|»›•·]"  # a line without any passes the three patterns above
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "lorem ipsum", "click here to", "subscribe to our", "accept cookies")
BOILERPLATE_CHARS = 200
WORDED = r"[^\x20\x09-\x0D]"


def line_kept(line: Column) -> Column:
    """Whether a line passes; a line without a word always does."""
    bare = reduce(lambda x, quoted: F.regexp_replace(x, quoted, "$1"), QUOTES, line)
    dense = lambda n: F.length(line) <= SPACING * n
    marks = F.regexp_count(bare, F.lit(SEPARATORS))
    menu = F.when(line.rlike(MENU), (marks >= 3) & dense(marks) & ~line.rlike(TABLE_ROW)).otherwise(F.lit(False))
    shouting = F.when(line.rlike(SHOUTING), dense(F.regexp_count(line, F.lit(SHOUTS)))).otherwise(F.lit(False))
    marked = line.rlike(SYMBOL_RUNS) | shouting | menu
    phrase = (F.length(line) <= BOILERPLATE_CHARS) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return ~(marked | phrase)


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed``.

    A null text counts as empty: all counts 0, ``base_failed`` true. Repeated
    rows are judged each on its own; an empty table stays empty. Columns of
    these names in ``df`` are replaced, other extra columns pass through.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = df.drop(*names, "__t", "__w", "__h", "__s", "__p")
    keep = [F.col(f"`{c}`") for c in d.columns]
    d = d.select(*keep, text_of(text).alias("__t")).withColumn("__w", words_of(F.col("__t")))
    w, t = F.col("__w"), F.col("__t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORDED))
    counts = [F.size(w).cast("long").alias("n_words"),
              F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
              F.when(t.rlike("[#*$%&|<>]"), F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")))
              .otherwise(F.lit(0)).cast("long").alias("n_symbols"),
              (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]
    # one projection a doubling, so that none is evaluated twice
    d = d.select(*keep, *counts, F.transform(w, lambda x: F.xxhash64(x)).alias("__h"))
    h, width = F.col("__h"), 1
    while width < WINDOW:
        d = d.withColumn("__h", F.zip_with(h, F.slice(h, width + 1, F.size(h)), lambda x, y: F.xxhash64(x, y)))
        width *= 2
    d = d.withColumn("__h", F.when(F.col("n_words") > WINDOW, F.slice(h, 1, F.greatest(F.col("n_words") - WINDOW + 1, F.lit(1)).cast("int"))))
    # only texts with a window twice are sorted
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    d = d.withColumn("__s", ordered).drop("__h")
    s = F.col("__s")
    twins = F.filter(s, lambda x, i: F.coalesce(x.h == F.get(s, i - 1).h, F.lit(False))
                     | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False)))
    d = d.withColumn("__p", F.array_sort(F.transform(twins, lambda x: x.i))).drop("__s")
    p = F.col("__p")
    # a window adds its words up to the start of the next such window
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                          F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def clean(df: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``signals`` plus ``clean_text`` (the lines that pass, joined by line
    feeds), ``n_lines`` and ``n_removed`` (lines with a word, and those of them that fail),
    ``lost_chars`` (characters of removed lines) and ``kept``: not
    ``base_failed`` and at most ``max_loss`` of the characters lost."""
    d = signals(df.drop("clean_text", "n_lines", "n_removed", "lost_chars", "kept", "__t", "__low", "__lines", "__good"), text)
    t, low = F.col("__t"), F.col("__low")
    d = d.withColumn("__t", text_of(text)).withColumn("__low", F.lower("__t"))
    suspect = t.rlike(MARKS)
    for p in BOILERPLATE:
        suspect = suspect | low.contains(p)
    # a text without any mark or phrase keeps all its lines
    d = d.withColumn("__lines", F.split("__t", "\n")).withColumn("__good", F.when(suspect, F.filter("__lines", line_kept)))
    d = d.withColumn("clean_text", F.when(F.size("__good") < F.size("__lines"), F.array_join("__good", "\n")).otherwise(t))
    d = d.withColumn("n_lines", F.size(F.filter("__lines", lambda x: x.rlike(WORDED))).cast("long")) \
        .withColumn("n_removed", F.coalesce(F.size("__lines") - F.size("__good"), F.lit(0)).cast("long")) \
        .withColumn("lost_chars", (F.length(t) - F.length("clean_text")).cast("long")) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_loss * F.length(t)))
    return d.drop("__t", "__low", "__lines", "__good")
