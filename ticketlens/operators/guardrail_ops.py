"""Table-level guardrail operators (G8 as a DataFrame step, G12, G13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.guardrails import (LEGAL_KEYWORDS, PII_RULES, SEVERE_KEYWORDS,
                                             check_escalation, keyword_hits, pii_test)
from ticketlens.functions.text import let


def with_guardrails(df: DataFrame, text_col: str, prefix: str = "_g_", lexicon=SEVERE_KEYWORDS,
                    legal=LEGAL_KEYWORDS, whole_word: bool = False) -> tuple[DataFrame, Column, dict]:
    """Add the lower-cased text, the four PII flags and one keyword-hit array as
    columns, each computed once per row; returns (frame, low column, flags).

    ``flags`` maps each PII kind to its boolean column and ``flags["kw"]`` maps
    every lexicon and legal keyword to an element of the hit array; pass it as
    ``hits=`` to the keyword rules. Rule expressions reference these columns
    many times; as separate projections they are not inlined back
    (CollapseProject keeps multiply-referenced, non-cheap expressions apart), so
    each regex, each keyword search and the lower-casing run once per row.
    """
    t = F.col(text_col)
    out = df.withColumn(f"{prefix}low", F.lower(t))
    for kind, pattern, _ in PII_RULES:
        out = out.withColumn(f"{prefix}{kind}", pii_test(kind, pattern, t))
    words = list(dict.fromkeys([k for k, _ in lexicon] + list(legal)))
    out = out.withColumn(f"{prefix}kw", keyword_hits(F.col(f"{prefix}low"), words, whole_word))
    flags = {kind: F.col(f"{prefix}{kind}") for kind, _, _ in PII_RULES}
    flags["kw"] = {w: F.col(f"{prefix}kw")[i] for i, w in enumerate(words)}
    return out, F.col(f"{prefix}low"), flags


def with_escalation(df: DataFrame, text_col: str, out: str = "guard",
                    lexicon=SEVERE_KEYWORDS, whole_word: bool = False) -> DataFrame:
    """Attach the G8 struct once; downstream steps read ``out.flag`` / ``out.reason``."""
    return df.withColumn(out, check_escalation(F.col(text_col), lexicon, whole_word))


def running_sums(lengths: Column) -> Column:
    """Sums of an array up to and including each element. An array that grows by one
    element a step is copied at every step; here it grows within blocks of about the square root of
    its length, so 100,000 elements cost what 300 arrays of 300 do."""
    def grown(xs: Column, start: Column) -> Column:
        none = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(xs, none, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"] + x)).alias("sums")),
                           lambda s: s["sums"])

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
        starts = F.concat(F.array(F.lit(0).cast("long")), grown(totals, F.lit(0)))
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, j: grown(b, F.get(at, j)))))

    def cut(xs: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        last = F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / step).cast("int")
        return let(step, lambda n: F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(xs, j * n + 1, n)))

    return let(lengths, lambda xs: let(cut(xs), by_blocks))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, leftmost first, in code points from 0, end exclusive.
    A match ends where the pieces and matches before it and itself end."""
    def located(found: Column) -> Column:
        pieces = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda p: F.length(p).cast("long"))
        ends = running_sums(F.zip_with(pieces, found, lambda p, m: p + F.length(m)))
        return F.when(F.size(found) > 0, F.zip_with(ends, found, lambda e, m: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), located)


def pii_hits(df: DataFrame, id_col: str, text_col: str, rules=PII_RULES) -> DataFrame:
    """One row per PII match: (id, kind, ordinal, start, end, match), positions in code points from 0.

    Per-row arrays + ``explode``; no shuffle, nearly linear in the matches. The reference
    only tests existence; this is the audit form of the same patterns. A null text has none.
    """
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), spans(F.col(text_col), pattern).alias("m")) for kind, pattern, _ in rules])
    per_kind = df.select(F.col(id_col), F.explode(kinds).alias("k"))
    return per_kind.select(id_col, F.col("k.kind").alias("kind"), F.posexplode("k.m").alias("ordinal", "hit")).select(
        id_col, "kind", (F.col("ordinal") + 1).cast("int").alias("ordinal"), "hit.start", "hit.end", "hit.match")


def guardrail_profile(df: DataFrame, text_col: str, lexicon=SEVERE_KEYWORDS,
                      whole_word: bool = False) -> DataFrame:
    """Rows per (flag, reason) — partial aggregation map-side, tiny shuffle."""
    d, low, flags = with_guardrails(df.select(text_col), text_col, lexicon=lexicon, legal=[],
                                    whole_word=whole_word)
    g = check_escalation(F.col(text_col), lexicon, whole_word, low=low, flags=flags, hits=flags["kw"])
    return d.select(g.alias("g")).groupBy(F.col("g.flag").alias("flag"),
                                           F.col("g.reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
