"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs
before an exact hash join.

* ``rules``: the longest rule that fits a URL's host (or a parent domain) and
  the start of its path gives the verdict.
* ``listed``: canonical URLs of a list are hashed into blocks of 256 bits (four
  longs) by ``bit_or``; a page passes if all its bits are set in its block.
  Only pages that pass go to the exact join with the list, which removes the
  false positives. Pages that do not pass are proven absent.

Scale: the filter takes about 16 bits a listed URL. It is broadcast only while
its counted size is below ``BROADCAST_BYTES``; beyond that it is joined by
block with a shuffle, hot blocks spread over salted copies. The exact join
meets a hot URL once: pages that pass are reduced to distinct canonical URLs
before it, and the confirmed URLs are joined back to the pages that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import hold_row, stored, unheld

BROADCAST_BYTES = 64 << 20
URLS_PER_BLOCK = 16      # 256 bits a block: 16 bits a URL
PROBES = 6
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid|sessionid"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _after(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    cut = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    path = F.when(F.instr(cut, "/") > 0, F.substr(cut, F.instr(cut, "/"))).otherwise(F.lit(""))
    return F.coalesce(F.when(F.instr(url, "://") > 0, path), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a trailing slash or
    ``.html``, remaining query parameters sorted; scheme, fragment and tracking
    parameters dropped. Without ``://`` there is no host or path, and all that
    stands before the query is kept as it is. Null for null."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(\.html?)?/*$", "")
    cut = F.substring_index(url, "#", 1)
    query = F.when(F.instr(cut, "?") > 0, F.substr(cut, F.instr(cut, "?") + 1)).otherwise(F.lit(""))
    args = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)"))
    place = F.when(F.instr(url, "://") > 0, F.concat(host, path)).otherwise(F.substring_index(cut, "?", 1))
    return F.when(url.isNotNull(), F.concat(place, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(args), "&")))
                                            .otherwise(F.lit(""))))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path of the longest
    rule that fits, else null) and ``rule_verdict``. ``rules`` are (verdict,
    host, path); a rule fits its host and all subdomains, if the path starts
    with the rule's. Of rules of equal length the longer host wins, then block."""
    host, path = F.col("host"), F.col("path")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (v, h, p) in reversed(list(zip(fits, order, strict=True))):
        rule = F.when(fit, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fit, F.lit(v)).otherwise(verdict)
    return (df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
            .withColumn("rule", rule).withColumn("rule_verdict", verdict))


def _bits(canon: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block and four words of bit masks of a canonical URL."""
    h, g = F.xxhash64(canon), F.xxhash64(canon, F.lit(1))
    at = [F.shiftrightunsigned(g, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for a in at:
            # shift counts are taken modulo 64
            word = word.bitwiseOR(F.when((a / 64).cast("int") == w, F.call_function("shiftleft", F.lit(1).cast("long"), a % 64)).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.pmod(h, F.lit(blocks)), words


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0..w3)`` of a table with a column ``canon``."""
    block, words = _bits(F.col("canon"), blocks)
    d = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return d.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def listed_flag(df: DataFrame, listed: DataFrame, url: str = "url", name: str = "listed") -> DataFrame:
    """``df`` with a boolean ``name``: its canonical URL is in the column
    ``canon`` of ``listed`` (null and repeated entries are ignored; an empty
    list matches nothing). A null URL is not listed. Extra columns pass
    through; repeated rows stay repeated."""
    held, names = hold_row(df, "__r")
    listed = stored(listed.select("canon").where(F.col("canon").isNotNull()).distinct(), "listed")
    n = listed.count()
    blocks = max(1, -(-n // URLS_PER_BLOCK))
    block, words = _bits(F.col("canon"), blocks)
    rows = held.withColumn("canon", canonical(F.col("__r").getField(url))).withColumn("block", block)
    filt = bloom(listed, blocks)
    if blocks * 40 <= BROADCAST_BYTES:
        probed = rows.join(F.broadcast(filt), "block", "left")
    else:
        salts = 16
        filt = filt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        probed = rows.withColumn("salt", F.floor(F.rand(7) * salts).cast("int")).join(filt, ["block", "salt"], "left").drop("salt")
    passes = F.lit(True)
    for i, w in enumerate(words):
        passes = passes & (F.col(f"w{i}").bitwiseAND(w) == w)
    probed = probed.select("__r", "canon", F.coalesce(passes & F.col("canon").isNotNull(), F.lit(False)).alias("passes"))
    # exact: distinct passing URLs against the list, then back to their rows;
    # rows that do not pass are proven absent and stay out of the joins
    hits = (probed.where("passes").select("canon").distinct()
            .join(listed, "canon", "left_semi").withColumn("hit", F.lit(True)))
    found = (probed.where("passes").join(hits, "canon", "left").select("__r", F.coalesce("hit", F.lit(False)).alias("hit"))
             .union(probed.where(~F.col("passes")).select("__r", F.lit(False).alias("hit"))))
    return found.select(*unheld("__r", names), F.col("hit").alias(name))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host, path, rule, listed, verdict``: the rule's verdict, or
    without a rule ``block`` for a listed URL and ``allow`` for any other.
    Columns of those names in ``df`` are replaced."""
    df = df.drop("host", "path", "rule", "rule_verdict", "listed", "verdict")
    d = listed_flag(with_rule(df, rules, url), listed, url)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return d.withColumn("verdict", F.coalesce("rule_verdict", method)).drop("rule_verdict")
