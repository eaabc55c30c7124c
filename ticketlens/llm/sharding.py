"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Law: ``rows`` (shard sizes differ by at most one). Row ``r`` of ``n`` goes to
position ``p = permute(r)``, shard ``p % shards``, slot ``p // shards``; both
are computable from ``r``, ``n`` and the seed alone (``position``).

* Global row numbers: rows are dealt to buckets by a hash of their order
  columns, buckets are counted, and a row's number is the rows of earlier
  buckets plus its rank in its bucket. The numbering depends on the rows only,
  not on files or partitions, so a rerun or a recomputed partition agrees.
* Permutation: ``rounds`` Feistel rounds over a square of side ``ceil(sqrt n)``;
  values at or above ``n`` walk on until they fall below it. Fewer than
  ``2 * side + 1`` values lie outside, so the longest walk is found exactly on the driver
  and the column expression repeats just that often.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import bucket_count, hold_row, text_of, unheld

PRIME = 2**31 - 1  # products of two residues stay below 2^62
ROUNDS = 8


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three residues a round, from SHA-256 of the seed and the round."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append(tuple(1 + int.from_bytes(d[k:k + 8], "big") % (PRIME - 1) for k in (0, 8, 16)))
    return out


def _permute_once(x: int, side: int, keys: list[tuple[int, int, int]]) -> int:
    left, right = divmod(x, side)
    for a, b, c in keys:
        f = (right * a + b) % PRIME * ((right + c) % PRIME) % PRIME
        left, right = right, (left + f) % side
    return left * side + right


def position(row: int, n: int, seed: int = 0) -> int:
    """Position of global row ``row`` among ``n`` (plain Python, for one row)."""
    side, keys = max(1, math.isqrt(n - 1) + 1), round_keys(seed)
    x = _permute_once(row, side, keys)
    while x >= n:
        x = _permute_once(x, side, keys)
    return x


def longest_walk(n: int, seed: int = 0) -> int:
    """Most rounds of the permutation that any row needs: one more than the
    longest chain of values outside ``[0, n)``, of which there are under
    ``2 * sqrt(n) + 1``."""
    side, keys = max(1, math.isqrt(n - 1) + 1) if n else 1, round_keys(seed)
    exits: dict[int, int] = {}
    for start in range(n, side * side):
        chain, x = [], start
        while x >= n and x not in exits and x not in chain:
            chain.append(x)
            x = _permute_once(x, side, keys)
        steps = exits.get(x, 0) if x >= n and x in exits else 0
        for v in reversed(chain):
            steps += 1
            exits[v] = steps
    return 1 + max(exits.values(), default=0)


def permute(row: Column, n: int, seed: int = 0) -> Column:
    """``position`` as a column expression."""
    side = max(1, math.isqrt(n - 1) + 1) if n else 1
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"),
                              F.lit(c).cast("long").alias("c")) for a, b, c in round_keys(seed)])

    def turn(s, k):
        f = (s.r * k.a + k.b) % PRIME * ((s.r + k.c) % PRIME) % PRIME
        return F.struct(s.r.alias("l"), ((s.l + f) % side).alias("r"))

    def once(x):
        start = F.struct(((x - x % side) / side).cast("long").alias("l"), (x % side).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s.l * side + s.r)

    walks = longest_walk(n, seed)
    x = once(row)
    if walks == 1:
        return x
    return F.aggregate(F.sequence(F.lit(2), F.lit(walks)), x,
                       lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))


def numbered(df: DataFrame, order: list[Column], total: int | None = None, name: str = "row") -> DataFrame:
    """``df`` with a global row number from 0 in column ``name``: reproducible,
    gapless, in no meaningful order. ``order`` are columns that fix the order
    (rows equal in all of them are interchangeable)."""
    total = df.count() if total is None else total
    n = bucket_count(total)
    held, names = hold_row(df.select("*", F.pmod(F.xxhash64(*order), F.lit(n)).alias("__b"),
                                     *[c.alias(f"__o{i}") for i, c in enumerate(order)]), "__r")
    names = names[:len(df.columns)]
    rows = held.select("__r", F.col("__r").getField("__b").alias("__b"))
    sums = df.select(F.pmod(F.xxhash64(*order), F.lit(n)).alias("__b")).groupBy("__b").count()
    # at most 65,536 rows (bucket_count), so one task and a broadcast are bounded
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__b", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__start"))
    inner = Window.partitionBy("__b").orderBy(*[F.col("__r").getField(f"__o{i}").asc_nulls_first() for i in range(len(order))])
    return (rows.join(F.broadcast(starts), "__b")
            .select("__r", (F.col("__start") + F.row_number().over(inner) - 1).alias("__n"))
            .select(*unheld("__r", names), F.col("__n").alias(name)))


def deal(df: DataFrame, order: list[Column], shards: int = 16, seed: int = 0) -> DataFrame:
    """Every row of ``df`` with its ``shard`` (0 to ``shards`` - 1) and its
    ``slot`` in the shard, gapless from 0; shard sizes differ by at most one.
    ``order`` are the columns that identify a row (rows equal in all of them
    are interchangeable). An empty table stays empty; columns of ``df`` named
    ``shard`` or ``slot`` are replaced, all others pass through."""
    df = df.drop("shard", "slot", "__row", "__p")
    n = df.count()
    p = F.col("__p")
    return (numbered(df, order, n, "__row")
            .withColumn("__p", permute(F.col("__row"), n, seed))
            .withColumn("shard", (p % shards).cast("int"))
            .withColumn("slot", ((p - p % shards) / shards).cast("long"))
            .drop("__p", "__row"))


def shard(df: DataFrame, shards: int = 16, seed: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``deal`` of documents, identified by key, checksum and length of the
    text. Null keys and texts are ordinary values (a null text is empty);
    repeated rows are numbered like any others."""
    return deal(df, [F.col(key), F.crc32(text_of(text).cast("binary")), F.octet_length(text_of(text))], shards, seed)
