"""Join helpers with explicit size checks and skew handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension side is broadcast only below this many rows and bytes (both measured).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20
ROW_OVERHEAD = 48
DEFAULT_SALTS = 32


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row of ``df`` takes in memory."""
    total = F.lit(ROW_OVERHEAD).cast("long")
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.StringType):
            size = 8 + F.octet_length(c)
        elif isinstance(t, T.BinaryType):
            size = 8 + F.length(c)
        elif isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            size = 24 + 8 * F.size(c)
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            size = 24 + 2 * F.octet_length(F.to_json(c))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(8))
    return total


def dimension_join(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner",
                   max_broadcast_rows: int = BROADCAST_MAX_ROWS, max_broadcast_bytes: int = BROADCAST_MAX_BYTES,
                   salts: int = DEFAULT_SALTS, salt_source: Column | None = None) -> DataFrame:
    """Join a large, possibly skewed ``fact`` side to a lookup ``dim`` on ``on``.

    The dimension is measured first: at or below ``max_broadcast_rows`` and
    ``max_broadcast_bytes`` it is broadcast (no shuffle of the fact side, so a
    hot key costs nothing extra). Above either, the join is salted: each fact row
    gets a salt in [0, salts) (from ``salt_source`` — e.g. a row id — or a hash
    of the fact row) and the dimension is replicated once per salt, so one hot
    key is spread over ``salts`` tasks. Results are identical either way.
    """
    rows, size = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(dim)), F.lit(0))).first()
    if rows <= max_broadcast_rows and size <= max_broadcast_bytes:
        return fact.join(F.broadcast(dim), on, how)
    src = salt_source if salt_source is not None else F.xxhash64(*[F.col(c) for c in fact.columns])
    salted = fact.withColumn("_salt", F.pmod(src, F.lit(salts)).cast("int"))
    dim_rep = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(dim_rep, on + ["_salt"], how).drop("_salt")
