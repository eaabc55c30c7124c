"""Exact quantiles by histogram refinement.

The wanted ranks are found from counts alone. A round cuts every interval that still holds a
wanted rank into ``bins`` and counts its rows per bin; the bin a rank falls in is the next
interval. The first round cuts by sign and logarithm, so that an interval holds
values of one magnitude, the later ones evenly. After a few rounds (at most seven, for any
doubles) an interval is one value or has at most ``leaf_rows`` rows, which are read.

Scale: a round is one scan of one narrow stored column and a partial aggregate of at most ``bins``
counters a wanted rank, whatever the number of distinct values; these counters are
what comes back to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import stored

BINS = 4096
LEAF_ROWS = 4096


def _magnitude(v: Column) -> Column:
    """Sign and logarithm on one ascending scale (smallest double: exp(-745))."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + F.lit(746.0)))


def _bin(v: Column, lo: float, hi: float, bins: int, even: bool) -> Column:
    """Number of the bin of ``v`` in ``[lo, hi]``: never smaller for a larger value."""
    if even:
        half = 1.0 if math.isfinite(hi - lo) else 0.5  # the width of all doubles is none
        share = (v * half - lo * half) / F.lit(hi * half - lo * half)
    else:
        share = (_magnitude(v) + F.lit(1456.0)) / F.lit(2912.0)
    return F.greatest(F.lit(0), F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")


def values_at(d: DataFrame, ranks: Sequence[int], lo: float, hi: float, rows: int, bins: int = BINS,
              leaf_rows: int = LEAF_ROWS) -> dict[int, float]:
    """The values at ``ranks`` (from 0) of the finite column ``v`` of ``d``."""
    out: dict[int, float] = {}
    # an interval: its ends, the rows below it, its rows
    wanted = {r: (lo, hi, 0, rows) for r in ranks}
    even = False
    while True:
        for r, (a, b, _, _) in wanted.items():
            if a == b:
                out[r] = a
        wanted = {r: x for r, x in wanted.items() if r not in out}
        small = {x for x in wanted.values() if x[3] <= leaf_rows}
        for a, b, below, _ in small:
            here = sorted(x["v"] for x in d.where(F.col("v").between(a, b)).collect())
            out |= {r: here[r - below] for r, x in wanted.items() if x == (a, b, below, len(here))}
        wanted = {r: x for r, x in wanted.items() if r not in out}
        if not wanted:
            return out
        cuts = sorted(set(wanted.values()))
        v, place = F.col("v"), None
        for i, (a, b, _, _) in enumerate(cuts):  # intervals are apart, or one and the same
            case = F.struct(F.lit(i).alias("i"), _bin(v, a, b, bins, even).alias("bin"))
            place = F.when(v.between(a, b), case) if place is None else place.when(v.between(a, b), case)
        counts = d.select("v", place.alias("p")).where("p IS NOT NULL").groupBy("p.i", "p.bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "bin").collect()
        for r, x in list(wanted.items()):
            below = x[2]
            for c in counts:
                if c["i"] == cuts.index(x):
                    if r < below + c["n"]:
                        wanted[r] = (c["lo"], c["hi"], below, c["n"])
                        break
                    below += c["n"]
        even = True


def exact_quantiles(df: DataFrame, value: Column | str, fractions: Sequence[float], bins: int = BINS,
                    leaf_rows: int = LEAF_ROWS) -> list[float | None]:
    """Quantiles with linear interpolation between ranks, as the ``percentile`` aggregate gives them. Nulls
    are left out, NaN counts as the largest value; without a value every quantile is None."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = stored(df.select(v.alias("v")).where("v IS NOT NULL"), "quantile-values")
    x, inf = F.col("v"), float("inf")
    finite = ~F.isnan(x) & (F.abs(x) < inf)
    head = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(x == -inf).alias("low"), F.count_if(finite).alias("rows"),
                 F.count_if(x == inf).alias("high"), F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")).first()
    n = head["n"]
    if not n:
        return [None] * len(fractions)
    places = [(n - 1) * f for f in fractions]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    inner = [r - head["low"] for r in ranks if head["low"] <= r < head["low"] + head["rows"]]
    found = values_at(d.where(finite), inner, head["lo"], head["hi"], head["rows"], bins, leaf_rows) if inner else {}

    def at(r: int) -> float:
        if r < head["low"]:
            return -inf
        if r - head["low"] in found:
            return found[r - head["low"]]
        return inf if r < head["low"] + head["rows"] + head["high"] else math.nan

    out = []
    for p in places:
        a, b = at(math.floor(p)), at(math.ceil(p))
        out.append(a if a == b or p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out
