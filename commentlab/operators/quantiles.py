"""Exact quantiles of continuous columns by rank selection.

Spark's exact ``percentile`` keeps every distinct value in one task. Here no task holds more than ``HELD`` values:

1. Approximate percentiles (a sketch of bounded size) cut the values into some hundred ranges.
2. The values are counted per range, and in each range those equal to its lower bound; one row per range comes back.
3. A wanted rank lies in one range. If it falls on the lower bound it is that value, whatever the number of ties;
   otherwise the range above its bound is refined in the same way, until it holds few enough values to be sorted.

The values are written once as a table of one column, and each refinement reads it with the range as a filter that
reaches the scan.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.session import cut_lineage

HELD = 10_000  # values that are sorted together
RANGES = 256
_X = "_x"


def _cuts(values: DataFrame, ranges: int) -> list[float]:
    """Lower bounds of the ranges: the smallest value and approximate percentiles, all of them values that occur."""
    share = F.array(*[F.lit(i / ranges) for i in range(ranges + 1)])
    low, inner = values.agg(F.min(_X), F.percentile_approx(_X, share, F.lit(8 * ranges))).first()
    return sorted({low, *inner})


def _select(values: DataFrame, ranks: Sequence[int], n: int, held: int, ranges: int) -> dict[int, float]:
    """The values of 0-based ``ranks`` among the ``n`` rows of ``values``."""
    if n <= held:
        ordered = [r[0] for r in values.orderBy(_X).collect()]
        return {k: ordered[k] for k in ranks}
    cuts = _cuts(values, ranges)
    if len(cuts) > 1:
        parted = Bucketizer(splits=[*cuts, math.inf], inputCol=_X, outputCol="_part").transform(values)
    else:
        parted = values.withColumn("_part", F.lit(0.0))
    bound = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("_part").cast("int") + 1)
    counted = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(_X) == bound).cast("bigint")).alias("ties"))
    sizes = {int(r["_part"]): (r["n"], r["ties"]) for r in counted.collect()}
    parts = sorted(sizes)
    starts, total = [], 0
    for p in parts:
        starts.append(total)
        total += sizes[p][0]
    found: dict[int, float] = {}
    inside: dict[int, list[int]] = {}
    for k in ranks:
        at = bisect_right(starts, k) - 1
        if k - starts[at] < sizes[parts[at]][1]:
            found[k] = cuts[parts[at]]
        else:
            inside.setdefault(at, []).append(k)
    for at, wanted in inside.items():
        p = parts[at]
        above = values.where(F.col(_X) > cuts[p])
        if p + 1 < len(cuts):
            above = above.where(F.col(_X) < cuts[p + 1])
        before = starts[at] + sizes[p][1]
        got = _select(above, [k - before for k in wanted], sizes[p][0] - sizes[p][1], held, ranges)
        found |= {k: got[k - before] for k in wanted}
    return found


def _column(df: DataFrame, col: Column | str) -> DataFrame:
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    return cut_lineage(df.select(x.alias(_X)).where(F.col(_X).isNotNull() & ~F.isnan(_X)), "values")


def _quantiles(values: DataFrame, n: int, probs: Sequence[float], held: int, ranges: int) -> dict[float, float]:
    at = {p: p * (n - 1) for p in probs}
    ranks = sorted({r for h in at.values() for r in (math.floor(h), math.ceil(h))})
    found = _select(values, ranks, n, held, ranges)

    def between(h: float) -> float:
        low, high = found[math.floor(h)], found[math.ceil(h)]
        return low + (high - low) * (h - math.floor(h))

    return {p: between(h) for p, h in at.items()}


def exact_quantiles(df: DataFrame, col: Column | str, probs: Sequence[float], held: int = HELD, ranges: int = RANGES) -> DataFrame:
    """``(prob, value)``, linear interpolation between ranks; nulls and NaN take no part; without values the value is null."""
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    values = _column(df, col)
    n = values.count()
    found = _quantiles(values, n, probs, held, ranges) if n else dict.fromkeys(probs)
    return df.sparkSession.createDataFrame([(float(p), found[p]) for p in probs], "prob double, value double")


def describe_continuous(df: DataFrame, col: Column | str, held: int = HELD, ranges: int = RANGES) -> DataFrame:
    """E3 of a continuous column: count, mean, std (n-1), min, exact quartiles, max; one row."""
    values = _column(df, col)
    stats = values.agg(F.count(_X).alias("count"), F.avg(_X).alias("mean"), F.stddev_samp(_X).alias("std"), F.min(_X).alias("min"), F.max(_X).alias("max"))
    n = values.count()
    quartiles = _quantiles(values, n, (0.25, 0.5, 0.75), held, ranges) if n else {}
    named = [F.lit(quartiles.get(p)).cast("double").alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return stats.select("count", "mean", "std", "min", *named, "max")
