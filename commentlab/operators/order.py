"""Global order without a single-task window (S1–S6, W6, W7, B7 and the scans used by W1–W4 and E13).

``row_number().over(Window.orderBy(...))`` with no partition runs in one task. Everything here instead
range-partitions the rows, numbers/scans them inside each range in parallel, and adds the totals of the
earlier ranges, which form a table of at most one row per (range, group) — small and broadcastable by
construction. The range-partitioned frame is checkpointed to the shared folder before the range number is
used twice, so a recomputed task cannot move a row to a different range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlab.session import cut_lineage

_PID = "_range_id"
_PLACE = "_range_place"


def _cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_ranges(df: DataFrame, num_ranges: int | None) -> int:
    if num_ranges:
        return num_ranges
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, sort: list[Column], num_ranges: int | None) -> DataFrame:
    """Sorted ranges, written once, each row with its range number and its 0-based place inside the range."""
    parted = df.repartitionByRange(_num_ranges(df, num_ranges), *sort).sortWithinPartitions(*sort)
    # the id is (partition << 33) + place in the partition, taken in the task that sorts the range
    place = F.monotonically_increasing_id()
    numbered = parted.withColumn(_PLACE, place)
    return cut_lineage(
        numbered.select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.shiftrightunsigned(_PLACE, 33).cast("int").alias(_PID),
            F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1)).alias(_PLACE),
        )
    )


def global_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    rank_col: str = "rank",
    total_col: str | None = None,
    num_ranges: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in the total order ``order`` (pass a unique order).

    ``total_col`` optionally adds the row count of the whole frame, so callers need no separate action.
    One shuffle of the rows: each range numbers its rows in the task that sorted it, and the sizes of the
    earlier ranges are added.
    """
    sort = _cols(order)
    ranged = _ranged(df, sort, num_ranges)
    sizes = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        _PID,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"),
    )
    # one row per range: bounded by the number of ranges, never by the data
    out = ranged.join(F.broadcast(offsets), _PID).withColumn(rank_col, F.col(_PLACE) + F.col("_offset") + F.lit(1))
    if total_col:
        out = out.withColumn(total_col, F.col("_total"))
    return out.drop(_PID, _PLACE, "_offset", "_total")


_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def segmented_scan(
    df: DataFrame,
    partition_by: Sequence[str],
    order: Sequence[Column | str],
    scans: dict[str, tuple[str, Column | str, bool]],
    row_number_col: str | None = None,
    num_ranges: int | None = None,
) -> DataFrame:
    """Running aggregates per group in a total order, parallel even when one group holds most rows.

    ``scans`` maps an output name to ``(fn, column, inclusive)`` with fn in sum/count/max/min;
    ``inclusive=False`` gives the value over the rows strictly before. ``row_number_col`` adds the
    1-based position inside the group. Order must be unique within a group. Rows whose group columns are
    NULL form a group of their own, as in GROUP BY.
    """
    sort = [F.col(c) for c in partition_by] + _cols(order)
    ranged = _ranged(df, sort, num_ranges)
    here = ranged
    totals_aggs = []
    if scans:
        seg = Window.partitionBy(_PID, *partition_by).orderBy(*_cols(order))
        for name, (fn, col, inclusive) in scans.items():
            c = F.col(col) if isinstance(col, str) else col
            frame = seg.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            here = here.withColumn(f"_here_{name}", _AGG[fn](c).over(frame))
            totals_aggs.append(_AGG[fn](c).alias(f"_tot_{name}"))
    # a row's number in its group needs no window: its place in the range, less the group's first place there
    totals = ranged.groupBy(_PID, *partition_by).agg(*totals_aggs, F.count(F.lit(1)).alias("_tot_rn"), F.min(_PLACE).alias("_first"))
    earlier = Window.partitionBy(*partition_by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    fns = {name: scans[name][0] for name in scans} | {"rn": "count"}
    # totals of earlier ranges: counts and sums add up, max/min combine as themselves
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    # at most one row per (range, group), written so that the planner knows its size
    offsets = totals.select(
        *[F.col(f"`{c}`").alias(f"_key_{c}") for c in [_PID, *partition_by]],
        "_first",
        *[merge[fn](f"_tot_{n}").over(earlier).alias(f"_before_{n}") for n, fn in fns.items()],
    )
    offsets = cut_lineage(offsets, "range-totals")
    same = F.col(_PID) == F.col(f"_key_{_PID}")
    for c in partition_by:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_key_{c}`"))
    out = here.join(offsets, same)
    for name in scans:
        out = out.withColumn(name, _COMBINE[fns[name]](F.col(f"_before_{name}"), F.col(f"_here_{name}")))
    if row_number_col:
        out = out.withColumn(row_number_col, F.coalesce("_before_rn", F.lit(0)) + F.col(_PLACE) - F.col("_first") + 1)
    drop = [_PID, _PLACE, "_first", "_before_rn", *[f"_key_{c}" for c in [_PID, *partition_by]]]
    return out.drop(*drop, *[f"_here_{n}" for n in scans], *[f"_before_{n}" for n in scans])


def shuffle_key(id_col: Column | str, seed: int | str) -> Column:
    """Deterministic pseudo-random sort key, identical in Spark and in SQL engines: md5('<seed>:<id>')."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def head_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (unique). Every task keeps its own first ``n``, one task merges them, so
    nothing is shuffled or sorted beyond ``n`` rows a task; ``n`` is a parameter of a size that one task holds."""
    return df.orderBy(*_cols(order)).limit(n)


def tail_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Last ``n`` rows in ``order`` (unique), nulls first as in a rising sort, in the same way."""
    return df.orderBy(*[c.desc_nulls_last() for c in _cols(order)]).limit(n)


def ordered_split(
    df: DataFrame, order: Sequence[Column | str], val_fraction: float = 0.2, split_col: str = "split"
) -> DataFrame:
    """S3: the first ``int(val_fraction * n)`` rows in ``order`` are 'val', the rest 'train'."""
    ranked = global_rank(df, order, rank_col="_pos", total_col="_n")
    cut = F.floor(F.col("_n") * F.lit(val_fraction))
    return ranked.withColumn(split_col, F.when(F.col("_pos") <= cut, "val").otherwise("train")).drop("_pos", "_n")


def shuffled_split(
    df: DataFrame, id_col: str, seed: int = 666, val_fraction: float = 0.2, split_col: str = "split"
) -> DataFrame:
    """Exact-size seeded split; order = md5(seed:id), ties by id."""
    return ordered_split(df, [shuffle_key(id_col, seed), F.col(id_col)], val_fraction, split_col)


def three_way_split(
    df: DataFrame, id_col: str, seed: int = 666, val_fraction: float = 0.2, test_fraction: float = 0.2, split_col: str = "split"
) -> DataFrame:
    """S4 with a third part: in the seeded order first 'val', then 'test', the rest 'train', all of exact sizes."""
    ranked = global_rank(df, [shuffle_key(id_col, seed), F.col(id_col)], rank_col="_pos", total_col="_n")
    val = F.floor(F.col("_n") * F.lit(val_fraction))
    test = val + F.floor(F.col("_n") * F.lit(test_fraction))
    part = F.when(F.col("_pos") <= val, "val").when(F.col("_pos") <= test, "test").otherwise("train")
    return ranked.withColumn(split_col, part).drop("_pos", "_n")


def shuffled_order(df: DataFrame, id_col: str, seed: int = 666, order_col: str = "ord") -> DataFrame:
    """1-based shuffled position of every row."""
    return global_rank(df, [shuffle_key(id_col, seed), F.col(id_col)], rank_col=order_col)


def batches(df: DataFrame, order: Sequence[Column | str], batch_size: int = 64, batch_col: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in ``order``; the short last batch is kept."""
    ranked = global_rank(df, order, rank_col="_pos")
    return ranked.withColumn(batch_col, F.floor((F.col("_pos") - 1) / batch_size).cast("bigint")).drop("_pos")


def batches_overlap_tail(
    df: DataFrame, order: Sequence[Column | str], batch_size: int = 64, batch_col: str = "batch_id"
) -> DataFrame:
    """Full batches, then always one more batch made of the last ``batch_size`` rows."""
    ranked = global_rank(df, order, rank_col="_pos", total_col="_n")
    full = F.floor(F.col("_n") / batch_size)
    body = ranked.where(F.col("_pos") <= full * batch_size).withColumn(
        batch_col, F.floor((F.col("_pos") - 1) / batch_size).cast("bigint")
    )
    tail = ranked.where(F.col("_pos") > F.col("_n") - batch_size).withColumn(batch_col, full.cast("bigint"))
    return body.unionByName(tail).drop("_pos", "_n")


def sample_every_n(df: DataFrame, step_col: str, n: int, keep: int = 0) -> DataFrame:
    """Periodic sampling of a step series: rows with ``step % n == keep``."""
    return df.where(F.col(step_col) % n == keep)
