"""Ordered-series building blocks.

Two kinds of series occur. *Calendar series* (one row per player and game, or per team and game) come out of
an aggregation and are bounded by the number of days, however skewed the raw events are; they use plain
windows. *Event series* (all rows of a game) have no such bound: the ``width`` argument of
:func:`last_before` and :func:`running_state` cuts the order axis into ranges, summarises each
range with a partial aggregate, carries the summaries across ranges, and windows only inside a range. A key
holding a third of all rows is then spread over its ranges, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

UNBOUNDED = Window.unboundedPreceding


def series(keys: Sequence[str], order: Sequence[str]):
    """Window over one series."""
    return Window.partitionBy(*keys).orderBy(*order)


def trailing_means(df: DataFrame, keys, order, cols, widths, suffix: str = "_roll") -> DataFrame:
    """Mean of the previous ``w`` rows for each width; the row itself is left out, nulls are skipped."""
    w = series(keys, order)
    return df.withColumns(
        {f"{c}{suffix}{n}": F.avg(c).over(w.rowsBetween(-n, -1)) for c in cols for n in widths}
    )


def trailing_sums(df: DataFrame, keys, order, sums: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``{output: (column, w)}`` → sum of the previous ``w`` rows (null before the first)."""
    w = series(keys, order)
    return df.withColumns({out: F.sum(c).over(w.rowsBetween(-n, -1)) for out, (c, n) in sums.items()})


def expanding_means(df: DataFrame, keys, order, cols, suffix: str = "_season_avg") -> DataFrame:
    """Mean of all earlier rows of the series."""
    w = series(keys, order).rowsBetween(UNBOUNDED, -1)
    return df.withColumns({f"{c}{suffix}": F.avg(c).over(w) for c in cols})


def day_gap(df: DataFrame, keys, order, date: str, out: str = "rest_days", first: int = 7) -> DataFrame:
    """Whole days since the previous row of the series; ``first`` where there is none."""
    previous = F.lag(date).over(series(keys, order))
    return df.withColumn(out, F.coalesce(F.datediff(F.col(date), previous), F.lit(first)))


def change_runs(df: DataFrame, keys, order, col: str, run: str, position: str) -> DataFrame:
    """Number the runs of equal ``col`` values from 0 and the rows inside each run from 1."""
    w = series(keys, order)
    changed = F.when(F.col(col) != F.lag(col).over(w), 1).otherwise(0)
    numbered = df.withColumn("_changed", changed).withColumn(
        run, F.sum("_changed").over(w.rowsBetween(UNBOUNDED, 0)).cast("int")
    )
    return numbered.withColumn(position, F.row_number().over(series([*keys, run], order))).drop("_changed")


def ewma_means(
    df: DataFrame, keys, order, cols, alpha: float = 0.3, suffix: str = "_ewma"
) -> DataFrame:
    """Exponentially weighted mean of all earlier rows, weights decaying across null rows."""
    return ewma_series(df, keys, order, [([], cols, suffix)], alpha)


def ewma_series(
    df: DataFrame, keys, order, series: Sequence[tuple[Sequence[str], Sequence[str], str]], alpha: float = 0.3
) -> DataFrame:
    """Exponentially weighted means of several kinds in one pass: for each (runs, columns, suffix) of ``series`` the means
    start over with each key and with each value of the runs, which do not come back in a key's order.

    A mean hangs on the mean before it, which no window expresses. Rows are hashed by key and sorted, and a task streams them in
    Arrow batches: all series of a batch advance together, row by row, and one state per column is carried to the next batch.
    """
    runs = list(dict.fromkeys(r for own, _, _ in series for r in own))
    added = [(f"{c}{suffix}", [*keys, *own], c) for own, cols, suffix in series for c in cols]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *runs, *order)
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name, _, _ in added]])
    return rows.mapInArrow(_ewma_stream(added, 1.0 - alpha, alpha), schema)


def _ewma_stream(added: list[tuple[str, list[str], str]], decay: float, alpha: float):
    kinds = [list(k) for k in dict.fromkeys(tuple(k) for _, k, _ in added)]
    names = {tuple(k): [c for _, own, c in added if own == k] for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            means = {}
            for k in kinds:
                x = [batch.column(c).cast(pa.float64(), safe=False) for c in names[tuple(k)]]
                values = np.stack([c.to_numpy(zero_copy_only=False) for c in x], axis=1)
                known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in x], axis=1)
                key = [batch.column(c) for c in k]
                last, state = carried.get(tuple(k), (None, None))
                follows = last is not None and all(own[0].equals(v) for own, v in zip(key, last))
                y, there, state = _ewma_batch(values, known, _starts(key), state if follows else None, decay, alpha)
                carried[tuple(k)] = [own[-1] for own in key], state
                means |= {(tuple(k), c): pa.array(y[:, i], mask=~there[:, i]) for i, c in enumerate(names[tuple(k)])}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[means[tuple(k), c] for _, k, c in added]],
                                             names=[*batch.schema.names, *[name for name, _, _ in added]])
    return run


def _starts(key: list[pa.Array]) -> np.ndarray:
    """Row numbers at which a batch's series begin."""
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in key]
    return np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [c[1:] != c[:-1] for c in codes])]))


def _ewma_batch(values, known, starts, state, decay: float, alpha: float):
    """Means before each row of a batch, which of them there are, and the state (mean, weight, whether there is one) after the
    last row; the first series goes on from the given state."""
    sizes = np.diff([*starts, len(values)])
    y, w = np.zeros((len(starts), values.shape[1])), np.ones((len(starts), values.shape[1]))
    has = np.zeros(y.shape, bool)
    if state is not None:
        y[0], w[0], has[0] = state
    out, there = np.empty(values.shape), np.empty(values.shape, bool)
    longest = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[longest], -np.arange(1, sizes.max() + 1), side="right")
    for place, n in enumerate(left):
        s = longest[:n]                     # the series that have a row at this place
        at = starts[s] + place
        old, weight, mean, x, new = has[s], w[s] * decay, y[s], values[at], known[at]
        out[at], there[at] = mean, old
        moved = np.where(old, (weight * mean + alpha * x) / (weight + alpha), x)
        y[s], w[s], has[s] = np.where(new, moved, mean), np.where(new | ~old, 1.0, weight), old | new
    return out, there, (y[-1].copy(), w[-1].copy(), has[-1].copy())


def latest_values(df: DataFrame, keys, order, cols) -> DataFrame:
    """Last non-null value per column, each on its own, as one partial aggregate (no window, no full sort)."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols if c not in keys]
    )


def latest_in_series(df: DataFrame, keys, order, cols) -> DataFrame:
    """What :func:`latest_values` gives, for calendar series: carried along each series in its order, whose last row is kept.
    One sort serves all columns, and rows that are already hashed by part of the key are not shuffled again."""
    w = series(keys, order)
    so_far = w.rowsBetween(UNBOUNDED, 0)
    carried = [F.last(c, ignorenulls=True).over(so_far).alias(c) for c in cols if c not in keys]
    return df.select(*keys, *carried, F.lead(F.lit(True)).over(w).alias("_more")).where("_more IS NULL").drop("_more")


def first_values(df: DataFrame, keys, order, cols) -> DataFrame:
    """First non-null value per column, each on its own."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols if c not in keys]
    )


def top_rows(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First ``n`` rows per key; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _ranges(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn("_rng", F.floor(F.col(order) / F.lit(width)))


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    width: int | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add, per name, the last non-null value among the earlier rows (``inclusive``: and the row itself)."""
    keys = list(keys)
    end = 0 if inclusive else -1
    if width is None:
        w = series(keys, [order]).rowsBetween(UNBOUNDED, end)
        return df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()})
    names = list(values)
    work = _ranges(df.withColumns({f"_v_{n}": v for n, v in values.items()}), order, width)
    tails = work.groupBy(*keys, "_rng").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_c_{n}") for n in names]
    )
    across = series(keys, ["_rng"]).rowsBetween(UNBOUNDED, -1)
    carried = tails.select(
        *keys, "_rng", *[F.last(f"_c_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in names]
    )
    inside = series([*keys, "_rng"], [order]).rowsBetween(UNBOUNDED, end)
    joined = work.join(carried, [*keys, "_rng"], "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")).alias(n)
            for n in names
        ],
    )


def running_state(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    ahead: Mapping[str, str],
    width: int | None = None,
) -> DataFrame:
    """Add running sums up to and including each row (``sums``) and values of the following row (``ahead``)."""
    keys = list(keys)
    following = F.struct(*[F.col(c).alias(n) for n, c in ahead.items()])
    if width is None:
        w = series(keys, [order])
        added = {n: F.sum(c).over(w.rowsBetween(UNBOUNDED, 0)) for n, c in sums.items()}
        return df.withColumns(added | {n: F.lead(c).over(w) for n, c in ahead.items()})
    work = _ranges(df, order, width)
    pieces = work.groupBy(*keys, "_rng").agg(
        F.min_by(following, order).alias("_head"), *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()]
    )
    across = series(keys, ["_rng"])
    carried = pieces.select(
        *keys, "_rng", F.lead("_head").over(across).alias("_head"),
        *[F.sum(f"_c_{n}").over(across.rowsBetween(UNBOUNDED, -1)).alias(f"_c_{n}") for n in sums],
    )
    inside = series([*keys, "_rng"], [order])
    joined = work.join(carried, [*keys, "_rng"], "left")
    joined = joined.withColumn("_next", F.coalesce(F.lead(following).over(inside), F.col("_head")))
    return joined.select(
        *df.columns,
        *[
            (F.sum(c).over(inside.rowsBetween(UNBOUNDED, 0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n, c in sums.items()
        ],
        *[F.col(f"_next.{n}").alias(n) for n in ahead],
    )
