"""Sample-wise signal operators on long tables (keys, frame, value).

Operators of bounded reach are windows over the keys they are given. A few very long recordings would make
a few very long tasks: ``chunked`` cuts them into pieces that carry a halo of neighbouring rows, runs any
of these operators on (keys, chunk), and keeps each row once. Operators of unbounded reach scan chunks
themselves (``operators/chunks.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.operators.chunks import CHUNK, filled, neighbours
from onsetlab.staging import positions, with_same


def chunked(df: DataFrame, by: list[str], frame: str, rows: int, halo: int, work: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Apply ``work(df, keys)`` to chunks of ``rows`` consecutive frames with ``halo`` frames around.

    Exact for operators that look at most ``halo`` rows away, where frames are consecutive numbers.
    """
    if halo > rows:
        raise ValueError(f"a halo of {halo} rows is more than a chunk of {rows}")
    chunk = F.floor(F.col(frame) / rows)
    edge = F.col(frame) - chunk * rows
    copies = F.array_compact(F.array(
        chunk, F.when(edge < halo, chunk - 1), F.when(edge >= rows - halo, chunk + 1)
    ))
    cut = df.withColumn("_chunk", F.explode(copies))
    done = work(cut, [*by, "_chunk"])
    return done.filter(F.floor(F.col(frame) / rows) == F.col("_chunk")).drop("_chunk")


def centered(window: int) -> tuple[int, int]:
    """Row bounds of a centred window; an even one leans back by one row."""
    return -(window // 2), (window - 1) // 2


def _rows(by: list[str], order: str, lo: int, hi: int) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(lo, hi)


def boxcar(df: DataFrame, by: list[str], order: str, value: str, window: int, out: str) -> DataFrame:
    """Centred mean over ``window`` rows; null unless the whole window is there."""
    w = _rows(by, order, *centered(window))
    return df.withColumn(out, F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def rolling_extreme(df: DataFrame, by: list[str], order: str, value: str, window: int, out: str, largest: bool = True) -> DataFrame:
    """Centred rolling maximum (or minimum) over ``window`` rows; null unless the whole window is there.

    The rows of a key are cut into blocks of the window's length, and the extreme runs forward and backward
    inside each block. A window meets at most two blocks, so it is the backward one at its first row and the
    forward one at its last: the cost of a row does not depend on the window. ``order`` counts rows.
    """
    lo, hi = centered(window)
    extreme, both = (F.max, F.greatest) if largest else (F.min, F.least)
    block = Window.partitionBy(*by, "_block")
    upto = (Window.unboundedPreceding, 0)
    there = F.count(value)
    rows = df.withColumn("_block", F.floor(F.col(order) / window))
    rows = rows.withColumns({n: f.over(block.orderBy(order).rowsBetween(*upto)) for n, f in (("_head", extreme(value)), ("_heads", there))})
    rows = rows.withColumns({n: f.over(block.orderBy(F.desc(order)).rowsBetween(*upto)) for n, f in (("_tail", extreme(value)), ("_tails", there))})
    w = Window.partitionBy(*by).orderBy(order)
    first = F.lag(F.struct("_tail", "_tails", "_block"), -lo).over(w) if lo else F.struct("_tail", "_tails", "_block")
    last = F.lead(F.struct("_head", "_heads", "_block"), hi).over(w) if hi else F.struct("_head", "_heads", "_block")
    rows = rows.withColumns({"_a": first, "_b": last})
    n = F.when(F.col("_a._block") == F.col("_b._block"), F.col("_a._tails")).otherwise(F.col("_a._tails") + F.col("_b._heads"))
    whole = n == window
    rows = rows.withColumn(out, F.when(whole, both(F.col("_a._tail"), F.col("_b._head"))))
    return rows.drop("_block", "_head", "_heads", "_tail", "_tails", "_a", "_b")


def rolling_range(df: DataFrame, by: list[str], order: str, value: str, max_window: int, min_window: int, out: str) -> DataFrame:
    """Centred rolling maximum less centred rolling minimum; null unless both windows are whole. ``order`` counts rows."""
    rows = rolling_extreme(df, by, order, value, max_window, "_high")
    rows = rolling_extreme(rows, by, order, value, min_window, "_low", largest=False)
    return rows.withColumn(out, F.col("_high") - F.col("_low")).drop("_high", "_low")


def activity(df: DataFrame, by: list[str], order: str, value: str, rate: float, out: str) -> DataFrame:
    """|change| per millisecond at ``rate`` samples a second; 0 on the first row."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.abs(F.col(value) - F.lag(value).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn(out, F.when(first, F.lit(0.0)).otherwise(change * F.lit(rate / 1000)))


def trailing_mean(df: DataFrame, by: list[str], order: str, value: str, window: int, out: str) -> DataFrame:
    """Mean of the last ``window`` rows, nulls skipped, from the first row on."""
    return df.withColumn(out, F.avg(value).over(_rows(by, order, 1 - window, 0)))


def every_kth(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Every k-th row of each key, the first included."""
    return positions(df, by, [order], "_n", "every-kth").filter(F.col("_n") % k == 0).drop("_n")


def resampled(df: DataFrame, by: list[str], x: str, values: list[str], step: float = 1.0, through_last: bool = False, bucket: float | None = None) -> DataFrame:
    """Values on the grid of multiples of ``step``, linear between neighbouring samples.

    The grid runs from the first sample up to, but without, the last grid point (``through_last`` keeps it).
    Each pair of neighbours makes its own grid points, so nothing is gathered by recording; neighbours are
    found bucket by bucket (65,536 steps, unless given). Times must not repeat in a key.
    """
    here = F.struct(F.col(x).alias("_y"), *[F.col(v).alias(f"_next_{v}") for v in values])
    ahead = neighbours(df.select(*by, x, *values), by, x, here, "_ahead", bucket or CHUNK * step, ahead=True)
    ahead = with_same(ahead, df.groupBy(*by).agg(F.max(x).alias("_end")), by)
    ahead = ahead.select(*by, F.col(x).alias("_x"), *values, "_end", "_ahead.*")
    lo = F.ceil(F.col("_x") / F.lit(step))
    hi = F.coalesce(F.ceil(F.col("_y") / F.lit(step)) - 1, F.floor(F.col("_x") / F.lit(step)))
    stop = F.floor(F.col("_end") / F.lit(step)) - (0 if through_last else 1)
    hi = F.least(hi, stop)
    grid = ahead.withColumn("_k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("_k") * F.lit(step)
    share = F.coalesce(F.try_divide(at - F.col("_x"), F.col("_y") - F.col("_x")), F.lit(0.0))
    blend = [F.when(share == 0, F.col(v)).otherwise(F.col(v) + (F.col(f"_next_{v}") - F.col(v)) * share).alias(v) for v in values]
    return grid.select(*by, F.col("_k").alias("grid_no"), at.alias(x), *blend)


def position_interpolated(df: DataFrame, by: list[str], order: str, value: str, out: str, rows: int = CHUNK) -> DataFrame:
    """Fill nulls linearly by row position between the neighbours that are there; the last value goes on.

    ``order`` counts rows. Gaps may be longer than a chunk of ``rows``.
    """
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("n"), F.col(value).alias("v")))
    df = filled(df, by, order, point, "_a", rows)
    df = filled(df, by, order, point, "_b", rows, ahead=True)
    share = F.try_divide(F.col(order) - F.col("_a.n"), F.col("_b.n") - F.col("_a.n"))
    blend = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.coalesce(share, F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_b").isNull(), F.col("_a.v")).otherwise(blend)).drop("_a", "_b")


def rebased(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The column less its least value in the key."""
    least = df.groupBy(*by).agg(F.min(column).alias("_least"))
    return with_same(df, least, by).withColumn(column, F.col(column) - F.col("_least")).drop("_least")


def uniform_clock(df: DataFrame, by: list[str], order: str, step: float, out: str, start: Column | float = 0.0) -> DataFrame:
    begin = start if isinstance(start, Column) else F.lit(float(start))
    return positions(df, by, [order], "_n", "uniform-clock").withColumn(out, begin + F.col("_n") * F.lit(float(step))).drop("_n")


def gap_marks(df: DataFrame, by: list[str], frame: str, out: str = "after_gap") -> DataFrame:
    """Whether the frame number jumps by more than one here."""
    near = neighbours(df, by, frame, F.col(frame), "_before")
    return near.withColumn(out, F.coalesce(F.col(frame) - F.col("_before") > 1, F.lit(False))).drop("_before")
