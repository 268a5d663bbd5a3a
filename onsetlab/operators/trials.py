"""Trials around stimuli: cutting, block dimensions, windows, scaling and response features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab import staging
from onsetlab.functions.columns import clip
from onsetlab.operators.intervals import range_join
from onsetlab.staging import with_same


def numbered_stimuli(events: DataFrame, by: list[str], order: list[str], number: str = "trial_no") -> DataFrame:
    return events.withColumn(number, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cut_trials(
    samples: DataFrame, stimuli: DataFrame, by: list[str], t: str, onset: str, lo: float, hi: float,
    axis: str = "time", rate: float = 1.0,
) -> DataFrame:
    """Samples of each stimulus's window, with ``rel`` = t - onset; overlapping windows repeat samples.

    ``axis="position"`` numbers the rows of a trial from ``lo`` instead, at ``rate`` rows per unit, so a
    trial whose head is missing is shifted.
    """
    rows = range_join(samples, stimuli, by, t, onset, lo, hi)
    if axis == "position":
        w = Window.partitionBy(*by, onset).orderBy(t)
        rows = rows.withColumn("rel", F.lit(lo) + (F.row_number().over(w) - 1) / F.lit(rate))
    elif axis != "time":
        raise ValueError(f"no axis {axis!r}")
    return rows


def window(t: Column | str, lo: float, hi: float, closed: str = "both") -> Column:
    """t in [lo, hi]; ``closed`` names the closed ends: both, left, right or neither."""
    t = F.col(t) if isinstance(t, str) else t
    low = t >= lo if closed in ("both", "left") else t > lo
    return low & (t <= hi if closed in ("both", "right") else t < hi)


def windows(baseline: float, response: tuple[float, float], align: str = "CS") -> dict[str, tuple[float, float]]:
    """Baseline and response windows; aligned to the US both lie ``response[1]`` before its onset."""
    shift = response[1] if align == "US" else 0.0
    return {"baseline": (-baseline - shift, -shift), "response": (response[0] - shift, response[1] - shift)}


def contiguous_blocks(first: int, size: int, names: list[str]) -> list[tuple[int, str, int]]:
    """(block_order, block_name, trial_no) of blocks of ``size`` trials from ``first`` on."""
    return [(k, name, first + k * size + i) for k, name in enumerate(names) for i in range(size)]


def block_names(count: int, base: list[str] | None = None, own: list[str] | None = None) -> list[str]:
    """Names of ``count`` blocks: the base names, else the own ones, where their number fits; base names that are
    cut in two become Early and Late, in more parts are numbered; else the blocks are just numbered."""
    base, own = base or [], own or []
    for names in (base, own):
        if names and len(names) == count:
            return list(names)
    if base and count % len(base) == 0:
        parts = count // len(base)
        told = (lambda n: [f"Early {n}", f"Late {n}"]) if parts == 2 else (lambda n: [f"{n} part {i + 1}" for i in range(parts)])
        return [name for n in base for name in told(n)]
    return [f"Block {i + 1}" for i in range(count)]


def chosen_blocks(chosen: list[str], names: list[str], base: list[str] | None = None) -> list[str]:
    """Those of the chosen blocks that exist; chosen base names stand for all their parts; all blocks, if none fits."""
    found = [c for c in chosen if c in names]
    if not found and base and len(names) % len(base) == 0:
        parts = len(names) // len(base)
        found = [n for c in chosen if c in base for n in names[base.index(c) * parts : (base.index(c) + 1) * parts]]
    return list(dict.fromkeys(found)) or list(names)


def select_trials(df: DataFrame, trial_set: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """The rows of the trials in ``trial_set`` (catch trials, for example), or with ``keep=False`` of all others."""
    return df.join(trial_set.select(*on).distinct(), on, "left_semi" if keep else "left_anti")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_order_of(df: DataFrame, column: str, values: list, then: list | None = None) -> DataFrame:
    """Rows sorted by the place of ``column`` in a list of values, those not in it last, with the place as ``place``."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return df.withColumn("place", F.nullif(place, F.lit(0)).cast("int")).orderBy(F.col("place").asc_nulls_last(), *(then or []))


def with_blocks(trials: DataFrame, blocks: DataFrame, keys: list[str], keep_outside: bool = False) -> DataFrame:
    """Look up each trial's block in the (small) block dimension; trials in no block go, unless kept with nulls."""
    return trials.join(blocks, keys, "left" if keep_outside else "inner")


def block_of(trial_no: Column | str, size: int) -> Column:
    trial_no = F.col(trial_no) if isinstance(trial_no, str) else trial_no
    return F.ceil(trial_no / size).cast("int")


def response_features(
    samples: DataFrame, keys: list[str], t: str, value: str, baseline: tuple[float, float], response: tuple[float, float],
    max_missing: float | None = None, closed: str = "both",
) -> DataFrame:
    """Per trial: mean_baseline, mean_response and nv = response / baseline, in one aggregate.

    Nulls are left out of the means; with ``max_missing`` a window in which a larger share is null gives
    null. A baseline of 0 gives null.
    """
    parts = {"baseline": window(t, *baseline, closed), "response": window(t, *response, closed)}
    aggregates = []
    for name, inside in parts.items():
        aggregates += [
            F.avg(F.when(inside, F.col(value))).alias(f"mean_{name}"),
            (1 - F.avg(F.when(inside, F.col(value).isNotNull().cast("double")))).alias(f"missing_{name}"),
        ]
    out = samples.groupBy(*keys).agg(*aggregates)
    if max_missing is not None:
        for name in parts:
            enough = F.col(f"missing_{name}") <= max_missing
            out = out.withColumn(f"mean_{name}", F.when(enough, F.col(f"mean_{name}")))
    return out.withColumn("nv", F.try_divide("mean_response", "mean_baseline"))


def baseline_scaled(
    samples: DataFrame, keys: list[str], t: str, value: str, before: float, out: str, quantiles: tuple[float, float] = (0.1, 0.9),
    exact: bool = True,
) -> DataFrame:
    """(value - q_lo) / (q_hi - q_lo), clipped to [0, 1], with the quantiles of the trial's rows at t < before."""
    base = F.when(F.col(t) < before, F.col(value))
    if exact:
        ranges = staging.quantiles(samples, keys, base, list(quantiles), "_q", "baseline-scaled")
    else:
        ranges = samples.groupBy(*keys).agg(F.percentile_approx(base, F.array(*map(F.lit, quantiles))).alias("_q"))
    lo, hi = F.element_at("_q", 1), F.element_at("_q", 2)
    return with_same(samples, ranges, keys).withColumn(out, clip(F.try_divide(F.col(value) - lo, hi - lo), 0.0, 1.0)).drop("_q")


def baseline_subtracted(
    samples: DataFrame, keys: list[str], t: str, value: str, baseline: tuple[float, float], out: str,
    center: str = "median", limits: tuple[float, float] | None = None,
) -> DataFrame:
    """The value less its median (or mean) in the trial's baseline window, clipped where limits are given."""
    inside = F.when(window(t, *baseline), F.col(value))
    if center == "median":
        level = staging.median(samples, keys, inside, "_level", "baseline-subtracted")
    else:
        level = samples.groupBy(*keys).agg(F.avg(inside).alias("_level"))
    x = F.col(value) - F.col("_level")
    return with_same(samples, level, keys).withColumn(out, clip(x, *limits) if limits else x).drop("_level")


def without_early_us(samples: DataFrame, t: str, us_begin: str, value: str, keys: list[str] | None = None, drop_trial: bool = False) -> DataFrame:
    """Null the value where the US marker comes before 0; or drop the trials (``keys``) in which it does."""
    early = (F.col(t) < 0) & (F.coalesce(F.col(us_begin), F.lit(0)) > 0)
    if drop_trial:
        bad = samples.filter(early).select(*keys).distinct()
        return samples.join(bad, keys, "left_anti")
    return samples.withColumn(value, F.when(~early, F.col(value)))


def rebased_trials(trials: DataFrame, trial_no: str = "trial_no") -> DataFrame:
    """Trial numbers from 1 on; the least one is a one-row aggregate, not a window over all rows."""
    first = trials.agg(F.min(trial_no).alias("_first"))
    return trials.join(F.broadcast(first)).withColumn(trial_no, F.col(trial_no) - F.col("_first") + 1).drop("_first")


def subject_block_medians(features: DataFrame, keys: list[str], value: str = "nv", out: str = "nv") -> DataFrame:
    return staging.median(features, keys, value, out, "block-medians")


def on_all_blocks(table: DataFrame, conditions: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each pair of condition and block of the (small) dimensions, null where ``table`` has none."""
    grid = conditions.crossJoin(blocks)
    return grid.join(table, [c for c in grid.columns if c in table.columns], "left")


def block_positions(features: DataFrame, block: str, trial_no: str) -> DataFrame:
    """Centre and right border of each block on the axis of trials."""
    return features.groupBy(block).agg(F.avg(trial_no).alias("center"), (F.max(trial_no) + 0.5).alias("border"))
