"""Binned and pooled tables, histograms, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab import staging
from onsetlab.functions.columns import bin_mid
from onsetlab.staging import median, sums_before, with_same


def pooled_bins(samples: DataFrame, keys: list[str], subject: str, t: str, value: str, width: float) -> DataFrame:
    """Median and count over subjects at each time, then mean and count per subject in each bin.

    Returns keys, bin_mid, value and count (values in the bin / subjects of the key).
    """
    at = median(samples, [*keys, t], value, "_m", "pooled-bins")
    at = with_same(at, samples.groupBy(*keys, t).agg(F.count(value).alias("_n")), [*keys, t])
    subjects = samples.groupBy(*keys).agg(F.count_distinct(subject).alias("_subjects"))
    bins = at.groupBy(*keys, bin_mid(t, width).alias("bin_mid")).agg(F.avg("_m").alias("value"), F.sum("_n").alias("_n"))
    return bins.join(subjects, keys).select(*keys, "bin_mid", "value", (F.col("_n") / F.col("_subjects")).alias("count"))


def heatmap(bins: DataFrame, rows: list[str], column: str, values: list, value: str, names: list[str] | None = None) -> DataFrame:
    """Rows by bins, with a given list of bin values."""
    wide = bins.groupBy(*rows).pivot(column, values).agg(F.avg(value))
    return wide.toDF(*rows, *(names or [str(v) for v in values]))


def value_ranges(samples: DataFrame, keys: list[str], value: str, quantiles: list[float], positive: bool = False, exact: bool = True) -> DataFrame:
    """Quantiles of the values (of the positive ones) in each key."""
    x = F.when(F.col(value) > 0, F.col(value)) if positive else F.col(value)
    if exact:
        return staging.quantiles(samples, keys, x, quantiles, "quantiles", "value-ranges")
    return samples.groupBy(*keys).agg(F.percentile_approx(x, F.array(*map(F.lit, quantiles))).alias("quantiles"))


def histogram_2d(df: DataFrame, x: Column, y: Column, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Counts on a grid: x_bin, y_bin, n."""
    cell = lambda v, v0, d: F.floor((v - F.lit(v0)) / F.lit(d))
    return df.groupBy(cell(x, x0, dx).alias("x_bin"), cell(y, y0, dy).alias("y_bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, keys: list[str], x: str, width: float) -> DataFrame:
    """Counts in bins of ``width`` with their density in the key: bin_left, n, density."""
    left = F.floor(F.col(x) / F.lit(width)) * F.lit(width)
    bins = df.groupBy(*keys, left.alias("bin_left")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return bins.withColumn("density", F.col("n") / (total * F.lit(width)))


def bin_width(bins: DataFrame, mid: str = "bin_mid") -> DataFrame:
    """The least distance between bins, as a one-row table; bins are few."""
    w = Window.partitionBy(F.lit(0)).orderBy(mid)
    return bins.select(mid).distinct().select((F.lead(mid).over(w) - F.col(mid)).alias("d")).agg(F.min("d").alias("width"))


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform number."""
    # The distribution function of Poisson(1) at 0, 1, 2, ...
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    return sum(((u > F.lit(s)).cast("int") for s in steps), F.lit(0))


def bootstrap_median(
    df: DataFrame, keys: list[str], value: str, replicates: int, draw: Column, level: float = 0.95
) -> DataFrame:
    """Poisson bootstrap of the median: keys, median, low, high.

    ``draw`` gives a uniform number from the row and ``replicate`` (a hash of a stable identifier, so
    reruns agree). Each row meets each replicate with its weight, values of a replicate are counted by
    value, and the weighted median is the least value with at least half the weight.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("_w", poisson_weight(draw)).filter("_w > 0")
    counts = rows.groupBy(*keys, "replicate", value).agg(F.sum("_w").alias("_w"))
    half = sums_before(counts, [*keys, "replicate"], [value], {"_w": "_c"}, "bootstrap-median")
    half = with_same(half, half.groupBy(*keys, "replicate").agg(F.sum("_w").alias("_t")), [*keys, "replicate"])
    medians = half.filter((F.col("_c") + F.col("_w")) * 2 >= F.col("_t")).groupBy(*keys, "replicate").agg(F.min(value).alias("_m"))
    tail = (1 - level) / 2
    bounds = medians.groupBy(*keys).agg(  # one value per replicate
        F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high")
    )
    point = median(df, keys, value, "median", "bootstrap-median")
    return with_same(point, bounds, keys, "left")
