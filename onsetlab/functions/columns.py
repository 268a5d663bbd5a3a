"""Column expressions: angles, bins, labels, transforms, probabilities. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Time

def frames_to_seconds(frame: Column | str, rate: float) -> Column:
    return _c(frame) / F.lit(float(rate))


def seconds_to_frames(seconds: Column | str, rate: float) -> Column:
    return F.round(_c(seconds) * F.lit(float(rate))).cast("int")


def wall_micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp without time zone since 1970-01-01, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(_c(ts).cast("timestamp"), F.current_timezone()))


def timestamp_seconds(ts: Column | str) -> Column:
    return wall_micros(ts) / F.lit(1e6)


def bin_right(t: Column | str, width: float) -> Column:
    """The right edge of the bin that holds ``t``: bins are right-closed and have an edge at 0."""
    return F.ceil(_c(t) / F.lit(width)) * F.lit(width)


def bin_mid(t: Column | str, width: float) -> Column:
    return bin_right(t, width) - F.lit(width / 2)


def time_bins(lo: float, hi: float, width: float) -> list[float]:
    """Edges with one at 0 that cover [lo, hi]."""
    return [k * width for k in range(math.floor(lo / width), math.ceil(hi / width) + 1)]


def latency_ramp(trial: Column | str, first: int, last: int, start: float, end: float) -> Column:
    """``start`` up to trial ``first``, a straight line to ``end`` at trial ``last``, constant after."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(trial) - first) / F.lit(float(max(last - first, 1)))))
    return F.lit(float(start)) + share * F.lit(float(end - start))


# Values

def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Clipped to [lo, hi]; null stays null."""
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x))))


def no_nan(x: Column | str) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(_c(x)), _c(x))


def decimal_comma(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), ",", ".").cast("double")


def transformed(x: Column | str, how: str = "log1p") -> Column:
    """``log1p``, ``log`` (null unless positive) or ``none``."""
    if how == "log1p":
        return F.log1p(_c(x))
    if how == "log":
        return F.when(_c(x) > 0, F.log(_c(x)))
    if how == "none":
        return _c(x)
    raise ValueError(f"no transform {how!r}")


def jitter(x: Column | str, scale: float, seed: int) -> Column:
    return _c(x) + F.lit(scale) * F.randn(seed)


def masked(x: Column | str, keep: Column) -> Column:
    """The value where ``keep`` holds, else null."""
    return F.when(keep, _c(x))


# Arrays of angles along a line of points

def degrees_of(angles: Column | str) -> Column:
    return F.transform(_c(angles), F.degrees)


def radians_of(angles: Column | str) -> Column:
    return F.transform(_c(angles), F.radians)


def running_sum(values: Column | str) -> Column:
    """Prefix sums of an array, in one pass."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"))
    return F.aggregate(_c(values), start, step, lambda acc: acc["a"])


def space_boxcar(values: Column | str, window: int = 3) -> Column:
    """Mean over neighbouring points, shorter at both ends."""
    back, ahead, v = window // 2, (window - 1) // 2, _c(values)

    def mean(_: Column, i: Column) -> Column:
        lo = F.greatest(i - back, F.lit(0))
        part = F.slice(v, lo + 1, F.least(i + ahead, F.size(v) - 1) - lo + 1)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)

    return F.transform(v, mean)


def line_points(angles: Column | str, length: float) -> Column:
    """Points (x, y) of a chain of segments with absolute ``angles`` in radians; the first is (0, 0), the last angle is unused."""
    used = F.slice(_c(angles), 1, F.greatest(F.size(_c(angles)) - 1, F.lit(0)))
    xs = running_sum(F.transform(used, lambda a: F.lit(length) * F.cos(a)))
    ys = running_sum(F.transform(used, lambda a: F.lit(length) * F.sin(a)))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.concat(F.array(point(F.lit(0.0), F.lit(0.0))), F.zip_with(xs, ys, point))


def dense_points(points: Column | str, n: int) -> Column:
    """Points along the segments, ``max(1, n // segments)`` on each."""
    p = _c(points)
    per = F.greatest(F.floor(F.lit(n) / F.greatest(F.size(p) - 1, F.lit(1))), F.lit(1)).cast("int")

    def along(a: Column, i: Column) -> Column:
        b = F.element_at(p, i + 2)
        at = lambda k: F.struct(
            (a["x"] + (b["x"] - a["x"]) * k / per).alias("x"), (a["y"] + (b["y"] - a["y"]) * k / per).alias("y")
        )
        return F.transform(F.sequence(F.lit(0), per - 1), at)

    return F.flatten(F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), along))


# Names

def recording_parts(stem: Column | str) -> dict[str, Column]:
    """Fields of ``day_number_condition_rig_strain_<n>dpf``."""
    parts = F.split(F.lower(_c(stem)), "_")
    at = lambda k: F.get(parts, F.lit(k))
    return {
        "day": at(0), "subject_no": at(1), "condition": at(2), "rig": at(3), "strain": at(4),
        "age": F.regexp_replace(at(5), "dpf.*$", ""), "subject": F.concat_ws("_", at(0), at(1)),
    }


def condition_label(condition: Column | str) -> Column:
    return F.lower(F.split_part(_c(condition), F.lit("-"), F.lit(1)))


def matches_any(x: Column | str, tokens: list[str]) -> Column:
    """Whether the text holds any of the tokens."""
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(_c(x), t)) if tokens else F.lit(False)


# Probabilities

def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution by Abramowitz and Stegun 26.2.17 (error under 7.5e-8)."""
    z = _c(z)
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    # Fixed values of the published approximation.
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.lit(0.3989422804014327) * F.exp(-z * z / 2) * series
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided_p(z: Column | str) -> Column:
    return F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(_c(z))))


def chi2_cdf(x: float, df: int) -> float:
    """Driver scalar: the regularised lower incomplete gamma function by its series."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    """Driver scalar: the value that ``chi2_cdf`` maps to ``p``, by bisection."""
    lo, hi = 0.0, max(10.0, 10.0 * df)
    while chi2_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def stars(p: Column | str) -> Column:
    p = _c(p)
    return (
        F.when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 1e-2, "**").when(p <= 0.05, "*")
        .when(p.isNotNull(), "ns")
    )
