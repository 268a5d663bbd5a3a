"""Clocks: frame intervals, stable spans, lost frames, protocol summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.operators.chunks import CHUNK, neighbours, running_sums
from onsetlab.staging import median, positions, staged, with_same


def frame_intervals(clock: DataFrame, by: list[str], frame: str, elapsed: str, tolerance: float, rows: int = CHUNK) -> DataFrame:
    """Add ``interval`` to the row before, its median ``typical``, and ``steady`` (within the tolerance)."""
    out = neighbours(clock, by, frame, F.col(elapsed), "_before", rows)
    out = out.withColumn("interval", (F.col(elapsed) - F.col("_before")).cast("double")).drop("_before")
    out = with_same(out, median(out, by, "interval", "typical", "frame-intervals"), by)
    return out.withColumn("steady", F.coalesce(F.abs(F.col("interval") - F.col("typical")) <= F.lit(tolerance), F.lit(False)))


def lost_frames(clock: DataFrame, by: list[str], frame: str, elapsed: str, tolerance: float, buffer: int = 0, rows: int = CHUNK) -> DataFrame:
    """Add first_steady, last_steady, mean_interval, drift and ``lost`` (frames lost just before this one) to the intervals.

    A frame is an anchor if it and its neighbours have steady intervals; the first anchor lies ``buffer``
    frames in, at least. The mean interval is taken between the anchors. The drift is the running sum of what
    intervals there exceed it by, and frames are lost where the whole part of the drift (in intervals) rises.
    """
    out = staged(frame_intervals(clock, by, frame, elapsed, tolerance, rows), "clock-intervals")
    near = neighbours(out, by, frame, F.col("steady"), "_s", rows)
    near = neighbours(near, by, frame, F.col("steady"), "_t", rows, ahead=True)
    three = F.col("steady") & F.coalesce("_s", F.lit(False)) & F.coalesce("_t", F.lit(False))
    near = near.withColumn("_anchor", three).drop("_s", "_t")
    near = positions(near, by, [frame], "_n", "clock-anchors") if buffer else near.withColumn("_n", F.lit(0))
    anchors = near.groupBy(*by).agg(
        F.min(F.when(F.col("_anchor") & (F.col("_n") >= buffer), F.col(frame))).alias("first_steady"),
        F.max(F.when(F.col("_anchor"), F.col(frame))).alias("last_steady"),
    )
    out = with_same(out, anchors, by)
    inside = F.coalesce((F.col(frame) > F.col("first_steady")) & (F.col(frame) <= F.col("last_steady")), F.lit(False))
    means = out.groupBy(*by).agg(F.avg(F.when(inside, F.col("interval"))).alias("mean_interval"))
    out = with_same(out, means, by)
    out = staged(out.withColumn("_more", F.when(inside, F.col("interval") - F.col("mean_interval")).otherwise(0.0)), "clock-drift")
    out = running_sums(out, by, frame, {"_more": "drift"}, rows)
    whole = lambda d: F.greatest(F.floor(F.try_divide(d, F.col("mean_interval")) + 1e-9), F.lit(0))
    lost = F.greatest(whole(F.col("drift")) - whole(F.col("drift") - F.col("_more")), F.lit(0))
    return out.withColumn("lost", F.coalesce(lost, F.lit(0)).cast("long")).drop("_more")


def clock_report(clock: DataFrame, by: list[str], frame: str, elapsed: str, tolerance: float, buffer: int = 0, rows: int = CHUNK) -> DataFrame:
    """Per key: typical and mean interval, first and last steady frame, rate, largest interval, lost frames."""
    return lost_frames(clock, by, frame, elapsed, tolerance, buffer, rows).groupBy(*by).agg(
        F.first("typical").alias("typical"), F.first("mean_interval").alias("mean_interval"), F.first("first_steady").alias("first_steady"),
        F.first("last_steady").alias("last_steady"), F.max("interval").alias("largest"), F.sum("lost").alias("lost"),
    ).withColumn("rate", F.try_divide(F.lit(1000.0), F.col("mean_interval")))


def merged_clock(samples: DataFrame, clock: DataFrame, by: list[str], frame: str) -> DataFrame:
    """Samples with their clock rows; frames rebased to 0 in each key."""
    both = samples.join(clock, [*by, frame])
    first = both.groupBy(*by).agg(F.min(frame).alias("_first"))
    return with_same(both, first, by).withColumn(frame, F.col(frame) - F.col("_first")).drop("_first")


def frames_before(samples: DataFrame, by: list[str], frame: str, reference: str) -> DataFrame:
    """How many frames come before the reference frame, which the rows carry."""
    return samples.groupBy(*by).agg(F.count_if(F.col(frame) < F.col(reference)).alias("n_before"))


def first_absolute(clock: DataFrame, by: list[str], frame: str, absolute: str) -> DataFrame:
    return clock.groupBy(*by).agg(F.min_by(absolute, frame).alias("first_absolute"))


def stimulus_intervals(stimuli: DataFrame, by: list[str], kind: str, begin: str, end: str) -> DataFrame:
    """Each stimulus with its number in its kind, duration, and the time since the last one of the kind ended."""
    w = Window.partitionBy(*by, kind).orderBy(begin)
    return (
        stimuli.withColumn("stim_no", F.row_number().over(w))
        .withColumn("duration", F.col(end) - F.col(begin))
        .withColumn("since_last", F.col(begin) - F.lag(end).over(w))
    )


def protocol_summary(stimuli: DataFrame, by: list[str], kind: str, begin: str, end: str, kinds: list[str]) -> DataFrame:
    """Per key: stimuli of each kind, first begin, least and greatest duration and interval."""
    rows = stimulus_intervals(stimuli, by, kind, begin, end)
    return rows.groupBy(*by).agg(
        *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds],
        F.min(begin).alias("first_begin"), F.min("duration").alias("least_duration"), F.max("duration").alias("greatest_duration"),
        F.min("since_last").alias("least_interval"), F.max("since_last").alias("greatest_interval"),
    )


def stimulus_timeline(stimuli: DataFrame, by: list[str], kind: str, marks: list[str], unit: float = 1.0) -> DataFrame:
    """One row per mark of each stimulus, in protocol time: by, kind, mark, at, since_last.

    ``marks`` are columns of times (onset, end and the like); null ones give no row. ``at`` counts from the
    key's first mark in ``unit``s, ``since_last`` from the mark before, of any kind.
    """
    rows = stimuli.unpivot([*by, kind], marks, "mark", "_t").filter("_t is not null")
    first = rows.groupBy(*by).agg(F.min("_t").alias("_first"))
    # One row per time and key, so that what comes before is told without ties.
    times = staged(rows.select(*by, "_t").distinct(), "timeline-times")
    before = neighbours(times, by, "_t", F.col("_t"), "_before", CHUNK * unit)
    rows = with_same(with_same(rows, first, by), before, [*by, "_t"])
    out = rows.withColumns({"at": (F.col("_t") - F.col("_first")) / F.lit(unit), "since_last": (F.col("_t") - F.col("_before")) / F.lit(unit)})
    return out.select(*by, kind, "mark", "at", "since_last")
