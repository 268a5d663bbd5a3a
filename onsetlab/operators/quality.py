"""Data-quality rules: all metrics of a subject in one aggregate, the first failing rule names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetlab.staging import with_same


def rule_table(metrics: DataFrame, subject: list[str], rules: list[tuple[str | Column, Column]]) -> DataFrame:
    """subject, reason: the first rule (reason, fails) that fails, null if none does. A null test fails."""
    failing = [F.when(F.coalesce(fails, F.lit(True)), F.lit(name) if isinstance(name, str) else name) for name, fails in rules]
    return metrics.select(*subject, F.coalesce(*failing).alias("reason"))


def trial_activity(samples: DataFrame, keys: list[str], t: str, active: str, windows: dict[str, tuple[float, float]]) -> DataFrame:
    """Per trial, for each named window, whether any sample in it is active."""
    inside = lambda w: F.col(t).between(*map(F.lit, w)) & F.col(active)
    return samples.groupBy(*keys).agg(
        *[F.coalesce(F.bool_or(inside(w)), F.lit(False)).alias(f"active_{name}") for name, w in windows.items()]
    )


def us_metrics(
    samples: DataFrame, subject: list[str], trial_no: str, t: str, active: str, end_mark: str, block: str, window: tuple[float, float],
    parts: dict[str, str], subjects: DataFrame | None = None,
) -> DataFrame:
    """Per subject, for the rules on unconditioned stimuli: trials, the last one's end and response, silent trials.

    Columns: us_trials, last_end (time of the last trial's first end mark), last_active (any activity in
    ``window`` of it), and for each of ``parts`` (name to a part of block names) seen_<name>, whether a trial of
    a block whose name contains the part has rows in the window, and silent_<name>, the sorted trials of them
    that are silent there. Subjects of ``subjects`` without trials get a row of nulls.
    """
    inside = F.col(t).between(*map(F.lit, window))
    per = samples.groupBy(*subject, trial_no).agg(
        F.min(F.when(F.col(end_mark), F.col(t))).alias("_end"), F.count_if(inside).alias("_rows"),
        F.coalesce(F.bool_or(inside & F.col(active)), F.lit(False)).alias("_active"), F.min(block).alias("_block"),
    )
    aggregates = [F.count("*").alias("us_trials"), F.max_by(F.struct("_end", "_active"), trial_no).alias("_last")]
    for name, part in parts.items():
        own = F.coalesce((F.col("_rows") > 0) & F.contains("_block", F.lit(part)), F.lit(False))
        aggregates.append(F.bool_or(own).alias(f"seen_{name}"))
        aggregates.append(F.array_sort(F.collect_list(F.when(own & ~F.col("_active"), F.col(trial_no)))).alias(f"silent_{name}"))
    out = per.groupBy(*subject).agg(*aggregates)
    if subjects is not None:
        out = with_same(subjects.select(*subject).distinct(), out, subject, "left")
    seen = [c for name in parts for c in (f"seen_{name}", f"silent_{name}")]
    return out.select(*subject, "us_trials", F.col("_last._end").alias("last_end"), F.col("_last._active").alias("last_active"), *seen)


def us_rules(train: str, retrain: str, least_end: float, said: str | None = None) -> list[tuple[str | Column, Column]]:
    """The rules on ``us_metrics`` (with the parts "train" and "retrain"), in order: viability, the training blocks,
    the retraining blocks if there are any. ``said`` is the latter's name in the reason."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    # The texts of the reasons.
    silent = lambda name, shown: (F.concat(F.lit(f"no bouts in {shown} for trial(s): "), listed(f"silent_{name}")), F.size(f"silent_{name}") > 0)
    return [
        ("no US trials found", F.coalesce(F.col("us_trials"), F.lit(0)) == 0),
        ("missing US end in last trial", F.col("last_end").isNull()),
        ("US end too short in last trial", F.col("last_end") < least_end),
        ("failed viability test", ~F.col("last_active")),
        (f"no {train} block found", ~F.col("seen_train")),
        silent("train", train),
        silent("retrain", said or retrain),
    ]


def block_activity(trials: DataFrame, subject: list[str], block: str, chosen: list[str], names: list[str]) -> DataFrame:
    """Per subject: trials of each chosen block that are active in each named window, as <name>_<place of the block>; an absent block counts 0."""
    return trials.groupBy(*subject).agg(
        *[F.count_if((F.col(block) == b) & F.col(f"active_{n}")).alias(f"{n}_{k}") for n in names for k, b in enumerate(chosen)]
    )


def block_rules(chosen: list[str], name: str, minimum: int, period: str) -> list[tuple[str, Column]]:
    """The rules on ``block_activity``: in each chosen block, in order, at least ``minimum`` active trials."""
    # The texts of the reasons.
    return [(f"less than {minimum} trials with bouts in {period} period in {b}", F.col(f"{name}_{k}") < minimum) for k, b in enumerate(chosen)]


def covers_protocol(samples: DataFrame, protocol: DataFrame, by: list[str], t: str, onset: str) -> DataFrame:
    """by, covered: whether the samples reach the last onset of the protocol; a key without samples does not."""
    ends = samples.groupBy(*by).agg(F.max(t).alias("_reach"))
    need = protocol.groupBy(*by).agg(F.max(onset).alias("_need"))
    return need.join(ends, by, "left").select(*by, F.coalesce(F.col("_reach") >= F.col("_need"), F.lit(False)).alias("covered"))


def by_age_and_rig(df: DataFrame, age: str, rig: str, ages: list | None = None, colours: list[str] | None = None) -> DataFrame:
    """Rows of the given ages and rig colours (the part of the rig's name before a hyphen); None takes all."""
    out = df if ages is None else df.filter(F.col(age).isin(ages))
    return out if colours is None else out.filter(F.split_part(rig, F.lit("-"), F.lit(1)).isin(colours))


def active_trials(trials: DataFrame, subject: list[str], block: str, name: str) -> DataFrame:
    """Trials of each block that are active in the named window."""
    return trials.groupBy(*subject, block).agg(
        F.count("*").alias("trials"), F.count_if(F.col(f"active_{name}")).alias("active_trials")
    )


def silent_trials(trials: DataFrame, subject: list[str], trial_no: str, name: str) -> DataFrame:
    """The trials without any activity, as a sorted list (a subject has few trials)."""
    return trials.groupBy(*subject).agg(
        F.array_sort(F.collect_list(F.when(~F.col(f"active_{name}"), F.col(trial_no)))).alias("silent")
    )


def tracking_errors(samples: DataFrame, by: list[str], angles: str, limit: float) -> DataFrame:
    """Per key: greatest absolute angle, whether any is missing, and whether tracking failed."""
    out = samples.groupBy(*by).agg(
        F.max(F.array_max(F.transform(angles, F.abs))).alias("greatest"),
        F.bool_or(F.col(angles).isNull() | F.exists(angles, F.isnull)).alias("missing"),
    )
    return out.withColumn("failed", F.coalesce(F.col("greatest") > limit, F.lit(True)) | F.col("missing"))


def enough_stimuli(summary: DataFrame, minima: dict[str, int]) -> Column:
    """Whether each counted kind reaches its minimum."""
    del summary
    return F.array_min(F.array(*[(F.col(f"n_{k}") >= m).cast("int") for k, m in minima.items()])) == 1


def eligible_subjects(trials: DataFrame, subject: list[str], block: str, blocks: list, minimum: int, mode: str = "all") -> DataFrame:
    """Subjects with at least ``minimum`` trials in all (or any) of the blocks; an absent block counts 0."""
    counts = [F.count_if(F.col(block) == b) for b in blocks]
    enough = [(c >= minimum).cast("int").alias(f"_{k}") for k, c in enumerate(counts)]
    table = trials.groupBy(*subject).agg(*enough)
    pick = F.least if mode == "all" else F.greatest
    columns = [F.col(f"_{k}") for k in range(len(blocks))]
    hit = columns[0] if len(columns) == 1 else pick(*columns)
    return table.filter(hit == 1).select(*subject)


def present_in_all(table: DataFrame, subject: list[str], block: str, blocks: list) -> DataFrame:
    """Relational division: the subjects with a row in every one of the blocks."""
    found = table.filter(F.col(block).isin(blocks)).groupBy(*subject).agg(F.count_distinct(block).alias("_n"))
    return found.filter(F.col("_n") == len(set(blocks))).select(*subject)


def without_subjects(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids, on, "left_anti")


def excluded_without_artefact(excluded: DataFrame, artefacts: DataFrame, on: list[str]) -> DataFrame:
    """Excluded ids for which no artefact exists."""
    return excluded.join(artefacts, on, "left_anti")
