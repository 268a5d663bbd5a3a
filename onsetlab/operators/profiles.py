"""Subject profiles: distance to the controls, thresholds, votes, calibrated scores, diagnostics, summaries.

Features come long (subject, condition, feature, value, se) or wide (one column each). Covariances are
sums over one aggregate; the p-by-p algebra is on the driver and comes back as Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.functions.columns import chi2_quantile, normal_cdf
from onsetlab.operators.binning import poisson_weight
from onsetlab.operators.grouptests import mann_whitney
from onsetlab.staging import median, positions, quantiles, staged, sums_before, with_same


@dataclass
class Moments:
    """Mean and covariance (by n) of a group, and the Ledoit-Wolf shrunk covariance."""

    n: int
    mean: np.ndarray
    covariance: np.ndarray
    shrinkage: float
    shrunk: np.ndarray


def moments(df: DataFrame, features: list[str]) -> Moments:
    """Moments of complete rows, from two aggregates; shrinkage after Ledoit and Wolf (2004)."""
    rows, p = df.dropna(subset=features), len(features)
    first = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]).first()
    n, mean = first["n"], np.array([first[f"m{i}"] if first["n"] else np.nan for i in range(p)], float)
    if not n:
        return Moments(0, mean, np.full((p, p), np.nan), 0.0, np.full((p, p), np.nan))
    d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, mean, strict=True)]
    cells = [F.avg(d[i] * d[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    square = sum((x * x for x in d), F.lit(0.0))
    got = rows.agg(*cells, F.avg(square * square).alias("fourth")).first()
    S = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            S[i, j] = S[j, i] = got[f"c{i}_{j}"]
    m = np.trace(S) / p
    d2 = (np.sum(S * S) - p * m * m) / p
    b2 = min(max((got["fourth"] - np.sum(S * S)) / (n * p), 0.0), d2)
    s = b2 / d2 if d2 > 0 else 0.0
    return Moments(n, mean, S, float(s), (1 - s) * S + s * m * np.eye(p))


def quadratic_form(columns: list[Column], matrix: np.ndarray) -> Column:
    terms = [columns[i] * columns[j] * F.lit(float(matrix[i, j])) for i in range(len(columns)) for j in range(len(columns))]
    return sum(terms, F.lit(0.0))


def mahalanobis(df: DataFrame, features: list[str], reference: Moments, out: str = "distance") -> DataFrame:
    """Distance to the reference group under its shrunk covariance."""
    d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, reference.mean, strict=True)]
    return df.withColumn(out, F.sqrt(quadratic_form(d, np.linalg.inv(reference.shrunk))))


def chi2_threshold(features: int, alpha: float = 0.05) -> float:
    return float(np.sqrt(chi2_quantile(1 - alpha, features)))


def bootstrap_threshold(controls: DataFrame, distance: str, draw: Column, replicates: int = 50, quantile: float = 0.95) -> DataFrame:
    """One row: the mean over Poisson bootstrap replicates of the weighted quantile of control distances."""
    rows = controls.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("_w", poisson_weight(draw)).filter("_w > 0").groupBy("replicate", distance).agg(F.sum("_w").alias("_w"))
    w = Window.partitionBy("replicate")
    rows = rows.withColumn("_c", F.sum("_w").over(w.orderBy(distance).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_t", F.sum("_w").over(w))
    cut = rows.filter(F.col("_c") >= F.lit(quantile) * F.col("_t")).groupBy("replicate").agg(F.min(distance).alias("_q"))
    return cut.agg(F.avg("_q").alias("threshold"))


def classify(
    long: DataFrame, subject: list[str], directions: dict[str, int], control: Column, method: str = "probabilistic",
    min_probability: float = 0.8, k: float = 1.0,
) -> DataFrame:
    """subject, vote_point, vote_prob: features past the controls' mean in the expected direction.

    A point vote compares the value itself. ``probabilistic`` votes where P = Phi(direction * (value -
    mean) / se) reaches ``min_probability`` (a se of 0 or less counts as z = +-10); ``conservative``
    where the bound k standard errors towards the mean is still past it.
    """
    sign = F.lit(None).cast("int")
    for feature, s in directions.items():
        sign = F.when(F.col("feature") == feature, F.lit(int(s))).otherwise(sign)
    means = long.filter(control).groupBy("feature").agg(F.avg("value").alias("_mean"))
    rows = long.join(means, "feature").withColumn("_d", sign * (F.col("value") - F.col("_mean")))
    z = F.when(F.col("se") > 0, F.col("_d") / F.col("se")).otherwise(10.0 * F.signum("_d"))
    if method == "probabilistic":
        sure = normal_cdf(z) >= min_probability
    elif method == "conservative":
        sure = F.col("_d") - F.lit(float(k)) * F.col("se") > 0
    else:
        raise ValueError(f"no method {method!r}")
    return rows.groupBy(*subject).agg(
        F.count_if(F.col("_d") > 0).alias("vote_point"), F.count_if(sure).alias("vote_prob"), F.count("*").alias("features")
    )


def calibrated_scores(
    wide: DataFrame, subject: list[str], control: str, features: dict[str, int], alpha: float = 0.05, se: dict[str, str] | None = None
) -> DataFrame:
    """Directional scores calibrated on the controls: z_*, t_joint, p_empirical, votes, is_learner.

    z is taken against the controls' mean without the subject itself and their standard deviation (with
    the subject's se, where given); T is the quadratic form of its positive parts under the controls'
    shrunk covariance of z; the threshold is the controls' 1 - alpha quantile; p counts controls at
    least as large, from a running sum over distinct values. A learner passes it with every feature > 0.
    A subject with a null feature has no t_joint and no p, and is no learner; its other features vote.
    """
    c = F.col(control)
    sums = wide.filter(c).agg(
        F.count("*").alias("_n"), *[F.sum(f).alias(f"_s_{f}") for f in features], *[F.stddev_samp(f).alias(f"_sd_{f}") for f in features]
    )
    rows = wide.join(F.broadcast(sums))  # one row
    for f, sign in features.items():
        mean = F.when(c, F.try_divide(F.col(f"_s_{f}") - F.col(f), F.col("_n") - 1)).otherwise(F.try_divide(F.col(f"_s_{f}"), F.col("_n")))
        scale = F.col(f"_sd_{f}")
        if se:
            scale = F.sqrt(scale * scale + F.col(se[f]) * F.col(se[f]))
        rows = rows.withColumn(f"z_{f}", F.lit(float(sign)) * F.try_divide(F.col(f) - mean, scale))
    z = [f"z_{f}" for f in features]
    reference = moments(rows.filter(c), z)
    positive = [F.when(F.col(x).isNotNull(), F.greatest(F.col(x), F.lit(0.0))) for x in z]
    # Written, so that the values counted below and those they are joined to are the same to the last bit.
    rows = staged(rows.withColumn("t_joint", quadratic_form(positive, np.linalg.inv(reference.shrunk))), "calibrated-rows")
    controls = rows.filter(c)
    limit = quantiles(controls, [], "t_joint", [1 - alpha], "_q", "calibrated-limit").select(F.element_at("_q", 1).alias("_limit"))
    votes = sum((F.coalesce(F.col(x) > 0, F.lit(False)).cast("int") for x in z), F.lit(0))
    # How many controls have at least this t, by distinct values.
    counts = rows.filter("t_joint is not null").groupBy(F.lit(0).alias("_all"), "t_joint").agg(F.count_if(c).alias("_k"))
    counts = sums_before(counts, ["_all"], [F.desc("t_joint")], {"_k": "_more"}, "calibrated")
    counts = counts.select("t_joint", (F.col("_more") + F.col("_k")).alias("_above"))
    out = rows.join(counts, "t_joint", "left").join(F.broadcast(limit))
    return out.select(
        *subject, control, *z, "t_joint", ((1 + F.col("_above")) / (1 + F.col("_n"))).alias("p_empirical"), votes.alias("votes"),
        F.coalesce((F.col("t_joint") > F.col("_limit")) & (votes == len(z)), F.lit(False)).alias("is_learner"),
    )


def mardia(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: n, skewness and kurtosis (Mardia), from whitened third and fourth moments."""
    ref, p = moments(df, features), len(features)
    L = np.linalg.cholesky(np.linalg.inv(ref.covariance))
    d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, ref.mean, strict=True)]
    z = [sum((d[i] * F.lit(float(L[i, a])) for i in range(p)), F.lit(0.0)) for a in range(p)]
    rows = df.dropna(subset=features).select(*[x.alias(f"_z{a}") for a, x in enumerate(z)])
    z = [F.col(f"_z{a}") for a in range(p)]
    third = [F.pow(F.avg(z[a] * z[b] * z[c]), F.lit(2)) for a in range(p) for b in range(p) for c in range(p)]
    square = sum((x * x for x in z), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), sum(third, F.lit(0.0)).alias("skewness"), F.avg(square * square).alias("kurtosis"))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """first, second, r for each pair of features, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(cells))


def principal_components(df: DataFrame, features: list[str], standardise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns) and shares of variance, largest first; signs make each loading's largest part positive."""
    S = moments(df, features).covariance
    if standardise:
        sd = np.sqrt(np.diag(S))
        S = S / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(S)
    order = np.argsort(-values)
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[top, range(len(order))]), values[order] / values.sum()


def batch_rates(results: DataFrame, batch: Column, learner: str) -> DataFrame:
    """batch, learners, subjects, rate."""
    out = results.groupBy(batch.alias("batch")).agg(F.count_if(F.col(learner)).alias("learners"), F.count("*").alias("subjects"))
    return out.withColumn("rate", F.col("learners") / F.col("subjects"))


def subject_summary(long: DataFrame, subject: list[str], features: list[str], classes: DataFrame, k: float = 1.96) -> DataFrame:
    """One row per subject: each feature's value and interval, with the classes joined on."""
    cells = []
    for f in features:
        own = F.col("feature") == f
        value, se = F.max(F.when(own, F.col("value"))), F.max(F.when(own, F.col("se")))
        cells += [value.alias(f), (value - k * se).alias(f"{f}_lower"), (value + k * se).alias(f"{f}_upper")]
    return long.groupBy(*subject).agg(*cells).join(classes, subject, "left")


def effect_trajectory(wide: DataFrame, subject: list[str], features: list[tuple[str, str]]) -> DataFrame:
    """subject, epoch, effect, se: 0, f1, f1 + f2, ... with the standard errors propagated."""
    steps, effect, variance = [], F.lit(0.0), F.lit(0.0)
    steps.append(F.struct(F.lit(0).alias("epoch"), effect.alias("effect"), F.lit(0.0).alias("se")))
    for k, (value, se) in enumerate(features, 1):
        effect, variance = effect + F.col(value), variance + F.col(se) * F.col(se)
        steps.append(F.struct(F.lit(k).alias("epoch"), effect.alias("effect"), F.sqrt(variance).alias("se")))
    return wide.select(*subject, F.inline(F.array(*steps)))


def status_rank(outlier: Column, point: Column, probabilistic: Column) -> Column:
    """0 non-learner, 1 outlier, 2 learner by points, 3 by probabilities."""
    return F.when(probabilistic, 3).when(point, 2).when(outlier, 1).otherwise(0)


def ranked_subjects(long: DataFrame, feature: str = "feature", value: str = "value", status: str | None = None) -> DataFrame:
    """Add ``rank``: the place (from 1) in each feature by value, or by ``status`` first (non-learners first) and then by value."""
    order = [value] if status is None else [status, value]
    return positions(long, [feature], order, "rank", "subject-ranks").withColumn("rank", F.col("rank") + 1)


def status_trajectories(subjects: DataFrame, features: DataFrame, subject: list[str], status: str, keys: list[str], value: str = "nv") -> tuple[DataFrame, DataFrame]:
    """For ranking tables: counts of each status by the first key, and the median over subjects of their medians by ``keys``."""
    per = median(features, [*subject, *keys], value, value, "subject-medians")
    return subjects.groupBy(keys[0], status).agg(F.count("*").alias("subjects")), median(per, keys, value, value, "condition-medians")


def modelling_table(features: DataFrame, subject: list[str], trial_no: str, columns: dict[str, Column], least_rows: int = 1) -> DataFrame:
    """Complete rows with the given columns computed, trials counted from the subject's first one kept; subjects with fewer rows go."""
    rows = features.withColumns(columns).dropna(subset=[*columns])
    extents = rows.groupBy(*subject).agg(F.min(trial_no).alias("_first"), F.count("*").alias("_n"))
    rows = with_same(rows, extents, subject).filter(F.col("_n") >= least_rows)
    return rows.withColumn("session_trial", F.col(trial_no) - F.col("_first")).drop("_first", "_n")


def normalised_to_epoch(features: DataFrame, subject: list[str], value: str, reference: Column, out: str) -> DataFrame:
    """The value over the subject's mean in the reference rows."""
    w = Window.partitionBy(*subject)
    return features.withColumn(out, F.try_divide(F.col(value), F.avg(F.when(reference, F.col(value))).over(w)))


def class_rates(results: DataFrame, condition: str, learner: str) -> DataFrame:
    """condition, learners, subjects, rate; the control's rate is the false-positive rate."""
    return batch_rates(results, F.col(condition), learner).withColumnRenamed("batch", condition)


def confounds(subjects: DataFrame, learner: str, measures: list[str]) -> DataFrame:
    """measure, the medians of non-learners and learners, and their rank test."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    long = subjects.select(F.col(learner), F.inline(cells))
    tests = mann_whitney(long, ["measure"], F.col(learner), "value")
    for name, part in (("median_learners", F.col(learner)), ("median_others", ~F.col(learner))):
        tests = median(long, ["measure"], F.when(part, F.col("value")), name, "confounds").join(tests, "measure")
    return tests


def epoch_points(features: DataFrame, subject: list[str], block: str, epochs: dict[str, list], value: str) -> DataFrame:
    """subject, epoch, value: the median over the epoch's blocks, where the subject has all of them."""
    parts = [
        F.struct(
            F.lit(name).alias("epoch"),
            F.when(F.array_size(F.array_distinct(F.collect_list(F.when(F.col(block).isin(blocks), F.col(block))))) == len(blocks),
                   F.median(F.when(F.col(block).isin(blocks), F.col(value)))).alias("value"),
        )
        for name, blocks in epochs.items()
    ]
    rows = features.groupBy(*subject).agg(*[p.alias(f"_e{k}") for k, p in enumerate(parts)])
    return rows.select(*subject, F.inline(F.array(*[f"_e{k}" for k in range(len(parts))]))).filter("value is not null")
