"""Mixed-effects and keyed linear models from sufficient statistics.

One aggregate over the rows gives each subject's sums of products; every later step is arithmetic on
them. The statistics table (one row per subject and model) is written once, and each step of a fit is one
more aggregate over it, in arrays of many subjects; the driver sees only small matrices and scalars.

Variances are found by scoring: the gradient of the (restricted) likelihood against the average curvature,
both from the same pass. A step that loses likelihood is halved, and where that does not help an EM step
(from the same sums) is taken instead, so the likelihood only rises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onsetlab.functions.columns import two_sided_p
from onsetlab.staging import staged


def _sums(columns: list[Column], y: Column) -> list[Column]:
    """Sums of products of the columns with each other and with y, then of y with itself, then the count."""
    k = len(columns)
    pairs = [F.sum(columns[i] * columns[j]) for i in range(k) for j in range(i, k)]
    return [F.array(*pairs).alias("aa"), F.array(*[F.sum(c * y) for c in columns]).alias("ay"), F.sum(y * y).alias("yy"), F.count(y).alias("n")]


#: Keys that ``mixed_by_key`` fits at most: the driver holds a state for each.
MAX_KEYS = 10_000
#: Relative change of the variances at which a fit has converged.
TOLERANCE = 1e-8


def _squares(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric k-by-k matrices from rows of their upper triangles."""
    out = np.zeros((len(flat), k, k))
    rows, columns = np.triu_indices(k)
    out[:, rows, columns] = flat
    out[:, columns, rows] = flat
    return out


def _stacked(frame: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sums of a frame's subjects as arrays: k-by-k products, products with y, y'y, n."""
    if not len(frame):
        return np.zeros((0, k, k)), np.zeros((0, k)), np.zeros(0), np.zeros(0)
    aa, ay = np.stack(frame["aa"].to_list()).astype(float), np.stack(frame["ay"].to_list()).astype(float)
    return _squares(aa, k), ay, frame["yy"].to_numpy(float), frame["n"].to_numpy(float)


@dataclass
class Fit:
    """A fitted model; ``rounds`` are its passes over the subjects, ``converged`` is false where they ran out."""

    beta: np.ndarray
    covariance: np.ndarray
    G: np.ndarray
    sigma2: float
    rounds: int
    converged: bool
    n: int


class MixedModel:
    """y = X b + Z u + e with u ~ N(0, G) by subject, fitted by scoring (REML or ML).

    ``x`` and ``z`` are numeric columns (literals for intercepts); rows with a null are left out.
    """

    def __init__(self, df: DataFrame, subject: list[str], y: Column, x: list[Column], z: list[Column]) -> None:
        self.subject, self.p, self.q = subject, len(x), len(z)
        columns = [c.cast("double") for c in (*x, *z)]
        names = [f"_a{i}" for i in range(len(columns))]
        rows = df.select(*subject, y.cast("double").alias("_y"), *[c.alias(n) for c, n in zip(columns, names, strict=True)])
        rows = rows.dropna(subset=["_y", *names])
        stats = rows.groupBy(*subject).agg(*_sums([F.col(n) for n in names], F.col("_y")))
        self.stats = staged(stats, "mixed-stats")

    def fit(self, reml: bool = True, rounds: int = 100, tolerance: float = TOLERANCE) -> Fit:
        fits = _fit(self.stats, None, self.p, self.q, reml, rounds, tolerance)
        if None not in fits:
            raise ValueError("no complete rows to fit, or terms that depend on each other")
        return fits[None]

    def blups(self, fit: Fit, effect: int = 0) -> DataFrame:
        """subject, fixed, random, blup, se and 95 % bounds of one effect (same place in x and z).

        se combines the fixed effect's variance with the conditional variance of the random one.
        """
        p, k, subject = self.p, self.p + self.q, self.subject
        fixed, fixed_var = float(fit.beta[effect]), fit.covariance[effect, effect]

        def run(frames):
            for frame in frames:
                products, with_y, _, _ = _stacked(frame, k)
                zz, zx = products[:, p:, p:], products[:, p:, :p]
                S = _conditional(zz, fit.G, fit.sigma2)
                u = np.einsum("mab,mb->ma", S, with_y[:, p:] - zx @ fit.beta)[:, effect] / fit.sigma2
                se = np.sqrt(fixed_var + np.maximum(S[:, effect, effect], 0.0))
                out = frame[subject].copy()
                out["fixed"], out["random"] = fixed, u
                out["blup"], out["se"] = fixed + u, se
                out["ci_lower"], out["ci_upper"] = out["blup"] - 1.96 * se, out["blup"] + 1.96 * se
                yield out

        fields = [f for f in self.stats.schema if f.name in subject]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        numbers = "fixed double, random double, blup double, se double, ci_lower double, ci_upper double"
        return self.stats.mapInPandas(run, f"{schema}, {numbers}")


# --- one pass and one step of a fit ---


def _conditional(zz: np.ndarray, G: np.ndarray, s: float) -> np.ndarray:
    """The conditional variances of the random effects, also for a singular G."""
    return G @ np.linalg.inv(np.eye(len(G)) + zz @ G / s)


def _lengths(p: int, q: int) -> list[int]:
    """Sizes of what a pass sums up, in the order of ``_contributions``."""
    return [(q * (p + 1)) ** 2, q * q, q**4, (p + 1) ** 2, (p + 1) ** 2, q * q, 1, 1, 1, 1, 1]


def _contributions(products: np.ndarray, with_y: np.ndarray, yy: np.ndarray, n: np.ndarray, p: int, G: np.ndarray, s: float) -> np.ndarray:
    """Over all given subjects: the sums that the likelihood at (G, s), its gradient and its average curvature are made of.

    With D = (X, y) and W the inverse variance of a subject: products of Z'WD, Z'WZ, its Kronecker square,
    D'WD, D'WWD, Z'WWZ, tr W, tr WW, log|V|, n, subjects.
    """
    zz = products[:, p:, p:]
    zd = np.concatenate([products[:, p:, :p], with_y[:, p:, None]], axis=2)
    dd = np.concatenate([
        np.concatenate([products[:, :p, :p], with_y[:, :p, None]], axis=2),
        np.concatenate([with_y[:, None, :p], yy[:, None, None]], axis=2),
    ], axis=1)
    S = _conditional(zz, G, s)
    S = (S + S.transpose(0, 2, 1)) / 2
    dz = zd.transpose(0, 2, 1)
    zwd, zwz = (zd - zz @ S @ zd / s) / s, (zz - zz @ S @ zz / s) / s
    dwd = (dd - dz @ S @ zd / s) / s
    dwwd = (dd - 2 * dz @ S @ zd / s + dz @ S @ zz @ S @ zd / s**2) / s**2
    zwwz = (zz - 2 * zz @ S @ zz / s + zz @ S @ zz @ S @ zz / s**2) / s**2
    sz = S @ zz
    tr = lambda a: np.einsum("maa->", a)
    logdet = (n * np.log(s)).sum() + np.linalg.slogdet(np.eye(len(G)) + zz @ G / s)[1].sum()
    c = zwd.reshape(len(n), -1)
    return np.concatenate([x.ravel() for x in (
        c.T @ c, zwz.sum(0), np.einsum("mab,mcd->acbd", zwz, zwz), dwd.sum(0), dwwd.sum(0), zwwz.sum(0),
        np.array([(n.sum() - tr(sz) / s) / s, (n.sum() - 2 * tr(sz) / s + tr(sz @ sz) / s**2) / s**2, logdet, n.sum(), float(len(n))]),
    )])


class _State:
    """Where a fit stands: the variances, and what the last pass said about them."""

    def __init__(self, p: int, q: int, G: np.ndarray, s: float, reml: bool) -> None:
        self.p, self.q, self.G, self.s, self.reml = p, q, G, s, reml
        self.best, self.halved, self.done, self.passes = None, 0, False, 0

    def take(self, sums: np.ndarray, tolerance: float) -> None:
        """Judge the pass at the present variances, and go on to the next ones or be done."""
        self.passes += 1
        p, q = self.p, self.q
        T, B, K, M, MM, Z2, tr_w, tr_ww, logdet, n, groups = np.split(sums, np.cumsum(_lengths(p, q))[:-1])
        M, MM, T = M.reshape(p + 1, p + 1), MM.reshape(p + 1, p + 1), T.reshape(q, p + 1, q, p + 1)
        Ai = np.linalg.inv(M[:p, :p])
        beta = Ai @ M[:p, p]
        w = np.r_[-beta, 1.0]
        level = -0.5 * (logdet[0] + w @ M @ w + (np.linalg.slogdet(M[:p, :p])[1] if self.reml else 0.0))
        if self.best and level < self.best["level"] - 1e-10 * (1 + abs(level)):  # lost likelihood: go back half the way, or an EM step
            self.halved += 1
            if self.halved <= 3:
                self.G, self.s = (self.G + self.best["G"]) / 2, (self.s + self.best["s"]) / 2
            elif self.halved == 4:
                self.G, self.s = self.best["em"]
            else:  # not even that gains: at the top, up to rounding
                self.G, self.s, self.done = self.best["G"], self.best["s"], True
            return
        moved = np.inf if not self.best else max(
            np.abs(self.G - self.best["G"]).max() / max(np.abs(self.best["G"]).max(), 1e-3 * self.s), abs(self.s - self.best["s"]) / self.s
        )
        R = np.einsum("aibj,i,j->ab", T, w, w)
        Q, lost = B.reshape(q, q).copy(), tr_w[0]
        if self.reml:
            Q -= np.einsum("aibj,ij->ab", T[:, :p, :, :p], Ai)
            lost -= (Ai * MM[:p, :p]).sum()
        gradient = (R - Q) / 2
        slope = (w @ MM @ w - lost) / 2
        em = (self.G + self.G @ (R - Q) @ self.G / groups[0], max(self.s + self.s**2 * 2 * slope / n[0], self.s / 10))
        self.best = {"G": self.G, "s": self.s, "level": level, "em": em, "beta": beta, "Ai": Ai, "n": int(n[0])}
        self.halved = 0
        if moved < tolerance:
            self.done = True
            return
        # Average curvature in the lower triangle of G and s, and the step against it.
        cells = [(a, b) for a in range(q) for b in range(a + 1)]
        E = [np.array([[float((i, j) in ((a, b), (b, a))) for j in range(q)] for i in range(q)]) for a, b in cells]
        flat, K = [e.ravel() for e in E], K.reshape(q * q, q * q)
        curve = np.zeros((len(E) + 1, len(E) + 1))
        for i, e in enumerate(flat):
            curve[i, :-1] = [e @ K @ f / 2 for f in flat]
            curve[i, -1] = curve[-1, i] = (E[i] * Z2.reshape(q, q)).sum() / 2
        curve[-1, -1] = tr_ww[0] / 2
        step = np.linalg.lstsq(curve, np.r_[[(gradient * e).sum() for e in E], slope], rcond=None)[0]
        G = self.G + sum(x * e for x, e in zip(step, E, strict=False))
        values, vectors = np.linalg.eigh((G + G.T) / 2)
        self.G, self.s = (vectors * np.maximum(values, 0.0)) @ vectors.T, max(self.s + step[-1], self.s / 10)


def _pass(stats: DataFrame, key: str | None, p: int, q: int, at: dict) -> dict:
    """For each key its sums at the variances ``at`` (key to (G, s)), made on the executors."""
    size = sum(_lengths(p, q))

    def run(frames):
        total: dict = {}
        for frame in frames:
            groups = [(None, frame)] if key is None else frame.groupby(key, sort=False)
            for k, rows in groups:
                if k in at and len(rows):
                    total[k] = total.get(k, 0.0) + _contributions(*_stacked(rows, p + q), p, *at[k])
        rows = [(str(i), j, float(v)) for i, k in enumerate(at) if k in total for j, v in enumerate(total[k])]
        yield pd.DataFrame(rows, columns=["k", "j", "v"]).astype({"j": "int64", "v": "float64"})

    columns = ([] if key is None else [key]) + ["aa", "ay", "yy", "n"]
    got = stats.select(*columns).mapInPandas(run, "k string, j long, v double").groupBy("k", "j").agg(F.sum("v").alias("v"))
    names, out = list(at), {}
    for r in got.collect():  # ``size`` numbers a key, and keys are bounded
        out.setdefault(names[int(r["k"])], np.zeros(size))[r["j"]] = r["v"]
    return out


def _fit(stats: DataFrame, key: str | None, p: int, q: int, reml: bool, rounds: int, tolerance: float) -> dict:
    """A fit for each value of ``key`` (or under None), all in the same passes. Keys with dependent terms are left out."""
    keys = [None] if key is None else [r[0] for r in stats.select(key).distinct().limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} values of {key}")
    states = {}
    nothing = np.zeros((q, q))
    for k, sums in _pass(stats, key, p, q, {k: (nothing, 1.0) for k in keys}).items():
        _, _, _, dd, _, _, _, _, _, n, groups = np.split(sums, np.cumsum(_lengths(p, q))[:-1])
        dd, n = dd.reshape(p + 1, p + 1), n[0]
        if groups[0] and n > p and np.linalg.matrix_rank(dd[:p, :p]) == p:
            beta = np.linalg.solve(dd[:p, :p], dd[:p, p])
            s = max((dd[p, p] - beta @ dd[:p, p]) / (n - p), 1e-12) / 2
            states[k] = _State(p, q, np.eye(q) * s, s, reml)
    for _ in range(rounds):
        open_ = {k: t for k, t in states.items() if not t.done}
        if not open_:
            break
        for k, sums in _pass(stats, key, p, q, {k: (t.G, t.s) for k, t in open_.items()}).items():
            open_[k].take(sums, tolerance)
    return {
        k: Fit(t.best["beta"], t.best["Ai"], t.best["G"], t.best["s"], t.passes, t.done, t.best["n"]) for k, t in states.items() if t.best
    }


def keyed_ols(df: DataFrame, keys: list[str], y: Column, x: list[Column], names: list[str]) -> DataFrame:
    """Least squares for each key: keys, n, term, estimate, se, z (ML variance), solved row by row from sums.

    With one row per subject in a key a random intercept is not identifiable, so this is what a
    per-trial mixed model comes to. Keys with fewer rows than terms, or dependent terms, give nulls.
    """
    columns = {f"_a{i}": c.cast("double") for i, c in enumerate(x)}
    rows = df.select(*keys, y.cast("double").alias("_y"), *[c.alias(n) for n, c in columns.items()]).dropna(subset=["_y", *columns])
    stats = rows.groupBy(*keys).agg(*_sums([F.col(n) for n in columns], F.col("_y")))
    k = len(x)

    def solve(frames):
        for frame in frames:
            est, ses = [], []
            for a, b, yy, n in zip(*_stacked(frame, k), strict=True):
                if n < k or np.linalg.matrix_rank(a) < k:
                    est.append([None] * k)
                    ses.append([None] * k)
                    continue
                inv = np.linalg.inv(a)
                w = inv @ b
                s2 = max(float(yy - w @ b), 0.0) / n
                est.append(w.tolist())
                ses.append(np.sqrt(s2 * np.diag(inv)).tolist())
            out = frame[[*keys, "n"]].copy()
            out["estimate"], out["se"] = est, ses
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name in keys)
    solved = stats.mapInPandas(solve, f"{fields}, n long, estimate array<double>, se array<double>")
    zipped = F.arrays_zip(F.array(*map(F.lit, names)).alias("term"), "estimate", "se")
    out = solved.select(*keys, "n", F.inline(zipped)).toDF(*keys, "n", "term", "estimate", "se")
    return out.withColumn("z", F.try_divide("estimate", "se"))


def change_feature(
    df: DataFrame, subject: list[str], y: str, epoch: str, control: str, covariates: list[str] | None = None, rounds: int = 100
) -> tuple[DataFrame, Fit]:
    """Control-anchored change between two epochs (0 and 1) by subject.

    The controls are fitted first; their effect of the epoch is subtracted from all, the model is
    refitted, and the effect is added back to each subject's epoch slope. With fewer than three
    controls the plain fit is used.
    """
    cov = [F.col(c) for c in covariates or []]
    x, z = [F.col(epoch), F.lit(1.0), *cov], [F.col(epoch), F.lit(1.0)]
    controls = df.filter(F.col(control))
    effect = 0.0
    if controls.select(*subject).distinct().limit(3).count() >= 3:
        effect = float(MixedModel(controls, subject, F.col(y), x, z).fit(rounds=rounds).beta[0])
    shifted = F.col(y) - F.lit(effect) * F.col(epoch)
    model = MixedModel(df, subject, shifted, x, z)
    fit = model.fit(rounds=rounds)
    out = model.blups(fit, 0)
    for c in ("fixed", "blup", "ci_lower", "ci_upper"):
        out = out.withColumn(c, F.col(c) + F.lit(effect))
    return out, fit


def fit_table(spark: SparkSession, fit: Fit, names: list[str]) -> DataFrame:
    """term, estimate, se, z, p of a fit's fixed effects."""
    se = np.sqrt(np.diag(fit.covariance))
    rows = [(n, float(b), float(s)) for n, b, s in zip(names, fit.beta, se, strict=True)]
    out = spark.createDataFrame(rows, "term string, estimate double, se double")
    return out.withColumn("z", F.try_divide("estimate", "se")).withColumn("p", two_sided_p("z"))


def dummies(column: str, levels: list, first: bool = False) -> tuple[list[Column], list[str]]:
    """0/1 columns of the levels but the first (the reference), and their names."""
    used = levels if first else levels[1:]
    return [(F.col(column) == F.lit(v)).cast("double") for v in used], [f"{column}[{v}]" for v in used]


def ancova(df: DataFrame, subject: list[str], y: str, covariate: str, condition: str, conditions: list, block: str, blocks: list, rounds: int = 100) -> DataFrame:
    """y ~ covariate + condition * block with a random intercept by subject: a row per term."""
    a, an = dummies(condition, conditions)
    b, bn = dummies(block, blocks)
    cross = [(p * q, f"{pn}:{qn}") for p, pn in zip(a, an, strict=True) for q, qn in zip(b, bn, strict=True)]
    x = [F.lit(1.0), F.col(covariate), *a, *b, *[c for c, _ in cross]]
    model = MixedModel(df, subject, F.col(y), x, [F.lit(1.0)])
    return fit_table(df.sparkSession, model.fit(rounds=rounds), ["intercept", covariate, *an, *bn, *[n for _, n in cross]])


def mixed_by_key(
    df: DataFrame, key: str, subject: list[str], y: Column, x: list[Column], z: list[Column], names: list[str], rounds: int = 100,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One REML fit for each value of ``key`` (blocks or trials, so few), all in the same passes.

    Returns key, term, estimate, se, z, p, n, converged. Each step is one aggregate over the table of sums by
    (key, subject) for all keys that are not done. Keys with dependent terms are left out; more than
    ``MAX_KEYS`` keys are an error.
    """
    spark = df.sparkSession
    model = MixedModel(df.filter(F.col(key).isNotNull()), [key, *subject], y, x, z)
    kind = model.stats.schema[key].dataType.simpleString()
    rows = [
        (k, n, float(b), float(s), t.n, t.converged)
        for k, t in _fit(model.stats, key, len(x), len(z), True, rounds, tolerance).items()
        for n, b, s in zip(names, t.beta, np.sqrt(np.diag(t.covariance)), strict=True)
    ]
    out = spark.createDataFrame(rows, f"`{key}` {kind}, term string, estimate double, se double, n long, converged boolean")
    return out.withColumn("z", F.try_divide("estimate", "se")).withColumn("p", two_sided_p("z"))
