"""Rank tests for many keys at once, adjustment of p-values, outliers, pairs.

Ranks come from counts per distinct value and running sums over values, so a test is no task of its own
and a large group is no window of raw rows. Small groups without ties get exact p-values from the null
distribution of the statistic, which depends on the sizes only; all others the normal approximation with tie
and continuity correction. The column ``exact`` tells which.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onsetlab.functions.columns import stars, two_sided_p
from onsetlab.staging import quantiles, sums_before, with_same


def _z(u: Column, mean: Column, variance: Column) -> Column:
    """The continuity-corrected z of a statistic; 0 where the variance is 0."""
    away = F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) * F.signum(u - mean)
    return F.coalesce(F.try_divide(away, F.sqrt(variance)), F.lit(0.0))


#: Rank-sum tests are exact up to this size of the smaller and of the larger group, signed-rank tests up to this number of differences.
SMALLER, LARGER, DIFFERENCES = 8, 50, 50


def _tails(counts: np.ndarray) -> list[float]:
    """P(statistic >= k) for k = 0, 1, ... from the numbers of equally likely cases."""
    return (np.cumsum(counts[::-1])[::-1] / counts.sum()).tolist()


def rank_sum_tails(spark: SparkSession) -> DataFrame:
    """small, large, tails: the null distribution of U for all sizes up to the limits, by recursion over the sizes.

    The largest value belongs to either group: f(n, m, u) = f(n - 1, m, u - m) + f(n, m - 1, u).
    """
    of: dict[tuple[int, int], np.ndarray] = {}
    for n in range(LARGER + 1):
        for m in range(LARGER + 1):
            if min(n, m) > SMALLER:
                continue
            counts = np.zeros(n * m + 1)
            if n == 0 or m == 0:
                counts[0] = 1
            else:
                counts[m:] += of[n - 1, m]
                counts[: n * (m - 1) + 1] += of[n, m - 1]
            of[n, m] = counts
    rows = [(n, m, _tails(c)) for (n, m), c in of.items() if 0 < n <= m and n <= SMALLER]
    return spark.createDataFrame(rows, "small long, large long, tails array<double>")


def signed_rank_tails(spark: SparkSession) -> DataFrame:
    """n, tails: the null distribution of the sum of positive ranks: each rank is in it or not."""
    counts, rows = np.ones(1), []
    for n in range(1, DIFFERENCES + 1):
        counts = np.r_[counts, np.zeros(n)] + np.r_[np.zeros(n), counts]
        rows.append((n, _tails(counts)))
    return spark.createDataFrame(rows, "n long, tails array<double>")


def _with_exact_p(out: DataFrame, tails: DataFrame, on: dict[str, Column], statistic: Column) -> DataFrame:
    """Replace p of tests without ties whose sizes are in ``tails``; ``statistic`` is the larger one of the two sides."""
    named = tails.withColumnsRenamed({k: f"_k_{k}" for k in on})
    same = [c == F.col(f"_k_{k}") for k, c in on.items()]
    out = out.join(F.broadcast(named), [*same, F.col("_ties") == 0], "left")  # as many rows as the limits allow sizes
    p = F.least(F.lit(1.0), 2 * F.get("tails", statistic.cast("int")))
    out = out.withColumns({"p": F.coalesce(p, F.col("p")), "exact": F.col("tails").isNotNull()})
    return out.drop("tails", *named.columns)


def mann_whitney(df: DataFrame, keys: list[str], group: Column, value: str, exact: bool = True) -> DataFrame:
    """keys, n0, n1, u0, z, p, exact: group (boolean) false against true, two-sided. Null values are left out."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("_g", group)
    counts = rows.groupBy(*keys, value).agg(
        F.count_if(~F.col("_g")).alias("_a"), F.count_if(F.col("_g")).alias("_b")
    )
    counts = sums_before(counts, keys, [value], {"_b": "_below"}, "rank-test")
    counts = counts.withColumn("_u", F.col("_a") * (F.col("_below") + F.col("_b") / 2)).withColumn("_t", F.col("_a") + F.col("_b"))
    out = counts.groupBy(*keys).agg(
        F.sum("_a").alias("n0"), F.sum("_b").alias("n1"), F.sum("_u").alias("u0"),
        F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("_ties"),
    )
    n = F.col("n0") + F.col("n1")
    variance = F.col("n0") * F.col("n1") / F.lit(12.0) * ((n + 1) - F.coalesce(F.try_divide(F.col("_ties"), n * (n - 1)), F.lit(0.0)))
    z = _z(F.col("u0"), F.col("n0") * F.col("n1") / F.lit(2.0), variance)
    out = out.withColumn("z", z).withColumn("p", two_sided_p("z"))
    if exact:
        sizes = {"small": F.least("n0", "n1"), "large": F.greatest("n0", "n1")}
        out = _with_exact_p(out, rank_sum_tails(df.sparkSession), sizes, F.greatest(F.col("u0"), F.col("n0") * F.col("n1") - F.col("u0")))
    else:
        out = out.withColumn("exact", F.lit(False))
    return out.drop("_ties")


def wilcoxon(pairs: DataFrame, keys: list[str], x: str, y: str, exact: bool = True) -> DataFrame:
    """keys, n, w_plus, z, p, exact: signed-rank test of y - x; zero differences are dropped."""
    d = pairs.withColumn("_d", F.col(y) - F.col(x)).filter("_d <> 0")
    counts = d.groupBy(*keys, F.abs("_d").alias("_v")).agg(
        F.count("*").alias("_t"), F.count_if(F.col("_d") > 0).alias("_plus")
    )
    counts = sums_before(counts, keys, ["_v"], {"_t": "_below"}, "rank-test")
    rank = F.col("_below") + (F.col("_t") + 1) / 2
    out = counts.withColumn("_w", F.col("_plus") * rank).groupBy(*keys).agg(
        F.sum("_t").alias("n"), F.sum("_w").alias("w_plus"), F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("_ties")
    )
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("_ties") / F.lit(48.0)
    z = _z(F.col("w_plus"), n * (n + 1) / F.lit(4.0), variance)
    out = out.withColumn("z", z).withColumn("p", two_sided_p("z"))
    if exact:
        other = n * (n + 1) / 2 - F.col("w_plus")
        out = _with_exact_p(out, signed_rank_tails(pairs.sparkSession), {"n": n}, F.greatest(F.col("w_plus"), other))
    else:
        out = out.withColumn("exact", F.lit(False))
    return out.drop("_ties")


def adjusted(tests: DataFrame, family: list[str], p: str, order: list[str], method: str = "holm", out: str = "p_adj") -> DataFrame:
    """Holm or Benjamini-Hochberg adjustment in each family; ``order`` breaks ties. Tables of tests are small."""
    w = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count(p).over(Window.partitionBy(*family))
    i = F.row_number().over(w)
    if method == "holm":
        raw, frame = F.least(F.lit(1.0), (m - i + 1) * F.col(p)), w.rowsBetween(Window.unboundedPreceding, 0)
        return tests.withColumn("_raw", raw).withColumn(out, F.max("_raw").over(frame)).drop("_raw")
    if method != "bh":
        raise ValueError(f"no method {method!r}")
    frame = w.rowsBetween(0, Window.unboundedFollowing)
    return tests.withColumn("_raw", F.least(F.lit(1.0), m * F.col(p) / i)).withColumn(out, F.min("_raw").over(frame)).drop("_raw")


def with_stars(tests: DataFrame, p: str = "p_adj", out: str = "stars") -> DataFrame:
    return tests.withColumn(out, stars(p))


def iqr_outliers(df: DataFrame, keys: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """The rows outside the quartiles by more than ``factor`` interquartile ranges of their key."""
    fences = quantiles(df, keys, value, [0.25, 0.75], "_q", "iqr-outliers")
    lo, hi = F.element_at("_q", 1), F.element_at("_q", 2)
    reach = (hi - lo) * F.lit(factor)
    joined = with_same(df, fences, keys)
    return joined.filter((F.col(value) < lo - reach) | (F.col(value) > hi + reach)).drop("_q")


def condition_pairs(table: DataFrame, condition: str, block: str, between: bool = True) -> DataFrame:
    """Pairs that occur in the data: two conditions in one block, or two blocks of one condition."""
    cells = table.select(condition, block).distinct()
    fixed, free = (block, condition) if between else (condition, block)
    a = cells.select(F.col(fixed), F.col(free).alias("first"))
    b = cells.select(F.col(fixed), F.col(free).alias("second"))
    return a.join(b, fixed).filter("first < second")


def paired_blocks(table: DataFrame, subject: list[str], block: str, value: str) -> DataFrame:
    """Each subject's values in a block and the next one: block, x, y."""
    a = table.select(*subject, F.col(block), F.col(value).alias("x"))
    b = table.select(*subject, (F.col(block) - 1).alias(block), F.col(value).alias("y"))
    return a.join(b, [*subject, block])


def least_p_term(tests: DataFrame, keys: list[str], p: str, columns: list[str]) -> DataFrame:
    """In each key the row with the least p."""
    return tests.groupBy(*keys).agg(F.min_by(F.struct(*columns), p).alias("_b")).select(*keys, "_b.*")
