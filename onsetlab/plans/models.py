"""Queries of models and subject profiles on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onsetlab.operators import mixed, profiles
from onsetlab.plans import events as ev
from onsetlab.plans.base import query
from onsetlab.plans.events import EV
from onsetlab.staging import median


CHANGES = EV + """, ch AS (SELECT subject, condition, trial_no, ln(1 + mean_response) - ln(1 + mean_baseline) AS d FROM nvt WHERE mean_response IS NOT NULL AND mean_baseline IS NOT NULL),
f AS (SELECT subject, condition, avg(d) FILTER (trial_no <= 4) AS f1, stddev_samp(d) FILTER (trial_no <= 4) / sqrt(count(d) FILTER (trial_no <= 4)) AS se1,
 avg(d) FILTER (trial_no > 4) AS f2, stddev_samp(d) FILTER (trial_no > 4) / sqrt(count(d) FILTER (trial_no > 4)) AS se2, count(d) FILTER (trial_no <= 4) AS n1, count(d) FILTER (trial_no > 4) AS n2
 FROM ch GROUP BY ALL),
g AS (SELECT * FROM f WHERE n1 >= 2 AND n2 >= 2)
"""


def wide_features(spark, sf) -> DataFrame:
    """subject, condition, f1, se1, f2, se2: mean log change in the first four trials and after."""
    rows = ev.trial_features(spark, sf).withColumn("d", F.log1p("mean_response") - F.log1p("mean_baseline")).filter("d is not null")
    cells = []
    for k, part in ((1, F.col("trial_no") <= 4), (2, F.col("trial_no") > 4)):
        d = F.when(part, F.col("d"))
        cells += [F.avg(d).alias(f"f{k}"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias(f"se{k}"), F.count(d).alias(f"n{k}")]
    return rows.groupBy("subject", "condition").agg(*cells).filter("n1 >= 2 and n2 >= 2").drop("n1", "n2")


def long_features(wide: DataFrame) -> DataFrame:
    cell = lambda k: F.struct(F.lit(f"f{k}").alias("feature"), F.col(f"f{k}").alias("value"), F.col(f"se{k}").alias("se"))
    return wide.select("subject", "condition", F.inline(F.array(cell(1), cell(2))))


@query("ols_by_trial", EV + """, r AS (SELECT trial_no, ln(1 + mean_response) AS y, ln(1 + mean_baseline) AS x, condition AS c FROM nvt WHERE mean_response IS NOT NULL AND mean_baseline IS NOT NULL),
s AS (SELECT trial_no, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(c) AS mc, var_pop(x) AS sxx, var_pop(c) AS scc, covar_pop(x, c) AS sxc, covar_pop(x, y) AS sxy, covar_pop(c, y) AS scy FROM r GROUP BY trial_no HAVING count(*) >= 20),
b AS (SELECT *, (scc * sxy - sxc * scy) / (sxx * scc - sxc * sxc) AS bx, (sxx * scy - sxc * sxy) / (sxx * scc - sxc * sxc) AS bc FROM s)
SELECT trial_no, n, 'intercept' AS term, round(my - bx * mx - bc * mc, 5) AS estimate FROM b UNION ALL SELECT trial_no, n, 'baseline', round(bx, 5) FROM b UNION ALL SELECT trial_no, n, 'condition', round(bc, 5) FROM b""")
def ols_by_trial(spark, sf):
    rows = ev.trial_features(spark, sf)
    x = [F.lit(1.0), F.log1p("mean_baseline"), F.col("condition")]
    out = mixed.keyed_ols(rows, ["trial_no"], F.log1p("mean_response"), x, ["intercept", "baseline", "condition"])
    return out.filter("n >= 20").select("trial_no", "n", "term", F.round("estimate", 5).alias("estimate"))


@query("mixed_balanced", """WITH k AS (SELECT vec_id, unnest(embedding)::DOUBLE + 0.5::DOUBLE * (vec_id % 7) AS y FROM embeddings),
g AS (SELECT vec_id, avg(y) AS m, var_samp(y) AS v FROM k GROUP BY vec_id), a AS (SELECT avg(m) AS mu, avg(v) AS msw, 64 * var_samp(m) AS msb FROM g),
l AS (SELECT *, ((msb - msw) / 64) / ((msb - msw) / 64 + msw / 64) AS shrink FROM a) SELECT vec_id, round(mu, 4) AS fixed, round(mu + shrink * (m - mu), 4) AS blup FROM g, l""")
def mixed_balanced(spark, sf):
    """Every vector has as many values as any other, so the variances have a closed form."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.explode("embedding").alias("value"))
    model = mixed.MixedModel(rows, ["vec_id"], F.col("value").cast("double") + 0.5 * (F.col("vec_id") % 7), [F.lit(1.0)], [F.lit(1.0)])
    return model.blups(model.fit()).select("vec_id", F.round("fixed", 4).alias("fixed"), F.round("blup", 4).alias("blup"))


# The ratio of the variances is where the derivative of the profiled restricted likelihood vanishes, found by halving.
UNBALANCED = EV + """, g AS (SELECT subject, count(*)::DOUBLE AS n, avg(y) AS m, coalesce(var_samp(y), 0) * (count(*) - 1) AS ss FROM (SELECT subject, value + 20 * (subject % 7) AS y FROM ev) GROUP BY subject),
arr AS (SELECT list({'n': n, 'm': m}) AS g, sum(ss) AS ss, sum(n) AS n FROM g),
it AS (SELECT 0 AS k, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi UNION ALL
 SELECT k + 1, CASE WHEN d < 0 THEN mid ELSE lo END, CASE WHEN d < 0 THEN hi ELSE mid END FROM (
  SELECT k, lo, hi, mid, sw - sww / sw - (n - 1) * q2 / (ss + q1) AS d FROM (
   SELECT *, list_sum(list_transform(w, lambda x, i: x * pow(g[i].m - mu, 2))) AS q1, list_sum(list_transform(w, lambda x, i: x * x * pow(g[i].m - mu, 2))) AS q2 FROM (
    SELECT *, list_sum(w) AS sw, list_sum(list_transform(w, lambda x: x * x)) AS sww, list_sum(list_transform(w, lambda x, i: x * g[i].m)) / list_sum(w) AS mu FROM (
     SELECT k, lo, hi, (lo + hi) / 2 AS mid, arr.*, list_transform(g, lambda x: x.n / (1 + x.n * exp((lo + hi) / 2))) AS w FROM it, arr WHERE k < 60)))))
, b AS (SELECT exp((lo + hi) / 2) AS r FROM it WHERE k = 60), f AS (SELECT r, sum(n / (1 + n * r) * m) / sum(n / (1 + n * r)) AS mu FROM g, b GROUP BY r)
SELECT subject, round(mu, 3) AS fixed, round(mu + n * r / (1 + n * r) * (m - mu), 3) AS blup FROM g, f"""


@query("mixed_events", UNBALANCED.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1))
def mixed_events(spark, sf):
    """All events of all subjects, groups of unequal size."""
    rows = ev.events(spark, sf)
    y = F.col("value") + 20 * (F.col("subject") % 7)
    model = mixed.MixedModel(rows, ["subject"], y, [F.lit(1.0)], [F.lit(1.0)])
    return model.blups(model.fit()).select("subject", F.round("fixed", 3).alias("fixed"), F.round("blup", 3).alias("blup"))


@query("change_feature")
def change_feature(spark, sf):
    rows = ev.trial_features(spark, sf).filter("block in (1, 2)").withColumns({
        "y": F.log1p("mean_response"), "epoch": (F.col("block") == 2).cast("double"), "control": F.col("condition") == 0, "base": F.log1p("mean_baseline"),
    })
    out, _ = mixed.change_feature(rows, ["subject"], "y", "epoch", "control", ["base"])
    return out


CUSTOMERS = """WITH w AS (SELECT c_custkey, c_custkey % 2 = 0 AS control, avg(o_totalprice) / 1000 AS price, count(*)::DOUBLE AS orders
 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT count(*) AS n, avg(price) AS mp, avg(orders) AS mo, var_pop(price) AS a, var_pop(orders) AS c, covar_pop(price, orders) AS b FROM w WHERE control),
q AS (SELECT m.*, (SELECT avg(pow(pow(price - mp, 2) + pow(orders - mo, 2), 2)) FROM w WHERE control) AS fourth, (a + c) / 2 AS t, a * a + 2 * b * b + c * c AS f2 FROM m),
s AS (SELECT *, (f2 - 2 * t * t) / 2 AS d2, least(greatest((fourth - f2) / (n * 2), 0), (f2 - 2 * t * t) / 2) / ((f2 - 2 * t * t) / 2) AS k FROM q),
v AS (SELECT *, (1 - k) * a + k * t AS sa, (1 - k) * b AS sb, (1 - k) * c + k * t AS sc FROM s),
d AS (SELECT c_custkey, control, sqrt((pow(price - mp, 2) * sc - 2 * (price - mp) * (orders - mo) * sb + pow(orders - mo, 2) * sa) / (sa * sc - sb * sb)) AS distance FROM w, v)
"""


def customer_features(spark, sf) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    out = customers.join(orders, "c_custkey").groupBy("c_custkey")
    out = out.agg((F.avg("o_totalprice") / 1000).alias("price"), F.count("*").cast("double").alias("orders"))
    return out.withColumn("control", F.col("c_custkey") % 2 == 0)


@query("shrunk_distance", CUSTOMERS + "SELECT c_custkey, control, round(distance, 5) AS distance, distance > 2.447746830680816 AS outlier FROM d")
def shrunk_distance(spark, sf):
    rows, features = customer_features(spark, sf), ["price", "orders"]
    out = profiles.mahalanobis(rows, features, profiles.moments(rows.filter("control"), features))
    limit = profiles.chi2_threshold(2)
    return out.select("c_custkey", "control", F.round("distance", 5).alias("distance"), (F.col("distance") > limit).alias("outlier"))


VOTES = CHANGES + """, l AS (SELECT subject, condition, 'f1' AS feature, f1 AS value, se1 AS se, -1 AS s FROM g UNION ALL SELECT subject, condition, 'f2', f2, se2, 1 FROM g),
cm AS (SELECT feature, avg(value) AS mean FROM l WHERE condition = 0 GROUP BY feature),
z AS (SELECT subject, condition, s * (value - mean) AS d, CASE WHEN se > 0 THEN s * (value - mean) / se ELSE 10 * sign(s * (value - mean)) END AS z FROM l JOIN cm USING (feature)),
k AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z),
p AS (SELECT *, 0.3989422804014327 * exp(-z * z / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS tail FROM k),
vt AS (SELECT subject, count_if(d > 0) AS vote_point, count_if(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END >= 0.8) AS vote_prob FROM p GROUP BY subject)
"""


def vote_table(spark, sf) -> DataFrame:
    long = long_features(wide_features(spark, sf))
    return profiles.classify(long, ["subject"], {"f1": -1, "f2": 1}, F.col("condition") == 0).drop("features")


@query("classify_votes", VOTES + "SELECT subject, vote_point, vote_prob FROM vt")
def classify_votes(spark, sf):
    return vote_table(spark, sf)


@query("conservative_votes", VOTES + "SELECT subject, count_if(d - 1.0 * abs(d / nullif(z, 0)) > 0) AS vote_prob FROM z GROUP BY subject")
def conservative_votes(spark, sf):
    long = long_features(wide_features(spark, sf))
    return profiles.classify(long, ["subject"], {"f1": -1, "f2": 1}, F.col("condition") == 0, "conservative").select("subject", "vote_prob")


@query("calibrated_score", CHANGES + """, c AS (SELECT count(*) AS n, sum(f1) AS s1, sum(f2) AS s2, stddev_samp(f1) AS d1, stddev_samp(f2) AS d2 FROM g WHERE condition = 0),
z AS (SELECT subject, condition = 0 AS control, -(f1 - CASE WHEN condition = 0 THEN (s1 - f1) / (n - 1) ELSE s1 / n END) / d1 AS z1, (f2 - CASE WHEN condition = 0 THEN (s2 - f2) / (n - 1) ELSE s2 / n END) / d2 AS z2, n FROM g, c),
m AS (SELECT count(*) AS k, avg(z1) AS m1, avg(z2) AS m2, var_pop(z1) AS a, var_pop(z2) AS cc, covar_pop(z1, z2) AS b FROM z WHERE control),
q AS (SELECT m.*, (SELECT avg(pow(pow(z1 - m1, 2) + pow(z2 - m2, 2), 2)) FROM z WHERE control) AS fourth, (a + cc) / 2 AS t, a * a + 2 * b * b + cc * cc AS f2n FROM m),
s AS (SELECT *, least(greatest((fourth - f2n) / (k * 2), 0), (f2n - 2 * t * t) / 2) / ((f2n - 2 * t * t) / 2) AS sh FROM q),
v AS (SELECT (1 - sh) * a + sh * t AS sa, (1 - sh) * b AS sb, (1 - sh) * cc + sh * t AS sc FROM s),
tt AS (SELECT z.*, (pow(greatest(z1, 0), 2) * sc - 2 * greatest(z1, 0) * greatest(z2, 0) * sb + pow(greatest(z2, 0), 2) * sa) / (sa * sc - sb * sb) AS tj FROM z, v)
SELECT subject, control, round(tj, 5) AS t_joint, round((1 + (SELECT count(*) FROM tt o WHERE o.control AND o.tj >= tt.tj)) / (1.0 + n), 6) AS p_empirical,
(z1 > 0)::INT + (z2 > 0)::INT AS votes, tj > (SELECT quantile_cont(tj, 0.95) FROM tt WHERE control) AND z1 > 0 AND z2 > 0 AS is_learner FROM tt""")
def calibrated_score(spark, sf):
    rows = wide_features(spark, sf).withColumn("control", F.col("condition") == 0)
    out = profiles.calibrated_scores(rows, ["subject"], "control", {"f1": -1, "f2": 1})
    return out.select("subject", "control", F.round("t_joint", 5).alias("t_joint"), F.round("p_empirical", 6).alias("p_empirical"), "votes", "is_learner")


@query("moments", CHANGES + """, m AS (SELECT count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, var_pop(f1) AS a, var_pop(f2) AS c, covar_pop(f1, f2) AS b, corr(f1, f2) AS r FROM g),
d AS (SELECT f1 - m1 AS x, f2 - m2 AS y, a, b, c, a * c - b * b AS det, n, r FROM g, m),
sk AS (SELECT avg(pow((p.x * q.x * p.c - (p.x * q.y + p.y * q.x) * p.b + p.y * q.y * p.a) / p.det, 3)) AS skewness FROM d p, d q)
SELECT any_value(n) AS n, round((SELECT skewness FROM sk), 5) AS skewness, round(avg(pow((x * x * c - 2 * x * y * b + y * y * a) / det, 2)), 5) AS kurtosis, round(any_value(r), 5) AS r FROM d""")
def moments(spark, sf):
    rows = wide_features(spark, sf)
    shape, r = profiles.mardia(rows, ["f1", "f2"]), profiles.correlations(rows, ["f1", "f2"])
    one = shape.join(F.broadcast(r))  # one row each
    return one.select("n", *[F.round(c, 5).alias(c) for c in ("skewness", "kurtosis", "r")])


@query("batch_rates", VOTES + "SELECT (subject // 25)::BIGINT AS batch, count_if(vote_point = 2) AS learners, count(*) AS subjects, round(count_if(vote_point = 2) / count(*), 6) AS rate FROM vt GROUP BY 1")
def batch_rates(spark, sf):
    results = vote_table(spark, sf).withColumn("learner", F.col("vote_point") == 2)
    out = profiles.batch_rates(results, F.floor(F.col("subject") / 25), "learner")
    return out.withColumn("rate", F.round("rate", 6))


@query("subject_summary", VOTES + "SELECT g.subject, round(f1, 6) AS f1, round(f1 - 1.96 * se1, 6) AS f1_lower, round(f2 + 1.96 * se2, 6) AS f2_upper, vote_point, CASE WHEN vote_prob = 2 THEN 3 WHEN vote_point = 2 THEN 2 ELSE 0 END AS status FROM g JOIN vt USING (subject)")
def subject_summary(spark, sf):
    long = long_features(wide_features(spark, sf))
    out = profiles.subject_summary(long, ["subject"], ["f1", "f2"], vote_table(spark, sf))
    status = profiles.status_rank(F.lit(False), F.col("vote_point") == 2, F.col("vote_prob") == 2)
    return out.select("subject", *[F.round(c, 6).alias(c) for c in ("f1", "f1_lower", "f2_upper")], "vote_point", status.alias("status"))


@query("effect_trajectory", CHANGES + """, e AS (SELECT condition, 0 AS epoch, 0.0::DOUBLE AS effect, 0.0::DOUBLE AS se FROM g UNION ALL SELECT condition, 1, f1, se1 FROM g UNION ALL SELECT condition, 2, f1 + f2, sqrt(se1 * se1 + se2 * se2) FROM g)
SELECT condition, epoch, round(median(effect), 6) AS effect, round(median(se), 6) AS se FROM e GROUP BY ALL""")
def effect_trajectory(spark, sf):
    rows = profiles.effect_trajectory(wide_features(spark, sf), ["subject", "condition"], [("f1", "se1"), ("f2", "se2")])
    keys = ["condition", "epoch"]
    out = median(rows, keys, "effect", "effect").join(median(rows, keys, "se", "se"), keys)
    return out.select(*keys, F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"))


@query("feature_ranks", CHANGES + "SELECT subject, feature, row_number() OVER (PARTITION BY feature ORDER BY value) AS rank FROM (SELECT subject, 'f1' AS feature, f1 AS value FROM g UNION ALL SELECT subject, 'f2', f2 FROM g)")
def feature_ranks(spark, sf):
    return profiles.ranked_subjects(long_features(wide_features(spark, sf))).select("subject", "feature", "rank")
