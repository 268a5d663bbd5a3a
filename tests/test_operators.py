import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetlab.functions import columns as C
from onsetlab.operators import binning, clock, grouptests, intervals, mixed, profiles, quality, signal, trials
from onsetlab.plans import events as ev
from onsetlab.plans import registry
from onsetlab.sources import tables
from onsetlab.staging import sums_before, with_position


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, f long, v double")


def column(df, name, order="f"):
    return [r[name] for r in df.orderBy(order).collect()]


def runs(df):
    return [(r.start, r.end) for r in df.orderBy("start").collect()]


# --- runs

def test_bouts_close_gaps_then_drop_short_then_weak(spark):
    v = [0] * 400
    for a, b in ((10, 49), (58, 90), (150, 189), (199, 238), (260, 299), (340, 381)):
        v[a:b] = [5] * (b - a)
    v[345] = 9
    df = frame(spark, v)
    # 39 rows and 32 rows, 9 apart, are one bout; 39 and 39 rows, 10 apart, are two short ones; 39 is short; 41 stays.
    assert runs(intervals.bouts(df, ["k"], "f", "v", 5, min_gap=10, min_duration=40)) == [(10, 90), (340, 381)]
    assert runs(intervals.bouts(df, ["k"], "f", "v", 5, 10, 40, min_peak=9)) == [(340, 381)]


def test_first_and_last_row_are_inactive(spark):
    df = frame(spark, [5] * 10)
    found = intervals.bouts(df, ["k"], "f", "v", 5, min_gap=2, min_duration=2)
    assert runs(found) == [(1, 9)]
    marked = intervals.mark_bouts(df, found, ["k"], "f", width=4)
    assert column(marked, "bout") == [False] + [True] * 8 + [False]
    assert column(marked, "bout_beg").index(True) == 1 and column(marked, "bout_end").index(True) == 9
    assert column(intervals.mean_inside(marked.withColumn("v", F.col("f") * 1.0), ["k"], "v", "m"), "m")[1:9] == [4.5] * 8


def test_paired_events_repairs_the_borders(spark):
    rows = [("a", t, kind) for t, kind in enumerate(["", "e", "", "b", "", "e", "", "b", ""])]
    df = spark.createDataFrame(rows, "k string, t long, m string")
    assert runs(intervals.paired_events(df, ["k"], "t", F.col("m") == "b", F.col("m") == "e")) == [(0, 1), (3, 5), (7, 8)]


def test_merged_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 4), ("a", 5, 7), ("a", 9, 12), ("b", 1, 2)], "k string, s long, e long")
    got = sorted(map(tuple, intervals.merged_intervals(df, ["k"], "s", "e").collect()))
    assert got == [("a", 0, 7), ("a", 9, 12), ("b", 1, 2)]


# --- joins in time

def test_overlapping_trials_repeat_samples(spark):
    samples = spark.createDataFrame([("a", t, float(t)) for t in range(0, 100)], "k string, t long, v double")
    onsets = spark.createDataFrame([("a", 40, 1), ("a", 49, 2), ("a", 2, 3)], "k string, onset long, trial_no int")
    rows = trials.cut_trials(samples, onsets, ["k"], "t", "onset", -20, 20)
    assert rows.filter("trial_no = 1").count() == rows.filter("trial_no = 2").count() == 41
    head = rows.filter("trial_no = 3")
    assert (head.count(), head.agg(F.min("rel")).first()[0]) == (23, -2)
    shifted = trials.cut_trials(samples, onsets, ["k"], "t", "onset", -20, 20, axis="position").filter("trial_no = 3")
    assert shifted.agg(F.min("rel"), F.max("rel")).first() == (-20, 2)


@pytest.mark.parametrize("direction,strict,want", [
    ("backward", False, [None, 10, 10, 20]), ("backward", True, [None, None, 10, 10]), ("forward", False, [10, 10, 20, 20]), ("forward", True, [10, 20, 20, None]),
])
@pytest.mark.parametrize("bucket", [None, 7, 100])
def test_as_of(spark, direction, strict, want, bucket):
    left = spark.createDataFrame([("a", t) for t in (5, 10, 15, 20)], "k string, t long")
    right = spark.createDataFrame([("a", t, t) for t in (10, 20)], "k string, u long, x long")
    assert column(intervals.as_of(left, right, ["k"], "t", "u", ["x"], direction, strict, bucket=bucket), "x", "t") == want


# --- signal

def test_centred_windows_lean_back_and_must_be_whole(spark):
    df = frame(spark, range(30))
    assert column(signal.boxcar(df, ["k"], "f", "v", 10, "m"), "m") == [None] * 5 + [i - 0.5 for i in range(5, 26)] + [None] * 4
    assert column(signal.rolling_range(df, ["k"], "f", "v", 2, 4, "r"), "r")[2:-1] == [2.0] * 27
    assert column(signal.activity(df, ["k"], "f", "v", 500.0, "a"), "a") == [0.0] + [0.5] * 29
    assert column(signal.trailing_mean(frame(spark, [1, None, 3]), ["k"], "f", "v", 10, "m"), "m") == [1.0, 1.0, 2.0]
    assert column(signal.every_kth(df, ["k"], "f", 7), "f") == [0, 7, 14, 21, 28]


def test_chunks_equal_the_whole(spark):
    df = frame(spark, np.random.default_rng(1).random(500).round(3))
    work = lambda d, keys: signal.boxcar(signal.activity(d, keys, "f", "v", 700.0, "a"), keys, "f", "a", 11, "m")
    whole = column(work(df, ["k"]), "m")
    assert column(signal.chunked(df, ["k"], "f", rows=64, halo=12, work=work), "m") == whole


def test_resampling_equals_interpolation_without_the_last_point(spark):
    x = np.cumsum(np.random.default_rng(2).random(80) * 2)
    df = spark.createDataFrame([("a", float(a), float(np.sin(a))) for a in x], "k string, x double, v double")
    got = signal.resampled(df, ["k"], "x", ["v"]).orderBy("x").collect()
    grid = np.arange(np.ceil(x[0]), np.floor(x[-1]))
    assert [r.x for r in got] == grid.tolist()
    assert np.allclose([r.v for r in got], np.interp(grid, x, np.sin(x)), atol=1e-12)


def test_position_interpolation(spark):
    assert column(signal.position_interpolated(frame(spark, [None, 1, None, None, 4, None]), ["k"], "f", "v", "o"), "o") == [None, 1, 2, 3, 4, 4]


def test_lost_frames(spark):
    t, rows = 0.0, []
    for i in range(200):
        t += 5.0 if i == 100 else 1.0
        rows.append(("a", i, t))
    report = clock.clock_report(spark.createDataFrame(rows, "k string, f long, e double"), ["k"], "f", "e", tolerance=0.005, buffer=3).first()
    assert (report.typical, report.largest, report.first_steady) == (1.0, 5.0, 3)
    assert report.lost >= 1
    steady = spark.createDataFrame([("a", i, i * 1.0) for i in range(50)], "k string, f long, e double")
    assert clock.clock_report(steady, ["k"], "f", "e", 0.005).first().lost == 0


# --- trials

def test_response_features(spark):
    rows = [("a", 1, t, 2.0 if t < 0 else 6.0 if t > 0 else 4.0) for t in range(-4, 5)] + [("b", 1, t, 0.0 if t <= 0 else 1.0) for t in range(-4, 5)]
    rows += [("c", 1, t, None if t < 0 else 1.0) for t in range(-4, 5)]
    df = spark.createDataFrame(rows, "s string, n int, t long, v double")
    got = {r.s: r for r in trials.response_features(df, ["s", "n"], "t", "v", (-4, 0), (0, 4), max_missing=0.5).collect()}
    assert got["a"].mean_baseline == pytest.approx(2.4) and got["a"].mean_response == pytest.approx(5.6)  # both hold t = 0
    assert got["b"].nv is None  # baseline 0
    assert got["c"].mean_baseline is None and got["c"].missing_baseline == pytest.approx(0.8)


def test_constant_baseline_scales_to_null(spark):
    df = spark.createDataFrame([("a", t, 1.0 if t < 0 else 3.0) for t in range(-5, 5)], "s string, t long, v double")
    assert set(column(trials.baseline_scaled(df, ["s"], "t", "v", 0, "x"), "x", "t")) == {None}


def test_blocks_leave_out_other_trials(spark):
    blocks = spark.createDataFrame(trials.contiguous_blocks(5, 10, ["A", "B"]), "block_order int, block string, trial_no int")
    df = spark.createDataFrame([(n,) for n in range(1, 31)], "trial_no int")
    assert trials.with_blocks(df, blocks, ["trial_no"]).count() == 20
    assert trials.with_blocks(df, blocks, ["trial_no"], keep_outside=True).filter("block is null").count() == 10
    assert trials.block_names(4, ["A", "B"]) == ["Early A", "Late A", "Early B", "Late B"]
    assert trials.block_names(3, ["A"]) == ["A part 1", "A part 2", "A part 3"]
    assert trials.block_names(2, ["A"] * 3, ["x", "y"]) == ["x", "y"] and trials.block_names(2, ["A"] * 3) == ["Block 1", "Block 2"]
    assert trials.chosen_blocks(["B"], ["Early A", "Late A", "Early B", "Late B"], ["A", "B"]) == ["Early B", "Late B"]
    assert trials.chosen_blocks(["no"], ["x", "y"]) == ["x", "y"]
    assert trials.rebased_trials(df.filter("trial_no > 4")).agg(F.min("trial_no")).first()[0] == 1
    assert trials.windows(15, (0, 9), "US") == {"baseline": (-24, -9), "response": (-9, 0)}


def test_early_us(spark):
    df = spark.createDataFrame([("a", 1, -1, 1, 5.0), ("a", 1, 1, 2, 6.0), ("a", 2, 1, 0, 7.0)], "s string, n int, t int, us int, v double")
    assert column(trials.without_early_us(df, "t", "us", "v"), "v", "n") == [None, 6.0, 7.0]
    assert column(trials.without_early_us(df, "t", "us", "v", ["s", "n"], drop_trial=True), "v", "n") == [7.0]


def test_eligibility(spark):
    rows = [(s, b) for s, counts in {"x": (3, 3), "y": (3, 0), "z": (1, 1)}.items() for b, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "s string, b int")
    pick = lambda mode: {r.s for r in quality.eligible_subjects(df, ["s"], "b", [0, 1], 2, mode).collect()}
    assert (pick("all"), pick("any")) == ({"x"}, {"x", "y"})
    assert {r.s for r in quality.present_in_all(df, ["s"], "b", [0, 1]).collect()} == {"x", "z"}


def test_first_failing_rule_names_the_reason(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 5, 1), ("c", 5, 9)], "s string, x int, y int")
    got = dict(quality.rule_table(df, ["s"], [("few", F.col("x") < 3), ("low", F.col("y") < 3)]).collect())
    assert got == {"a": "few", "b": "low", "c": None}


def test_tracking_errors(spark):
    df = spark.createDataFrame([("a", [1.0, -3.0]), ("b", [0.5, None]), ("c", [0.1, 0.2])], "k string, v array<double>")
    assert {r.k: r.failed for r in quality.tracking_errors(df, ["k"], "v", 2.0).collect()} == {"a": True, "b": True, "c": False}


# --- statistics

def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_mann_whitney_with_ties(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 6, 30), rng.integers(1, 8, 25)
    df = spark.createDataFrame([("k", False, float(x)) for x in a] + [("k", True, float(x)) for x in b], "k string, g boolean, v double")
    r = grouptests.mann_whitney(df, ["k"], F.col("g"), "v").first()
    assert r.u0 == brute_u(a, b) and brute_u(a, b) + brute_u(b, a) == len(a) * len(b)
    swapped = grouptests.mann_whitney(df, ["k"], ~F.col("g"), "v").first()
    assert swapped.z == pytest.approx(-r.z) and swapped.p == pytest.approx(r.p)


def test_wilcoxon_drops_zeros(spark):
    df = spark.createDataFrame([("k", 0.0, d) for d in (1.0, -1.0, 2.0, 0.0, 3.0, 3.0)], "k string, x double, y double")
    r = grouptests.wilcoxon(df, ["k"], "x", "y").first()
    assert (r.n, r.w_plus) == (5, 1.5 + 3 + 4.5 + 4.5)


def test_adjustments_are_monotone(spark):
    p = [0.001, 0.04, 0.03, 0.2, 0.9]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    holm = column(grouptests.adjusted(df, ["f"], "p", ["i"], "holm"), "p_adj", "p")
    bh = column(grouptests.adjusted(df, ["f"], "p", ["i"], "bh"), "p_adj", "p")
    assert np.allclose(holm, [0.005, 0.12, 0.12, 0.4, 0.9]) and np.allclose(bh, [0.005, 0.2 / 3, 0.2 / 3, 0.25, 0.9])


def test_normal_and_chi2(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 1.959964]
    got = column(spark.createDataFrame([(float(x),) for x in z], "z double").withColumn("p", C.normal_cdf("z")), "p", "z")
    assert np.allclose(got, [0.0013499, 0.1586553, 0.5, 0.6914625, 0.975], atol=1e-6)
    assert C.chi2_quantile(0.95, 2) == pytest.approx(5.991464547) and C.chi2_quantile(0.95, 5) == pytest.approx(11.07049769)


def test_balanced_mixed_model_equals_anova(spark):
    rng = np.random.default_rng(8)
    groups, n = 40, 12
    y = rng.normal(0, 2, groups)[:, None] + rng.normal(0, 1, (groups, n)) + 5
    df = spark.createDataFrame([(i, float(v)) for i in range(groups) for v in y[i]], "s int, y double")
    model = mixed.MixedModel(df, ["s"], F.col("y"), [F.lit(1.0)], [F.lit(1.0)])
    fit = model.fit()
    msw, msb = y.var(axis=1, ddof=1).mean(), n * y.mean(axis=1).var(ddof=1)
    assert fit.converged and fit.sigma2 == pytest.approx(msw, rel=1e-4) and fit.G[0, 0] == pytest.approx((msb - msw) / n, rel=1e-4)
    shrink = fit.G[0, 0] / (fit.G[0, 0] + fit.sigma2 / n)
    got = {r.s: r.random for r in model.blups(fit).collect()}
    assert np.allclose([got[i] for i in range(groups)], shrink * (y.mean(axis=1) - y.mean()), atol=1e-6)


def test_random_slopes_are_recovered(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(120):
        slope, base = rng.normal(1.0, 0.5), rng.normal(2.0, 0.3)
        rows += [(s, e, base + slope * e + rng.normal(0, 0.2)) for e in (0.0, 1.0) for _ in range(8)]
    df = spark.createDataFrame([(s, float(e), float(v), s < 40) for s, e, v in rows], "s int, e double, y double, c boolean")
    out, fit = mixed.change_feature(df, ["s"], "y", "e", "c")
    assert fit.converged and fit.rounds <= 10
    assert fit.G[0, 0] == pytest.approx(0.25, rel=0.4) and fit.sigma2 == pytest.approx(0.04, rel=0.2)
    assert out.agg(F.avg("blup")).first()[0] == pytest.approx(1.0, abs=0.15)


def test_keyed_ols(spark):
    rng = np.random.default_rng(10)
    x = rng.random((2, 50))
    df = spark.createDataFrame([(k, float(x[k, i]), float(3 + 2 * x[k, i] * (k + 1))) for k in (0, 1) for i in range(50)] + [(2, 1.0, 1.0)], "k int, x double, y double")
    got = {(r.k, r.term): r.estimate for r in mixed.keyed_ols(df, ["k"], F.col("y"), [F.lit(1.0), F.col("x")], ["b", "m"]).collect()}
    assert got[0, "m"] == pytest.approx(2) and got[1, "m"] == pytest.approx(4) and got[2, "m"] is None


def test_ledoit_wolf_and_distance(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double")
    ref = profiles.moments(df, ["a", "b", "c"])
    S, mu = np.cov(X.T, bias=True), X.mean(axis=0)
    m = np.trace(S) / 3
    d2 = np.sum((S - m * np.eye(3)) ** 2) / 3
    b2 = min(sum(np.sum((np.outer(r - mu, r - mu) - S) ** 2) for r in X) / 60**2 / 3, d2)
    assert np.allclose(ref.covariance, S) and ref.shrinkage == pytest.approx(b2 / d2)
    got = sorted(r.distance for r in profiles.mahalanobis(df, ["a", "b", "c"], ref).collect())
    P = np.linalg.inv(ref.shrunk)
    assert np.allclose(got, sorted(np.sqrt((r - mu) @ P @ (r - mu)) for r in X))
    Z = np.linalg.inv(np.linalg.cholesky(S)) @ (X - mu).T
    shape = profiles.mardia(df, ["a", "b", "c"]).first()
    assert shape.skewness == pytest.approx(((Z.T @ Z) ** 3).mean()) and shape.kurtosis == pytest.approx((np.sum(Z * Z, axis=0) ** 2).mean())
    loadings, share = profiles.principal_components(df, ["a", "b", "c"])
    assert share.sum() == pytest.approx(1) and np.allclose(loadings.T @ loadings, np.eye(3))


def test_bootstrap_brackets_the_median(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(101)], "k string, i long, v double")
    u = F.pmod(F.xxhash64("i", "replicate"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    r = binning.bootstrap_median(df, ["k"], "v", 60, u).first()
    assert r.median == 50 and 30 < r.low < 50 < r.high < 70
    t = profiles.bootstrap_threshold(df.withColumnRenamed("v", "distance"), "distance", u, 30).first().threshold
    assert 85 < t < 100


# --- columns and sources

def test_array_columns(spark):
    df = spark.createDataFrame([([0.0, np.pi / 2, 1.0],)], "a array<double>")
    r = df.select(C.running_sum("a").alias("s"), C.space_boxcar("a", 3).alias("b"), C.line_points("a", 2.0).alias("p")).first()
    assert r.s == pytest.approx([0, np.pi / 2, np.pi / 2 + 1])
    assert r.b == pytest.approx([np.pi / 4, (np.pi / 2 + 1) / 3, (np.pi / 2 + 1) / 2])
    assert [x for p in r.p for x in p] == pytest.approx([0, 0, 2, 0, 2, 2])
    dense = df.select(F.size(C.dense_points(C.line_points("a", 2.0), 9)).alias("n")).first()
    assert dense.n == 8


def test_bins_and_ramp(spark):
    df = spark.createDataFrame([(float(x),) for x in (-0.5, -0.25, 0.0, 0.25, 0.5)], "t double")
    assert column(df.withColumn("m", C.bin_mid("t", 0.5)), "m", "t") == [-0.75, -0.25, -0.25, 0.25, 0.25]
    ramp = column(spark.range(5).withColumn("r", C.latency_ramp("id", 1, 3, 9.0, 13.0)), "r", "id")
    assert ramp == [9, 9, 11, 13, 13]
    assert column(spark.range(3).withColumn("c", C.clip(F.when(F.col("id") > 0, F.col("id") * 2.0), 0.0, 3.0)), "c", "id") == [None, 2.0, 3.0]


def test_recording_names(spark):
    df = spark.createDataFrame([("20240102_05_Delay-x_RigA-red_wt_6dpf",)], "n string").select(*[c.alias(k) for k, c in C.recording_parts("n").items()])
    assert df.first().asDict() == {"day": "20240102", "subject_no": "05", "condition": "delay-x", "rig": "riga-red", "strain": "wt", "age": "6", "subject": "20240102_05"}


def test_text_sources(spark, tmp_path):
    rec = tmp_path / "raw"
    rec.mkdir()
    (rec / "r1 cam.txt").write_text("ID TotalTime AbsoluteTime\n" + "\n".join(f"{i} {i * 1.5} {1000 + i}" for i in range(6)))
    (rec / "r1 tail tracking.txt").write_text("FrameID angle1 angle0 angle10\n" + "\n".join(f"{i} 0,5 0 1" for i in range(4)) + "\n9 9 9 9\n")
    (rec / "r1 stim control.txt").write_text("Type beg end more\nCycle 30 40 x\nCycle 10 20 x\nReinforcer 15 16 x\n")
    (rec / "r2 stim control.txt").write_text("Type beg end\nCycle 0 20\n")
    clock_rows = tables.read_clock(spark, f"{rec}/*cam.txt", suffix=" cam.txt", skip=2)
    assert [(r.recording_id, r.frame, r.elapsed_ms) for r in clock_rows.orderBy("frame").collect()] == [("r1", i, i * 1.5) for i in range(2, 6)]
    samples = tables.read_samples(spark, f"{rec}/*tracking.txt", suffix=" tail tracking.txt").orderBy("frame").collect()
    assert len(samples) == 4 and samples[0].angles == pytest.approx([0.0, np.degrees(0.5), np.degrees(1.0)], rel=1e-6)
    stim = tables.read_stimuli(spark, f"{rec}/*control.txt", suffix=" stim control.txt")
    assert sorted((r.recording_id, r.stim_type, r.beg_ms, r.stim_no) for r in stim.collect()) == [
        ("r1", "Cycle", 10.0, 1), ("r1", "Cycle", 30.0, 2), ("r1", "Reinforcer", 15.0, 1)
    ]
    assert {r.recording_id for r in tables.discover(spark, str(rec), " stim control.txt").collect()} == {"r1", "r2"}
    assert tables.unfinished(tables.discover(spark, str(rec), " stim control.txt"), stim).first().recording_id == "r2"
    (tmp_path / "ids.txt").write_text("Subject # header\n'a_1', \"a_2\"; a_1\n# none\nb_3\tc\n")
    assert {r.id for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"a_1", "a_2", "b_3", "c"}


def test_latest_dataset_and_log(spark, tmp_path):
    path = str(tmp_path / "d")
    for k in (1, 2, 2):
        tables.write_dataset(spark.range(k), path, "CS", F.lit(k))
    assert tables.latest_dataset(spark, path, "CS").count() == 2
    reasons = spark.createDataFrame([("a", "few"), ("b", None)], "subject string, reason string")
    for _ in range(2):
        tables.append_log(reasons, str(tmp_path / "log"), "rules", F.lit(1))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    with pytest.raises(ValueError, match="missing columns: y, z"):
        tables.conform(spark.range(1), {"id": "long", "y": "long", "z": "long"})


def test_global_positions(spark):
    df = spark.createDataFrame([(i * 7919 % 1009,) for i in range(1009)], "x long")
    got = sorted((r.x, r.at) for r in with_position(df, ["x"], "at", "test").collect())
    assert got == [(i, i) for i in range(1009)]


def test_keyed_mixed_models_equal_single_ones(spark):
    rng = np.random.default_rng(12)
    rows = [(k, s, float(e), float(k + e * (k + 1) + b + rng.normal(0, 0.3))) for k in (1, 2) for s, b in enumerate(rng.normal(0, 1, 25)) for e in range(4)]
    df = spark.createDataFrame(rows, "k int, s int, e double, y double")
    x, names = [F.lit(1.0), F.col("e")], ["b", "e"]
    got = {(r.k, r.term): r for r in mixed.mixed_by_key(df, "k", ["s"], F.col("y"), x, [F.lit(1.0)], names).collect()}
    for k in (1, 2):
        fit = mixed.MixedModel(df.filter(F.col("k") == k), ["s"], F.col("y"), x, [F.lit(1.0)]).fit()
        assert [got[k, n].estimate for n in names] == pytest.approx(fit.beta.tolist(), abs=1e-6)
        assert [got[k, n].se for n in names] == pytest.approx(np.sqrt(np.diag(fit.covariance)).tolist(), abs=1e-6)


def test_sums_before_is_the_same_in_windows_and_partitions(spark):
    rng = np.random.default_rng(13)
    rows = [(int(k), int(x), int(v)) for k, x, v in zip(rng.integers(0, 3, 900), rng.permutation(900), rng.integers(0, 9, 900), strict=True)]
    df = spark.createDataFrame(rows, "k int, x int, v int")
    for order in (["x"], [F.desc("x")]):
        got = [sorted(map(tuple, sums_before(df, ["k"], order, {"v": "s"}, "test", limit).collect())) for limit in (10**6, 10)]
        assert got[0] == got[1] and len(got[0]) == 900


@pytest.mark.parametrize("limit", [0, 1000])
def test_sums_before_keeps_null_keys(spark, limit):
    rows = [(None, 1, 2), (None, 2, 3), ("a", 1, 5), ("a", 2, 7)]
    df = spark.createDataFrame(rows, "k string, o int, v long")
    got = sums_before(df, ["k"], ["o"], {"v": "before"}, "nulls", limit=limit)
    assert {(r.k, r.o): r.before for r in got.collect()} == {(None, 1): 0, (None, 2): 2, ("a", 1): 0, ("a", 2): 5}


@pytest.mark.parametrize("bucket", [None, 2])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_as_of_keeps_null_keys_and_times(spark, bucket, direction):
    left = spark.createDataFrame([("a", 3), ("a", None), (None, 3), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 7, "y"), (None, 1, "z"), (None, 8, "w"), ("a", None, "never")], "k string, rt long, v string")
    got = {(r.k, r.t): r.v for r in intervals.as_of(left, right, ["k"], "t", "rt", ["v"], direction, bucket=bucket).collect()}
    hit = ("x", "z") if direction == "backward" else ("y", "w")
    assert got == {("a", 3): hit[0], ("a", None): None, (None, 3): hit[1], ("b", 9): None}


def test_left_range_join_keeps_samples(spark):
    samples = spark.createDataFrame([("a", 5), ("a", 50), (None, 5), ("a", None)], "k string, t long")
    events = spark.createDataFrame([("a", 4), ("a", 6)], "k string, onset long")
    got = intervals.range_join(samples, events, ["k"], "t", "onset", -2, 2, how="left").collect()
    assert sorted(((r.k or "", r.t or -1, r.onset, r.rel) for r in got), key=str) == sorted(
        [("a", 5, 4, 1), ("a", 5, 6, -1), ("a", 50, None, None), ("", 5, None, None), ("a", -1, None, None)], key=str
    )


@pytest.mark.parametrize("summary", ["sum 0,5", "4 0,5"])
def test_only_the_summary_row_goes(spark, tmp_path, summary):
    (tmp_path / "r1tail tracking.txt").write_text("FrameID angle0\n1 0,1\n2 0,2\n3 0,3\n" + summary + "\n")
    rows = tables.read_samples(spark, f"{tmp_path}/*tail tracking.txt", degrees=False).collect()
    assert sorted(r.frame for r in rows) == [1, 2, 3]


def test_chunks_refuse_a_halo_longer_than_a_chunk(spark):
    with pytest.raises(ValueError):
        signal.chunked(spark.range(3).withColumnRenamed("id", "f"), [], "f", 2, 3, lambda d, k: d)


def test_calibrated_scores_keep_subjects_with_null_features(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2 == 0, float(rng.normal()), None if i == 7 else float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "s int, control boolean, f double, g double")
    got = {r.s: r for r in profiles.calibrated_scores(df, ["s"], "control", {"f": 1, "g": 1}).collect()}
    assert sorted(got) == list(range(60))
    assert (got[7].t_joint, got[7].p_empirical, got[7].is_learner) == (None, None, False) and got[7].votes in (0, 1)
    assert all(r.p_empirical is not None for s, r in got.items() if s != 7)


def test_discard_rules_see_split_blocks_and_subjects_without_trials(spark):
    names = {"both": ["Early Train", "Late Train"], "again": ["Early Train", "Late Re-Train"], "none": ["Early Pre", None], "silent": ["Late Train", "Late Re-Train"]}
    rows = []
    for s, blocks in names.items():
        for n, b in enumerate(blocks, 1):
            active = s != "silent" or n == 2
            rows += [(s, n, 0.5, active, False, b), (s, n, 2.0, False, True, b), (s, n, 9.0, True, False, b)]
    rows += [("short", 1, 0.2, True, True, "Train"), ("endless", 1, 0.5, True, False, "Train")]
    df = spark.createDataFrame(rows, "s string, n int, t double, active boolean, ended boolean, b string")
    subjects = spark.createDataFrame([(s,) for s in (*names, "short", "endless", "absent", "absent", None)], "s string")
    m = quality.us_metrics(df, ["s"], "n", "t", "active", "ended", "b", (0, 3), {"train": "Train", "retrain": "Re-Train"}, subjects)
    got = {r.s: r.reason for r in quality.rule_table(m, ["s"], quality.us_rules("Train", "Re-Train", 0.4, "Retrain")).collect()}
    assert got == {
        "both": None, "again": None, "none": "no Train block found", "silent": "no bouts in Train for trial(s): [1]",
        "short": "US end too short in last trial", "endless": "missing US end in last trial", "absent": "no US trials found", None: "no US trials found",
    }


def test_block_rules_count_absent_blocks_as_none(spark):
    df = spark.createDataFrame([("a", "X", True), ("a", "X", True), ("a", "Y", True), ("b", "X", True), ("b", None, True)], "s string, b string, active_pre boolean")
    counts = quality.block_activity(df, ["s"], "b", ["X", "Y"], ["pre"])
    got = {r.s: r.reason for r in quality.rule_table(counts, ["s"], quality.block_rules(["X", "Y"], "pre", 1, "pre-CS")).collect()}
    assert got == {"a": None, "b": "less than 1 trials with bouts in pre-CS period in Y"}


def dense_likelihood(rows, beta_of, G, s, reml=True):
    """The (restricted) log likelihood of (subject, x, z, y) rows from whole variance matrices."""
    A, b, total = 0.0, 0.0, 0.0
    parts = []
    for subject in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == subject]
        X, Z, y = np.array([r[1] for r in own]), np.array([r[2] for r in own]), np.array([r[3] for r in own])
        V = Z @ G @ Z.T + s * np.eye(len(y))
        W = np.linalg.inv(V)
        A, b, total = A + X.T @ W @ X, b + X.T @ W @ y, total + np.linalg.slogdet(V)[1]
        parts.append((X, y, W))
    beta = np.linalg.solve(A, b)
    quadratic = sum((y - X @ beta) @ W @ (y - X @ beta) for X, y, W in parts)
    return -0.5 * (total + quadratic + (np.linalg.slogdet(A)[1] if reml else 0.0)), beta


@pytest.mark.parametrize(("reml", "spread"), [(True, 0.6), (False, 0.6), (True, 0.0)])
def test_scoring_ends_at_the_top_of_the_likelihood(spark, reml, spread):
    rng = np.random.default_rng(21)
    rows = []
    for subject in range(40):
        u = rng.multivariate_normal([0, 0], [[1.0, spread / 2], [spread / 2, spread]])
        for k in range(int(rng.integers(1, 9))):
            t, c = k / 4, float(rng.normal())
            rows.append((subject, (1.0, t, c), (1.0, t), 2 + 0.5 * t - c + u[0] + u[1] * t + rng.normal(0, 0.5)))
    df = spark.createDataFrame([(r[0], r[1][1], r[1][2], float(r[3])) for r in rows], "s int, t double, c double, y double")
    fit = mixed.MixedModel(df, ["s"], F.col("y"), [F.lit(1.0), F.col("t"), F.col("c")], [F.lit(1.0), F.col("t")]).fit(reml)
    assert fit.converged and (fit.rounds <= 10 or spread == 0)
    best, beta = dense_likelihood(rows, None, fit.G, fit.sigma2, reml)
    assert np.allclose(beta, fit.beta)
    for step in (1e-2, 1e-3):
        for E in (np.array([[1, 0], [0, 0]]), np.array([[0, 0], [0, 1]]), np.array([[0, 1], [1, 0]])):
            for sign in (-1, 1):
                G = fit.G + sign * step * E
                if np.linalg.eigvalsh(G).min() >= 0:
                    assert dense_likelihood(rows, None, G, fit.sigma2, reml)[0] <= best + 1e-7
        for sign in (-1, 1):
            assert dense_likelihood(rows, None, fit.G, fit.sigma2 + sign * step, reml)[0] <= best + 1e-7


def test_registered_model_fits_converge(spark):
    rows = registry.QUERIES["block_models"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.converged for r in rows)
    features = ev.trial_features(spark, "/root/testdata/sf0.001").withColumns({"y": F.log1p("mean_response"), "base": F.log1p("mean_baseline")})
    both = features.filter("block in (1, 2)").withColumns({"epoch": (F.col("block") == 2).cast("double"), "control": F.col("condition") == 0})
    for part in (both, both.filter("control")):
        fit = mixed.MixedModel(part, ["subject"], F.col("y"), [F.col("epoch"), F.lit(1.0), F.col("base")], [F.col("epoch"), F.lit(1.0)]).fit()
        assert fit.converged, fit


def test_exact_p_values_equal_full_enumeration(spark):
    from itertools import combinations, product

    rng, rows, pairs, want = np.random.default_rng(31), [], [], {}
    for k, (n, m) in enumerate([(1, 1), (2, 5), (5, 5), (3, 7), (8, 8), (9, 9), (4, 60)]):
        v = rng.permutation(200)[: n + m].astype(float)
        rows += [(k, i >= n, float(x)) for i, x in enumerate(v)]
        if n + m <= 16:
            ranks = v.argsort().argsort()
            u = lambda chosen, n=n: sum(chosen) - n * (n - 1) / 2
            all_u = np.array([u(c) for c in combinations(range(n + m), n)])
            mine = u(ranks[:n])
            want[k] = min(1.0, 2 * (all_u >= max(mine, n * m - mine)).mean())
    rows += [(9, g, 1.0) for g in (True, False)]
    got = {r.k: r for r in grouptests.mann_whitney(spark.createDataFrame(rows, "k int, g boolean, v double"), ["k"], F.col("g"), "v").collect()}
    assert {k: r.exact for k, r in got.items()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 9: False}
    for k, p in want.items():
        assert got[k].p == pytest.approx(p)
    for k, n in enumerate([1, 2, 6, 10, 51]):
        pairs += [(k, 0.0, float(x)) for x in rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1], n)] + [(k, 1.0, 1.0)]
    pairs += [(9, 0.0, 1.0), (9, 0.0, -1.0)]
    found = {r.k: r for r in grouptests.wilcoxon(spark.createDataFrame(pairs, "k int, x double, y double"), ["k"], "x", "y").collect()}
    for k, n in enumerate([1, 2, 6, 10]):
        sums = np.array([sum((i + 1) * s for i, s in enumerate(c)) for c in product((0, 1), repeat=n)])
        w = found[k].w_plus
        assert found[k].exact and found[k].p == pytest.approx(min(1.0, 2 * (sums >= max(w, n * (n + 1) / 2 - w)).mean()))
    assert not found[4].exact and not found[9].exact


def test_normal_tail_probabilities(spark):
    from math import erfc, sqrt

    z = [k / 10 for k in range(-80, 81)]
    got = column(spark.createDataFrame([(x,) for x in z], "z double").withColumn("p", C.normal_cdf("z")), "p", "z")
    assert np.allclose(got, [erfc(-x / sqrt(2)) / 2 for x in z], atol=2e-7)
