"""Scans over chunks give what a plain loop over the whole recording gives, for runs longer than a chunk, null keys and gaps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetlab import staging
from onsetlab.operators import chunks, clock, intervals, signal

ROWS = 7
KEYS = (None, 0, 1, 2)


def recordings(seed, n=120):
    """Rows (k, f, v) of a few keys: long runs, single rows, nulls; key 2 has one row and key 1 misses frames."""
    rng, rows = random.Random(seed), []
    for k in KEYS:
        v = 0.0
        for f in range(1 if k == 2 else n):
            if rng.random() < 0.12:
                v = rng.choice([0.0, 5.0, 6.0, 9.0])
            if k == 1 and 30 <= f < 60:
                continue
            rows.append((k, f, None if rng.random() < 0.05 else v + rng.randint(0, 1)))
    return rows


def by_key(rows):
    return {k: [(f, v) for q, f, v in rows if q == k] for k in KEYS}


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return recordings(1)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, f long, v double").repartition(5).cache()


def runs_of(seq, on):
    out, open_ = [], None
    for f, v in seq:
        if on(v):
            open_ = (open_[0], f, open_[2] + 1, max(open_[3], v)) if open_ else (f, f, 1, v)
        elif open_:
            out.append(open_)
            open_ = None
    return out + [open_] * bool(open_)


def test_islands(table, rows):
    got = chunks.islands(table, ["k"], "f", F.col("v") >= 5, ROWS, top=("max", F.col("v")))
    want = [(k, *r) for k, s in by_key(rows).items() for r in runs_of(s, lambda v: v is not None and v >= 5)]
    assert found(got, "k", "start", "end", "n", "top") == sorted(want, key=str)
    assert max(r[3] for r in want) > 2 * ROWS


def bouts_of(seq, gap, duration):
    if not seq:
        return []
    runs = [(a, b + 1) for a, b, _, _ in runs_of([(f, v if seq[0][0] < f < seq[-1][0] else None) for f, v in seq], lambda v: v is not None and v >= 5)]
    out = []
    for a, b in runs:
        if out and a - out[-1][1] < gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [r for r in out if r[1] - r[0] >= duration]


@pytest.mark.parametrize("gap", [1, 3, 11])
def test_bouts_are_the_same_in_chunks_and_whole(spark, gap):
    rows = [r for r in recordings(gap) if not (r[0] == 1)]  # frames count rows
    df = spark.createDataFrame(rows, "k int, f long, v double")
    want = [(k, a, b, n + 1) for k, s in by_key(rows).items() for n, (a, b) in enumerate(bouts_of(s, gap, 2))]
    for size in (ROWS, 10_000):
        assert found(intervals.bouts(df, ["k"], "f", "v", 5, gap, 2, rows=size), "k", "start", "end", "bout_no") == sorted(want, key=str)


def test_unions_in_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice(KEYS), a, a + rng.choice([0, 1, 3, 60])) for a in (rng.randint(0, 900) for _ in range(150))]
    df = spark.createDataFrame(rows, "k int, s long, e long")
    want = []
    for k in KEYS:
        out = []
        for a, b in sorted((a, b) for q, a, b in rows if q == k):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        want += [(k, *r) for r in out]
    for bucket in (10, 37, 10_000, None):
        assert found(intervals.merged_intervals(df, ["k"], "s", "e", bucket), "k", "s", "e") == sorted(want, key=str)


def test_running_sums_neighbours_and_fills(table, rows):
    got = chunks.running_sums(table.withColumn("x", F.col("v") - 4), ["k"], "f", {"x": "upto"}, ROWS)
    got = chunks.running_sums(got, ["k"], "f", {"x": "before"}, ROWS, inclusive=False)
    got = chunks.neighbours(chunks.neighbours(got, ["k"], "f", F.col("v"), "last", ROWS), ["k"], "f", F.col("v"), "next", ROWS, ahead=True)
    got = chunks.filled(chunks.filled(got, ["k"], "f", F.col("v"), "held", ROWS), ["k"], "f", F.col("v"), "coming", ROWS, ahead=True)
    want = []
    for k, seq in by_key(rows).items():
        v = [x for _, x in seq]
        for i, (f, _) in enumerate(seq):
            add = [x - 4 for x in v[: i + 1] if x is not None]
            less = [x - 4 for x in v[:i] if x is not None]
            held = next((x for x in reversed(v[: i + 1]) if x is not None), None)
            coming = next((x for x in v[i:] if x is not None), None)
            want.append((k, f, sum(add), sum(less), v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None, held, coming))
    plain = lambda rs: sorted((tuple(None if x is None else float(x) for x in r) for r in rs), key=str)
    assert plain(found(got, "k", "f", "upto", "before", "last", "next", "held", "coming")) == plain(want)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles(spark, limit):
    rng = np.random.default_rng(3)
    rows = [(None if k == 3 else k, None if rng.random() < 0.1 else float(rng.integers(0, 6 + 40 * k))) for k in range(4) for _ in range([1, 2, 60, 101][k])]
    rows += [(9, None), (9, None), (8, 1.5)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.quantiles for r in staging.quantiles(df, ["k"], "v", shares, limit=limit).collect()}
    for k in {k for k, _ in rows}:
        v = [x for q, x in rows if q == k and x is not None]
        assert (got[k] is None) == (not v)
        if v:
            assert np.allclose(got[k], np.quantile(v, shares))
    assert len(got) == len({k for k, _ in rows})
    everything = [x for _, x in rows if x is not None]
    assert np.isclose(staging.median(df, [], "v", "m").first().m, np.median(everything))
    assert "ObjectHashAggregate" not in staging.quantiles(df, ["k"], "v", shares, limit=limit)._jdf.queryExecution().toString()


def test_positions(spark):
    rows = [(k, 1000 - i, i % 3) for k in KEYS for i in range(1 if k == 2 else 90)]
    df = spark.createDataFrame(rows, "k int, t long, x int").repartition(6)
    got = found(staging.positions(df, ["k"], ["t"], "n"), "k", "t", "x", "n")
    assert got == sorted([(k, t, x, sorted(u for q, u, _ in rows if q == k).index(t)) for k, t, x in rows], key=str)
    plan = staging.positions(df, ["k"], ["t"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7, 8, 30])
def test_rolling_extremes_equal_the_sliding_frame(table, rows, window):
    rows = [r for r in rows if r[0] != 1]
    got = signal.rolling_extreme(table.filter("k is null or k <> 1"), ["k"], "f", "v", window, "high")
    got = signal.rolling_extreme(got, ["k"], "f", "v", window, "low", largest=False)
    lo, hi = signal.centered(window)
    want = []
    for k, seq in by_key(rows).items():
        v = [x for _, x in seq]
        for i, (f, _) in enumerate(seq):
            part = v[max(i + lo, 0) : i + hi + 1]
            whole = len(part) == window and None not in part
            want.append((k, f, max(part) if whole else None, min(part) if whole else None))
    assert found(got, "k", "f", "high", "low") == sorted(want, key=str)


def test_lost_frames_with_drift_of_both_signs(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in KEYS:
        t, times = 0.0, []
        for f in range(2 if k == 2 else 200):
            times.append(t)
            t += 1.4286 + rng.choice([0, 0.001, -0.001]) + (1.4286 * 3 if f in (50, 51, 120) else 0) - (1.4286 / 2 if f in (90, 150) else 0)
        rows += [(k, f, x) for f, x in enumerate(times)]
        gaps = [None, *np.diff(times)]
        typical = np.median(gaps[1:])
        steady = [g is not None and abs(g - typical) <= 0.01 for g in gaps]
        anchors = [i for i in range(1, len(gaps) - 1) if steady[i - 1] and steady[i] and steady[i + 1]]
        if not anchors:
            want[k] = (None, 0)
            continue
        inside = [gaps[i] for i in range(anchors[0] + 1, anchors[-1] + 1)]
        mean, drift, late, lost = np.mean(inside), 0.0, 0, 0
        for g in inside:
            drift += g - mean
            now = max(np.floor(drift / mean + 1e-9), 0)
            lost += max(now - late, 0)
            late = now
        want[k] = (round(float(mean), 9), int(lost))
    df = spark.createDataFrame(rows, "k int, f long, t double")
    for size in (ROWS, 10_000):
        got = clock.clock_report(df, ["k"], "f", "t", tolerance=0.01, rows=size).collect()
        assert {r.k: (None if r.mean_interval is None else round(r.mean_interval, 9), r.lost) for r in got} == want
    assert max(w[1] for w in want.values()) >= 3


def test_paired_events_over_buckets(spark):
    rng = random.Random(6)
    rows = [(k, t, rng.choice("beex-")) for k in KEYS for t in rng.sample(range(200), 1 if k == 2 else 40)]
    want = []
    for k in KEYS:
        seq = sorted((t, m) for q, t, m in rows if q == k)
        marks = [(t, m) for t, m in seq if m in "be"]
        for i, (t, m) in enumerate(marks):
            if m == "b":
                want.append((k, t, marks[i + 1][0] if i + 1 < len(marks) else seq[-1][0]))
            elif i == 0:
                want.append((k, seq[0][0], t))
    df = spark.createDataFrame([*rows, (0, None, "b")], "k int, t long, m string")
    for bucket in (5, 1000):
        assert found(intervals.paired_events(df, ["k"], "t", F.col("m") == "b", F.col("m") == "e", bucket), "k", "start", "end") == sorted(want, key=str)


def test_paired_events_of_one_time(spark):
    df = spark.createDataFrame([(1, 0, "-"), (1, 3, "b"), (1, 3, "b"), (1, 3, "e"), (1, 5, "b"), (1, 5, "b"), (1, 9, "-")], "k int, t long, m string")
    got = intervals.paired_events(df, ["k"], "t", F.col("m") == "b", F.col("m") == "e")
    assert found(got, "start", "end") == [(3, 3), (3, 3), (5, 5), (5, 9)]
