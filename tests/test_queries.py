from pathlib import Path

import duckdb
import numpy as np
import pytest
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

import __spark_entry__ as entry
from onsetlab import staging
from onsetlab.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    expected, columns = rows_of_sql(con, registry.SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


def test_quality_rules_of_a_subject_without_silent_trials(spark, tmp_path):
    rows = [(2 * k + j, 1, f"2024-01-{1 + 2 * k:02d} 0{j}:00:00", ("purchase", "view")[j], 95.0) for k in range(12) for j in range(2)]
    rows += [(100 + k, 2, f"2024-01-{1 + 2 * k:02d} 00:00:00", "purchase", 95.0) for k in range(3)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = rows_of(registry.QUERIES["quality_rules"](spark, str(tmp_path)))
    assert got == rows_of_sql(con, registry.SQL["quality_rules"])[0]
    assert got == [(3, "few trials", 2), (None, "quiet baseline", 1)]


def test_round_trip_writes_no_file_for_each_recording(spark, tmp_path):
    df = spark.range(300).selectExpr("id event_id", "id user_id", "'purchase' event_type", "1.0D value", "timestamp_ntz'2024-01-01 00:00:01' ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    folder = Path(staging.shared_dir(spark).removeprefix("file:"))
    texts = lambda: sum(p.suffix in (".txt", ".csv") for p in folder.rglob("part-*"))
    before = texts()
    assert registry.QUERIES["recordings_round_trip"](spark, str(tmp_path)).count() == 300
    assert 0 < texts() - before < 100


def test_mixed_events_fits_all_events_of_all_subjects(spark, tmp_path):
    sizes = [1, 2, 7, 39, 40, 41, 90, 200]
    rng = np.random.default_rng(4)
    rows = [(u, float(rng.normal(30, 8))) for u, n in enumerate(sizes) for _ in range(n)]
    rows = [(k, u, "2024-01-01 00:00:00", "view", v) for k, (u, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.subject: r for r in registry.QUERIES["mixed_events"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(sizes)))

    y = {u: np.array([v + 20 * (u % 7) for _, w, _, _, v in rows if w == u]) for u in range(len(sizes))}
    n, m = np.array(sizes), np.array([y[u].mean() for u in y])
    within = sum(((v - v.mean()) ** 2).sum() for v in y.values())

    def reml(ratio):  # of the variances between and within; the residual variance is profiled out
        w = n / (1 + n * ratio)
        mu = (w * m).sum() / w.sum()
        df = n.sum() - 1
        s2 = (within + (w * (m - mu) ** 2).sum()) / df
        return df * np.log(s2) + np.log(1 + n * ratio).sum() + np.log(w.sum()), mu

    best = min(np.exp(np.linspace(-3, 6, 200_001)), key=lambda r: reml(r)[0])
    mu = reml(best)[1]
    for u, r in got.items():
        shrink = n[u] * best / (1 + n[u] * best)
        assert abs(r.fixed - mu) < 0.01 and abs(r.blup - (mu + shrink * (m[u] - mu))) < 0.01


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
