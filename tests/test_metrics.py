"""Metrics on small cases with known figures."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.sky import with_ephemeris
from driftline.operators import metrics, ordered, study
from driftline.plans.nights import orbit_merge
from driftline.plans.orbits import ephemeris_alerts

POINTS = "k int, candid int, jd double, nid int, ra double, dec double, fid int, magpsf double"


def nights(spark, lists):
    rows, c = [], 0
    for k, nids in lists.items():
        for n in nids:
            c += 1
            rows.append((k, c, 2459000.0 + n + c * 1e-3, n, 10.0, 5.0 + n * 0.1, 1, 18.0))
    return spark.createDataFrame(rows, POINTS)


def test_run_length_cases(spark):
    # Window 8: 1 has a run of two short gaps, 2 one of three, 3 one of four after a long gap; in 4 each short gap stands
    # alone between long ones and counts as none; in 5 a long gap cuts four short ones into runs of two.
    gaps = {1: [3, 4], 2: [8, 1, 6], 3: [2, 30, 7, 7, 1, 1], 4: [20, 2, 11, 8, 40], 5: [1, 1, 9, 1, 1], 6: [2]}
    lists = {}
    for k, g in gaps.items():
        lists[k] = [0]
        for x in g:
            lists[k].append(lists[k][-1] + x)
    got = {r.k for r in metrics.run_detectable(nights(spark, lists), "k", 8, 6).collect()}
    assert got == {2, 3}


def test_paired_and_followed_nights(spark):
    df = nights(spark, {1: [1, 1, 5, 5, 6, 7], 2: [1, 1, 5, 20, 20, 21], 3: [1, 1, 1, 2, 3, 4], 4: [1, 1, 5], 5: [1, 1, 2, 5, 5, 6, 6]})
    assert {r.k for r in metrics.paired_nights(df, "k").collect()} == {1, 3, 5}
    assert {r.k for r in metrics.followed_nights(df, "k").collect()} == {5}


def test_detectable(spark):
    df = nights(spark, {1: [1, 2, 4], 2: [1, 5, 6], 3: [1, 2]})
    assert {r.k for r in metrics.detectable(df, "k", 3, 2).collect()} == {1}
    assert metrics.detectable(df, "k", 3, 2, strict=True).count() == 0


def test_association_statistics(spark):
    # A tracklet alone; one that grew by an alert; a pair that grew by a tracklet of two; a tracklet with an old alert,
    # which is short and not in the means; the same grown by three alerts, which is. Means: A (1 + 0 + 3) / 3, T (0 + 2 + 0) / 3.
    tags = {0: ["I", "I", "I"], 1: ["I", "I", "A"], 2: ["N", "N", "T", "T"], 3: ["O", "I", "I"], 4: ["O", "I", "I", "A", "A", "A"]}
    rows = [(k, n, float(n), t) for k, of in tags.items() for n, t in enumerate(of)]
    got = metrics.association_statistics(spark.createDataFrame(rows, "trajectory_id int, candid int, jd double, assoc_tag string")).first()
    assert tuple(got)[:4] == (1, 1, 1, 2) and got.mean_alerts_added == pytest.approx(4 / 3) and got.mean_tracklet_alerts_added == pytest.approx(2 / 3)


def test_described_is_bias_corrected(spark):
    values = [1.0, 2.0, 3.0, 4.0, 20.0, float("nan"), None]
    got = metrics.described(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).first()
    skew, kurtosis = duckdb.execute("select skewness(x), kurtosis(x) from unnest(?) as t(x)", [values[:5]]).fetchone()  # both corrected
    assert got.n == 5 and got.median == 3.0 and got.skew == pytest.approx(skew) and got.kurtosis == pytest.approx(kurtosis)


def test_neighbours_counts_and_quantiles_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), c, 2459000 + rng.choice([0.0, 0.5, 1.25, 3.0, 9.5]), rng.choice([None, float("nan"), 1.5, 2.0, 7.25])) for c in range(300)]
    df = spark.createDataFrame(rows, "k string, candid int, jd double, x double")
    want = {}
    for k in ("hot", "b"):
        own = sorted((r[2], r[1]) for r in rows if r[0] == k)
        want |= {c: (own[n - 1][1] if n else None) for n, (_, c) in enumerate(own)}
    got = {r.candid: r.previous and r.previous.candid for r in ordered.with_previous(df, "k", ["candid"]).collect()}
    assert got == want
    for share in (0.001, 0.4):
        counts = {(r.candid, r.n) for r in ordered.with_group_count(df, "k", "n", share).collect()}
        assert counts == {(r[1], sum(x[0] == r[0] for x in rows)) for r in rows if r[0] is not None}
    quantiles = {(r.k, r.q): r.quantile for r in ordered.quantiles(df.where("k is not null"), "k", "x", [0.0, 0.25, 0.37, 0.5, 1.0]).collect()}
    for (k, q), value in quantiles.items():
        assert value == pytest.approx(np.quantile([r[3] for r in rows if r[0] == k and r[3] is not None and r[3] == r[3]], q))
    assert len(quantiles) == 10 and ordered.quantiles(df.limit(0), "k", "x", [0.5]).count() == 0


def test_pair_metrics_without_pairs(spark):
    none = spark.createDataFrame([], "a int, b int")
    some = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert metrics.pair_metrics(none, none).first().precision == 0
    got = metrics.pair_metrics(some, some.limit(1)).first()
    assert (got.true_positive, got.false_positive, got.false_negative, got.precision, got.recall) == (1, 0, 1, 100.0, 50.0)


def test_histogram_and_speed(spark):
    got = study.histogram(spark.createDataFrame([(0.1,), (0.9,), (5.0,), (None,)], "x double"), "x", 0.0, 1.0, 2).orderBy("bin").collect()
    assert [(r.bin, r.n, round(r.cdf, 4)) for r in got] == [(0, 1, 0.3333), (1, 2, 1.0)]
    speeds = [r.speed for r in study.speeds(nights(spark, {1: [1, 2, 4]}), "k").collect()]
    assert speeds == pytest.approx([0.1, 0.1], rel=1e-2)


def test_class_labels_and_reduced_chi(spark):
    paths = {"MB>Outer": "MB", "MB>Hilda": "Hilda", "MB": "MB", "NEA>Apollo": "Apollo", "KBO": "KBO", "Mars-Crosser>Deep": "Mars-Crosser"}
    df = spark.createDataFrame(list(paths.items()), "p string, want string").select(metrics.class_label(F.col("p")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    chi = spark.createDataFrame([([1.0, 2.0],), ([],), ([1.0, -1.0],), (None,)], "r array<double>").select(metrics.reduced_chi(F.col("r")).alias("c"))
    assert [r.c for r in chi.collect()] == [1.5, None, None, None]


def test_orbits_are_predicted_for_all_nights_of_alerts(spark, tmp_path):
    elements = "a double, e double, i double, long_node double, arg_peric double, mean_anomaly double"
    orbit = spark.createDataFrame([(7, 2459000.7, 2.5, 0.1, 5.0, 40.0, 70.0, 10.0)], f"trajectory_id long, ref_epoch double, {elements}")
    orbit.write.parquet(f"{tmp_path}/orbits.parquet")
    times = orbit.withColumn("jd", F.explode(F.array(*[F.lit(2459000.7 + n) for n in (-200, -15, 0, 15, 16, 90)])))
    seen = with_ephemeris(times, ["a", "e", "i", "long_node", "arg_peric", "mean_anomaly"], "ref_epoch", "jd")
    alerts = seen.selectExpr("cast(jd * 10 as long) as candid", "ra", "dec", "jd", "cast(floor(jd - 2457754.5D) as int) as nid", "1 as fid", "18D as magpsf", "cast(null as timestamp) as received_at", "1L as delivery_id")
    alerts.write.parquet(f"{tmp_path}/alerts.parquet")
    got = ephemeris_alerts(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r.trajectory_id for r in got} == {7}


def test_predictions_are_not_broadcast(spark, tmp_path):
    """An orbit is a row for each night and cell, of which the size that Spark expects knows nothing."""
    spark.createDataFrame([], "trajectory_id long, ref_epoch double, a double, e double, i double, long_node double, arg_peric double, mean_anomaly double").write.parquet(f"{tmp_path}/orbits.parquet")
    spark.range(9).selectExpr("id as candid", "1D as ra", "2D as dec", "2459000.5D as jd", "cast(id as int) as nid", "1 as fid", "18D as magpsf", "cast(null as timestamp) as received_at", "1L as delivery_id").write.parquet(f"{tmp_path}/alerts.parquet")
    found = ephemeris_alerts(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_all_arcs_of_a_split_object_are_paired(spark, tmp_path):
    """Four arcs of one orbit, whose elements lie in a row: the nearest alone gives three of the six pairs."""
    elements = "a double, e double, i double, long_node double, arg_peric double, mean_anomaly double"
    orbits = spark.createDataFrame([(k, 2459000.5, 2.5 + d, 0.1, 5.0, 40.0, 70.0, 10.0) for k, d in ((1, 0.0), (2, 1e-4), (3, 3e-4), (4, 7e-4))], f"trajectory_id long, ref_epoch double, {elements}")
    orbits.write.parquet(f"{tmp_path}/orbits.parquet")
    times = orbits.withColumn("a", F.lit(2.5)).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("jd", F.lit(2459000.5) + 6 * F.col("trajectory_id") + 2 * F.col("n"))
    seen = with_ephemeris(times, ["a", "e", "i", "long_node", "arg_peric", "mean_anomaly"], "ref_epoch", "jd")
    seen.selectExpr("trajectory_id", "trajectory_id * 10 + n as candid", "ra", "dec", "jd", "cast(jd - 2457754.5D as int) as nid", "1 as fid", "18D as magpsf").write.parquet(f"{tmp_path}/trajectories.parquet")
    got = {(r.first, r.second) for r in orbit_merge(spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
