"""Range joins, components, tracklets, links across nights, the nightly step."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.graph import cluster_labels, numbered, path_labels
from driftline.operators.link import end_points, extend_trajectories, new_pairs
from driftline.operators.nearby import separation_arcsec
from driftline.operators.nightly import NightState, evict, guard_night, keep_last_only, process_night, replay
from driftline.operators.pairs import intra_night_pairs, magnitude_pairs, mirror_free, nearest_elements, sky_join, successors
from driftline.operators.tracklets import tracklets
from driftline.plans import linking
from driftline.schema import POINT, TRAJECTORY, LinkConfig

CFG = LinkConfig(intra_separation_arcsec=145.0, separation_deg=0.3, mag_same=5.0, mag_diff=5.0, max_angle_deg=5.0)


def scatter(n, seed):
    rng = random.Random(seed)
    spots = [(0.01, 5.0), (359.99, 5.0), (120.0, 89.95), (300.0, 89.95), (40.0, -89.99)]
    rows = []
    for k in range(n):
        if rng.random() < 0.6:
            ra, dec = rng.choice(spots)
            ra, dec = (ra + rng.gauss(0, 0.5)) % 360, max(-90.0, min(90.0, dec + rng.gauss(0, 0.5)))
        else:
            ra, dec = rng.uniform(0, 359.999), rng.uniform(-90, 90)
        rows.append((k, ra, dec, 2459000.0 + rng.random(), rng.choice([1, 2]), rng.choice([1, 2]), rng.uniform(17, 19)))
    return rows


@pytest.mark.parametrize("radius,height", [(0.5, None), (2.0, 2.0), (0.05, None), (15.0, None), (100.0, None)])
def test_sky_join_equals_brute_force(spark, radius, height):
    rows = scatter(250, 3)
    df = spark.createDataFrame([*rows, (999, float("nan"), 1.0, 0.0, 1, 1, 1.0), (998, None, 1.0, 0.0, 1, 1, 1.0)], POINT)
    found = sky_join(df, df, radius, [("nid", "nid")], radius, height).select("l.candid", F.col("r.candid").alias("other")).collect()
    got = [(r.candid, r.other) for r in found]
    ra, dec, nid = (np.array([r[k] for r in rows]) for k in (1, 2, 4))
    a, b = np.meshgrid(np.arange(len(rows)), np.arange(len(rows)))
    a, b = a.ravel(), b.ravel()
    near = (separation_arcsec(ra[a], dec[a], ra[b], dec[b]) <= radius * 3600) & (nid[a] == nid[b])
    assert len(got) == len(set(got)) and set(got) == set(zip(a[near].tolist(), b[near].tolist()))


def chain(points):
    return [(c, ra, 10.0, jd, 1, 1, 18.0) for c, ra, jd in points]


def test_tracklet_chain_and_choices(spark):
    rows = chain([(1, 10.0, 0.1), (2, 10.01, 0.2), (3, 10.02, 0.3), (4, 50.0, 0.1), (5, 50.0, 0.2), (6, 80.0, 0.1), (7, 80.01, 0.1)])
    df = spark.createDataFrame(rows, POINT)
    pairs = intra_night_pairs(df, 145.0)
    assert {(r[0], r[1]) for r in pairs.select("l.candid", "r.candid").collect()} == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2), (6, 7), (7, 6)}  # 4 and 5 coincide
    links = successors(magnitude_pairs(pairs, 0.2, 0.8)).select("l.candid", "r.candid").collect()
    assert sorted(map(tuple, links)) == [(1, 2), (2, 3)]
    assert mirror_free(pairs).count() == 4
    found, rest = tracklets(df, CFG, 7)
    assert sorted((r.candid, r.trajectory_id) for r in found.collect()) == [(1, 7), (2, 7), (3, 7)]
    assert sorted(r.candid for r in rest.collect()) == [4, 5, 6, 7]


def test_density_clusters_drop_equal_times(spark):
    rows = chain([(1, 10.0, 0.1), (2, 10.03, 0.2), (3, 10.06, 0.3), (6, 80.0, 0.1), (7, 80.01, 0.1), (9, 200.0, 0.5)])
    found, rest = tracklets(spark.createDataFrame(rows, POINT), LinkConfig(intra_separation_arcsec=145.0, use_density=True), 0)
    assert sorted((r.candid, r.trajectory_id) for r in found.collect()) == [(1, 0), (2, 0), (3, 0)]
    assert rest.count() == 3


def test_path_and_cluster_labels(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 200)
    links = list(zip(ids[:99], ids[1:100])) + list(zip(ids[100:199], ids[101:200]))
    df = spark.createDataFrame(links, "u long, v long")
    heads = {r.node: r.head for r in path_labels(df).collect()}
    assert heads == {x: ids[0] for x in ids[:100]} | {x: ids[100] for x in ids[100:]}
    labels = {r.node: r.cluster for r in cluster_labels(df).collect()}
    assert labels == {x: min(ids[:100]) for x in ids[:100]} | {x: min(ids[100:]) for x in ids[100:]}
    assert path_labels(df.limit(0)).count() == 0 and cluster_labels(df.limit(0)).count() == 0


def test_numbers_run_through_all_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x"), F.lit(1).alias("id")).repartition(7)
    assert all(r.n == r.x + 5 for r in numbered(df, ["x"], "n", 5).collect())


def test_nearest_elements_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.gauss(2.5, 0.3), 5.2]), rng.random(), rng.uniform(0, 30)) for k in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 0.1, 1.0), (901, float("nan"), 0.1, 1.0)], "k long, a double, e double, i double")
    got = {}
    for r in nearest_elements(df, "k", ["a", "e", "i"], 5).collect():
        got.setdefault(r.k, {})[r.rank] = r.neighbour
    x = np.array([r[1:] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {k: {n + 1: int(j) for n, j in enumerate(sorted(range(300), key=lambda j: (d[k, j], j))[:5])} for k in range(300)}
    assert got == want


def trajectory(tid, nid, start, step, n, tag="I"):
    return [(tid, 1000 * tid + k, start + k * step, 10.0, 2459000.0 + nid + k * 0.02, nid, 1, 18.0, tag, True) for k in range(n)]


def test_extension_and_forks(spark):
    traj = spark.createDataFrame(trajectory(1, 10, 50.0, 0.001, 3), TRAJECTORY)
    rows = [(1, 50.052, 10.0, 2459011.0, 11, 1, 18.0), (2, 50.060, 10.0, 2459011.1, 11, 1, 18.0), (3, 50.055, 10.0, 2459011.0, 11, 2, 18.0), (4, 49.9, 10.0, 2459011.0, 11, 1, 18.0)]
    alerts = spark.createDataFrame(rows, POINT)
    after, used = extend_trajectories(traj, alerts, alerts, "candid", 11, CFG, "A", 100)
    got = {}
    for r in after.collect():
        got.setdefault(r.trajectory_id, []).append(r.candid)
    old = [1000, 1001, 1002]
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, *old], 100: [2, *old], 101: [3, *old]}  # same filter first, the angle leaves 4 out
    assert used.count() == 3


def test_ends_need_two_points(spark):
    traj = spark.createDataFrame(trajectory(1, 10, 50.0, 0.001, 1) + trajectory(2, 10, 60.0, 0.001, 2), TRAJECTORY)
    assert [r.trajectory_id for r in end_points(traj).collect()] == [2]


def test_old_alerts_pair_with_the_newest_night_that_matches(spark):
    old = spark.createDataFrame([(1, 50.0, 10.0, 2459009.0, 9, 1, 18.0), (2, 50.1, 10.0, 2459010.0, 10, 1, 18.0)], POINT)
    new = spark.createDataFrame([(3, 50.2, 10.0, 2459011.0, 11, 1, 18.0)], POINT)
    rows, used = new_pairs(old, new, 11, CFG, 40)
    assert sorted((r.trajectory_id, r.candid, r.assoc_tag) for r in rows.collect()) == [(40, 2, "N"), (40, 3, "N")]
    assert [(r.old_candid, r.new_candid) for r in used.collect()] == [(2, 3)]


def test_eviction(spark):
    rows = trajectory(1, 10, 0.0, 0.1, 3) + trajectory(2, 10, 0.0, 0.1, 2) + trajectory(3, 18, 0.0, 0.1, 2) + trajectory(4, 1, 0.0, 0.1, 5) + trajectory(5, 19, 0.0, 0.1, 1)
    alerts = spark.createDataFrame([(k, 0.0, 0.0, 0.0, n, 1, 1.0) for k, n in ((1, 17), (2, 18), (3, 19))], POINT)
    recent, old, expired, young = evict(spark.createDataFrame(rows, TRAJECTORY), alerts, 20, LinkConfig())
    ids = [sorted({r.trajectory_id for r in x.collect()}) for x in (recent, old, expired)]
    assert ids == [[1, 3], [4], [2, 5]] and sorted(r.candid for r in young.collect()) == [2, 3]
    kept, rest = keep_last_only(spark.createDataFrame(rows, TRAJECTORY), 10)
    assert sorted({r.trajectory_id for r in kept.collect()}) == [1] and sorted({r.trajectory_id for r in rest.collect()}) == [3, 4, 5]


def moving(nights, seed=0):
    rows, candid = [], 0
    for obj, (ra, dec, speed) in enumerate([(100.0, 5.0, 0.1), (200.0, -20.0, 0.2)]):
        for night in nights:
            for part in (0.1, 0.12):
                candid += 1
                rows.append((candid, ra + speed * (night - nights[0] + part), dec, 2459000.0 + night + part, night, 1, 18.0 + obj))
    return rows


def test_replay_follows_objects_and_loses_no_alert(spark):
    rows = moving([1, 2]) + [(900, 300.0, 40.0, 2459001.5, 1, 1, 20.0)]
    alerts = spark.createDataFrame(rows, POINT)
    cfg = LinkConfig(intra_mag_same=0.5, mag_same=0.5, orbit_points=99)
    state = replay(alerts, [2, 1, 7], cfg)
    groups = {}
    for r in state.trajectories.collect():
        groups.setdefault(r.trajectory_id, []).append(r.candid)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert state.last_nid == 2 and state.next_id > max(groups) and state.old_alerts.count() <= 1
    with pytest.raises(ValueError):
        process_night(state, alerts, 2, cfg)
    again = replay(alerts.repartition(5), [1, 2], cfg)
    assert sorted((r.trajectory_id, r.candid) for r in again.trajectories.collect()) == sorted((r.trajectory_id, r.candid) for r in state.trajectories.collect())


def test_a_tracklet_takes_an_old_alert(spark):
    rows = [(1, 100.0, 5.0, 2459001.1, 1, 1, 18.0)] + [(c, 100.0 + 0.1 * t, 5.0, 2459001.1 + t, 2, 1, 18.0) for c, t in ((2, 1.0), (3, 1.02))]
    state = replay(spark.createDataFrame(rows, POINT), [1, 2], LinkConfig())
    assert sorted((r.candid, r.assoc_tag) for r in state.trajectories.collect()) == [(1, "O"), (2, "I"), (3, "I")]


def test_nights_come_once_and_in_order():
    guard_night(None, 5)
    guard_night(4, 5)
    with pytest.raises(ValueError):
        guard_night(5, 5)


def test_what_expires_is_archived_and_leaves_the_state(spark):
    rows = trajectory(1, 1, 0.0, 0.1, 5) + trajectory(2, 9, 50.0, 0.1, 2) + trajectory(3, 19, 90.0, 0.1, 3)
    state = NightState(spark.createDataFrame(rows, TRAJECTORY), spark.createDataFrame([], POINT), 4, 19)
    after = process_night(state, spark.createDataFrame([], POINT), 20, LinkConfig())
    assert {r.trajectory_id for r in after.trajectories.collect()} == {3}
    assert sorted({(r.trajectory_id) for r in after.archived.collect()}) == [1, 2]


@pytest.mark.parametrize("off", ["tracklets_to_trajectories", "alerts_to_trajectories", "old_alerts_to_tracklets", "old_alerts_to_alerts"])
def test_each_association_can_be_switched_off(spark, off):
    """Four tracks at once: a trajectory met by a tracklet, one met by an alert, an old alert met by a tracklet, and one by an alert."""
    state_rows = trajectory(1, 9, 10.0, 0.002, 2) + trajectory(2, 9, 40.0, 0.002, 2)
    old = [(5001, 70.0, 10.0, 2459009.02, 9, 1, 18.0), (5002, 100.0, 10.0, 2459009.02, 9, 1, 18.0)]
    new = [(1, 10.1, 10.0, 2459010.0, 10, 1, 18.0), (2, 10.101, 10.0, 2459010.02, 10, 1, 18.0), (3, 40.1, 10.0, 2459010.0, 10, 1, 18.0)]
    new += [(4, 70.1, 10.0, 2459010.0, 10, 1, 18.0), (5, 70.102, 10.0, 2459010.02, 10, 1, 18.0), (6, 100.1, 10.0, 2459010.0, 10, 1, 18.0)]
    state = NightState(spark.createDataFrame(state_rows, TRAJECTORY), spark.createDataFrame(old, POINT), 3, 9)
    found = {}
    for cfg in (LinkConfig(), LinkConfig(**{off: False})):
        after = process_night(state, spark.createDataFrame(new, POINT), 10, cfg)
        found[cfg] = {(r.trajectory_id, r.candid, r.assoc_tag) for r in after.trajectories.where("nid = 10 or assoc_tag in ('O', 'N')").collect()}
    whole, less = found.values()
    assert {t for _, _, t in whole} == {"T", "A", "O", "I", "N"} and len(whole) == 8
    gone = {"tracklets_to_trajectories": "T", "alerts_to_trajectories": "A", "old_alerts_to_tracklets": "O", "old_alerts_to_alerts": "N"}[off]
    assert gone not in {t for _, _, t in less} and {t for _, _, t in whole} - {gone} <= {t for _, _, t in less}


def test_empty_state_and_night(spark):
    state = process_night(NightState.empty(spark), spark.createDataFrame([], POINT), 1, LinkConfig())
    assert state.trajectories.count() == 0 and state.old_alerts.count() == 0


def test_continuations_reach_over_the_whole_window(spark, tmp_path):
    """A straight track of 0.1 degrees a night, continued after a gap of 10, 15 and 16 nights."""
    def row(track, night, candid):
        return (candid, 20.0 * track + 0.1 * night, 0.0, 2459000.5 + night, night, 1, 18.0)

    kinds = "candid long, ra double, dec double, jd double, nid int, fid int, magpsf double"
    gaps = {1: 10, 2: 15, 3: 16}
    new = [row(t, 1 + gap, 100 + t) for t, gap in gaps.items()]
    spark.createDataFrame([(*r, None, k) for k, r in enumerate(new)], f"{kinds}, received_at timestamp, delivery_id long").write.parquet(f"{tmp_path}/alerts.parquet")
    old = [(t, *row(t, n, 10 * t + n)) for t in gaps for n in (0, 1)]
    spark.createDataFrame(old, f"trajectory_id long, {kinds}").write.parquet(f"{tmp_path}/trajectories.parquet")
    found = linking.QUERIES["extend_window"](spark, str(tmp_path)).collect()
    assert {(r.trajectory_id, r.candid, r.gap) for r in found} == {(1, 101, 10), (2, 102, 15)}
    assert {r.candid for r in linking.QUERIES["cone_window"](spark, str(tmp_path)).collect()} == {101, 102}
    assert linking.QUERIES["fork_window"](spark, str(tmp_path)).count() == 0
