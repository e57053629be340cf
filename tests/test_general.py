"""The general training-data operators: skewed counts, radius pairs, surplus deliveries."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftline.operators.deliveries import DeliveryIndex, surplus_deliveries
from driftline.operators.nearby import VantageTree, local_pairs, pairs_within, separation_arcsec, unit_vectors
from driftline.operators.skew import heavy_keys, salted_distinct, stale_counts
from driftline.runtime import within

COUNTS = "name string, month int, candid long, stored int, k string, p string, salt string"


def count_rows():
    rng = random.Random(4)
    rows = [("hot", rng.choice([1, 2, None]), rng.choice([None, *range(60)]), rng.choice([None, 5]), "x", "y", "z") for _ in range(900)]
    rows += [(rng.choice(["a", "b", "", None]), 1, rng.randrange(9), 3, None, None, None) for _ in range(90)]
    return rows + rows[:40]


def test_salted_counts_equal_plain_ones(spark):
    rows = count_rows()
    df = spark.createDataFrame(rows, COUNTS)
    want = {}
    for name, month, candid, stored, *_ in rows:
        if name is not None:
            n, ids, kept = want.setdefault((name, month), [0, set(), []])
            want[name, month][0] += 1
            ids.update([candid] if candid is not None else [])
            kept.extend([stored] if stored is not None else [])
    want = {k: (n, len(i), min(s, default=None), max(s, default=None)) for k, (n, i, s) in want.items()}
    for sizes in ({}, {"share": 0.1, "rows_per_salt": 20}):
        got = {(r.name, r.month): (r.n_rows, r.n_distinct, r.stored_min, r.stored_max) for r in salted_distinct(df, "name", "month", "candid", "stored", **sizes).collect()}
        assert got == want
    stale = {(r.name, r.month) for r in stale_counts(df, "name", "month", "candid", "stored", share=0.1, rows_per_salt=20).collect()}
    assert stale == {k for k, v in want.items() if v[2] is not None and (v[2] != v[1] or v[3] != v[1])}


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame(count_rows(), COUNTS)
    assert {r.heavy_key for r in heavy_keys(df, "name", 0.3, 10).collect()} == {"hot"}
    assert heavy_keys(df, "name", 0.3, 10_000).count() == 0


def test_an_item_delivered_often_crosses_the_exchange_once_a_task(spark):
    df = spark.range(200_000, numPartitions=4).selectExpr("'hot' as name", "1 as month", "7L as candid", "1 as stored")
    out = salted_distinct(df, "name", "month", "candid", "stored", rows_per_salt=1000)
    assert [(r.n_rows, r.n_distinct) for r in out.collect()] == [(200_000, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    first_exchange = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "salt" in first_exchange and "HashAggregate" in plan.split(first_exchange)[1].splitlines()[1]


def test_counts_of_nothing(spark):
    assert salted_distinct(spark.createDataFrame([], COUNTS), "name", "month", "candid", "stored").count() == 0


def brute(points, radius):
    out = set()
    for i, (n1, c1, ra1, d1) in enumerate(points):
        for n2, c2, ra2, d2 in points[i + 1 :]:
            if n1 == n2 and n1 is not None and None not in (c1, c2, ra1, d1, ra2, d2) and c1 != c2 and all(map(math.isfinite, (ra1, d1, ra2, d2))):
                if separation_arcsec(*(np.array([x]) for x in (ra1, d1, ra2, d2)))[0] <= radius:
                    out.add((n1, min(c1, c2), max(c1, c2)))
    return out


def sky_points(n, seed, spot=0.3):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        night = rng.choice([1, 1, 1, 2])
        if rng.random() < spot:
            ra, dec = rng.choice([(0.0, 10.0), (359.99, 89.9), (180.0, -89.99), (-0.005, 10.0)])
            ra, dec = ra + rng.gauss(0, 0.03), min(90.0, dec + rng.gauss(0, 0.03))
        else:
            ra, dec = rng.uniform(-180, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        out.append((night, c, ra, dec))
    return out


def test_pairs_equal_brute_force_with_small_cells_and_blocks(spark):
    points = sky_points(400, 1) + [(1, 900, None, 1.0), (1, 901, float("nan"), 1.0), (None, 902, 0.0, 10.0), (1, None, 0.0, 10.0), (1, 903, 5.0, float("inf"))]
    points += [(1, 910 + k, 77.0, 7.0) for k in range(30)] + points[:20]  # one hot spot, copies
    df = spark.createDataFrame([(*p, "x", 1) for p in points], "nid int, candid long, ra double, dec double, grp string, cell int")
    for sizes in ({"cell_points": 10}, {"cell_points": 40, "max_pivots": 3, "part_points": 50}, {}):
        found = [(r.nid, r.a, r.b) for r in pairs_within(df, "candid", "ra", "dec", "nid", 150.0, **sizes).collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(sorted(set(points), key=repr), 150.0)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "nid int, candid long, ra double, dec double")
    assert pairs_within(df, "candid", "ra", "dec", "nid", 10.0).count() == 0


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10_000), st.integers(0, 300), st.floats(1.0, 40_000.0))
def test_tree_misses_no_pair(seed, n, radius):
    points = sky_points(n, seed)
    lon, lat = np.array([p[2] for p in points]), np.array([p[3] for p in points])
    i, j, sep = local_pairs(lon, lat, radius)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    a, b = np.triu_indices(n, 1)
    near = separation_arcsec(lon[a], lat[a], lon[b], lat[b]) <= radius
    assert got == set(zip(a[near].tolist(), b[near].tolist()))
    if n:
        assert len(VantageTree(unit_vectors(lon, lat)).order) == n


DELIVERY = "candid long, received_at timestamp, delivery_id long, batch_id int, prefix string, lost string"


def deliveries(seed, n=500):
    rng, start = random.Random(seed), dt.datetime(2020, 1, 1)
    rows = []
    for d in range(n):
        candid = 7 if rng.random() < 0.35 else rng.choice([None, *range(1000, 1200)])
        at = None if rng.random() < 0.05 else start + dt.timedelta(seconds=rng.randrange(50))
        rows.append((candid, at, d, rng.choice([None, *range(12)]), "a", None))
    return rows


def surplus_of(rows):
    best = {}
    key = lambda r: (r[1] is None, r[1] or dt.datetime.min, r[2])
    for r in rows:
        if r[0] is not None and (r[0] not in best or key(r) < key(best[r[0]])):
            best[r[0]] = r
    return sorted((r[0], r[2]) for r in rows if r[0] is not None and r is not best[r[0]])


@pytest.mark.parametrize("waves", [1, 2, 6])
def test_surplus_is_all_but_the_first_received(spark, waves):
    rows = deliveries(waves)
    df = spark.createDataFrame(rows, DELIVERY)
    got = surplus_deliveries(df, "candid", "received_at", "delivery_id", "batch_id", waves=waves, prefix_rows=100).collect()
    assert sorted((r.candid, r.delivery_id) for r in got) == surplus_of(rows)


def test_index_is_opened_again_merges_splits_and_keeps_one_each(spark, tmp_path):
    rows, lost = [(c % 20, 100 - c, c) for c in range(60)], []
    for k in range(5):  # another process each time: nothing but the folder is handed on
        index = DeliveryIndex(spark, str(tmp_path), prefixes=3, merge_every=2, prefix_rows=4)
        lost += [(r.id, r.delivery) for r in index.ingest(spark.createDataFrame(rows[k * 12 : k * 12 + 12], "id long, at long, delivery long")).collect()]
    index = DeliveryIndex(spark, str(tmp_path), prefixes=99)
    assert index.prefixes in (6, 12) and len(index.runs) < 5
    kept = {(r.id, r.delivery) for r in index.kept().collect()}
    assert kept == {(c % 20, c) for c in range(40, 60)} and sorted(lost) == sorted((c % 20, c) for c in range(40))
    index.vacuum()
    again = DeliveryIndex(spark, str(tmp_path))
    assert {(r.id, r.delivery) for r in again.kept().collect()} == kept and len(within(spark, str(tmp_path))) == 2


def test_a_batch_that_failed_leaves_the_index_as_it_was(spark, tmp_path):
    index = DeliveryIndex(spark, str(tmp_path), prefixes=2)
    index.ingest(spark.createDataFrame([(1, 1, 1)], "id long, at long, delivery long"))
    with pytest.raises(Exception):
        index.ingest(spark.sql("select 2L as id, 1L as at, cast(raise_error('lost') as bigint) as delivery"))
    assert {(r.id, r.delivery) for r in DeliveryIndex(spark, str(tmp_path)).kept().collect()} == {(1, 1)}


def test_surplus_of_nothing_and_of_repeated_rows(spark):
    assert surplus_deliveries(spark.createDataFrame([], DELIVERY), "candid", "received_at", "delivery_id", "batch_id").count() == 0
    row = (5, dt.datetime(2020, 1, 1), 9, 1, None, None)
    got = surplus_deliveries(spark.createDataFrame([row] * 3, DELIVERY), "candid", "received_at", "delivery_id", "batch_id").collect()
    assert [(r.candid, r.delivery_id) for r in got] == [(5, 9), (5, 9)]
