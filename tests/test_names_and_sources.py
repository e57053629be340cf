"""Names, dates, observation lines, sources, state, streams, solver, command line."""

import datetime as dt
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import cli
from driftline.functions import naming
from driftline.functions.sky import difference_magnitude, ecliptic_to_galactic, galactic, lit, planar_angle, position_angle, separation, with_ephemeris
from driftline.operators import orbit_fit
from driftline.operators.follow_up import follow_up
from driftline.operators.nightly import NightState
from driftline.operators.orbit_fit import FAILED, OBLIQUITY_DEG, command_solver, earth, elements_position, fit_orbits, merge_orbits, two_body_fit, two_body_fits
from driftline.runtime import within
from driftline.schema import ALERT, POINT, TRAJECTORY, LinkConfig, coerced
from driftline.sources import alerts as source
from driftline.sources import orbit_files
from driftline.sources.catalogue import aliases, read_catalogue
from driftline.sources.state import ARCHIVED, StateStore, append_orbits, append_statistics, archive_night, statistics, write_archive
from driftline.streaming.nightly import arrivals, closed_days, run_complete, start_nightly, table_stream


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_tags_and_dates(spark):
    n = 3 * 26**2 + 0 * 26 + 7  # digits 3, 0, 7: letters d, a, h
    row = one(spark, naming.base26(F.lit(n)), naming.object_tag(F.lit(n), lit(2451545.25)), naming.jd_to_date(lit(2451544.49)), naming.base26(F.lit(26**7 - 1)))
    assert row.c0 == "aaaadah" and row.c1 == "FF20000101aaaadah" and row.c2 == dt.date(1999, 12, 31) and row.c3 == "zzzzzzz"


def test_designations_do_not_collide(spark):
    day = F.lit("1969-07-20").cast("date")
    names = [r.d for r in spark.range(0, 15_500).select(naming.packed_designation(day, F.col("id")).alias("d")).collect()]
    assert names[0] == "K69O00A".replace("K", "J") and len(set(names)) == 15_500 and None not in names
    assert one(spark, naming.packed_designation(day, F.lit(15_500))).c0 is None


def test_observation_line(spark):
    first = naming.mpc_line(F.lit("J69O00A"), lit(2440423.345602), lit(0.0), lit(0.0), lit(17.4), F.lit(1), F.lit(True))
    second = naming.mpc_line(F.lit("J69O00A"), lit(2440423.345602), lit(1.0), lit(-1.0), lit(17.6), F.lit(2), F.lit(False))
    row = one(spark, first, second, naming.observation_date(lit(2440423.5), False))
    assert len(row.c0) == len(row.c1) == 80
    assert row.c0 == "     J69O00A* C1969 07 20.73040 00 00 00.00 +00 00 00.00         17.4 g      I41".replace("73040", row.c0[26:31])
    assert row.c0[26:31] == f"{20 * 3600 + 17 * 60 + 20}"  # seconds of the day and the hour once more
    assert "00 04 00.00 -01 00 00.00" in row.c1 and row.c1.endswith("17.6 r      I41") and row.c2 == "1969 07 21.00000"


def test_sexagesimal_carries_and_comes_back(spark):
    row = one(spark, naming.sexagesimal(lit(359.99999999), lit(-0.5)), naming.from_sexagesimal(F.lit("-00 30 00")), naming.from_sexagesimal(F.lit("12 30 36.0"), True), naming.sexagesimal(lit(15 * 59.9999999 / 3600), lit(89.9999999)))
    assert row.c0 == "00 00 00.00 -00 30 00.00" and row.c1 == -0.5 and row.c2 == pytest.approx(187.65) and row.c3 == "00 01 00.00 +90 00 00.00"


def test_angles(spark):
    gal, ecl = galactic(lit(192.85948), lit(27.12825)), ecliptic_to_galactic(lit(0.0), lit(0.0))
    row = one(spark, separation(lit(359.9), lit(0.0), lit(0.1), lit(0.0)), planar_angle(lit(0), lit(0), lit(1), lit(0), lit(1), lit(1)), planar_angle(lit(0), lit(0), lit(0), lit(0), lit(1), lit(1)), position_angle(lit(10), lit(0), lit(11), lit(0)), gal[1], ecl[1], galactic(lit(0.0), lit(0.0))[1])
    assert row.c0 == pytest.approx(0.2) and row.c1 == pytest.approx(45) and row.c2 is None and row.c3 == pytest.approx(90)
    assert row.c4 == pytest.approx(90, abs=1e-2) and row.c5 == pytest.approx(row.c6)


def test_magnitude_of_a_difference(spark):
    plus, minus = (difference_magnitude(lit(18.0), lit(0.1), lit(18.0), lit(0.1), F.lit(p)) for p in (True, False))
    row = one(spark, plus[0], minus[0])
    assert row.c0 == pytest.approx(18 - 2.5 * np.log10(2)) and row.c1 is None


def positions(elements, jd, epoch):
    d = elements_position(elements, jd, epoch) - earth(jd)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    ob = np.radians(OBLIQUITY_DEG)
    x, y, z = d.T
    y, z = y * np.cos(ob) - z * np.sin(ob), y * np.sin(ob) + z * np.cos(ob)
    return np.degrees(np.arctan2(y, x)) % 360, np.degrees(np.arcsin(z))


EL, EPOCH = np.array([2.7, 0.12, 8.0, 100.0, 50.0, 200.0]), 2459000.0
JD = EPOCH + np.array([0, 0.03, 3, 3.04, 8, 8.02, 15, 15.03])


def test_solver_recovers_an_orbit_and_spark_agrees_on_its_ephemeris(spark):
    ra, dec = positions(EL, JD, EPOCH)
    found = two_body_fit(JD, ra, dec)
    assert found[1:6] == pytest.approx(EL[:5], rel=1e-3) and found[-1] < 1e-3
    rows = [(1, k, float(a), float(d), float(t), 1, 1, 18.0, "I", True) for k, (a, d, t) in enumerate(zip(ra, dec, JD))] + [(2, 99, 1.0, 1.0, EPOCH, 1, 1, 1.0, "I", True)]
    orbits = fit_orbits(spark.createDataFrame(rows, TRAJECTORY)).collect()
    assert [o.trajectory_id for o in orbits] == [1] and orbits[0].a == pytest.approx(2.7, rel=1e-3)
    names = ["a", "e", "i", "n", "w", "m"]
    times = spark.createDataFrame([(float(t),) for t in JD], "jd double").withColumns({n: lit(x) for n, x in zip(names, EL)} | {"epoch": lit(EPOCH)})
    got = with_ephemeris(times, names, "epoch", "jd").orderBy("jd").collect()
    assert [r.ra for r in got] == pytest.approx(ra.tolist(), abs=1e-4) and [r.dec for r in got] == pytest.approx(dec.tolist(), abs=1e-4)


def test_follow_up_finds_the_alerts_of_an_orbit(spark):
    def rows(times, first):
        ra, dec = positions(EL, times, EPOCH)
        return [(first + k, float(a), float(d), float(t), int(np.floor(t - 2457754.5 + 0.5)), 1, 18.0) for k, (a, d, t) in enumerate(zip(ra, dec, times))]

    points = spark.createDataFrame([(1, *r) for r in rows(JD, 0)], f"trajectory_id long, {POINT}")
    ahead, behind = rows(EPOCH + np.array([20.0, 27.02]), 100), rows(EPOCH - np.array([9.0, 9.03]), 200)
    stray = [(300, ahead[0][1], ahead[0][2] + 0.5, *ahead[0][3:]), (301, ahead[0][1] + 90, ahead[0][2], *ahead[0][3:])]
    alerts = spark.createDataFrame(rows(JD, 0) + ahead + behind + stray, POINT)
    found, orbits = follow_up(points, fit_orbits(points), alerts, step=15, radius_arcsec=20.0)
    assert sorted(r.candid for r in found.collect()) == [*range(8), 100, 101, 200, 201]
    assert sorted(r.candid for r in found.where("assoc_tag = 'E'").collect()) == [100, 101, 200, 201]
    assert orbits.first().a == pytest.approx(2.7, rel=1e-3)


def test_archive_reads_the_months_asked_for(spark, tmp_path):
    alerts = spark.createDataFrame([(c, 201911 + c % 2) for c in range(20)], "candid long, obs_month int")
    write_archive(alerts, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").where("year = 2019 and month = 12").count() == 10
    assert source.archive_scan(spark, f"{tmp_path}/a", 201912, 202001).count() == 10


def test_many_arcs_are_fitted_at_once():
    """One by one they took some 170 ms each; together each comes out as it does alone, arcs without an orbit too."""
    arcs = []
    for k in range(300):
        times = EPOCH + np.linspace(0, 20 + k % 7, 6 + k % 5)
        arcs.append((times, *positions([2.2 + k / 300, 0.05 + k / 2000, 3.0 + k / 20, 40.0, 70.0, 1.2 * k], times, EPOCH)))
    arcs[5], arcs[6] = (arcs[5][0], np.full_like(arcs[5][0], np.nan), arcs[5][2]), tuple(x[:2] for x in arcs[6])
    began = time.process_time()
    found = two_body_fits(arcs)
    assert time.process_time() - began < 10
    assert [k for k, x in enumerate(found) if x is None] == [5, 6]
    for k in (0, 7, 150, 299):
        assert two_body_fit(*arcs[k]) == pytest.approx(found[k], rel=1e-6)
    assert np.mean([x[13] < 1 for x in found if x]) > 0.9


def test_arcs_of_all_lengths_are_fitted_together(monkeypatch):
    """A task with few arcs of many lengths ran the least squares twice for each length."""
    arcs = []
    for k in range(60):
        times = EPOCH + np.linspace(0, 20 + k % 7, 6 + k % 20)
        arcs.append((times, *positions([2.2 + k / 60, 0.05 + k / 400, 3.0 + k / 4, 40.0, 70.0, 6.0 * k], times, EPOCH)))
    alone, runs, fit = [two_body_fit(*arc) for arc in arcs], [], orbit_fit._least_squares
    monkeypatch.setattr(orbit_fit, "_least_squares", lambda *args: runs.append(1) or fit(*args))
    found = two_body_fits(arcs)
    assert len(runs) == 1
    for x, y in zip(found, alone):
        assert x[:7] == pytest.approx(y[:7], rel=1e-4) and x[13] == pytest.approx(y[13], rel=1e-4, abs=1e-3)


def test_arcs_longer_than_a_part_are_fitted():
    times = EPOCH + np.linspace(0, 30, 20_000)
    arcs = [(JD, *positions(EL, JD, EPOCH)), (times, *positions(EL, times, EPOCH)), (times, *positions(EL, times, EPOCH))]
    found = two_body_fits(arcs)
    assert [x[1] for x in found] == pytest.approx([2.7] * 3, rel=1e-3) and max(x[13] for x in found) < 1e-3


def test_a_solver_of_many_is_given_whole_batches(spark):
    def solver(jd, ra, dec):
        raise AssertionError("one by one")

    solver.many = lambda arcs: [None if len(jd) == 4 else [float(len(jd)), float(len(arcs)), *[1.0] * 12] for jd, _, _ in arcs]
    points = spark.range(200).selectExpr("id as trajectory_id", "explode(sequence(1L, 2 + id % 3)) as n").selectExpr("trajectory_id", "n as candid", "n + 2459000D as jd", "1D as ra", "2D as dec")
    got = fit_orbits(points, 3, solver).collect()
    assert {(r.trajectory_id % 3, r.ref_epoch) for r in got} == {(1, 3.0), (2, FAILED)}
    assert sorted(r.trajectory_id for r in got) == [k for k in range(200) if k % 3] and max(r.a for r in got) > 1


def test_arcs_of_a_pair_count_a_shared_alert_once(spark):
    def solver(jd, ra, dec):
        return [float(len(jd)), *[1.0] * 12, float(np.all(np.diff(jd) >= 0))]

    orbits = spark.createDataFrame([(1, 2.5, 0.1, 5.0), (2, 2.5001, 0.1, 5.0)], "trajectory_id long, a double, e double, i double")
    points = spark.createDataFrame([(t, c, float(c), 5.0, EPOCH + c) for t, cs in ((1, (1, 3, 5)), (2, (2, 3, 4)), (9, (7, 8))) for c in cs], "trajectory_id long, candid long, ra double, dec double, jd double")
    got = merge_orbits(orbits, points, solver=solver).collect()
    assert [(r.first, r.second, r.ref_epoch, r.chi_reduced) for r in got] == [(1, 2, 5.0, 1.0)]


def test_solver_failures_are_marked(spark):
    rows = [(1, k, 10.0, 5.0, EPOCH, 1, 1, 18.0, "I", True) for k in range(4)]
    assert fit_orbits(spark.createDataFrame(rows, TRAJECTORY)).first().a == FAILED
    slow = command_solver(["sleep", "5"], lambda *_: None, lambda _: None, timeout=0.2)
    assert slow(JD, JD, JD) is None


def test_solver_texts():
    text = "! Elements\n KEP   1.29E+00 0.2376   3.0 139.1 316.7 42.5\n MJD     59274.5 TDT\n! RMS    2.6-155   2.1E-05   0.0E+00   1.5E-03   4.0E-09   0.0E+00\n"
    got = orbit_files.parse_elements(text)
    assert got[0] == 2459275.0 and got[1:3] == [1.29, 0.2376] and got[7] == 2.6e-155 and got[8] == 2.1e-05
    assert orbit_files.parse_elements("nothing") == [-1.0] * 13
    head = "\n".join("x" * 3 for _ in range(7))
    assert orbit_files.parse_residuals(head + "\n a b 1.58 1 0\n a b 0.61 1 0\n", 2) == [1.58, 0.61]
    assert orbit_files.parse_residuals(head + "\n a b 1.58 1 0\n", 2) == [-1.0, -1.0]
    line = "  1 Jun 2022 22.500 59731.937500   08 43 35.562  -00 20 57.44   6.5  3.6634  3.3086"
    jd, ra, dec, mag = orbit_files.parse_ephemeris("junk\n" + line)[0]
    assert jd == 2459732.4375 and ra == pytest.approx(130.898175) and dec == pytest.approx(-0.349289, abs=1e-6) and mag == 6.5
    options = orbit_files.SolverOptions(n_triplets=-1, verbose=9, ephemeris=7).text()
    assert "\t.n_triplets = 10\n" in options and "\t.verbose = 1\n" in options and "\t.ephem = 0\n" in options
    assert orbit_files.solver_input(["A", "B"]) == "A\nB\n"


def test_observation_files(spark, tmp_path):
    rows = [(t, 10 * t + k, 10.0, 5.0, 2459000.5 + k, 1, 1, 18.0, "I", True) for t in (1, 2) for k in range(3)]
    orbit_files.write_observation_files(spark.createDataFrame(rows, TRAJECTORY), f"{tmp_path}/obs")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/obs", recursiveFileLookup=True).collect()]
    assert len(lines) == 6 and all(len(x) == 80 for x in lines) and sum(x[12] == "*" for x in lines) == 2
    orbit_files.write_observation_files(spark.createDataFrame(rows, TRAJECTORY), f"{tmp_path}/one", buckets=1)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/one/bucket=0").collect()]
    assert [x[12] for x in lines] == ["*", " ", " "] * 2 and len({x[5:12] for x in lines[:3]}) == 1


def test_solver_files_are_read_as_rows(spark, tmp_path):
    good = "! Elements\n KEP   1.29E+00 0.2376D0   3.0 139.1 316.7 42.5\n MJD     59274.5 TDT\n! RMS    2.6-155   2.1E-05   0.0E+00   1.5E-03   4.0E-09   0.0E+00\n"
    (tmp_path / "K21A00B.oel").write_text(good)
    (tmp_path / "K21A00C.oel").write_text("nothing here\n")
    (tmp_path / "K21A00D.oel").write_text(good.replace("316.7", "oops"))
    got = {r.name: r for r in orbit_files.read_elements(spark, str(tmp_path), "*.oel").collect()}
    assert list(got["K21A00B"])[1:] == orbit_files.parse_elements(good)
    assert list(got["K21A00C"])[1:] == list(got["K21A00D"])[1:] == [-1.0] * 13
    (tmp_path / "K21A00B.rwo").write_text("x\n" * 7 + " a b 1.58 1 0\n a b oops 1 0\n")
    rows = orbit_files.read_residuals(spark, str(tmp_path), "*.rwo").collect()
    assert [(r.name, r.place, r.chi) for r in rows] == [("K21A00B", 0, 1.58), ("K21A00B", 1, -1.0)]


def test_text_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ra dec jd magpsf sigmapsf extra\n 1.0  2.0 2459000.6 18.1 0.1 x\n\n3.0 4.0 2459000.7 18.2 bad y\n")
    got = source.text_alerts(spark, f"{tmp_path}/a.txt").orderBy("candid").collect()
    assert [(r.candid, r.ra, r.fid, r.nid, r.not_updated, str(r.last_assoc_date)) for r in got] == [(10, 1.0, 0, 0, True, "2020-05-31"), (11, 3.0, 0, 0, True, "2020-05-31")]
    assert got[1].sigmapsf is None
    (tmp_path / "b.txt").write_text("ra dec\n1 2\n")
    with pytest.raises(ValueError):
        source.text_alerts(spark, f"{tmp_path}/b.txt")


class Service(BaseHTTPRequestHandler):
    asked = 0

    def do_POST(self):
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        n = int(ask["stop"] - ask["start"])
        if self.path == "/count":
            body = n
        else:
            Service.asked += 1
            body = [{"candid": int(ask["start"]) + k, "jd": ask["start"], "ra": 1, "last_assoc_date": "2020-01-02"} for k in range(n - (Service.asked == 1))]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_alert_service_asks_again(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(source.AlertService)
    reader = spark.read.format("alert_service").option("url", f"http://127.0.0.1:{server.server_port}").option("start", "0").option("stop", "6").option("nights", "2")
    got = reader.load()
    rows = got.collect()
    assert sorted(r.candid for r in rows) == list(range(6)) and rows[0].last_assoc_date == dt.date(2020, 1, 2) and Service.asked >= 3
    server.shutdown()


def test_catalogue(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"Number": "(12)", "Name": "Abc", "Principal_desig": "1999 AB1", "Other_desigs": ["1998 CD2", "1999 AB1"]}, {"Principal_desig": "2000 EF3"}]))
    cat = read_catalogue(spark, f"{tmp_path}/m.json")
    got = {(r.principal_desig, r.kind, r.alias) for r in aliases(cat).collect()}
    assert got == {("1999 AB1", "number", "12"), ("1999 AB1", "name", "Abc"), ("1999 AB1", "principal", "1999AB1"), ("1999 AB1", "other", "1998CD2"), ("1999 AB1", "other", "1999AB1"), ("2000 EF3", "principal", "2000EF3")}


def test_coercion(spark):
    df = spark.createDataFrame([("7", "x", "1")], "candid string, RA string, other string")
    got = coerced(df, POINT)
    assert got.dtypes == [("candid", "bigint"), ("ra", "double")] and got.first().ra is None


def test_state_survives(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    assert store.load().last_nid is None
    rows = [(1, 2, 3.0, 4.0, 5.0, 6, 1, 7.0, "I", True)]
    store.save(NightState(spark.createDataFrame(rows, TRAJECTORY), spark.createDataFrame([], POINT), 9, 6))
    store.save(NightState(store.load().trajectories, store.load().old_alerts, 10, 7))
    state = store.load()
    assert (state.next_id, state.last_nid, state.trajectories.count()) == (10, 7, 1)
    store.reset()
    assert store.load().next_id == 10
    store.reset(confirm=True)
    assert store.load().next_id == 0


def test_state_versions_and_archive(spark, tmp_path):
    store, archived = StateStore(spark, f"{tmp_path}/state"), f"{ARCHIVED}"
    for n in (1, 2, 2, 3):  # night 2 comes again, as after a crash
        left = spark.createDataFrame([(n, 10 * n, 1.0, 1.0, 1.0, 1, 1, 1.0, "I")], archived)
        empty = NightState.empty(spark)
        store.save(NightState(empty.trajectories, empty.old_alerts, n, n, left))
    assert store.load().last_nid == 3
    assert sorted((r.trajectory_id, r.until_nid) for r in store.archive().collect()) == [(1, 1), (2, 2), (3, 3)]
    assert sum("/v-" in p for p in within(spark, store.path)) == 2 and len(within(spark, f"{store.path}/records")) == 2
    os.remove(f"{within(spark, f'{store.path}/records')[-1].removeprefix('file:')}/_SUCCESS")  # the last record was not completed
    assert store.load().last_nid == 2


def test_orbit_rows_of_a_run_replace_those_of_its_retry(spark, tmp_path):
    for _ in range(2):
        append_orbits(spark.range(3), f"{tmp_path}/orbits", "7-9")
    append_orbits(spark.range(2), f"{tmp_path}/orbits", "8-12")
    assert spark.read.parquet(f"{tmp_path}/orbits").count() == 5


def test_recovery_by_class(spark):
    known = spark.createDataFrame([("(1)", "MBA"), ("(2)", "MBA"), ("(3)", "Amor"), (None, "Amor")], "number string, orbit_type string")
    names = spark.createDataFrame([(1, "1"), (2, "1"), (3, "2"), (4, "3"), (5, None)], "candid long, ssnamenr string")
    points = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)], "trajectory_id long, candid long")
    got = {r.orbit_type: (r.n_known, r.n_found, r.percent) for r in cli.recovered(known, names, points).collect()}
    assert got == {"MBA": (2, 1, 50.0), "Amor": (1, 0, 0.0)}


def test_archive_and_statistics(spark, tmp_path):
    alerts = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 5, 1, 1.0), (2, 1.0, 1.0, 1.0, 6, 1, 1.0)], POINT)
    for _ in range(2):
        archive_night(alerts.where("nid = 5"), f"{tmp_path}/archive")
        archive_night(alerts.where("nid = 6"), f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 2
    append_statistics(spark, f"{tmp_path}/stats", 5, {"n": 1})
    append_statistics(spark, f"{tmp_path}/stats", 5, {"n": 2})
    assert [(r.nid, r.value) for r in statistics(spark, f"{tmp_path}/stats").collect()] == [(5, 2.0)]


def nights(path, spark):
    rows = []
    for night in (1, 2):
        rows += [(f"o{c}", 10 * night + c, 100.0 + 0.1 * (night + 0.02 * c), 5.0, 2459000.0 + night + 0.02 * c, night, 1, 18.0, 0.1, "x", True, None) for c in (1, 2)]
    spark.createDataFrame(rows, ALERT).write.parquet(path)


def test_command_line(spark, tmp_path, capsys):
    nights(f"{tmp_path}/alerts", spark)
    config = tmp_path / "link.conf"
    config.write_text("[link]\norbit_points = 4\nintra_mag_same = 0.5\nuse_density = no\n")
    base = ["--output", f"{tmp_path}/out", "--config", str(config)]
    cli.main([*base, "associations", "--alerts", f"{tmp_path}/alerts", "--night", "1", "-s"], spark)
    with pytest.raises(ValueError):
        cli.main([*base, "associations", "--alerts", f"{tmp_path}/alerts", "--night", "1"], spark)
    cli.main([*base, "offline", "--alerts", f"{tmp_path}/alerts", "2"], spark)
    assert StateStore(spark, f"{tmp_path}/out/state").load().trajectories.agg(F.count_distinct("trajectory_id")).first()[0] == 1
    cli.main([*base, "stats"], spark)
    cli.main([*base, "solve_orbit"], spark)
    cli.main([*base, "merge_orbit"], spark)
    cli.main([*base, "stats"], spark)
    assert "associations" in capsys.readouterr().out
    assert StateStore(spark, f"{tmp_path}/out/state").load().trajectories.count() == 0
    cli.main([*base, "associations", "--alerts", f"{tmp_path}/alerts", "--night", "2", "-r", "-y"], spark)
    two = spark.read.parquet(f"{tmp_path}/alerts").withColumn("fink_class", F.when(F.col("candid") % 2 == 0, "Solar System MPC").otherwise("Solar System candidate"))
    two.write.parquet(f"{tmp_path}/classes")
    for objects in ("mpc", "candidates"):
        cli.main([*base, "--objects", objects, "associations", "--alerts", f"{tmp_path}/classes", "--night", "1"], spark)
        assert [r.candid % 2 for r in StateStore(spark, f"{tmp_path}/out/{objects}/state").load().old_alerts.collect()] == [int(objects == "candidates")]


def test_config_file(tmp_path):
    path = tmp_path / "c.conf"
    path.write_text("[link]\nseparation_deg = 0.4\nuse_density = yes\nunknown = 1\n")
    cfg = LinkConfig.from_file(str(path))
    assert cfg.separation_deg == 0.4 and cfg.use_density is True and cfg.trajectory_window == 15
    with pytest.raises(FileNotFoundError):
        LinkConfig.from_file(str(tmp_path / "none"))


def test_stream_equals_replay_and_takes_each_night_once(spark, tmp_path):
    nights(f"{tmp_path}/in", spark)
    stream = spark.readStream.schema(ALERT).parquet(f"{tmp_path}/in")
    store = StateStore(spark, f"{tmp_path}/state")
    for log in ("log1", "log2"):  # a second run over the same files must change nothing
        start_nightly(stream, store, LinkConfig(intra_mag_same=0.5), f"{tmp_path}/{log}").awaitTermination()
    state = store.load()
    assert state.last_nid == 2 and state.trajectories.agg(F.count_distinct("trajectory_id")).first()[0] == 1 and state.trajectories.count() == 4


def test_streamed_counts(spark, tmp_path):
    rows = [(k, dt.datetime(2020, 1, 1 + k // 4, 3)) for k in range(12)]
    spark.createDataFrame(rows, "delivery_id long, received_at timestamp").write.parquet(f"{tmp_path}/alerts.parquet")
    stream = table_stream(spark, str(tmp_path), "alerts")
    got = run_complete(arrivals(stream), f"{tmp_path}/out", f"{tmp_path}/log").collect()
    assert sorted((str(r.day), r.n) for r in got) == [("2020-01-01", 4), ("2020-01-02", 4), ("2020-01-03", 4)]
    assert closed_days(stream, "2 days").columns == ["day", "n"]
