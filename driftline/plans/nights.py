"""Queries of the nightly step and its passes, of streams and of the orbit solver.

The passes are registered over all nights of the tables; the step takes in one night, and its replay and its stream
three, as a replay of all takes as many steps as there are nights.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.link import end_points, grow, last_points, newest_night_only, ranked, within_cone
from driftline.operators.nightly import NightState, process_night, replay, split_by_size
from driftline.operators.orbit_fit import fit_orbits, merge_orbits
from driftline.operators.pairs import night_pairs
from driftline.operators.tracklets import tracklets
from driftline.functions.sky import planar_angle
from driftline.plans.linking import HEADS, tracklets_sql
from driftline.plans.sql import ALERTS_SQL, TRAJECTORIES_SQL, angle, sep
from driftline.plans.trajectories import NIGHT
from driftline.runtime import new_path, table, written
from driftline.schema import ELEMENTS, POINT_COLUMNS, LinkConfig, unique_alerts, unique_trajectories
from driftline.sources.state import StateStore
from driftline.streaming.nightly import arrivals, run_complete, start_nightly, table_stream

CFG = LinkConfig()
THREE = (NIGHT - 1, NIGHT, NIGHT + 1)


def _tracklets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tracklets of all nights that are short of an orbit, and all alerts."""
    alerts = unique_alerts(spark, sf_dir)
    found = written(tracklets(alerts, CFG, 0)[0], "tracklets").df
    return split_by_size(found, CFG.orbit_points)[0], alerts


def tracklet_to_trajectory(spark, sf_dir):
    """Tracklets, by the candid of their first point, that continue trajectories over the whole window: rank 1 extends, others fork."""
    small, _ = _tracklets(spark, sf_dir)
    heads = last_points(small, 1, newest=False).select(*POINT_COLUMNS)
    ends = end_points(unique_trajectories(spark, sf_dir))
    pairs = within_cone(night_pairs(ends, heads, CFG.separation_deg, CFG.mag_same, CFG.mag_diff, CFG.trajectory_window), CFG.max_angle_deg)
    pairs = ranked(newest_night_only(pairs, "r.candid", F.col("l.gap")))
    return pairs.select(F.col("l.trajectory_id").alias("trajectory_id"), F.col("r.candid").alias("head"), F.col("l.gap").alias("gap"), F.col("rk").cast("int").alias("rk"))


def old_obs_to_tracklet(spark, sf_dir):
    """Alerts on no tracklet that lead up to tracklets of the next two nights: rank 1 extends, others fork."""
    small, alerts = _tracklets(spark, sf_dir)
    first = small.withColumn("head", F.min_by("candid", F.struct("jd", "candid")).over(Window.partitionBy("trajectory_id")))
    ends = end_points(first.withColumn("trajectory_id", F.col("head")), newest=False)
    old = alerts.join(small.select("candid"), "candid", "left_anti")
    pairs = night_pairs(old, ends, CFG.separation_deg, CFG.mag_same, CFG.mag_diff, CFG.observation_window)
    pairs = pairs.where(planar_angle("r.p1.ra", "r.p1.dec", "r.ra", "r.dec", "l.ra", "l.dec") <= CFG.max_angle_deg)
    pairs = newest_night_only(pairs, "r.trajectory_id", F.col("l.gap"))
    order = [(F.col("l.fid") != F.col("r.fid")).cast("int"), F.col("l.jd"), F.col("l.candid")]
    rank = F.row_number().over(Window.partitionBy("r.trajectory_id").orderBy(*order))
    return pairs.select(F.col("r.trajectory_id").alias("head"), F.col("l.candid").alias("candid"), F.col("l.gap").alias("gap"), rank.alias("rk"))


def extend_rows(spark, sf_dir):
    """All rows of trajectories after their extension by alerts over the whole window: copies under new ids where they fork."""
    trajectories, alerts = unique_trajectories(spark, sf_dir), unique_alerts(spark, sf_dir)
    top = trajectories.agg(F.max("trajectory_id")).first()[0]
    pairs = within_cone(night_pairs(end_points(trajectories), alerts, CFG.separation_deg, CFG.mag_same, CFG.mag_diff, CFG.trajectory_window), CFG.max_angle_deg)
    pairs = ranked(newest_night_only(pairs, "r.candid", F.col("l.gap")))
    flat = pairs.select(F.col("l.trajectory_id").alias("trajectory_id"), "rk", F.col("r.candid").alias("key"), F.col("l.gap").alias("gap"))
    rows, _ = grow(trajectories, flat, alerts.select(*POINT_COLUMNS).withColumn("key", F.col("candid")), "A", 0 if top is None else top + 1)
    return rows.select("trajectory_id", "candid")


def _state(spark, sf_dir) -> tuple[NightState, DataFrame]:
    """The state as the tables have it before ``NIGHT``, and all alerts."""
    trajectories, alerts = unique_trajectories(spark, sf_dir), unique_alerts(spark, sf_dir)
    top = trajectories.agg(F.max("trajectory_id")).first()[0]
    before = trajectories.where(F.col("nid") < NIGHT).withColumn("assoc_tag", F.lit(None).cast("string"))
    old = alerts.where(F.col("nid") < NIGHT).select(*POINT_COLUMNS).join(before.select("candid"), "candid", "left_anti")
    return NightState(before, old, 0 if top is None else top + 1, NIGHT - 1), alerts


def _rows(state: NightState) -> DataFrame:
    """Trajectories, alerts still unmatched, and what left, in one."""
    rows = state.trajectories.select(F.lit("trajectory").alias("part"), "trajectory_id", "candid", "assoc_tag")
    old = state.old_alerts.select(F.lit("old alert"), F.lit(None).cast("long"), "candid", F.lit(None).cast("string"))
    return rows.union(old).union(state.archived.select(F.lit("archived"), "trajectory_id", "candid", "assoc_tag"))


def night_step(spark, sf_dir):
    """One night taken in by the state of all nights before it: everything the state holds afterwards, and what left it."""
    state, alerts = _state(spark, sf_dir)
    return _rows(process_night(state, alerts.where(F.col("nid") == NIGHT), NIGHT, CFG))


def replay_three_nights(spark, sf_dir):
    """Three nights one after another on the state of all nights before them."""
    state, alerts = _state(spark, sf_dir)
    return _rows(replay(alerts, [NIGHT, NIGHT + 1, NIGHT + 2], CFG, state))


def streaming_nightly(spark, sf_dir):
    """Three nights of a stream over the alerts, taken in by ``foreachBatch`` with the state kept in a store."""
    stream = table_stream(spark, sf_dir, "alerts", *POINT_COLUMNS).where(F.col("nid").isin(*THREE))
    store = StateStore(spark, new_path(spark, "state"))
    start_nightly(stream, store, CFG, new_path(spark, "state-log")).awaitTermination()
    return store.load().trajectories.select("trajectory_id", "candid", "assoc_tag")


def streaming_days(spark, sf_dir):
    """Deliveries per day of arrival, counted by a stream over the alerts."""
    stream = table_stream(spark, sf_dir, "alerts", "delivery_id", "received_at")
    return run_complete(arrivals(stream), new_path(spark, "days"), new_path(spark, "days-log"))


def orbit_fit(spark, sf_dir):
    """Two-body orbits of all trajectories of six points or more."""
    found = fit_orbits(unique_trajectories(spark, sf_dir), 6)
    return found.select("trajectory_id", *ELEMENTS, "chi_reduced")


def orbit_merge(spark, sf_dir):
    """Pairs of like orbits (each with its three nearest) whose points one orbit fits, whatever its chi, which is given."""
    orbits = table(spark, sf_dir, "orbits")
    return merge_orbits(orbits, unique_trajectories(spark, sf_dir), max_chi=float("inf")).select("first", "second", "chi_reduced")


QUERIES = {
    f.__name__: f
    for f in (tracklet_to_trajectory, old_obs_to_tracklet, extend_rows, night_step, replay_three_nights, streaming_nightly, streaming_days, orbit_fit, orbit_merge)
}


def _last_first(source: str) -> str:
    return f"""select *, row_number() over (partition by trajectory_id order by jd desc, candid desc) as back,
    row_number() over (partition by trajectory_id order by jd, candid) as front from {source}"""


_MAG = "abs(l.magpsf - r.magpsf) / nullif(abs(r.jd - l.jd), 0) <= case when l.fid = r.fid then 0.1::double else 0.5::double end"


def _forward(ends: str, later: str, key: str) -> str:
    """Continuations of trajectories ``ends`` (with ``back``) by points of ``later``, ranked."""
    far = sep("l.ra", 'l."dec"', "r.ra", 'r."dec"')
    turn = angle("i", "l", "r")
    return f"""(select *, row_number() over (partition by trajectory_id order by (lfid <> rfid), rjd, rcandid) as rk from (
    select *, min(gap) over (partition by key) as least from (
      select l.trajectory_id, {key} as key, r.nid - l.nid as gap, l.fid as lfid, r.fid as rfid, r.jd as rjd, r.candid as rcandid
      from {ends} l join {ends} i on i.trajectory_id = l.trajectory_id and l.back = 1 and i.back = 2
        join {later} r on r.nid - l.nid between 1 and 15 and abs(r."dec" - l."dec") <= 0.3::double * (r.nid - l.nid) + 1e-6
      where {far} <= 0.3::double * (r.nid - l.nid) and {_MAG} * (r.nid - l.nid)
        and case when r.jd - l.jd > 1 then {turn} / (r.jd - l.jd) else {turn} end <= 1)) where gap = least)"""


def _backward(old: str, ends: str) -> str:
    """Old alerts that lead up to tracklets ``ends`` (with ``front``), ranked."""
    far = sep("l.ra", 'l."dec"', "r.ra", 'r."dec"')
    return f"""(select *, row_number() over (partition by trajectory_id order by (lfid <> rfid), ljd, key) as rk from (
    select *, min(gap) over (partition by trajectory_id) as least from (
      select r.trajectory_id, l.candid as key, r.nid - l.nid as gap, l.fid as lfid, r.fid as rfid, l.jd as ljd
      from {ends} r join {ends} i on i.trajectory_id = r.trajectory_id and r.front = 1 and i.front = 2
        join {old} l on r.nid - l.nid between 1 and 2 and abs(r."dec" - l."dec") <= 0.3::double * (r.nid - l.nid) + 1e-6
      where {far} <= 0.3::double * (r.nid - l.nid) and {_MAG} * (r.nid - l.nid) and {angle('i', 'r', 'l')} <= 1)) where gap = least)"""


_SMALL = """found as (select f.*, w.head, count(*) over (partition by w.head) as size from {alerts} f join walk w using (candid)),
 first as (select * replace (first_value(candid) over (partition by head order by jd, candid) as head) from found where size < 6)"""
_ALL_TRACKLETS = f"{ALERTS_SQL},\n {tracklets_sql('a')}, {HEADS}, {_SMALL.format(alerts='a')}"


def _named(pairs: str, base: str) -> str:
    """Pairs with the id each goes to: their trajectory's, or for forks a new one numbered from ``base``."""
    return f"""select * from (select *, trajectory_id as new_id from {pairs} where rk = 1
    union all select *, {base} + row_number() over (order by gap, trajectory_id, rk) - 1 from {pairs} where rk > 1)"""


_FORKS = "(select count(*) from {} where rk > 1)"
_STEP = f"""{ALERTS_SQL}, {TRAJECTORIES_SQL},
 fresh as (select * from a where nid = {NIGHT}), {tracklets_sql('fresh')}, {HEADS},
 base as (select max(trajectory_id) + 1 as b from t),
 old0 as (select * from t where nid < {NIGHT}),
 young as (select * from a where nid < {NIGHT} and {NIGHT} - nid <= 2 and candid not in (select candid from old0)),
 age as (select trajectory_id, count(*) as n, {NIGHT} - arg_max(nid, (jd, candid)) as age from old0 group by 1),
 recent as (select old0.* from old0 join age using (trajectory_id) where age <= 15 and (n > 2 or (n = 2 and age <= 8))),
 gone as (select old0.* from old0 join age using (trajectory_id) where not (age <= 15 and (n > 2 or (n = 2 and age <= 8)))),
 found as (select f.*, (select b from base) + dense_rank() over (order by w.head) - 1 as trajectory_id, count(*) over (partition by w.head) as size from fresh f join walk w using (candid)),
 b1 as (select coalesce(max(trajectory_id) + 1, (select b from base)) as b from found),
 small as (select * from found where size < 6),
 rest as (select * from fresh where candid not in (select candid from found)),
 ends as ({_last_first('recent')}),
 heads as (select *, row_number() over (partition by trajectory_id order by jd, candid) as front from small),
 t0 as (select * from {_forward('ends', '(select * from heads where front = 1)', 'r.trajectory_id')}),
 t1 as ({_named('t0', '(select b from b1)')}),
 b2 as (select b + {_FORKS.format('t0')} as b from b1),
 open_ends as (select * from ends where trajectory_id not in (select trajectory_id from t1 where rk = 1)),
 a0 as (select * from {_forward('open_ends', 'rest', 'r.candid')}),
 a1 as ({_named('a0', '(select b from b2)')}),
 b3 as (select b + {_FORKS.format('a0')} as b from b2),
 tracks as (select * from heads where trajectory_id not in (select key from t1)),
 o0 as (select * from {_backward('young', 'tracks')}),
 o1 as ({_named('o0', '(select b from b3)')}),
 b4 as (select b + {_FORKS.format('o0')} as b from b3),
 left_old as (select * from young where candid not in (select key from o1)),
 left_new as (select * from rest where candid not in (select key from a1)),
 n0 as (select * from (select *, min(gap) over (partition by new_candid) as least from (
    select l.candid as old_candid, r.candid as new_candid, r.nid - l.nid as gap from left_old l join left_new r
      on r.nid - l.nid between 1 and 2 and abs(r."dec" - l."dec") <= 0.3::double * (r.nid - l.nid) + 1e-6
    where {sep('l.ra', 'l."dec"', 'r.ra', 'r."dec"')} <= 0.3::double * (r.nid - l.nid) and {_MAG} * (r.nid - l.nid))) where gap = least),
 n1 as (select *, (select b from b4) + row_number() over (order by gap, old_candid, new_candid) - 1 as new_id from n0)"""

SQL = {
    "streaming_days": "select cast(received_at as date) as day, count(*) as n from alerts where received_at is not null group by 1",
    "tracklet_to_trajectory": f"""with recursive {_ALL_TRACKLETS}, {TRAJECTORIES_SQL}, ends as ({_last_first('t')}),
 m as (select * from {_forward('ends', '(select * from first where candid = head)', 'r.candid')})
select trajectory_id, key as head, cast(gap as int) as gap, cast(rk as int) as rk from m""",
    "old_obs_to_tracklet": f"""with recursive {_ALL_TRACKLETS},
 ends as (select head as trajectory_id, * exclude (head), row_number() over (partition by head order by jd, candid) as front from first),
 lone as (select * from a where candid not in (select candid from first)),
 m as (select * from {_backward('lone', 'ends')})
select trajectory_id as head, key as candid, cast(gap as int) as gap, cast(rk as int) as rk from m""",
    "extend_rows": f"""with {ALERTS_SQL}, {TRAJECTORIES_SQL}, ends as ({_last_first('t')}),
 m as (select * from {_forward('ends', 'a', 'r.candid')}), named as ({_named('m', '(select max(trajectory_id) + 1 from t)')})
select trajectory_id, candid from t union all select cast(new_id as bigint), key from named
union all select cast(new_id as bigint), candid from named join t using (trajectory_id) where rk > 1""",
    "night_step": f"""with recursive {_STEP},
 all_rows as (
  select trajectory_id, candid, cast(null as varchar) as tag from recent
  union all select trajectory_id, candid, 'I' from found where size >= 6 or trajectory_id not in (select key from t1)
  union all select new_id, small.candid, 'T' from t1 join small on small.trajectory_id = t1.key
  union all select new_id, recent.candid, null from t1 join recent using (trajectory_id) where rk > 1
  union all select new_id, key, 'A' from a1 union all select new_id, recent.candid, null from a1 join recent using (trajectory_id) where rk > 1
  union all select new_id, key, 'O' from o1 union all select new_id, tracks.candid, 'I' from o1 join tracks using (trajectory_id) where rk > 1
  union all select new_id, old_candid, 'N' from n1 union all select new_id, new_candid, 'N' from n1)
select 'trajectory' as part, cast(trajectory_id as bigint) as trajectory_id, candid, tag as assoc_tag from all_rows
union all select 'old alert', null, candid, null from left_old where candid not in (select old_candid from n1)
union all select 'old alert', null, candid, null from left_new where candid not in (select new_candid from n1)
union all select 'archived', trajectory_id, candid, null from gone""",
}
