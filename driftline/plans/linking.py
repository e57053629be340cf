"""Queries of pairs, tracklets and links across nights, over all nights of the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.sky import planar_angle
from driftline.operators.link import end_points, newest_night_only, ranked, within_cone
from driftline.operators.pairs import intra_night_pairs, magnitude_pairs, mirror_free, night_pairs
from driftline.operators.tracklets import chained_tracklets, dense_tracklets, tracklet_links
from driftline.plans.sql import ALERTS_SQL, TRAJECTORIES_SQL, angle, sep
from driftline.schema import LinkConfig, unique_alerts, unique_trajectories

CFG = LinkConfig()
#: Criteria per night of the queries across nights, and how far they look.
ACROSS = {"separation_deg": 0.05, "same": 0.5, "diff": 1.0, "window": 2}
#: Magnitude limits, window and angle of the continuations of trajectories: a short look ahead, and all that production takes.
SHORT = (ACROSS["same"], ACROSS["diff"], ACROSS["window"], 10.0)
WHOLE = (CFG.mag_same, CFG.mag_diff, CFG.trajectory_window, CFG.max_angle_deg)


def _ids(pairs):
    return pairs.select(F.col("l.candid").alias("left_candid"), F.col("r.candid").alias("right_candid"), F.round("sep_deg", 6).alias("sep_deg"))


def intra_pairs(spark, sf_dir):
    return _ids(intra_night_pairs(unique_alerts(spark, sf_dir), CFG.intra_separation_arcsec))


def mirror_dedupe(spark, sf_dir):
    return _ids(mirror_free(intra_night_pairs(unique_alerts(spark, sf_dir), CFG.intra_separation_arcsec)))


def intra_pairs_mag(spark, sf_dir):
    return _ids(magnitude_pairs(intra_night_pairs(unique_alerts(spark, sf_dir), CFG.intra_separation_arcsec), CFG.intra_mag_same, CFG.intra_mag_diff))


def successor_pick(spark, sf_dir):
    return _ids(tracklet_links(unique_alerts(spark, sf_dir), CFG))


def tracklet_paths(spark, sf_dir):
    """Alerts of chained tracklets with the smallest candid of their chain."""
    found = chained_tracklets(unique_alerts(spark, sf_dir), CFG)
    return found.withColumn("tracklet", F.min("candid").over(Window.partitionBy("head"))).select("candid", "tracklet")


def dbscan_equiv(spark, sf_dir):
    return dense_tracklets(unique_alerts(spark, sf_dir), CFG.intra_separation_arcsec).select("candid", F.col("head").alias("cluster"))


def _across(spark, sf_dir, window):
    alerts = unique_alerts(spark, sf_dir)
    return night_pairs(alerts, alerts, ACROSS["separation_deg"], ACROSS["same"], ACROSS["diff"], window)


def night_pairs_gap1(spark, sf_dir):
    return _ids(_across(spark, sf_dir, 1))


def night_pairs_window(spark, sf_dir):
    """Alerts of a night with those of the next two, by criteria that grow with the gap."""
    return _across(spark, sf_dir, 2).select(F.col("l.candid").alias("left_candid"), F.col("r.candid").alias("right_candid"), F.col("l.gap").alias("gap"))


def pair_trajectories(spark, sf_dir):
    """Pairs across nights, where each later alert goes to the nearest earlier night that matches it."""
    pairs = newest_night_only(_across(spark, sf_dir, 2), "r.candid", F.col("l.gap"))
    return pairs.select(F.col("l.candid").alias("old_candid"), F.col("r.candid").alias("new_candid"), F.col("l.gap").alias("gap"))


def _cone(spark, sf_dir, limits=SHORT):
    same, diff, window, angle = limits
    ends = end_points(unique_trajectories(spark, sf_dir))
    return within_cone(night_pairs(ends, unique_alerts(spark, sf_dir), CFG.separation_deg, same, diff, window), angle)


def cone_forward(spark, sf_dir, limits=SHORT):
    """Alerts of the next two nights that continue the last two points of a trajectory within a cone."""
    return _cone(spark, sf_dir, limits).select(F.col("l.trajectory_id").alias("trajectory_id"), F.col("r.candid").alias("candid"), F.round("angle", 3).alias("angle"))


def cone_backward(spark, sf_dir):
    """Earlier alerts that lead up to the first two points of a trajectory within a cone; the angle is never per day."""
    ends = end_points(unique_trajectories(spark, sf_dir), newest=False)
    pairs = night_pairs(unique_alerts(spark, sf_dir), ends, CFG.separation_deg, ACROSS["same"], ACROSS["diff"], ACROSS["window"])
    found = pairs.withColumn("angle", planar_angle("r.p1.ra", "r.p1.dec", "r.ra", "r.dec", "l.ra", "l.dec")).where(F.col("angle") <= 10.0)
    return found.select(F.col("r.trajectory_id").alias("trajectory_id"), F.col("l.candid").alias("candid"), F.round("angle", 3).alias("angle"))


def _ranked(spark, sf_dir, limits=SHORT):
    return ranked(newest_night_only(_cone(spark, sf_dir, limits), "r.candid", F.col("l.gap")))


def extend_one_night(spark, sf_dir, limits=SHORT):
    """The match of the next two nights that extends each trajectory."""
    return _ranked(spark, sf_dir, limits).where("rk = 1").select(F.col("l.trajectory_id").alias("trajectory_id"), F.col("r.candid").alias("candid"), F.col("l.gap").alias("gap"))


def fork_copies(spark, sf_dir, limits=SHORT):
    """Further matches of the next two nights: each makes a copy of the trajectory as it was, here by its size."""
    sizes = unique_trajectories(spark, sf_dir).groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("copied"))
    forks = _ranked(spark, sf_dir, limits).where("rk > 1").select(F.col("l.trajectory_id").alias("trajectory_id"), F.col("r.candid").alias("candid"), F.col("rk").cast("int").alias("rk"))
    return forks.join(sizes, "trajectory_id")


def cone_window(spark, sf_dir):
    """:func:`cone_forward` over the whole window of trajectories, within the limits of production."""
    return cone_forward(spark, sf_dir, WHOLE)


def extend_window(spark, sf_dir):
    """:func:`extend_one_night` over the whole window of trajectories, within the limits of production."""
    return extend_one_night(spark, sf_dir, WHOLE)


def fork_window(spark, sf_dir):
    """:func:`fork_copies` over the whole window of trajectories, within the limits of production."""
    return fork_copies(spark, sf_dir, WHOLE)


QUERIES = {
    f.__name__: f
    for f in (intra_pairs, mirror_dedupe, intra_pairs_mag, successor_pick, tracklet_paths, dbscan_equiv, night_pairs_gap1, night_pairs_window, pair_trajectories, cone_forward, cone_backward, extend_one_night, fork_copies, cone_window, extend_window, fork_window)
}

_R = "120.0::double / 3600"


def tracklets_sql(alerts: str) -> str:
    """Pairs ``p`` and ``pm`` of the alerts of a night, and the successors ``s``."""
    return f"""p as (select l.candid as left_candid, r.candid as right_candid, {sep('l.ra', 'l."dec"', 'r.ra', 'r."dec"')} as sep_deg,
         l.jd as ljd, r.jd as rjd, l.magpsf as lmag, r.magpsf as rmag, l.fid as lfid, r.fid as rfid
       from {alerts} l join {alerts} r on l.nid = r.nid and l.candid <> r.candid and abs(l."dec" - r."dec") < 0.034
       where {sep('l.ra', 'l."dec"', 'r.ra', 'r."dec"')} between 1e-300 and {_R}),
 pm as (select * from p where ljd < rjd and abs(lmag - rmag) <= case when lfid = rfid then 0.2::double else 0.8::double end),
 s1 as (select *, count(*) over (partition by left_candid) > 1 as multi, row_number() over (partition by left_candid order by rjd, right_candid) as rk from pm),
 s as (select * from (select *, row_number() over (partition by right_candid order by multi, case when multi then rjd else ljd end, left_candid, right_candid) as f
       from s1 where rk = 1) where f = 1)"""


_P = f"{ALERTS_SQL},\n {tracklets_sql('a')}"
HEADS = """head as (select distinct left_candid as candid from s where left_candid not in (select right_candid from s)),
 walk(candid, head) as (select candid, candid from head union all select s.right_candid, w.head from walk w join s on s.left_candid = w.candid)"""


def _across_sql(window: int) -> str:
    return f"""{ALERTS_SQL},
 n as (select l.candid as left_candid, r.candid as right_candid, g.gap, {sep('l.ra', 'l."dec"', 'r.ra', 'r."dec"')} as sep_deg
       from a l join (select unnest(range(1, {window + 1})) as gap) g on true join a r on r.nid = l.nid + g.gap and abs(l."dec" - r."dec") <= 0.05::double * g.gap + 1e-6
       where {sep('l.ra', 'l."dec"', 'r.ra', 'r."dec"')} <= 0.05::double * g.gap
         and abs(l.magpsf - r.magpsf) / nullif(abs(r.jd - l.jd), 0) <= case when l.fid = r.fid then 0.5::double else 1.0::double end * g.gap)"""


_ENDS = f"""{ALERTS_SQL}, {TRAJECTORIES_SQL},
 k as (select *, row_number() over (partition by trajectory_id order by jd desc, candid desc) as back,
              row_number() over (partition by trajectory_id order by jd, candid) as front from t),
 c as (select p2.trajectory_id, p2.fid as efid, r.candid, r.jd, r.fid as rfid, g.gap,
         case when r.jd - p2.jd > 1 then {angle('p1', 'p2', 'r')} / (r.jd - p2.jd) else {angle('p1', 'p2', 'r')} end as angle
       from k p2 join k p1 on p1.trajectory_id = p2.trajectory_id and p2.back = 1 and p1.back = 2
         join (select unnest([1, 2]) as gap) g on true join a r on r.nid = p2.nid + g.gap and abs(r."dec" - p2."dec") <= 0.3::double * g.gap + 1e-6
       where {sep('p2.ra', 'p2."dec"', 'r.ra', 'r."dec"')} <= 0.3::double * g.gap
         and abs(p2.magpsf - r.magpsf) / nullif(abs(r.jd - p2.jd), 0) <= case when p2.fid = r.fid then 0.5::double else 1.0::double end * g.gap),
 cone as (select * from c where angle <= 10),
 rk as (select *, row_number() over (partition by trajectory_id order by (efid <> rfid), jd, candid) as rk
        from (select *, min(gap) over (partition by candid) as least from cone) where gap = least)"""

SQL = {
    "intra_pairs": f"with {_P} select left_candid, right_candid, round(sep_deg, 6) as sep_deg from p",
    "mirror_dedupe": f"with {_P} select left_candid, right_candid, round(sep_deg, 6) as sep_deg from p where ljd < rjd or (ljd = rjd and left_candid < right_candid)",
    "intra_pairs_mag": f"with {_P} select left_candid, right_candid, round(sep_deg, 6) as sep_deg from pm",
    "successor_pick": f"with {_P} select left_candid, right_candid, round(sep_deg, 6) as sep_deg from s",
    "tracklet_paths": f"""with recursive {_P}, {HEADS}
select candid, min(candid) over (partition by head) as tracklet from walk""",
    "dbscan_equiv": f"""with recursive {_P},
 reach(candid, lab) as (select distinct left_candid, left_candid from p union select p.right_candid, r.lab from reach r join p on p.left_candid = r.candid where r.lab < p.right_candid),
 lab as (select candid, min(lab) as cluster from reach group by candid),
 good as (select cluster from lab join a using (candid) group by cluster having count(jd) = count(distinct jd))
select candid, cluster from lab where cluster in (select cluster from good)""",
    "night_pairs_gap1": f"with {_across_sql(1)} select left_candid, right_candid, round(sep_deg, 6) as sep_deg from n",
    "night_pairs_window": f"with {_across_sql(2)} select left_candid, right_candid, cast(gap as int) as gap from n",
    "pair_trajectories": f"""with {_across_sql(2)} select left_candid as old_candid, right_candid as new_candid, cast(gap as int) as gap
from (select *, min(gap) over (partition by right_candid) as least from n) where gap = least""",
    "cone_forward": f"with {_ENDS} select trajectory_id, candid, round(angle, 3) as angle from cone",
    "cone_backward": f"""with {_ENDS.split(' c as (')[0].rstrip().rstrip(',')}
select trajectory_id, candid, round(angle, 3) as angle from (
  select p2.trajectory_id, l.candid, {angle('p1', 'p2', 'l')} as angle
  from k p2 join k p1 on p1.trajectory_id = p2.trajectory_id and p2.front = 1 and p1.front = 2
    join (select unnest([1, 2]) as gap) g on true join a l on l.nid = p2.nid - g.gap and abs(l."dec" - p2."dec") <= 0.3::double * g.gap + 1e-6
  where {sep('l.ra', 'l."dec"', 'p2.ra', 'p2."dec"')} <= 0.3::double * g.gap
    and abs(p2.magpsf - l.magpsf) / nullif(abs(p2.jd - l.jd), 0) <= case when p2.fid = l.fid then 0.5::double else 1.0::double end * g.gap)
where angle <= 10""",
    "extend_one_night": f"with {_ENDS} select trajectory_id, candid, cast(gap as int) as gap from rk where rk = 1",
    "fork_copies": f"with {_ENDS} select trajectory_id, candid, cast(rk as int) as rk, copied from rk join (select trajectory_id, count(*) as copied from t group by 1) using (trajectory_id) where rk > 1",
}

_WHOLE = {
    "unnest([1, 2])": "unnest(range(1, 16))",
    "then 0.5::double else 1.0::double": "then 0.1::double else 0.5::double",
    "angle <= 10": "angle <= 1",
}
for _name, _short in (("cone_window", "cone_forward"), ("extend_window", "extend_one_night"), ("fork_window", "fork_copies")):
    SQL[_name] = SQL[_short]
    for _old, _new in _WHOLE.items():
        SQL[_name] = SQL[_name].replace(_old, _new)
