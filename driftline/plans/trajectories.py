"""Queries over whole trajectories: windows, statistics, eviction, motion."""

from pyspark.sql import functions as F

from driftline.operators import metrics, study
from driftline.operators.graph import numbered
from driftline.operators.link import last_points
from driftline.operators.nightly import evict, split_by_size
from driftline.operators.ordered import with_group_count
from driftline.plans.sql import ALERTS_SQL, TRAJECTORIES_SQL, angle, sep
from driftline.runtime import table
from driftline.schema import LinkConfig, unique_alerts, unique_trajectories

KEY = "trajectory_id"
#: A night in the middle of the tables, at which state is evicted.
NIGHT = 1075


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def last_n(spark, sf_dir):
    return last_points(unique_trajectories(spark, sf_dir), 2).select(KEY, "candid", "jd")


def first_n(spark, sf_dir):
    return last_points(unique_trajectories(spark, sf_dir), 2, newest=False).select(KEY, "candid", "jd")


def last_row(spark, sf_dir):
    last = F.max_by(F.struct("candid", "jd", "nid"), F.struct("jd", "candid")).alias("p")
    return unique_trajectories(spark, sf_dir).groupBy(KEY).agg(last).select(KEY, "p.*")


def size_split(spark, sf_dir):
    small, long = split_by_size(unique_trajectories(spark, sf_dir), LinkConfig().orbit_points)
    return small.select(KEY, "candid", F.lit(False).alias("for_orbit")).unionByName(long.select(KEY, "candid", F.lit(True).alias("for_orbit")))


def size_histogram(spark, sf_dir):
    sizes = unique_trajectories(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def evict_state(spark, sf_dir):
    """What the state of the tables would be on a night: rows by what becomes of them."""
    points = unique_trajectories(spark, sf_dir).where(F.col("nid") < NIGHT)
    alerts = unique_alerts(spark, sf_dir).where(F.col("nid") < NIGHT)
    recent, old, expired, young = evict(points, alerts, NIGHT, LinkConfig())
    parts = [x.select(F.lit(part).alias("part"), KEY, "candid") for part, x in (("recent", recent), ("old", old), ("expired", expired))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(young.select(F.lit("young alert").alias("part"), F.lit(None).cast("long").alias(KEY), "candid"))


def renumber(spark, sf_dir):
    """Dense numbers of the ids of two tables in common, from 0."""
    a = table(spark, sf_dir, "trajectories", KEY).where(F.col(KEY) >= 0)
    b = table(spark, sf_dir, "orbits", KEY).where(F.col(KEY) >= 0)
    return numbered(a.union(b).distinct(), [KEY], "new_id")


def assoc_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "trajectories", KEY, "candid", "jd", "assoc_tag").where((F.col(KEY) >= 0) & F.col("jd").isNotNull())
    rows = rows.groupBy(KEY, "candid").agg(F.min("jd").alias("jd"), F.max("assoc_tag").alias("assoc_tag"))
    return _rounded(metrics.association_statistics(rows))


def extended_table(spark, sf_dir):
    return _rounded(study.extended_table(unique_trajectories(spark, sf_dir), KEY))


def gaps(spark, sf_dir):
    return metrics.nights_of(unique_trajectories(spark, sf_dir), KEY).where("gap is not null").select(KEY, "candid", "gap")


def detectable(spark, sf_dir):
    return metrics.detectable(unique_trajectories(spark, sf_dir), KEY, 6, 3)


def window_membership(spark, sf_dir):
    """The strict variant: every gap below the window."""
    return metrics.detectable(unique_trajectories(spark, sf_dir), KEY, 3, 3, strict=True)


def run_length_detectable(spark, sf_dir):
    return metrics.run_detectable(unique_trajectories(spark, sf_dir), KEY, 3, 6)


def paired_nights(spark, sf_dir):
    return metrics.paired_nights(unique_trajectories(spark, sf_dir), KEY)


def followed_nights(spark, sf_dir):
    return metrics.followed_nights(unique_trajectories(spark, sf_dir), KEY)


def head_k(spark, sf_dir):
    """The first three nights of each trajectory, as an array."""
    rows = unique_trajectories(spark, sf_dir).groupBy(KEY).agg(F.slice(F.sort_array(F.collect_set("nid")), 1, 3).alias("nights"))
    return rows.select(KEY, F.array_join(F.col("nights").cast("array<string>"), ",").alias("nights"))


def ordered_lists(spark, sf_dir):
    """Times and filters of each trajectory as ordered lists, taken apart again."""
    lists = unique_trajectories(spark, sf_dir).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("jd", "candid", "fid"))).alias("p"))
    return lists.select(KEY, F.posexplode("p").alias("place", "p")).select(KEY, "place", F.col("p.candid").alias("candid"), F.col("p.fid").alias("fid"))


def speed(spark, sf_dir):
    return _rounded(study.speeds(unique_trajectories(spark, sf_dir), KEY))


def intra_sep(spark, sf_dir):
    return _rounded(study.intra_separations(unique_trajectories(spark, sf_dir), KEY), 4)


def mag_rate(spark, sf_dir):
    return _rounded(study.magnitude_rates(unique_trajectories(spark, sf_dir), KEY))


def colour(spark, sf_dir):
    return _rounded(study.colours(unique_trajectories(spark, sf_dir), KEY), 9)


def turn_angle(spark, sf_dir):
    return _rounded(study.turning_angles(unique_trajectories(spark, sf_dir), KEY), 3)


def position_angle(spark, sf_dir):
    return _rounded(study.direction_rates(unique_trajectories(spark, sf_dir), KEY), 3)


def tracklet_gap(spark, sf_dir):
    return _rounded(study.tracklet_gaps(unique_trajectories(spark, sf_dir), KEY))


def motion_fit(spark, sf_dir):
    return _rounded(study.motion_fit(unique_trajectories(spark, sf_dir), KEY), 3)


def hist_cdf(spark, sf_dir):
    return _rounded(study.histogram(study.speeds(unique_trajectories(spark, sf_dir), KEY), "speed", 0.0, 2.0, 200))


def scaled_magnitude(spark, sf_dir):
    return _rounded(study.scaled(unique_trajectories(spark, sf_dir), KEY, "magpsf").select(KEY, "candid", "scaled"))


def describe_stats(spark, sf_dir):
    return _rounded(metrics.described(unique_trajectories(spark, sf_dir), ["magpsf", "dec"]), 5)


def night_multiplicity(spark, sf_dir):
    """Of each night, the alerts, the objects, and the most alerts of one object."""
    per = unique_alerts(spark, sf_dir, "ssnamenr").where("ssnamenr is not null").groupBy("nid", "ssnamenr").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("nid").agg(F.sum("n").alias("n_alerts"), F.count(F.lit(1)).alias("n_objects"), F.max("n").alias("most"), F.median("n").alias("median"))


def night_class_counts(spark, sf_dir):
    return table(spark, sf_dir, "alerts", "nid", "fink_class").groupBy("nid", "fink_class").agg(F.count(F.lit(1)).alias("n"))


def whole_count(spark, sf_dir):
    """Each alert with the number of alerts of its object."""
    return with_group_count(unique_alerts(spark, sf_dir, "ssnamenr").select("candid", "ssnamenr"), "ssnamenr", "n_object").select("candid", "n_object")


def _truth(spark, sf_dir):
    alerts = unique_alerts(spark, sf_dir, "ssnamenr").where("ssnamenr is not null")
    points = unique_trajectories(spark, sf_dir).select(KEY, "candid")
    return alerts.join(points, "candid", "left").select("candid", "jd", "nid", "ssnamenr", F.coalesce(KEY, F.lit(-1)).alias(KEY))


def seeding_purity(spark, sf_dir):
    return _rounded(metrics.seeding_purity(_truth(spark, sf_dir)))


def seeding_completeness(spark, sf_dir):
    return _rounded(metrics.seeding_completeness(_truth(spark, sf_dir)))


def pair_metrics(spark, sf_dir):
    """Neighbours in time on trajectories against neighbours in time of named objects."""
    real = metrics.consecutive_pairs(unique_alerts(spark, sf_dir, "ssnamenr"), "ssnamenr")
    found = metrics.consecutive_pairs(unique_trajectories(spark, sf_dir), KEY)
    return _rounded(metrics.pair_metrics(real, found))


def efficiency_report(spark, sf_dir):
    """How many detectable objects have a trajectory of their own, and how many trajectories are of one object."""
    alerts = unique_alerts(spark, sf_dir, "ssnamenr").where("ssnamenr is not null")
    points = unique_trajectories(spark, sf_dir).select(KEY, "candid").join(alerts.select("candid", "ssnamenr"), "candid")
    named = points.groupBy(KEY).agg(F.count_distinct("ssnamenr").alias("names"), F.min("ssnamenr").alias("ssnamenr"))
    return _rounded(metrics.efficiency(named, metrics.detectable(alerts, "ssnamenr", 6, 15), "ssnamenr"))


def name_numbers(spark, sf_dir):
    """Running numbers of stored names, for tools that need integers."""
    return numbered(table(spark, sf_dir, "alerts", "ssnamenr").where("ssnamenr is not null").distinct(), ["ssnamenr"], "n")


def first_nights(spark, sf_dir):
    """Alerts of the first seven nights, by night and filter; the seven are the point of the query."""
    alerts = unique_alerts(spark, sf_dir)
    seven = alerts.select("nid").distinct().orderBy("nid").limit(7)
    return alerts.join(seven, "nid", "left_semi").groupBy("nid", "fid").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        last_n, first_n, last_row, size_split, size_histogram, evict_state, renumber, assoc_stats, extended_table, gaps, detectable, window_membership,
        run_length_detectable, paired_nights, followed_nights, head_k, ordered_lists, speed, intra_sep, mag_rate, colour, turn_angle, position_angle,
        tracklet_gap, motion_fit, hist_cdf, scaled_magnitude, describe_stats, night_multiplicity, night_class_counts, whole_count, seeding_purity,
        seeding_completeness, pair_metrics, efficiency_report, name_numbers, first_nights,
    )
}

_T = TRAJECTORIES_SQL
_K = f"""{_T}, k as (select *, row_number() over w as front, row_number() over (partition by trajectory_id order by jd desc, candid desc) as back,
  lag(ra) over w as ra0, lag("dec") over w as dec0, lag(jd) over w as jd0, lag(nid) over w as nid0, lag(ra, 2) over w as ra2, lag("dec", 2) over w as dec2, lag(jd, 2) over w as jd2,
  nid - lag(nid) over w as gap, lead(nid) over w - nid as after, count(*) over (partition by trajectory_id) as size
  from t window w as (partition by trajectory_id order by jd, candid))"""
_S = f"{_K}, s as (select *, jd - jd0 as days, {sep('ra0', 'dec0', 'ra', '\"dec\"')} as sep_deg from k where jd0 is not null)"
_SPEED = "sep_deg / greatest(days, 1.0::double)"
_AGE = f"select trajectory_id, count(*) as n, {NIGHT} - arg_max(nid, (jd, candid)) as age from t where nid < {NIGHT} group by trajectory_id"
_TRUTH = f"""{ALERTS_SQL}, {_T}, x as (select a.candid, a.ssnamenr, coalesce(t.trajectory_id, -1) as trajectory_id from a left join t on a.candid = t.candid where ssnamenr is not null)"""
_DESCRIBED = """select '{0}' as "column", count(*) as n, round(avg(x), 5) as mean, round(stddev_samp(x), 5) as std, round(min(x), 5) as low, round(quantile_cont(x, 0.25), 5) as q1,
  round(median(x), 5) as median, round(quantile_cont(x, 0.75), 5) as q3, round(max(x), 5) as high, round(skewness(x), 5) as skew, round(kurtosis(x), 5) as kurtosis
  from (select cast({1} as double) as x from t)"""

SQL = {
    "last_n": f"with {_K} select trajectory_id, candid, jd from k where back <= 2",
    "first_n": f"with {_K} select trajectory_id, candid, jd from k where front <= 2",
    "last_row": f"with {_K} select trajectory_id, candid, jd, nid from k where back = 1",
    "size_split": f"with {_K} select trajectory_id, candid, size >= 6 as for_orbit from k",
    "size_histogram": f"with {_K} select size, count(*) as n from k where front = 1 group by size",
    "evict_state": f"""with {ALERTS_SQL}, {_T}, age as ({_AGE})
select case when age > 15 then 'old' when n > 2 or (n = 2 and age <= 8) then 'recent' else 'expired' end as part, trajectory_id, candid from t join age using (trajectory_id) where nid < {NIGHT}
union all select 'young alert', cast(null as bigint), candid from a where nid < {NIGHT} and {NIGHT} - nid <= 2""",
    "renumber": """select trajectory_id, cast(dense_rank() over (order by trajectory_id) - 1 as bigint) as new_id
from (select trajectory_id from trajectories where trajectory_id >= 0 union select trajectory_id from orbits where trajectory_id >= 0)""",
    "assoc_stats": """with r as (select trajectory_id, candid, min(jd) as jd, max(assoc_tag) as tag from trajectories where trajectory_id >= 0 and jd is not null group by 1, 2),
 per as (select trajectory_id, count(*) as n, count(*) filter (where tag = 'A') as a, count(*) filter (where tag = 'T') as t, count(*) filter (where tag = 'O') as o,
   count(*) filter (where tag = 'I') as i, arg_min(tag, (jd, candid)) as f from r where tag is not null group by 1),
 st as (select *, case when i = n then 3 when o > 0 then 2 when f = 'I' then 0 when f = 'N' then 1 end as s from per)
select count(*) filter (where s = 3) as n_tracklets, count(*) filter (where s = 0) as n_from_tracklet, count(*) filter (where s = 1) as n_from_pair, count(*) filter (where s = 2) as n_from_old,
 round(avg(a) filter (where s in (0, 1) or (s = 2 and n > 3)), 6) as mean_alerts_added, round(avg(t) filter (where s in (0, 1) or (s = 2 and n > 3)), 6) as mean_tracklet_alerts_added from st""",
    "extended_table": f"""with {_T} select trajectory_id, count(*) as n_points, round(max(jd), 6) as last_jd, round(max(jd) - min(jd), 6) as arc_days,
 round(min(magpsf) filter (where fid = 1), 6) as min_mag_1, round(max(magpsf) filter (where fid = 1), 6) as max_mag_1,
 round(min(magpsf) filter (where fid = 2), 6) as min_mag_2, round(max(magpsf) filter (where fid = 2), 6) as max_mag_2 from t group by trajectory_id""",
    "gaps": f"with {_K} select trajectory_id, candid, gap from k where gap is not null",
    "detectable": f"with {_K} select trajectory_id, count(*) as n from k group by 1 having count(*) >= 6 and bool_and(coalesce(gap, 0) <= 3)",
    "window_membership": f"with {_K} select trajectory_id, count(*) as n from k group by 1 having count(*) >= 3 and bool_and(coalesce(gap, 0) < 3)",
    "run_length_detectable": f"""with {_T}, d as (select distinct trajectory_id, nid from t),
 g as (select trajectory_id, nid, nid - lag(nid) over (partition by trajectory_id order by nid) > 3 as long from d),
 m as (select *, long or (coalesce(lag(long) over w, false) and coalesce(lead(long) over w, false)) as masked from g where long is not null window w as (partition by trajectory_id order by nid)),
 r as (select *, sum(masked::int) over (partition by trajectory_id order by nid) as run from m)
select trajectory_id, max(c) as longest from (select trajectory_id, run, count(*) as c from r where not masked group by 1, 2) group by 1 having max(c) * 2 >= 6""",
    "paired_nights": f"""with {_K} select distinct x.trajectory_id from k x join k y on x.trajectory_id = y.trajectory_id and x.front < y.front
where x.size >= 5 and x.gap = 0 and y.gap = 0 and y.nid - x.nid <= 14""",
    "followed_nights": f"""with {_K} select distinct x.trajectory_id from k x join k y on x.trajectory_id = y.trajectory_id and x.front + 2 <= y.front
where x.size >= 6 and x.gap = 0 and y.gap = 0 and x.after <= 3 and y.after <= 3 and y.nid - x.nid <= 14""",
    "head_k": f"""with {_T}, d as (select trajectory_id, nid, row_number() over (partition by trajectory_id order by nid) as r from (select distinct trajectory_id, nid from t))
select trajectory_id, string_agg(cast(nid as varchar), ',' order by nid) as nights from d where r <= 3 group by 1""",
    "ordered_lists": f"with {_K} select trajectory_id, cast(front - 1 as int) as place, candid, fid from k",
    "speed": f"with {_S} select trajectory_id, candid, round({_SPEED}, 6) as speed from s",
    "intra_sep": f"with {_S} select trajectory_id, candid, round(sep_deg * 3600, 4) as sep_arcsec from s where nid = nid0",
    "mag_rate": f"""with {_T} select * from (select trajectory_id, candid, fid, round(abs(magpsf - lag(magpsf) over w) / greatest(jd - lag(jd) over w, 1.0::double), 6) as mag_rate,
 from t window w as (partition by trajectory_id, fid order by jd, candid) qualify greatest(jd - lag(jd) over w, 1.0::double) < 15 and lag(jd) over w is not null)""",
    "colour": f"with {_T} select trajectory_id, round(avg(magpsf) filter (where fid = 1) - avg(magpsf) filter (where fid = 2), 9) as colour from t group by 1",
    "turn_angle": f"""with {_K}, p as (select trajectory_id, candid, jd, jd0, {{'ra': ra2, 'dec': dec2}} as x, {{'ra': ra0, 'dec': dec0}} as y, {{'ra': ra, 'dec': "dec"}} as z from k where jd2 is not null)
select trajectory_id, candid, round(ang / greatest(jd - jd0, 1.0::double), 3) as angle from (select *, {angle('x', 'y', 'z')} as ang from p) where ang is not null""",
    "position_angle": f"""with {_S} select trajectory_id, candid, round((case when pa < 0 then pa + 360 else pa end) / days, 3) as direction_rate from (
 select *, degrees(atan2(sin(radians(ra - ra0)) * cos(radians("dec")), cos(radians(dec0)) * sin(radians("dec")) - sin(radians(dec0)) * cos(radians("dec")) * cos(radians(ra - ra0)))) as pa
 from s where days > 0 and sep_deg > 0)""",
    "tracklet_gap": f"""with {_T}, n as (select trajectory_id, nid, arg_min({{'ra': ra, 'd': "dec", 'm': magpsf}}, (jd, candid)) as f, arg_max({{'ra': ra, 'd': "dec", 'm': magpsf}}, (jd, candid)) as l from t group by 1, 2 having count(*) >= 2),
 o as (select *, row_number() over w as place, lead(f) over w as nx, lead(nid) over w as next_nid from n window w as (partition by trajectory_id order by nid))
select trajectory_id, nid, next_nid, round({sep('l.ra', 'l.d', 'nx.ra', 'nx.d')}, 6) as sep_deg, round(abs(nx.m - l.m), 6) as mag_change from o where place % 2 = 1 and next_nid is not null""",
    "motion_fit": f"""with {_T}, q as (select trajectory_id, count(*) as n, regr_slope("dec", jd) as slope, regr_sxx("dec", jd) as sxx, regr_sxy("dec", jd) as sxy, regr_syy("dec", jd) as syy from t group by 1)
select trajectory_id, n, round(slope, 3) as slope, round(greatest(0, syy - sxy * sxy / sxx), 3) as residual from q where n >= 3 and sxx > 0""",
    "hist_cdf": f"""with {_S}, b as (select cast(least(199, greatest(0, floor({_SPEED} / (2.0::double / 200)))) as int) as bin from s), c as (select bin, count(*) as n from b group by 1)
select bin, n, round(bin * (2.0::double / 200), 6) as low, round(sum(n) over (order by bin) / sum(n) over (), 6) as cdf from c""",
    "scaled_magnitude": f"""with {_T} select trajectory_id, candid, round((magpsf - min(magpsf) over w) / nullif(max(magpsf) over w - min(magpsf) over w, 0), 6) as scaled from t window w as (partition by trajectory_id)""",
    "describe_stats": f"with {_T} {_DESCRIBED.format('magpsf', 'magpsf')} union all {_DESCRIBED.format('dec', '\"dec\"')}",
    "night_multiplicity": f"""with {ALERTS_SQL}, per as (select nid, ssnamenr, count(*) as n from a where ssnamenr is not null group by 1, 2)
select nid, cast(sum(n) as bigint) as n_alerts, count(*) as n_objects, max(n) as most, median(n) as median from per group by nid""",
    "night_class_counts": "select nid, fink_class, count(*) as n from alerts group by 1, 2",
    "whole_count": f"with {ALERTS_SQL} select candid, count(*) over (partition by ssnamenr) as n_object from a where ssnamenr is not null",
    "seeding_purity": f"""with {_TRUTH}, sz as (select ssnamenr, count(*) as size from x group by 1 having count(*) > 1),
 cl as (select min(ssnamenr) as ssnamenr, count(*) as size from x group by trajectory_id having count(distinct ssnamenr) = 1),
 f as (select sz.ssnamenr, bool_or(cl.size is not null) as pure from sz left join cl on sz.ssnamenr = cl.ssnamenr and sz.size = cl.size group by 1)
select count(*) filter (where pure) as n_pure, count(*) as n_recoverable, round(count(*) filter (where pure) * 100.0::double / count(*), 6) as purity from f""",
    "seeding_completeness": f"""with {_TRUTH}, o as (select ssnamenr, count(distinct trajectory_id) = 1 and min(trajectory_id) <> -1 as whole from x group by 1 having count(*) > 1)
select count(*) filter (where whole) as n_complete, count(*) as n_recoverable, round(count(*) filter (where whole) * 100.0::double / count(*), 6) as completeness from o""",
    "pair_metrics": f"""with {ALERTS_SQL}, {_T},
 r as (select distinct x, y from (select candid as x, lead(candid) over (partition by ssnamenr order by jd, candid) as y from a where ssnamenr is not null) where y is not null),
 f as (select distinct x, y from (select candid as x, lead(candid) over (partition by trajectory_id order by jd, candid) as y from t) where y is not null),
 m as (select count(*) filter (where r.x is not null and f.x is not null) as true_positive, count(*) filter (where r.x is null) as false_positive, count(*) filter (where f.x is null) as false_negative
   from r full join f on r.x = f.x and r.y = f.y)
select *, round(true_positive * 100.0::double / (true_positive + false_positive), 6) as precision, round(true_positive * 100.0::double / (true_positive + false_negative), 6) as recall,
 true_positive + false_negative as n_real from m""",
    "efficiency_report": f"""with {ALERTS_SQL}, {_T}, x as (select * from a where ssnamenr is not null),
 g as (select ssnamenr, nid - lag(nid) over (partition by ssnamenr order by jd, candid) as gap from x),
 d as (select ssnamenr from g group by 1 having count(*) >= 6 and bool_and(coalesce(gap, 0) <= 15)),
 nm as (select trajectory_id, count(distinct ssnamenr) as names, min(ssnamenr) as ssnamenr from t join x using (candid) group by 1),
 c as (select (select count(*) from d) as n_detectable, (select count(*) from d where ssnamenr in (select ssnamenr from nm where names = 1)) as n_unique,
   (select count(*) from nm) as n_trajectories, (select count(*) from nm where names = 1) as n_pure)
select *, round(case when n_trajectories > 0 then n_pure * 100.0::double / n_trajectories else 0 end, 6) as purity, round(case when n_detectable > 0 then n_unique * 100.0::double / n_detectable else 0 end, 6) as efficiency from c""",
    "name_numbers": "select ssnamenr, row_number() over (order by encode(ssnamenr)) - 1 as n from (select distinct ssnamenr from alerts where ssnamenr is not null)",
    "first_nights": f"with {ALERTS_SQL} select nid, fid, count(*) as n from a where nid in (select distinct nid from a order by nid limit 7) group by 1, 2",
}
