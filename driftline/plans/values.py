"""Queries of functions over alerts and trajectories: magnitudes, dates, labels, scalings, reports."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.naming import band_letter, from_sexagesimal, mjd_to_jd, observation_date, sexagesimal
from driftline.functions.sky import chord, difference_magnitude, lit, separation
from driftline.operators import metrics, study
from driftline.operators.link import end_points
from driftline.plans.sql import ALERTS_SQL, TRAJECTORIES_SQL, sep
from driftline.runtime import table
from driftline.schema import unique_alerts, unique_trajectories

KEY = "trajectory_id"


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def apparent_magnitudes(spark, sf_dir):
    """Magnitudes of objects from difference photometry, with errors; the sign is text of two conventions."""
    alerts = unique_alerts(spark, sf_dir, "sigmapsf", "magnr", "sigmagnr", "isdiffpos")
    positive = F.when(F.col("isdiffpos").isin("t", "1"), True).when(F.col("isdiffpos").isin("f", "0"), False)
    mag, sigma = difference_magnitude(F.col("magpsf"), F.col("sigmapsf"), F.col("magnr"), F.col("sigmagnr"), positive)
    rows = alerts.where("isdiffpos is not null").select("candid", F.round(mag, 5).alias("mag"), F.round(sigma, 5).alias("sigma"))
    return rows.where(F.col("mag").isNotNull() & F.col("sigma").isNotNull() & ~F.isnan("mag") & ~F.isnan("sigma"))


def positions_in_sixties(spark, sf_dir):
    """Positions as written in observation lines, and read again."""
    text = unique_alerts(spark, sf_dir).withColumn("position", sexagesimal(F.col("ra"), F.col("dec")))
    ra, dec = from_sexagesimal(F.substring("position", 1, 11), hours=True), from_sexagesimal(F.substring("position", 13, 12))
    return text.select("candid", "position", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


def observation_dates(spark, sf_dir):
    """Alerts by the day of their observation date (the true fraction of the day, cut to a thousandth) and filter letter."""
    jd = mjd_to_jd(F.col("jd") - lit(2400000.5))
    day = F.substring(observation_date(jd, mpc_compat=False), 1, 14)
    return unique_alerts(spark, sf_dir).groupBy(day.alias("day"), band_letter(F.col("fid"), "-").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def class_labels(spark, sf_dir):
    """Catalogue entries by the short label of a class hierarchy, made from their type and the form of their orbit."""
    belt = F.when(F.col("a") < 2.5, "Inner").when(F.col("a") < 2.82, "Middle").otherwise("Outer")
    path = F.when(F.col("orbit_type") == "MBA", F.concat(F.lit("MB>"), belt)).when(F.col("orbit_type").isin("Apollo", "Amor"), F.concat(F.lit("NEA>"), F.col("orbit_type"))).otherwise(F.concat("orbit_type", F.lit(">all")))
    known = table(spark, sf_dir, "mpcorb_extended", "orbit_type", "a").where("orbit_type is not null and a is not null")
    return known.groupBy(metrics.class_label(path).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def mean_chi(spark, sf_dir):
    """Distance of the magnitudes of each trajectory from a constant one, in units of their errors."""
    errors = unique_alerts(spark, sf_dir, "sigmapsf").select("candid", "sigmapsf")
    return _rounded(study.chi_of_constant(unique_trajectories(spark, sf_dir).join(errors, "candid", "left"), KEY, "magpsf", "sigmapsf"))


def motion_changes(spark, sf_dir):
    return _rounded(study.motion_changes(unique_trajectories(spark, sf_dir), KEY), 5)


def speed_quantiles(spark, sf_dir):
    """Speeds below which half, nine tenths and 99 % of all steps lie, read off a histogram."""
    cdf = study.histogram(study.speeds(unique_trajectories(spark, sf_dir), KEY), "speed", 0.0, 2.0, 200)
    return _rounded(study.quantile_of_cdf(cdf, 0.01, [0.5, 0.9, 0.99]))


def robust_magnitude(spark, sf_dir):
    return _rounded(study.robustly_scaled(unique_trajectories(spark, sf_dir), KEY, "magpsf").select(KEY, "candid", "scaled"), 5)


def end_chords(spark, sf_dir):
    """Straight distance on the unit sphere between the last two points of each trajectory."""
    ends = end_points(unique_trajectories(spark, sf_dir))
    return ends.select(KEY, F.round(chord(separation("p1.ra", "p1.dec", "ra", "dec")), 9).alias("chord"))


def report_by_fit(spark, sf_dir):
    """Purity and efficiency of all trajectories, of those with an orbit, and of those whose orbit has errors."""
    alerts = unique_alerts(spark, sf_dir, "ssnamenr").where("ssnamenr is not null")
    points = unique_trajectories(spark, sf_dir).select(KEY, "candid").join(alerts.select("candid", "ssnamenr"), "candid")
    named = points.groupBy(KEY).agg(F.count_distinct("ssnamenr").alias("names"), F.min("ssnamenr").alias("ssnamenr"))
    orbits = table(spark, sf_dir, "orbits", KEY, "a", "rms_a").where("a is not null and a <> -1")
    with_errors = orbits.where("rms_a is not null and rms_a <> -1")
    detectable = metrics.detectable(alerts, "ssnamenr", 6, 15)
    parts = {"all": named, "orbit": named.join(orbits, KEY, "left_semi"), "orbit with errors": named.join(with_errors, KEY, "left_semi")}
    rows = [metrics.efficiency(part, detectable, "ssnamenr").withColumn("part", F.lit(name)) for name, part in parts.items()]
    return _rounded(reduce(DataFrame.unionByName, rows))


QUERIES = {
    f.__name__: f
    for f in (apparent_magnitudes, positions_in_sixties, observation_dates, class_labels, mean_chi, motion_changes, speed_quantiles, robust_magnitude, end_chords, report_by_fit)
}

_REF, _DIFF = "pow(10, -0.4::double * magnr)", "pow(10, -0.4::double * magpsf)"
_STEPS = f"""{TRAJECTORIES_SQL}, b as (select *, lag(ra) over w as ra0, lag("dec") over w as dec0, lag(jd) over w as jd0 from t window w as (partition by trajectory_id order by jd, candid)),
 s as (select *, jd - jd0 as days, {sep('ra0', 'dec0', 'ra', '"dec"')} as sep_deg from b where jd0 is not null)"""


def _six(x: str) -> str:
    return f"printf('%02d %02d %02d.%02d', {x} // 360000, {x} // 6000 % 60, {x} // 100 % 60, {x} % 100)"


def _report(part: str, which: str) -> str:
    return f"""select '{part}' as part, *, round(case when n_trajectories > 0 then n_pure * 100.0::double / n_trajectories else 0 end, 6) as purity,
 round(case when n_detectable > 0 then n_unique * 100.0::double / n_detectable else 0 end, 6) as efficiency from (
  select (select count(*) from d) as n_detectable, (select count(*) from d where ssnamenr in (select ssnamenr from nm where names = 1 {which})) as n_unique,
    (select count(*) from nm where true {which}) as n_trajectories, (select count(*) from nm where names = 1 {which}) as n_pure)"""


SQL = {
    "apparent_magnitudes": f"""with {ALERTS_SQL}, f as (select candid, {_REF} + case when isdiffpos in ('t', '1') then {_DIFF} else -{_DIFF} end as total,
   sqrt(pow({_DIFF} * sigmapsf, 2) + pow({_REF} * sigmagnr, 2)) as sigma from a where isdiffpos is not null)
select candid, round(-2.5::double * log10(total), 5) as mag, round(sigma / total, 5) as sigma from f where total > 0 and sigma is not null and not isnan(total) and not isnan(sigma)""",
    "positions_in_sixties": f"""with {ALERTS_SQL}, h as (select candid, cast(round(ra / 15 * 360000) as bigint) % (24 * 360000) as h, cast(round(abs("dec") * 360000) as bigint) as g, "dec" < 0 as south from a)
select candid, {_six('h')} || ' ' || case when south then '-' else '+' end || {_six('g')} as position, round(h / 24000.0::double, 6) as ra,
 round(case when south then -1 else 1 end * g / 360000.0::double, 6) as dec from h""",
    "observation_dates": f"""with {ALERTS_SQL}, d as (select fid, (jd - 2400000.5::double) + 2400000.5::double as jd from a),
 u as (select fid, make_timestamp(cast(round((jd - 2440587.5::double) * 86400000000::double) as bigint)) as utc, cast(floor(((jd - 2440587.5::double) % 1) * 100000) as int) as f from d)
select substr(strftime(utc, '%Y %m %d') || '.' || lpad(cast(f as varchar), 5, '0'), 1, 14) as day, case fid when 1 then 'g' when 2 then 'r' else '-' end as band, count(*) as n from u group by 1, 2""",
    "class_labels": """select case when orbit_type = 'MBA' then 'MB' else orbit_type end as label, count(*) as n from mpcorb_extended where orbit_type is not null and a is not null group by 1""",
    "mean_chi": f"""with {ALERTS_SQL}, {TRAJECTORIES_SQL}, x as (select t.trajectory_id, t.magpsf, a.sigmapsf, avg(t.magpsf) over (partition by t.trajectory_id) as mean from t left join a using (candid))
select trajectory_id, case when bool_and(coalesce(sigmapsf > 0, false)) then round(avg(abs(magpsf - mean) / sigmapsf), 6) end as chi from x group by 1""",
    "motion_changes": f"""with {_STEPS}, v as (select trajectory_id, jd, candid, sep_deg / days as speed from s where days > 0),
 c as (select *, (speed - lag(speed) over w) / nullif(jd - lag(jd) over w, 0) as change from v window w as (partition by trajectory_id order by jd, candid))
select trajectory_id, count(*) as n_steps, round(avg(speed), 5) as mean_speed, round(avg(change), 5) as mean_acceleration from c group by 1""",
    "speed_quantiles": f"""with {_STEPS}, h as (select cast(least(199, greatest(0, floor(sep_deg / greatest(days, 1.0::double) / (2.0::double / 200)))) as int) as bin, count(*) as n from s group by 1),
 c as (select bin, sum(n) over (order by bin) / sum(n) over () as cdf from h), d as (select *, coalesce(lag(cdf) over (order by bin), 0) as below from c)
select q, round(bin * 0.01::double + 0.01::double * (q - below) / (cdf - below), 6) as value from d join (select unnest([0.5::double, 0.9::double, 0.99::double]) as q) on below < q and q <= cdf""",
    "robust_magnitude": f"""with {TRAJECTORIES_SQL}, p as (select trajectory_id, quantile_cont(magpsf, 0.25) as q1, quantile_cont(magpsf, 0.5) as q2, quantile_cont(magpsf, 0.75) as q3 from t group by 1)
select trajectory_id, candid, round((magpsf - q2) / nullif(q3 - q1, 0), 5) as scaled from t join p using (trajectory_id)""",
    "end_chords": f"""with {TRAJECTORIES_SQL}, k as (select *, row_number() over (partition by trajectory_id order by jd desc, candid desc) as back from t)
select p.trajectory_id, round(2 * sin(radians({sep('q.ra', 'q."dec"', 'p.ra', 'p."dec"')}) / 2), 9) as chord from k p join k q on p.trajectory_id = q.trajectory_id and p.back = 1 and q.back = 2""",
    "report_by_fit": f"""with {ALERTS_SQL}, {TRAJECTORIES_SQL}, x as (select * from a where ssnamenr is not null),
 g as (select ssnamenr, nid - lag(nid) over (partition by ssnamenr order by jd, candid) as gap from x),
 d as (select ssnamenr from g group by 1 having count(*) >= 6 and bool_and(coalesce(gap, 0) <= 15)),
 good as (select trajectory_id, bool_or(rms_a is not null and rms_a <> -1) as errors from orbits where a is not null and a <> -1 group by 1),
 nm as (select trajectory_id, count(distinct ssnamenr) as names, min(ssnamenr) as ssnamenr from t join x using (candid) group by 1)
{_report('all', '')} union all {_report('orbit', 'and trajectory_id in (select trajectory_id from good)')}
union all {_report('orbit with errors', 'and trajectory_id in (select trajectory_id from good where errors)')}""",
}
