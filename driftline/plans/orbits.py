"""Queries over orbits, the catalogue and names."""

from pyspark.sql import functions as F

from driftline.functions.naming import jd_to_date, object_tag
from driftline.functions.sky import galactic, lit, separation, with_ephemeris
from driftline.operators import metrics
from driftline.operators.graph import numbered
from driftline.operators.pairs import nearest_elements, sky_join
from driftline.plans.sql import ALERTS_SQL, TRAJECTORIES_SQL, ephemeris, sep
from driftline.runtime import table
from driftline.schema import ELEMENTS, unique_alerts, unique_trajectories
from driftline.sources.catalogue import aliases, bare_number
from driftline.sources.orbit_files import observation_lines


def _good(spark, sf_dir):
    return table(spark, sf_dir, "orbits").where("a is not null and a <> -1")


def orbit_types(spark, sf_dir):
    return _good(spark, sf_dir).groupBy(metrics.orbit_type(F.col("a"), F.col("e")).alias("orbit_type")).agg(F.count(F.lit(1)).alias("n"))


def orbit_score_top10(spark, sf_dir):
    scored = metrics.orbit_scores(table(spark, sf_dir, "orbits")).orderBy("score", "trajectory_id").limit(10)
    return scored.select("trajectory_id", *[F.round(c, 6).alias(c) for c in ("rms_distance", "chi_distance", "score")])


def knn_elements(spark, sf_dir):
    """The four nearest orbits of each by (a, e, i), itself first."""
    found = nearest_elements(_good(spark, sf_dir), "trajectory_id", ["a", "e", "i"], 4)
    return found.select("trajectory_id", "neighbour", F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


def _named_trajectories(spark, sf_dir):
    """Trajectories whose alerts all carry one plain number."""
    names = unique_alerts(spark, sf_dir, "ssnamenr").select("candid", "ssnamenr")
    per = unique_trajectories(spark, sf_dir).join(names, "candid").groupBy("trajectory_id").agg(F.count_distinct("ssnamenr").alias("k"), F.min("ssnamenr").alias("ssnamenr"))
    return per.where("k = 1").drop("k")


def residuals(spark, sf_dir):
    """Relative differences of fitted orbits to the catalogue, for trajectories of one numbered object."""
    known = table(spark, sf_dir, "mpcorb_extended").where("number is not null").withColumn("ssnamenr", bare_number("number"))
    known = known.select("ssnamenr", *[F.col(c).alias(f"k_{c}") for c in ("a", "e", "i", "node", "peri", "m")])
    fitted = _good(spark, sf_dir).join(_named_trajectories(spark, sf_dir), "trajectory_id").join(known, "ssnamenr")
    pairs = dict(zip(ELEMENTS, ("k_a", "k_e", "k_i", "k_node", "k_peri", "k_m")))
    left, right = fitted.select("trajectory_id", *ELEMENTS), fitted.select("trajectory_id", *pairs.values())
    out = metrics.residuals(left, right, "trajectory_id", pairs)
    return out.select("trajectory_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "trajectory_id"])


def _plain_names(spark, sf_dir):
    return table(spark, sf_dir, "alerts", "ssnamenr").where("ssnamenr is not null").distinct().withColumn("alias", F.regexp_replace("ssnamenr", " ", ""))


def alias_match(spark, sf_dir):
    """Stored names that are an alias of an object as they stand, with the kinds of alias."""
    names = aliases(table(spark, sf_dir, "mpcorb_extended"))
    return _plain_names(spark, sf_dir).join(names, "alias").groupBy("ssnamenr", "principal_desig").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def not_matched(spark, sf_dir):
    names = aliases(table(spark, sf_dir, "mpcorb_extended")).select("alias")
    return _plain_names(spark, sf_dir).join(names, "alias", "left_anti").select("ssnamenr")


def keyed_union(spark, sf_dir):
    """The union of three joins by number, name and designation, repetitions kept: matches by kind."""
    names, stored = aliases(table(spark, sf_dir, "mpcorb_extended")), _plain_names(spark, sf_dir)
    parts = [stored.join(names.where(F.col("kind").isin(*kinds)), "alias").select("ssnamenr", "principal_desig", "kind") for kinds in (("number",), ("name",), ("principal", "other"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def class_recovery(spark, sf_dir):
    """Objects of each catalogue class, and how many of them have a trajectory of their own."""
    known = table(spark, sf_dir, "mpcorb_extended").where("number is not null").select(bare_number("number").alias("ssnamenr"), "orbit_type")
    found = _named_trajectories(spark, sf_dir).select("ssnamenr").distinct().withColumn("found", F.lit(1))
    per = known.join(found, "ssnamenr", "left").groupBy("orbit_type").agg(F.count(F.lit(1)).alias("n_known"), F.count("found").alias("n_found"))
    return per.withColumn("percent", F.round(F.col("n_found") * lit(100) / F.col("n_known"), 6))


def counterpart_purity(spark, sf_dir):
    """Trajectories by whether their alerts are of one object, none, or several."""
    names = unique_alerts(spark, sf_dir, "ssnamenr").select("candid", "ssnamenr")
    per = unique_trajectories(spark, sf_dir).join(names, "candid").groupBy("trajectory_id").agg(
        F.count_distinct("ssnamenr").alias("k"), F.count("ssnamenr").alias("named"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("named") == 0, "unknown").when((F.col("k") == 1) & (F.col("named") == F.col("n")), "pure").otherwise("not pure")
    return per.groupBy(kind.alias("purity")).agg(F.count(F.lit(1)).alias("n"))


def tags(spark, sf_dir):
    """Tags of fitted orbits in the order of their epochs."""
    rows = numbered(_good(spark, sf_dir).select("trajectory_id", "ref_epoch"), ["ref_epoch", "trajectory_id"], "n")
    return rows.select("trajectory_id", object_tag(F.col("n"), F.col("ref_epoch")).alias("tag"))


def tagged_points(spark, sf_dir):
    """Rows of fitted trajectories under their tags."""
    return unique_trajectories(spark, sf_dir).join(tags(spark, sf_dir), "trajectory_id").select("tag", "candid")


def jd_dates(spark, sf_dir):
    return unique_alerts(spark, sf_dir).groupBy(jd_to_date(F.col("jd")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def galactic_latitudes(spark, sf_dir):
    lon, lat = galactic("ra", "dec")
    return unique_alerts(spark, sf_dir).select("candid", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


def mpc_lines(spark, sf_dir):
    return observation_lines(unique_trajectories(spark, sf_dir))


def _ephemerides(spark, sf_dir, offsets):
    orbits = _good(spark, sf_dir).where("e < 1").withColumn("offset", F.explode(F.array(*[F.lit(x) for x in offsets]))).withColumn("jd", F.col("ref_epoch") + F.col("offset"))
    return with_ephemeris(orbits, ELEMENTS, "ref_epoch", "jd").select("trajectory_id", "offset", "jd", "ra", "dec", "distance")


def ephemeris_table(spark, sf_dir):
    """Predicted positions 7, 30, 120 and 360 days after the epoch, by two bodies."""
    return _ephemerides(spark, sf_dir, [7, 30, 120, 360]).select("trajectory_id", "offset", *[F.round(c, 4).alias(c) for c in ("ra", "dec", "distance")])


def ephemeris_alerts(spark, sf_dir):
    """Alerts within a degree of a predicted position of their night; of each the nearest prediction.

    Each orbit is predicted for all nights that have alerts, at the time of day of its epoch.
    """
    alerts = unique_alerts(spark, sf_dir)
    first = F.floor(F.col("ref_epoch") - lit(2457754.5)).cast("int")
    known = sorted(r.nid for r in alerts.select("nid").distinct().collect())  # nights, not rows
    nights = _good(spark, sf_dir).where("e < 1").withColumn("nid", F.explode(F.array(*[F.lit(n) for n in known]).cast("array<int>")))
    nights = nights.withColumn("jd", F.col("ref_epoch") + (F.col("nid") - first))
    predicted = with_ephemeris(nights, ELEMENTS, "ref_epoch", "jd").select("trajectory_id", "nid", "ra", "dec")
    found = sky_join(predicted, alerts, 1.0, [("nid", "nid")], 1.0)
    return found.groupBy(F.col("r.candid").alias("candid")).agg(F.min_by("l.trajectory_id", F.struct("sep_deg", "l.trajectory_id")).alias("trajectory_id"))


def ephemeris_deviation(spark, sf_dir):
    """How far fitted orbits and catalogue orbits put an object apart, 7, 30, 120 and 360 days on."""
    known = table(spark, sf_dir, "mpcorb_extended").where("number is not null and a is not null and e < 1").select(
        bare_number("number").alias("ssnamenr"), F.struct("a", "e", "i", "node", "peri", "m", "epoch").alias("k"))
    both = _good(spark, sf_dir).where("e < 1").join(_named_trajectories(spark, sf_dir), "trajectory_id").join(known, "ssnamenr")
    both = both.withColumn("offset", F.explode(F.array(*[F.lit(x) for x in (7, 30, 120, 360)]))).withColumn("jd", F.col("ref_epoch") + F.col("offset"))
    both = with_ephemeris(both, ELEMENTS, "ref_epoch", "jd", "fit_")
    both = with_ephemeris(both, [f"k.{c}" for c in ("a", "e", "i", "node", "peri", "m")], "k.epoch", "jd", "list_")
    return both.select("trajectory_id", "offset", F.round(separation("fit_ra", "fit_dec", "list_ra", "list_dec"), 4).alias("sep_deg"))


QUERIES = {
    f.__name__: f
    for f in (
        orbit_types, orbit_score_top10, knn_elements, residuals, alias_match, not_matched, keyed_union, class_recovery, counterpart_purity, tags,
        tagged_points, jd_dates, galactic_latitudes, mpc_lines, ephemeris_table, ephemeris_alerts, ephemeris_deviation,
    )
}

_GOOD = "select * from orbits where a is not null and a <> -1"
_ALIASES = """al as (select distinct principal_desig, kind, alias from (
  select principal_desig, 'number' as kind, regexp_extract(number, '(\\d+)', 1) as alias from mpcorb_extended
  union all select principal_desig, 'name', name from mpcorb_extended
  union all select principal_desig, 'principal', replace(principal_desig, ' ', '') from mpcorb_extended
  union all select principal_desig, 'other', replace(unnest(other_desigs), ' ', '') from mpcorb_extended) where alias is not null and alias <> ''),
 st as (select distinct ssnamenr, replace(ssnamenr, ' ', '') as alias from alerts where ssnamenr is not null)"""
_NAMED = f"""{ALERTS_SQL}, {TRAJECTORIES_SQL},
 named as (select trajectory_id, min(ssnamenr) as ssnamenr from t join a using (candid) group by 1 having count(distinct ssnamenr) = 1)"""
_RES = ", ".join(f"round(abs(k.{k} - o.{o}) / nullif(k.{k}, 0), 6) as res_{o}" for o, k in zip(ELEMENTS, ("a", "e", "i", "node", "peri", "m")))
_TAG = "'FF' || strftime(date '1970-01-01' + cast(floor(ref_epoch - 2440587.5::double) as int), '%Y%m%d') || " + " || ".join(
    f"chr(cast(97 + (n // {26**k}) % 26 as int))" for k in range(6, -1, -1)
)
_TAGS = f"tg as (select trajectory_id, {_TAG} as tag from (select *, row_number() over (order by ref_epoch, trajectory_id) - 1 as n from ({_GOOD})))"
_GAL = {
    "x": "(-0.0548755604::double * x + -0.8734370902::double * y + -0.4838350155::double * z)",
    "y": "(0.4941094279::double * x + -0.4448296300::double * y + 0.7469822445::double * z)",
    "z": "(-0.8676661490::double * x + -0.1980763734::double * y + 0.4559837762::double * z)",
}

SQL = {
    "orbit_types": f"""select case when a >= 1.7 and a <= 4.5 then 'main belt' when a > 4.5 then 'distant' when a < 1.7 and e > 0.1 then 'earth crosser' else 'inner' end as orbit_type,
 count(*) as n from ({_GOOD}) group by 1""",
    "orbit_score_top10": """with s as (select trajectory_id, sqrt(pow(rms_a - 0.018712::double, 2) + pow(rms_e - 0.009554::double, 2) + pow(rms_i - 0.170369::double, 2)
   + pow(rms_long_node - 0.383595::double, 2) + pow(rms_arg_peric - 4.314636::double, 2) + pow(rms_mean_anomaly - 3.791175::double, 2)) as r, abs(chi_reduced - 1) as c
 from orbits where a is not null and a <> -1 and rms_a <> -1 and chi_reduced is not null)
select trajectory_id, round(r, 6) as rms_distance, round(c, 6) as chi_distance, round(sqrt(r * r + c * c), 6) as score from s order by sqrt(r * r + c * c), trajectory_id limit 10""",
    "knn_elements": f"""with g as ({_GOOD}), d as (select x.trajectory_id, y.trajectory_id as neighbour, sqrt(pow(x.a - y.a, 2) + pow(x.e - y.e, 2) + pow(x.i - y.i, 2)) as distance from g x cross join g y),
 r as (select *, row_number() over (partition by trajectory_id order by distance, neighbour) as rank from d)
select trajectory_id, neighbour, cast(rank as int) as rank, round(distance, 6) as distance from r where rank <= 4""",
    "residuals": f"""with {_NAMED} select o.trajectory_id, {_RES} from ({_GOOD}) o join named n using (trajectory_id)
 join (select *, regexp_extract(number, '(\\d+)', 1) as ssnamenr from mpcorb_extended where number is not null) k on k.ssnamenr = n.ssnamenr""",
    "alias_match": f"with {_ALIASES} select ssnamenr, principal_desig, string_agg(distinct kind, ',' order by kind) as kinds from st join al using (alias) group by 1, 2",
    "not_matched": f"with {_ALIASES} select ssnamenr from st where alias not in (select alias from al)",
    "keyed_union": f"with {_ALIASES} select kind, count(*) as n from st join al using (alias) group by kind",
    "class_recovery": f"""with {_NAMED}, f as (select distinct ssnamenr, 1 as found from named), k as (select regexp_extract(number, '(\\d+)', 1) as ssnamenr, orbit_type from mpcorb_extended where number is not null)
select orbit_type, count(*) as n_known, count(found) as n_found, round(count(found) * 100.0::double / count(*), 6) as percent from k left join f using (ssnamenr) group by 1""",
    "counterpart_purity": f"""with {ALERTS_SQL}, {TRAJECTORIES_SQL}, per as (select trajectory_id, count(distinct ssnamenr) as k, count(ssnamenr) as named, count(*) as n from t join a using (candid) group by 1)
select case when named = 0 then 'unknown' when k = 1 and named = n then 'pure' else 'not pure' end as purity, count(*) as n from per group by 1""",
    "tags": f"with {_TAGS} select trajectory_id, tag from tg",
    "tagged_points": f"with {TRAJECTORIES_SQL}, {_TAGS} select tag, candid from t join tg using (trajectory_id)",
    "jd_dates": f"with {ALERTS_SQL} select date '1970-01-01' + cast(floor(jd - 2440587.5::double) as int) as day, count(*) as n from a group by 1",
    "galactic_latitudes": f"""with {ALERTS_SQL}, c as (select candid, cos(radians("dec")) * cos(radians(ra)) as x, cos(radians("dec")) * sin(radians(ra)) as y, sin(radians("dec")) as z from a),
 g as (select candid, degrees(atan2({_GAL['y']}, {_GAL['x']})) as lon, degrees(asin(greatest(-1, least(1, {_GAL['z']})))) as lat from c)
select candid, round(case when lon < 0 then lon + 360 else lon end, 5) as lon, round(lat, 5) as lat from g""",
}

_OFFSETS = "(select unnest([7, 30, 120, 360]) as \"offset\")"
SQL["ephemeris_table"] = f"""with {ephemeris('o', f'select *, ref_epoch + "offset" as jd from ({_GOOD}) join {_OFFSETS} on true where e < 1', ELEMENTS, 'ref_epoch')}
select trajectory_id, "offset", round(o_ra, 4) as ra, round(o_dec, 4) as dec, round(o_distance, 4) as distance from o"""
SQL["ephemeris_alerts"] = f"""with {ALERTS_SQL}, nights as (select distinct nid from a),
 {ephemeris('o', f'select g.*, n.nid, ref_epoch + (n.nid - cast(floor(ref_epoch - 2457754.5::double) as int)) as jd from ({_GOOD}) g join nights n on true where e < 1', ELEMENTS, 'ref_epoch')},
 near as (select a.candid, o.trajectory_id, {sep('o.o_ra', 'o.o_dec', 'a.ra', 'a."dec"')} as far from a join o on o.nid = a.nid and abs(o.o_dec - a."dec") <= 1.000001)
select candid, arg_min(trajectory_id, (far, trajectory_id)) as trajectory_id from near where far <= 1 group by candid"""
SQL["ephemeris_deviation"] = f"""with {_NAMED},
 both_ as (select o.*, k.a as ka, k.e as ke, k.i as ki, k.node, k.peri, k.m, k.epoch as k_epoch, f."offset", o.ref_epoch + f."offset" as jd from ({_GOOD}) o join named n using (trajectory_id)
   join (select *, regexp_extract(number, '(\\d+)', 1) as ssnamenr from mpcorb_extended where number is not null and a is not null and e < 1) k on k.ssnamenr = n.ssnamenr
   join {_OFFSETS} f on true where o.e < 1),
 {ephemeris('o', 'select * from both_', ELEMENTS, 'ref_epoch')},
 {ephemeris('q', 'select * from o', ['ka', 'ke', 'ki', 'node', 'peri', 'm'], 'k_epoch')}
select trajectory_id, "offset", round({sep('o_ra', 'o_dec', 'q_ra', 'q_dec')}, 4) as sep_deg from q"""


def _split(x: str) -> str:
    """Hundredths of seconds as ``dd mm ss.ss``."""
    return f"printf('%02d %02d %02d.%02d', {x} // 360000, {x} // 6000 % 60, {x} // 100 % 60, {x} % 100)"


SQL["mpc_lines"] = f"""with {TRAJECTORIES_SQL},
 p as (select *, row_number() over w - 1 as place, first_value(jd) over w as first_jd from t window w as (partition by trajectory_id order by jd, candid)),
 d as (select *, date '1970-01-01' + cast(floor(first_jd - 2440587.5::double) as int) as day, trajectory_id % 15500 as n,
   make_timestamp(cast(round((jd - 2440587.5::double) * 86400000000::double) as bigint)) as utc,
   cast(round(ra / 15 * 360000) as bigint) % (24 * 360000) as h, cast(round(abs("dec") * 360000) as bigint) as g from p),
 q as (select *, substr('IJKL', cast(year(day) // 100 - 18 + 1 as int), 1) || printf('%02d', year(day) % 100)
     || substr('ABCDEFGHJKLMNOPQRSTUVWXY', cast((month(day) - 1) * 2 + case when day(day) > 15 then 1 else 0 end + 1 as int), 1)
     || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', cast(n // 25 // 10 + 1 as int), 1) || (n // 25 % 10)
     || substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', cast(n % 25 + 1 as int), 1) as designation from d)
select trajectory_id, designation, cast(place as int) as place,
  rpad('     ' || rpad(designation, 7, ' ') || case when place = 0 then '*' else ' ' end || ' C'
    || rpad(strftime(utc, '%Y %m %d') || '.' || lpad(cast(hour(utc) * 3600 + minute(utc) * 60 + hour(utc) as varchar), 5, '0'), 17, ' ')
    || {_split('h')} || ' ' || case when "dec" < 0 then '-' else '+' end || {_split('g')}
    || '        ' || lpad(cast(cast(round(cast(cast(magpsf as varchar) as decimal(18, 8)), 1) as decimal(9, 1)) as varchar), 5, ' ') || ' ' || case fid when 1 then 'g' else 'r' end, 77, ' ') || 'I41' as line
from q"""
