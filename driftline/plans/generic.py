"""Queries of relational operators that the others build on: set operations, semi and outer joins, top-k, diffs, windows of time."""

from pyspark.sql import functions as F

from driftline.runtime import table
from driftline.schema import coerced


def semi(spark, sf_dir):
    """Alerts that lie on a trajectory."""
    on = table(spark, sf_dir, "trajectories", "candid").where("candid is not null")
    return table(spark, sf_dir, "alerts", "candid", "delivery_id").join(on, "candid", "left_semi")


def anti(spark, sf_dir):
    on = table(spark, sf_dir, "trajectories", "candid").where("candid is not null")
    return table(spark, sf_dir, "alerts", "candid", "delivery_id").join(on, "candid", "left_anti")


def full_outer(spark, sf_dir):
    """Trajectory ids of points and of orbits, by where they are found."""
    t = table(spark, sf_dir, "trajectories", "trajectory_id").where("trajectory_id >= 0").distinct().withColumn("t", F.lit(1))
    o = table(spark, sf_dir, "orbits", "trajectory_id").where("trajectory_id is not null").distinct().withColumn("o", F.lit(1))
    side = F.when(F.col("o").isNull(), "points only").when(F.col("t").isNull(), "orbits only").otherwise("both")
    return t.join(o, "trajectory_id", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def union_all(spark, sf_dir):
    """Candids of all tables that have them, with how often they occur."""
    edges = table(spark, sf_dir, "path_edges")
    parts = [table(spark, sf_dir, "alerts", "candid"), table(spark, sf_dir, "trajectories", "candid"), edges.select(F.col("left_candid").alias("candid")), edges.select(F.col("right_candid").alias("candid"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("candid").agg(F.count(F.lit(1)).alias("n"))


def distinct_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "path_edges").where("left_candid <> right_candid")
    return e.select(F.least("left_candid", "right_candid").alias("a"), F.greatest("left_candid", "right_candid").alias("b")).distinct()


def intersection(spark, sf_dir):
    """Candids that both an association run and a trajectory have."""
    e = table(spark, sf_dir, "path_edges")
    return e.select(F.col("left_candid").alias("candid")).union(e.select("right_candid")).intersect(table(spark, sf_dir, "trajectories", "candid"))


def cross_run(spark, sf_dir):
    """Trajectories that share an alert: the ids of the same object in two of them."""
    t = table(spark, sf_dir, "trajectories", "trajectory_id", "candid").where("trajectory_id >= 0 and candid is not null").distinct()
    other = t.withColumnRenamed("trajectory_id", "other_id")
    return t.join(other, "candid").where("trajectory_id < other_id").select("trajectory_id", "other_id").distinct()


def frame_diff(spark, sf_dir):
    """Copies of an alert whose payload differs from the first delivery of it, by column."""
    a = table(spark, sf_dir, "alerts", "candid", "delivery_id", "received_at", "jd", "magpsf", "batch_id").where("candid is not null")
    first = a.groupBy("candid").agg(F.min_by(F.struct("delivery_id", "jd", "magpsf", "batch_id"), F.struct("received_at", "delivery_id")).alias("f"))
    both = a.join(first, "candid").where("delivery_id <> f.delivery_id")
    kinds = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"f.{c}")), F.lit(c)) for c in ("jd", "magpsf", "batch_id")])
    return both.select(F.explode(F.array_compact(kinds)).alias("differs")).groupBy("differs").agg(F.count(F.lit(1)).alias("n"))


def explode_zip(spark, sf_dir):
    """Designations of catalogue objects with their place in the list."""
    m = table(spark, sf_dir, "mpcorb_extended", "principal_desig", "other_desigs")
    return m.select("principal_desig", F.posexplode("other_desigs").alias("place", "other"))


def coerced_alerts(spark, sf_dir):
    """Alerts in declared types: text dates as dates, text flags and what is no number as null."""
    rows = coerced(table(spark, sf_dir, "alerts"), "candid bigint, nid int, last_assoc_date date, isdiffpos double")
    return rows.groupBy("last_assoc_date").agg(F.count(F.lit(1)).alias("n"), F.count("isdiffpos").alias("n_numeric"))


def brightest(spark, sf_dir):
    """The ten brightest deliveries; NaN is no brightness."""
    a = table(spark, sf_dir, "alerts", "delivery_id", "magpsf").where(F.col("magpsf").isNotNull() & ~F.isnan("magpsf"))
    return a.orderBy("magpsf", "delivery_id").limit(10)


def delivery_windows(spark, sf_dir):
    """Deliveries per day of arrival, and those that came more than a day after their night."""
    a = table(spark, sf_dir, "alerts", "received_at", "nid").where("received_at is not null")
    day = F.datediff(F.col("received_at"), F.lit("2017-01-01").cast("date"))
    return a.groupBy(F.to_date("received_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(day > F.col("nid") + 1).alias("n_late"))


def user_sessions(spark, sf_dir):
    """Sessions of event streams: runs of events of a user less than an hour apart."""
    e = table(spark, sf_dir, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (semi, anti, full_outer, union_all, distinct_pairs, intersection, cross_run, frame_diff, explode_zip, coerced_alerts, brightest, delivery_windows, user_sessions)
}

_ENDS = "select left_candid as candid from path_edges union all select right_candid from path_edges"

SQL = {
    "semi": "select candid, delivery_id from alerts where candid in (select candid from trajectories where candid is not null)",
    "anti": "select candid, delivery_id from alerts where candid is null or candid not in (select candid from trajectories where candid is not null)",
    "full_outer": """select case when o.trajectory_id is null then 'points only' when t.trajectory_id is null then 'orbits only' else 'both' end as side, count(*) as n
from (select distinct trajectory_id from trajectories where trajectory_id >= 0) t full join (select distinct trajectory_id from orbits where trajectory_id is not null) o on t.trajectory_id = o.trajectory_id group by 1""",
    "union_all": f"select candid, count(*) as n from (select candid from alerts union all select candid from trajectories union all {_ENDS}) group by 1",
    "distinct_pairs": "select distinct least(left_candid, right_candid) as a, greatest(left_candid, right_candid) as b from path_edges where left_candid <> right_candid",
    "intersection": f"({_ENDS}) intersect select candid from trajectories",
    "cross_run": """with t as (select distinct trajectory_id, candid from trajectories where trajectory_id >= 0 and candid is not null)
select distinct x.trajectory_id, y.trajectory_id as other_id from t x join t y on x.candid = y.candid and x.trajectory_id < y.trajectory_id""",
    "frame_diff": """with a as (select candid, delivery_id, received_at, jd, magpsf, batch_id from alerts where candid is not null),
 f as (select candid, arg_min({'delivery_id': delivery_id, 'jd': jd, 'magpsf': magpsf, 'batch_id': batch_id}, (received_at, delivery_id)) as f from a group by 1),
 b as (select a.*, f from a join f using (candid) where a.delivery_id <> f.delivery_id)
select differs, count(*) as n from (
  select 'jd' as differs from b where cast(jd as varchar) is distinct from cast(f.jd as varchar) union all select 'batch_id' from b where batch_id is distinct from f.batch_id
  union all select 'magpsf' from b where cast(magpsf as varchar) is distinct from cast(f.magpsf as varchar)) group by 1""",
    "explode_zip": "select principal_desig, cast(unnest(range(len(other_desigs))) as int) as place, unnest(other_desigs) as other from mpcorb_extended where len(other_desigs) > 0",
    "coerced_alerts": "select try_cast(last_assoc_date as date) as last_assoc_date, count(*) as n, count(try_cast(isdiffpos as double)) as n_numeric from alerts group by 1",
    "brightest": "select delivery_id, magpsf from alerts where magpsf is not null and cast(magpsf as varchar) <> 'nan' order by magpsf, delivery_id limit 10",
    "delivery_windows": """select cast(received_at as date) as day, count(*) as n, count(*) filter (where date_diff('day', date '2017-01-01', cast(received_at as date)) > nid + 1) as n_late
from alerts where received_at is not null group by 1""",
    "user_sessions": """with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
 s as (select user_id, sum(case when before is null or ts - before >= interval 1 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from e),
 c as (select user_id, s, count(*) as n from s group by 1, 2)
select user_id, count(*) as n_sessions, max(n) as longest from c group by 1""",
}
