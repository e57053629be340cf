"""Queries of the general operators for training-data work, over the whole alerts table."""

from pyspark.sql import functions as F

from driftline.operators.deliveries import surplus_deliveries
from driftline.operators.nearby import pairs_within
from driftline.operators.skew import salted_distinct, stale_counts
from driftline.runtime import table


def p2_found(spark, sf_dir):
    alerts = table(spark, sf_dir, "alerts", "ssnamenr", "obs_month", "candid", "nb_detection")
    return stale_counts(alerts, "ssnamenr", "obs_month", "candid", "nb_detection").select("ssnamenr", "obs_month")


def p2_counts(spark, sf_dir):
    alerts = table(spark, sf_dir, "alerts", "ssnamenr", "obs_month", "candid", "nb_detection")
    return salted_distinct(alerts, "ssnamenr", "obs_month", "candid", "nb_detection")


def p3_found(spark, sf_dir):
    alerts = table(spark, sf_dir, "alerts", "candid", "ra", "dec", "nid")
    found = pairs_within(alerts, "candid", "ra", "dec", "nid", radius_arcsec=120.0)
    return found.select(F.col("a").alias("candid_a"), F.col("b").alias("candid_b")).distinct()


def p5_found(spark, sf_dir):
    alerts = table(spark, sf_dir, "alerts", "candid", "delivery_id", "received_at", "batch_id")
    return surplus_deliveries(alerts, "candid", "received_at", "delivery_id", "batch_id")


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p5_found": p5_found}

_COUNTS = """
select ssnamenr, obs_month, count(*) as n_rows, count(distinct candid) as n_distinct,
       min(nb_detection) as stored_min, max(nb_detection) as stored_max
from alerts where ssnamenr is not null group by ssnamenr, obs_month
"""

SQL = {
    "p2_found": f"select ssnamenr, obs_month from ({_COUNTS}) where stored_min <> n_distinct or stored_max <> n_distinct",
    "p2_counts": _COUNTS,
    "p3_found": """
with p as (select candid, nid, any_value(ra) as ra, any_value("dec") as d from alerts
           where candid is not null and nid is not null and abs(ra) < 'infinity'::double and abs("dec") < 'infinity'::double
           group by candid, nid)
select distinct a.candid as candid_a, b.candid as candid_b
from p a join p b on a.nid = b.nid and a.candid < b.candid and abs(a.d - b.d) < 0.0334
where degrees(2 * asin(least(1, sqrt(pow(sin(radians(b.d - a.d) / 2), 2)
      + cos(radians(a.d)) * cos(radians(b.d)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) * 3600 <= 120
""",
    "p5_found": """
select candid, delivery_id from (
  select candid, delivery_id, row_number() over (partition by candid order by received_at nulls last, delivery_id nulls last) as rn
  from alerts where candid is not null) where rn > 1
""",
}
