"""Declared schemas, parameters, and the views of the given tables that all operators start from."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.sky import normal_ra
from driftline.runtime import table

ALERT = (
    "objectid string, candid bigint, ra double, dec double, jd double, nid int, fid int, magpsf double, "
    "sigmapsf double, ssnamenr string, not_updated boolean, last_assoc_date date"
)
POINT = "candid bigint, ra double, dec double, jd double, nid int, fid int, magpsf double"
TRAJECTORY = f"trajectory_id bigint, {POINT}, assoc_tag string, not_updated boolean"
ORBIT = (
    "trajectory_id bigint, ref_epoch double, a double, e double, i double, long_node double, arg_peric double, "
    "mean_anomaly double, rms_a double, rms_e double, rms_i double, rms_long_node double, rms_arg_peric double, "
    "rms_mean_anomaly double, chi_reduced double"
)
ELEMENTS = ["a", "e", "i", "long_node", "arg_peric", "mean_anomaly"]
POINT_COLUMNS = ["candid", "ra", "dec", "jd", "nid", "fid", "magpsf"]


@dataclass(frozen=True)
class LinkConfig:
    """Parameters of the nightly association, angles in degrees where not said otherwise."""

    trajectory_window: int = 15
    observation_window: int = 2
    two_point_window: int = 8
    intra_separation_arcsec: float = 120.0
    intra_mag_same: float = 0.2
    intra_mag_diff: float = 0.8
    separation_deg: float = 0.3
    mag_same: float = 0.1
    mag_diff: float = 0.5
    max_angle_deg: float = 1.0
    orbit_points: int = 6
    use_density: bool = False
    tracklets_to_trajectories: bool = True
    alerts_to_trajectories: bool = True
    old_alerts_to_tracklets: bool = True
    old_alerts_to_alerts: bool = True

    @classmethod
    def from_file(cls, path: str) -> LinkConfig:
        """Values of the section ``[link]`` of an INI file; environment variables may be used as ``%(NAME)s``."""
        import os

        parser = configparser.ConfigParser({k: v for k, v in os.environ.items() if "%" not in v})
        if not parser.read(path):
            raise FileNotFoundError(path)
        known, given = {f.name: f for f in fields(cls)}, {}
        for key in parser["link"]:
            if key in known:
                kind = known[key].type
                given[key] = (
                    parser["link"].getboolean(key) if kind == "bool" else parser["link"].getint(key) if kind == "int" else parser["link"].getfloat(key)
                )
        return cls(**given)


def coerced(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` that the frame has, cast to their declared types; text that is no number becomes null."""
    wanted = [part.strip().split(" ") for part in schema.split(",")]
    present = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(present[name]).try_cast(kind).alias(name) for name, kind in wanted if name in present])


def finite(*columns: str):
    """Not null, not NaN and not infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.abs(F.col(c)) < F.lit(float("inf")))
    return out


def unique_alerts(spark, sf_dir: str, *more: str) -> DataFrame:
    """One row per alert (the delivery received first; without a time, last) with a position, time, magnitude and filter, ra in [0, 360)."""
    names = list(dict.fromkeys([*POINT_COLUMNS, *more]))
    raw = table(spark, sf_dir, "alerts", *names, "received_at", "delivery_id")
    rank = F.row_number().over(Window.partitionBy("candid").orderBy(F.col("received_at").asc_nulls_last(), F.col("delivery_id").asc_nulls_last()))
    kept = raw.withColumn("rank", rank).where("rank = 1").drop("rank", "received_at", "delivery_id")
    sane = finite("ra", "dec", "jd", "magpsf") & F.col("nid").isNotNull() & F.col("fid").isNotNull()
    return kept.where(sane).withColumn("ra", normal_ra("ra")).select(*names)


def finite_sql(*columns: str) -> str:
    """DuckDB's test for finite values by their text: its statistics of a file leave NaN out, so ``isnan`` may be folded away."""
    return " and ".join(f"cast({c} as varchar) not in ('nan', 'inf', '-inf')" for c in columns)


#: The same view for DuckDB, as a common table expression ``a``.
ALERTS_SQL = f"""a as (
  select * replace (case when ra < 0 then ra + 360 else ra end as ra) from (
    select *, row_number() over (partition by candid order by received_at nulls last, delivery_id nulls last) as rank from alerts)
  where rank = 1 and {finite_sql('ra', '"dec"', 'jd', 'magpsf')} and nid is not null and fid is not null)"""


def unique_trajectories(spark, sf_dir: str) -> DataFrame:
    """Rows of real trajectories with complete points, each alert of a trajectory once."""
    raw = table(spark, sf_dir, "trajectories", "trajectory_id", *POINT_COLUMNS)
    sane = finite("ra", "dec", "jd", "magpsf") & F.col("nid").isNotNull() & F.col("fid").isNotNull()
    real = raw.where((F.col("trajectory_id") >= 0) & F.col("candid").isNotNull() & sane)
    return real.withColumn("ra", normal_ra("ra")).select("trajectory_id", *POINT_COLUMNS).dropDuplicates(["trajectory_id", "candid"])


TRAJECTORIES_SQL = f"""t as (
  select trajectory_id, candid, any_value(case when ra < 0 then ra + 360 else ra end) as ra, any_value("dec") as "dec", any_value(jd) as jd,
         any_value(nid) as nid, any_value(fid) as fid, any_value(magpsf) as magpsf
  from trajectories where trajectory_id >= 0 and candid is not null and {finite_sql('ra', '"dec"', 'jd', 'magpsf')}
    and nid is not null and fid is not null
  group by trajectory_id, candid)"""
