"""Search of further alerts of fitted trajectories, forwards and backwards in time, with a new fit after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.sky import lit, separation, with_ephemeris
from driftline.operators.orbit_fit import FAILED, Solver, fit_orbits, two_body_fit
from driftline.operators.pairs import sky_join
from driftline.runtime import written
from driftline.schema import ELEMENTS, POINT_COLUMNS

#: Julian date at which night 0 begins (noon before 2017-01-01, UT).
NIGHT_ZERO_JD = 2457754.5


def predicted_nights(orbits: DataFrame, first: str, last: str) -> DataFrame:
    """Positions of orbits at midnight of each night from column ``first`` to column ``last``: with ``nid, jd, ra, dec``."""
    nights = orbits.withColumn("nid", F.explode(F.sequence(F.col(first), F.col(last)))).withColumn("jd", F.col("nid") + lit(NIGHT_ZERO_JD))
    return with_ephemeris(nights, ELEMENTS, "ref_epoch", "jd")


def matched(predicted: DataFrame, alerts: DataFrame, radius_arcsec: float, coarse_deg: float = 1.5) -> DataFrame:
    """Alerts within the radius of where their time puts an orbit; of each alert the nearest orbit: ``trajectory_id`` and a point.

    Predictions of the night are joined within ``coarse_deg`` (more than an object moves in half a day), then
    positions are predicted for the time of the alert itself.
    """
    near = sky_join(predicted, alerts, coarse_deg, [("nid", "nid")], coarse_deg, height_deg=2 * coarse_deg)
    exact = with_ephemeris(near, [f"l.{c}" for c in ELEMENTS], "l.ref_epoch", "r.jd", "at_")
    close = exact.withColumn("sep", separation("at_ra", "at_dec", "r.ra", "r.dec") * 3600).where(F.col("sep") <= radius_arcsec)
    best = close.groupBy(F.col("r.candid").alias("candid")).agg(F.min_by(F.struct(F.col("l.trajectory_id").alias("trajectory_id"), "r"), F.struct("sep", "l.trajectory_id")).alias("b"))
    return best.select("b.trajectory_id", *[F.col(f"b.r.{c}").alias(c) for c in POINT_COLUMNS])


def follow_up(points: DataFrame, orbits: DataFrame, alerts: DataFrame, step: int = 15, radius_arcsec: float = 5.0, solver: Solver = two_body_fit) -> tuple[DataFrame, DataFrame]:
    """Points and orbits of trajectories extended by all alerts their orbits predict; new points have the tag ``E``.

    All trajectories take a step of ``step`` nights at once, forwards until none finds more, then backwards, in as many
    steps as that takes: only trajectories that found something go on, and each of their steps takes alerts that are
    then no longer free, so it ends. After each step those with new points are fitted again; where that fails, the
    new points are given back.
    """
    now = written(points.select("trajectory_id", *POINT_COLUMNS).withColumn("assoc_tag", F.lit(None).cast("string")), "follow").df
    fitted = written(orbits.where((F.col("a") != FAILED) & F.col("a").isNotNull()), "orbits").df
    alerts = alerts.select(*POINT_COLUMNS)
    for forward in (True, False):
        edge = now.groupBy("trajectory_id").agg((F.max("nid") + 1 if forward else F.min("nid") - 1).alias("edge"))
        active = written(edge, "edges").df
        while True:
            low, high = (F.col("edge"), F.col("edge") + step - 1) if forward else (F.col("edge") - step + 1, F.col("edge"))
            spans = fitted.join(active, "trajectory_id").withColumns({"from_nid": low.cast("int"), "to_nid": high.cast("int")})
            free = alerts.join(now.select("candid"), "candid", "left_anti")
            found = written(matched(predicted_nights(spans, "from_nid", "to_nid"), free, radius_arcsec).withColumn("assoc_tag", F.lit("E")), "found")
            if not found.seen["rows"]:
                break
            touched = found.df.select("trajectory_id").distinct()
            longer = now.join(touched, "trajectory_id", "left_semi").unionByName(found.df)
            better = written(fit_orbits(longer, 3, solver).where(F.col("a") != FAILED), "orbits").df
            kept = found.df.join(better, "trajectory_id", "left_semi")
            now = written(now.unionByName(kept), "follow").df
            fitted = written(fitted.join(better, "trajectory_id", "left_anti").unionByName(better, allowMissingColumns=True), "orbits").df
            shift = step if forward else -step
            active = written(active.join(better, "trajectory_id", "left_semi").withColumn("edge", F.col("edge") + shift), "edges").df
    return now, fitted
