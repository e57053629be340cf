"""Links across nights: trajectories with tracklets and alerts, tracklets with old alerts, alerts with alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.sky import angle_over_time, planar_angle
from driftline.operators.graph import numbered
from driftline.operators.pairs import night_pairs, point
from driftline.runtime import Written, written
from driftline.schema import POINT_COLUMNS, LinkConfig


def last_points(trajectories: DataFrame, n: int, newest: bool = True) -> DataFrame:
    """The n last (or first) rows of each trajectory, by time and candid."""
    order = [F.col("jd").desc(), F.col("candid").desc()] if newest else [F.col("jd"), F.col("candid")]
    rank = F.row_number().over(Window.partitionBy("trajectory_id").orderBy(*order))
    return trajectories.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def end_points(trajectories: DataFrame, newest: bool = True) -> DataFrame:
    """Of each trajectory of two points or more, the point at one end flat, and its inner neighbour as ``p1``.

    The end is the last point, or with ``newest=False`` the first one, which is then matched backwards in time.
    """
    two = last_points(trajectories, 2, newest).groupBy("trajectory_id").agg(
        F.sort_array(F.collect_list(F.struct("jd", "candid", "ra", "dec", "nid", "fid", "magpsf")), asc=not newest).alias("p")
    )
    two = two.where(F.size("p") == 2)
    return two.select("trajectory_id", *[F.col("p")[0][c].alias(c) for c in POINT_COLUMNS], F.col("p")[1].alias("p1"))


def within_cone(pairs: DataFrame, max_angle_deg: float, end: str = "l", other: str = "r") -> DataFrame:
    """Pairs whose candidate continues the direction of the trajectory: angle at the inner point, planar in (ra, dec)."""
    angle = planar_angle(f"{end}.p1.ra", f"{end}.p1.dec", f"{end}.ra", f"{end}.dec", f"{other}.ra", f"{other}.dec")
    days = F.col(f"{other}.jd") - F.col(f"{end}.jd")
    return pairs.withColumn("angle", angle_over_time(angle, days)).where(F.col("angle") <= max_angle_deg)


def newest_night_only(pairs: DataFrame, key: str, gap: Column) -> DataFrame:
    """Of each candidate the pairs over its smallest gap: nights are served newest first and take what they match."""
    least = F.min(gap).over(Window.partitionBy(key))
    return pairs.withColumn("_least", least).where(gap == F.col("_least")).drop("_least")


def ranked(pairs: DataFrame) -> DataFrame:
    """Order of the matches of each trajectory: equal filters first, then time and candid; the first extends it."""
    differs = (F.col("l.fid") != F.col("r.fid")).cast("int")
    return pairs.withColumn("rk", F.row_number().over(Window.partitionBy("l.trajectory_id").orderBy(differs, F.col("r.jd"), F.col("r.candid"))))


@dataclass(frozen=True)
class Growth:
    """What one pass adds: new rows (copies made by forks, and additions), the pairs with their ``new_id``, and counts."""

    rows: DataFrame
    used: DataFrame
    n_pairs: int
    n_forks: int


def growth(trajectories: DataFrame, pairs: DataFrame, additions: DataFrame, tag: str, first_id: int) -> Growth:
    """Extensions of trajectories and their forks.

    ``pairs`` has ``trajectory_id, rk, key, gap``; ``additions`` has ``key`` and the point columns to add. The match
    of rank 1 extends its trajectory; every further one makes a copy of the trajectory as it was, with the match,
    under a new id numbered from ``first_id`` by (gap, trajectory, rank).
    """
    matches = written(pairs, "matches", forks=F.count_if(F.col("rk") > 1))
    pairs, n_forks = matches.df, matches.seen["forks"]
    named = pairs.where("rk = 1").withColumn("new_id", F.col("trajectory_id"))
    rows = None
    if n_forks:
        forks = numbered(pairs.where("rk > 1"), ["gap", "trajectory_id", "rk"], "new_id", first_id)
        named = named.unionByName(forks)
        rows = trajectories.join(forks.select("trajectory_id", "new_id"), "trajectory_id").withColumn("trajectory_id", F.col("new_id")).drop("new_id")
    added = additions.join(named.select("key", F.col("new_id").alias("trajectory_id")), "key").drop("key").withColumn("assoc_tag", F.lit(tag))
    return Growth(added if rows is None else rows.unionByName(added, allowMissingColumns=True), named, matches.seen["rows"], n_forks)


def grow(trajectories: DataFrame, pairs: DataFrame, additions: DataFrame, tag: str, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Extended trajectories and their forks, as rows, and the pairs with their ids: :func:`growth` with what was there."""
    g = growth(trajectories, pairs, additions, tag, first_id)
    return trajectories.unionByName(g.rows, allowMissingColumns=True), g.used


def extension(trajectories: DataFrame, candidates: DataFrame, additions: DataFrame, key: str, next_nid: int, cfg: LinkConfig, tag: str, first_id: int) -> Growth:
    """Trajectories with candidates of one night.

    ``candidates`` are single points with ``key`` (a tracklet's id or a candid); ``additions`` the rows each adds.
    """
    ends = end_points(trajectories).withColumn("next_nid", F.lit(next_nid))
    pairs = within_cone(night_pairs(ends, candidates, cfg.separation_deg, cfg.mag_same, cfg.mag_diff, cfg.trajectory_window, "next_nid"), cfg.max_angle_deg)
    pairs = ranked(newest_night_only(pairs, f"r.{key}", F.col("l.gap")))
    flat = pairs.select(F.col("l.trajectory_id").alias("trajectory_id"), "rk", F.col(f"r.{key}").alias("key"), F.col("l.gap").alias("gap"))
    return growth(trajectories, flat, additions.withColumn("key", F.col(key)).drop(*([key] if key not in POINT_COLUMNS else [])), tag, first_id)


def extend_trajectories(trajectories: DataFrame, candidates: DataFrame, additions: DataFrame, key: str, next_nid: int, cfg: LinkConfig, tag: str, first_id: int) -> tuple[DataFrame, DataFrame]:
    """:func:`extension` with what was there: all rows afterwards, and the pairs used."""
    g = extension(trajectories, candidates, additions, key, next_nid, cfg, tag, first_id)
    return trajectories.unionByName(g.rows, allowMissingColumns=True), g.used


def night_links(trajectories: DataFrame, old_alerts: DataFrame, tracklets: DataFrame, new_alerts: DataFrame, night: int, cfg: LinkConfig) -> Written:
    """All pairs of a night's step that its limits allow, found by one range join of the state with the night.

    The state's sides (``l_kind``) are ends of trajectories (``t``) and old alerts (``o``), the night's (``r_kind``) are
    first points of tracklets (``k``) and lone alerts (``a``). Continuations of trajectories turn by the angle allowed at
    their inner point, per day beyond one; old alerts before tracklets by the same angle seen backwards, never per day;
    pairs of alerts have no angle. ``l_id`` and ``r_id`` are ids of trajectories and tracklets, else candids.
    """
    nothing = F.lit(None).cast(f"struct<{', '.join(f'{c}: double' for c in ('ra', 'dec'))}>").alias("p1")
    inner = F.struct(F.col("p1.ra").alias("ra"), F.col("p1.dec").alias("dec")).alias("p1")

    def side(kind: str, ends: DataFrame, lone: DataFrame, other: str) -> DataFrame:
        moving = ends.select(F.lit(kind).alias("kind"), F.col("trajectory_id").alias("id"), *POINT_COLUMNS, inner)
        return moving.unionByName(lone.select(F.lit(other).alias("kind"), F.col("candid").alias("id"), *POINT_COLUMNS, nothing))

    left = side("t", end_points(trajectories), old_alerts, "o").withColumn("next_nid", F.lit(night))
    right = side("k", end_points(tracklets, newest=False), new_alerts, "a")
    pairs = night_pairs(left, right, cfg.separation_deg, cfg.mag_same, cfg.mag_diff, cfg.trajectory_window, "next_nid")
    ahead = angle_over_time(planar_angle("l.p1.ra", "l.p1.dec", "l.ra", "l.dec", "r.ra", "r.dec"), F.col("r.jd") - F.col("l.jd"))
    back = planar_angle("r.p1.ra", "r.p1.dec", "r.ra", "r.dec", "l.ra", "l.dec")
    turns = F.when(F.col("l.kind") == "t", ahead <= cfg.max_angle_deg).when(F.col("r.kind") == "k", back <= cfg.max_angle_deg).otherwise(True)
    differs = (F.col("l.fid") != F.col("r.fid")).cast("int").alias("differs")
    flat = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "lr" for c in ("kind", "id", "jd", "candid")]
    return written(pairs.where(turns).select(*flat, F.col("l.gap").alias("gap"), differs), "links")


def matches(links: DataFrame, kinds: str, owner: str, other: str) -> DataFrame:
    """Links of two kinds as matches of trajectories: ``trajectory_id, rk, key, gap``.

    Of each right side only the newest night counts. ``owner`` is the side that is extended (l or r), ``other`` the
    side that is added; matches are ranked by equal filters first, then time and candid.
    """
    pairs = newest_night_only(links.where((F.col("l_kind") == kinds[0]) & (F.col("r_kind") == kinds[1])), "r_id", F.col("gap"))
    rank = F.row_number().over(Window.partitionBy(f"{owner}_id").orderBy("differs", f"{other}_jd", f"{other}_candid"))
    return pairs.select(F.col(f"{owner}_id").alias("trajectory_id"), rank.alias("rk"), F.col(f"{other}_id").alias("key"), "gap")


def new_pairs(old_alerts: DataFrame, new_alerts: DataFrame, next_nid: int, cfg: LinkConfig, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Two-point trajectories from old and new alerts, every pair one of its own, and the pairs."""
    old = old_alerts.select(*POINT_COLUMNS).withColumn("next_nid", F.lit(next_nid))
    pairs = night_pairs(old, new_alerts.select(*POINT_COLUMNS), cfg.separation_deg, cfg.mag_same, cfg.mag_diff, cfg.observation_window, "next_nid")
    pairs = newest_night_only(pairs, "r.candid", F.col("l.gap"))
    ids = numbered(pairs.select("l", "r"), [F.col("l.gap"), F.col("l.candid"), F.col("r.candid")], "trajectory_id", first_id)
    rows = ids.select("trajectory_id", *point("l")).unionByName(ids.select("trajectory_id", *point("r"))).withColumn("assoc_tag", F.lit("N"))
    return rows, ids.select(F.col("l.candid").alias("old_candid"), F.col("r.candid").alias("new_candid"), "trajectory_id")
