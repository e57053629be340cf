"""The nightly step: state and new alerts in, state out; replay over nights."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.graph import numbered
from driftline.operators.link import growth, matches, newest_night_only, night_links
from driftline.operators.tracklets import tracklets
from driftline.runtime import written
from driftline.schema import POINT, POINT_COLUMNS, TRAJECTORY, LinkConfig


@dataclass(frozen=True)
class NightState:
    """What is kept between nights: trajectories that may still be extended, and alerts that may still be matched.

    ``next_id`` only grows, so an id never names two trajectories. ``archived`` holds the rows of trajectories that
    left with the last night, to be appended to an archive by its number: too old to be extended, or small and
    expired. So a night's work grows with the window, not with history.
    """

    trajectories: DataFrame
    old_alerts: DataFrame
    next_id: int = 0
    last_nid: int | None = None
    archived: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> NightState:
        return cls(spark.createDataFrame([], TRAJECTORY), spark.createDataFrame([], POINT))


def split_by_size(trajectories: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of trajectories of fewer than ``limit`` points, and of the others."""
    sizes = trajectories.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
    return trajectories.join(sizes, "trajectory_id", "left_anti"), trajectories.join(sizes, "trajectory_id", "left_semi")


def with_age(trajectories: DataFrame, next_nid: int) -> DataFrame:
    """Points and nights since the last one of each trajectory: ``trajectory_id, n, age``."""
    return trajectories.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n"), (F.lit(next_nid) - F.max_by("nid", F.struct("jd", "candid"))).alias("age"))


def evict(trajectories: DataFrame, old_alerts: DataFrame, next_nid: int, cfg: LinkConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows still to be extended, rows too old, rows of small trajectories that expired, and old alerts still young.

    A trajectory is too old once its last point is more than the window back. Trajectories of two points have a
    window of their own, those of one point none; when they expire they are neither extended nor kept, so they come
    out as a third part that callers may archive.
    """
    age = with_age(trajectories, next_nid)
    in_window = F.col("age") <= cfg.trajectory_window
    lively = (F.col("n") > 2) | ((F.col("n") == 2) & (F.col("age") <= cfg.two_point_window))

    def rows(which) -> DataFrame:
        return trajectories.join(age.where(which).select("trajectory_id"), "trajectory_id", "left_semi")

    young = old_alerts.where(F.lit(next_nid) - F.col("nid") <= cfg.observation_window)
    return rows(in_window & lively), rows(~in_window), rows(in_window & ~lively), young


def keep_last_only(trajectories: DataFrame, last_nid: int) -> tuple[DataFrame, DataFrame]:
    """After a gap longer than the window: trajectories of more than two points that end in the last night, and those that do not end there."""
    age = with_age(trajectories, last_nid)
    return (
        trajectories.join(age.where("age = 0 and n > 2").select("trajectory_id"), "trajectory_id", "left_semi"),
        trajectories.join(age.where("age <> 0").select("trajectory_id"), "trajectory_id", "left_semi"),
    )


def guard_night(last_nid: int | None, night: int) -> None:
    """Nights are taken in once and in order."""
    if last_nid is not None and night <= last_nid:
        raise ValueError(f"night {night} is not after night {last_nid}, the last one taken in")


def process_night(state: NightState, alerts: DataFrame, night: int, cfg: LinkConfig) -> NightState:
    """Take in one night: evict, find tracklets, extend trajectories by tracklets and by alerts, tracklets by old
    alerts, and pair what is left. Alerts matched by nothing become old alerts.

    Each of the four associations can be switched off. Tracklets long enough for an orbit are not extended. All
    associations choose from the pairs of one range join of the state with the night. What a trajectory had is never changed, so the rows afterwards are those before and what each pass adds; they are
    written to the shared folder once, and a replay's plans do not grow from night to night.
    """
    guard_night(state.last_nid, night)
    recent, old, expired, young = evict(state.trajectories, state.old_alerts, night, cfg)
    recent = written(recent, "recent").df
    fresh = written(alerts.select(*POINT_COLUMNS).dropDuplicates(["candid"]), "night").df
    found = written(tracklets(fresh, cfg, state.next_id)[0], "tracklets", top=F.max("trajectory_id"))
    next_id = state.next_id if found.seen["top"] is None else found.seen["top"] + 1
    tracks, long = split_by_size(found.df, cfg.orbit_points)
    left_old, left_new = young, fresh.join(found.df.select("candid"), "candid", "left_anti")
    parts, links = [recent, long], night_links(recent, young, tracks, left_new, night, cfg)
    pairs, used_tracks, extended = links.df, None, None
    if cfg.tracklets_to_trajectories and links.seen["rows"]:
        additions = tracks.select(F.col("trajectory_id").alias("key"), *POINT_COLUMNS)
        g = growth(recent, matches(pairs, "tk", "l", "r"), additions, "T", next_id)
        next_id += g.n_forks
        if g.n_pairs:
            parts.append(g.rows)
            used_tracks, extended = g.used.select(F.col("key").alias("r_id")), g.used.where("rk = 1").select(F.col("trajectory_id").alias("l_id"))
            tracks = tracks.join(used_tracks.withColumnRenamed("r_id", "trajectory_id"), "trajectory_id", "left_anti")
    if cfg.alerts_to_trajectories and links.seen["rows"]:
        still = pairs if extended is None else pairs.join(extended, "l_id", "left_anti")
        g = growth(recent, matches(still, "ta", "l", "r"), fresh.withColumn("key", F.col("candid")), "A", next_id)
        next_id += g.n_forks
        if g.n_pairs:
            parts.append(g.rows)
            left_new = left_new.join(g.used.select(F.col("key").alias("candid")), "candid", "left_anti")
            pairs = pairs.join(g.used.select(F.lit("a").alias("r_kind"), F.col("key").alias("r_id")), ["r_kind", "r_id"], "left_anti")
    parts.append(tracks)
    if cfg.old_alerts_to_tracklets and links.seen["rows"]:
        still = pairs if used_tracks is None else pairs.join(used_tracks, "r_id", "left_anti")
        g = growth(tracks, matches(still, "ok", "r", "l"), young.withColumn("key", F.col("candid")), "O", next_id)
        next_id += g.n_forks
        if g.n_pairs:
            parts.append(g.rows)
            left_old = young.join(g.used.select(F.col("key").alias("candid")), "candid", "left_anti")
            pairs = pairs.join(g.used.select(F.lit("o").alias("l_kind"), F.col("key").alias("l_id")), ["l_kind", "l_id"], "left_anti")
    if cfg.old_alerts_to_alerts and links.seen["rows"]:
        free = newest_night_only(pairs.where("l_kind = 'o' and r_kind = 'a'"), "r_id", F.col("gap"))
        made = written(numbered(free.select("gap", F.col("l_id").alias("old"), F.col("r_id").alias("new")), ["gap", "old", "new"], "trajectory_id", next_id), "pairs")
        next_id += made.seen["rows"]
        if made.seen["rows"]:
            for side, points in (("old", young), ("new", fresh)):
                parts.append(made.df.select("trajectory_id", F.col(side).alias("candid")).join(points, "candid").withColumn("assoc_tag", F.lit("N")))
            left_old = left_old.join(made.df.select(F.col("old").alias("candid")), "candid", "left_anti")
            left_new = left_new.join(made.df.select(F.col("new").alias("candid")), "candid", "left_anti")
    everything = reduce(DataFrame.unionByName, [part.select("trajectory_id", *POINT_COLUMNS, "assoc_tag") for part in parts])
    after = written(everything.withColumn("not_updated", F.lit(True)), "trajectories").df
    unmatched = written(left_old.select(*POINT_COLUMNS).unionByName(left_new.select(*POINT_COLUMNS)), "old-alerts").df
    left = old.unionByName(expired).select("trajectory_id", *POINT_COLUMNS, "assoc_tag")
    return NightState(after, unmatched, next_id, night, left)


def replay(alerts: DataFrame, nights: list[int], cfg: LinkConfig, state: NightState | None = None) -> NightState:
    """Nights one after another, each committed before the next; nights without alerts change nothing.

    What left on the way is archived in one, in the state returned.
    """
    state, left = state or NightState.empty(alerts.sparkSession), []
    for night in sorted(nights):
        batch = alerts.where(F.col("nid") == night)
        if not batch.isEmpty():
            state = process_night(state, batch, night, cfg)
            left.append(state.archived)
    return replace(state, archived=reduce(DataFrame.unionByName, left)) if left else state
