"""Tracklets: alerts of one night that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.graph import cluster_labels, numbered, path_labels
from driftline.operators.pairs import intra_night_pairs, magnitude_pairs, successors
from driftline.schema import LinkConfig


def tracklet_links(alerts: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Pairs (structs ``l``, ``r``) that chain the alerts of a night: close, alike in magnitude, the next in time."""
    pairs = intra_night_pairs(alerts, cfg.intra_separation_arcsec)
    return successors(magnitude_pairs(pairs, cfg.intra_mag_same, cfg.intra_mag_diff))


def chained_tracklets(alerts: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Alerts of chains with the first candid of their chain: ``candid, head``."""
    links = tracklet_links(alerts, cfg).select(F.col("l.candid").alias("u"), F.col("r.candid").alias("v"))
    return path_labels(links).select(F.col("node").alias("candid"), "head")


def dense_tracklets(alerts: DataFrame, separation_arcsec: float) -> DataFrame:
    """Density clusters of at least two alerts of a night: ``candid, head``, the smallest candid of the cluster.

    With a minimum of two points every point with a neighbour is a core point, so clusters are the connected
    groups of the graph of close pairs. Clusters with two alerts of one time are no tracklet and are left out.
    """
    pairs = intra_night_pairs(alerts, separation_arcsec).where("l.candid < r.candid")
    labels = cluster_labels(pairs.select(F.col("l.candid").alias("u"), F.col("r.candid").alias("v")))
    times = labels.join(alerts.select(F.col("candid").alias("node"), "jd"), "node")
    good = times.groupBy("cluster").agg((F.count("jd") == F.count_distinct("jd")).alias("good")).where("good")
    return labels.join(good, "cluster", "left_semi").select(F.col("node").alias("candid"), F.col("cluster").alias("head"))


def tracklets(alerts: DataFrame, cfg: LinkConfig, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the tracklets of new alerts, numbered from ``first_id`` by their head, and the alerts left over."""
    found = dense_tracklets(alerts, cfg.intra_separation_arcsec) if cfg.use_density else chained_tracklets(alerts, cfg)
    heads = numbered(found.select("head").distinct(), ["head"], "trajectory_id", first_id)
    rows = alerts.join(found, "candid").join(heads, "head").drop("head").withColumn("assoc_tag", F.lit("I"))
    return rows, alerts.join(found, "candid", "left_anti")
