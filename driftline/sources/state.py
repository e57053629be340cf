"""Versioned state between nights, appended orbit tables, the alert archive and run statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.nightly import NightState
from driftline.runtime import drop_path, latest, publish, within
from driftline.schema import POINT, TRAJECTORY

ARCHIVED = f"trajectory_id bigint, {POINT}, assoc_tag string"


class StateStore:
    """State under a path: each save goes to a new folder, and a record, replaced as a whole, names it; readers never
    see half a state, and a crash leaves the former one. The version before the last stays for those who read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> NightState:
        """The last state saved; an empty one before the first."""
        now = latest(self.spark, f"{self.path}/records")
        if not now:
            return NightState.empty(self.spark)
        base = f"{self.path}/{now['version']}"
        return NightState(
            self.spark.read.schema(TRAJECTORY).parquet(f"{base}/trajectories"),
            self.spark.read.schema(POINT).parquet(f"{base}/old_alerts"),
            now["next_id"],
            now["last_nid"],
        )

    def save(self, state: NightState) -> None:
        """Save a state; what left with its night goes to the archive under that night, replacing it on a retry."""
        before = latest(self.spark, f"{self.path}/records") or {}
        version = f"v-{uuid.uuid4().hex}"
        state.trajectories.write.parquet(f"{self.path}/{version}/trajectories")
        state.old_alerts.write.parquet(f"{self.path}/{version}/old_alerts")
        if state.archived is not None:
            state.archived.write.mode("overwrite").parquet(f"{self.path}/archive/until_nid={state.last_nid}")
        publish(self.spark, f"{self.path}/records", {"version": version, "next_id": state.next_id, "last_nid": state.last_nid})
        for path in within(self.spark, self.path):
            if path.split("/")[-1].startswith("v-") and path.split("/")[-1] not in (version, before.get("version")):
                drop_path(self.spark, path)

    def archive(self) -> DataFrame:
        """Rows of trajectories that left the state, with the night they left at."""
        if not within(self.spark, f"{self.path}/archive"):
            return self.spark.createDataFrame([], f"{ARCHIVED}, until_nid int")
        return self.spark.read.schema(f"{ARCHIVED}, until_nid int").parquet(f"{self.path}/archive")

    def reset(self, confirm: bool = False) -> None:
        """Forget everything; nothing happens without ``confirm``."""
        if confirm:
            drop_path(self.spark, self.path)


def append_orbits(orbits: DataFrame, path: str, key: str | int) -> None:
    """Rows of one run under its ``key``; the same run again replaces them instead of doubling them."""
    orbits.write.mode("overwrite").parquet(f"{path}/run={key}")


def archive_night(alerts: DataFrame, path: str) -> None:
    """Alerts of a night as a partition of their own, replacing that night only."""
    alerts.withColumn("night", F.col("nid")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("night").parquet(path)


def write_archive(alerts: DataFrame, path: str) -> None:
    """Alerts by year and month of their night, so that scans of months read those months only."""
    dated = alerts.withColumns({"year": F.floor(F.col("obs_month") / 100).cast("int"), "month": F.col("obs_month") % 100})
    dated.repartition("year", "month", F.pmod(F.xxhash64("candid"), F.lit(32))).write.mode("append").partitionBy("year", "month").parquet(path)


def append_statistics(spark: SparkSession, path: str, night: int, figures: dict[str, float]) -> None:
    """Figures of a run as JSON lines, keyed by night; the last line of a night counts."""
    rows = [(night, k, float(v)) for k, v in figures.items()]
    spark.createDataFrame(rows, "nid int, figure string, value double").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("nid int, figure string, value double, at timestamp").json(path)
    return rows.groupBy("nid", "figure").agg(F.max_by("value", "at").alias("value"))
