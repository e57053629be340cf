"""Command line: python -m driftline.cli COMMAND ... on a session given by spark-submit or a local one."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import metrics
from driftline.operators.nightly import process_night, split_by_size
from driftline.operators.orbit_fit import fit_orbits, merge_orbits
from driftline.runtime import within
from driftline.schema import ORBIT, LinkConfig, coerced
from driftline.session import local_session
from driftline.sources.alerts import night_scan, text_alerts
from driftline.sources.catalogue import bare_number, read_catalogue
from driftline.sources.state import StateStore, append_orbits, append_statistics, archive_night


#: Classes that the broker gives to alerts of moving objects.
OBJECTS = {"mpc": "Solar System MPC", "candidates": "Solar System candidate"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftline", description="Link single-night detections into moving objects.")
    p.add_argument("--output", required=True, help="folder of the state and the results")
    p.add_argument("--config", help="INI file with a section [link]")
    p.add_argument("--objects", choices=[*OBJECTS], help="known objects or candidates only, each with state and results of their own")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("associations", help="take in one night")
    one.add_argument("--alerts", help="landing folder of parquet")
    one.add_argument("--night", type=int, help="night to take in from the landing folder")
    one.add_argument("--filepath", help="whitespace text file instead of a landing folder")
    one.add_argument("-r", "--reset", action="store_true", help="forget all state first")
    one.add_argument("-y", "--yes", action="store_true", help="do not ask before forgetting")
    one.add_argument("-s", "--save", action="store_true", help="keep the alerts of the night in the archive")
    replay = sub.add_parser("offline", help="take in a range of nights, each committed before the next")
    replay.add_argument("--alerts", required=True)
    replay.add_argument("end", type=int)
    replay.add_argument("start", type=int, nargs="?")
    sub.add_parser("solve_orbit", help="fit long trajectories and move them to the orbit tables")
    sub.add_parser("merge_orbit", help="merge arcs of like orbits")
    stats = sub.add_parser("stats", help="report")
    stats.add_argument("--catalogue", help="published JSON of known objects")
    stats.add_argument("--names", help="parquet of alerts (candid, ssnamenr): recovery of known objects by class")
    return p


def _confirmed(question: str) -> bool:
    return input(f"{question} [y/n] ").strip().lower() in ("y", "yes")


def take_in(store: StateStore, alerts: DataFrame, night: int, cfg: LinkConfig, output: str) -> None:
    state = process_night(store.load(), alerts, night, cfg)
    store.save(state)
    found = state.trajectories.where(F.col("nid") == night).agg(F.count_distinct("trajectory_id").alias("t"), F.count(F.lit(1)).alias("n")).first()
    append_statistics(alerts.sparkSession, f"{output}/statistics", night, {"trajectories": found.t, "alerts_on_trajectories": found.n})


def solve(spark: SparkSession, store: StateStore, cfg: LinkConfig, output: str) -> DataFrame:
    """Fit trajectories of enough points; all of them, fitted or not, leave the state for the orbit tables.

    Rows go to the tables under the state's last night and highest id, so a retry replaces them.
    """
    state = store.load()
    small, long = split_by_size(state.trajectories, cfg.orbit_points)
    key = f"{state.last_nid}-{long.agg(F.max('trajectory_id')).first()[0]}"
    append_orbits(fit_orbits(long, cfg.orbit_points), f"{output}/orbits", key)
    append_orbits(long, f"{output}/orbit_points", key)
    store.save(replace(state, trajectories=small, archived=None))
    return spark.read.schema(ORBIT).parquet(f"{output}/orbits")


def recovered(known: DataFrame, names: DataFrame, points: DataFrame) -> DataFrame:
    """Known objects of each class, and how many have a trajectory with an orbit whose alerts are all theirs."""
    own = points.join(names.select("candid", "ssnamenr"), "candid").groupBy("trajectory_id").agg(F.count_distinct("ssnamenr").alias("k"), F.min("ssnamenr").alias("number"))
    found = own.where("k = 1").select("number").distinct().withColumn("found", F.lit(1))
    objects = known.select(bare_number("number").alias("number"), "orbit_type").where("number <> ''").distinct()
    per = objects.join(found, "number", "left").groupBy("orbit_type").agg(F.count(F.lit(1)).alias("n_known"), F.count("found").alias("n_found"))
    return per.withColumn("percent", F.round(F.col("n_found") * 100 / F.col("n_known"), 2))


def report(spark: SparkSession, store: StateStore, output: str, catalogue: str | None, names: str | None = None) -> dict[str, DataFrame]:
    state = store.load()
    sizes = state.trajectories.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("size"))
    out = {"sizes": sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size"), "associations": metrics.association_statistics(state.trajectories)}
    if not within(spark, f"{output}/orbits"):  # no orbit was solved yet
        return out
    orbits = spark.read.schema(ORBIT).parquet(f"{output}/orbits")
    good = orbits.where("a <> -1")
    out["elements"] = metrics.described(good, ["a", "e", "i", "chi_reduced"])
    out["types"] = good.groupBy(metrics.orbit_type(F.col("a"), F.col("e")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    out["best"] = metrics.orbit_scores(orbits).orderBy("score", "trajectory_id").limit(10)
    if catalogue:
        known = read_catalogue(spark, catalogue)
        out["known types"] = known.where(bare_number("number") != "").groupBy("orbit_type").agg(F.count(F.lit(1)).alias("n"))
        if names:
            out["recovered"] = recovered(known, spark.read.parquet(names), spark.read.parquet(f"{output}/orbit_points"))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.getActiveSession() or local_session()
    cfg = LinkConfig.from_file(a.config) if a.config else LinkConfig()
    if a.objects:
        a.output = f"{a.output}/{a.objects}"
    scan = {"only": OBJECTS.get(a.objects)}
    store = StateStore(spark, f"{a.output}/state")
    if a.command == "associations":
        if a.reset and (a.yes or _confirmed("Forget all trajectories and old alerts?")):
            store.reset(confirm=True)
        if a.filepath:
            alerts = text_alerts(spark, a.filepath)
            night = 0
        else:
            night, alerts = a.night, night_scan(spark, a.alerts, a.night, **scan)
        if a.save:
            archive_night(alerts, f"{a.output}/archive")
        take_in(store, alerts, night, cfg, a.output)
    elif a.command == "offline":
        wanted = F.col("nid") <= a.end
        if a.start is not None:
            wanted = wanted & (F.col("nid") >= a.start)
        last = store.load().last_nid
        if last is not None:
            wanted = wanted & (F.col("nid") > last)
        nights = [r.nid for r in spark.read.parquet(a.alerts).where(wanted).select("nid").distinct().orderBy("nid").collect()]  # nights, not rows
        for night in nights:
            take_in(store, night_scan(spark, a.alerts, night, **scan), night, cfg, a.output)
    elif a.command == "solve_orbit":
        solve(spark, store, cfg, a.output).groupBy((F.col("a") != -1).alias("fitted")).count().show()
    elif a.command == "merge_orbit":
        orbits, points = spark.read.schema(ORBIT).parquet(f"{a.output}/orbits"), spark.read.parquet(f"{a.output}/orbit_points")
        merge_orbits(orbits, points).write.mode("overwrite").parquet(f"{a.output}/merged_orbits")
    else:
        for name, df in report(spark, store, a.output, a.catalogue, a.names).items():
            print(name)
            df.show(50, truncate=False)


if __name__ == "__main__":
    main()
