"""Quality figures of associations, trajectories and orbits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.sky import lit
from driftline.operators.ordered import quantiles, with_previous


def pair_metrics(real: DataFrame, detected: DataFrame) -> DataFrame:
    """One row with true and false positives, false negatives, precision and recall in percent, of pairs ``a, b``.

    Percentages are 0 where there is nothing to divide by. Repeated pairs count once.
    """
    both = real.select("a", "b").distinct().withColumn("real", F.lit(True)).join(detected.select("a", "b").distinct().withColumn("found", F.lit(True)), ["a", "b"], "full_outer")
    counts = both.agg(
        F.count_if(F.col("real") & F.col("found")).alias("true_positive"),
        F.count_if(F.col("real").isNull()).alias("false_positive"),
        F.count_if(F.col("found").isNull()).alias("false_negative"),
    )

    def percent(of: str) -> Column:
        total = F.col("true_positive") + F.col(of)
        return F.when(total > 0, F.col("true_positive") * lit(100) / total).otherwise(lit(0))

    return counts.withColumns({"precision": percent("false_positive"), "recall": percent("false_negative"), "n_real": F.col("true_positive") + F.col("false_negative")})


def consecutive_pairs(alerts: DataFrame, label: str) -> DataFrame:
    """Neighbouring alerts in time of each object: the true pairs ``a, b``."""
    pairs = with_previous(alerts.select(label, "jd", "candid"), label, ["candid"]).where(F.col("previous").isNotNull())
    return pairs.select(F.col("previous.candid").alias("a"), F.col("candid").alias("b"))


def seeding_purity(points: DataFrame, label: str = "ssnamenr", cluster: str = "trajectory_id") -> DataFrame:
    """Percent of recoverable objects (two points or more) that have a cluster of their points alone, all of them."""
    sizes = points.groupBy(label).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    clusters = points.groupBy(cluster).agg(F.count_distinct(label).alias("labels"), F.min(label).alias(label), F.count(F.lit(1)).alias("size"))
    pure = clusters.where("labels = 1").select(label, "size").distinct().withColumn("pure", F.lit(True))
    found = sizes.join(pure, [label, "size"], "left").agg(F.count("pure").alias("n_pure"), F.count(F.lit(1)).alias("n_recoverable"))
    return found.withColumn("purity", F.when(F.col("n_recoverable") > 0, F.col("n_pure") * lit(100) / F.col("n_recoverable")).otherwise(lit(0)))


def seeding_completeness(points: DataFrame, label: str = "ssnamenr", cluster: str = "trajectory_id") -> DataFrame:
    """Percent of recoverable objects whose points all lie in one cluster that is not noise (-1)."""
    objects = points.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("clusters"), F.min(cluster).alias("first")).where("n > 1")
    whole = F.count_if((F.col("clusters") == 1) & (F.col("first") != -1))
    found = objects.agg(whole.alias("n_complete"), F.count(F.lit(1)).alias("n_recoverable"))
    return found.withColumn("completeness", F.when(F.col("n_recoverable") > 0, F.col("n_complete") * lit(100) / F.col("n_recoverable")).otherwise(lit(0)))


def association_statistics(trajectories: DataFrame) -> DataFrame:
    """How trajectories begin (tracklet, pair, old alert, tracklet alone), and the mean A and T points of long ones."""
    tag = F.col("assoc_tag")
    per = trajectories.where(tag.isNotNull()).groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(tag == "A").alias("a"), F.count_if(tag == "T").alias("t"),
        F.count_if(tag == "O").alias("o"), F.count_if(tag == "I").alias("i"), F.min_by(tag, F.struct("jd", "candid")).alias("first"),
    )
    start = F.when(F.col("i") == F.col("n"), 3).when(F.col("o") > 0, 2).when(F.col("first") == "I", 0).when(F.col("first") == "N", 1)
    per = per.withColumn("start", start)
    long = F.col("start").isin(0, 1) | ((F.col("start") == 2) & (F.col("n") > 3))
    return per.agg(
        F.count_if(F.col("start") == 3).alias("n_tracklets"), F.count_if(F.col("start") == 0).alias("n_from_tracklet"),
        F.count_if(F.col("start") == 1).alias("n_from_pair"), F.count_if(F.col("start") == 2).alias("n_from_old"),
        F.avg(F.when(long, F.col("a"))).alias("mean_alerts_added"), F.avg(F.when(long, F.col("t"))).alias("mean_tracklet_alerts_added"),
    )


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: count, mean, deviation, quartiles, and bias-corrected skewness and kurtosis; NaN is no value."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    stacked = stacked.where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, skew, kurt = F.col("n"), F.col("_skew"), F.col("_kurt")
    rows = stacked.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("std"), F.min("x").alias("low"),
        F.max("x").alias("high"), F.skewness("x").alias("_skew"), F.kurtosis("x").alias("_kurt"),
    )
    read = quantiles(stacked, "column", "x", [0.25, 0.5, 0.75])
    quarters = [F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    rows = rows.join(read.groupBy("column").agg(*quarters), "column")  # a row per column
    fair_skew = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))
    fair_kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
    rows = rows.withColumns({"skew": fair_skew, "kurtosis": fair_kurt})
    return rows.select("column", "n", "mean", "std", "low", "q1", "median", "q3", "high", "skew", "kurtosis")


def orbit_type(a: Column, e: Column) -> Column:
    return (
        F.when((a >= 1.7) & (a <= 4.5), "main belt").when(a > 4.5, "distant")
        .when((a < 1.7) & (e > 0.1), "earth crosser").otherwise("inner")
    )


def class_label(path: Column) -> Column:
    """Short class of a hierarchy written ``MB>Outer``: belts by their first word, near-Earth and special classes by the second."""
    part = F.split(path, ">")
    first, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    return F.when((first == "MB") & second.isin("Middle", "Outer", "Inner"), first).when(first.isin("MB", "NEA"), F.coalesce(second, first)).otherwise(first)


def reduced_chi(residuals: Column) -> Column:
    """Mean of an array of residuals; null for an empty one or where a residual is missing (-1)."""
    total = F.aggregate(residuals, lit(0), lambda x, y: x + y)
    return F.when((F.size(residuals) > 0) & ~F.exists(residuals, lambda x: x == -1), total / F.nullif(F.size(residuals), F.lit(0)))


def efficiency(named: DataFrame, detectable_objects: DataFrame, label: str) -> DataFrame:
    """One row: detectable objects, trajectories, pure ones, objects with a pure trajectory, and percentages.

    ``named`` has ``trajectory_id, names, label`` per trajectory: the number of different labels on it and one of them.
    """
    per = named.select("trajectory_id", (F.col("names") == 1).alias("pure"), F.when(F.col("names") == 1, F.col(label)).alias(label))
    found = per.where("pure").select(label).distinct().withColumn("found", F.lit(True))
    objects = detectable_objects.select(label).distinct().join(found, label, "left")
    rows = objects.select(F.lit(1).alias("detectable"), F.when(F.col("found"), 1).otherwise(0).alias("unique"), F.lit(0).alias("trajectories"), F.lit(0).alias("pure"))
    rows = rows.unionByName(per.select(F.lit(0).alias("detectable"), F.lit(0).alias("unique"), F.lit(1).alias("trajectories"), F.col("pure").cast("int").alias("pure")))
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("detectable", "unique", "trajectories", "pure")])

    def percent(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) * lit(100) / F.col(b)).otherwise(lit(0))

    return sums.withColumns({"purity": percent("n_pure", "n_trajectories"), "efficiency": percent("n_unique", "n_detectable")})


#: Mean errors of the elements of orbits fitted to known objects.
USUAL_RMS = {"rms_a": 0.018712, "rms_e": 0.009554, "rms_i": 0.170369, "rms_long_node": 0.383595, "rms_arg_peric": 4.314636, "rms_mean_anomaly": 3.791175}


def orbit_scores(orbits: DataFrame) -> DataFrame:
    """Fitted orbits with the distance of their errors from the usual ones, that of chi from 1, and both together."""
    good = orbits.where((F.col("a") != -1) & F.col("a").isNotNull() & (F.col("rms_a") != -1) & F.col("chi_reduced").isNotNull())
    square = sum((F.pow(F.col(c) - lit(v), lit(2)) for c, v in USUAL_RMS.items()), lit(0))
    scored = good.withColumns({"rms_distance": F.sqrt(square), "chi_distance": F.abs(F.col("chi_reduced") - 1)})
    return scored.withColumn("score", F.sqrt(F.pow("rms_distance", lit(2)) + F.pow("chi_distance", lit(2))))


def residuals(orbits: DataFrame, known: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """Relative differences of fitted elements to known ones, per ``key``; null where the known one is 0."""
    joined = orbits.alias("o").join(known.alias("k"), key)
    return joined.select(key, *[(F.abs(F.col(f"k.{k}") - F.col(f"o.{o}")) / F.nullif(F.col(f"k.{k}"), lit(0))).alias(f"res_{o}") for o, k in pairs.items()])


def nights_of(points: DataFrame, label: str) -> DataFrame:
    """Gaps between successive observations of each object: ``label, jd, candid, nid, gap``, null at the first one."""
    rows = with_previous(points.select(label, "jd", "candid", "nid"), label, ["nid"])
    return rows.select(label, "jd", "candid", "nid", (F.col("nid") - F.col("previous.nid")).alias("gap"))


def detectable(points: DataFrame, label: str, least: int, window: int, strict: bool = False) -> DataFrame:
    """Objects with at least ``least`` points and no gap above ``window`` nights (or, strictly, none reaching it)."""
    gap = F.col("gap") < window if strict else F.col("gap") <= window
    per = nights_of(points, label).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.every(gap), F.lit(True)).alias("steady"))
    return per.where((F.col("n") >= least) & F.col("steady")).select(label, "n")


def run_detectable(points: DataFrame, label: str, window: int, least: int) -> DataFrame:
    """Objects with a run of short gaps between nights, twice as long as ``least`` points at least.

    Gaps above the window break runs; so does a short gap between two long ones.
    """
    nights = points.select(label, "nid").distinct()
    order = Window.partitionBy(label).orderBy("nid")
    gaps = nights.withColumn("gap", F.col("nid") - F.lag("nid").over(order)).where("gap is not null")
    long = F.col("gap") > window
    alone = F.coalesce(F.lag("long").over(order), F.lit(False)) & F.coalesce(F.lead("long").over(order), F.lit(False))
    marked = gaps.withColumn("long", long).withColumn("masked", F.col("long") | alone)
    runs = marked.withColumn("run", F.count_if("masked").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("masked"))
    longest = runs.groupBy(label, "run").agg(F.count(F.lit(1)).alias("_length")).groupBy(label).agg(F.max("_length").alias("longest"))
    return longest.where(F.col("longest") * 2 >= least).select(label, F.col("longest").cast("long").alias("longest"))


def _gap_rows(points: DataFrame, label: str, least: int) -> DataFrame:
    """Zero gaps (two observations of one night) with the nights before them, of objects with enough points."""
    order = Window.partitionBy(label).orderBy("jd", "candid")
    gaps = nights_of(points, label).withColumns({"after": F.lead("gap").over(order), "place": F.row_number().over(order)}).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(label)))
    return gaps.where((F.col("gap") == 0) & (F.col("size") >= least))


def paired_nights(points: DataFrame, label: str, least: int = 5, within: int = 14) -> DataFrame:
    """Objects seen twice in a night and again twice within ``within`` nights: successive same-night pairs suffice."""
    order = Window.partitionBy(label).orderBy("jd", "candid")
    pairs = _gap_rows(points, label, least).withColumn("apart", F.col("nid") - F.lag("nid").over(order))
    return pairs.where(F.col("apart") <= within).select(label).distinct()


def followed_nights(points: DataFrame, label: str, least: int = 6, within: int = 14, follow: int = 3) -> DataFrame:
    """Like :func:`paired_nights`, where each same-night pair is followed by another observation within ``follow`` nights.

    The gap between two pairs counts from the night of the observation after the first.
    """
    order = Window.partitionBy(label).orderBy("jd", "candid")
    pairs = _gap_rows(points, label, least).where(F.col("after") <= follow)
    apart = pairs.select(
        label, (F.col("nid") - F.lag("nid", 1).over(order)).alias("nights1"), (F.col("nid") - F.lag("nid", 2).over(order)).alias("nights2"),
        (F.col("place") - F.lag("place", 1).over(order)).alias("places1"),
    )  # the pair before may share an observation with this one; the one before that cannot
    near = ((F.col("places1") >= 2) & (F.col("nights1") <= within)) | (F.col("nights2") <= within)
    return apart.where(near).select(label).distinct()
