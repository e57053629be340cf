"""Motion and brightness of objects along their observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.sky import lit, planar_angle, position_angle, separation
from driftline.operators.metrics import reduced_chi


def _order(label: str) -> Window:
    return Window.partitionBy(label).orderBy("jd", "candid")


def steps(points: DataFrame, label: str) -> DataFrame:
    """Each observation with the one before it: days, separation, direction."""
    w = _order(label)
    back = {f"{c}0": F.lag(c).over(w) for c in ("ra", "dec", "jd", "nid")}
    rows = points.withColumns(back).where(F.col("jd0").isNotNull())
    return rows.withColumns({"days": F.col("jd") - F.col("jd0"), "sep_deg": separation("ra0", "dec0", "ra", "dec")})


def speeds(points: DataFrame, label: str, floor_days: float | None = 1.0) -> DataFrame:
    """Degrees per day between successive observations; with a floor, steps under it count as that long."""
    days = F.greatest(F.col("days"), lit(floor_days)) if floor_days else F.nullif(F.col("days"), lit(0))
    return steps(points, label).select(label, "candid", (F.col("sep_deg") / days).alias("speed"))


def intra_separations(points: DataFrame, label: str) -> DataFrame:
    """Arcseconds between successive observations of one night."""
    return steps(points, label).where("nid = nid0").select(label, "candid", (F.col("sep_deg") * 3600).alias("sep_arcsec"))


def magnitude_rates(points: DataFrame, label: str, floor_days: float = 1.0, within_days: float = 15.0) -> DataFrame:
    """Magnitudes per day between successive observations in one filter, for gaps below ``within_days``."""
    w = Window.partitionBy(label, "fid").orderBy("jd", "candid")
    days = F.greatest(F.col("jd") - F.lag("jd").over(w), lit(floor_days))
    rows = points.withColumn("days", days).withColumn("change", F.abs(F.col("magpsf") - F.lag("magpsf").over(w)))
    return rows.where(F.col("change").isNotNull() & (F.col("days") < within_days)).select(label, "candid", "fid", (F.col("change") / F.col("days")).alias("mag_rate"))


def colours(points: DataFrame, label: str) -> DataFrame:
    """Difference of the mean magnitudes in g and r; null without both."""
    g, r = (F.avg(F.when(F.col("fid") == n, F.col("magpsf"))) for n in (1, 2))
    return points.groupBy(label).agg((g - r).alias("colour"))


def turning_angles(points: DataFrame, label: str) -> DataFrame:
    """Planar angle at the first of three successive observations, per day with a floor of one day between the last two."""
    w = _order(label)
    back = {f"{c}{k}": F.lag(c, k).over(w) for c in ("ra", "dec", "jd") for k in (1, 2)}
    rows = points.withColumns(back).where(F.col("jd2").isNotNull())
    angle = planar_angle("ra2", "dec2", "ra1", "dec1", "ra", "dec")
    return rows.select(label, "candid", (angle / F.greatest(F.col("jd") - F.col("jd1"), lit(1))).alias("angle")).where(F.col("angle").isNotNull() & ~F.isnan("angle"))


def direction_rates(points: DataFrame, label: str) -> DataFrame:
    """Position angle of each step per day, for steps that take time and cover ground."""
    angle = position_angle("ra0", "dec0", "ra", "dec")
    return steps(points, label).where("days > 0 and sep_deg > 0").select(label, "candid", (angle / F.col("days")).alias("direction_rate"))


def tracklet_gaps(points: DataFrame, label: str) -> DataFrame:
    """From the last point of a night's tracklet to the first of the next: nights 1 and 2, 3 and 4, and so on.

    A tracklet is two observations or more in one night; a last one without partner is left out.
    """
    first, last = (f(F.struct("ra", "dec", "jd", "magpsf"), F.struct("jd", "candid")) for f in (F.min_by, F.max_by))
    night = points.groupBy(label, "nid").agg(F.count(F.lit(1)).alias("n"), first.alias("first"), last.alias("last")).where("n >= 2")
    w = Window.partitionBy(label).orderBy("nid")
    rows = night.withColumn("place", F.row_number().over(w)).withColumns({"next": F.lead("first").over(w), "next_nid": F.lead("nid").over(w)})
    rows = rows.where("place % 2 = 1 and next is not null")
    sep = separation("last.ra", "last.dec", "next.ra", "next.dec")
    return rows.select(label, "nid", "next_nid", sep.alias("sep_deg"), F.abs(F.col("next.magpsf") - F.col("last.magpsf")).alias("mag_change"))


def motion_fit(points: DataFrame, label: str) -> DataFrame:
    """Linear fit of declination over time per object: slope and sum of squared residuals."""
    sums = points.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("dec", "jd").alias("slope"),
        F.regr_sxx("dec", "jd").alias("sxx"), F.regr_sxy("dec", "jd").alias("sxy"), F.regr_syy("dec", "jd").alias("syy"),
    )
    return sums.where("n >= 3 and sxx > 0").select(label, "n", "slope", F.greatest(lit(0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).alias("residual"))


def motion_changes(points: DataFrame, label: str) -> DataFrame:
    """Mean speed of each object (degrees per day over all its steps that take time) and mean change of speed per day."""
    w = _order(label)
    rows = steps(points, label).where("days > 0").withColumn("speed", F.col("sep_deg") / F.col("days"))
    rows = rows.withColumn("change", (F.col("speed") - F.lag("speed").over(w)) / F.nullif(F.col("jd") - F.lag("jd").over(w), lit(0)))
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_steps"), F.avg("speed").alias("mean_speed"), F.avg("change").alias("mean_acceleration"))


def quantile_of_cdf(cdf: DataFrame, width: float, of: list[float]) -> DataFrame:
    """Values at which the cumulative shares of a :func:`histogram` reach given shares, interpolated in their bin: ``q, value``."""
    whole = Window.partitionBy(F.lit(0)).orderBy("bin")  # as many rows as bins
    rows = cdf.withColumn("below", F.coalesce(F.lag("cdf").over(whole), lit(0)))
    rows = rows.withColumn("q", F.explode(F.array(*[lit(q) for q in of]))).where((F.col("below") < F.col("q")) & (F.col("q") <= F.col("cdf")))
    return rows.select("q", (F.col("low") + lit(width) * (F.col("q") - F.col("below")) / (F.col("cdf") - F.col("below"))).alias("value"))


def histogram(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and cumulative shares over equal bins of [low, high]; values outside are in the first or last bin."""
    v = F.col(value)
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - lit(low)) / lit((high - low) / bins)))).cast("int")
    counts = values.where(v.isNotNull() & ~F.isnan(v)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # as many rows as bins
    share = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole)
    return counts.withColumns({"low": lit(low) + F.col("bin") * lit((high - low) / bins), "cdf": share})


def extended_table(points: DataFrame, label: str) -> DataFrame:
    """One row per trajectory: points, last time, arc in days, range of magnitudes in g and r."""

    def ends(fid: int) -> list[Column]:
        mag = F.when(F.col("fid") == fid, F.col("magpsf"))
        return [F.min(mag).alias(f"min_mag_{fid}"), F.max(mag).alias(f"max_mag_{fid}")]

    return points.groupBy(label).agg(F.count(F.lit(1)).alias("n_points"), F.max("jd").alias("last_jd"), (F.max("jd") - F.min("jd")).alias("arc_days"), *ends(1), *ends(2))


def scaled(points: DataFrame, label: str, value: str) -> DataFrame:
    """Values of each object scaled to [0, 1] by its range; null for objects of one value."""
    w = Window.partitionBy(label)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return points.withColumn("scaled", (F.col(value) - low) / F.nullif(high - low, lit(0)))


def robustly_scaled(points: DataFrame, label: str, value: str) -> DataFrame:
    """Values of each object less its median, by its range between quartiles; null where that is 0."""
    q1, median, q3 = (F.percentile(value, lit(q)) for q in (0.25, 0.5, 0.75))
    per = points.groupBy(label).agg(median.alias("_median"), (q3 - q1).alias("_range"))
    return points.join(per, label).withColumn("scaled", (F.col(value) - F.col("_median")) / F.nullif(F.col("_range"), lit(0))).drop("_median", "_range")


def chi_of_constant(points: DataFrame, label: str, value: str, sigma: str) -> DataFrame:
    """Mean of the distances of an object's values from their mean, in units of their errors: null where an error is missing."""
    chi = F.transform("_v", lambda v: F.when(v["s"] > 0, F.abs(v["x"] - F.col("_mean")) / v["s"]).otherwise(lit(-1)))
    per = points.groupBy(label).agg(F.avg(value).alias("_mean"), F.collect_list(F.struct(F.col(value).alias("x"), F.col(sigma).alias("s"))).alias("_v"))
    return per.select(label, reduced_chi(chi).alias("chi"))
