"""Neighbours in order, counts and quantiles of groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.runtime import written


def with_previous(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``previous``: ``columns`` of the row before by (jd, candid) under the same key, null for the first.

    Rows are ordered within days; the first row of a day takes the last of the key's day before. So a key is spread
    over its days and no task orders all rows of a hot one. Rows with a null key or jd are left out.
    """
    rows = df.where(F.col(key).isNotNull() & F.col("jd").isNotNull()).withColumn("_day", F.floor("jd"))
    item = F.struct(*columns)
    lasts = rows.groupBy(key, "_day").agg(F.max_by(item, F.struct("jd", "candid")).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))  # a row per day
    lasts = lasts.select(key, "_day", before.alias("_before"))
    within = Window.partitionBy(key, "_day").orderBy("jd", "candid")
    ordered = rows.withColumns({"_inner": F.lag(item).over(within), "_place": F.row_number().over(within)}).join(lasts, [key, "_day"])
    return ordered.withColumn("previous", F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_inner"))).drop("_day", "_before", "_inner", "_place")


def with_group_count(df: DataFrame, key: str, name: str, share: float = 0.001) -> DataFrame:
    """Rows with the number of rows of their key, which are counted map-side and joined back.

    Keys holding more than ``share`` of the rows, at most ``1 / share``, are joined by broadcast, so no task gets all
    rows of one. Rows with a null key are left out.
    """
    rows = df.where(F.col(key).isNotNull())
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), "group-counts", total=F.sum(name))
    heavy = F.col(name) > F.lit((counts.seen["total"] or 0) * share)
    marked = rows.join(F.broadcast(counts.df.where(heavy)), key, "left")
    light = marked.where(F.col(name).isNull()).drop(name).join(counts.df.where(~heavy), key)
    return marked.where(F.col(name).isNotNull()).unionByName(light)


def quantiles(df: DataFrame, group: str, value: str, of: list[float]) -> DataFrame:
    """Interpolated quantiles of each group, as SQL's ``percentile_cont``: ``group, q, quantile``.

    Values are counted, the counts sorted by range over (group, value), and running sums raised by those of the
    partitions before, so one large group spreads over many tasks. Null and NaN are no values.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counts.repartitionByRange("g", "x").withColumn("part", F.spark_partition_id()), "quantiles").df
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("here"))  # a row per group and partition
    by_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("here").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("g", "part", before.alias("before"), F.sum("here").over(by_group).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    rows = ranged.join(sums, ["g", "part"]).withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), place(q).alias("at")) for q in of])
    inside = lambda at: (F.col("from") <= at) & (at < F.col("upto"))
    met = rows.select("g", "x", "from", "upto", F.explode(F.filter(wanted, lambda w: inside(F.floor(w["at"])) | inside(F.ceil(w["at"])))).alias("w"))
    low, high = (F.max(F.when(inside(f(F.col("w.at"))), F.col("x"))) for f in (F.floor, F.ceil))
    found = met.groupBy("g", F.col("w.q").alias("q"), F.col("w.at").alias("at")).agg(low.alias("low"), high.alias("high"))
    share = F.col("at") - F.floor("at")
    exact = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share)
    return found.select(F.col("g").alias(group), "q", exact.alias("quantile"))
