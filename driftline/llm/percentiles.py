"""Percentiles per group from group-value counts, exact up to a stated rounding and combinable over parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.runtime import written

#: Values of more bins than this are kept as they are: doubles of that size differ by little less than a bin.
EXACT_FROM = float(1 << 40)


def summarise(df: DataFrame, groups: list[str], value: str, bins_per_unit: int = 10_000) -> DataFrame:
    """Counts of rounded values per group: ``groups, bin, n``. Combine parts with :func:`combine`.

    ``bin`` is the value rounded to a multiple of ``1 / bins_per_unit``, so the error of anything read from the
    summary is at most ``0.5 / bins_per_unit`` and its size is bounded by the range of the values, not by the rows.
    Values too large to be rounded so are kept exactly, infinities among them. Counts are combined before the
    shuffle. Null and NaN are no values. Null groups are groups.
    """
    v = F.col(value).cast("double")
    bins = F.lit(float(bins_per_unit))
    binned = F.when(F.abs(v * bins) < F.lit(EXACT_FROM), F.round(v * bins) / bins).otherwise(v)
    values = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*groups, binned.alias("bin"))
    return values.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"))


def combine(summaries: list[DataFrame], groups: list[str]) -> DataFrame:
    """One summary from several (of nights, days or files), or a coarser one from one by naming fewer groups."""
    return reduce(DataFrame.unionByName, summaries).groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def keep(summary: DataFrame, folder: str, part: str) -> None:
    """Store the summary of one part (a day, a file) in a folder of summaries; storing a part again replaces it."""
    summary.write.mode("overwrite").parquet(f"{folder}/part={part}")


def kept(spark: SparkSession, folder: str, parts: list[str]) -> list[DataFrame]:
    """Stored summaries of some parts, to be combined."""
    return [spark.read.parquet(f"{folder}/part={part}") for part in parts]


def percentiles(summary: DataFrame, groups: list[str], permille: list[int], bins_per_unit: int = 10_000, partitions: int | None = None) -> DataFrame:
    """Percentiles of a summary: ``groups, permille, n_values, value, max_error``.

    The percentile q is the first value whose cumulative frequency reaches ``ceil(q n / 1000)`` (at least 1), as
    SQL's ``percentile_disc``. The counts are sorted by range over (groups, bin), so one large group spreads over
    many partitions; running sums are taken within a partition and raised by the sums of the partitions before it.
    Groups without values give no rows.
    """
    spark = summary.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = summary.repartitionByRange(parts, *groups, "bin").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged").df  # the partition numbers are now data and stay as they are
    totals = ranged.groupBy(*groups, "part").agg(F.sum("n").alias("part_n"))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"of_{g}") for g in groups],
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("offset"),
        F.sum("part_n").over(by_group).alias("n_values"),
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups], F.col("part") == F.col("of_part"))
    within = Window.partitionBy("part", *groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("n").over(within)).join(offsets, same).withColumn("upto", F.col("upto") + F.col("offset"))

    def reached(q: Column) -> Column:
        rank = F.greatest(F.lit(1), F.floor((q * F.col("n_values") + F.lit(999)) / F.lit(1000)))
        return (F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto"))

    # A row can be a percentile only where the share reached, in permille, grows with it (or for 0, in the first row).
    steps = [F.floor(x * F.lit(1000) / F.col("n_values")) for x in (F.col("upto") - F.col("n"), F.col("upto"))]
    running = running.where((steps[0] < steps[1]) | (F.col("upto") == F.col("n")))
    wanted = F.array(*[F.lit(q).cast("long") for q in permille])
    return running.withColumn("permille", F.explode(F.filter(wanted, reached))).select(
        *groups, F.col("permille").cast("int").alias("permille"), "n_values", F.col("bin").alias("value"), F.lit(0.5 / bins_per_unit).alias("max_error")
    )
