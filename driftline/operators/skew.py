"""Distinct counts per key when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.runtime import written


def heavy_keys(df: DataFrame, key: str, share: float, rows_per_salt: int) -> DataFrame:
    """Keys that hold more than ``share`` of all rows and more than ``rows_per_salt``, with their row counts.

    There can be at most ``1 / share`` of them, which bounds what may be broadcast. Rows are read once, for the
    counts by key; their sum is taken while those are written.
    """
    counts = df.groupBy(F.col(key).alias("heavy_key")).agg(F.count(F.lit(1)).alias("heavy_rows"))
    counts = written(counts, "key-counts", total=F.sum("heavy_rows"))
    return counts.df.where(F.col("heavy_rows") > F.lit(max(float(rows_per_salt), (counts.seen["total"] or 0) * share)))


def with_salt(df: DataFrame, key: str, item: str, share: float, rows_per_salt: int) -> DataFrame:
    """Add ``salt``: 0 for light keys, else one of ``ceil(rows of the key / rows_per_salt)`` values.

    The salt is a hash of ``item``, as good as random over items but the same for all copies of one,
    so counts of distinct items per salt may be added up.
    """
    heavy = F.broadcast(heavy_keys(df, key, share, rows_per_salt))  # at most 1 / share rows
    salts = F.ceil(F.col("heavy_rows") / F.lit(rows_per_salt))
    salt = F.when(F.col("heavy_rows").isNull(), 0).otherwise(F.pmod(F.coalesce(F.xxhash64(item), F.lit(0)), salts))
    return df.join(heavy, F.col(key) == F.col("heavy_key"), "left").withColumn("salt", salt.cast("int")).drop("heavy_key", "heavy_rows")


def salted_distinct(
    df: DataFrame, key: str, part: str, item: str, stored: str, share: float = 0.001, rows_per_salt: int = 100_000
) -> DataFrame:
    """Per (``key``, ``part``): rows, distinct ``item`` and the range of ``stored``, without a straggling task.

    Two stages over salts of heavy keys: partial results of each (key, part, salt), then merged by (key, part).
    Copies of an item are combined before the first exchange, so an item delivered any number of times crosses it
    once a task; items spread over all tasks by (key, part, salt, item), and what is exchanged after that are sums.
    No row is dropped or sampled. Keys too light to be salted hold less than ``share`` of the rows.

    Nulls: rows with a null key are left out, a null ``part`` is a group of its own, null items count as rows but
    not as items, null ``stored`` values are ignored (the range is null if all are). Empty input gives no rows.
    Other columns, whatever their names, are not read.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(part).alias("p"), F.col(item).alias("i"), F.col(stored).alias("s")
    )
    items = with_salt(rows, "k", "i", share, rows_per_salt).groupBy("k", "p", "salt", "i").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")
    )
    partial = items.groupBy("k", "p", "salt").agg(
        F.sum("n").alias("n"), F.count("i").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return partial.groupBy(F.col("k").alias(key), F.col("p").alias(part)).agg(
        F.sum("n").alias("n_rows"), F.sum("d").alias("n_distinct"), F.min("lo").alias("stored_min"), F.max("hi").alias("stored_max")
    )


def stale_counts(df: DataFrame, key: str, part: str, item: str, stored: str, **sizes) -> DataFrame:
    """The (``key``, ``part``) of :func:`salted_distinct` where a stored count differs from the count found."""
    found = salted_distinct(df, key, part, item, stored, **sizes)
    return found.where((F.col("stored_min") != F.col("n_distinct")) | (F.col("stored_max") != F.col("n_distinct")))
