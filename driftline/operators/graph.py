"""Path labels, density clusters and running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.runtime import written


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int | Column = 0) -> DataFrame:
    """Running numbers in an order, without one task for all rows: sorted by range, then raised by the rows before."""
    columns = [f"_o{n}" for n in range(len(order))]
    keyed = df.withColumns({c: F.col(o) if isinstance(o, str) else o for c, o in zip(columns, order)})
    ranged = written(keyed.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "numbered").df
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    numbers = ranged.withColumn("_rank", rank).join(offsets, "_part")
    return numbers.withColumn(name, (F.col("_before") + F.col("_rank") - 1 + start).cast("long")).drop("_part", "_rank", "_before", *columns)


def path_labels(links: DataFrame) -> DataFrame:
    """Label of every node of simple paths: ``node, head``; each node has at most one successor and one predecessor.

    ``links`` are ``u, v`` from a node to its successor. Pointers to the predecessor are doubled until all nodes
    point to the head of their path, in steps that grow with the logarithm of the longest one.
    """
    heads = links.select(F.col("u").alias("node")).join(links.select(F.col("v").alias("node")), "node", "left_anti").distinct()
    start = links.select(F.col("v").alias("node"), F.col("u").alias("up")).unionByName(heads.select("node", F.col("node").alias("up")))
    now = written(start, "paths")
    while True:
        up = now.df.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        step = now.df.join(up, "up").select("node", F.col("higher").alias("new"), (F.col("higher") != F.col("up")).alias("moved"))
        after = written(step.withColumnRenamed("new", "up").select("node", "up", "moved"), "paths", moved=F.max("moved"))
        now.drop()
        now = after
        if not now.seen["moved"]:
            return now.df.select("node", F.col("up").alias("head"))


def cluster_labels(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's cluster: ``node, cluster``, by turns of tying nodes to their smallest neighbour.

    In one turn larger neighbours are tied to the smallest neighbour of a node, in the next smaller ones; clusters
    become stars around their smallest node. ``edges`` are ``u, v`` in any direction.
    """

    def tied(df: DataFrame, smaller: bool) -> DataFrame:
        if smaller:
            ends = df.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("n"))
        else:
            ends = df.select(F.col("u").alias("c"), F.col("v").alias("n")).unionByName(df.select(F.col("v").alias("c"), F.col("u").alias("n")))
        least = ends.groupBy("c").agg(F.min("n").alias("m"))  # partly in each task; a join can split a hot node, a window cannot
        low = ends.join(least, "c").withColumn("m", F.least("c", "m"))
        out = low.select(F.col("n").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))) if smaller else out.where("u > v").unionByName(low.where("c > m").select(F.col("c").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    state = F.bit_xor(F.xxhash64("u", "v"))
    now = written(edges.select("u", "v").where("u <> v"), "cluster", state=state)
    while True:
        after = written(tied(tied(now.df, False), True), "cluster", state=state)
        same = (after.seen["rows"], after.seen["state"]) == (now.seen["rows"], now.seen["state"])
        now.drop()
        now = after
        if same:
            stars = now.df.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("cluster"))
            return stars.unionByName(stars.select(F.col("cluster").alias("node"), "cluster")).distinct()
