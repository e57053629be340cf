"""Groups of everything linked directly or indirectly: Borůvka hooking with pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.runtime import Written, written


def star_edges(df: DataFrame, group: str, item: str, salts: int = 256) -> DataFrame:
    """Edges ``u, v`` that tie together the items of each group; a group of n items gives less than n edges.

    Items are tied to the smallest item of their (group, salt) and those to the smallest of the group, so a group
    holding a third of all rows is spread over ``salts`` tasks and no task sees more than a share of it.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("v"), F.pmod(F.xxhash64(item), F.lit(salts)).alias("salt"))
    low = rows.withColumn("u", F.min("v").over(Window.partitionBy("g", "salt")))
    tops = low.where("u = v").groupBy("g", "u").agg(F.lit(1).alias("one")).select("g", F.col("u").alias("v"))
    top = tops.withColumn("u", F.min("v").over(Window.partitionBy("g")))
    return low.select("u", "v").unionByName(top.select("u", "v")).where("u <> v")


#: Keys that may be looked up by broadcast, and how many a sketch follows to find the most frequent ones.
HOT_KEYS, FOLLOWED = 64, 4096


def _most_frequent(*columns: str) -> dict[str, Column]:
    """Sketches of the most frequent values of columns, taken while a table is written."""
    return {f"hot_{c}": F.expr(f"approx_top_k({c}, {HOT_KEYS}, {FOLLOWED})") for c in columns}


def _hot(table: Written, column: str, least: int) -> list[int]:
    """Values with more than ``least`` rows, as far as they are among the ``HOT_KEYS`` most frequent ones."""
    return [x["item"] for x in table.seen[f"hot_{column}"] or [] if x["count"] > least]


def _looked_up(rows: DataFrame, key: str, to: DataFrame, value: str, hot: list[int]) -> DataFrame:
    """Left join of ``rows`` with ``to`` (``key, value``, one row a key). Hot keys go by broadcast, as their rows would crowd one task."""
    if not hot:
        return rows.join(to, key, "left")
    few = F.broadcast(to.where(F.col(key).isin(hot)))  # at most HOT_KEYS rows
    cold = rows.where(~F.col(key).isin(hot)).join(to, key, "left")
    return cold.unionByName(rows.where(F.col(key).isin(hot)).join(few, key, "left"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, smaller end first, without loops."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _hook(edges: DataFrame) -> Written:
    """Every component's smallest outgoing edge: ``c, p``.

    Edges are ordered by (smaller end, larger end), which makes all of them different; the smallest edge of a
    component leads to its smallest neighbour. Under one strict order hooks form trees whose only cycles are of
    two; of these the smaller end becomes the root, which is then also the smallest component of its tree.
    """
    ends = edges.select(F.col("u").alias("c"), F.col("v").alias("p")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("p")))
    return written(ends.groupBy("c").agg(F.min("p").alias("p")), "hooks", **_most_frequent("p"))


def _double(hooks: Written, least: int) -> Written:
    """Pointers to the grandparent; of a cycle of two the smaller end points to itself."""
    up = hooks.df.select(F.col("c").alias("p"), F.col("p").alias("gp"))
    step = _looked_up(hooks.df.select("c", "p"), "p", up, "gp", _hot(hooks, "p", least))
    to = F.when(F.col("gp") == F.col("c"), F.least("c", "p")).otherwise(F.coalesce("gp", "p"))
    moved = step.select("c", to.alias("p"), (to != F.col("p")).alias("moved"))
    return written(moved, "pointers", moved=F.max("moved"), **_most_frequent("p"))


def _relabel(edges: Written, roots: DataFrame, least: int) -> DataFrame:
    """Both ends replaced by their roots."""
    out = edges.df
    for end in ("u", "v"):
        to = roots.select(F.col("c").alias(end), F.col("p").alias("root"))
        out = _looked_up(out, end, to, "root", _hot(edges, end, least)).drop(end).withColumnRenamed("root", end)
    return out


def components(edges: DataFrame, hub_least: int = 200_000) -> DataFrame:
    """The group of each item that is linked to another: ``item, group_id``, the smallest item of the group.

    ``edges`` has two columns of integers, the ends of a link in any order. Each round, all components hook onto their smallest
    neighbour, the trees collapse by pointer doubling, and edges are relabelled and made unique, until none remain;
    every round at least halves the components that still have edges, so chains of any length take logarithmic
    rounds. All tables of a round are written to the shared folder; nothing is collected but sketches of the
    ``HOT_KEYS`` most frequent keys of each table, taken while it is written: keys with more than ``hub_least`` rows
    (hubs of a graph, roots of large groups) are looked up by broadcast in every join. Which keys those are changes
    the plan, never the result.

    Links with a null end, loops and repeated links link nothing new. Empty input gives no rows.
    """
    a, b = edges.columns[:2]
    raw = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    now, levels = written(_ordered(raw), "edges", **_most_frequent("u", "v")), []
    while now.seen["rows"]:
        pointers, moved = _hook(now.df), True
        while moved:
            after = _double(pointers, hub_least)
            pointers.drop()
            pointers, moved = after, after.seen["moved"]
        levels.append(pointers)
        after = written(_ordered(_relabel(now, pointers.df, hub_least)), "edges", **_most_frequent("u", "v"))
        now.drop()
        now = after
    now.drop()
    if not levels:
        return raw.select(F.col("u").alias("item"), F.col("v").alias("group_id")).where(F.lit(False))
    # From the last round back: where a root of one round was hooked again, take the root it got later.
    groups = levels[-1].df.select("c", "p")
    for level in reversed(levels[:-1]):
        later = groups.select(F.col("c").alias("p"), F.col("p").alias("last"))
        found = _looked_up(level.df.select("c", "p"), "p", later, "last", _hot(level, "p", hub_least))
        groups = found.select("c", F.coalesce("last", "p").alias("p"))
    return groups.select(F.col("c").alias("item"), F.col("p").alias("group_id"))
