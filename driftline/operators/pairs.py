"""Spherical range joins and the pair filters built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.sky import lit, separation
from driftline.runtime import written
from driftline.schema import POINT_COLUMNS, finite

#: Radii are widened by this many degrees while cells are chosen, against rounding; the last test is exact.
SLACK_DEG = 1e-9


def _band(dec: Column, height: Column) -> Column:
    return F.least(F.floor(lit(180) / height), F.greatest(F.lit(0), F.floor((dec + 90) / height))).cast("int")


def _cells_in_band(band: Column, height: Column) -> Column:
    """How many right-ascension cells a band has: their width on the sphere stays at least ``height``."""
    low, high = band * height - 90, (band + 1) * height - 90
    widest = F.greatest(F.abs(low), F.abs(high))
    return F.when(widest >= 89, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(lit(360) / height * F.cos(F.radians(widest))))).cast("int")


def _levels(max_radius_deg: float) -> list[float]:
    """Radii that halve from the largest one on, down to 16 times less: each is served by cells of its own size."""
    return [max_radius_deg / 2**k for k in range(5)]


def sky_join(left: DataFrame, right: DataFrame, radius_deg: Column | float, keys: list[tuple[str, str]], max_radius_deg: float, height_deg: float | None = None) -> DataFrame:
    """Inner join of rows at most ``radius_deg`` apart (inclusive) whose ``keys`` are equal, with ``sep_deg``.

    The sides come out as structs ``l`` and ``r``; each needs ``ra`` in [0, 360) and ``dec``. The sky is cut into
    declination bands and, in each band, right-ascension cells; the left side goes to every cell that its circle
    touches, the right side to its own, so the join is an equi-join on (keys, band, cell) and each pair comes out
    once. ``radius_deg`` may depend on the left row, up to ``max_radius_deg``: then there are cells of several sizes,
    halving from one to the next, and a left row uses those that fit its radius, while the right side goes to one
    cell of each size. Cells are four radii high (two of the largest radius served), so candidates stay within a
    constant factor of the pairs found, however dense the sky, and a crowded night is spread over many tasks.
    Null and NaN positions join with nothing. Neither side is broadcast, however small it seems.
    """
    one = not isinstance(radius_deg, Column)
    levels = [max_radius_deg] if one else _levels(max_radius_deg)
    heights = [min(180.0, height_deg or max((4 if one else 2) * r, 0.02)) for r in levels]
    radius = lit(radius_deg) if one else radius_deg
    reach = radius + lit(SLACK_DEG)
    height = F.element_at(F.array(*[lit(h) for h in heights]), F.col("_level") + 1)
    level = sum((F.when(F.col("_reach") <= lit(r + SLACK_DEG), 1).otherwise(0) for r in levels[1:]), F.lit(0))
    sane = (F.abs(F.col("dec")) <= 90) & (F.col("ra") >= 0) & (F.col("ra") < 360)
    names = [f"_k{n}" for n in range(len(keys))]
    ls = left.where(sane).withColumn("_radius", radius).select(F.struct(*left.columns).alias("l"), *[F.col(a).alias(k) for k, (a, _) in zip(names, keys)], "ra", "dec", "_radius", reach.alias("_reach"))
    ls = ls.withColumn("_level", level).withColumn("_height", height)
    ls = ls.withColumn("_band", F.explode(F.sequence(_band(F.col("dec") - F.col("_reach"), F.col("_height")), _band(F.col("dec") + F.col("_reach"), F.col("_height")))))
    over_pole = F.abs(F.col("dec")) + F.col("_reach") >= 89.999
    width = F.degrees(F.asin(F.least(lit(1), F.sin(F.radians("_reach")) / F.cos(F.radians("dec"))))) + lit(SLACK_DEG)
    first, last = (F.floor((F.col("ra") + s * width) / 360 * F.col("_cells")).cast("int") for s in (-1, 1))
    around = F.when(over_pole | (last - first >= F.col("_cells")), F.sequence(F.lit(0), F.col("_cells") - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_cells"))))
    )
    ls = ls.withColumn("_cells", _cells_in_band(F.col("_band"), F.col("_height"))).withColumn("_cell", F.explode(around)).select("l", "_radius", "_level", "_band", "_cell", *names)
    rs = right.where(sane).select(F.struct(*right.columns).alias("r"), "ra", "dec", *[F.col(b).alias(k) for k, (_, b) in zip(names, keys)])
    rs = rs.withColumn("_level", F.lit(0) if one else F.explode(F.array(*[F.lit(k) for k in range(len(levels))]))).withColumn("_height", height)
    rs = rs.withColumn("_band", _band(F.col("dec"), F.col("_height")))
    own = _cells_in_band(F.col("_band"), F.col("_height"))
    rs = rs.withColumn("_cell", F.least(own - 1, F.floor(F.col("ra") / 360 * own)).cast("int")).drop("ra", "dec", "_height")
    sep = separation("l.ra", "l.dec", "r.ra", "r.dec")
    joined = ls.join(rs.hint("merge"), [*names, "_level", "_band", "_cell"])  # sizes behind an explode are underrated: no broadcast
    near = F.abs(F.col("l.dec") - F.col("r.dec")) <= F.col("_radius") + lit(SLACK_DEG)  # cheap test first
    return joined.where(near).withColumn("sep_deg", sep).where(F.col("sep_deg") <= F.col("_radius")).select("l", "r", "sep_deg")


def intra_night_pairs(alerts: DataFrame, radius_arcsec: float) -> DataFrame:
    """Pairs of alerts of one night within the radius, both directions, without coincident positions."""
    pairs = sky_join(alerts, alerts, radius_arcsec / 3600, [("nid", "nid")], radius_arcsec / 3600)
    return pairs.where((F.col("l.candid") != F.col("r.candid")) & (F.col("sep_deg") > 0))


def magnitude_rate(days: Column | None = None) -> Column:
    """Difference of magnitude of a pair, per day where ``days`` is given; null where no time lies between."""
    diff = F.abs(F.col("l.magpsf") - F.col("r.magpsf"))
    return diff if days is None else diff / F.nullif(F.abs(days), lit(0))


def by_filter(same: Column | float, diff: Column | float) -> Column:
    """The criterion of a pair: one value for equal filters, another for different ones."""
    return F.when(F.col("l.fid") == F.col("r.fid"), same).otherwise(diff)


def magnitude_pairs(pairs: DataFrame, same: float, diff: float) -> DataFrame:
    """Intra-night pairs of different exposures whose magnitudes differ little enough, earlier alert first."""
    return pairs.where("l.jd < r.jd").where(magnitude_rate() <= by_filter(lit(same), lit(diff)))


def successors(pairs: DataFrame) -> DataFrame:
    """Of each left alert the earliest right one, and of each right alert the first left one.

    Lefts with one match come first, by their own time; then the chosen matches of the others, by the time of the
    right alert: a right alert already taken, or a left one, is not taken again. Ties go by candid.
    """
    per_left = Window.partitionBy("l.candid")
    ranked = pairs.withColumn("_n", F.count(F.lit(1)).over(per_left)).withColumn("_rank", F.row_number().over(per_left.orderBy("r.jd", "r.candid")))
    chosen = ranked.where("_rank = 1").withColumn("_multi", F.col("_n") > 1)
    order = [F.col("_multi"), F.when(F.col("_multi"), F.col("r.jd")).otherwise(F.col("l.jd")), F.col("l.candid"), F.col("r.candid")]
    first = F.row_number().over(Window.partitionBy("r.candid").orderBy(*order))
    return chosen.withColumn("_first", first).where("_first = 1").drop("_n", "_rank", "_multi", "_first")


def mirror_free(pairs: DataFrame) -> DataFrame:
    """One row of each pair found in both directions: the one whose left alert is earlier, among equals the smaller candid."""
    ahead = (F.col("l.jd") < F.col("r.jd")) | ((F.col("l.jd") == F.col("r.jd")) & (F.col("l.candid") < F.col("r.candid")))
    return pairs.where(ahead)


def night_pairs(ends: DataFrame, later: DataFrame, separation_deg: float, same: float, diff: float, window: int, next_nid: str | None = None) -> DataFrame:
    """Pairs of points of earlier nights with points of later ones, up to ``window`` nights on.

    All criteria grow with the gap in nights; magnitudes count per day. With ``next_nid`` the later side is one
    night and its number comes from that column of ``ends``; otherwise all nights of ``later`` take part.
    """
    if next_nid is None:
        ends = ends.withColumn("gap", F.explode(F.sequence(F.lit(1), F.lit(window)))).withColumn("to_nid", F.col("nid") + F.col("gap"))
    else:
        ends = ends.withColumn("to_nid", F.col(next_nid)).withColumn("gap", F.col("to_nid") - F.col("nid")).where(F.col("gap").between(1, window))
    pairs = sky_join(ends, later, lit(separation_deg) * F.col("gap"), [("to_nid", "nid")], separation_deg * window)
    limit = by_filter(lit(same), lit(diff)) * F.col("l.gap")
    return pairs.where(magnitude_rate(F.col("r.jd") - F.col("l.jd")) <= limit)


def point(side: str) -> list[Column]:
    """The columns of one side of a pair, flat."""
    return [F.col(f"{side}.{c}").alias(c) for c in POINT_COLUMNS]


def _placed(rows: DataFrame, names: list[str], side: int) -> DataFrame:
    """Rows with their cell ``c0, c1, ...``: along each column in turn, ``side`` parts of equal size of each part so far."""
    cells: list[str] = []
    for n, name in enumerate(names):
        steps = F.percentile_approx(name, [k / side for k in range(1, side)] or [1.0], F.lit(10 * side)).alias("cuts")
        if cells:
            rows = rows.join(rows.groupBy(*cells).agg(steps), cells)
        else:
            rows = rows.withColumn("cuts", F.array(*[lit(q) for q in rows.agg(steps).first()[0] or [0.0]]))  # less than ``side`` values
        above = F.size(F.filter("cuts", lambda q: F.col(name) > q)) if side > 1 else F.lit(0)
        rows = rows.withColumn(f"c{n}", above.cast("int")).drop("cuts")
        cells.append(f"c{n}")
    return rows


def nearest_elements(orbits: DataFrame, key: str, columns: list[str], k: int, cell_rows: int = 500, max_side: int = 64) -> DataFrame:
    """The ``k`` nearest rows of each row by Euclidean distance over ``columns``, itself included: ``key, neighbour, rank, distance``.

    Rows are cut along each column in turn into cells of about ``cell_rows`` rows, so there are more of them as rows
    grow. A first pass within the own cell bounds each row's k-th distance; the second joins the row with the cells
    whose boxes that bound reaches, found column by column. Exact: cells change the cost, never the result.
    Rows with a null or NaN in a used column have no neighbours. Ties go by the smaller key.
    """
    rows = orbits.where(F.col(key).isNotNull() & finite(*columns)).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{n}") for n, c in enumerate(columns)])
    rows = rows.dropDuplicates(["key"])
    names, cells = [f"x{n}" for n in range(len(columns))], [f"c{n}" for n in range(len(columns))]
    side = max(1, min(max_side, round((rows.count() / max(cell_rows, 4 * k)) ** (1 / len(columns)))))
    rows = written(_placed(rows, names, side), "placed").df
    other = rows.select(F.col("key").alias("neighbour"), *cells, *[F.col(c).alias(f"o{c}") for c in names])
    distance = F.sqrt(sum((F.pow(F.col(c) - F.col(f"o{c}"), lit(2)) for c in names), lit(0)))
    by_key = Window.partitionBy("key").orderBy("distance", "neighbour")
    own = rows.join(other, cells).withColumn("distance", distance).withColumn("rank", F.row_number().over(by_key)).where(F.col("rank") <= k)
    bound = own.groupBy("key").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("have"))
    sent = rows.drop(*cells).join(bound, "key").withColumn("reach", F.when(F.col("have") < k, lit(float("inf"))).otherwise(F.col("reach"))).drop("have")
    for n, name in enumerate(names):  # parts along this column, in the parts reached so far
        box = F.struct(F.col(f"c{n}"), F.col("low"), F.col("high"))
        boxes = rows.groupBy(*cells[: n + 1]).agg(F.min(name).alias("low"), F.max(name).alias("high"))
        if n:
            sent = sent.join(boxes.groupBy(*cells[:n]).agg(F.collect_list(box).alias("boxes")), cells[:n])  # at most max_side boxes each
        else:
            known = [F.struct(F.lit(r.c0).alias("c0"), lit(r.low).alias("low"), lit(r.high).alias("high")) for r in boxes.collect()]  # at most max_side
            sent = sent.withColumn("boxes", F.array(*known) if known else F.array().cast("array<struct<c0:int,low:double,high:double>>"))
        met = F.filter("boxes", lambda b: (b["low"] <= F.col(name) + F.col("reach")) & (b["high"] >= F.col(name) - F.col("reach")))
        sent = sent.withColumn(f"c{n}", F.explode(F.transform(met, lambda b: b[f"c{n}"]))).drop("boxes")
    near = sent.join(other, cells).withColumn("distance", distance).where(F.col("distance") <= F.col("reach"))
    return near.withColumn("rank", F.row_number().over(by_key)).where(F.col("rank") <= k).select(F.col("key").alias(key), "neighbour", "rank", "distance")
