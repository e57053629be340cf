"""All pairs of points within a radius on the sphere, by Voronoi cells and vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.runtime import written

#: Radians added to radii while candidates are searched, against rounding; the last test is exact.
SLACK = 1e-7
LEAF = 24


def unit_vectors(lon_deg: np.ndarray, lat_deg: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon_deg), np.radians(lat_deg)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distance of unit vectors in radians, by the chord: accurate for small angles."""
    d = a - b
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(np.einsum("ij,ij->i", d, d)) / 2))


def separation_arcsec(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Haversine distance in arcseconds of positions in degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.minimum(1.0, np.sqrt(h)))) * 3600


class VantageTree:
    """A vantage-point tree over unit vectors under the great-circle metric, built level by level.

    Every inner node holds a vantage point and the median distance of the others from it; the nearer half goes to
    its first child, the rest to the second. Nodes are numbered as in a heap.
    """

    def __init__(self, xyz: np.ndarray):
        self.xyz, n = xyz, len(xyz)
        self.order = np.arange(n)
        levels = [np.array([0])]
        starts, ends = np.array([0]), np.array([n])
        self.levels = []
        while len(levels[-1]):
            nodes = levels[-1]
            inner = ends - starts > LEAF
            self.levels.append((nodes, starts, ends, inner, np.zeros(len(nodes))))
            if not inner.any():
                break
            s, e = starts[inner], ends[inner]
            sizes = e - s - 1  # the first point of a node is its vantage point
            seg = np.repeat(np.arange(len(s)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(s + 1, sizes)
            d = angle(xyz[self.order[at]], xyz[self.order[np.repeat(s, sizes)]])
            by = np.lexsort((d, seg))
            self.order[at] = self.order[at[by]]
            d = d[by]
            half = s + 1 + sizes // 2
            first = np.cumsum(sizes) - sizes
            self.levels[-1][4][inner] = d[first + sizes // 2 - 1]
            parents = nodes[inner]
            levels.append(np.stack([2 * parents + 1, 2 * parents + 2], axis=1).ravel())
            starts = np.stack([s + 1, half], axis=1).ravel()
            ends = np.stack([half, e], axis=1).ravel()

    def candidate_pairs(self, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (i < j) that may be within ``radius``; no pair within it is missing. All points query at once."""
        n, left, right = len(self.xyz), [], []
        query, slot = np.arange(n), np.zeros(n, np.int64)  # slot: place of the node in its level
        for nodes, starts, ends, inner, mu in self.levels:
            is_inner = inner[slot]
            q, k = query[~is_inner], slot[~is_inner]
            sizes = ends[k] - starts[k]
            qq = np.repeat(q, sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[k], sizes)
            other = self.order[at]
            keep = qq < other
            left.append(qq[keep])
            right.append(other[keep])
            q, k = query[is_inner], slot[is_inner]
            if not len(q):
                break
            vantage = self.order[starts[k]]
            d = angle(self.xyz[q], self.xyz[vantage])
            keep = (d <= radius) & (q < vantage)
            left.append(q[keep])
            right.append(vantage[keep])
            child = np.cumsum(inner) - 1  # the inner node's rank gives the place of its children
            near, far = d <= mu[k] + radius, d >= mu[k] - radius
            query = np.concatenate([q[near], q[far]])
            slot = np.concatenate([2 * child[k[near]], 2 * child[k[far]] + 1])
        return np.concatenate(left), np.concatenate(right)


def local_pairs(lon: np.ndarray, lat: np.ndarray, radius_arcsec: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within the radius, with their separations."""
    xyz = unit_vectors(lon, lat)
    i, j = VantageTree(xyz).candidate_pairs(np.radians(radius_arcsec / 3600) + SLACK)
    sep = separation_arcsec(lon[i], lat[i], lon[j], lat[j])
    keep = sep <= radius_arcsec
    return i[keep], j[keep], sep[keep]


def _assign(radius: float):
    """One part of a group's points and all its pivots to rows of (group, cell, home): the nearest pivot's cell, and
    visits to lower-numbered ones."""

    def run(key: tuple, points: pa.Table, pivots: pa.Table) -> pa.Table:
        ident, lon, lat = (points.column(c).to_numpy() for c in ("id", "lon", "lat"))
        pivots = pivots.sort_by("of_id")  # all parts must number the cells alike
        where = unit_vectors(pivots.column("of_lon").to_numpy(), pivots.column("of_lat").to_numpy()) if pivots.num_rows else np.zeros((1, 3))
        xyz, m = unit_vectors(lon, lat), len(where)
        rows, cells, home = [], [], []
        for some in np.array_split(np.arange(len(ident)), max(1, len(ident) * m // 4_000_000)):
            dots = xyz[some] @ where.T
            own = dots.argmax(axis=1)
            nearest = angle(xyz[some], where[own])
            limit = np.cos(np.minimum(np.pi, nearest + 2 * radius + SLACK))
            p, c = np.nonzero((dots >= limit[:, None]) & (np.arange(m)[None, :] < own[:, None]))
            rows += [some, some[p]]
            cells += [own, c]
            home += [np.ones(len(some), bool), np.zeros(len(p), bool)]
        at = np.concatenate(rows)
        return pa.table({
            "grp": np.full(len(at), key[0], np.int64), "cell": np.concatenate(cells).astype(np.int32), "id": ident[at],
            "lon": lon[at], "lat": lat[at], "home": np.concatenate(home),
        })

    return run


def _join_cell(radius_arcsec: float):
    def run(t: pa.Table) -> pa.Table:
        group, ident, lon, lat, home, block, b1, b2 = (
            t.column(c).to_numpy() for c in ("grp", "id", "lon", "lat", "home", "block", "b1", "b2")
        )
        i, j, sep = local_pairs(lon, lat, radius_arcsec)
        keep = (home[i] | home[j]) & (ident[i] != ident[j])
        if b1[0] != b2[0]:  # a pair inside one block is found where that block meets itself
            keep &= block[i] != block[j]
        i, j, sep = i[keep], j[keep], sep[keep]
        a, b = ident[i], ident[j]
        return pa.table({"grp": group[i], "a": np.minimum(a, b), "b": np.maximum(a, b), "sep_arcsec": sep})

    return run


def pairs_within(
    df: DataFrame,
    ident: str,
    lon: str,
    lat: str,
    group: str,
    radius_arcsec: float,
    cell_points: int = 1500,
    max_pivots: int = 16384,
    part_points: int = 200_000,
) -> DataFrame:
    """Every pair of different ``ident`` of one ``group`` at most ``radius_arcsec`` apart, once: ``group, a, b, sep_arcsec``.

    Points go to the Voronoi cell of the nearest of some pivots. By the triangle inequality a point within r of a
    cell's point is at most 2 r farther from that cell's pivot than from its own, so such points also visit that
    cell; visiting only lower-numbered cells makes each pair appear in one cell alone. Each cell is joined by a
    vantage-point tree under the exact great-circle metric. The pivots of a group are points of its own, chosen by
    hash, about one in ``cell_points`` and ``max_pivots`` at most on average, so they lie where its points are and
    cells stay of one size as groups grow. Large groups are assigned in parts of ``part_points``, each with all pivots
    of its group: neither points nor pivots pass the driver. Pivots change the balance only, never the result. Cells
    that are too full all the same (a hot spot) are cut into blocks, and every pair of blocks is joined by itself:
    nothing is capped.

    ``ident`` and ``group`` are integers. Rows with a null in a used column or a NaN or infinite coordinate pair
    with nothing; copies of one ident of a group count once (its smallest position); longitudes may follow
    either convention (-180..180 or 0..360). Empty input gives no pairs. Other columns are not read.
    """
    radius = float(np.radians(radius_arcsec / 3600))
    sane = [F.abs(F.col(c)) < F.lit(float("inf")) for c in (lon, lat)]  # also drops NaN, which is above infinity
    raw = df.where(F.col(ident).isNotNull() & F.col(group).isNotNull() & sane[0] & sane[1]).select(
        F.col(group).cast("long").alias("grp"), F.col(ident).cast("long").alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")
    )
    points = raw.groupBy("grp", "id").agg(F.min(F.struct("lon", "lat")).alias("at")).select("grp", "id", "at.lon", "at.lat")
    n = F.count(F.lit(1))
    sizes = raw.groupBy("grp").agg(  # from all rows: copies make it an estimate, which is enough
        F.least(F.lit(1.0 / cell_points), F.lit(float(max_pivots)) / n).alias("share"),
        F.when(n > cell_points, F.ceil(n / F.lit(part_points))).otherwise(0).cast("int").alias("parts"),
    )
    sized = points.join(sizes, "grp")
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) / F.lit(float(1 << 53))
    chosen = sized.where((F.col("parts") > 0) & (draw < F.col("share")))
    chosen = chosen.select(*[F.col(c).alias(f"of_{c}") for c in ("grp", "id", "lon", "lat")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))
    parted = sized.select("grp", "id", "lon", "lat", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.col("parts"))).cast("int").alias("part"))
    assigned = parted.groupBy("grp", "part").cogroup(chosen.groupBy("of_grp", "of_part")).applyInArrow(_assign(radius), "grp long, cell int, id long, lon double, lat double, home boolean")
    placed = written(assigned, "cells").df
    full = 8 * cell_points
    counts = placed.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(full)).cast("int").alias("blocks")).where("blocks > 1")
    blocked = (
        placed.join(counts, ["grp", "cell"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
        .drop("other", "blocks")
    )
    found = blocked.groupBy("grp", "cell", "b1", "b2").applyInArrow(_join_cell(radius_arcsec), "grp long, a long, b long, sep_arcsec double")
    return found.withColumnRenamed("grp", group)
