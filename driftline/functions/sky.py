"""Positions on the sphere as column expressions, all angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x: float) -> Column:
    return F.lit(float(x))


def normal_ra(ra: ColumnLike) -> Column:
    """Right ascension in [0, 360), from either convention."""
    return F.pmod(_c(ra), lit(360))


def chord(angle_deg: ColumnLike) -> Column:
    """Straight distance on the unit sphere of two points that far apart."""
    return lit(2) * F.sin(F.radians(_c(angle_deg)) / 2)


def cartesian(ra: ColumnLike, dec: ColumnLike) -> tuple[Column, Column, Column]:
    a, d = F.radians(_c(ra)), F.radians(_c(dec))
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def separation(ra1: ColumnLike, dec1: ColumnLike, ra2: ColumnLike, dec2: ColumnLike) -> Column:
    """Great-circle distance by the haversine formula; NaN and null positions give NaN and null."""
    p1, p2 = F.radians(_c(dec1)), F.radians(_c(dec2))
    h = F.pow(F.sin((p2 - p1) / 2), lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(_c(ra2) - _c(ra1)) / 2), lit(2))
    return F.degrees(lit(2) * F.asin(F.least(lit(1), F.sqrt(h))))


def planar_angle(ax: ColumnLike, ay: ColumnLike, bx: ColumnLike, by: ColumnLike, cx: ColumnLike, cy: ColumnLike) -> Column:
    """Angle between the directions a to b and a to c in the (ra, dec) plane.

    Null where two points coincide, NaN where rounding takes the cosine above 1: neither passes a ``<=`` test.
    """
    ux, uy, vx, vy = _c(bx) - _c(ax), _c(by) - _c(ay), _c(cx) - _c(ax), _c(cy) - _c(ay)
    norms = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.degrees(F.acos((ux * vx + uy * vy) / F.nullif(norms, lit(0))))


def angle_over_time(angle: Column, days: Column) -> Column:
    """The angle per day where more than a day lies between the last two points, else the angle."""
    return F.when(days > 1, angle / F.nullif(days, lit(0))).otherwise(angle)


def position_angle(ra1: ColumnLike, dec1: ColumnLike, ra2: ColumnLike, dec2: ColumnLike) -> Column:
    """Direction from the first point to the second, from north through east, in [0, 360)."""
    da, d1, d2 = F.radians(_c(ra2) - _c(ra1)), F.radians(_c(dec1)), F.radians(_c(dec2))
    y = F.sin(da) * F.cos(d2)
    x = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    return F.pmod(F.degrees(F.atan2(y, x)), lit(360))


#: Rotation from J2000 equatorial to galactic axes (IAU 1958 pole).
GALACTIC = (
    (-0.0548755604, -0.8734370902, -0.4838350155),
    (0.4941094279, -0.4448296300, 0.7469822445),
    (-0.8676661490, -0.1980763734, 0.4559837762),
)
OBLIQUITY_DEG = 23.4392911


def galactic(ra: ColumnLike, dec: ColumnLike) -> tuple[Column, Column]:
    """Galactic longitude in [0, 360) and latitude."""
    xyz = cartesian(ra, dec)
    x, y, z = (sum((lit(m) * v for m, v in zip(row[1:], xyz[1:])), lit(row[0]) * xyz[0]) for row in GALACTIC)
    return F.pmod(F.degrees(F.atan2(y, x)), lit(360)), F.degrees(F.asin(F.greatest(lit(-1), F.least(lit(1), z))))


def ecliptic_to_galactic(lon: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    x, y, z = cartesian(lon, lat)
    e = math.radians(OBLIQUITY_DEG)
    y, z = y * math.cos(e) - z * math.sin(e), y * math.sin(e) + z * math.cos(e)
    return galactic(F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.greatest(lit(-1), F.least(lit(1), z)))))


GAUSS_DEG_PER_DAY = 0.9856076686


def eccentric_anomaly(a: Column, e: Column, mean_anomaly: Column, epoch: Column, jd: Column, iterations: int = 12) -> Column:
    """Eccentric anomaly in radians by a fixed number of Newton steps; null for orbits that are not ellipses."""
    ellipse = F.when((a > 0) & (e >= 0) & (e < 1), e)
    m = F.radians(F.pmod(mean_anomaly + lit(GAUSS_DEG_PER_DAY) / F.pow(a, lit(1.5)) * (jd - epoch), lit(360)))
    given = F.struct(m.alias("m"), ellipse.alias("e"), (m + ellipse * F.sin(m)).alias("x"))

    def newton(s: Column, _: Column) -> Column:
        step = (s["x"] - s["e"] * F.sin(s["x"]) - s["m"]) / (lit(1) - s["e"] * F.cos(s["x"]))
        return F.struct(s["m"].alias("m"), s["e"].alias("e"), (s["x"] - step).alias("x"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), given, newton, lambda s: s["x"])


def orbit_position(a: Column, e: Column, inc: Column, node: Column, peri: Column, ecc: Column) -> tuple[Column, Column, Column]:
    """Heliocentric ecliptic position in au at an eccentric anomaly."""
    xp, yp = a * (F.cos(ecc) - e), a * F.sqrt(lit(1) - e * e) * F.sin(ecc)
    cw, sw, cn, sn, ci, si = (f(F.radians(x)) for x in (peri, node, inc) for f in (F.cos, F.sin))
    x = (cw * cn - sw * sn * ci) * xp + (-sw * cn - cw * sn * ci) * yp
    y = (cw * sn + sw * cn * ci) * xp + (-sw * sn + cw * cn * ci) * yp
    return x, y, (sw * si) * xp + (cw * si) * yp


#: Mean elements of the Earth-Moon barycentre at J2000 (a, e, mean anomaly, perihelion longitude).
EARTH = (1.00000261, 0.01671123, 357.52688973, 102.93768193)


def with_ephemeris(df: DataFrame, elements: list[str], epoch: str, jd: str, prefix: str = "") -> DataFrame:
    """Add geocentric ``ra``, ``dec`` and ``distance`` in au of two-body orbits at the time ``jd``, without light time.

    An approximation: no planets. ``elements`` names a, e, inclination, node, perihelion and mean anomaly. The steps
    are columns of their own, each computed once per row. Null for orbits that are not ellipses.
    """
    a, e, inc, node, peri, m = (F.col(c) for c in elements)
    ea, ee, em, ep = (lit(x) for x in EARTH)
    df = df.withColumns({"_ecc": eccentric_anomaly(a, e, m, F.col(epoch), F.col(jd)), "_earth": eccentric_anomaly(ea, ee, em, lit(2451545.0), F.col(jd))})
    body = orbit_position(a, e, inc, node, peri, F.col("_ecc"))
    home = orbit_position(ea, ee, lit(0), lit(0), ep, F.col("_earth"))
    df = df.withColumns({f"_{n}": o - g for n, o, g in zip("xyz", body, home)})
    ob = math.radians(OBLIQUITY_DEG)
    df = df.withColumns({"_yq": F.col("_y") * math.cos(ob) - F.col("_z") * math.sin(ob), "_zq": F.col("_y") * math.sin(ob) + F.col("_z") * math.cos(ob)})
    df = df.withColumn("_r", F.sqrt(F.pow("_x", lit(2)) + F.pow("_yq", lit(2)) + F.pow("_zq", lit(2))))
    sky = {"ra": F.pmod(F.degrees(F.atan2("_yq", "_x")), lit(360)), "dec": F.degrees(F.asin(F.col("_zq") / F.col("_r"))), "distance": F.col("_r")}
    return df.withColumns({f"{prefix}{k}": v for k, v in sky.items()}).drop("_ecc", "_earth", "_x", "_y", "_z", "_yq", "_zq", "_r")


def difference_magnitude(magpsf: Column, sigmapsf: Column, magnr: Column, sigmagnr: Column, positive: Column) -> tuple[Column, Column]:
    """Apparent magnitude and its error from difference photometry, by the survey's published formula.

    Flux of the reference source plus or minus the flux of the difference; null where the sum is not positive.
    """
    ref, diff = F.pow(lit(10), lit(-0.4) * magnr), F.pow(lit(10), lit(-0.4) * magpsf)
    total = ref + F.when(positive, diff).otherwise(-diff)
    ok = F.when(total > 0, total)
    sigma = F.sqrt(F.pow(diff * sigmapsf, lit(2)) + F.pow(ref * sigmagnr, lit(2))) / ok
    return lit(-2.5) * F.log10(ok), sigma
