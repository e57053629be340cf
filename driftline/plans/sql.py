"""Pieces of SQL for DuckDB that several queries share."""

from driftline.schema import ALERTS_SQL, TRAJECTORIES_SQL

__all__ = ["ALERTS_SQL", "TRAJECTORIES_SQL", "angle", "ephemeris", "sep"]


def sep(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """Great-circle distance in degrees."""
    return (
        f"degrees(2 * asin(least(1, sqrt(pow(sin((radians({dec2}) - radians({dec1})) / 2), 2)"
        f" + cos(radians({dec1})) * cos(radians({dec2})) * pow(sin(radians({ra2} - {ra1}) / 2), 2)))))"
    )


def angle(a: str, b: str, c: str) -> str:
    """Planar angle at ``a`` of the directions to ``b`` and ``c``, each an alias with ra and dec; null where undefined."""
    ux, uy, vx, vy = f"({b}.ra - {a}.ra)", f'({b}."dec" - {a}."dec")', f"({c}.ra - {a}.ra)", f'({c}."dec" - {a}."dec")'
    cos = f"(({ux} * {vx} + {uy} * {vy}) / nullif(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}), 0))"
    return f"(case when abs({cos}) <= 1 then degrees(acos({cos})) end)"


def _kepler(name: str, source: str, m: str, e: str) -> str:
    """Steps of Newton for the eccentric anomaly ``{name}_x``, each a table expression over the one before."""
    first = f"{name}_k0 as (select *, {m} as {name}_m, {e} as {name}_e, {m} + {e} * sin({m}) as {name}_x from ({source}))"
    x = f"{name}_x - ({name}_x - {name}_e * sin({name}_x) - {name}_m) / (1 - {name}_e * cos({name}_x))"
    return ",\n ".join([first, *(f"{name}_k{k} as (select * replace ({x} as {name}_x) from {name}_k{k - 1})" for k in range(1, 13))])


def ephemeris(name: str, source: str, elements: list[str], epoch: str) -> str:
    """Table ``name``: ``source``, which has ``jd``, with positions of two-body orbits as ``{name}_ra, {name}_dec, {name}_distance``."""
    a, e, inc, node, peri, m = elements

    def anomaly(a: str, m: str, epoch: str) -> str:
        return f"radians(((({m} + 0.9856076686::double / pow({a}, 1.5) * (jd - {epoch})) % 360) + 360) % 360)"

    def place(a: str, e: str, inc: str, node: str, peri: str, x: str) -> list[str]:
        xp, yp = f"({a} * (cos({x}) - {e}))", f"({a} * sqrt(1 - {e} * {e}) * sin({x}))"
        cw, sw, cn, sn, ci, si = (f"{f}(radians({v}))" for v in (peri, node, inc) for f in ("cos", "sin"))
        return [
            f"(({cw} * {cn} - {sw} * {sn} * {ci}) * {xp} + (-{sw} * {cn} - {cw} * {sn} * {ci}) * {yp})",
            f"(({cw} * {sn} + {sw} * {cn} * {ci}) * {xp} + (-{sw} * {sn} + {cw} * {cn} * {ci}) * {yp})",
            f"({sw} * {si} * {xp} + {cw} * {si} * {yp})",
        ]

    own, home = f"{name}b", f"{name}h"
    body = place(a, e, inc, node, peri, f"{own}_x")
    earth = place("1.00000261::double", "0.01671123::double", "0::double", "0::double", "102.93768193::double", f"{home}_x")
    tilt = "radians(23.4392911::double)"
    n = name
    return f"""{_kepler(own, source, anomaly(a, m, epoch), e)},
 {_kepler(home, f'select * from {own}_k12', anomaly('1.00000261::double', '357.52688973::double', '2451545.0::double'), '0.01671123::double')},
 {n}_v as (select *, {body[0]} - {earth[0]} as {n}_vx, {body[1]} - {earth[1]} as {n}_vy, {body[2]} - {earth[2]} as {n}_vz from {home}_k12),
 {n}_w as (select *, {n}_vy * cos({tilt}) - {n}_vz * sin({tilt}) as {n}_wy, {n}_vy * sin({tilt}) + {n}_vz * cos({tilt}) as {n}_wz from {n}_v),
 {n}_d as (select *, sqrt({n}_vx * {n}_vx + {n}_wy * {n}_wy + {n}_wz * {n}_wz) as {n}_distance from {n}_w),
 {n} as (select *, (degrees(atan2({n}_wy, {n}_vx)) + 360) % 360 as {n}_ra, degrees(asin({n}_wz / {n}_distance)) as {n}_dec from {n}_d)"""
