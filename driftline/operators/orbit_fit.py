"""Orbits of trajectories: a solver interface, a two-body solver of our own, and merging of arcs."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.sky import EARTH, OBLIQUITY_DEG
from driftline.operators.pairs import nearest_elements
from driftline.runtime import written
from driftline.schema import ELEMENTS, ORBIT

#: Gravitational parameter of the sun in au^3 / day^2.
MU = 0.01720209895**2
FAILED = -1.0
#: A solver takes times (JD), ra and dec in degrees; it returns epoch, six elements, six errors and reduced chi, or None.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray], "list[float] | None"]


def elements_position(el: np.ndarray, t: np.ndarray, epoch: float) -> np.ndarray:
    """Heliocentric ecliptic positions (n, 3) of elements in degrees at times."""
    a, e, inc, node, peri, m0 = el[0], el[1], *np.radians(el[2:])
    m = np.mod(m0 + np.sqrt(MU / a**3) * (t - epoch), 2 * np.pi)
    ecc = m + e * np.sin(m)
    for _ in range(30):
        step = (ecc - e * np.sin(ecc) - m) / (1 - e * np.cos(ecc))
        ecc = ecc - step
        if np.abs(step).max() < 1e-13:
            break
    x, y = a * (np.cos(ecc) - e), a * np.sqrt(1 - e * e) * np.sin(ecc)
    cw, sw, cn, sn, ci, si = np.cos(peri), np.sin(peri), np.cos(node), np.sin(node), np.cos(inc), np.sin(inc)
    return np.stack([(cw * cn - sw * sn * ci) * x + (-sw * cn - cw * sn * ci) * y, (cw * sn + sw * cn * ci) * x + (-sw * sn + cw * cn * ci) * y, sw * si * x + cw * si * y], axis=1)


def earth(t: np.ndarray) -> np.ndarray:
    a, e, m, peri = EARTH
    return elements_position(np.array([a, e, 0.0, 0.0, peri, m]), t, 2451545.0)


def directions(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """Unit vectors in ecliptic axes of equatorial positions in degrees."""
    a, d, ob = np.radians(ra), np.radians(dec), np.radians(OBLIQUITY_DEG)
    x, y, z = np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)
    return np.stack([x, y * np.cos(ob) + z * np.sin(ob), -y * np.sin(ob) + z * np.cos(ob)], axis=1)


def states_to_elements(states: np.ndarray) -> np.ndarray:
    """Elements in degrees (m, 6) of heliocentric states (m, 6); NaN unless they are ellipses."""
    r, v = states[:, :3], states[:, 3:]
    rn, h = np.linalg.norm(r, axis=1), np.cross(r, v)
    a = 1 / (2 / rn - (v * v).sum(1) / MU)
    ev = np.cross(v, h) / MU - r / rn[:, None]
    e, hn = np.linalg.norm(ev, axis=1), np.linalg.norm(h, axis=1)
    inc, nn = np.arccos(np.clip(h[:, 2] / hn, -1, 1)), np.hypot(h[:, 0], h[:, 1])
    flat = ~(nn > 1e-12)
    n = np.stack([np.where(flat, 1.0, -h[:, 1] / np.where(flat, 1, nn)), np.where(flat, 0.0, h[:, 0] / np.where(flat, 1, nn)), np.zeros(len(r))], axis=1)
    up = h / hn[:, None]
    base = np.where(e[:, None] > 1e-10, ev, n)
    peri = np.arctan2((base * np.cross(up, n)).sum(1), (base * n).sum(1))
    true = np.arctan2((r * np.cross(up, base)).sum(1), (r * base).sum(1))
    ecc = 2 * np.arctan2(np.sqrt(1 - e) * np.sin(true / 2), np.sqrt(1 + e) * np.cos(true / 2))
    angles = np.degrees(np.stack([np.arctan2(n[:, 1], n[:, 0]), peri, ecc - e * np.sin(ecc)], axis=1)) % 360
    out = np.column_stack([a, e, np.degrees(inc), angles])
    out[~((a > 0) & (e < 1) & (hn > 0))] = np.nan
    return out


def _eccentric(m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eccentric anomalies by Newton's steps, in full for those that need more than a few."""
    sin = np.sin(m)
    x = m + e * sin * (1 + e * np.cos(m))
    for _ in range(3):
        step = (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
        x = x - step
    x, m, e = x.ravel(), m.ravel(), np.broadcast_to(e, m.shape).ravel()
    left = np.flatnonzero(np.abs(step.ravel()) > 1e-8)  # a step below that leaves an error of its square
    for _ in range(40):
        if not left.size:
            break
        part, ecc = x[left], e[left]
        step = (part - ecc * np.sin(part) - m[left]) / (1 - ecc * np.cos(part))
        x[left] = part - step
        left = left[np.abs(step) > 1e-8]
    return x.reshape(sin.shape)


ARCSEC = np.degrees(1) * 3600


def _of(seen: tuple[np.ndarray, ...], rows: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(x[..., rows] for x in seen)


def _sky(states: np.ndarray, seen: tuple[np.ndarray, ...], slopes: bool = False):
    """Squared residuals of m states in square arcsec, infinite unless they are ellipses, and with ``slopes`` the normal matrices and gradients too.

    ``seen`` holds times from the epoch (n, m), directions and places of the earth (3, n, m), and weights (n, m): arcsec a
    radian, 0 for points that only fill up a shorter arc. Positions come by the f and g of two bodies, which depend on the
    state through 1/a, |r| and r v alone, so their slopes are exact and closed.
    """
    dt, u, origin, weight = seen
    r, v = states[:, :3].T, states[:, 3:].T
    rn = np.sqrt((r * r).sum(0))
    a = 1 / (2 / rn - (v * v).sum(0) / MU)
    h = np.cross(states[:, :3], states[:, 3:])
    ok = (a > 0) & ((h * h).sum(1) > 0)
    a = np.where(ok, a, 1.0)
    root = np.sqrt(a)
    ec, es = 1 - rn / a, (r * v).sum(0) / np.sqrt(MU) / root  # e cos E and e sin E at the epoch
    e = np.hypot(ec, es)
    ok &= e < 1
    ec, es, e = np.where(ok, ec, 0.0), np.where(ok, es, 0.0), np.where(ok, e, 0.0)
    n, first = np.sqrt(MU / a**3), np.arctan2(es, ec)
    x = _eccentric(first - es + n * dt, e) - first
    sin, half = np.sin(x), np.sin(x / 2)
    less = 2 * half * half  # 1 - cos x
    f, g = 1 - a / rn * less, dt - (x - sin) / n
    d = f * r[:, None, :] + g * v[:, None, :] - origin
    far = np.sqrt((d * d).sum(0))
    d /= far
    off = (d - u) * weight
    cost = np.where(ok, (off * off).sum((0, 1)), np.inf)
    if not slopes:
        return cost
    k = 1 / (1 - ec * (1 - less) + es * sin)  # a / r at the time
    x_a = k * (-1.5 * n * dt / a + rn / a**2 * sin + 0.5 / a * es * less)
    x_r, x_s = -k * sin / a, -k * less / root
    w, z = -(a / rn) * sin, -less / n
    f_a, f_r, f_s = w * x_a - less / rn, w * x_r + a / rn**2 * less, w * x_s
    g_a, g_r, g_s = z * x_a - 1.5 * (x - sin) / (n * a), z * x_r, z * x_s
    by_r, by_v, mu = 2 * a * a / rn**3, 2 * a * a / MU, np.sqrt(MU)
    # Gradients of f and g: along r and v by the position, along v and r by the velocity.
    f_rr, g_rr, f_rv, g_rv = f_a * by_r + f_r / rn, g_a * by_r + g_r / rn, f_s / mu, g_s / mu
    f_vv, g_vv = f_a * by_v, g_a * by_v
    flat = np.hypot(d[0], d[1])
    pole = flat < 1e-9
    flat = np.where(pole, 1.0, flat)
    one = np.stack([np.where(pole, 1.0, -d[1] / flat), np.where(pole, 0.0, d[0] / flat), np.zeros_like(flat)])
    two = np.stack([d[1] * one[2] - d[2] * one[1], d[2] * one[0] - d[0] * one[2], d[0] * one[1] - d[1] * one[0]])
    columns = []
    for axis in (one, two):
        scale = weight / far
        ar, av = (axis * r[:, None, :]).sum(0) * scale, (axis * v[:, None, :]).sum(0) * scale
        p, q = ar * f_rr + av * g_rr, ar * f_rv + av * g_rv
        pv, qv = ar * f_vv + av * g_vv, q
        fs, gs = f * scale, g * scale
        columns.append([*(fs * axis[c] + p * r[c] + q * v[c] for c in range(3)), *(gs * axis[c] + qv * r[c] + pv * v[c] for c in range(3)), (axis * off).sum(0)])
    normal, grad = np.empty((len(states), 6, 6)), np.empty((len(states), 6))
    for i in range(6):
        for j in range(i, 6):
            normal[:, i, j] = normal[:, j, i] = (columns[0][i] * columns[0][j] + columns[1][i] * columns[1][j]).sum(0)
        grad[:, i] = (columns[0][i] * columns[0][6] + columns[1][i] * columns[1][6]).sum(0)
    return cost, normal, grad


def _circular(distance: float, dt: np.ndarray, u: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """States (m, 6) of circular orbits at a distance from the sun, seen at the middle of each arc and moving towards its farthest point; NaN where there is none."""
    rows = np.arange(dt.shape[1])
    mid = np.abs(dt).argmin(0)
    other = np.abs(dt - dt[mid, rows]).argmax(0)
    places = []
    for at in (mid, other):
        look, home = u[:, at, rows], origin[:, at, rows]
        b = (look * home).sum(0)
        root = b * b - (home * home).sum(0) + distance**2
        places.append(home + (-b + np.sqrt(np.where(root > 0, root, np.nan))) * look)
    r, step = places[0], places[1] - places[0]
    flat = step - (step * r).sum(0) / (r * r).sum(0) * r
    v = flat / np.sqrt((flat * flat).sum(0)) * np.sqrt(MU / distance) * np.sign(dt[other, rows] - dt[mid, rows])
    return np.concatenate([r, v]).T


def _least_squares(states: np.ndarray, seen: tuple[np.ndarray, ...], steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares from each state: the states reached and their squared residuals. Those that end are left out of later steps."""
    states = states.copy()
    cost, normal, grad = _sky(states, seen, True)
    damp, active = np.full(len(states), 1e-3), np.flatnonzero(np.isfinite(cost))
    for _ in range(steps):
        if not active.size:
            break
        scale = np.sqrt(np.einsum("mii->mi", normal[active])) + 1e-150
        matrix = normal[active] / (scale[:, :, None] * scale[:, None, :])
        matrix[:, range(6), range(6)] += damp[active, None] + 1e-12 / scale**2
        good = np.isfinite(matrix).all((1, 2))
        matrix[~good] = np.eye(6)
        tried = states[active] - np.linalg.solve(matrix, (grad[active] / scale)[:, :, None])[:, :, 0] / scale
        after = _sky(tried, _of(seen, active))
        better = after < cost[active]
        up, stay = active[better], active[~better]
        ends = 1 - after[better] / np.maximum(cost[up], 1e-300) < 1e-4
        states[up], damp[up] = tried[better], np.maximum(damp[up] / 5, 1e-9)
        cost[up] = after[better]
        damp[stay] *= 8
        go = up[~ends]
        if go.size:
            _, normal[go], grad[go] = _sky(states[go], _of(seen, go), True)
        active = np.sort(np.concatenate([go, stay[damp[stay] <= 1e6]]))
    return states, cost


def _fit_like(arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sigma_arcsec: float) -> np.ndarray:
    """Figures (m, 14) of m arcs; NaN where there is no orbit. Shorter arcs are filled up to the longest by points that weigh nothing."""
    sizes = np.array([len(jd) for jd, _, _ in arcs])
    m, n = len(arcs), sizes.max()
    real = np.arange(n) < sizes[:, None]
    fill = np.minimum(np.arange(n), sizes[:, None] - 1) + (np.cumsum(sizes) - sizes)[:, None]
    jd, ra, dec = (np.concatenate([arc[c] for arc in arcs])[fill] for c in range(3))
    epoch = jd[:, 0] + ((jd - jd[:, :1]) * real).sum(1) / sizes
    dt = np.ascontiguousarray((jd - epoch[:, None]).T)
    u, origin = (np.ascontiguousarray(x.reshape(m, n, 3).transpose(2, 1, 0)) for x in (directions(ra.ravel(), dec.ravel()), earth(jd.ravel())))
    seen = dt, u, origin, np.where(real.T, ARCSEC, 0.0)
    starts = np.stack([_circular(x, dt, u, origin) for x in (1.3, 1.8, 2.3, 2.8, 3.3, 5.2)])
    costs = np.stack([_sky(s, seen) for s in starts])
    order = np.argsort(np.where(np.isfinite(costs), costs, np.inf), axis=0, kind="stable")[:2]
    which, rows = np.nonzero(np.isfinite(np.take_along_axis(costs, order, 0)))
    states, cost = _least_squares(starts[order[which, rows], rows], _of(seen, rows))
    best, least = np.full((m, 6), np.nan), np.full(m, np.inf)
    for k in (0, 1):
        won = np.flatnonzero((which == k) & (cost < least[rows]))
        best[rows[won]], least[rows[won]] = states[won], cost[won]
    out, rows = np.full((m, 14), np.nan), np.flatnonzero(np.isfinite(least))
    if not rows.size:
        return out
    state, el = best[rows], states_to_elements(best[rows])
    turns = []
    for k, s in enumerate((1e-6, 1e-6, 1e-6, 1e-8, 1e-8, 1e-8)):
        near, s = states_to_elements(state + np.eye(6)[k] * s), np.full((len(state), 1), s)
        gone = np.isnan(near[:, 0])  # no ellipse on this side
        near[gone], s[gone] = states_to_elements(state[gone] - np.eye(6)[k] * s[gone]), -s[gone]
        turn = near - el
        turn[:, 2:] = (turn[:, 2:] + 180) % 360 - 180
        turns.append(turn / s)
    to_el, normal = np.stack(turns, axis=2), _sky(state, _of(seen, rows), True)[1]
    good = np.isfinite(to_el).all((1, 2)) & np.isfinite(normal).all((1, 2)) & np.isfinite(el).all(1)
    rows, el, to_el, normal = rows[good], el[good], to_el[good], normal[good]
    cov = to_el @ np.linalg.pinv(normal, hermitian=True) @ to_el.transpose(0, 2, 1) * sigma_arcsec**2
    chi = least[rows] / sigma_arcsec**2 / np.maximum(1, 2 * sizes[rows] - 6)
    out[rows] = np.column_stack([epoch[rows], el, np.sqrt(np.maximum(np.einsum("mii->mi", cov), 0)), chi])
    return out


def two_body_fits(arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sigma_arcsec: float = 0.5, points: int = 16384) -> list[list[float] | None]:
    """Orbits of many arcs at once, arcs of like length together, about ``points`` points at a time; None where there is none.

    A part costs as much as some hundred arcs however few it has, so arcs are not kept apart by length: a part ends where
    an eighth of ``points`` would only fill up shorter arcs. An arc longer than that is a part of its own.
    """
    found: list[list[float] | None] = [None] * len(arcs)
    arcs = [tuple(np.asarray(x, float) for x in arc) for arc in arcs]
    sane = [k for k, (jd, ra, dec) in enumerate(arcs) if len(jd) >= 3 and np.isfinite(jd).all() and np.isfinite(ra).all() and np.isfinite(dec).all() and np.ptp(jd) > 0]
    parts, held = [], 0
    for k in sorted(sane, key=lambda k: len(arcs[k][0])):
        n = len(arcs[k][0])
        if not parts or (full := (len(parts[-1]) + 1) * n) > points or full - held - n > points // 8:
            parts.append([])
            held = 0
        parts[-1].append(k)
        held += n
    for part in parts:
        with np.errstate(all="ignore"):
            figures = _fit_like([arcs[k] for k in part], sigma_arcsec)
        for k, x in zip(part, figures.tolist()):
            found[k] = x if np.isfinite(x).all() else None
    return found


def two_body_fit(jd: np.ndarray, ra: np.ndarray, dec: np.ndarray, sigma_arcsec: float = 0.5) -> list[float] | None:
    """Damped least squares over the heliocentric state at the middle of the arc, from the two best of circular orbits at several distances."""
    return two_body_fits([(jd, ra, dec)], sigma_arcsec)[0]


#: A solver with ``many`` is given the arcs of a batch at once.
two_body_fit.many = two_body_fits


def command_solver(command: list[str], write: Callable, read: Callable, timeout: float = 5.0) -> Solver:
    """A solver run as a command in a folder of its own per trajectory; ``write`` makes its input, ``read`` its result.

    A run that fails or takes longer than ``timeout`` seconds gives no orbit.
    """

    def solve(jd: np.ndarray, ra: np.ndarray, dec: np.ndarray) -> list[float] | None:
        with tempfile.TemporaryDirectory() as folder:  # scratch of one run inside one task
            write(Path(folder), jd, ra, dec)
            try:
                subprocess.run(command, cwd=folder, timeout=timeout, check=True, capture_output=True)
            except (subprocess.SubprocessError, OSError):
                return None
            return read(Path(folder))

    return solve


def arcs_of(points: DataFrame, *keys: str) -> DataFrame:
    """The points of each group in the order of time as one column ``arc``. Trajectories are small (a point per detection)."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("jd", "candid", "ra", "dec"))).alias("arc"))


def fit_arcs(arcs: DataFrame, solver: Solver = two_body_fit) -> DataFrame:
    """Rows of ``arcs`` with the figures of an orbit instead of the points; -1 in all of them where there is none."""
    names = [part.strip() for part in ORBIT.split(",")][1:]
    keys = [f for f in arcs.schema.fields if f.name != "arc"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), *names])
    many = getattr(solver, "many", None)

    def each(arc: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[float] | None:
        try:
            return solver(*arc)
        except (FloatingPointError, np.linalg.LinAlgError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("arc")
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            columns = [np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in ("jd", "ra", "dec")]
            own = list(zip(*(np.split(c, ends[:-1]) for c in columns)))[: batch.num_rows]
            found = many(own) if many else [each(arc) for arc in own]
            figures = np.array([x if x is not None and np.isfinite(x).all() else [FAILED] * 14 for x in found], float).reshape(-1, 14)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), *(pa.array(c) for c in figures.T)], [*(f.name for f in keys), *(x.split(" ")[0] for x in names)])

    return arcs.mapInArrow(run, schema)


def _tasks(df: DataFrame) -> int:
    """A fit costs far more than its few points suggest: a given number of partitions is not merged for their size."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fit_orbits(points: DataFrame, least_points: int = 3, solver: Solver = two_body_fit) -> DataFrame:
    """An orbit per trajectory of at least ``least_points`` points; -1 in all figures where there is none."""
    rows = points.where("trajectory_id is not null").select("trajectory_id", "candid", "jd", "ra", "dec").repartition(_tasks(points), "trajectory_id")
    return fit_arcs(arcs_of(rows, "trajectory_id").where(F.size("arc") >= least_points), solver)


def merge_candidates(orbits: DataFrame, neighbours: int = 3) -> DataFrame:
    """Pairs of trajectories with like orbits in (a, e, i): ``first, second``, each once."""
    good = orbits.where((F.col("a") != FAILED) & F.col("a").isNotNull())
    near = nearest_elements(good, "trajectory_id", ["a", "e", "i"], neighbours + 1, cell_rows=64).where("trajectory_id <> neighbour")
    return near.select(F.least("trajectory_id", "neighbour").alias("first"), F.greatest("trajectory_id", "neighbour").alias("second")).distinct()


def merge_orbits(orbits: DataFrame, points: DataFrame, neighbours: int = 3, solver: Solver = two_body_fit, max_chi: float = 10.0) -> DataFrame:
    """Joint orbits of pairs of arcs: both trajectories and the merged elements, where a joint fit succeeds within ``max_chi``."""
    pairs = written(merge_candidates(orbits, neighbours), "pairs").df
    ids = pairs.select(F.explode(F.array("first", "second")).alias("trajectory_id")).distinct()
    arcs = written(arcs_of(points.join(ids, "trajectory_id", "left_semi"), "trajectory_id"), "arcs").df
    both = pairs.join(arcs.select(F.col("trajectory_id").alias("first"), F.col("arc").alias("_a")), "first", "left")
    both = both.join(arcs.select(F.col("trajectory_id").alias("second"), F.col("arc").alias("_b")), "second", "left")
    both = both.select("first", "second", *[F.coalesce(c, F.array().cast(arcs.schema["arc"].dataType)).alias(c) for c in ("_a", "_b")])
    other = F.filter("_b", lambda p: ~F.array_contains(F.col("_a.candid"), p["candid"]))  # an alert of both arcs counts once
    joint = both.select("first", "second", F.array_sort(F.concat("_a", other)).alias("arc")).where(F.size("arc") >= 4)
    found = fit_arcs(joint.repartition(_tasks(points), "first", "second"), solver)
    return found.where((F.col("a") != FAILED) & (F.col("chi_reduced") <= max_chi)).select("first", "second", "ref_epoch", *ELEMENTS, "chi_reduced")
