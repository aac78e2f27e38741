"""Circles and cylinders fitted per group of points.

Algebraic circles are plain SQL sums. Fits of random subsets take them from all points of their group: a
group of any size sends as many points as its subsets need, the first ones in an order by hash, each round
the next ones; a group that is smaller than this goes whole and is drawn from. Random choices are seeded by
the group's key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Workspace, spread
from .points import is_number
from .sampling import hash01

CYLINDER = ["rho", "theta", "phi", "alpha", "radius", "err", "px", "py", "pz"]
TILTED = ["x", "y", "radius", "err", "ax", "ay"]
#: Groups of up to so many points go whole to their subsets' draws.
WHOLE_POINTS = 20_000
MAX_ITERATIONS, TOLERANCE = 2000, 1e-8


def upper_median(v: np.ndarray) -> float:
    return float(np.sort(v)[len(v) // 2])


def nelder_mead(f, start: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """(best point, its value, whether it converged). Adaptive coefficients for the dimension; the simplex
    starts with each coordinate 5 % larger, or 0.00025 where it is 0."""
    n = len(start)
    reflect, expand, contract, shrink = 1.0, 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
    corners = [np.array(start, float)]
    for i in range(n):
        c = corners[0].copy()
        c[i] = c[i] * 1.05 if c[i] else 0.00025
        corners.append(c)
    s = np.array(corners)
    v = np.array([f(c) for c in s])
    before, done = v.min(), False
    for _ in range(MAX_ITERATIONS):
        order = np.argsort(v, kind="stable")
        s, v = s[order], v[order]
        middle = s[:-1].mean(0)
        r = middle + reflect * (middle - s[-1])
        fr = f(r)
        new = None
        if v[0] <= fr < v[-2]:
            new = (r, fr)
        elif fr < v[0]:
            e = middle + expand * (r - middle)
            fe = f(e)
            new = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-1]:
            c = middle + contract * (r - middle)
            fc = f(c)
            new = (c, fc) if fc <= fr else None
        else:
            c = middle - contract * (middle - s[-1])
            fc = f(c)
            new = (c, fc) if fc < v[-1] else None
        if new is None:
            s[1:] = s[0] + shrink * (s[1:] - s[0])
            v[1:] = [f(c) for c in s[1:]]
        else:
            s[-1], v[-1] = new
        change, before = abs(before - v.max()), v.min()
        if change <= TOLERANCE:
            done = True
            break
    at = int(np.argmin(v))
    return s[at], float(v[at]), done


def _cylinder_frame(angles):
    """Two directions across the axis: towards its point nearest to the origin, and square to that."""
    (st, sp, sa), (ct, cp, ca) = np.sin(angles), np.cos(angles)
    return (cp * st, sp * st, ct), (-cp * ct * sa - sp * ca, cp * ca - sp * ct * sa, st * sa)


def _cylinder_planes(p, q) -> np.ndarray:
    """``cylinder_residuals`` from planes x, y, z; p has numbers, or one per column of the planes."""
    n, b = _cylinder_frame(p[1:4])
    u, v, t = q[0] * n[0], q[0] * b[0], q[1] * n[1]
    u += t
    u += np.multiply(q[2], n[2], out=t)
    u -= p[4] + p[0]
    v += np.multiply(q[1], b[1], out=t)
    v += np.multiply(q[2], b[2], out=t)
    u *= u
    v *= v
    u += v
    np.sqrt(u, out=u)
    u -= p[4]
    return u


def _circle_planes(p, q) -> np.ndarray:
    u, v = q[0] - p[0], q[1] - p[1]
    u *= u
    v *= v
    u += v
    np.sqrt(u, out=u)
    u -= p[2]
    return u


def cylinder_residuals(p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of each point from the axis, minus the radius. The axis is given by the direction (theta,
    phi) and distance rho + radius of its point nearest to the origin, and its turn alpha about that."""
    return _cylinder_planes(p, points.T)


def _centred(points: np.ndarray) -> np.ndarray:
    return points - np.array([upper_median(points[:, i]) for i in range(3)])


def fit_nm(points: np.ndarray, start: np.ndarray | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Least squares by Nelder-Mead; infinite error if it doesn't converge."""
    q = _centred(points)
    w = 1.0 if weights is None else weights
    p, v, done = nelder_mead(lambda c: float((w * cylinder_residuals(c, q) ** 2).sum()), np.array([0, math.pi / 2, 0, 0, 0]) if start is None else start)
    p[4] = abs(p[4])
    return p, v if done else math.inf


def tukey(squares: np.ndarray, b: float = 5.0) -> np.ndarray:
    """Bisquare weights of squared residuals over their scaled median deviation; all 1 if that is 0."""
    s = 1.4826 * upper_median(np.abs(squares - upper_median(squares)))
    if not s > 0:
        return np.ones(len(squares))
    u = squares / s
    return np.where(np.abs(u) > b, 0.0, (1 - (u / b) ** 2) ** 2)


def fit_irls(points: np.ndarray) -> tuple[np.ndarray, float]:
    p, last, w = None, math.inf, np.ones(len(points))
    q = _centred(points)
    for _ in range(100):
        p, err = fit_nm(points, p, w)
        w = tukey(cylinder_residuals(p, q) ** 2)
        if abs(err - last) < 1e-6 or not math.isfinite(err):
            break
        last = err
    return p, err


#: Points that fits handle side by side, and the size from which a cloud is fitted by itself.
SIDE_BY_SIDE, ALONE = 24_576, 3_000
#: Subsets whose points are drawn together, and rows of groups that a task fits together.
TOGETHER, STACK_ROWS = 50_000, 400_000
#: Tilts about y whose subsets are handled together.
TURNS = 64


def _width(size: int) -> int:
    """Rows of the planes that hold a cloud: the next of a ladder whose rungs are a quarter apart."""
    w = 10
    while w < size:
        w += w // 4
    return w


class _Slots:
    """Nelder-Mead as in ``nelder_mead`` for clouds side by side, the smallest first, one in each column. A column
    whose fit has come to rest is weighted anew and starts again, or takes the next cloud, so that none waits for
    the slowest; columns grow when only a few of the smaller clouds are left. Each column counts by itself, so
    results don't depend on what stands beside it."""

    def __init__(self, planes, clouds: list[np.ndarray], starts: np.ndarray, robust: bool):
        self.planes, self.clouds, self.starts, self.robust = planes, clouds, starts, robust
        self.n = starts.shape[1]
        self.sizes = np.array([len(c) for c in clouds])
        self.queue, self.next = np.argsort(self.sizes, kind="stable"), 0
        self.best, self.error = np.zeros((len(clouds), self.n)), np.full(len(clouds), np.inf)
        self.q, self.w = np.zeros((clouds[0].shape[1], 0, 0)), np.zeros((0, 0))
        self.s, self.v = np.zeros((self.n + 1, self.n, 0)), np.zeros((self.n + 1, 0))
        self.before, self.last = np.zeros(0), np.zeros(0)
        self.steps, self.which, self.rounds = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)

    def _ahead(self) -> int:
        """How many clouds the columns could take now."""
        return int(np.searchsorted(self.sizes[self.queue], self.w.shape[0], "right")) - self.next

    def _arrange(self, keep: np.ndarray, rows: int, columns: int) -> None:
        """Only the columns ``keep``, with empty ones behind them and more rows."""
        for name in ("q", "w", "s", "v", "before", "steps", "which", "rounds", "last"):
            a = getattr(self, name)[..., keep]
            pad = [(0, 0)] * (a.ndim - 1) + [(0, columns - len(keep))]
            if name in ("q", "w"):
                pad[-2] = (0, rows - a.shape[-2])
            setattr(self, name, np.pad(a, pad, constant_values=-1 if name == "which" else 0))
        self.columns, self.cells = np.arange(columns), np.arange(self.n * columns).reshape(self.n, columns)

    def _error(self, p: np.ndarray, at=slice(None)) -> np.ndarray:
        r = self.planes(p, self.q[:, :, at])
        r *= r
        r *= self.w[:, at]
        return np.add.reduce(r, axis=0)

    def _begin(self, at: np.ndarray, start: np.ndarray) -> None:
        """Simplex about ``start`` (n, columns) with each coordinate 5 % larger, or 0.00025 where it is 0."""
        at2 = at if len(at) > 1 else np.append(at, at)  # a single column would be added up in another order
        if len(at) < 2:
            start = np.concatenate([start, start], axis=1)
        s = np.repeat(start[None], self.n + 1, axis=0)
        for i in range(self.n):
            s[i + 1, i] = np.where(start[i] == 0, 0.00025, start[i] * 1.05)
        self.s[:, :, at2] = s
        q, w = self.q[:, :, at2], self.w[:, at2]
        for i in range(self.n + 1):
            r = self.planes(s[i], q)
            self.v[i, at2] = np.add.reduce(r * r * w, axis=0)
        self.before[at], self.steps[at] = self.v[:, at].min(0), 0

    def _load(self, at: np.ndarray) -> None:
        """The next clouds for the columns ``at``; columns without one rest."""
        some = self._ahead()
        at, idle = at[:some], at[some:]
        self.which[idle] = -1
        self.w[:, idle] = 0
        if not len(at):
            return
        for c in at:
            i = self.queue[self.next]
            p = self.clouds[i]
            self.q[:, :, c] = 0
            self.q[:, : len(p), c] = p.T
            self.w[:, c] = np.arange(self.w.shape[0]) < len(p)
            self.which[c], self.rounds[c], self.last[c] = i, 0, np.inf
            self.next += 1
        self._begin(at, self.starts[self.which[at]].T)

    def _settle(self, at: np.ndarray, ended: np.ndarray) -> None:
        """Keep the best corners of the columns ``at``, and go on with the next weights or clouds."""
        k = self.v[:, at].argmin(0)
        p, e = self.s[k, :, at].T.copy(), np.where(ended, self.v[k, at], np.inf)
        p[-1] = np.abs(p[-1])
        self.best[self.which[at]], self.error[self.which[at]] = p.T, e
        if self.robust:
            self.rounds[at] += 1
            more = np.isfinite(e) & ~(np.abs(e - self.last[at]) < 1e-6) & (self.rounds[at] < 100)
            self.last[at] = e
            again = at[more]
            if len(again):
                r = self.planes(p[:, more], self.q[:, :, again]) ** 2
                self.w[:, again] = _tukey_columns(r, self.sizes[self.which[again]])
                self._begin(again, p[:, more])
            at = at[~more]
        self._load(at)

    def _step(self, live: np.ndarray) -> None:
        s, v, n = self.s, self.v, self.n
        b = v.shape[1]
        expand, contract, shrink = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
        first, at = v.min(0), v.argmax(0)
        top = at * b + self.columns
        worst = v.take(top)
        v.put(top, -np.inf)
        second = v.max(0)
        place = at * (n * b) + self.cells
        w = s.take(place)
        middle = (s.sum(0) - w) / n
        away = middle - w
        r = middle + away
        fr = self._error(r)
        better, poor = fr < first, fr >= second
        outer = poor & (fr < worst)
        t = middle + away * np.where(better, expand, np.where(outer, contract, -contract))
        ft = self._error(t)
        use_t = (better & (ft < fr)) | (outer & (ft <= fr)) | (poor & ~outer & (ft < worst))
        use = (use_t | ~poor) & live
        s.put(place, np.where(use, np.where(use_t, t, r), w))
        v.put(top, np.where(use, np.where(use_t, ft, fr), worst))
        small = np.flatnonzero(live & ~use)
        if len(small):
            if len(small) < 2:
                small = np.append(small, small)
            k = v[:, small].argmin(0)
            base = s[k, :, small].T
            x = base + shrink * (s[:, :, small] - base)
            q, ws = self.q[:, :, small], self.w[:, small]
            for i in range(n + 1):
                e = self.planes(x[i], q)
                e *= e
                e *= ws
                keep = k == i
                s[i][:, small] = np.where(keep, base, x[i])
                v[i, small] = np.where(keep, v[i, small], np.add.reduce(e, axis=0))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        live = ended = np.zeros(0, bool)
        while True:
            used = int(live.sum())
            if self.next < len(self.queue) and not self._ahead():
                rows = _width(int(self.sizes[self.queue[self.next]]))
                room = max(2, SIDE_BY_SIDE // rows)
                if 4 * used <= room:
                    self._arrange(np.flatnonzero(live), rows, max(2, min(room, used + len(self.queue) - self.next)))
                    self._load(self.columns[used:])
                    live = self.which >= 0
                    ended = np.zeros(len(live), bool)
            elif not used:
                return self.best, self.error
            if 4 * used < 3 * len(live) and used > 1 and live.sum() == used and not self._ahead():
                self._arrange(np.flatnonzero(live), self.w.shape[0], used)
                live, ended = np.ones(used, bool), np.zeros(used, bool)
            while True:
                self._step(live)
                self.steps += 1
                still = ~(np.abs(self.before - self.v.max(0)) <= TOLERANCE)
                self.before = self.v.min(0)
                ended |= live & ~still
                live &= still & (self.steps < MAX_ITERATIONS)
                rest = (self.which >= 0) & ~live
                waiting = int(rest.sum())
                if waiting and (waiting * 16 >= len(live) or not live.any()):
                    at = np.flatnonzero(rest)
                    self._settle(at, ended[at])
                    live, ended[at] = self.which >= 0, False
                    break


def _tukey_columns(squares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``tukey`` of each column, of which the first ``sizes`` rows count; the others weigh 0."""
    counts = np.arange(len(squares))[:, None] < sizes
    half, every = sizes // 2, np.arange(len(sizes))
    m = np.sort(np.where(counts, squares, np.inf), axis=0)[half, every]
    s = 1.4826 * np.sort(np.where(counts, np.abs(squares - m), np.inf), axis=0)[half, every]
    u = squares / np.where(s > 0, s, 1)
    return np.where(counts, np.where(s > 0, np.where(u > 5.0, 0.0, (1 - (u / 5.0) ** 2) ** 2), 1.0), 0.0)


def _fit_alone(planes, cloud: np.ndarray, start: np.ndarray, robust: bool) -> tuple[np.ndarray, float]:
    """One large cloud, a stretch of its points at a time."""
    q = np.ascontiguousarray(cloud.T)
    w = np.ones(q.shape[1])
    parts = [(q[:, i : i + 8192], slice(i, i + 8192)) for i in range(0, q.shape[1], 8192)]
    p, last, err = start, math.inf, math.inf

    def error(c: np.ndarray) -> float:
        total = 0.0
        for part, i in parts:
            r = planes(c, part)
            r *= r
            r *= w[i]
            total += float(r.sum())
        return total

    for _ in range(100 if robust else 1):
        p, err, done = nelder_mead(error, p)
        p[-1] = abs(p[-1])
        err = err if done else math.inf
        if not math.isfinite(err) or abs(err - last) < 1e-6:
            break
        if robust:
            w = tukey(planes(p, q) ** 2)
        last = err
    return p, err


def minimise_many(planes, clouds: list[np.ndarray], starts: np.ndarray, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """(parameters (m, n), errors (m,)): least squares of ``planes(parameters, coordinates)`` of each cloud by
    Nelder-Mead, with bisquare weights until the error stays if ``robust``; infinite errors where it doesn't
    converge. The last parameter is a radius."""
    best, error = np.zeros(starts.shape), np.full(len(clouds), np.inf)
    large = np.array([len(c) >= ALONE for c in clouds], bool)
    for i in np.flatnonzero(large):
        best[i], error[i] = _fit_alone(planes, clouds[i], starts[i], robust)
    i = np.flatnonzero(~large)
    if len(i):
        with np.errstate(invalid="ignore", over="ignore"):
            best[i], error[i] = _Slots(planes, [clouds[k] for k in i], starts[i], robust).run()
    return best, error


CYLINDER_START = np.array([0, math.pi / 2, 0, 0, 0], float)


def fit_cylinders(clouds: list[np.ndarray], robust: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``fit_nm`` of many clouds (k, 3), or ``fit_irls``."""
    return minimise_many(_cylinder_planes, [_centred(c) for c in clouds], np.tile(CYLINDER_START, (len(clouds), 1)), robust)


def _rounds(times: int, n: int, inliers: float, conf: float) -> int:
    """``times`` as often as one subset without an outlier takes with the given confidence."""
    miss = 1 - inliers**n
    return times if miss <= 0 else max(1, times * math.ceil(math.log(max(1 - conf, 1e-300)) / math.log(miss)))


def _draws(size: int, total: int, rounds: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """(rounds, n) places of the subsets. Of a group that came whole each subset is drawn by itself; the rows
    of a larger one came in random order, and each round takes the next."""
    if total > size and size >= rounds * n:
        return np.arange(rounds * n).reshape(rounds, n)
    if size <= 4 * n:
        return np.argsort(rng.random((rounds, size)), axis=1)[:, :n]
    d = rng.integers(0, size, (rounds, n))
    while True:  # subsets that hold a place twice are drawn again
        s = np.sort(d, axis=1)
        twice = (s[:, 1:] == s[:, :-1]).any(1)
        if not twice.any():
            return d
        d[twice] = rng.integers(0, size, (int(twice.sum()), n))


def nelder_mead_many(f, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nelder_mead`` for many problems at once: f(points (m, d), which problem (m,)) gives m values."""
    b, n = start.shape
    expand, contract, shrink = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
    s = np.repeat(start[:, None, :], n + 1, axis=1)
    for i in range(n):
        s[:, i + 1, i] = np.where(start[:, i] == 0, 0.00025, start[:, i] * 1.05)
    every = np.arange(b)
    v = f(s.reshape(-1, n), np.repeat(every, n + 1)).reshape(b, n + 1)
    before, done = v.min(1), np.zeros(b, bool)
    live = every
    for _ in range(MAX_ITERATIONS):
        order = np.argsort(v[live], axis=1, kind="stable")
        sl, vl = np.take_along_axis(s[live], order[:, :, None], 1), np.take_along_axis(v[live], order, 1)
        middle = sl[:, :-1].mean(1)
        r = 2 * middle - sl[:, -1]
        fr = f(r, live)
        # one further trial point per problem: outwards, or towards the middle from either side
        better, poor = fr < vl[:, 0], fr >= vl[:, -2]
        outer = poor & (fr < vl[:, -1])
        t = np.where(better[:, None], middle + expand * (r - middle), np.where(outer[:, None], middle + contract * (r - middle), middle - contract * (middle - sl[:, -1])))
        ft = np.full(len(live), np.inf)
        need = better | poor
        if need.any():
            ft[need] = f(t[need], live[need])
        use_t = (better & (ft < fr)) | (outer & (ft <= fr)) | (poor & ~outer & (ft < vl[:, -1]))
        use_r = ~use_t & ~poor
        sl[use_t, -1], vl[use_t, -1] = t[use_t], ft[use_t]
        sl[use_r, -1], vl[use_r, -1] = r[use_r], fr[use_r]
        small = np.flatnonzero(~use_t & ~use_r)
        if len(small):
            sl[small, 1:] = sl[small, :1] + shrink * (sl[small, 1:] - sl[small, :1])
            vl[small, 1:] = f(sl[small, 1:].reshape(-1, n), np.repeat(live[small], n)).reshape(-1, n)
        s[live], v[live] = sl, vl
        still = np.abs(before[live] - vl.max(1)) > TOLERANCE
        before[live] = vl.min(1)
        done[live[~still]] = True
        live = live[still]
        if not len(live):
            break
    at = v.argmin(1)
    return s[every, at], v[every, at], done


def fit_many(clouds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``fit_nm`` of many clouds of one size, (b, n, 3)."""
    q = clouds - np.sort(clouds, axis=1)[:, clouds.shape[1] // 2, :][:, None, :]
    return minimise_many(_cylinder_planes, list(q), np.tile(CYLINDER_START, (len(q), 1)), False)


def fit_ransac(points: np.ndarray, n: int, inliers: float, conf: float, rng: np.random.Generator, total: int | None = None) -> tuple[np.ndarray, float]:
    if len(points) <= n:
        return fit_nm(points)
    p, e = fit_many(points[_draws(len(points), total or len(points), _rounds(5, n, inliers, conf), n, rng)])
    k = int(e.argmin())
    return p[k], float(e[k])


def circles_ls(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(cx, cy, r, sum of squared residuals) of the algebraic circle through each row of points; NaN where
    the points lie on a line."""
    mx, my = x.mean(1, keepdims=True), y.mean(1, keepdims=True)
    u, v = x - mx, y - my
    suu, svv, suv = (u * u).sum(1), (v * v).sum(1), (u * v).sum(1)
    z = u * u + v * v
    bu, bv = (u * z).sum(1), (v * z).sum(1)
    det = suu * svv - suv * suv
    det = np.where(np.abs(det) > 1e-12 * np.maximum(suu * svv, 1e-300), det, np.nan)
    a, b = (bu * svv - bv * suv) / (2 * det), (bv * suu - bu * suv) / (2 * det)
    r = np.sqrt(a * a + b * b + z.mean(1))
    err = ((np.hypot(u - a[:, None], v - b[:, None]) - r[:, None]) ** 2).sum(1)
    return np.column_stack([a + mx[:, 0], b + my[:, 0], r, err])


def ransac_circle(x: np.ndarray, y: np.ndarray, n: int, inliers: float, conf: float, n_best: int, rng: np.random.Generator, total: int | None = None) -> np.ndarray:
    """(x, y, radius, err) from many subsets: the best one, or the median of the n_best + 2 best. The error
    divides by the size of the whole group, ``total``, of which x and y may be the first in random order."""
    k = _rounds(n_best + 5, n, inliers, conf)
    draws = _draws(len(x), total or len(x), k, n, rng)
    c = circles_ls(x[draws], y[draws])
    c[:, 3] = np.sqrt(c[:, 3] / (total or len(x)))
    c = c[np.isfinite(c).all(1)]
    if not len(c):
        return np.full(4, np.nan)
    c = c[np.argsort(c[:, 3], kind="stable")]
    return c[0] if n_best <= 0 or k < n_best else np.array([upper_median(c[: n_best + 2, i]) for i in range(4)])


def rotation(ax: float, ay: float) -> np.ndarray:
    """Turn by ax degrees about x, then ay about y, for row vectors."""
    a, b = math.radians(ax), math.radians(ay)
    rx = np.array([[1, 0, 0], [0, math.cos(a), math.sin(a)], [0, -math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]])
    return ry @ rx


def _distinct(size: int, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """(n, rounds): places of subsets, each drawn from those that its subset hasn't taken yet."""
    kind = np.uint16 if size < 1 << 16 else np.uint32
    out = np.empty((n, rounds), kind)
    taken: list[np.ndarray] = []  # of each subset, in ascending order
    for i in range(n):
        d = rng.integers(0, size - i, rounds, dtype=kind)
        for t in taken:
            d += d >= t
        out[i] = d
        up = d
        for j, t in enumerate(taken):
            taken[j], up = np.minimum(t, up), np.maximum(t, up)
        taken.append(up)
    return out


def tilted_circles(points: np.ndarray, ax: int, ays: np.ndarray, n: int, inliers: float, conf: float, n_best: int, rng: np.random.Generator, total: int | None = None) -> np.ndarray:
    """(x, y, radius, err, ax, ay): ``ransac_circle`` of the cloud turned by ax and each of ``ays``, subsets drawn
    anew for each; the best, the first on ties."""
    size, k, turns = len(points), _rounds(n_best + 5, n, inliers, conf), len(ays)
    if (total or size) > size and size >= k * n:
        draws = np.tile(np.arange(k * n).reshape(k, n).T, turns)
    else:
        draws = _distinct(size, n, k * turns, rng)
    # as rotation(ax, ay), written out
    a, b = math.radians(ax), np.repeat(np.radians(ays), k)
    sa, ca, sb, cb = math.sin(a), math.cos(a), np.sin(b), np.cos(b)
    px, pz = points[:, 0].take(draws), points[:, 2].take(draws)
    u, v = px * cb, (points[:, 1] * ca).take(draws)
    t = pz * sb
    u += t
    v += np.multiply(px, sb * sa, out=t)
    v -= np.multiply(pz, cb * sa, out=t)
    mx, my = u.sum(0) / n, v.sum(0) / n
    u -= mx
    v -= my
    uu, vv = np.multiply(u, u, out=px), np.multiply(v, v, out=pz)
    suu, svv, suv = uu.sum(0), vv.sum(0), np.multiply(u, v, out=t).sum(0)
    z = np.add(uu, vv, out=uu)
    bu, bv = np.multiply(u, z, out=t).sum(0), np.multiply(v, z, out=vv).sum(0)
    square = suu * svv
    det = square - suv * suv
    det = np.where(np.abs(det) > 1e-12 * np.maximum(square, 1e-300), 2 * det, np.nan)
    cx, cy = (bu * svv - bv * suv) / det, (bv * suu - bu * suv) / det
    r = np.sqrt(cx * cx + cy * cy + (suu + svv) / n)
    u -= cx
    v -= cy
    u *= u
    v *= v
    u += v
    np.sqrt(u, out=u)
    u -= r
    u *= u
    err = np.sqrt(u.sum(0) / (total or size)).reshape(turns, k)
    err = np.where(np.isfinite(err), err, np.inf)
    # of each tilt the error that stands for it: the least, or the upper median of the n_best + 2 least
    counts = np.isfinite(err).sum(1)
    rank = np.zeros(turns, int) if n_best <= 0 or k < n_best else np.minimum(counts, n_best + 2) // 2
    chosen = np.unique(rank)
    errors = np.partition(err, chosen, axis=1)[np.arange(turns), rank]
    j = int(errors.argmin())
    if not np.isfinite(errors[j]):
        return np.full(6, np.nan)
    best = np.argsort(err[j], kind="stable")[: int(counts[j])]
    c = np.column_stack([(cx + mx).reshape(turns, k)[j], (cy + my).reshape(turns, k)[j], r.reshape(turns, k)[j], err[j]])[best]
    c = c[0] if n_best <= 0 or k < n_best else np.array([upper_median(c[: n_best + 2, i]) for i in range(4)])
    return np.array([*c, ax, ays[j]])


def fit_tilted(points: np.ndarray, n: int, inliers: float, conf: float, max_angle: int, n_best: int, rng: np.random.Generator, total: int | None = None, ax_only: int | None = None) -> np.ndarray:
    """(x, y, radius, err, ax, ay): of all whole-degree tilts the one with the best circle, the first on ties;
    of the tilts about x only ``ax_only`` if that is given."""
    n = min(n, len(points) - 1) if len(points) > 3 else 3
    best = np.full(6, np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        for ax in range(-max_angle, max_angle + 1) if ax_only is None else (ax_only,):
            for ay in range(-max_angle, max_angle + 1, TURNS):
                c = tilted_circles(points, ax, np.arange(ay, min(ay + TURNS, max_angle + 1)), n, inliers, conf, n_best, rng, total)
                if np.isfinite(c[3]) and not c[3] >= best[3]:
                    best = c
    return best


def fit_cylinder(points: np.ndarray, method: str = "ransac", n: int = 5, inliers: float = 0.9, conf: float = 0.95, max_angle: int = 30, n_best: int = 20, seed: int = 0, total: int | None = None, ax: int | None = None) -> np.ndarray | None:
    """Parameters of one cloud (k, 3), named by CYLINDER without px, py, pz, or by TILTED for ``bf``; None
    for fewer than three points. ``total`` is the size of the group of which these are the first in random
    order, ``ax`` the only tilt about x that bf tries."""
    if len(points) < 3:
        return None
    rng = np.random.default_rng(seed)
    if method == "bf":
        return fit_tilted(points, n, inliers, conf, max_angle, n_best, rng, total, ax)
    if method == "ransac":
        p, e = fit_ransac(points, n, inliers, conf, rng, total)
    elif method in ("nm", "irls"):
        p, e = (fit_nm if method == "nm" else fit_irls)(points)
    else:
        raise ValueError("method must be nm, irls, ransac or bf")
    return np.array([*p, e])


def _circle_start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    start = circles_ls(x[None], y[None])[0, :3]
    return start if np.isfinite(start).all() else np.array([x.mean(), y.mean(), 0.0])


def circle_nm(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """((cx, cy, r), error): least squares of the distances from the circle by Nelder-Mead, from the
    algebraic circle or a given start."""
    w = np.ones(len(x)) if weights is None else weights
    if start is None:
        start = _circle_start(x, y)
    p, v, done = nelder_mead(lambda c: float((w * (np.hypot(x - c[0], y - c[1]) - c[2]) ** 2).sum()), start)
    p[2] = abs(p[2])
    return p, v if done else math.inf


def circle_irls(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """``circle_nm`` with bisquare weights until the error stays."""
    p, last, w = None, math.inf, np.ones(len(x))
    for _ in range(100):
        p, err = circle_nm(x, y, w, p)
        w = tukey((np.hypot(x - p[0], y - p[1]) - p[2]) ** 2)
        if not math.isfinite(err) or abs(err - last) < 1e-6:
            break
        last = err
    return p, err


def fit_circles(points: DataFrame, key: str, method: str = "irls", n: int = 5, inliers: float = 0.9, conf: float = 0.95, n_best: int = 0, seed: int = 0) -> DataFrame:
    """(key, cx, cy, radius, err) per group of (key, id, x, y) by ``nm``, ``irls`` or ``ransac``; groups of
    fewer than three points and null keys have no row."""
    if method not in ("nm", "irls", "ransac"):
        raise ValueError("method must be nm, irls or ransac")
    rows = points.where(F.col(key).isNotNull() & is_number(F.col("x")) & is_number(F.col("y"))).select(key, "id", "x", "y")
    kind = rows.schema[key].dataType.simpleString()
    if method == "ransac":
        rows = subset_rows(rows, key, _rounds(n_best + 5, n, inliers, conf) * n, seed)

    if method != "ransac":

        def many(keys: list, groups: list[pd.DataFrame]):
            clouds = [f[["x", "y"]].to_numpy() for f in groups]
            p, e = minimise_many(_circle_planes, clouds, np.array([_circle_start(c[:, 0], c[:, 1]) for c in clouds]), method == "irls")
            yield pd.DataFrame({key: keys, **dict(zip(("cx", "cy", "radius"), p.T)), "err": e})

        return _fit_stacks(rows, key, "id", many, f"`{key}` {kind}, cx double, cy double, radius double, err double")

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_order")
        x, y = f["x"].to_numpy(), f["y"].to_numpy()
        out = []
        if len(x) > 2:
            p = ransac_circle(x, y, min(n, len(x) - 1) if len(x) > 3 else 3, inliers, conf, n_best, np.random.default_rng(_seed(k[0], seed)), int(f["_total"].iloc[0]))
            out = [[k[0], *map(float, p)]]
        return pd.DataFrame(out, columns=[key, "cx", "cy", "radius", "err"])

    return spread(rows, key).groupBy(key).applyInPandas(run, f"`{key}` {kind}, cx double, cy double, radius double, err double")


def _fit_stacks(rows: DataFrame, key: str, order: str, fit, schema: str) -> DataFrame:
    """``fit(keys, groups)`` of whole groups of at least three rows, in the given order, many at a time; it
    yields frames."""

    def run(frames):
        for t in _whole_groups(frames, key):
            codes = pd.factorize(t[key])[0]
            ends = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
            groups = [t.iloc[i:j] for i, j in zip([0, *ends[:-1]], ends) if j - i > 2]
            if groups:
                yield from fit([f[key].iloc[0] for f in groups], groups)

    return spread(rows, key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def _whole_groups(frames, key: str):
    """Frames joined until they hold STACK_ROWS rows, cut where a group ends."""
    held, n, limit = [], 0, STACK_ROWS
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= limit:
            t = pd.concat(held, ignore_index=True)
            codes = pd.factorize(t[key])[0]
            cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if codes[0] != codes[-1] else 0
            if cut:
                yield t.iloc[:cut]
            held, n = [t.iloc[cut:]], len(t) - cut
            limit = max(STACK_ROWS, 2 * n)  # a large group isn't copied for every frame
    if n:
        yield pd.concat(held, ignore_index=True)


def subset_rows(points: DataFrame, key: str, needed: int, seed: int = 0) -> DataFrame:
    """Rows for random subsets of ``needed`` points altogether, with the size ``_total`` of their group and a
    random ``_order``: all rows of a group of at most WHOLE_POINTS or ``needed`` rows, else the first ones."""
    size = max(WHOLE_POINTS, needed)
    total = points.groupBy(key).agg(F.count("*").alias("_total"))
    order = hash01(seed, F.col("id"))
    first = points.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, "id"))).where(F.col("_r") <= size)
    # of a larger group no more than needed; a smaller one in order of its ids, for the draws to come
    return first.join(total, key).where((F.col("_total") <= size) | (F.col("_r") <= needed)).withColumn("_order", F.when(F.col("_total") <= size, F.col("id")).otherwise(F.col("_r"))).drop("_r")


def fit_groups(points: DataFrame, key: str, method: str = "ransac", n: int = 5, inliers: float = 0.9, conf: float = 0.95, max_angle: int = 30, n_best: int = 20, seed: int = 0) -> DataFrame:
    """(key, parameters...): one fit per group of (key, id, x, y, z). Groups of fewer than three points and
    null keys have no row. px, py, pz are the middle of the bounding box of the whole group."""
    if method not in ("nm", "irls", "ransac", "bf"):
        raise ValueError("method must be nm, irls, ransac or bf")
    rows = points.where(F.col(key).isNotNull())
    for c in "xyz":
        rows = rows.where(is_number(F.col(c)))
    names = TILTED if method == "bf" else CYLINDER[:6]
    kind = rows.schema[key].dataType.simpleString()

    needed = n * _rounds(n_best + 5 if method == "bf" else 5, n, inliers, conf)
    cols = rows.select(key, "id", "x", "y", "z")
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names)
    if method == "bf":
        # stored, as its groups are counted; where they are few, tilts about x go to tasks of their own
        sample = Workspace(points.sparkSession, "tilts").put("rows", subset_rows(cols, key, needed, seed))
        tasks, turns = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * max_angle + 1
        parts = min(turns, math.ceil(4 * tasks / max(1, sample.select(key).distinct().count())))
        if parts > 1:
            sample = sample.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def tilts(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("_order")
            p, total = f[["x", "y", "z"]].to_numpy(), int(f["_total"].iloc[0])
            if len(p) < 3:
                return pd.DataFrame([], columns=[key, *names])
            each = [fit_tilted(p, n, inliers, conf, max_angle, n_best, np.random.default_rng(_seed(f"{k[0]}/{ax}", seed)), total, ax) for ax in range(-max_angle + (k[1] if parts > 1 else 0), max_angle + 1, parts)]
            return pd.DataFrame([[k[0], *c] for c in each if np.isfinite(c[3])], columns=[key, *names])

        by = [key, "_part"][: 1 + (parts > 1)]
        best = spread(sample, *by).groupBy(*by).applyInPandas(tilts, schema).groupBy(key).agg(F.min(F.struct("err", "ax", "ay", "x", "y", "radius")).alias("m"))
        return best.select(key, *[F.col("m." + c).alias(c) for c in TILTED])

    def many(keys: list, groups: list[pd.DataFrame]):
        clouds = [f[["x", "y", "z"]].to_numpy() for f in groups]
        if method != "ransac":
            p, e = fit_cylinders(clouds, method == "irls")
            yield pd.DataFrame({key: keys, **dict(zip(names, p.T)), "err": e})
            return
        small = [i for i, c in enumerate(clouds) if len(c) <= n]
        if small:
            p, e = fit_cylinders([clouds[i] for i in small])
            yield pd.DataFrame({key: [keys[i] for i in small], **dict(zip(names, p.T)), "err": e})
        rounds = _rounds(5, n, inliers, conf)
        large = [i for i, c in enumerate(clouds) if len(c) > n]
        some = max(1, TOGETHER // rounds)
        for part in (large[i : i + some] for i in range(0, len(large), some)):
            subsets = np.concatenate([clouds[i][_draws(len(clouds[i]), int(groups[i]["_total"].iloc[0]), rounds, n, np.random.default_rng(_seed(keys[i], seed)))] for i in part])
            p, e = fit_many(subsets)
            best = e.reshape(-1, rounds).argmin(1) + np.arange(len(part)) * rounds
            yield pd.DataFrame({key: [keys[i] for i in part], **dict(zip(names, p[best].T)), "err": e[best]})

    # nm and irls fit all points, one group in one task
    fit = _fit_stacks(subset_rows(cols, key, needed, seed), key, "_order", many, schema) if method == "ransac" else _fit_stacks(cols, key, "id", many, schema)
    box = rows.groupBy(key).agg(*[((F.min(c) + F.max(c)) / 2).alias("p" + c) for c in "xyz"])
    return fit.join(box, key)


def _seed(key, seed: int) -> int:
    """The same for a key in every process."""
    h = 1469598103934665603
    for b in f"{key}|{seed}".encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def algebraic_circles(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, r, n): the algebraic least-squares circle of each group of (key, x, y), from sums about
    the mean; null for points on a line and for fewer than three."""
    m = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = points.select(key, "x", "y").join(m, key).withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    u, v = F.col("u"), F.col("v")
    z = u * u + v * v
    s = d.groupBy(key).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("suu"), F.sum(v * v).alias("svv"), F.sum(u * v).alias("suv"), F.sum(u * z).alias("bu"), F.sum(v * z).alias("bv"), F.avg(z).alias("mz"))
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    det = F.when((F.col("n") >= 3) & (det > 1e-12 * F.col("suu") * F.col("svv")), det)
    a = (F.col("bu") * F.col("svv") - F.col("bv") * F.col("suv")) / (2 * det)
    b = (F.col("bv") * F.col("suu") - F.col("bu") * F.col("suv")) / (2 * det)
    return s.withColumn("a", a).withColumn("b", b).select(key, (F.col("mx") + F.col("a")).alias("cx"), (F.col("my") + F.col("b")).alias("cy"), F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("mz")).alias("r"), "n")


def landau_circle(x: np.ndarray, y: np.ndarray, rounds: int = 50, eps: float = 1e-8) -> tuple[float, float, float]:
    """Centre and radius by Landau's fixed-point iteration on geometric distances."""
    mx, my = x.mean(), y.mean()
    a, b = mx, my
    for _ in range(rounds):
        dx, dy = x - a, y - b
        d = np.maximum(np.hypot(dx, dy), 1e-300)
        r = d.mean()
        a2, b2 = mx + r * (-(dx / d)).mean(), my + r * (-(dy / d)).mean()
        if abs(a2 - a) + abs(b2 - b) < eps:
            a, b = a2, b2
            break
        a, b = a2, b2
    return float(a), float(b), float(np.hypot(x - a, y - b).mean())


def landau_groups(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, r) of each group of (key, id, x, y), from all its points."""
    kind = points.schema[key].dataType.simpleString()

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        return pd.DataFrame([[k[0], *landau_circle(f["x"].to_numpy(), f["y"].to_numpy())]], columns=[key, "cx", "cy", "r"])

    return spread(points.select(key, "id", "x", "y"), key).groupBy(key).applyInPandas(run, f"`{key}` {kind}, cx double, cy double, r double")
