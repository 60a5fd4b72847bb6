"""Bundle adjustment: Levenberg-Marquardt on poses, points and one focal factor, with Huber weights.

A point is eliminated where its observations are (Schur complement), so what is left to solve has six unknowns a
camera and one for the focal length. The same kernels serve arrays in one process and a table with a row per
point, which holds the point's own observations: tasks send blocks of the reduced system, a shuffle adds them up by
camera pair, and only cameras and that system are on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..tables import discard, staged
from .geometry import pose_jacobian, rotation

#: Pairs of observations of one point that are multiplied at once, about.
PAIRS = 1 << 16
#: Length of the sums of a camera with itself: its part of the Schur complement and of the system (36 each), gradient,
#: its correction, row of the focal factor and its correction (6 each). Of two cameras: the first 36.
OWN = 96
#: Sums of all: focal diagonal, gradient and their corrections, cost, observations in front, their squared errors.
ALL = 7
#: A step that moves cameras by less than this and helps nothing is the last.
STILL = 1e-13


@dataclass
class Cameras:
    """Poses by ascending image number, focal lengths, centres, and the factor on all focal lengths."""

    names: np.ndarray
    r: np.ndarray
    t: np.ndarray
    f: np.ndarray
    center: np.ndarray
    scale: float = 1.0

    @staticmethod
    def of(intrinsics: dict[int, np.ndarray], poses: dict[int, tuple[np.ndarray, np.ndarray]]) -> Cameras:
        names = sorted(poses)
        k = [intrinsics[c] for c in names]
        return Cameras(np.array(names), np.array([poses[c][0] for c in names]), np.array([np.ravel(poses[c][1]) for c in names]), np.array([[m[0, 0], m[1, 1]] for m in k]), np.array([[m[0, 2], m[1, 2]] for m in k]))

    def moved(self, step: np.ndarray) -> Cameras:
        d = step[:-1].reshape(-1, 6)
        turn = np.array([rotation(v[:3]) for v in d])
        return replace(self, r=turn @ self.r, t=np.einsum("nij,nj->ni", turn, self.t) + d[:, 3:], scale=self.scale + step[-1])

    def poses(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {int(c): (self.r[n], self.t[n]) for n, c in enumerate(self.names)}


@dataclass
class Seen:
    """Points (m, 3) and their observations, sorted by point: number of the camera, of the point, pixel."""

    x: np.ndarray
    cam: np.ndarray
    point: np.ndarray
    uv: np.ndarray

    def portions(self) -> Iterator[Seen]:
        """Runs of points with about PAIRS pairs of observations."""
        n = np.bincount(self.point, minlength=len(self.x))
        ends, last = np.cumsum(n), np.cumsum(n * n) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(last)) + 1).tolist(), len(self.x)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            lo, hi = (ends[a - 1] if a else 0), (ends[z - 1] if z else 0)
            yield Seen(self.x[a:z], self.cam[lo:hi], self.point[lo:hi] - a, self.uv[lo:hi])


def residuals(cams: Cameras, seen: Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixel errors, zero behind the camera; places in camera frames; which are in front."""
    c = np.einsum("nij,nj->ni", cams.r[seen.cam], seen.x[seen.point]) + cams.t[seen.cam]
    ok = c[:, 2] > 1e-8
    z = np.where(ok, c[:, 2], 1.0)
    e = c[:, :2] / z[:, None] * cams.f[seen.cam] * cams.scale + cams.center[seen.cam] - seen.uv
    return np.where(ok[:, None], e, 0.0), c, ok


@dataclass
class Linear:
    """Derivatives at a state, and each point's own system with its damped inverse."""

    e: np.ndarray
    ok: np.ndarray
    w: np.ndarray
    jp: np.ndarray
    jf: np.ndarray
    hpx: np.ndarray
    hfx: np.ndarray
    gx: np.ndarray
    inv: np.ndarray


def linear(cams: Cameras, seen: Seen, damp: float, huber: float, refine_focal: bool) -> Linear:
    e, c, ok = residuals(cams, seen)
    d = np.linalg.norm(e, axis=1)
    w = np.where(ok, np.where(d <= huber, 1.0, huber / np.maximum(d, 1e-12)), 0.0)[:, None, None]
    safe, f = np.where(ok[:, None], c, [0.0, 0.0, 1.0]), cams.f[seen.cam]
    jp = pose_jacobian(safe) * (f * cams.scale)[:, :, None]
    jx = jp[:, :, 3:] @ cams.r[seen.cam]
    jf = (safe[:, :2] / safe[:, 2:] * f)[:, :, None] * float(refine_focal)
    back = np.swapaxes(jx, 1, 2)

    def by_point(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(seen.x), *v.shape[1:]))
        np.add.at(out, seen.point, v)
        return out

    hxx = by_point(back @ (w * jx))
    inv = np.linalg.inv(hxx + damp * hxx * np.eye(3) + 1e-9 * np.eye(3))
    return Linear(e, ok, w, jp, jf, np.swapaxes(jp, 1, 2) @ (w * jx), by_point((back @ (w * jf))[:, :, 0]), by_point((back @ (w * e[:, :, None]))[:, :, 0]), inv)


def _by_key(key: np.ndarray, values: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(key, kind="stable")
    found, first = np.unique(key[order], return_index=True)
    return dict(zip(found.tolist(), np.add.reduceat(values[order], first), strict=True)) if len(key) else {}


def _paired(n: int, cam: np.ndarray, point: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[int, np.ndarray]:
    """Sums of left times right transposed over the pairs of observations of one point, by i * n + j of their cameras i <= j."""
    start = np.cumsum(count) - count
    a = np.repeat(np.arange(len(cam)), count[point])
    b = start[point[a]] + np.arange(len(a)) - np.repeat(np.cumsum(count[point]) - count[point], count[point])
    keep = cam[a] <= cam[b]
    a, b = a[keep], b[keep]
    return _by_key(cam[a] * n + cam[b], (left[a] @ np.swapaxes(right[b], 1, 2)).reshape(-1, 36))


def _dense(n: int, cam: np.ndarray, point: np.ndarray, m: int, left: np.ndarray, right: np.ndarray) -> dict[int, np.ndarray]:
    """The same where most cameras see most points: one product of matrices with a place for each camera and point."""
    x, y = np.zeros((n, m, 6, 3)), np.zeros((n, m, 6, 3))
    np.add.at(x, (cam, point), left)
    np.add.at(y, (cam, point), right)
    wide = [np.ascontiguousarray(v.transpose(0, 2, 1, 3)).reshape(6 * n, 3 * m) for v in (x, y)]
    made = (wide[0] @ wide[1].T).reshape(n, 6, n, 6)
    seen = np.zeros((n, m), bool)
    seen[cam, point] = True
    met = seen.astype(np.float32) @ seen.T.astype(np.float32)
    return {i * n + j: made[i, :, j].ravel() for i in range(n) for j in range(i, n) if met[i, j]}


def sums(cams: Cameras, seen: Seen, damp: float, huber: float, refine_focal: bool) -> dict[tuple[int, int], np.ndarray]:
    """What these points add to the reduced system, by camera numbers i <= j; under (-1, -1) the sums of all."""
    n, out, total = len(cams.names), {}, np.zeros(ALL)
    for part in seen.portions():
        s = linear(cams, part, damp, huber, refine_focal)
        cam, point, turned = part.cam, part.point, np.swapaxes(s.jp, 1, 2)
        count = np.bincount(point, minlength=len(part.x))
        left = s.hpx @ s.inv[point]
        blocks = _dense(n, cam, point, len(part.x), left, s.hpx) if n * n * len(part.x) <= 2 * (count**2).sum() else _paired(n, cam, point, count, left, s.hpx)
        own = _by_key(cam, np.concatenate([
            (turned @ (s.w * s.jp)).reshape(-1, 36), (turned @ (s.w * s.e[:, :, None]))[:, :, 0], (left @ s.gx[point][:, :, None])[:, :, 0],
            (turned @ (s.w * s.jf))[:, :, 0], (left @ s.hfx[point][:, :, None])[:, :, 0],
        ], axis=1))
        for key, v in blocks.items():
            i, j = divmod(key, n)
            v = np.concatenate([v, own[i]]) if i == j else v
            out[i, j] = out[i, j] + v if (i, j) in out else v
        d = np.linalg.norm(s.e, axis=1)
        inner = (s.inv @ np.stack([s.hfx, s.gx], axis=2)) if len(part.x) else np.zeros((0, 3, 2))
        total += [
            (s.w * s.jf * s.jf).sum(), (s.w[:, :, 0] * s.jf[:, :, 0] * s.e).sum(), (s.hfx * inner[:, :, 0]).sum(), (s.hfx * inner[:, :, 1]).sum(),
            np.where(d <= huber, d**2 / 2, huber * (d - huber / 2)).sum(), s.ok.sum(), (s.e[s.ok] ** 2).sum(),
        ]
    return out | {(-1, -1): total}


def advanced(cams: Cameras, seen: Seen, damp: float, huber: float, refine_focal: bool, step: np.ndarray) -> np.ndarray:
    """The points after the cameras have taken `step`."""
    d, out = step[:-1].reshape(-1, 6), []
    for part in seen.portions():
        s = linear(cams, part, damp, huber, refine_focal)
        back = s.gx + s.hfx * step[-1]
        np.add.at(back, part.point, (np.swapaxes(s.hpx, 1, 2) @ d[part.cam][:, :, None])[:, :, 0])
        out.append(part.x - (s.inv @ back[:, :, None])[:, :, 0])
    return np.concatenate(out) if out else seen.x


def solved(n: int, parts: dict[tuple[int, int], np.ndarray], damp: float, refine_focal: bool, fixed: int | None) -> np.ndarray:
    """The step of `n` cameras, six values each, and of the focal factor."""
    h, s, g = np.zeros((6 * n + 1, 6 * n + 1)), np.zeros((6 * n + 1, 6 * n + 1)), np.zeros(6 * n + 1)
    for (i, j), v in parts.items():
        if i < 0:
            h[-1, -1], g[-1] = v[0], v[1] - v[3]
            s[-1, -1] = v[2]
            continue
        a, b = slice(6 * i, 6 * i + 6), slice(6 * j, 6 * j + 6)
        s[a, b] = v[:36].reshape(6, 6)
        if i == j:
            h[a, a], g[a] = v[36:72].reshape(6, 6), v[72:78] - v[78:84]
            h[a, -1] = h[-1, a] = v[84:90]
            s[a, -1] = s[-1, a] = v[90:96]
        else:
            s[b, a] = s[a, b].T
    s = h + np.diag(damp * np.diag(h) + 1e-9) - s
    free = np.ones(6 * n + 1, bool)
    free[-1] = refine_focal
    if fixed is not None:
        free[6 * fixed : 6 * fixed + 6] = False
    step = np.zeros(6 * n + 1)
    step[free] = -np.linalg.lstsq(s[np.ix_(free, free)], g[free], rcond=None)[0]
    return step


def levenberg(cams: Cameras, state, build: Callable, advance: Callable, drop: Callable, iterations: int, ftol: float, refine_focal: bool, fixed: int | None):
    """(cameras, state, root mean square before and after). build(cams, state, damp) gives sums(), advance(cams, state, damp, step)
    a state beside the old one, drop(state) is told of states that are needed no more."""

    def rms(parts) -> float:
        total = parts[-1, -1]
        return float(np.sqrt(total[6] / total[5])) if total[5] else 0.0

    damp = 1e-3
    parts = build(cams, state, damp)
    first = rms(parts)
    for _ in range(iterations):
        better = False
        for _ in range(8):
            step = solved(len(cams.names), parts, damp, refine_focal, fixed)
            later, moved, less = advance(cams, state, damp, step), cams.moved(step), max(damp / 5, 1e-9)
            new = build(moved, later, less)
            now, then = parts[-1, -1], new[-1, -1]
            if then[5] >= now[5] and moved.scale > 0.1 and then[4] < now[4]:
                better, gain = True, (now[4] - then[4]) / max(now[4], 1e-12)
                drop(state)
                cams, state, parts, damp = moved, later, new, less
                break
            drop(later)
            if np.abs(step).max() <= STILL * max(1.0, np.abs(cams.t).max()):
                break  # cameras are where rounding leaves them: a shorter step does not help either
            damp *= 5
            parts = build(cams, state, damp)
        if not better or gain < ftol:
            break
    return cams, state, (first, rms(parts))


@dataclass
class Adjustment:
    poses: dict[int, tuple[np.ndarray, np.ndarray]]
    points: np.ndarray
    focal_scale: float
    rms: tuple[float, float]


def bundle_adjust(intrinsics: dict[int, np.ndarray], poses: dict[int, tuple[np.ndarray, np.ndarray]], points: np.ndarray, obs_img: np.ndarray, obs_point: np.ndarray, obs_uv: np.ndarray, iterations: int = 30, huber: float = 2.0, ftol: float = 1e-4, refine_focal: bool = True, fixed: int | None = None) -> Adjustment:
    """Bundle adjustment of arrays in this process. The image `fixed` stays where it is."""
    cams, order = Cameras.of(intrinsics, poses), np.argsort(obs_point, kind="stable")
    seen = Seen(points.astype(float), np.searchsorted(cams.names, np.asarray(obs_img)[order]), np.asarray(obs_point)[order], np.asarray(obs_uv)[order])

    def build(cams: Cameras, seen: Seen, damp: float):
        return sums(cams, seen, damp, huber, refine_focal)

    def advance(cams: Cameras, seen: Seen, damp: float, step: np.ndarray) -> Seen:
        return replace(seen, x=advanced(cams, seen, damp, huber, refine_focal, step))

    cams, seen, rms = levenberg(cams, seen, build, advance, lambda old: None, iterations, ftol, refine_focal, _place(cams, fixed))
    return Adjustment(cams.poses(), seen.x, cams.scale, rms)


def _place(cams: Cameras, fixed: int | None) -> int | None:
    return int(np.searchsorted(cams.names, fixed)) if fixed is not None and fixed in cams.names else None


def _seen(batch: pa.RecordBatch, cams: Cameras) -> Seen:
    x = np.stack([batch.column(c).to_numpy() for c in "xyz"], axis=1)
    n = np.diff(batch.column("img").offsets.to_numpy())
    img, u, v = (batch.column(c).flatten().to_numpy() for c in ("img", "u", "v"))
    return Seen(x, np.searchsorted(cams.names, img), np.repeat(np.arange(len(x)), n), np.stack([u, v], axis=1))


def adjust_scene(intrinsics: dict[int, np.ndarray], poses: dict[int, tuple[np.ndarray, np.ndarray]], points: DataFrame, observations: DataFrame, iterations: int = 30, huber: float = 2.0, ftol: float = 1e-4, refine_focal: bool = True, fixed: int | None = None) -> tuple[dict, DataFrame, float, tuple[float, float]]:
    """(poses, points, focal factor, root mean square before and after) of `points` (track_id, x, y, z) and `observations` (track_id, img, u, v).

    Only observations in images of `poses` count; points without one are returned as they are, with null as with any
    place. A point with its observations is one row; every step writes the rows anew in the shared folder.
    """
    kind = points.select("track_id").dtypes[0][1]
    cams = Cameras.of(intrinsics, poses)
    own = observations.where(F.col("img").isin([int(c) for c in cams.names])).groupBy("track_id").agg(F.collect_list(F.struct("img", "u", "v")).alias("o"))
    rows = points.select("track_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(own.hint("merge"), "track_id", "left")
    lists = [F.coalesce(F.col("o").getField(c).cast(f"array<{t}>"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("img", "int"), ("u", "double"), ("v", "double"))]
    schema = f"track_id {kind}, x double, y double, z double, img array<int>, u array<double>, v array<double>"
    # Every step works on all files: they are dealt for the cores, not by their bytes.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    table = staged(rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("track_id", *"xyz", *lists).repartition(parts, "track_id"), "bundle")

    def build(cams: Cameras, table: DataFrame, damp: float) -> dict[tuple[int, int], np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for key, v in sums(cams, _seen(batch, cams), damp, huber, refine_focal).items():
                    found[key] = found[key] + v if key in found else v
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["i", "j", "v"])

        def add(key: tuple, group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v) for v in group.column("v").to_pylist())
            return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

        added = table.mapInArrow(run, "i int, j int, v binary").groupBy("i", "j").applyInArrow(add, "i int, j int, v binary")
        return {(-1, -1): np.zeros(ALL)} | {(r["i"], r["j"]): np.frombuffer(r["v"]) for r in added.collect()}

    def advance(cams: Cameras, table: DataFrame, damp: float, step: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = advanced(cams, _seen(batch, cams), damp, huber, refine_focal, step)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3)), *batch.columns[4:]], batch.schema.names)

        return staged(table.mapInArrow(run, schema), "bundle")

    cams, table, rms = levenberg(cams, table, build, advance, discard, iterations, ftol, refine_focal, _place(cams, fixed))
    made = table.select("track_id", *"xyz")
    return cams.poses(), made.unionByName(points.where("x IS NULL OR y IS NULL OR z IS NULL").select("track_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])), cams.scale, rms
