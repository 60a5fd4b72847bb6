"""Camera solvers for images and pairs with more rows than one task should hold.

Samples are drawn from all rows of a key by a hash, models are compared on all of them, and fits are made of what tasks add up:
normal equations, or the triangular factor of the equations. A pass over the rows sends a few numbers for each key; only models
are on the driver. The steps are those of geometry.consensus().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..tables import discard, staged
from . import geometry as G
from .cloud import percentiles

#: Rows that a task takes of one image or pair; more are worked on in passes over them.
TASK = 100_000
#: Samples of the first pass, of a later one, and in all; chance to have drawn a clean one; rounds of fits to inliers, steps of one.
FIRST, MORE, ROUNDS, CONFIDENCE, FITS, STEPS = 16, 112, 1000, 0.9999, 3, 5
#: Rows and models that are compared at once.
ROWS, RANGE = 4096, 1 << 31

Models = dict[int, np.ndarray]


def added(rows: DataFrame, kernel: Callable[[int, np.ndarray], np.ndarray], add: Callable[[list[np.ndarray]], np.ndarray] = sum) -> Models:
    """What `kernel` makes of the values of each key, `add`ed up over runs of ROWS rows, then over tasks. `rows` has key and columns of doubles."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        keys = batch.column(0).to_numpy()
        values = np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1)
        for key in np.unique(keys).tolist():
            own = values[keys == key]
            for at in range(0, len(own), ROWS):
                yield key, kernel(key, own[at : at + ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Models = {}
        for batch in batches:
            for key, v in parts(batch):
                found[key] = add([found[key], v]) if key in found else v
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([v.astype(float).tobytes() for v in found.values()], pa.binary())], ["key", "v"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total = add([np.frombuffer(v) for v in group.column("v").to_pylist()])
        return pa.table({"key": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    made = rows.mapInArrow(run, "key int, v binary").groupBy("key").applyInArrow(merge, "key int, v binary")
    return {r["key"]: np.frombuffer(r["v"]) for r in made.collect()}


def _of(rows: DataFrame, keys) -> DataFrame:
    return rows.where(F.col("key").isin([int(k) for k in keys]))


def _samples(rows: DataFrame, ids: list[str], sizes: dict[int, int], size: int, count: int, seed: int) -> Models:
    """About `count` samples of `size` rows of each key, (count, size, columns): rows whose hash is in a share of its range, by hash."""
    n = F.element_at(F.create_map(*[F.lit(v) for k in sizes.items() for v in k]), F.col("key"))
    at = F.pmod(F.xxhash64(F.lit(seed), "key", *ids), F.lit(RANGE))
    taken = _of(rows, sizes).withColumn("at", at).where(F.col("at") < F.lit(float(size * count * RANGE)) / n).orderBy("key", "at").drop(*ids, "at").collect()
    out: Models = {}
    for key in sizes:
        own = np.array([r[1:] for r in taken if r[0] == key], float)
        out[key] = own[: len(own) // size * size].reshape(-1, size, own.shape[-1])
    return out


def consensus(rows: DataFrame, ids: list[str], sizes: dict[int, int], size: int, seed: int, fit: Callable, error: Callable, refit: Callable, limit: float) -> Models:
    """The model of each key with the smallest truncated error over random samples, refitted to its inliers.

    `rows` has key int, `ids` that tell its rows apart, and values; `sizes` the number of rows of each key. fit(key, values) gives a model
    as a flat array, or None; error(key, models, values) a matrix of residuals; refit(rows, models) the models of least squares of the inliers.
    """
    values = rows.drop(*ids)

    def score(models: Models) -> Models:
        """The truncated errors of the models of each key, and the number of their inliers."""

        def run(key: int, v: np.ndarray) -> np.ndarray:
            e = error(key, models[key], v)
            return np.concatenate([np.minimum(e, limit).sum(0), (e < limit).sum(0)])

        return added(_of(values, models), run)

    best: Models = {}
    cost, inliers, need, drawn, pass_ = dict.fromkeys(sizes, np.inf), dict.fromkeys(sizes, 0.0), dict.fromkeys(sizes, float(ROUNDS)), 0, 0
    while left := {k: n for k, n in sizes.items() if drawn < min(need[k], ROUNDS)}:
        count = FIRST if pass_ == 0 else MORE
        models: Models = {}
        for key, samples in _samples(rows, ids, left, size, count, seed + pass_).items():
            made = [m for m in (fit(key, v) for v in samples) if m is not None]
            if made:
                models[key] = np.stack(made)
        for key, total in (score(models) if models else {}).items():
            m = int(np.argmin(total[: len(models[key])]))
            if total[m] < cost[key]:
                best[key], cost[key], inliers[key] = models[key][m], total[m], total[len(models[key]) + m]
                share = min((inliers[key] / sizes[key]) ** size, 1 - 1e-12)
                need[key] = np.log(1 - CONFIDENCE) / np.log1p(-share) if share > 1e-12 else ROUNDS
        drawn, pass_ = drawn + count, pass_ + 1
    open_ = [k for k in best if inliers[k] >= size]
    for _ in range(FITS):
        if not open_:
            break
        later = refit(_of(values, open_), {k: best[k] for k in open_})
        counts = {k: v[1] for k, v in score({k: m[None] for k, m in later.items()}).items()} if later else {}
        for k in [*open_]:
            if counts.get(k, -1) >= inliers[k]:
                best[k] = later[k]
            if counts.get(k, -1) <= inliers[k]:
                open_.remove(k)
            inliers[k] = max(counts.get(k, 0), inliers[k])
    return {k: m for k, m in best.items() if inliers[k] >= size}


# Poses


def absolute_poses(rows: DataFrame, sizes: dict[int, int], intrinsics: dict[int, np.ndarray], limit: float, seed: int = 42) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """(R, t, inliers) of the cameras `key` from rows (key, feat, x, y, z, u, v), as absolute_pose() has them; those without a solution are left out."""

    def places(key: int, v: np.ndarray) -> np.ndarray:
        k = intrinsics[key]
        return (v[:, 3:5] - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]

    def fit(key: int, v: np.ndarray) -> np.ndarray | None:
        pose = G._pose_dlt(v[:, :3], places(key, v))
        return pose and np.concatenate([np.ravel(p) for p in G.refine_pose(*pose, v[:, :3], places(key, v), 5)])

    def error(key: int, models: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.stack([G.reprojection(intrinsics[key], m[:9].reshape(3, 3), m[9:], v[:, :3], v[:, 3:5]) for m in models], axis=1)

    def refit(rows: DataFrame, models: Models) -> Models:
        """Steps of Gauss-Newton on the normalised errors of those that were inliers at first."""
        now = dict(models)
        moving = set(models)
        for _ in range(STEPS):
            at = dict(now)

            def run(key: int, v: np.ndarray, at: Models = at) -> np.ndarray:
                v = v[error(key, models[key][None], v)[:, 0] < limit]
                c = v[:, :3] @ at[key][:9].reshape(3, 3).T + at[key][9:]
                safe = np.abs(c[:, 2]) >= 1e-9
                v, c = v[safe], c[safe]
                e, j = (places(key, v) - c[:, :2] / c[:, 2:]).ravel(), G.pose_jacobian(c).reshape(-1, 6)
                return np.concatenate([(j.T @ j).ravel(), j.T @ e])

            for key, total in added(_of(rows, moving), run).items():
                d = np.linalg.lstsq(total[:36].reshape(6, 6), total[36:], rcond=None)[0]
                turn = G.rotation(d[:3])
                now[key] = np.concatenate([(turn @ now[key][:9].reshape(3, 3)).ravel(), turn @ now[key][9:] + d[3:]])
                if np.abs(d).max() < 1e-12:
                    moving.discard(key)
            if not moving:
                break
        return now

    rows = rows.select("key", "feat", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "u", "v")])
    made = consensus(rows, ["feat"], sizes, 6, seed, fit, error, refit, limit)
    inliers = added(_of(rows.drop("feat"), made), lambda key, v: (error(key, made[key][None], v) < limit).sum(0)) if made else {}
    return {k: (m[:9].reshape(3, 3), m[9:], int(inliers[k][0])) for k, m in made.items() if inliers[k][0] >= 6}


# Pairs


def relative_poses(rows: DataFrame, sizes: dict[int, int], cameras: dict[int, tuple[np.ndarray, np.ndarray]], limit: float, seed: int = 42) -> dict[int, tuple[np.ndarray, np.ndarray, int, float]]:
    """(R, t, inliers, median angle in degrees) of the second camera of each pair `key` from rows (key, fi, fj, ui, vi, uj, vj), as relative_pose() has them."""
    ends = {}

    def places(key: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return G.normalized(cameras[key][0], v[:, :2]), G.normalized(cameras[key][1], v[:, 2:4])

    def fit(key: int, v: np.ndarray) -> np.ndarray:
        return G.fundamental(*places(key, v), (1.0, 1.0, 0.0)).ravel()

    def error(key: int, models: np.ndarray, v: np.ndarray) -> np.ndarray:
        a, b = places(key, v)
        scale = (cameras[key][0][0, 0] + cameras[key][1][0, 0]) / 2
        return np.stack([G.sampson(m.reshape(3, 3), a, b) for m in models], axis=1) * scale

    def moments(key: int, v: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(v)], *[x for p in places(key, v) for x in (p.sum(0), [(p**2).sum()])]])

    def refit(rows: DataFrame, models: Models) -> Models:
        """Each from the triangular factor of its inliers' equations, which is that of the factors of all tasks one on the other."""

        def run(key: int, v: np.ndarray) -> np.ndarray:
            v = v[error(key, models[key][None], v)[:, 0] < limit]
            a, b = (G._homogeneous(p) @ t.T for p, t in zip(places(key, v), ends[key], strict=True))
            return np.linalg.qr(np.vstack([np.zeros((9, 9)), np.einsum("ni,nj->nij", b, a).reshape(len(a), 9)]), mode="r").ravel()

        def stack(parts: list[np.ndarray]) -> np.ndarray:
            return np.linalg.qr(np.vstack([p.reshape(9, 9) for p in parts]), mode="r").ravel()

        out = {}
        for key, factor in added(rows, run, stack).items():
            t1, t2 = ends[key]
            p, _, q = np.linalg.svd(t2.T @ G._least(factor.reshape(9, 9)).reshape(3, 3) @ t1)
            out[key] = (p @ np.diag([1.0, 1.0, 0.0]) @ q).ravel()
        return out

    rows = rows.select("key", "fi", "fj", *[F.col(c).cast("double").alias(c) for c in ("ui", "vi", "uj", "vj")])
    values = rows.drop("fi", "fj")
    for key, m in added(values, moments).items():
        # Scales that make places about as large as one; by their mean square, where geometry takes the mean distance.
        made = []
        for s in (m[1:4], m[4:7]):
            center = s[:2] / m[0]
            spread = np.sqrt(2 / max(s[2] / m[0] - center @ center, 1e-24))
            made.append(np.array([[spread, 0, -spread * center[0]], [0, spread, -spread * center[1]], [0, 0, 1]]))
        ends[key] = tuple(made)
    found = consensus(rows, ["fi", "fj"], sizes, 8, seed, fit, error, refit, limit)
    if not found:
        return {}
    ways = {key: G.motions(m.reshape(3, 3)) for key, m in found.items()}

    def front(key: int, v: np.ndarray) -> np.ndarray:
        return np.array([G.motion_inliers(*cameras[key], *way, v[:, :2], v[:, 2:4], limit).sum() for way in ways[key]])

    counts = added(_of(values, ways), front)
    best = {key: (*ways[key][int(np.argmax(n))], int(n.max())) for key, n in counts.items() if n.max() > 0}

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, v = batch.column(0).to_numpy(), np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1)
            out = np.full(len(v), np.nan)
            for key in np.unique(keys).tolist():
                r, t, _ = best[key]
                at = np.flatnonzero(keys == key)
                at = at[G.motion_inliers(*cameras[key], r, t, v[at, :2], v[at, 2:4], limit)]
                out[at] = G.motion_angles(*cameras[key], r, t, v[at, :2], v[at, 2:4])
            seen = np.isfinite(out)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(seen)), pa.array(out[seen])], ["key", "angle"])

    seen = staged(_of(values, best).mapInArrow(angles, "key int, angle double"), "angles")
    middle = percentiles(seen, {str(key): (F.when(F.col("key") == key, F.col("angle")), 0.5) for key in best})
    discard(seen)
    return {key: (*v, float(middle[str(key)] or 0.0)) for key, v in best.items()}
