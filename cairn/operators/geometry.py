"""Multi-view geometry in NumPy, over arrays of correspondences; and its kernels as DataFrame operators.

Cameras map p to K (R p + t). Random sampling is seeded, so results do not depend on scheduling.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def projection(k: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return k @ np.hstack([r, t.reshape(3, 1)])


def triangulate(p1: np.ndarray, p2: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Points (n, 3) from pixels in two views, by the linear method; points at infinity become very far ones."""
    a = np.stack([u1[:, :1] * p1[2] - p1[0], u1[:, 1:] * p1[2] - p1[1], u2[:, :1] * p2[2] - p2[0], u2[:, 1:] * p2[2] - p2[1]], axis=1)
    x = np.linalg.svd(a)[2][:, -1]
    w = np.where(np.abs(x[:, 3:]) < 1e-12, 1e-12, x[:, 3:])
    return x[:, :3] / w


def reprojection(k: np.ndarray, r: np.ndarray, t: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pixel errors; infinite for points at or behind the camera."""
    c = x @ r.T + t
    with np.errstate(divide="ignore", invalid="ignore"):
        uv = c[:, :2] / c[:, 2:] * [k[0, 0], k[1, 1]] + [k[0, 2], k[1, 2]]
        e = np.linalg.norm(uv - u, axis=1)
    return np.where(c[:, 2] > 1e-8, e, np.inf)


def angles(c1: np.ndarray, c2: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Degrees between the rays from two centres to each point."""
    a, b = x - c1, x - c2
    cos = (a * b).sum(1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-12)
    return np.degrees(np.arccos(np.clip(cos, -1, 1)))


def rotation(w: np.ndarray) -> np.ndarray:
    """The rotation matrix of a rotation vector."""
    theta = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if theta < 1e-12:
        return np.eye(3) + k
    k = k / theta
    return np.eye(3) + np.sin(theta) * k + (1 - np.cos(theta)) * k @ k


def _normalizer(u: np.ndarray) -> np.ndarray:
    center, spread = u.mean(0), max(np.sqrt(2) / max(np.linalg.norm(u - u.mean(0), axis=1).mean(), 1e-12), 1e-12)
    return np.array([[spread, 0, -spread * center[0]], [0, spread, -spread * center[1]], [0, 0, 1]])


def _homogeneous(u: np.ndarray) -> np.ndarray:
    return np.hstack([u, np.ones((len(u), 1))])


def _least(m: np.ndarray) -> np.ndarray:
    """The right singular vector of the least singular value; of many rows only their triangular factor, with as few as columns, is decomposed."""
    return np.linalg.svd(np.linalg.qr(m, mode="r") if len(m) > m.shape[1] else m)[2][-1]


def fundamental(u1: np.ndarray, u2: np.ndarray, singular: tuple[float, ...] | None = None) -> np.ndarray:
    """The matrix F with u2' F u1 = 0 of eight or more matches; `singular` (1, 1, 0) makes it an essential one."""
    t1, t2 = _normalizer(u1), _normalizer(u2)
    a, b = _homogeneous(u1) @ t1.T, _homogeneous(u2) @ t2.T
    f = _least(np.einsum("ni,nj->nij", b, a).reshape(len(a), 9)).reshape(3, 3)
    f = t2.T @ f @ t1 if singular else f
    p, s, q = np.linalg.svd(f)
    f = p @ np.diag(singular or (s[0], s[1], 0)) @ q
    return f if singular else t2.T @ f @ t1


def sampson(f: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """First-order distances of matches from the epipolar constraint."""
    a, b = _homogeneous(u1) @ f.T, _homogeneous(u2) @ f
    top = (_homogeneous(u2) * a).sum(1)
    return np.abs(top) / np.sqrt(np.maximum(a[:, 0] ** 2 + a[:, 1] ** 2 + b[:, 0] ** 2 + b[:, 1] ** 2, 1e-24))


def consensus(n: int, size: int, seed: int, fit, error, limit: float, rounds: int = 1000, confidence: float = 0.9999):
    """The model with the smallest truncated error over random samples, refitted to its inliers: (model, inlier mask)."""
    if n < size:
        return None, np.zeros(n, bool)
    rng, best, best_cost, need, k = np.random.default_rng(seed), None, np.inf, rounds, 0
    while k < min(need, rounds):
        k += 1
        model = fit(rng.choice(n, size, replace=False))
        if model is None:
            continue
        e = error(model)
        cost = np.minimum(e, limit).sum()
        if cost < best_cost:
            best, best_cost = model, cost
            share = min((e < limit).mean() ** size, 1 - 1e-12)
            need = np.log(1 - confidence) / np.log1p(-share) if share > 1e-12 else rounds
    if best is None:
        return None, np.zeros(n, bool)
    mask = error(best) < limit
    for _ in range(3):
        if mask.sum() < size:
            break
        again = fit(np.flatnonzero(mask))
        if again is None or (new := error(again) < limit).sum() < mask.sum():
            break
        best, mask = again, new
    return best, mask


#: Quantile of a residual's distribution, in standard deviations, beyond which it says nothing for a model (0.99, four degrees of freedom).
REACH = 3.64
#: Inliers lie within so many standard deviations of their own noise, which is this many pixels at least.
INLIER, LEAST_NOISE = 3.0, 0.05
#: Samples solved at once, and in all; chance to have drawn a clean one.
SAMPLES, ROUNDS, CONFIDENCE = 256, 8192, 0.9999
#: Matches that models of samples are compared on before those that are behind go, and ranges of residuals for that.
SLICE, LEVELS = 256, 4096
#: Steps of reweighted fits after a model that beats all before, and at the end.
POLISH, FINISH = 4, 20


@lru_cache(maxsize=1)
def _marginal() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, weight, loss) for residuals r in units of the largest noise, averaged over all noise levels up to it.

    The weight of a residual is the density of a chi distribution with four degrees of freedom, integrated over levels that
    are uniform from zero: an upper incomplete gamma function of 3/2, less its value at REACH. The loss is the integral of
    r times the weight, one where the weight has reached zero.
    """

    def upper(x: np.ndarray) -> np.ndarray:
        return np.sqrt(x) * np.exp(-x) + np.sqrt(np.pi) / 2 * np.array([math.erfc(v) for v in np.sqrt(x)])

    r = np.linspace(0, REACH, 2049)
    weight = upper(r * r / 2) - upper(np.array([REACH**2 / 2]))
    steps = r * weight
    loss = np.concatenate([[0], np.cumsum((steps[1:] + steps[:-1]) / 2)])
    return r, weight / weight[0], loss / loss[-1]


@lru_cache(maxsize=1)
def _least_loss() -> np.ndarray:
    """The loss at the lower ends of LEVELS equal ranges of squared residuals, in units of the largest noise, and one beyond them."""
    r, _, loss = _marginal()
    return np.append(np.interp(np.sqrt(np.arange(LEVELS) * (REACH**2 / LEVELS)), r, loss), 1.0)


def _sampled(u1: np.ndarray, u2: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Fundamental matrices (b, 3, 3) of samples (b, 8) of normalised matches."""
    a, b = _homogeneous(u1)[picks], _homogeneous(u2)[picks]
    # What eight equations leave is the last column of the orthogonal factor.
    f = np.linalg.qr((b[:, :, :, None] * a[:, :, None, :]).reshape(len(picks), -1, 9).transpose(0, 2, 1), mode="complete")[0][:, :, -1].reshape(-1, 3, 3)
    p, s, q = np.linalg.svd(f)
    s[:, 2] = 0
    return (p * s[:, None, :]) @ q


def _weighted(u1: np.ndarray, u2: np.ndarray, w: np.ndarray) -> np.ndarray:
    f = _least((_homogeneous(u2)[:, :, None] * _homogeneous(u1)[:, None, :]).reshape(len(u1), 9) * np.sqrt(w)[:, None]).reshape(3, 3)
    p, s, q = np.linalg.svd(f)
    return p @ np.diag([s[0], s[1], 0]) @ q


def noise_inliers(e: np.ndarray, reach: float) -> np.ndarray:
    """Residuals that belong to the noise around zero, none beyond `reach`.

    Its level is taken from the residuals within INLIER levels, from a twentieth of them on, until it stays: so it is that of
    the smallest noise that explains itself, whatever `reach` is.
    """
    within = min(max(INLIER * LEAST_NOISE, float(np.partition(e, k := min(len(e) - 1, max(8, len(e) // 20)))[k])), reach) if len(e) else reach
    mask = e <= within
    for _ in range(100):
        if not mask.any():
            break
        new = e <= min(INLIER * max(1.4826 * float(np.median(e[mask])), LEAST_NOISE), reach)
        if (new == mask).all():
            break
        mask = new
    return mask


def fundamental_ransac(u1: np.ndarray, u2: np.ndarray, limit: float, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The fundamental matrix of matches, many of which may be wrong, and its inliers; None with fewer than eight.

    Models of random samples are compared by losses that are averaged over all noise levels that can reach `limit`, so no
    threshold tells right from wrong; a model that beats all before it is fitted anew with the averaged weights. The noise of
    the best one then says which matches belong to it, so `limit` only has to be large enough.
    """
    n = len(u1)
    if n < 8:
        return None, np.zeros(n, bool)
    t1, t2 = _normalizer(u1), _normalizer(u2)
    a, b = (_homogeneous(u1) @ t1.T)[:, :2], (_homogeneous(u2) @ t2.T)[:, :2]
    r, weight, loss = _marginal()
    most = limit / REACH
    rng, best, cost, drawn, need = np.random.default_rng(seed), None, np.inf, 0, float(ROUNDS)

    def error(f: np.ndarray) -> np.ndarray:
        return sampson(t2.T @ f @ t1, u1, u2)

    def total(e: np.ndarray) -> float:
        return float(np.interp(e / most, r, loss).sum())

    def polished(f: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        found, least = f, total(error(f))
        for _ in range(steps):
            w = np.interp(error(f) / most, r, weight, right=0.0)
            if (w > 0).sum() < 8:
                break
            f = _weighted(a, b, w)
            if (now := total(error(f))) < least:
                found, least = f, now
        return found, least

    # Terms of the constraint, and of its gradients' squares, for products with many models at once.
    mixed = (_homogeneous(b)[:, :, None] * _homogeneous(a)[:, None, :]).reshape(n, 9)
    squares = np.hstack([np.stack([x * x, x * y, y * y, x, y, np.ones(n)], axis=1) for x, y in (a.T, b.T)])

    def ahead(models: np.ndarray) -> np.ndarray:
        """Which models may have less than the least loss so far: the others exceed it by lower bounds over the first matches already."""
        grads = []
        for lines, scale in ((models[:, :2], t2[0, 0]), (models.transpose(0, 2, 1)[:, :2], t1[0, 0])):
            p, q, c = (lines[:, :, k] * scale for k in range(3))
            grads += [(v * w).sum(1) * m for v, w, m in ((p, p, 1), (p, q, 2), (q, q, 1), (p, c, 2), (q, c, 2), (c, c, 1))]
        flat, grads, table = models.reshape(-1, 9).T, np.stack(grads), _least_loss()
        left, so_far = np.arange(len(models)), np.zeros(len(models))
        for at in range(0, n if np.isfinite(cost) else 0, SLICE):
            level = mixed[at : at + SLICE] @ flat[:, left]
            level *= level
            level /= np.maximum(squares[at : at + SLICE] @ grads[:, left], 1e-24)
            level *= LEVELS / limit**2
            so_far = so_far + table[np.minimum(level, LEVELS).astype(np.int32)].sum(0)
            keep = so_far < cost * (1 + 1e-9)
            left, so_far = left[keep], so_far[keep]
            if not len(left):
                break
        return left

    while drawn < min(need, ROUNDS):
        # Eight different ones of n: the least eight of random keys would cost n a sample, so repeats are drawn again.
        picks = rng.integers(0, n, (SAMPLES, 8))
        picks = picks[[len({*row}) == 8 for row in picks.tolist()]] if n > 8 else np.arange(8)[None]
        models = _sampled(a, b, picks) if len(picks) else np.zeros((0, 3, 3))
        # A few at first, so that most are compared with a loss that is not the first one's.
        for some in (models[:4], models[4:32], models[32:]):
            for f in some[ahead(some)]:
                if (now := total(error(f))) >= cost:
                    continue
                f, now = polished(f, POLISH)
                best, cost = f, now
                share = min(noise_inliers(error(f), limit).mean() ** 8, 1 - 1e-12)
                need = math.log(1 - CONFIDENCE) / math.log1p(-share) if share > 1e-12 else ROUNDS
        drawn += SAMPLES
        if n == 8:
            break
    if best is None:
        return None, np.zeros(n, bool)
    best, _ = polished(best, POLISH)
    mask = noise_inliers(error(best), limit)
    # At the end the noise of the inliers takes the place of the limit.
    for _ in range(FINISH):
        e = error(best)
        w = np.interp(e / max(1.4826 * float(np.median(e[mask])) if mask.any() else most, LEAST_NOISE), r, weight, right=0.0)
        if (w > 0).sum() < 8:
            break
        later = _weighted(a, b, w)
        new = noise_inliers(error(later), limit)
        if new.sum() < 8:
            break
        done = (new == mask).all()
        best, mask = later, new
        if done:
            break
    return t2.T @ best @ t1, mask


def normalized(k: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pixels as places in the plane at depth one."""
    return ((u - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]).astype(float)


def depths(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths in two cameras, the first at the origin, at which the rays of normalised places come nearest to each other."""
    p, q = _homogeneous(a) @ r.T, _homogeneous(b)
    pp, qq, pq, pt, qt = (p * p).sum(1), (q * q).sum(1), (p * q).sum(1), p @ t, q @ t
    det = np.maximum(pp * qq - pq * pq, 1e-24)
    return (pq * qt - qq * pt) / det, (pp * qt - pq * pt) / det


def motions(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (R, t) of an essential matrix."""
    p, _, q = np.linalg.svd(e)
    p, q = p * np.sign(np.linalg.det(p)), q * np.sign(np.linalg.det(q))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(r, t) for r in (p @ turn @ q, p @ turn.T @ q) for t in (p[:, 2], -p[:, 2])]


def motion_inliers(k1: np.ndarray, k2: np.ndarray, r: np.ndarray, t: np.ndarray, u1: np.ndarray, u2: np.ndarray, limit: float) -> np.ndarray:
    """Matches that fit the motion from one camera to another within `limit` pixels, and are in front of both."""
    a, b = normalized(k1, u1), normalized(k2, u2)
    e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
    z1, z2 = depths(r, t, a, b)
    return (sampson(e, a, b) * (k1[0, 0] + k2[0, 0]) / 2 < limit) & (z1 > 0) & (z2 > 0)


def motion_angles(k1: np.ndarray, k2: np.ndarray, r: np.ndarray, t: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Degrees at which the points of matches are seen from the two cameras."""
    return angles(np.zeros(3), -r.T @ t, triangulate(projection(k1, np.eye(3), np.zeros(3)), projection(k2, r, t), u1, u2))


def relative_pose(k1: np.ndarray, k2: np.ndarray, u1: np.ndarray, u2: np.ndarray, limit: float, seed: int = 42):
    """(R, t, inlier mask) of the second camera beside one at the origin; R is None without a solution."""
    a, b = normalized(k1, u1), normalized(k2, u2)
    scale = (k1[0, 0] + k2[0, 0]) / 2
    e, mask = consensus(len(a), 8, seed, lambda i: fundamental(a[i], b[i], (1.0, 1.0, 0.0)), lambda m: sampson(m, a, b) * scale, limit)
    best = (None, None, np.zeros(len(a), bool))
    if e is None or mask.sum() < 8:
        return best
    for r, t in motions(e):
        front = motion_inliers(k1, k2, r, t, u1, u2, limit)
        if front.sum() > best[2].sum():
            best = (r, t, front)
    return best


def _pose_dlt(x: np.ndarray, a: np.ndarray):
    """R, t of a camera that sees x at normalised places a, linearly; None for degenerate points."""
    center, spread = x.mean(0), max(np.abs(x - x.mean(0)).max(), 1e-12)
    h = _homogeneous((x - center) / spread)
    zero = np.zeros_like(h)
    m = _least(np.vstack([np.hstack([h, zero, -a[:, :1] * h]), np.hstack([zero, h, -a[:, 1:] * h])])).reshape(3, 4)
    u, s, v = np.linalg.svd(m[:, :3])
    if s[2] < 1e-9 * s[0]:
        return None
    sign = np.sign(np.linalg.det(u @ v))
    r, t = sign * u @ v, sign * m[:, 3] / s.mean() * spread
    return r, t - r @ center


def refine_pose(r: np.ndarray, t: np.ndarray, x: np.ndarray, a: np.ndarray, steps: int = 10):
    """Gauss-Newton on normalised reprojection errors."""
    for _ in range(steps):
        c = x @ r.T + t
        z = c[:, 2:]
        if (np.abs(z) < 1e-9).any():
            return r, t
        e = (a - c[:, :2] / z).ravel()
        j = pose_jacobian(c)
        d = np.linalg.lstsq(j.reshape(-1, 6), e, rcond=None)[0]
        turn = rotation(d[:3])
        r, t = turn @ r, turn @ t + d[3:]
        if np.abs(d).max() < 1e-12:
            break
    return r, t


def pose_jacobian(c: np.ndarray) -> np.ndarray:
    """Derivatives of the normalised image (n, 2) of camera-frame points by a left rotation and a shift: (n, 2, 6)."""
    x, y, z = c.T
    by_c = np.zeros((len(c), 2, 3))
    by_c[:, 0, 0] = by_c[:, 1, 1] = 1 / z
    by_c[:, 0, 2], by_c[:, 1, 2] = -x / z**2, -y / z**2
    turn = np.zeros((len(c), 3, 3))
    turn[:, 0, 1], turn[:, 0, 2], turn[:, 1, 0], turn[:, 1, 2], turn[:, 2, 0], turn[:, 2, 1] = z, -y, -z, x, y, -x
    return np.concatenate([by_c @ turn, by_c], axis=2)


def absolute_pose(k: np.ndarray, x: np.ndarray, u: np.ndarray, limit: float, seed: int = 42):
    """(R, t, inlier mask) of a camera from points and their pixels; R is None with fewer than six inliers."""
    a = (u - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]

    def fit(i):
        pose = _pose_dlt(x[i], a[i])
        return pose and refine_pose(*pose, x[i], a[i], 5)

    model, mask = consensus(len(x), 6, seed, fit, lambda m: reprojection(k, m[0], m[1], x, u), limit)
    if model is None or mask.sum() < 6:
        return None, None, mask
    return (*model, mask)


# Operators


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` in the session's number of partitions by `by`: groups that are small but long to solve are not put together in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *by)


def verify_pairs(matches: DataFrame, features: DataFrame, limit: float = 4.0, least: int = 8, seed: int = 42) -> DataFrame:
    """Matches (i, j, fi, fj) that fit their pair's fundamental matrix; pairs with fewer than `least` inliers go.

    One task-sized group per image pair, whose size the features of an image bound.
    """
    a = features.select(F.col("img").alias("i"), F.col("feat").alias("fi"), F.col("u").alias("ui"), F.col("v").alias("vi"))
    b = features.select(F.col("img").alias("j"), F.col("feat").alias("fj"), F.col("u").alias("uj"), F.col("v").alias("vj"))
    rows = matches.join(a, ["i", "fi"]).join(b, ["j", "fj"]).select("i", "j", "fi", "fj", "ui", "vi", "uj", "vj")

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values(["fi", "fj"])
        i, j = int(pair["i"].iloc[0]), int(pair["j"].iloc[0])
        _, mask = fundamental_ransac(pair[["ui", "vi"]].to_numpy(float), pair[["uj", "vj"]].to_numpy(float), limit, seed + i * 100_003 + j)
        return pair.loc[mask if mask.sum() >= least else np.zeros(len(pair), bool), ["i", "j", "fi", "fj"]]

    kinds = dict(matches.dtypes)
    return rows.groupBy("i", "j").applyInPandas(run, f"i {kinds['i']}, j {kinds['j']}, fi {kinds['fi']}, fj {kinds['fj']}")
