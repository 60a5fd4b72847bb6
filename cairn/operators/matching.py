"""Feature matching: features (img int, feat bigint, desc array) to matches (i, j, fi, fj), i < j."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import squared_distance

#: Features of a block of the blocked search.
BLOCK = 2048
#: Blocks of a group, about; groups of columns that the least of a product are looked for in have so many members.
TILES, GROUP = 16, 32
#: Rows of a block that are multiplied at once, so that their rough distances stay in the processor's cache.
STRIP = 256
#: Rough distance of rows that only fill a product up.
FAR = 1e37
#: Stands for no feature; last in any order.
NONE = np.iinfo(np.int64).max


def image_pairs(images: DataFrame, col: str = "img") -> DataFrame:
    """All unordered pairs (i, j), i < j, of distinct images: one row per image takes part, not per feature."""
    ids = images.select(col).distinct()
    a, b = ids.select(F.col(col).alias("i")), ids.select(F.col(col).alias("j"))
    return a.join(b, F.col("i") < F.col("j"))


def nearest_two(features: DataFrame) -> DataFrame:
    """(img, feat, other, d1, d2, nearest): the two nearest features of every other image, by expressions.

    Exact. Each feature meets each of another image once, in either direction; for large images use
    nearest_two_blocked(). Ties go to the lower feature; an image with fewer than two features has no rows as `other`.
    """
    a = features.select("img", "feat", "desc")
    b = features.select(F.col("img").alias("other"), F.col("feat").alias("ofeat"), F.col("desc").alias("odesc"))
    pairs = a.join(b, F.col("img") != F.col("other")).select("img", "feat", "other", "ofeat", F.sqrt(squared_distance("desc", "odesc")).alias("d"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("img", "feat", "other").orderBy("d", "ofeat"))).where("rank <= 2")
    return _two(ranked)


def _two(ranked: DataFrame) -> DataFrame:
    best = ranked.groupBy("img", "feat", "other").agg(
        F.min("d").alias("d1"), F.max("d").alias("d2"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("ofeat"))).alias("nearest")
    )
    return best.where("n = 2").drop("n")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x to rows of y, added up left to right, as the expressions do."""
    d = np.zeros(len(x))
    for k in range(x.shape[1]):
        d += (x[:, k] - y[:, k]) ** 2
    return np.sqrt(d)


def _near(rough: np.ndarray, off: np.ndarray, n: int, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what may be among the two least of each of the first n rows, whose values are off by `off` at most.

    The second least of the minima of groups of columns is not below the second least of all, so only groups with a minimum
    up to it are looked into. With `down` rows and columns change places.
    """
    groups = rough.reshape(GROUP, -1, rough.shape[1]) if down else rough.reshape(len(rough), GROUP, -1)  # every so-many-th one
    least = (groups.min(axis=0).T if down else groups.min(axis=1))[:n]
    limit = np.partition(least, 1, axis=1)[:, 1] + 2 * off[:n]
    row, group = np.nonzero(least <= limit[:, None])
    at, member = np.nonzero((groups[:, group, row].T if down else groups[row, :, group]) <= limit[row, None])
    return row[at], member * least.shape[1] + group[at]


def _pick(row: np.ndarray, feat: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, distances), the two least by distance, then feature, of each of n rows; NONE and NaN where there are fewer."""
    order = np.lexsort((feat, d, row))
    row, feat, d = row[order], feat[order], d[order]
    start = np.searchsorted(row, np.arange(n))
    count = np.searchsorted(row, np.arange(n), side="right") - start
    best, dist = np.full((n, 2), NONE), np.full((n, 2), np.nan)
    for k in range(2):
        has = count > k
        best[has, k], dist[has, k] = feat[start[has] + k], d[start[has] + k]
    return best, dist


def _two_of(x: np.ndarray, y: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, distances), two for each row of x: the nearest rows of y, whose features are `fb`; NONE where y has one row only."""
    return _two_sides(x, y, fb)[0]


def _two_sides(x: np.ndarray, y: np.ndarray, fb: np.ndarray, fa: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(features, distances)], two for each row of x: the nearest rows of y, whose features are `fb`; with `fa` those of x for each row of y, too."""
    bests = [_no_two(len(v)) for v in ((x,) if fa is None else (x, y))]
    _meet(x, y, fb, fa, bests)
    return bests


def _no_two(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, 2), NONE), np.full((n, 2), np.nan)


def _add(best: tuple[np.ndarray, np.ndarray], row: np.ndarray, feat: np.ndarray, d: np.ndarray) -> None:
    """Keeps in `best`, the (features, distances) of each row, the two least of those in it and of the given ones."""
    of, row = np.unique(row, return_inverse=True)
    at, k = np.nonzero(best[0][of] != NONE)
    old = of[at], k
    best[0][of], best[1][of] = _pick(np.concatenate([row, at]), np.concatenate([feat, best[0][old]]), np.concatenate([d, best[1][old]]), len(of))


def _meet(x: np.ndarray, y: np.ndarray, fb: np.ndarray, fa: np.ndarray | None, bests: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds rows of y, whose features are `fb`, to the two nearest of each row of x, bests[0]; with `fa` rows of x to those of y, bests[1].

    A product in single precision finds what may be among the two nearest, whatever its rounding; exact distances decide. Once
    rows have two, only what may be as near as the second is looked at, which in later blocks is next to nothing.
    """
    sides = [(x, y, fb)] + ([(y, x, fa)] if fa is not None else [])
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    if not (np.isfinite(xx).all() and np.isfinite(yy).all() and max(xx.max(initial=0), yy.max(initial=0)) < 1e30):
        for best, side in zip(bests, sides, strict=True):
            _add_two(best, *_two_plain(*side))
        return
    dims, wide = x.shape[1], GROUP * 2
    p, q = (np.zeros((-(-len(v) // wide) * wide, dims + 2), np.float32) for v in (x, y))
    p[: len(x), :dims], p[: len(x), dims], p[:, dims + 1] = -2 * x, xx, 1
    q[: len(y), :dims], q[: len(y), dims + 1], q[:, dims] = y, yy, 1
    p[len(x) :, dims] = q[len(y) :, dims + 1] = FAR
    offs = [(dims + 16) * 2.0**-23 * (np.sqrt(own) + np.sqrt(others.max())) ** 2 + 1e-36 for own, others in ((xx, yy), (yy, xx))[: len(sides)]]
    limits = []  # of the rough distances of rows that have two; None if some have not
    for best, off, padded in zip(bests, offs, (p, q), strict=False):
        second = best[1][:, 1]
        limits.append(None)
        if not np.isnan(second).any():
            limits[-1] = np.full(len(padded), -np.inf, np.float32)
            limits[-1][: len(second)] = np.nextafter((np.minimum(second**2, FAR / 10) + 2 * off).astype(np.float32), np.float32(np.inf))
    hits = [[] for _ in sides]
    if any(limit is None for limit in limits):
        rough = p @ q.T
        for found, off, down, side in zip(hits, offs, (False, True), sides, strict=False):
            found.append(_near(rough, off, len(side[0]), down))
    else:
        for at, row, col, value in _below(p, q, *limits):
            for found, limit, down in zip(hits, limits, (False, True), strict=False):
                mine = value <= (limit[col] if down else limit[at + row])
                found.append((col[mine], at + row[mine]) if down else (at + row[mine], col[mine]))
    for best, found, (of, to, feat) in zip(bests, hits, sides, strict=True):
        row, col = (np.concatenate(v) for v in zip(*found, strict=True))
        keep = col < len(to)
        row, col = row[keep], col[keep]
        if len(row) > 64 * len(of) + 4096:  # many at one place: only two of the same row of numbers count
            few = _two_each(to, feat)
            _add_two(best, *(_two_of(of, to[few], feat[few]) if len(few) < len(to) else _two_plain(of, to, feat)))
        elif len(row):
            _add(best, row, feat[col], _distances(of[row], to[col]))


def _below(p: np.ndarray, q: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, column, value) of the product of p and q, a strip of rows at a time, where it is up to the limit of its row or of its column."""
    rough, hit, other = (np.empty((STRIP, len(q)), t) for t in (np.float32, bool, bool))
    for at in range(0, len(p), STRIP):
        n = min(STRIP, len(p) - at)
        np.matmul(p[at : at + n], q.T, out=rough[:n])
        np.less_equal(rough[:n], rows[at : at + n, None], out=hit[:n])
        if columns is not None:
            np.less_equal(rough[:n], columns, out=other[:n])
            np.logical_or(hit[:n], other[:n], out=hit[:n])
        eight = np.flatnonzero(hit[:n].view(np.uint64))  # few are up to a limit: eight are passed over at once
        one, k = np.nonzero(hit[:n].reshape(-1, 8)[eight])
        row, col = np.divmod(eight[one] * 8 + k, len(q))
        yield at, row, col, rough[row, col]


def _add_two(best: tuple[np.ndarray, np.ndarray], feat: np.ndarray, d: np.ndarray) -> None:
    row, k = np.nonzero(feat != NONE)
    _add(best, row, feat[row, k], d[row, k])


def _two_each(y: np.ndarray, feat: np.ndarray) -> np.ndarray:
    """Places of the two lowest features of each different row of y."""
    group = np.unique(y, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((feat, group))
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(order)) - first < 2])


def _two_plain(x: np.ndarray, y: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by all exact distances, some rows at a time; NaN is last."""
    found, some = [], max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), some):
        n = len(x[at : at + some])
        row, col = np.repeat(np.arange(n), len(y)), np.tile(np.arange(len(y)), n)
        found.append(_pick(row, feat[col], _distances(x[at + row], y[col]), n))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _kind(features: DataFrame) -> str:
    """The type of the numbers of a block: single precision where descriptors have it, which halves what is sent."""
    return "float" if features.schema["desc"].dataType.simpleString() == "array<float>" else "double"


def _blocks(features: DataFrame, block: int) -> DataFrame:
    """(img, part, feat, desc), a row a block: images are cut by hash, a block's numbers lie in two buffers, as a block is sent once for
    each that it meets and arrays are sent number by number; a partition is a group of blocks, mostly of one image."""
    counts = features.groupBy("img").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    total = counts.agg(F.sum("blocks")).first()[0] or 1
    cores = features.sparkSession.sparkContext.defaultParallelism
    groups = min(total, max(math.ceil(math.sqrt(8 * cores)), math.ceil(total / TILES)))
    dealt = features.join(counts, "img").withColumn("part", F.pmod(F.xxhash64("feat"), F.col("blocks")).cast("int")).select("img", "part", "feat", "desc")
    numbers = F.col("desc").cast(f"array<{_kind(features)}>")

    def packed(rows: pa.Table) -> pa.Table:
        numbers = rows.column("desc").combine_chunks().flatten().to_numpy()
        block = [rows.column("feat").to_numpy().astype(np.int64).tobytes(), numbers.tobytes()]
        return pa.table({"img": rows.column("img")[:1], "part": rows.column("part")[:1], **{c: pa.array([v], pa.binary()) for c, v in zip(("feat", "desc"), block, strict=True)}})

    rows = dealt.withColumn("desc", numbers).groupBy("img", "part").applyInArrow(packed, "img int, part int, feat binary, desc binary")
    return rows.repartitionByRange(groups, "img", "part")


def nearest_two_blocked(features: DataFrame, block: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """The same as nearest_two(), with matrix products over blocks of features; `asked` are the features to find them for, if not all.

    Images are cut into blocks of `block` features by hash. A task meets two groups of blocks, of TILES or so each; a pair of
    blocks is multiplied once and answers for both, or for the asked one only. A task keeps the two best of a feature and an
    image, a row for all features of a block, and the best two of all tasks are the answer.
    """
    both = asked is None
    parts = _blocks(features, block)
    own = parts if both else _blocks(asked, block)
    a = own.select(*[F.col(c).alias(f"a_{c}") for c in parts.columns])
    b = parts.select(*[F.col(c).alias(f"b_{c}") for c in parts.columns])
    # A product of partitions: no side is small for sure, and a broadcast one would leave the tasks to the other's size.
    met = a.hint("shuffle_replicate_nl").join(b, F.col("a_img") < F.col("b_img") if both else F.col("a_img") != F.col("b_img"))
    kinds = [np.float32 if _kind(f) == "float" else np.float64 for f in (features if both else asked, features)]

    def unpacked(row: pa.RecordBatch, at: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        feat = np.frombuffer(row.column(at)[0].as_buffer(), np.int64).copy()
        return feat, np.frombuffer(row.column(at + 1)[0].as_buffer(), kind).astype(np.float64).reshape(len(feat), -1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The two best of each image are kept while blocks meet, so rows do not grow with the blocks."""
        at, x, fa, best = None, None, None, {}

        def of(img: int, part: int, other: int, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return best.setdefault((img, part, other), (feats, *_no_two(len(feats))))[1:]

        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                img, part, other, opart = (row.column(c)[0].as_py() for c in (0, 1, 4, 5))
                if (img, part) != at:
                    at = img, part
                    fa, x = unpacked(row, 2, kinds[0])
                fb, y = unpacked(row, 6, kinds[1])
                _meet(x, y, fb, fa if both else None, [of(img, part, other, fa)] + ([of(other, opart, img, fb)] if both else []))
        for (img, part, other), (feats, feat, d) in best.items():
            flat = [pa.array([v.ravel()], pa.list_(kind)) for v, kind in ((feats, pa.int64()), (feat, pa.int64()), (d, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (img, part, other)), *flat], ["img", "part", "other", "feat", "ofeat", "d"])

    def merged(found: pa.Table) -> pa.Table:
        """The two best of all tasks for a block and an image; features without two are left out."""
        feats, feat, d = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("feat", "ofeat", "d"))
        real = feat != NONE
        own, row = np.unique(np.repeat(feats, 2)[real], return_inverse=True)  # a block's rows may be in any order
        feat, d = _pick(row, feat[real], d[real], len(own))
        two = feat[:, 1] != NONE
        same = [np.full(int(two.sum()), found.column(c)[0].as_py(), np.int32) for c in ("img", "other")]
        columns = {"img": same[0], "feat": own[two], "other": same[1], "d1": d[two, 0], "d2": d[two, 1], "nearest": feat[two, 0]}
        return pa.table({c: pa.array(v) for c, v in columns.items()})

    found = met.mapInArrow(products, "img int, part int, other int, feat array<bigint>, ofeat array<bigint>, d array<double>")
    return found.groupBy("img", "part", "other").applyInArrow(merged, "img int, feat bigint, other int, d1 double, d2 double, nearest bigint")


def ratio_matches(two: DataFrame, ratio: float) -> DataFrame:
    """Directed matches whose nearest is clearly nearer than the second: d1 < ratio d2, strictly."""
    return two.where(F.col("d1") < F.lit(ratio) * F.col("d2")).select("img", "feat", "other", F.col("nearest").alias("ofeat"))


def mutual_matches(directed: DataFrame) -> DataFrame:
    """Matches that hold in both directions, once, with i < j."""
    up = F.col("img") < F.col("other")
    ends = [F.when(up, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("img", "other", "i"), ("other", "img", "j"), ("feat", "ofeat", "fi"), ("ofeat", "feat", "fj"))]
    # A join of the two directions would find the nearest features twice, once for each.
    met = directed.where("img <> other").select(*ends, up.alias("up")).groupBy("i", "j", "fi", "fj").agg(F.min("up").alias("both"), F.max("up").alias("any"))
    return met.where("NOT both AND any AND fi IS NOT NULL AND fj IS NOT NULL").select("i", "j", "fi", "fj")


def match_all(features: DataFrame, ratio: float, blocked: bool = True) -> DataFrame:
    """Mutual ratio-test matches of all image pairs."""
    return mutual_matches(ratio_matches((nearest_two_blocked if blocked else nearest_two)(features), ratio))


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def enough_matches(matches: DataFrame, least: int = 8) -> DataFrame:
    """Matches of the pairs that have at least `least`."""
    return matches.join(match_counts(matches).where(F.col("n") >= least), ["i", "j"], "left_semi")


def top_pairs(matches: DataFrame, n: int = 40) -> DataFrame:
    """The n pairs with most matches, ties by (i, j)."""
    return match_counts(matches).orderBy(F.desc("n"), "i", "j").limit(n)


def symmetric(matches: DataFrame) -> DataFrame:
    """Matches in both directions: (img, other, feat, ofeat)."""
    fwd = matches.select(F.col("i").alias("img"), F.col("j").alias("other"), F.col("fi").alias("feat"), F.col("fj").alias("ofeat"))
    return fwd.unionByName(matches.select(F.col("j").alias("img"), F.col("i").alias("other"), F.col("fj").alias("feat"), F.col("fi").alias("ofeat")))


def pair_matches(matches: DataFrame, i: int, j: int) -> DataFrame:
    """(feat of i, feat of j) of one pair, in either order."""
    a, b = min(i, j), max(i, j)
    own = matches.where((F.col("i") == a) & (F.col("j") == b))
    return own.select(F.col("fi" if i < j else "fj").alias("feat"), F.col("fj" if i < j else "fi").alias("ofeat"))


def neighbors(matches: DataFrame, img: int) -> DataFrame:
    """Images that share a match with `img`, and how many."""
    return symmetric(matches).where(F.col("img") == img).groupBy("other").agg(F.count(F.lit(1)).alias("n"))
