"""Scene tables: cameras (img, r, t, fx, fy, cx, cy), points (pid, x, y, z, track_id, ...), observations (img, feat, u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import camera as C
from ..functions.vectors import angle_degrees, is_finite, norm, sub, vec

CAMERA = ("r", "t", "fx", "fy", "cx", "cy")


def unregistered(images: DataFrame, cameras: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """Images without a camera and not on the blacklist, ascending."""
    out = images.select("img").distinct().join(cameras, "img", "left_anti")
    return (out.join(blacklist, "img", "left_anti") if blacklist is not None else out).orderBy("img")


def registered_observations(tracks: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations in images that have a camera."""
    return tracks.join(cameras, "img", "left_semi")


def correspondences(features: DataFrame, tracks: DataFrame, points: DataFrame, candidates: DataFrame) -> DataFrame:
    """(img, feat, u, v, track_id, pid, x, y, z): features of candidate images whose track has a point."""
    seen = tracks.join(candidates.select("img"), "img", "left_semi").join(points.select("track_id", "pid", "x", "y", "z"), "track_id")
    return seen.join(features.select("img", "feat", "u", "v"), ["img", "feat"])


def correspondence_rank(found: DataFrame, least: int = 6) -> DataFrame:
    """(img, n) by (-n, img): candidates with enough correspondences."""
    return found.groupBy("img").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "img")


def tracks_without_point(tracks: DataFrame, points: DataFrame) -> DataFrame:
    return tracks.join(points, "track_id", "left_anti")


def observation_errors(points: DataFrame, tracks: DataFrame, features: DataFrame | None, cameras: DataFrame) -> DataFrame:
    """(pid, img, feat, error): reprojection error of each observation in a registered image; without `features`, `tracks` has u and v."""
    rows = points.select("pid", "track_id", "x", "y", "z").join(tracks.hint("merge"), "track_id")
    rows = (rows.join(features.select("img", "feat", "u", "v").hint("merge"), ["img", "feat"]) if features is not None else rows).join(F.broadcast(cameras), "img")
    error = C.reprojection_error(*[F.col(c) for c in CAMERA], vec("x", "y", "z"), F.col("u"), F.col("v"))
    return rows.select("pid", "img", "feat", error.alias("error"))


def point_errors(errors: DataFrame) -> DataFrame:
    """(pid, mean_error, n): over finite errors; a point without any has NULL."""
    finite = F.when(is_finite(F.col("error")), F.col("error"))
    return errors.groupBy("pid").agg(F.avg(finite).alias("mean_error"), F.count(finite).alias("n"))


def filter_points(points: DataFrame, errors: DataFrame, max_reproj_px: float) -> DataFrame:
    """Points with a mean error of at most twice the limit, and that error; those without a finite one go."""
    good = point_errors(errors).where(F.col("mean_error") <= 2.0 * max_reproj_px)
    return points.drop("error").join(good.select("pid", F.col("mean_error").alias("error")), "pid")


def rms_error(errors: DataFrame) -> DataFrame:
    """One row: root mean square of finite errors, and how many."""
    good = errors.where(is_finite(F.col("error")))
    return good.agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"), F.count(F.lit(1)).alias("n"))


def view_pairs(cameras: DataFrame, max_angle: float = 30.0, least_baseline: float = 1e-6) -> DataFrame:
    """(img, other, angle, baseline) of ordered camera pairs with a small angle between their axes and some baseline."""
    cols = [F.col("img"), *[F.col(c) for c in ("r", "t")]]
    a = cameras.select(*[c.alias(f"a_{n}") for c, n in zip(cols, ("img", "r", "t"), strict=True)])
    b = cameras.select(*[c.alias(f"b_{n}") for c, n in zip(cols, ("img", "r", "t"), strict=True)])
    pairs = a.join(b, F.col("a_img") != F.col("b_img"))
    angle = angle_degrees(C.direction(F.col("a_r")), C.direction(F.col("b_r")))
    base = norm(sub(C.center(F.col("a_r"), F.col("a_t")), C.center(F.col("b_r"), F.col("b_t"))))
    out = pairs.select(F.col("a_img").alias("img"), F.col("b_img").alias("other"), angle.alias("angle"), base.alias("baseline"))
    return out.where((F.col("baseline") > least_baseline) & (F.col("angle") <= max_angle))


def view_neighbors(cameras: DataFrame, k: int = 4, max_angle: float = 30.0) -> DataFrame:
    """The k views of each camera with the smallest angle, ties by image."""
    rank = F.row_number().over(W.partitionBy("img").orderBy("angle", "other"))
    return view_pairs(cameras, max_angle).withColumn("rank", rank).where(F.col("rank") <= k)


def candidate_points(triangulated: DataFrame, max_reproj_px: float, angles: tuple[float, float] = (1.5, 178.0)) -> DataFrame:
    """Rows (track_id, other, feat, error_a, error_b, angle, ...) in front of both cameras, with small errors and a fair angle."""
    limit = F.lit(max_reproj_px)
    return triangulated.where((F.col("error_a") < limit) & (F.col("error_b") < limit) & (F.col("angle") > angles[0]) & (F.col("angle") < angles[1]) & ~F.isnan("angle"))


def first_per_track(candidates: DataFrame) -> DataFrame:
    """One candidate per track: that of the lowest other image, then of the lowest feature."""
    rank = F.row_number().over(W.partitionBy("track_id").orderBy("other", "feat"))
    return candidates.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def best_pair(scored: DataFrame, min_inliers: int = 80, min_angle: float = 2.0, cap: float = 15.0) -> DataFrame:
    """Of (i, j, inliers, angle, n): the pair with the greatest inliers * min(angle, cap); the better ranked on ties."""
    good = scored.where((F.col("inliers") >= min_inliers) & (F.col("angle") >= min_angle))
    good = good.withColumn("score", F.col("inliers") * F.least(F.col("angle"), F.lit(cap)))
    return good.orderBy(F.desc("score"), F.desc("n"), "i", "j").limit(1)


def disparity_window(points: DataFrame, focal: float, baseline: float, width: int, least: int = 8) -> DataFrame:
    """One row (min_disp, num_disp) that fits the disparities of points at depth z, or none if it would not fit the image."""
    d = points.where(F.col("z") > 1e-6).select((F.lit(focal * baseline) / F.col("z")).alias("d"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.percentile("d", 0.02).alias("lo"), F.percentile("d", 0.98).alias("hi"))
    s = s.withColumn("span", F.greatest(F.col("hi") - F.col("lo"), F.lit(16.0)))
    s = s.withColumn("min_disp", F.greatest(F.lit(0), F.floor(F.col("lo") - 0.3 * F.col("span")).cast("int")))
    s = s.withColumn("num_disp", (F.ceil((F.col("hi") + 0.3 * F.col("span") - F.col("min_disp")) / 16.0) * 16).cast("int"))
    fits = (F.col("n") >= least) & (F.col("num_disp") >= 16) & (F.col("min_disp") + F.col("num_disp") <= width)
    return s.where(fits & F.lit(baseline > 0)).select("min_disp", "num_disp")


def camera_markers(cameras: DataFrame) -> DataFrame:
    """One coloured point at each camera's centre."""
    x, y, z = C.center(F.col("r"), F.col("t"))
    return cameras.select(F.col("img").cast("bigint").alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"), *[F.lit(v).cast("smallint").alias(c) for c, v in (("r", 255), ("g", 220), ("b", 60))])


def scene_summary(cameras: DataFrame, points: DataFrame) -> DataFrame:
    """One row: numbers of cameras and points, mean error, and the registered images in order."""
    c = cameras.agg(F.count(F.lit(1)).alias("n_cameras"), F.sort_array(F.collect_list("img")).alias("registered"))
    return c.crossJoin(points.agg(F.count(F.lit(1)).alias("n_points"), F.avg("error").alias("mean_error")))
