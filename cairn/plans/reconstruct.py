"""Structure from motion and cleanup: the whole run from features to clouds.

The incremental loop takes one image after the other, as each step needs the one before; what it works on are
tables. Tracked features and verified matches are staged once, points and lost tracks at each step. A pose is
solved in the task that has the image's own correspondences, or in passes over them if they are many (operators/consensus.py), new points where their matches are, and bundle adjustment
sums up what each point has to say (operators/adjust.py). The driver holds cameras, which are thousands at most,
and the numbers that rank images; scenes are independent of each other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, ratio_threshold
from ..operators import adjust, cloud, consensus, geometry as G, matching, neighbors, scene, stereo, tracks
from ..tables import discard, staged

CAMERAS = "img int, r array<double>, t array<double>, fx double, fy double, cx double, cy double"
POINTS = "track_id long, x double, y double, z double, error double"


@dataclass
class Scene:
    """Cameras here, the rest in staged tables: `seen` (track_id, img, feat, u, v), `pairs` (i, j, fi, fj, ti, tj, ui, vi, uj, vj:
    verified matches with the tracks and pixels of both ends), `points` (POINTS), `lost` (track_id)."""

    intrinsics: dict[int, np.ndarray]
    seen: DataFrame
    pairs: DataFrame
    points: DataFrame
    lost: DataFrame
    poses: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    failed: set[int] = field(default_factory=set)

    @property
    def spark(self) -> SparkSession:
        return self.seen.sparkSession

    def cameras(self) -> DataFrame:
        rows = [(img, r.ravel().tolist(), np.ravel(t).tolist(), *(float(v) for v in (k[0, 0], k[1, 1], k[0, 2], k[1, 2]))) for img, (r, t) in sorted(self.poses.items()) for k in [self.intrinsics[img]]]
        return self.spark.createDataFrame(rows, CAMERAS)

    def replace_points(self, points: DataFrame) -> None:
        before, self.points = self.points, staged(points.select("track_id", "x", "y", "z", "error"), "points")
        discard(before)


def scene_of(features: DataFrame, matches: DataFrame, track_table: DataFrame, intrinsics: DataFrame) -> Scene:
    """The tables of one scene before its first camera; only the intrinsics are read here."""
    spark = features.sparkSession
    k = {r["img"]: np.array([[r["fx"], 0, r["cx"]], [0, r["fy"], r["cy"]], [0, 0, 1.0]]) for r in intrinsics.collect()}
    at = features.select("img", "feat", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    # What these tables are made of may say little of their size, as rows are exploded: none of them is broadcast.
    seen = staged(track_table.select("track_id", "img", "feat").join(at.hint("merge"), ["img", "feat"]).select("track_id", "img", "feat", "u", "v"), "seen")
    ends = at.join(track_table.select("track_id", "img", "feat").hint("merge"), ["img", "feat"], "left")
    a, b = (ends.select(F.col("img").alias(i), F.col("feat").alias(f"f{i}"), F.col("track_id").alias(f"t{i}"), F.col("u").alias(f"u{i}"), F.col("v").alias(f"v{i}")) for i in "ij")
    pairs = staged(matches.select("i", "j", "fi", "fj").join(a.hint("merge"), ["i", "fi"]).join(b.hint("merge"), ["j", "fj"]), "pairs")
    return Scene(k, seen, pairs, staged(spark.createDataFrame([], POINTS), "points"), staged(spark.createDataFrame([], "track_id long"), "lost"))


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows[["ui", "vi"]].to_numpy(float), rows[["uj", "vj"]].to_numpy(float)


def score_pairs(s: Scene, cfg: Config) -> DataFrame:
    """(i, j, n, inliers, angle, r, t) of the pairs with most matches: relative pose and median angle of each, in a task if its matches are few."""
    top = s.pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "i", "j").limit(cfg.init_probe_pairs)
    pairs = [(r["i"], r["j"], r["n"]) for r in top.collect() if r["n"] >= cfg.init_min_inliers]  # init_probe_pairs rows
    large = {at: pair for at, pair in enumerate(pairs) if pair[2] > consensus.TASK}
    small = s.spark.createDataFrame([pair for at, pair in enumerate(pairs) if at not in large], "i int, j int, n long")
    rows = s.pairs.join(F.broadcast(small), ["i", "j"])
    k, limit, seed = s.intrinsics, cfg.pnp_threshold_px, cfg.seed

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values(["fi", "fj"])
        i, j = int(pair["i"].iloc[0]), int(pair["j"].iloc[0])
        a, b = _arrays(pair)
        r, t, mask = G.relative_pose(k[i], k[j], a, b, limit, seed)
        if r is None:
            return pd.DataFrame(columns=["i", "j", "n", "inliers", "angle", "r", "t"])
        angle = float(np.median(G.motion_angles(k[i], k[j], r, t, a[mask], b[mask])))
        return pd.DataFrame({"i": [i], "j": [j], "n": [len(pair)], "inliers": [int(mask.sum())], "angle": [angle], "r": [r.ravel().tolist()], "t": [t.tolist()]})

    schema = "i int, j int, n long, inliers long, angle double, r array<double>, t array<double>"
    scored = rows.groupBy("i", "j").applyInPandas(run, schema)
    if not large:
        return scored
    keys = s.spark.createDataFrame([(i, j, at) for at, (i, j, _) in large.items()], "i int, j int, key int")
    many = consensus.relative_poses(s.pairs.join(F.broadcast(keys), ["i", "j"]), {at: n for at, (_, _, n) in large.items()}, {at: (k[i], k[j]) for at, (i, j, _) in large.items()}, limit, seed)
    return scored.unionByName(s.spark.createDataFrame([(*large[at], n, angle, r.ravel().tolist(), t.tolist()) for at, (r, t, n, angle) in many.items()], schema))


def candidates(rows: DataFrame, s: Scene) -> DataFrame:
    """(track_id, other, feat, x, y, z, error_a, error_b, angle): the point of each match (new, other, feat, track_id, ua, va, ub, vb) of posed images."""
    k, poses = s.intrinsics, s.poses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, other = (batch.column(c).to_numpy() for c in ("new", "other"))
            a, b = (np.stack([batch.column(c).to_numpy() for c in pair], axis=1) for pair in (("ua", "va"), ("ub", "vb")))
            x, made = np.zeros((len(a), 3)), np.zeros((len(a), 3))
            for i, j in {*zip(new.tolist(), other.tolist(), strict=True)}:
                at = np.flatnonzero((new == i) & (other == j))
                x[at] = G.triangulate(G.projection(k[i], *poses[i]), G.projection(k[j], *poses[j]), a[at], b[at])
                centers = [-poses[c][0].T @ poses[c][1] for c in (i, j)]
                made[at] = np.stack([G.reprojection(k[i], *poses[i], x[at], a[at]), G.reprojection(k[j], *poses[j], x[at], b[at]), G.angles(*centers, x[at])], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("track_id"), batch.column("other"), batch.column("feat"), *(pa.array(v[:, c]) for v in (x, made) for c in range(3))], ["track_id", "other", "feat", "x", "y", "z", "error_a", "error_b", "angle"])

    rows = rows.select("new", "other", F.col("feat").cast("long").alias("feat"), F.col("track_id").cast("long").alias("track_id"), "ua", "va", "ub", "vb")
    return rows.mapInArrow(run, "track_id long, other int, feat long, x double, y double, z double, error_a double, error_b double, angle double")


def _matches_of(s: Scene, img: int, pairs: DataFrame | None = None) -> DataFrame:
    """Tracked matches of `img` with posed images, whose track has no point and is not lost."""
    pairs = s.pairs if pairs is None else pairs
    sides = [(F.col("i") == img, "i", "j"), (F.col("j") == img, "j", "i")]
    both = [pairs.where(on).select(F.col(a).alias("new"), F.col(b).alias("other"), F.col(f"f{a}").alias("feat"), F.col(f"t{a}").alias("track_id"), F.col(f"u{a}").alias("ua"), F.col(f"v{a}").alias("va"), F.col(f"u{b}").alias("ub"), F.col(f"v{b}").alias("vb")) for on, a, b in sides]
    rows = both[0].unionByName(both[1]).where("track_id IS NOT NULL")
    return rows.where(F.col("other").isin([*s.poses])).join(s.points.hint("merge"), "track_id", "left_anti").join(s.lost.hint("merge"), "track_id", "left_anti")


def _added(s: Scene, rows: DataFrame, cfg: Config, angles: tuple[float, float] = (1.5, 178.0)) -> None:
    found = scene.first_per_track(scene.candidate_points(candidates(rows, s), cfg.max_reproj_px, angles))
    s.replace_points(s.points.unionByName(found.select("track_id", "x", "y", "z", F.lit(None).cast("double").alias("error"))))


def seed_pair(s: Scene, cfg: Config) -> bool:
    """Start from the pair, of those with most matches, with the best inliers * min(median angle, 15), and its inliers' points."""
    best = scene.best_pair(score_pairs(s, cfg), cfg.init_min_inliers).first()
    if best is None:
        return False
    i, j, r, t = best["i"], best["j"], np.array(best["r"]).reshape(3, 3), np.array(best["t"])
    s.poses |= {i: (np.eye(3), np.zeros(3)), j: (r, t)}
    k, limit = s.intrinsics, cfg.pnp_threshold_px

    def inliers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.stack([batch.column(c).to_numpy() for c in pair], axis=1) for pair in (("ui", "vi"), ("uj", "vj")))
            yield batch.filter(pa.array(G.motion_inliers(k[i], k[j], r, t, a, b, limit)))

    own = s.pairs.where((F.col("i") == i) & (F.col("j") == j))
    _added(s, _matches_of(s, j, own.mapInArrow(inliers, own.schema)), cfg, (-1.0, 181.0))
    return True


def register_next(s: Scene, cfg: Config) -> int | None:
    """Pose of the image that sees most points; one whose pose fails is not tried again."""
    left = [c for c in s.intrinsics if c not in s.poses and c not in s.failed]
    if not left:
        return None
    found = s.seen.where(F.col("img").isin(left)).join(s.points.select("track_id", "x", "y", "z").hint("merge"), "track_id")
    intrinsics, limit, seed = s.intrinsics, cfg.pnp_threshold_px, cfg.seed

    def pose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("feat")
        r, t, mask = G.absolute_pose(intrinsics[int(key[0])], rows[["x", "y", "z"]].to_numpy(), rows[["u", "v"]].to_numpy(), limit, seed)
        return pd.DataFrame({"r": [r.ravel().tolist()], "t": [t.ravel().tolist()]}) if r is not None and mask.sum() >= 6 else pd.DataFrame(columns=["r", "t"])

    for img, n in [(r["img"], r["n"]) for r in scene.correspondence_rank(found).collect()]:
        own = found.where(F.col("img") == img)
        if n <= consensus.TASK:
            made = own.groupBy("img").applyInPandas(pose, "r array<double>, t array<double>").first()
            solved = made and (np.array(made["r"]).reshape(3, 3), np.array(made["t"]))
        else:
            rows = staged(own.select(F.col("img").alias("key"), "feat", "x", "y", "z", "u", "v"), "seen_by")
            solved = consensus.absolute_poses(rows, {img: n}, intrinsics, limit, seed).get(img, (None,))[:2]
            discard(rows)
            solved = solved if solved[0] is not None else None
        if solved:
            s.poses[img] = solved
            return img
        s.failed.add(img)
    return None


def triangulate_new(s: Scene, img: int, cfg: Config) -> None:
    """Points of tracks that `img` shares with posed images and that have none yet; the lowest of those images decides."""
    _added(s, _matches_of(s, img), cfg)


def adjust_all(s: Scene, cfg: Config) -> tuple[float, float]:
    """Bundle adjustment of all poses and points; the root mean square error before and after."""
    if len(s.poses) < 2:
        return 0.0, 0.0
    s.poses, points, scale, rms = adjust.adjust_scene(s.intrinsics, s.poses, s.points, s.seen, cfg.ba_iterations, cfg.ba_huber_px, cfg.ba_ftol, cfg.refine_intrinsics, min(s.poses))
    s.replace_points(points.withColumn("error", F.lit(None).cast("double")))
    discard(points)
    if cfg.refine_intrinsics:
        s.intrinsics = {c: k * [[scale, 1, 1], [1, scale, 1], [1, 1, 1]] for c, k in s.intrinsics.items()}
    return rms


def drop_outliers(s: Scene, cfg: Config) -> None:
    """Points whose mean error is over twice the limit, or that no camera sees in front of it, are lost for good."""
    named = s.points.select(F.col("track_id").alias("pid"), "track_id", "x", "y", "z")
    kept = staged(scene.filter_points(named, scene.observation_errors(named, s.seen, None, s.cameras()), cfg.max_reproj_px), "kept")
    before, s.lost = s.lost, staged(s.lost.unionByName(s.points.join(kept.hint("merge"), "track_id", "left_anti").select("track_id")), "lost")
    s.replace_points(kept)
    discard(before)
    discard(kept)


def grow(s: Scene, cfg: Config, log: Callable[[str], None] | None = None) -> Scene:
    """Seed, then register, triangulate, adjust and filter until no image is left that fits."""
    say = log or (lambda line: None)
    if not seed_pair(s, cfg):
        return s
    say(f"seed pair {sorted(s.poses)}, error {adjust_all(s, cfg)[1]:.3f}")
    n = 0
    while (img := register_next(s, cfg)) is not None:
        triangulate_new(s, img, cfg)
        n += 1
        if n % max(1, cfg.ba_every) == 0:
            say(f"image {img}, error {adjust_all(s, cfg)[1]:.3f}")
        drop_outliers(s, cfg)
    adjust_all(s, cfg)
    drop_outliers(s, cfg)
    return s


def scene_tables(s: Scene) -> tuple[DataFrame, DataFrame]:
    """cameras and points (pid, x, y, z, track_id, error) of a reconstructed scene."""
    numbered = cloud.row_numbers(s.points, ["track_id"], "pid")
    return s.cameras(), numbered.select(F.col("pid").cast("bigint").alias("pid"), "x", "y", "z", "track_id", "error")


def cleanup(df: DataFrame, cfg: Config, order: list[str]) -> DataFrame:
    """The cap, then outliers, then voxels if asked for: each works on what the one before left."""
    out = cloud.decimate(df, cfg.dense_max_points, order)
    out = neighbors.remove_outliers(staged(out, "capped"), cfg.sor_k, cfg.sor_std_ratio)
    return cloud.voxel_downsample(out, cfg.voxel_size)


def reconstruct(spark: SparkSession, features: DataFrame, intrinsics: DataFrame, cfg: Config, out: str | None = None, images: DataFrame | None = None, log: Callable[[str], None] | None = None) -> dict:
    """From features (img, feat, u, v, desc) and intrinsics (img, fx, fy, cx, cy) to cameras, points and a clean cloud.

    With `images` (see operators.stereo) the cloud is a dense one from pairs of near views; without, or where no
    pair matches, it is made of the sparse points. With `out`, clouds and scene.json are written there. `log` is told of
    each step when it is done; none is needed.
    """
    from ..sources.writer import write_scene

    began = time.time()
    say = log or (lambda line: None)
    if features.select("img").distinct().count() < 2:
        raise ValueError("two images at least are needed")
    found = staged(matching.match_all(features, ratio_threshold(cfg.ratio_test)), "matches")
    good = staged(G.verify_pairs(matching.enough_matches(found, cfg.min_matches), features, cfg.max_reproj_px, cfg.min_matches, cfg.seed), "verified")
    say("matches are verified")
    track_table = staged(tracks.build_tracks(good, cfg.min_track_length), "tracks")
    say("tracks are built")
    s = grow(scene_of(features, good, track_table, intrinsics), cfg)
    say(f"scene: {len(s.poses)} of {len(s.intrinsics)} images, {s.points.count()} points")
    cameras, points = scene_tables(s)
    raw = None
    bound = cloud.sparse_bound(points)
    if images is not None:
        pairs = scene.view_neighbors(cameras, cfg.dense_neighbors, cfg.dense_max_angle).select("img", "other")
        made = stereo.dense_cloud(images, cameras, pairs, points, bound, cfg.block_size, cfg.uniqueness)
        # Staged first: ids must not change when a lost task is run again.
        raw = staged(staged(made, "dense").select(F.monotonically_increasing_id().alias("point_id"), "x", "y", "z", "r", "g", "b"), "numbered")
        say("dense cloud is made")
    if raw is None or raw.isEmpty():
        raw = cloud.radius_clip(points.selectExpr("pid AS point_id", "x", "y", "z"), bound)
    clean = cleanup(raw, cfg, ["point_id"])
    say("cloud is capped, the rest of the cleanup is planned")
    made = {"cameras": cameras, "points": points, "tracks": track_table, "matches": good, "cloud": clean, "summary": scene.scene_summary(cameras, points)}
    if out:
        made["scene"] = write_scene(cameras, points, out, time.time() - began, clean)
    return made

