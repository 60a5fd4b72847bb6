"""Stereo on rendered views of a textured plane, and what needs missing packages."""

import numpy as np
import pytest

from cairn.operators import cloud, scene, stereo
from cairn.operators.geometry import rotation
from cairn.sources import images

W, H = 160, 120
K = np.array([[150.0, 0, 80], [0, 150, 60], [0, 0, 1]])


def texture(x, y):
    return 128 + 40 * np.sin(9 * x) * np.cos(7 * y) + 40 * np.sin(23 * x + 5 * y) + 30 * np.cos(17 * y - 3 * x)


def render(r, t, depth=4.0):
    """A plane z = depth as the camera sees it."""
    v, u = np.mgrid[0:H, 0:W].astype(float)
    rays = np.stack([(u - K[0, 2]) / K[0, 0], (v - K[1, 2]) / K[1, 1], np.ones_like(u)], axis=-1) @ r
    center = -r.T @ t
    s = (depth - center[2]) / rays[..., 2]
    p = center + rays * s[..., None]
    return np.clip(texture(p[..., 0], p[..., 1]), 0, 255).astype(np.uint8)


def poses():
    return [(np.eye(3), np.zeros(3)), (rotation(np.array([0.0, 0.03, 0.0])), np.array([-0.4, 0.02, 0.0]))]


def test_plane(spark):
    rng = np.random.default_rng(0)
    known = np.column_stack([rng.uniform(-1, 1, (200, 2)), rng.uniform(3.6, 4.4, 200)])
    views = [render(*p).tobytes() for p in poses()]
    table = spark.createDataFrame([(k, W, H, g, g, g, None) for k, g in enumerate(views)], "img int, width int, height int, gray binary, red binary, green binary, blue binary")
    cams = spark.createDataFrame([(k, r.ravel().tolist(), t.tolist(), 150.0, 150.0, 80.0, 60.0) for k, (r, t) in enumerate(poses())], "img int, r array<double>, t array<double>, fx double, fy double, cx double, cy double")
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(known)], "pid long, x double, y double, z double")
    pairs = scene.view_neighbors(cams, 1).select("img", "other")
    out = stereo.dense_cloud(table, cams, pairs, points, cloud.sparse_bound(points)).toPandas()
    assert len(out) > 8000 and set(out.img) == {0, 1}
    assert np.median(np.abs(out.z - 4)) < 0.05 and (np.abs(out.z - 4) < 0.2).mean() > 0.95
    assert (out.r == out.b).all() and np.abs(out.r - texture(out.x, out.y)).median() < 6


def test_depth_ranges_of_all_points(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.uniform(-3, 3, (9000, 2)), rng.uniform(-2, 9, 9000)])
    cams = spark.createDataFrame([(k, r.ravel().tolist(), t.tolist(), 150.0, 150.0, 80.0, 60.0) for k, (r, t) in enumerate([*poses(), poses()[0]])], "img int, r array<double>, t array<double>, fx double, fy double, cx double, cy double")
    points = spark.createDataFrame([*((k, *map(float, p)) for k, p in enumerate(x)), (9001, None, 0.0, 0.0)], "pid long, x double, y double, z double").repartition(5)
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2)], "img int, other int")  # the last two cameras of (0, 2) are in one place
    rows = stereo.depth_ranges(cams, pairs, points).collect()
    assert {(r["img"], r["other"]) for r in rows} == {(0, 1), (1, 0)}
    for r in rows:
        (ra, ta), (rb, tb) = poses()[r["img"]], poses()[r["other"]]
        z = (x + ra.T @ ta) @ stereo.rectify(K, ra, ta, K, rb, tb)[1][2]
        z = z[z > 1e-6]
        near, far = np.percentile(z, [2, 98])
        assert r["n"] == len(z) and abs(stereo._depth(r["near"]) / near - 1) < 5e-3 and abs(stereo._depth(r["far"]) / far - 1) < 1e-3


def test_views_that_do_not_rectify_give_nothing():
    a = {"K": K, "R": np.eye(3), "t": np.zeros(3), "gray": np.zeros((H, W), np.uint8), "channels": [np.zeros((H, W))] * 3}
    b = a | {"t": np.array([-50.0, 0, 0])}
    assert len(stereo.pair_cloud(a, b, np.tile([0.0, 0, 4], (20, 1)))) == 0
    assert stereo.window(np.ones(3), 100, 1, 640) is None and stereo.window(np.full(50, 10.0), 800, 0.5, 640) == (35, 16)


def test_missing_packages_are_named(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    listed = images.list_images(spark, str(tmp_path)).selectExpr("0 AS img", "path")
    try:
        import PIL  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="Pillow"):
            images.load(listed, 1600).collect()
    else:
        assert images.load(listed, 1600).first().error
    assert {k: v.tolist() for k, v in images.sample_colors(np.array([-3.0, 1.4]), np.array([0.0, 9.0]), [np.arange(6).reshape(2, 3)] * 3).items()} == dict.fromkeys("rgb", [0, 4])
