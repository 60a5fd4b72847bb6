"""Operators against NumPy on small fixtures: edge cases, quirks and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import camera, scalars
from cairn.operators import cloud, matching, mesh, neighbors, scene, tracks
from cairn.plans import reconstruct
from cairn.config import Config
from cairn.streaming import progress


def make(spark, xyz, **more):
    rows = [(k, *map(float, p), *(v[k] if c in 'rgb' else float(v[k]) for c, v in more.items())) for k, p in enumerate(xyz)]
    kinds = "".join(f", {c} {'int' if c in 'rgb' else 'float' if c == 'opacity' else 'double'}" for c in more)
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double" + kinds)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


# Clouds


def test_voxels(spark):
    xyz = [(-0.1, 0, 0), (0.1, 0, 0), (0.9, 0, 0), (1.0, 0, 0), (-1.0, 0, 0)]
    c = make(spark, xyz, r=[1, 2, 3, 4, 5], g=[0] * 5, b=[255] * 5, nx=[0.0, 1, 0, 0, 0], ny=[0.0, 0, 1, 0, 0], nz=[1.0, 0, 0, 0, 0])
    out = {round(r.x, 6): r for r in cloud.voxel_downsample(c, 1.0).collect()}
    assert set(out) == {-0.55, 0.5, 1.0}  # floor, not truncation; a point on a boundary belongs to the cell above
    assert out[0.5].r == 2 and out[-0.55].r == 3 and abs(out[0.5].nx - math.sqrt(0.5)) < 1e-9
    assert cloud.voxel_downsample(c, 0.0).count() == 5 and cloud.voxel_downsample(c.limit(0), 1.0).count() == 0
    again = cloud.voxel_downsample(cloud.voxel_downsample(c, 1.0), 1.0)
    assert sorted(r.x for r in again.collect()) == sorted(r.x for r in cloud.voxel_downsample(c, 1.0).collect())
    ids = [r.group_id for r in cloud.voxel_group_ids(c, 1.0).orderBy("point_id").collect()]
    assert ids == [0, 1, 1, 2, 0]


def test_row_numbers_and_strides(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 3000).tolist()
    df = spark.createDataFrame([(int(v), k) for k, v in enumerate(values)], "v int, k int").repartition(7)
    got = {r.k: r.row for r in cloud.row_numbers(df, ["v", "k"], "row").collect()}
    want = {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))}
    assert got == want
    assert cloud.stride_sample(df, 7, ["v", "k"]).count() == math.ceil(3000 / 7)
    assert cloud.row_numbers(df.limit(0), ["v", "k"]).count() == 0


def test_decimate_and_prefix(spark):
    rng = np.random.default_rng(1)
    c = make(spark, rng.random((5000, 3)))
    for most in (5000, 3000, 500):
        n = cloud.decimate(c, most, ["point_id"]).count()
        assert 0 < n <= most and (n == 5000 or most < 5000)
    a, b = (sorted(r.point_id for r in cloud.shuffle_prefix(x, 300).collect()) for x in (c, c.repartition(9)))
    assert a == b and len(a) == 300 and abs(np.mean(a) - 2500) < 300


def test_bounds_and_clip(spark):
    rng = np.random.default_rng(2)
    xyz = rng.normal(0, 1, (400, 3))
    xyz[0] = 100
    c = make(spark, xyz)
    b = cloud.sparse_bound(c).first()
    center = np.median(xyz, axis=0)
    assert abs(b.cx - center[0]) < 1e-9 and abs(b.radius - 4 * np.percentile(np.linalg.norm(xyz - center, axis=1), 99)) < 1e-9
    assert cloud.radius_clip(c, cloud.sparse_bound(c)).count() == 399
    few = c.limit(7)
    assert cloud.sparse_bound(few).first().radius is None and cloud.radius_clip(few, cloud.sparse_bound(few)).count() == 7
    rough = cloud.robust_bounds(c, exact=False).first()
    assert abs(rough.lo_x - np.percentile(xyz[:, 0], 0.5)) < 0.5


def test_normalisations(spark):
    c = make(spark, np.zeros((3, 3)), opacity=[0.05, 0.06, float("nan")])
    assert [r.point_id for r in cloud.opacity_filter(c).collect()] == [1]  # strictly greater, as floats; NaN goes
    c = spark.createDataFrame([(0, 0.0, 0.5, 1.0), (1, 1.0, 0.999, 0.1)], "point_id long, r double, g double, b double")
    assert [tuple(r)[1:] for r in cloud.normalize_colors(c).orderBy("point_id").collect()] == [(0, 127, 255), (255, 254, 25)]
    c = spark.createDataFrame([(0, -3, 300, 7)], "point_id long, r int, g int, b int")
    assert tuple(cloud.normalize_colors(c).first())[1:] == (0, 255, 7)
    for kind, values, want in (("int", [0, 255], [0, 1]), ("double", [0.2, 0.8], [0.2, 0.8]), ("double", [0.0, 4.0], [0.5, 1 / (1 + math.exp(-4))])):
        got = [r.opacity for r in cloud.normalize_opacity(spark.createDataFrame([(v,) for v in values], f"opacity {kind}")).collect()]
        assert np.allclose(got, want)
    s = spark.createDataFrame([(0.0, 0.0, 3.0), (1.0, 1.0, 1.0)], "a double, b double, c double")
    assert [round(r.scale, 5) for r in cloud.normalize_scale(s, ["a", "b", "c"], True).collect()] == [round(math.e, 5)] * 2
    wild = spark.createDataFrame([(500.0,), (1.0,)], "a double")
    assert [r.scale for r in cloud.normalize_scale(wild, ["a"], True).collect()] == [500.0, 1.0]
    names = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5, 6)], "point_id long, PX double, y double, z double, Red int, g int")
    assert cloud.resolve_columns(names).columns == ["point_id", "x", "y", "z"]
    assert cloud.viewer_projection(make(spark, [(0, 0, 0), (0, 0, 2)])).columns == ["point_id", "x", "y", "z", "cr", "cg", "cb", "alpha", "rel_scale"]
    assert cloud.finalize(make(spark, [(0, 0, 0)], r=[999], g=[-4], b=[3])).first().r == 255


# Neighbours


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "same"])
def test_knn_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    xyz = {"even": rng.random((300, 3)), "clusters": np.vstack([rng.normal(0, 0.001, (150, 3)), rng.normal(50, 1, (100, 3)), [[1000, 0, 0]]]), "line": np.outer(np.arange(120.0), [1, 0, 0]), "same": np.zeros((40, 3))}[kind]
    got = {}
    for r in neighbors.knn(make(spark, xyz), 5).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.neighbor_id, r.d))
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    for i in range(len(xyz)):
        near = sorted((d[i, j], j) for j in range(len(xyz)) if j != i)[:5]
        assert [n for _, n, _ in sorted(got[i])] == [j for _, j in near] and np.allclose([x for _, _, x in sorted(got[i])], [a for a, _ in near])


def brute_nearest(ids, xyz, k):
    out = set()
    for i in range(len(xyz)):
        dx, dy, dz = (xyz[i] - xyz).T
        d = np.sqrt(dx * dx + dy * dy + dz * dz)
        d[i] = np.inf
        near = np.lexsort((ids, d))[: min(k, len(xyz) - 1)]
        out |= {(int(ids[i]), int(ids[j]), round(float(d[j]), 9), r + 1) for r, j in enumerate(near)}
    return out


@pytest.mark.parametrize("kind", ["far", "ties", "crowd", "flat"])
def test_knn_over_many_leaves(spark, kind, monkeypatch):
    """Far points, grids full of ties, many points at one place, and a plane, with leaves of few points and blocks of few distances."""
    monkeypatch.setattr(neighbors, "LEAF", 24)
    monkeypatch.setattr(neighbors, "BLOCK", 500)
    rng = np.random.default_rng(8)
    xyz = {
        "far": np.vstack([rng.random((600, 3)), rng.random((4, 3)) * 1000 + 1000]),
        "ties": rng.integers(0, 5, (500, 3)).astype(float),
        "crowd": np.vstack([np.zeros((150, 3)), rng.integers(0, 4, (300, 3))]).astype(float),
        "flat": np.c_[rng.random((500, 2)), np.zeros(500)],
    }[kind]
    ids = rng.permutation(3 * len(xyz))[: len(xyz)]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, xyz)] + [(9999, float("nan"), 0.0, 0.0), (9998, None, 0.0, 0.0), (9997, float("inf"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert {(r.point_id, r.neighbor_id, round(r.d, 9), r["rank"]) for r in neighbors.knn(df, 6).collect()} == brute_nearest(ids, xyz, 6)


def test_a_large_leaf_has_a_tree_of_its_own(monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF", 16)
    rng = np.random.default_rng(9)
    p = np.vstack([rng.random((500, 3)), rng.random((5, 3)) * 90])
    ids = rng.permutation(len(p))
    row, other, d = neighbors.block_knn(p, ids, p, ids, 5)
    made = {(int(ids[r]), int(o), round(float(x), 9)) for r, o, x in zip(row, other, d)}
    assert made == {t[:3] for t in brute_nearest(ids, p, 5)}


def test_a_feature_beyond_its_bits_is_refused(spark):
    bad = spark.createDataFrame([(1, (1 << 24) + 5)], "img int, feat long")
    with pytest.raises(Exception, match="out of range"):
        bad.select(scalars.pack_node(F.col("img"), F.col("feat"))).collect()


def test_outliers(spark):
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.random((200, 3)), [[9, 9, 9]]])
    c = make(spark, xyz)
    kept = {r.point_id for r in neighbors.remove_outliers(c, 8, 2.0).collect()}
    assert 200 not in kept and len(kept) > 180
    assert kept <= {r.point_id for r in neighbors.remove_outliers(c, 8, 4.0).collect()}
    assert neighbors.remove_outliers(c.limit(8), 8).count() == 8
    assert neighbors.remove_outliers(make(spark, np.zeros((20, 3))), 4).count() == 20
    assert neighbors.knn(c.limit(1), 3).count() == 0 and neighbors.knn(c.limit(0), 3).count() == 0


# Matching and tracks


def features(spark, images, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, 100 * i + k, rng.normal(0, 1, dims).astype(np.float32).tolist()) for i, n in enumerate(images) for k in range(n)], "img int, feat bigint, desc array<float>")


def test_blocked_search_is_the_plain_one(spark):
    f = features(spark, [30, 41, 1, 25])
    key = lambda r: (r.img, r.feat, r.other, r.nearest, round(r.d1, 9), round(r.d2, 9))
    plain = sorted(map(key, matching.nearest_two(f).collect()))
    assert plain == sorted(map(key, matching.nearest_two_blocked(f, block=9).collect()))
    assert not any(other == 2 for _, _, other, *_ in plain) and any(img == 2 for img, *_ in plain)
    m = matching.match_all(f, 0.9)
    assert sorted(m.select("i", "j", "fi", "fj").collect()) == sorted(matching.match_all(f, 0.9, blocked=False).select("i", "j", "fi", "fj").collect())
    same = spark.createDataFrame([(i, 10 * i + k, [0.0, 0.0]) for i in range(2) for k in range(3)], "img int, feat bigint, desc array<float>")
    assert matching.match_all(same, 0.99).count() == 0  # strictly nearer than the second


def edges(spark, *pairs):
    return spark.createDataFrame([(a[0], b[0], a[1], b[1]) for a, b in pairs], "i int, j int, fi bigint, fj bigint")


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([((0, 1), (1, 1)), ((1, 1), (2, 1))], [(0, 1), (1, 1), (2, 1)]),
        ([((0, 1), (1, 1)), ((1, 1), (2, 1)), ((2, 1), (0, 2))], [(1, 1), (2, 1)]),
        ([((0, 1), (1, 1)), ((1, 1), (0, 2))], []),
    ],
)
def test_tracks(spark, pairs, want):
    assert sorted((r.img, r.feat) for r in tracks.build_tracks(edges(spark, *pairs)).collect()) == want
    assert tracks.build_tracks(edges(spark, *pairs), min_length=4).count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r.node: r.component for r in tracks.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}


# Scenes, meshes, functions


def test_scene_rules(spark):
    t = spark.createDataFrame([(1, 2, 7, 1.0, 1.0, 10.0), (1, 1, 9, 1.0, 1.0, 10.0), (2, 1, 3, 5.0, 1.0, 10.0), (3, 1, 3, 1.0, 1.0, 1.0), (4, 1, 3, 1.0, float("inf"), 9.0), (5, 1, 3, 1.0, 1.0, float("nan"))], "track_id long, other int, feat long, error_a double, error_b double, angle double")
    assert [(r.track_id, r.other) for r in scene.first_per_track(scene.candidate_points(t, 4.0)).collect()] == [(1, 1)]
    e = spark.createDataFrame([(1, 2.0), (1, float("inf")), (2, float("inf")), (3, 9.0)], "pid long, error double")
    p = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "pid long, x int")
    assert [(r.pid, r.error) for r in scene.filter_points(p, e, 4.0).collect()] == [(1, 2.0)]
    s = spark.createDataFrame([(0, 1, 100, 3.0, 9), (0, 2, 90, 20.0, 8), (0, 3, 500, 1.0, 9), (1, 2, 20, 9.0, 9)], "i int, j int, inliers int, angle double, n int")
    assert scene.best_pair(s).first().score == 90 * 15.0
    far = spark.createDataFrame([(0.001 * k,) for k in range(1, 20)], "z double")
    assert scene.disparity_window(far, 800.0, 0.1, 640).count() == 0 and scene.disparity_window(far.limit(3), 800.0, 0.1, 640).count() == 0


def test_mesh_sampling(spark):
    verts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 9.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3)], "fid long, a long, b long, c long")
    out = mesh.sample_surface(verts, faces, n=400).toPandas()
    assert abs((out.fid == 0).sum() - 40) <= 1 and abs((out.fid == 1).sum() - 360) <= 1
    on = out[out.fid == 0]
    assert (on.z == 0).all() and (on.x + on.y <= 1 + 1e-9).all() and abs(on.x.mean() - 1 / 3) < 0.12
    assert mesh.sample_surface(verts, faces.limit(0)).count() == 4
    strips = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [1, 2])], "fid long, idx array<long>")
    assert [(r.a, r.b, r.c) for r in mesh.strip(strips).collect()] == [(1, 2, 3), (2, 3, 4)]
    assert [(r.a, r.b, r.c) for r in mesh.fan(strips).collect()] == [(1, 2, 3), (1, 3, 4)]


def test_functions(spark):
    lit = F.lit
    r = one(spark, *scalars.hex_to_rgb(lit("#fa0")), scalars.rgb_to_hex(lit(0.5), lit(1.5), lit(300)), scalars.mix(lit("#000000"), lit("#ffffff"), 0.5), scalars.extension(lit("/a.b/c.PLY")), scalars.extension(lit("/a.b/c")), scalars.basename(lit("x\\y/z")))
    assert tuple(r) == (255, 170, 0, "#0002ff", "#808080", ".ply", "", "z")
    r = one(spark, scalars.sigmoid(lit(-800.0)), scalars.sigmoid(lit(800.0)), scalars.to_byte(lit(float("nan"))), scalars.nice_step(lit(0.0)), scalars.nice_step(lit(0.034)), scalars.nice_step(lit(800.0)), scalars.data_uri(lit("data:x;base64,QUI=")))
    assert tuple(r) == (0.0, 1.0, None, 1.0, 0.02, 1000.0, bytearray(b"AB"))
    r = one(spark, *scalars.unpack_node(scalars.pack_node(lit(1000), lit(0xFFFFFF))), *scalars.viridis(lit(7.0)))
    assert tuple(r)[:2] == (1000, 0xFFFFFF) and all(0 <= v <= 1 for v in tuple(r)[2:])
    r = one(spark, *camera.back_project(lit(1.0), lit(1.0), lit(0.0), lit(1.0), lit(1.0), lit(0.0), lit(0.0)))
    assert tuple(r) == (None, None, None)


# Chains and streams


def test_cleanup_chain(spark):
    rng = np.random.default_rng(6)
    c = make(spark, np.vstack([rng.random((600, 3)), [[50, 50, 50]]]), r=[1] * 601, g=[2] * 601, b=[3] * 601)
    out = reconstruct.cleanup(c, Config(sor_k=8, voxel_size=0.25), ["point_id"])
    assert 40 <= out.count() <= 64 and out.agg(F.max("x")).first()[0] < 1


def test_progress(spark, tmp_path):
    lines = ["[features] 5/10", "nothing", "[match] 3 / 0", "[sfm] image 7: 30/60 inliers", "[pipeline] Done", "[clean] 9/3"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    assert [(r.stage, r.percent) for r in progress.parse(df).orderBy("n").collect()] == [("features", 10), ("match", 20), ("sfm", 57), ("pipeline] Done", 100), ("clean", 100)]
    assert tuple(progress.latest(df, "n").first()) == ("clean", 100)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(lines))
    q = progress.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("progress").count() == 5


def test_ema(spark):
    rng = np.random.default_rng(7)
    values = rng.random(50).tolist()
    df = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(values)], "key int, t int, v double")
    for r in progress.ema(df, "key", ["t"], "v").collect():
        mine = values[r.key :: 2]
        want = mine[0]
        for v in mine[1:]:
            want = 0.7 * want + 0.3 * v
        assert abs(r.ema - want) < 1e-12 and r.n == 25


def test_percentiles_are_exact(spark, monkeypatch):
    """Brackets hold the percentile whatever repeats; nulls do not count; interpolation as usual."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(0, 5, 1001)])
    df = spark.createDataFrame([(float(v), None if k % 3 else float(k), None) for k, v in enumerate(values)], "a double, b double, c double").repartition(5)
    wanted = {f"{c}{q}": (F.col(c), q) for c in "ab" for q in (0.0, 0.005, 0.37, 0.5, 0.995, 1.0)} | {"none": (F.col("c"), 0.5)}
    for sketch, few in ((cloud.SKETCH, cloud.FEW), (100, 50)):
        monkeypatch.setattr(cloud, "SKETCH", sketch)
        monkeypatch.setattr(cloud, "FEW", few)
        got = cloud.percentiles(df, wanted)
        assert got.pop("none") is None
        for name, v in got.items():
            assert v == pytest.approx(np.quantile(values if name[0] == "a" else np.arange(0, len(values), 3), float(name[1:])), abs=1e-9)
    assert cloud.percentiles(df.limit(0), {"x": (F.col("a"), 0.5)}) == {"x": None}
    assert cloud.sparse_bound(df.limit(0).selectExpr("a AS x", "a AS y", "a AS z")).first()["radius"] is None


def test_index_finds_the_nearest_of_clustered_descriptors(spark):
    from cairn.operators import index

    rng = np.random.default_rng(8)
    middle = rng.normal(0, 1, (40, 16))
    rows = [(k % 4, k, (middle[rng.integers(40)] + rng.normal(0, 0.15, 16)).astype(np.float32).tolist()) for k in range(1600)]
    features = spark.createDataFrame([*rows, (9, 5000, None), (8, 5001, rows[0][2])], "img int, feat bigint, desc array<float>")
    made = index.build(features)
    assert made.homes.count() == 1601 and made.probes < len(made.centers) / 3 and made.recall >= 0.95
    usable = features.where("desc IS NOT NULL")
    rows = index.recall(matching.nearest_two(usable), index.search(made, usable)).collect()
    assert {r["img"] for r in rows} == {0, 1, 2, 3, 8} and all(r["first"] > 0.9 and r["second"] > 0.9 for r in rows)
    everything = index.search(made, usable, probes=len(made.centers))
    key = lambda r: (r["img"], r["feat"], r["other"], round(r["d1"], 9), round(r["d2"], 9))
    assert sorted(map(key, everything.collect())) == sorted(map(key, matching.nearest_two(usable).collect()))
    assert index.build(features.limit(0)) is None


def test_index_cuts_long_lists(spark, monkeypatch):
    from cairn.operators import index

    monkeypatch.setattr(index, "PART", 40)
    rng = np.random.default_rng(9)
    features = spark.createDataFrame([(k % 3, k, rng.normal(0, 1, 4).tolist()) for k in range(300)], "img int, feat bigint, desc array<float>")
    made = index.build(features, lists=2)
    key = lambda r: (r["img"], r["feat"], r["other"], round(r["d1"], 5), round(r["d2"], 5), r["nearest"])
    assert sorted(map(key, index.search(made, features, probes=2).collect())) == sorted(map(key, matching.nearest_two(features).collect()))


def test_run_state_over_batches_and_restarts(spark, tmp_path):
    from cairn.streaming import runs

    rng = np.random.default_rng(3)
    rows = [(f"r{k % 5}" if k % 11 else None, k, None if k % 7 == 0 else float(rng.normal()), ("match" if k % 3 else "dense") if k % 4 else None, k % 100 if k % 4 else None) for k in range(200)]
    schema = "run string, ordinal bigint, value double, stage string, percent int"
    paths = [str(tmp_path / n) for n in ("in", "state", "out")]
    for a, z in ((0, 90), (90, 92), (92, 200)):
        spark.createDataFrame(rows[a:z], schema).repartition(3).write.mode("append").parquet(paths[0])
        runs.advance(spark, paths[0], schema, *paths[1:])
    want = {}
    for run, _, value, stage, percent in rows:
        if run is not None:
            s = want.setdefault(run, [0, None, None, None])
            if value is not None:
                s[0], s[1] = s[0] + 1, value if s[1] is None else 0.7 * s[1] + 0.3 * value
            if stage is not None:
                s[2:] = stage, percent
    got = {r["run"]: (r["n"], r["ema"], r["stage"], r["percent"]) for r in runs.latest(spark, paths[2]).collect()}
    assert got.keys() == want.keys()
    for run, (n, ema, stage, percent) in want.items():
        assert got[run][0] == n and abs(got[run][1] - ema) < 1e-12 and got[run][2:] == (stage, percent)


def test_place_scores_are_means_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF", 16)
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.uniform(-1, 1, (300, 3)), rng.integers(-2, 2, (200, 3)), np.full((9, 3), 0.25), [[1e6, 0, 0], [-0.0, 0, 0], [0.0, 0, 0]]])
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(xyz)] + [(1000, float("nan"), 0.0, 0.0)], "point_id long, x double, y double, z double").repartition(5)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for k in (1, 5, 12):
        want = np.sort(d, axis=1)[:, :k].mean(1)
        got = {r.point_id: r.mean_d for r in neighbors.outlier_scores(df, k).collect()}
        assert got.keys() == set(range(len(xyz))) and max(abs(got[n] - w) for n, w in enumerate(want)) < 1e-9
    # No list of all neighbours is made: a place with more than k points is not searched.
    made = neighbors._place_scores(df, 5)
    assert made.count() == len(np.unique(xyz + 0.0, axis=0)) and made.agg({"n": "sum"}).first()[0] == len(xyz)
    few = {r.point_id: r.mean_d for r in neighbors.outlier_scores(df.where("point_id < 3"), 5).collect()}
    small = np.where(np.isinf(d[:3, :3]), 0, d[:3, :3]).sum(1) / 2
    assert max(abs(few[n] - small[n]) for n in range(3)) < 1e-9


def test_rows_of_the_blocked_product_do_not_grow_with_blocks(spark):
    # 40 blocks of an image meet each block of the other: two rows a feature and task, not two for each of 40.
    rng = np.random.default_rng(2)
    f = spark.createDataFrame([(n % 2, n, rng.integers(0, 3, 4).astype(float).tolist()) for n in range(400)] + [(2, 1000, [0.0] * 4)], "img int, feat long, desc array<double>")
    key = lambda r: (r.img, r.feat, r.other, round(r.d1, 9), round(r.d2, 9), r.nearest)
    assert sorted(map(key, matching.nearest_two_blocked(f, block=5).collect())) == sorted(map(key, matching.nearest_two(f).collect()))
    x, y = rng.normal(size=(9, 4)), rng.normal(size=(1, 4))
    feat, d = matching._two_of(x, y, np.array([7]))
    assert (feat[:, 0] == 7).all() and (feat[:, 1] == matching.NONE).all() and np.isnan(d[:, 1]).all()


def test_ranges_compare_few_cuts(spark):
    df = spark.range(3000).selectExpr("id", "cast(pmod(hash(id), 700) AS double) AS v")
    parts = 100
    cuts = cloud._cuts(df, F.col("v"), parts).first()
    assert len(cuts["__wide"]) == (parts - 1) // cloud.WIDE
    got = cloud._ranged(df, F.col("v"), parts).select("v", "__range").distinct().collect()
    assert all(r["__range"] == sum(c < r.v for c in cuts["__cuts"]) for r in got) and len({r["__range"] for r in got}) > parts - 5


def test_blocked_search_of_some_features_and_of_many_copies(spark):
    # Copies are told apart by their features only: the two lowest count, however many there are in however many blocks.
    rng = np.random.default_rng(4)
    places = rng.normal(size=(7, 6)).astype(np.float32).astype(float)
    rows = [(n % 3, 7919 * n % 1009, places[rng.integers(7)].tolist()) for n in range(500)] + [(3, 2000, places[0].tolist()), (3, 2001, [1e20] * 6), (4, 2002, [0.0] * 6)]
    f = spark.createDataFrame(rows, "img int, feat long, desc array<double>")
    key = lambda r: (r.img, r.feat, r.other, r.d1, r.d2, r.nearest)
    plain = sorted(map(key, matching.nearest_two(f).collect()))
    for block in (40, 2048):
        assert sorted(map(key, matching.nearest_two_blocked(f, block=block).collect())) == plain
    some = matching.nearest_two_blocked(f, block=40, asked=f.where("feat % 50 = 0"))
    assert sorted(map(key, some.collect())) == [k for k in plain if k[1] % 50 == 0]


def test_blocks_are_dealt_to_tasks_whatever_their_size(spark):
    # One small table must not be one task; a pair of blocks is multiplied once, for both sides.
    f = features(spark, [30, 41, 25])
    assert matching._blocks(f, 5).rdd.getNumPartitions() >= 6
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (3, 200), (150, 70)):
        x, y = rng.normal(size=(n, 9)), rng.normal(size=(m, 9))
        fa, fb = rng.permutation(n), rng.permutation(m)
        for got, want in zip(matching._two_sides(x, y, fb, fa), (matching._two_plain(x, y, fb), matching._two_plain(y, x, fa)), strict=True):
            assert (got[0] == want[0]).all() and np.array_equal(got[1], want[1], equal_nan=True)


def test_index_asks_for_both_of_the_two_nearest(spark):
    from cairn.operators import index

    rng = np.random.default_rng(12)
    f = spark.createDataFrame([(k % 10, k, rng.normal(0, 1, 64).astype(np.float32).tolist()) for k in range(2000)], "img int, feat bigint, desc array<double>")
    made = index.build(f)
    rows = index.recall(matching.nearest_two_blocked(f), index.search(made, f)).collect()
    assert made.recall >= 0.95 and np.mean([r["second"] for r in rows]) > 0.935


def test_blocks_of_an_image_lie_together(spark):
    # A feature has two rows for each group that holds another image's blocks, so these must not be strewn over all groups.
    f = features(spark, [40, 40, 40, 40])
    blocks = matching._blocks(f, 4).withColumn("group", F.spark_partition_id())
    assert max(r["n"] for r in blocks.groupBy("img").agg(F.countDistinct("group").alias("n")).collect()) <= 5


def test_matches_of_both_directions_come_from_one_product(spark):
    f = features(spark, [40, 30, 20])
    found = matching.match_all(f, 0.9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, matching.match_all(f, 0.9, blocked=False).collect())) != []
    one_way = spark.createDataFrame([(0, 1, 1, 5), (1, 5, 0, 1), (0, 2, 1, 6), (1, 7, 0, 3), (2, 9, 0, None)], "img int, feat long, other int, ofeat long")
    assert [tuple(r) for r in matching.mutual_matches(one_way).collect()] == [(0, 1, 1, 5)]


def test_later_blocks_are_searched_below_the_second_best(spark):
    # Rows that have two look only at what may be as near: the result is that of all blocks at once, ties and copies included.
    rng = np.random.default_rng(9)
    for make in (lambda n: rng.normal(size=(n, 9)), lambda n: rng.integers(0, 2, (n, 4)).astype(float), lambda n: 1e8 + rng.integers(0, 3, (n, 3))):
        x, y = make(300), make(700)
        fa, fb = rng.permutation(300), rng.permutation(700)
        bests = [matching._no_two(300), matching._no_two(700)]
        for at in range(0, 700, 100):
            for k in range(0, 300, 60):
                some = [tuple(v[k : k + 60] for v in bests[0]), tuple(v[at : at + 100] for v in bests[1])]
                matching._meet(x[k : k + 60], y[at : at + 100], fb[at : at + 100], fa[k : k + 60], some)
        for got, want in zip(bests, (matching._two_plain(x, y, fb), matching._two_plain(y, x, fa)), strict=True):
            assert (got[0] == want[0]).all() and np.array_equal(got[1], want[1])


def test_a_block_has_one_row_for_an_image(spark):
    # Not two for each feature: 3 images of 40 features in blocks of 2048 are 6 pairs of a block and an image.
    plan = matching.nearest_two_blocked(features(spark, [40, 40, 40]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapGroupsInArrow" in plan
    twice = spark.createDataFrame([(k % 2, k // 4, [float(k), 1.0]) for k in range(24)], "img int, feat long, desc array<double>")  # two rows have the same feature
    key = lambda r: (r.img, r.feat, r.other, r.d1, r.d2, r.nearest)
    assert sorted(map(key, matching.nearest_two_blocked(twice, block=3).collect())) == sorted(map(key, matching.nearest_two(twice).collect()))


def _brute(p, weight, k, q=None, radius=None):
    d = np.sqrt((((p if q is None else q)[:, None] - p[None]) ** 2).sum(2))
    if q is None:
        np.fill_diagonal(d, np.inf)
    else:
        d[d > radius[:, None]] = np.inf
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(d, at, 1)
    return d, np.where(np.isfinite(d), weight[at], 0)


@pytest.mark.parametrize("kind", ["even", "far", "lines", "weights"])
@pytest.mark.parametrize("n", [1, 2, 17, 129, 3000])
def test_cells_find_all_neighbours_and_look_at_few_places(n, kind, monkeypatch):
    """Exact as all pairs; at 216 million places the job took too long with blocks of whole leaves."""
    rng = np.random.default_rng(n)
    p, k = rng.uniform(0, 1, (n, 3)) * [5, 40, 1], 16
    if kind == "far":
        p[::50, 2] += 1000
    if kind == "lines":
        p[:, ::2] = np.floor(p[:, ::2])
    weight = rng.integers(1, 4, n) if kind == "weights" else np.ones(n, int)
    looked, squares = [], neighbors._squares
    monkeypatch.setattr(neighbors, "_squares", lambda q, p: looked.append(q.shape[1] * p.shape[1]) or squares(q, p))
    d, w = neighbors.nearest_weights(p, weight, k)
    want, heavy = _brute(p, weight, k)
    m = want.shape[1]
    assert np.allclose(d[:, :m], want, rtol=1e-12) and not np.isfinite(d[:, m:]).any() and (w[:, :m] == heavy).all() and not w[:, m:].any()
    assert sum(looked) < 1200 * n
    q, radius = rng.uniform(0, 1, (40, 3)) * [5, 40, 1], rng.uniform(0, 3, 40)
    d, w = neighbors.nearest_weights(p, weight, k, q, radius)
    want, heavy = _brute(p, weight, k, q, radius)
    assert np.allclose(d[:, :m], want, rtol=1e-12) and (w[:, :m] == heavy).all() and not w[:, m:].any()


def test_scores_of_many_small_leaves(spark, monkeypatch):
    """Places that ask beyond their leaf, several points at a place, and far ones: means as from all pairs."""
    monkeypatch.setattr(neighbors, "LEAF", 40)
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(0, 1, (1500, 3)) * [5, 40, 1], 2)
    p[::60, 2] += 1000
    p[100:130], p[130:133] = p[100], p[200]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :16].mean(1)
    cloud_ = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(p)], "point_id long, x double, y double, z double")
    got = {r.point_id: r.mean_d for r in neighbors.outlier_scores(cloud_, 16).collect()}
    assert len(got) == 1500 and max(abs(got[n] - v) for n, v in enumerate(want)) < 1e-9


def test_knn_of_a_leaf_that_nobody_asks(spark):
    """A leaf of over 512 points without askers failed."""
    rng = np.random.default_rng(8)
    xyz = np.vstack([rng.random((600, 3)), rng.random((4, 3)) * 1000 + 1000])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    assert {(r.point_id, r.neighbor_id, round(r.d, 9), r["rank"]) for r in neighbors.knn(df, 6).collect()} == brute_nearest(np.arange(604), xyz, 6)
