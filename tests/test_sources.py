"""Every format from bytes that are made here, and the PLY sink."""

import base64
import io
import json
import struct

import numpy as np
import pytest

from cairn.sources import detect, reader, records, text, whole, writer
from cairn.sources.files import FormatError

XYZ = np.array([[0, 1, 2], [-3.5, 4, 5], [6, 7, -8]], np.float32)
RGB = np.array([[1, 2, 3], [250, 128, 0], [9, 255, 7]], np.uint8)


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("point_id").select(*names).collect()]


def ply(form, order, faces_first=False, kind="uchar", names=("red", "green", "blue")):
    face = "element face 2\nproperty list uchar int vertex_indices\n"
    vertex = "element vertex 3\nproperty float x\nproperty float y\nproperty double z\n" + "".join(f"property {kind} {n}\n" for n in names)
    head = f"ply\nformat {form} 1.0\ncomment made here\n" + (face + vertex if faces_first else vertex + face) + "end_header\n"
    if form == "ascii":
        v = "".join(f"{a[0]} {a[1]} {a[2]} {c[0]} {c[1]} {c[2]}\n" for a, c in zip(XYZ, RGB))
        f = "3 0 1 2\n4 0 1 2 0\n"
        return (head + (f + v if faces_first else v + f)).encode()
    code = {"uchar": "3B", "float": "3f"}[kind]
    v = b"".join(struct.pack(order + "2fd" + code, *a.tolist(), *(c.tolist() if kind == "uchar" else (c / 255).tolist())) for a, c in zip(XYZ, RGB))
    f = struct.pack(order + "B3i", 3, 0, 1, 2) + struct.pack(order + "B4i", 4, 0, 1, 2, 0)
    return head.encode() + (f + v if faces_first else v + f)


@pytest.mark.parametrize("form, order", [("binary_little_endian", "<"), ("binary_big_endian", ">"), ("ascii", "")])
@pytest.mark.parametrize("faces_first", [False, True])
def test_ply(spark, tmp_path, form, order, faces_first):
    path = put(tmp_path, "a.ply", ply(form, order, faces_first))
    out = reader.read_cloud(spark, path, rowsPerPartition=2)
    assert rows(out, "x", "y", "z") == [tuple(map(float, r)) for r in XYZ]
    assert rows(out, "r", "g", "b") == [tuple(map(int, r)) for r in RGB]
    assert records.ply_count(path) == 3


def test_ply_variants(spark, tmp_path):
    floating = reader.read_cloud(spark, put(tmp_path, "f.ply", ply("binary_little_endian", "<", kind="float", names=("diffuse_red", "diffuse_green", "diffuse_blue"))))
    assert [abs(a - b) <= 1 for x, y in zip(rows(floating, "r", "g", "b"), RGB.tolist()) for a, b in zip(x, y)] == [True] * 9
    short = ply("binary_little_endian", "<")
    cut = short.index(b"end_header\n") + 11 + 19 + 5
    assert reader.read_cloud(spark, put(tmp_path, "t.ply", short[:cut])).count() == 1
    only = reader.read_cloud(spark, put(tmp_path, "c.ply", short), columns=["x", "z"])
    assert only.columns == ["point_id", "x", "z"]
    with pytest.raises(FormatError):
        records.ply_header(put(tmp_path, "bad.ply", "ply\nformat ascii 1.0\nelement vertex 1\n"))


def test_ply_splats(spark, tmp_path):
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2"]
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    data = np.array([[0, 0, 0, 0, 1, -9, 0, 0, 0, 0], [1, 1, 1, 9, 0, 0, -2, 1, 2, 3]], "<f4")
    out = reader.read_cloud(spark, put(tmp_path, "g.ply", head.encode() + data.tobytes()))
    a, b = out.orderBy("point_id").collect()
    assert (a.r, a.g, a.b) == (127, 199, 0) and a.opacity == 0.5 and a.scale == 1.0
    assert b.r == 255 and abs(b.opacity - 1 / (1 + np.exp(2))) < 1e-6 and abs(b.scale - np.exp([1, 2, 3]).mean()) < 1e-5


@pytest.mark.parametrize(
    "body, colors",
    [
        ("# note\n3\n0 1 2 10 20 30\n3 4 5 40 50 60\n", [(10, 20, 30), (40, 50, 60)]),
        ("x,y,z,red,green,blue\n0,1,2,0.0,0.5,1.0\n3,4,5,0.1,0.2,0.3\n", [(0, 127, 255), (25, 51, 76)]),
        ("0\t1\t2\t7\n3\t4\t5\t9\n", [(7, 7, 7), (9, 9, 9)]),
        ("Z;Y;X\n2;1;0\n5;4;3\n", None),
    ],
)
def test_text(spark, tmp_path, body, colors):
    out = reader.read_cloud(spark, put(tmp_path, "a.xyz", body))
    assert rows(out, "x", "y", "z") == [(0, 1, 2), (3, 4, 5)]
    assert (rows(out, "r", "g", "b") if colors else None) == colors


def test_text_normals_and_track_points(spark, tmp_path):
    out = reader.read_cloud(spark, put(tmp_path, "n.txt", "0 0 1 1 2 3 0 0 1\n1 1 1 4 5 6 0 1 0\n"))
    assert rows(out, "nz", "b") == [(1.0, 3), (0.0, 6)]
    out = reader.read_cloud(spark, put(tmp_path, "p.txt", "# id x y z r g b\n7 3.5 1 2 10 20 30 0.5 1 2\n9 -4 0 1 40 50 60 0.1 3 4\n"))
    assert rows(out, "x", "r") == [(3.5, 10), (-4.0, 40)]


def test_pcd(spark, tmp_path):
    head = "VERSION .7\nFIELDS x y z extra rgb\nSIZE 4 4 4 2 4\nTYPE F F F U U\nCOUNT 1 1 1 3 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA "
    packed = [int(r) << 16 | int(g) << 8 | int(b) for r, g, b in RGB]
    body = b"".join(struct.pack("<3f3HI", *a.tolist(), 1, 2, 3, p) for a, p in zip(XYZ, packed))
    out = reader.read_cloud(spark, put(tmp_path, "b.pcd", (head + "binary\n").encode() + body))
    assert rows(out, "x", "y", "z") == [tuple(map(float, r)) for r in XYZ] and rows(out, "r", "g", "b") == [tuple(map(int, r)) for r in RGB]
    text_head = "VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nWIDTH 3\nHEIGHT 1\nDATA ascii\n"
    bits = np.array(packed, "<u4").view("<f4")
    lines = "".join(f"{a[0]} {a[1]} {a[2]} {float(f)!r}\n" for a, f in zip(XYZ, bits))
    out = reader.read_cloud(spark, put(tmp_path, "a.pcd", text_head + lines))
    assert rows(out, "r", "g", "b") == [tuple(map(int, r)) for r in RGB]
    with pytest.raises(FormatError):
        whole.read_file(put(tmp_path, "c.pcd", head + "binary_compressed\n"), "pcd")


def test_meshes(tmp_path):
    square = "v 0 0 0 1 0 0\nv 1 0 0 1 0 0\nv 1 1 0 1 0 0\nv 0 1 0 1 0 0\n"
    a = whole.obj(put(tmp_path, "a.obj", square + "f 1/1 2/1 3/1 4/1\n"))
    b = whole.obj(put(tmp_path, "b.obj", square + "f -4 -3 -2 -1\n"))
    assert len(a["x"]) == 400 and np.array_equal(a["x"], b["x"]) and set(a["r"]) == {255} and a["x"].max() <= 1 and abs(a["x"].mean() - 0.5) < 0.05
    assert len(whole.obj(put(tmp_path, "c.obj", square))["x"]) == 4
    for name, head in (("a.off", "OFF\n4 1 0\n"), ("b.off", "OFF 4 1 0\n"), ("c.off", "# c\nOFF\n4 1 0\n")):
        path = put(tmp_path, name, head + "0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
        assert detect.detect(path) == "off" and len(whole.off(path)["x"]) == 400
    tri = struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    path = put(tmp_path, "s.stl", b"solid of facet".ljust(80) + struct.pack("<I", 2) + tri * 2)
    assert detect.detect(path) == "stl" and len(whole.stl(path)["x"]) == 400
    path = put(tmp_path, "t.stl", "solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid a\n")
    assert detect.detect(path) == "stl_ascii" and len(whole.stl_ascii(path)["x"]) == 200


def test_splat_las_vox_colmap(spark, tmp_path):
    rec = b"".join(struct.pack("<3f4B3f4B", *a.tolist(), *c.tolist(), 128, 1, 2, 3, 0, 0, 0, 0) for a, c in zip(XYZ, RGB))
    out = reader.read_cloud(spark, put(tmp_path, "a.splat", rec))
    assert rows(out, "r", "scale") == [(1, 2.0), (250, 2.0), (9, 2.0)]
    for form, width, at in ((0, 20, None), (2, 26, 20), (3, 34, 28)):
        head = bytearray(227)
        head[:4] = b"LASF"
        struct.pack_into("<I", head, 96, 227)
        head[104] = form
        struct.pack_into("<HI", head, 105, width, 2)
        struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10, 20, 30)
        body = bytearray()
        for k in range(2):
            r = bytearray(width)
            struct.pack_into("<3iH", r, 0, 2 * k, 4, 6, 1000 * (k + 1))
            if at:
                struct.pack_into("<3H", r, at, 65535, 256 * 7, 255)
            body += r
        path = put(tmp_path, f"{form}.las", bytes(head) + bytes(body))
        out = reader.read_cloud(spark, path)
        assert rows(out, "x", "y", "z") == [(10, 22, 33), (11, 22, 33)]
        assert rows(out, "r", "g", "b") == ([(127, 127, 127), (255, 255, 255)] if at is None else [(255, 7, 0)] * 2)
    path = put(tmp_path, "z.laz", bytes(head))
    assert detect.detect(path) == "laz"
    with pytest.raises(FormatError):
        whole.read_file(path, "laz")

    def chunk(name, own, inner=b""):
        return name + struct.pack("<II", len(own), len(inner)) + own + inner

    cells = struct.pack("<I", 2) + bytes([1, 2, 3, 1, 4, 5, 6, 0])
    palette = bytes(k % 256 for k in range(1024))
    for inner, first in ((chunk(b"XYZI", cells), 200), (chunk(b"XYZI", cells) + chunk(b"RGBA", palette), 0)):
        made = whole.vox(put(tmp_path, "a.vox", b"VOX " + struct.pack("<I", 150) + chunk(b"MAIN", b"", inner)))
        assert made["x"].tolist() == [1.5, 4.5] and made["r"][0] == first
    binary = struct.pack("<Q", 2) + b"".join(struct.pack("<Q3d3BdQ", 5, *a.tolist(), *c.tolist(), 0.5, n) + bytes(8 * n) for a, c, n in zip(XYZ.astype(float), RGB, (2, 0)))
    made = whole.colmap(put(tmp_path, "points3D.bin", binary))
    assert made["x"].tolist() == [0, -3.5] and made["g"].tolist() == [2, 128]


def test_gltf(tmp_path):
    places = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], "<f4")
    mixed = np.zeros(4, [("p", "<f4", 3), ("c", "u1", 4)])
    mixed["p"], mixed["c"] = places, [255, 0, 0, 255]
    raw = mixed.tobytes() + np.array([0, 1, 2, 3], "<u2").tobytes()
    spec = {
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "indices": 2, "mode": 5}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 4}, {"bufferView": 0, "byteOffset": 12, "componentType": 5121, "type": "VEC4", "count": 4, "normalized": True}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 4}],
        "bufferViews": [{"buffer": 0, "byteStride": 16}, {"buffer": 0, "byteOffset": 64}],
    }
    body = json.dumps(spec).encode()
    body += b" " * (-len(body) % 4)
    glb = b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<I4s", len(body), b"JSON") + body + struct.pack("<I4s", len(raw), b"BIN\0") + raw
    path = put(tmp_path, "a.glb", glb)
    made = whole.read_file(path, detect.detect(path))
    assert len(made["x"]) == 400 and set(made["r"]) == {255} and set(made["g"]) == {0}
    for uri in ("data:application/octet-stream;base64," + base64.b64encode(raw).decode(), "side.bin"):
        put(tmp_path, "side.bin", raw)
        path = put(tmp_path, "a.gltf", json.dumps(spec | {"buffers": [{"uri": uri}]}))
        assert np.array_equal(whole.read_file(path, detect.detect(path))["x"], made["x"])
    with pytest.raises(FormatError):
        whole.gltf(put(tmp_path, "b.gltf", json.dumps(spec | {"buffers": [{"uri": "../side.bin"}]})))


def test_arrays(tmp_path):
    def npy(a):
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    assert len(whole.npy(put(tmp_path, "a.npy", npy(XYZ)))["x"]) == 3
    assert whole.npy(put(tmp_path, "b.npy", npy(np.hstack([XYZ, RGB / 256.0]))))["r"].tolist() == [0, 249, 8]
    assert len(whole.npy(put(tmp_path, "c.npy", npy(XYZ.ravel())))["x"]) == 3
    grid = np.zeros((4, 5, 6))
    grid[1, 2, 4] = 9
    made = whole.npy(put(tmp_path, "d.npy", npy(grid)))
    assert [made[c].tolist() for c in "xyz"] == [[4], [2], [1]]
    with pytest.raises(FormatError):
        whole.npy(put(tmp_path, "e.npy", npy(np.zeros((4, 5, 3)))))
    path = str(tmp_path / "f.npz")
    np.savez(path, means=XYZ, opacities=np.zeros(3), opacity=np.array([0, -5.0, 5]), log_scales=np.zeros((3, 3)), features_dc=np.zeros((3, 1, 3)))
    made = whole.read_file(path, detect.detect(path))
    assert made["opacity"][0] == 0.5 and made["scale"].tolist() == [1, 1, 1] and made["r"].tolist() == [127] * 3
    np.savez(path, a=np.array([{}], object))
    with pytest.raises(FormatError):
        whole.npz(path)
    made = whole.from_bag({"state": {"x": XYZ[:, 0], "y": XYZ[:, 1], "z": XYZ[:, 2]}})
    assert made["z"].tolist() == [2, 5, -8]


def test_bags_by_role():
    """Names by their words, shapes by role, as many rows as places; what fits nothing is left alone."""
    other = np.arange(30.0).reshape(10, 3)
    made = whole.from_bag({"scene": {"points": XYZ, "colors": RGB / 256.0, "normals": XYZ}, "error": other})
    assert made["z"].tolist() == [2, 5, -8] and made["g"].tolist()[1] == int(RGB[1, 1] / 256.0 * 255) and made["nx"].tolist() == XYZ[:, 0].tolist()
    assert len(whole.from_bag({"a": XYZ, "b": other})["x"]) == 10
    assert "scale" not in whole.from_bag({"xyz": XYZ, "scales": np.ones(7)})
    made = whole.from_bag({"_xyz": XYZ, "_opacity": np.zeros((3, 1)), "_scaling": np.zeros((3, 3)), "_features_dc": np.zeros((3, 3, 1)), "_rotation": np.zeros((3, 4))})
    assert made["opacity"].tolist() == [0, 0, 0] and made["scale"].tolist() == [1, 1, 1]
    assert whole.from_bag({"points": XYZ, "radii": np.full(3, 0.5)})["scale"].tolist() == [0.5] * 3
    for bag in ({}, {"x": np.ones(3), "y": np.ones(3)}, {"names": np.array(["a"])}):
        with pytest.raises(FormatError):
            whole.from_bag(bag)


@pytest.mark.parametrize(
    ("name", "body", "want"),
    [("a.stl", b"solid x".ljust(80) + (1).to_bytes(4, "little") + b"\0" * 50, "stl"), ("a.stl", "solid x\nfacet normal 0 0 1\n", "stl_ascii"), ("a.stl", b"\0" * 90, "stl"), ("a.bin", "solid x\nfacet\n", "stl_ascii"), ("a.dat", "# c\nVERSION 0.7\nFIELDS x y z\n", "pcd"), ("a.txt", "# c\n1 2 3\n", "text"), ("a.ply", "no magic", "ply"), ("a.pt", b"PK\x03\x04junk", "torch"), ("a.zip", b"PK\x03\x04junk", "npz"), ("a.x", "", "text"), ("a.bin", b"\x01\0\0\0", "colmap"), ("a.json", ' {"asset": {}}', "gltf")],
)
def test_detection_by_evidence(tmp_path, name, body, want):
    assert detect.detect(put(tmp_path, name, body)) == want


def test_detection_and_formats(spark, tmp_path):
    assert detect.detect(put(tmp_path, "a.bin", "OFF\n1 0 0\n0 0 0\n")) == "off"
    assert detect.detect(put(tmp_path, "b.dat", "v 0 0 0\n")) == "obj"
    assert detect.detect(put(tmp_path, "c.csv", "1,2,3\n")) == "text"
    assert detect.is_supported("x.PLY") and not detect.is_supported("x.h5")
    table = {r.ext: r.available for r in detect.formats(spark).collect()}
    assert table[".ply"] and not table[".laz"]


@pytest.mark.parametrize("binary", [True, False])
def test_ply_round_trip(spark, tmp_path, binary):
    data = [(k, float(np.float32(k * 0.37)), -float(k), 0.5, k % 256, 3, 300) for k in range(1000)]
    df = spark.createDataFrame(data, "point_id long, x double, y double, z double, r int, g int, b int").repartition(7)
    path = str(tmp_path / "o.ply")
    assert writer.write_cloud(df, path, ["point_id"], binary) == 1000
    back = rows(reader.read_cloud(spark, path), "x", "y", "z", "r", "g", "b")
    assert len(back) == 1000 and all(abs(a[0] - b[1]) < 1e-5 and a[3:] == (b[4], 3, 255) for a, b in zip(back, data))
    with pytest.raises(FormatError):
        writer.write_cloud(df, "o.las", ["point_id"])
    assert reader.read_cloud(spark, path, max_points=300).count() == 250
    assert reader.read_points(spark, path).columns == ["x", "y", "z", "r", "g", "b"]


def test_sfm_text_and_images(spark, tmp_path):
    from cairn.sources import images

    cams = text.read_sfm_cameras(spark, put(tmp_path, "cameras.txt", "# c\n1 PINHOLE 640 480 500 501 320 240\n")).first()
    assert cams.params == [500, 501, 320, 240]
    made = text.read_sfm_images(spark, put(tmp_path, "images.txt", "# c\n1 1 0 0 0 1 2 3 1 a b.jpg\n5 6 -1 7 8 9\n2 1 0 0 0 1 2 3 1 c.jpg\n\n")).orderBy("image_id").collect()
    assert made[0]["name"] == "a b.jpg" and [tuple(p) for p in made[0].points] == [(5, 6, -1), (7, 8, 9)] and made[1].points == []
    for name in ("b.JPG", "a.png", "c.txt"):
        put(tmp_path, name, "x")
    listed = images.with_cache_key(images.list_images(spark, str(tmp_path)), 1600, 8000, 0.004, 10.0)
    assert {r["name"] for r in listed.collect()} == {"a.png", "b.JPG"}
    folder = str(tmp_path / "cache")
    images.write_features(listed.where("name = 'a.png'").select("cache_key", "name"), folder)
    hit, miss = images.split_cached(listed, spark.read.parquet(folder))
    assert [r["name"] for r in hit.collect()] == ["a.png"] and [r["name"] for r in miss.collect()] == ["b.JPG"]


def test_text_files_are_read_in_splits(spark, tmp_path):
    """The same rows from many tasks as from the whole file, with other elements before and after, and odd lines."""
    rng = np.random.default_rng(5)
    rows = [f"{i} {a:.6f} {b:.6f} {int(c)} {int(d)} {int(e)}" for i, (a, b, c, d, e) in enumerate(np.column_stack([rng.normal(0, 9, (4000, 2)), rng.integers(0, 256, (4000, 3))]))]
    rows[7], rows[3999] = "1 2", "5 5 5 1 2 3 trailing words"
    head = "ply\nformat ascii 1.0\ncomment x\nelement other 2\nproperty float q\nelement vertex 4000\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    ply = put(tmp_path, "many.ply", head + "0.5\n0.25\n" + "\n".join(rows) + "\n3 0 1 2\n")
    pcd = put(tmp_path, "many.pcd", "VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nWIDTH 4000\nHEIGHT 1\nDATA ascii\n" + "\n".join(f"{i} 1 2 {(i * 7919) % (1 << 24)}" + ("\n" if i % 500 == 3 else "") for i in range(4000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for path, fmt in ((ply, "ply"), (pcd, "pcd")):
            made = reader.read_cloud(spark, path)
            assert made.rdd.getNumPartitions() > 5
            want = whole.READERS[fmt](path)
            got = made.orderBy("point_id").toPandas()
            assert got["point_id"].is_unique and all(np.array_equal(got[c].to_numpy(np.float64), want[c].astype(np.float64)) for c in "xyzrgb")
        many = "# head\n" + "".join(f"{k} 1 0 0 0 {k} 2 3 1 {k}.jpg\n{'' if k % 3 else f'{k} 6 {k}'}\n" for k in range(1500))
        images = text.read_sfm_images(spark, put(tmp_path, "images.txt", many)).orderBy("image_id").collect()
        assert [(r.image_id, r.t[0], len(r.points)) for r in images] == [(k, k, int(k % 3 == 0)) for k in range(1500)]
        assert reader.read_cloud(spark, ply).where("point_id = 8").first()["x"] == 8.0 and reader.read_cloud(spark, ply, columns=["x"]).columns == ["point_id", "x"]
        assert reader.read_cloud(spark, f"{ply},{put(tmp_path, 'b.ply', head.replace('4000', '2') + '0' + chr(10) + '0' + chr(10) + chr(10).join(rows[:2]) + chr(10))}").count() == 4001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ply_parts_pass_no_bytes_through_the_driver(spark, tmp_path):
    from cairn.sources import read_cloud, writer

    df = spark.range(1000).selectExpr("cast(id AS double) AS x", "cast(id * 2 AS double) AS y", "1.5D AS z", "cast(id % 256 AS int) AS r", "1 AS g", "2 AS b").repartition(3)
    assert writer.write_ply_parts(df, str(tmp_path / "parts")) == 1000
    back = read_cloud(spark, str(tmp_path / "parts"))
    assert sorted((r.x, r.y, r.z, r.r, r.g, r.b) for r in back.collect()) == [(n, 2 * n, 1.5, n % 256, 1, 2) for n in range(1000)]
    assert len(list((tmp_path / "parts").glob("*.ply"))) == 3
    assert writer.write_ply_parts(df.limit(0), str(tmp_path / "none")) == 0 and read_cloud(spark, str(tmp_path / "none")).count() == 0
