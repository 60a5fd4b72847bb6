"""Bytes of cloud and mesh formats, as their public descriptions lay them out, for queries that read them back.

Clouds come as arrays x, y, z (float32) and r, g, b (0..255). Formats with colours of 0..1 get the middle of each of
the 256 steps, so that no rounding of theirs shifts a colour.
"""

from __future__ import annotations

import base64
import io
import json
import struct

import numpy as np

from ..sources import writer

Cloud = dict[str, np.ndarray]
#: The corners of the triangles that meshes are made of: one for each whole number k, moved by k along x.
CORNERS = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], np.float32)


def places(c: Cloud, kind: str = "<f4") -> np.ndarray:
    return np.stack([c["x"], c["y"], c["z"]], axis=1).astype(kind)


def shades(c: Cloud, kind: str = "u1") -> np.ndarray:
    return np.stack([c["r"], c["g"], c["b"]], axis=1).astype(kind)


def unit(c: Cloud) -> np.ndarray:
    return (shades(c, "f8") + 0.5) / 255


def table(fields: list[tuple], **values: np.ndarray) -> bytes:
    rows = np.zeros(len(next(iter(values.values()))), fields)
    for name, v in values.items():
        rows[name] = v
    return rows.tobytes()


def lines(*columns: np.ndarray, sep: str = " ") -> str:
    return "".join(sep.join(map(repr, row)) + "\n" for row in zip(*[a.tolist() for a in columns], strict=True))


def ply_ascii(c: Cloud) -> bytes:
    return writer.header(len(c["x"]), False, True, False) + writer.encode(c, False, True, False)


def ply_big_endian(c: Cloud) -> bytes:
    """Faces stand before the vertices, and have to be skipped; z is a double."""
    faces = struct.pack(">B3i", 3, 0, 0, 0) + struct.pack(">B4i", 4, 0, 0, 0, 0)
    names = "".join(f"property {kind} {n}\n" for kind, n in (("float", "x"), ("float", "y"), ("double", "z"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue")))
    head = f"ply\nformat binary_big_endian 1.0\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex {len(c['x'])}\n{names}end_header\n"
    return head.encode() + faces + table([("x", ">f4"), ("y", ">f4"), ("z", ">f8"), ("r", "u1"), ("g", "u1"), ("b", "u1")], **{k: c[k] for k in "xyzrgb"})


def ply_gaussians(c: Cloud) -> bytes:
    """The colours are degree-0 coefficients (r, g, b) / 100 - 1; opacity and scales come before their activation, from b and g."""
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2"]
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(c['x'])}\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    dc = shades(c, "f8") / 100 - 1
    rest = [c["b"] / 10 - 1] + [c["g"] / 100 - k for k in range(3)]
    return head.encode() + np.column_stack([places(c), dc, *rest]).astype("<f4").tobytes()


def packed(c: Cloud) -> np.ndarray:
    return (shades(c, "u4") << np.array([16, 8, 0], "u4")).sum(axis=1).astype("<u4")


def pcd_binary(c: Cloud) -> bytes:
    head = f"VERSION .7\nFIELDS x y z extra rgb\nSIZE 4 4 4 2 4\nTYPE F F F U U\nCOUNT 1 1 1 3 1\nWIDTH {len(c['x'])}\nHEIGHT 1\nPOINTS {len(c['x'])}\nDATA binary\n"
    return head.encode() + table([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("extra", "<u2", 3), ("rgb", "<u4")], **{k: c[k] for k in "xyz"}, rgb=packed(c))


def pcd_ascii(c: Cloud) -> bytes:
    head = f"VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {len(c['x'])}\nHEIGHT 1\nPOINTS {len(c['x'])}\nDATA ascii\n"
    return (head + lines(c["x"], c["y"], c["z"], packed(c))).encode()


def obj(c: Cloud) -> bytes:
    return "".join("v " + row + "\n" for row in lines(*places(c).T, *unit(c).T).splitlines()).encode()


def off(c: Cloud) -> bytes:
    return f"OFF\n{len(c['x'])} 0 0\n{lines(*places(c).T)}".encode()


def delimited(c: Cloud) -> bytes:
    return ("x;y;z;red;green;blue\n" + lines(*places(c).T, *shades(c).T, sep=";")).encode()


def track_text(c: Cloud) -> bytes:
    """Points of a sparse reconstruction: number, place, colour, error, then pairs of image and feature."""
    n = np.arange(len(c["x"]))
    return ("# points\n" + lines(n + 1, *places(c).T, *shades(c).T, np.full(len(n), 0.5), n, n)).encode()


def track_binary(c: Cloud) -> bytes:
    """The same as records; the tracks have 0 to 2 images."""
    rows = zip(places(c, "f8").tolist(), shades(c).tolist(), strict=True)
    body = [struct.pack("<Q3d3BdQ", k, *at, *color, 0.5, k % 3) + bytes(8 * (k % 3)) for k, (at, color) in enumerate(rows)]
    return struct.pack("<Q", len(body)) + b"".join(body)


def splat(c: Cloud) -> bytes:
    fields = [("at", "<f4", 3), ("color", "u1", 3), ("alpha", "u1"), ("scale", "<f4", 3), ("turn", "u1", 4)]
    return table(fields, at=places(c), color=shades(c), alpha=c["b"], scale=(c["g"].astype("f8")[:, None] + np.arange(3)))


def las(c: Cloud) -> bytes:
    """Hundredths, shifted by 10, 20 and 30; colours of 16 bits."""
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    head[104] = 2
    struct.pack_into("<HI", head, 105, 26, len(c["x"]))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10, 20, 30)
    whole = np.rint((places(c, "f8") - [10, 20, 30]) * 100).astype("<i4")
    return bytes(head) + table([("at", "<i4", 3), ("intensity", "<u2"), ("more", "u1", 6), ("color", "<u2", 3)], at=whole, color=shades(c, "<u2") * 256 + 5)


def vox(c: Cloud) -> bytes:
    """Cells r, g, b of palette entry g + 1, whose colour is (g, 255 - g, 3)."""
    chunk = lambda name, own, inner=b"": name + struct.pack("<II", len(own), len(inner)) + own + inner
    cells = struct.pack("<I", len(c["x"])) + np.column_stack([shades(c), c["g"] + 1]).astype("u1").tobytes()
    palette = b"".join(bytes([k, 255 - k, 3, 255]) for k in range(256))
    return b"VOX " + struct.pack("<I", 150) + chunk(b"MAIN", b"", chunk(b"XYZI", cells) + chunk(b"RGBA", palette))


def npy(c: Cloud) -> bytes:
    out = io.BytesIO()
    np.save(out, np.hstack([places(c, "f8"), unit(c)]))
    return out.getvalue()


def npz(c: Cloud) -> bytes:
    """A checkpoint: places, colours and one array that is none of a cloud's."""
    out = io.BytesIO()
    np.savez(out, means=places(c), colors=unit(c), loss=np.ones(3))
    return out.getvalue()


def _gltf(at: np.ndarray, color: np.ndarray | None, index: np.ndarray | None, mode: int) -> tuple[dict, bytes]:
    given = [(at, "<f4", "VEC3"), (color, "<f4", "VEC3"), (index, "<u4", "SCALAR")]
    parts, kinds = zip(*[(a.astype(t), kind) for a, t, kind in given if a is not None], strict=True)
    raw = [p.tobytes() for p in parts]
    starts = np.cumsum([0] + [len(p) for p in raw]).tolist()
    prim = {"attributes": {"POSITION": 0} | ({"COLOR_0": 1} if color is not None else {}), "mode": mode} | ({"indices": len(kinds) - 1} if index is not None else {})
    spec = {
        "asset": {"version": "2.0"},
        "meshes": [{"primitives": [prim]}],
        "accessors": [{"bufferView": k, "componentType": 5125 if kind == "SCALAR" else 5126, "type": kind, "count": len(parts[k])} for k, kind in enumerate(kinds)],
        "bufferViews": [{"buffer": 0, "byteOffset": s, "byteLength": len(r)} for s, r in zip(starts, raw, strict=False)],
    }
    return spec, b"".join(raw)


def glb(c: Cloud) -> bytes:
    spec, raw = _gltf(places(c), unit(c), None, 0)
    body = json.dumps(spec | {"buffers": [{"byteLength": len(raw)}]}).encode()
    body += b" " * (-len(body) % 4)
    return b"glTF" + struct.pack("<II", 2, 28 + len(body) + len(raw)) + struct.pack("<I4s", len(body), b"JSON") + body + struct.pack("<I4s", len(raw), b"BIN\0") + raw


def gltf(c: Cloud) -> bytes:
    spec, raw = _gltf(places(c), unit(c), None, 0)
    uri = "data:application/octet-stream;base64," + base64.b64encode(raw).decode()
    return json.dumps(spec | {"buffers": [{"byteLength": len(raw), "uri": uri}]}).encode()


# Meshes of one triangle for each k


def _corners(c: Cloud) -> np.ndarray:
    return CORNERS[None] + np.stack([c["x"], 0 * c["x"], 0 * c["x"]], axis=1)[:, None].astype(np.float32)


def obj_faces(c: Cloud) -> bytes:
    verts = "".join("v " + row + "\n" for row in lines(*_corners(c).reshape(-1, 3).T).splitlines())
    return (verts + "".join(f"f {3 * k + 1}/1 {3 * k + 2}/1 {3 * k + 3}/1\n" for k in range(len(c["x"])))).encode()


def off_faces(c: Cloud) -> bytes:
    n = len(c["x"])
    return (f"OFF\n{3 * n} {n} 0\n" + lines(*_corners(c).reshape(-1, 3).T) + "".join(f"3 {3 * k} {3 * k + 1} {3 * k + 2}\n" for k in range(n))).encode()


def stl(c: Cloud) -> bytes:
    return b"triangles".ljust(80) + struct.pack("<I", len(c["x"])) + table([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("more", "<u2")], corner=_corners(c))


def stl_ascii(c: Cloud) -> bytes:
    facet = lambda t: "facet normal 0 0 1\nouter loop\n" + "".join("vertex " + row + "\n" for row in lines(*t.T).splitlines()) + "endloop\nendfacet\n"
    return ("solid triangles\n" + "".join(facet(t) for t in _corners(c)) + "endsolid triangles\n").encode()


def gltf_faces(c: Cloud) -> bytes:
    spec, raw = _gltf(_corners(c).reshape(-1, 3), None, np.arange(3 * len(c["x"])), 4)
    uri = "data:application/octet-stream;base64," + base64.b64encode(raw).decode()
    return json.dumps(spec | {"buffers": [{"byteLength": len(raw), "uri": uri}]}).encode()
