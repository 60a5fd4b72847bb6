"""Files of fixed-length records: read in ranges of rows, so one file is many tasks."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.scalars import SH_C0
from . import files
from .files import FormatError

#: PLY type names, fixed values.
PLY_TYPES = {
    **dict.fromkeys(("char", "int8"), "i1"),
    **dict.fromkeys(("uchar", "uint8"), "u1"),
    **dict.fromkeys(("short", "int16"), "i2"),
    **dict.fromkeys(("ushort", "uint16"), "u2"),
    **dict.fromkeys(("int", "int32"), "i4"),
    **dict.fromkeys(("uint", "uint32"), "u4"),
    **dict.fromkeys(("float", "float32"), "f4"),
    **dict.fromkeys(("double", "float64"), "f8"),
}
#: Names that PLY files use for what a cloud has, fixed values.
PLY_NAMES = {"r": ("red", "r", "diffuse_red"), "g": ("green", "g", "diffuse_green"), "b": ("blue", "b", "diffuse_blue"), "nx": ("nx", "normal_x"), "ny": ("ny", "normal_y"), "nz": ("nz", "normal_z")}
SPLAT_ORDERS = {"color_first": ("rgba", "scale"), "scale_first": ("scale", "rgba")}

Columns = dict[str, np.ndarray]


@dataclass
class Layout:
    """Where records are, their fields, and what they mean."""

    kind: str
    offset: int
    count: int
    fields: np.dtype
    extra: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        return list(decode(self, np.zeros(1, self.fields)))


def read_rows(path: str, layout: Layout, first: int, count: int) -> Columns:
    """Columns of a range of records; a file that ends early gives what it has."""
    width = layout.fields.itemsize
    raw = files.read(path, layout.offset + first * width, count * width)
    return decode(layout, np.frombuffer(raw, layout.fields, len(raw) // width))


def byte_colors(values: list[np.ndarray], factor: float = 1.0) -> Columns:
    with np.errstate(invalid="ignore"):
        return {c: np.clip(np.asarray(v, np.float64) * factor, 0, 255).astype(np.uint8).astype(np.int16) for c, v in zip("rgb", values, strict=True)}


def unpack_rgb(packed: np.ndarray) -> Columns:
    packed = packed.astype(np.int64)
    return {c: (packed >> shift & 255).astype(np.int16) for c, shift in zip("rgb", (16, 8, 0), strict=True)}


def logistic(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def decode(layout: Layout, rows: np.ndarray) -> Columns:
    return {"ply": _ply_columns, "pcd": _pcd_columns, "splat": _splat_columns, "las": _las_columns}[layout.kind](layout, rows)


# PLY


@dataclass
class PlyHeader:
    form: str
    size: int
    elements: list[tuple[str, int, list[tuple[str, str]]]]

    def vertex(self) -> tuple[int, list[tuple[str, str]]]:
        for name, count, props in self.elements:
            if name == "vertex" and props:
                return count, props
        raise FormatError("no vertex element")


def ply_header(path: str) -> PlyHeader:
    """The header of a PLY file; properties are (name, type), of a list (name, "count item")."""
    head, length = b"", 1 << 14
    while b"end_header" not in head:
        more = files.read(path, 0, length)
        if len(more) == len(head):
            raise FormatError("the header does not end")
        head, length = more, length * 4
    end = head.index(b"\n", head.index(b"end_header")) + 1
    form, elements = None, []
    for line in head[:end].decode("ascii", "replace").splitlines()[1:]:
        match line.split():
            case ["format", name, *_]:
                form = name
            case ["element", name, count]:
                elements.append((name, int(count), []))
            case ["property", "list", count, item, name] if elements:
                elements[-1][2].append((name, f"{count} {item}"))
            case ["property", kind, name] if elements:
                elements[-1][2].append((name, kind))
    if form is None:
        raise FormatError("no format line")
    return PlyHeader(form, end, elements)


def ply_count(path: str) -> int:
    """Vertices that the header promises; the body is not read."""
    return ply_header(path).vertex()[0]


def ply_layout(path: str, header: PlyHeader) -> Layout:
    order = ">" if "big" in header.form else "<"
    at = header.size
    for name, count, props in header.elements:
        lists = [k for _, k in props if " " in k]
        if name == "vertex":
            if lists:
                raise FormatError("a list inside the vertex element")
            fields = np.dtype([(n, order + PLY_TYPES[k]) for n, k in props])
            held = max(0, files.size(path) - at) // max(1, fields.itemsize)
            return Layout("ply", at, min(count, held), fields)
        at = _skip(path, at, count, props, order) if lists else at + count * sum(np.dtype(PLY_TYPES[k]).itemsize for _, k in props)
    raise FormatError("no vertex element")


def _skip(path: str, at: int, count: int, props: list[tuple[str, str]], order: str) -> int:
    """The byte after an element with lists."""
    body = files.read(path, at)
    here = 0
    for _ in range(count):
        for _, kind in props:
            if " " in kind:
                n_type, item = (np.dtype(order + PLY_TYPES[k]) for k in kind.split())
                here += n_type.itemsize + int(np.frombuffer(body, n_type, 1, here)[0]) * item.itemsize
            else:
                here += np.dtype(PLY_TYPES[kind]).itemsize
    return at + here


def _pick(names: tuple[str, ...], group: str) -> list[str] | None:
    found = [next((n for n in PLY_NAMES[c] if n in names), None) for c in group.split()]
    return found if all(found) else None


def ply_columns(get, names: tuple[str, ...], floating: bool) -> Columns:
    """Cloud columns from the columns of a vertex element; `get` gives one by name."""
    if not {"x", "y", "z"} <= set(names):
        raise FormatError("the vertex element has no x, y and z")
    out: Columns = {c: get(c).astype(np.float32) for c in "xyz"}
    if "f_dc_0" in names and "opacity" in names:
        out |= byte_colors([SH_C0 * get(f"f_dc_{k}").astype(np.float64) + 0.5 for k in range(3)], 255.0)
        out["opacity"] = logistic(get("opacity")).astype(np.float32)
        scales = [get(f"scale_{k}").astype(np.float64) for k in range(3) if f"scale_{k}" in names]
        if scales:
            out["scale"] = np.mean(np.exp(scales), axis=0).astype(np.float32)
        return out
    if colors := _pick(names, "r g b"):
        out |= byte_colors([get(c) for c in colors], 255.0 if floating else 1.0)
    if normals := _pick(names, "nx ny nz"):
        out |= {c: get(n).astype(np.float32) for c, n in zip(("nx", "ny", "nz"), normals, strict=True)}
    return out


def _ply_columns(layout: Layout, rows: np.ndarray) -> Columns:
    names = layout.fields.names
    colors = _pick(names, "r g b")
    return ply_columns(lambda n: rows[n], names, bool(colors) and layout.fields[colors[0]].kind == "f")


# PCD


def pcd_header(path: str) -> tuple[dict[str, list[str]], int]:
    head, at, found = files.read(path, 0, 1 << 16), 0, {}
    while "DATA" not in found:
        end = head.find(b"\n", at)
        if end < 0:
            raise FormatError("no DATA line")
        words = head[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            found[words[0]] = words[1:]
    if found["DATA"] == ["binary_compressed"]:
        raise FormatError("compressed PCD files are not read; store them as binary or ascii")
    return found, at


def pcd_layout(path: str, found: dict[str, list[str]], at: int) -> Layout:
    names, widths = [f.lower() for f in found["FIELDS"]], [int(s) for s in found["SIZE"]]
    repeat = [int(c) for c in found.get("COUNT", ["1"] * len(names))]
    kinds = {"F": "f", "I": "i", "U": "u"}
    keep, offset = {}, 0
    for name, width, kind, times in zip(names, widths, found["TYPE"], repeat, strict=True):
        if times == 1 and name in ("x", "y", "z", "rgb", "rgba"):
            keep["rgb" if name == "rgba" else name] = (("<u4" if name.startswith("rgb") else f"<{kinds[kind]}{width}"), offset)
        offset += width * times
    fields = np.dtype({"names": list(keep), "formats": [k for k, _ in keep.values()], "offsets": [o for _, o in keep.values()], "itemsize": offset})
    return Layout("pcd", at, min(pcd_points(found), max(0, files.size(path) - at) // offset), fields)


def pcd_points(found: dict[str, list[str]]) -> int:
    points = int(found.get("POINTS", ["0"])[0])
    return points or int(found.get("WIDTH", ["1"])[0]) * int(found.get("HEIGHT", ["1"])[0])


def _pcd_columns(layout: Layout, rows: np.ndarray) -> Columns:
    out = {c: rows[c].astype(np.float32) for c in "xyz"}
    return out | unpack_rgb(rows["rgb"]) if "rgb" in layout.fields.names else out


# SPLAT


def splat_layout(path: str, order: str = "color_first") -> Layout:
    """32-byte records: place, then colour and scale in the order named, then the rotation."""
    parts = {"rgba": [(c, "u1") for c in "rgba"], "scale": [(f"s{c}", "<f4") for c in "xyz"]}
    fields = np.dtype([(c, "<f4") for c in "xyz"] + [f for p in SPLAT_ORDERS[order] for f in parts[p]] + [(f"q{k}", "u1") for k in range(4)])
    count = files.size(path) // fields.itemsize
    if not count:
        raise FormatError("no splats")
    return Layout("splat", 0, count, fields)


def _splat_columns(layout: Layout, rows: np.ndarray) -> Columns:
    out: Columns = {c: rows[c].astype(np.float32) for c in "xyz"}
    out |= {c: rows[c].astype(np.int16) for c in "rgb"}
    mean = np.mean([rows[f"s{c}"].astype(np.float64) for c in "xyz"], axis=0)
    return out | {"opacity": rows["a"].astype(np.float32) / np.float32(255), "scale": np.maximum(mean, 1e-6).astype(np.float32)}


# LAS


def las_layout(path: str) -> Layout:
    head = files.read(path, 0, 375)
    if len(head) < 179:
        raise FormatError("the header is too short")
    offset, form, width = struct.unpack_from("<I", head, 96)[0], head[104], struct.unpack_from("<H", head, 105)[0]
    if not width:
        raise FormatError("records of no length")
    said, held = struct.unpack_from("<I", head, 107)[0], max(0, files.size(path) - offset) // width
    count = min(said, held) if said else held
    if not count:
        raise FormatError("no points")
    places = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", 12)}
    color = {2: 20, 3: 28, 5: 28}.get(form)
    if color is not None:
        places |= {c: ("<u2", color + 2 * k) for k, c in enumerate("rgb")}
    fields = np.dtype({"names": list(places), "formats": [k for k, _ in places.values()], "offsets": [o for _, o in places.values()], "itemsize": width})
    return Layout("las", offset, count, fields, {"scale": struct.unpack_from("<3d", head, 131), "shift": struct.unpack_from("<3d", head, 155)})


def _las_columns(layout: Layout, rows: np.ndarray) -> Columns:
    out: Columns = {c: (rows[c.upper()] * s + o).astype(np.float32) for c, s, o in zip("xyz", layout.extra["scale"], layout.extra["shift"], strict=True)}
    if "r" in layout.fields.names:
        return out | {c: (rows[c] // 256).astype(np.int16) for c in "rgb"}
    return out | {"intensity": rows["intensity"].astype(np.int32)}


def layout_of(path: str, fmt: str, splat_order: str = "color_first") -> Layout | None:
    """The records of a file; None if its format has none (text forms)."""
    if fmt == "ply":
        header = ply_header(path)
        return None if header.form == "ascii" else ply_layout(path, header)
    if fmt == "pcd":
        found, at = pcd_header(path)
        return None if found["DATA"] == ["ascii"] else pcd_layout(path, found, at)
    if fmt == "splat":
        return splat_layout(path, splat_order)
    return las_layout(path) if fmt == "las" else None
