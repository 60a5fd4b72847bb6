"""Which format a file has: by its first bytes, then by its name."""

from __future__ import annotations

import importlib.util
import io
import struct
import zipfile
from typing import NamedTuple

from . import files

#: Extensions by format, and the module that an optional one needs, fixed values.
EXTENSIONS = {
    "ply": [".ply"],
    "text": [".xyz", ".xyzrgb", ".xyzn", ".pts", ".csv", ".asc", ".txt"],
    "pcd": [".pcd"],
    "obj": [".obj"],
    "off": [".off"],
    "stl": [".stl"],
    "las": [".las"],
    "splat": [".splat"],
    "npy": [".npy"],
    "npz": [".npz"],
    "vox": [".vox"],
    "glb": [".glb"],
    "gltf": [".gltf"],
    "colmap": [".bin"],
    "torch": [".pt", ".pth"],
    "hdf5": [".h5", ".hdf5"],
    "laz": [".laz"],
    "packed_splat": [".ksplat", ".spz", ".sog"],
}
OPTIONAL = {"torch": "torch", "hdf5": "h5py", "laz": "lazrs", "packed_splat": "gaussforge"}
GROUPS = {
    "point cloud": ["ply", "pcd", "las", "text", "laz"],
    "mesh": ["obj", "stl", "off", "glb", "gltf"],
    "gaussian splats": ["splat", "packed_splat"],
    "arrays": ["npy", "npz", "torch", "hdf5"],
    "voxels": ["vox"],
    "structure from motion": ["colmap"],
}
OFF_NAMES = ("OFF", "COFF", "NOFF", "4OFF", "STOFF")


def available(fmt: str) -> bool:
    return fmt not in OPTIONAL or importlib.util.find_spec(OPTIONAL[fmt]) is not None


def supported_extensions() -> list[str]:
    return [e for fmt, exts in EXTENSIONS.items() if available(fmt) for e in exts]


def is_supported(path: str) -> bool:
    return files.extension(path) in supported_extensions()


def formats(spark):
    """The formats as a table: group, format, extension, available."""
    rows = [(group, fmt, e, available(fmt)) for group, fmts in GROUPS.items() for fmt in fmts for e in EXTENSIONS[fmt]]
    return spark.createDataFrame(rows, "label string, format string, ext string, available boolean")


#: First bytes that settle a format, fixed values.
MARKS = {b"ply": "ply", b"PLY": "ply", b"\x93NUMPY": "npy", b"\x89HDF\r\n\x1a\n": "hdf5", b"VOX ": "vox", b"glTF": "glb", b"LASF": "las", b"PK\x03\x04": "archive"}
#: What the members of an archive end in, by its format.
MEMBERS = {"npz": ".npy", "torch": "data.pkl"}
#: Bytes of a file that are looked at; the share of its lines that a grammar has to read.
HEAD, ENOUGH = 512, 0.9


class Grammar(NamedTuple):
    """Lines of a format of text: words that begin them, with the fewest values that follow; a word that has to be there; may lines be
    numbers only; the word after which the rest is not looked at."""

    lines: dict[str, int]
    needs: tuple[str, ...]
    numbers: bool = False
    last: str = ""

    def share(self, rows: list[list[str]]) -> float:
        """The share of lines that it reads; 0 if none has a word it needs."""
        if self.last:
            rows = rows[: next((k + 1 for k, r in enumerate(rows) if r[0] == self.last), len(rows))]
        read = [len(r) - 1 >= self.lines.get(r[0], len(r)) or self.numbers and all(map(_numeric, r)) for r in rows]
        return sum(read) / len(rows) if any(r[0] in self.needs for r in rows) else 0.0


GRAMMARS = {
    "obj": Grammar({"v": 3, "vn": 3, "vt": 2, "vp": 1, "f": 3, "l": 2, "p": 1, "g": 0, "o": 0, "s": 1, "usemtl": 0, "mtllib": 1}, ("v", "vn", "vt", "f")),
    "off": Grammar(dict.fromkeys(OFF_NAMES, 0), OFF_NAMES, numbers=True),
    "pcd": Grammar({"VERSION": 1, "FIELDS": 3, "SIZE": 3, "TYPE": 3, "COUNT": 3, "WIDTH": 1, "HEIGHT": 1, "VIEWPOINT": 7, "POINTS": 1, "DATA": 1}, ("FIELDS",), last="DATA"),
    "stl_ascii": Grammar({"solid": 0, "facet": 0, "outer": 0, "vertex": 3, "endloop": 0, "endfacet": 0, "endsolid": 0}, ("solid",)),
}


def _numeric(word: str) -> bool:
    try:
        float(word)
        return True
    except ValueError:
        return False


def _rows(head: bytes, size: int) -> list[list[str]]:
    """Words of the lines that are whole, not blank and no comments."""
    lines = head.decode("latin-1").splitlines()
    whole = lines[:-1] if len(lines) > 1 and size > len(head) else lines
    return [w for x in whole if (w := x.split()) and not w[0].startswith("#")]


def _archive(path: str, ext: str) -> str:
    """Which archive of arrays a file is, by its members; by its extension if those cannot be read or do not tell."""
    try:
        names = zipfile.ZipFile(io.BytesIO(files.read(path))).namelist()
    except zipfile.BadZipFile:
        names = []
    told = [fmt for fmt, end in MEMBERS.items() if any(n.endswith(end) for n in names)]
    return (told or [fmt for fmt in MEMBERS if ext in EXTENSIONS[fmt]] or ["npz"])[0]


def detect(path: str) -> str:
    """The format of a file: by the bytes it begins with, by the size that its own count asks for, by the grammar that reads its first
    lines, by its extension; else text."""
    head, size, ext = files.read(path, 0, HEAD), files.size(path), files.extension(path)
    begin = head.lstrip()
    mark = next((fmt for bytes_, fmt in MARKS.items() if begin.startswith(bytes_)), None)
    if mark == "archive":
        return _archive(path, ext)
    if mark == "las":
        # Compressed files set the top bit of the point format.
        return "laz" if ext == ".laz" or len(head) > 104 and head[104] >= 0x80 else "las"
    if mark:
        return mark
    if len(head) >= 84 and size == 84 + 50 * struct.unpack_from("<I", head, 80)[0] and size > 84:
        return "stl"
    if begin.startswith(b"{"):
        return "gltf"
    rows = _rows(head, size)
    shares = {fmt: g.share(rows) for fmt, g in GRAMMARS.items()} if rows else {}
    fmt = max(shares, key=shares.__getitem__, default="")
    if shares.get(fmt, 0) >= ENOUGH:
        return fmt
    return next((fmt for fmt, exts in EXTENSIONS.items() if ext in exts), "text")
