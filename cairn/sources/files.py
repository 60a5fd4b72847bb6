"""Files by path or URI, through Arrow's filesystems: local, and remote ones that Arrow was built with."""

from __future__ import annotations

import posixpath

from pyarrow import fs


class FormatError(ValueError):
    """A file that is not what it seems, or that this package cannot read."""


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def expand(path: str) -> list[str]:
    """The files that a path, a folder or several comma-separated ones stand for, sorted."""
    out = []
    for one in path.split(","):
        system, where = locate(one)
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(where, recursive=True))
            prefix = one.rstrip("/")
            out += [prefix + f.path[len(where.rstrip("/")) :] for f in inside if f.is_file and not f.base_name.startswith(("_", "."))]
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        else:
            out.append(one)
    return sorted(set(out))


def size(path: str) -> int:
    system, where = locate(path)
    return system.get_file_info(where).size


def read(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, where = locate(path)
    with system.open_input_file(where) as f:
        return f.read_at(f.size() - start if length is None else max(0, min(length, f.size() - start)), start)


def sibling(path: str, name: str) -> str:
    """A file beside another; names that lead out of its folder are refused."""
    clean = posixpath.normpath(name)
    if clean.startswith(("/", "..")) or "://" in name:
        raise FormatError(f"{name} is outside the file's folder")
    return posixpath.join(posixpath.dirname(path), clean)


def extension(path: str) -> str:
    return posixpath.splitext(path.rsplit("/", 1)[-1])[1].lower()
