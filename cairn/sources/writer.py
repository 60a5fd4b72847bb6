"""Writing clouds and scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.cloud import NORMAL, RGB, XYZ, row_numbers
from ..operators.scene import camera_markers, scene_summary
from ..tables import staged
from .files import FormatError, extension, locate

#: Points of one part; a part is bytes in a row of a staged table until it is copied into the file.
PART = 1 << 20


def header(n: int, normals: bool, colors: bool, binary: bool) -> bytes:
    lines = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {n}"]
    lines += [f"property float {c}" for c in (*XYZ, *(NORMAL if normals else ()))]
    lines += [f"property uchar {c}" for c in ("red", "green", "blue") if colors]
    return ("\n".join([*lines, "end_header"]) + "\n").encode()


def encode(columns: dict[str, np.ndarray], normals: bool, colors: bool, binary: bool) -> bytes:
    """The body of a PLY file; colours are clipped, numbers in text have six places."""
    floats = [*XYZ, *(NORMAL if normals else ())]
    shades = {c: np.clip(columns[c], 0, 255).astype(np.uint8) for c in RGB} if colors else {}
    if not binary:
        made = [[f"{v:.6f}" for v in columns[c].astype(np.float32)] for c in floats] + [[str(v) for v in shades[c]] for c in shades]
        return "".join(" ".join(row) + "\n" for row in zip(*made, strict=True)).encode()
    rows = np.empty(len(columns["x"]), [(c, "<f4") for c in floats] + [(c, "u1") for c in shades])
    for c in floats:
        rows[c] = columns[c]
    for c, v in shades.items():
        rows[c] = v
    return rows.tobytes()


def write_ply(df: DataFrame, path: str, order: list[str], binary: bool = True) -> int:
    """One PLY file with the points in `order` (unique); returns how many.

    Executors encode the parts into a table in the shared folder; the driver copies them into the file one
    at a time, as a single file has to be written by someone.
    """
    normals, colors = set(NORMAL) <= set(df.columns), set(RGB) <= set(df.columns)
    names = [*XYZ, *(NORMAL if normals else ()), *(RGB if colors else ())]
    rows = row_numbers(df, order, "__row").select("__row", *[F.col(c).cast("double" if c not in RGB else "int").alias(c) for c in names])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        body = encode({c: table.column(c).to_numpy() for c in names}, normals, colors, binary)
        return pa.table([pa.array([table.column("__row")[0].as_py() // PART], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([body], pa.binary())], ["part", "n", "body"])

    parts = staged(rows.groupBy(F.floor(F.col("__row") / PART)).applyInArrow(run, "part long, n long, body binary"), "ply")
    sizes = sorted((r["part"], r["n"]) for r in parts.select("part", "n").collect())
    total = sum(n for _, n in sizes)
    system, where = locate(path)
    with system.open_output_stream(where) as f:
        f.write(header(total, normals, colors, binary))
        for part, _ in sizes:
            f.write(parts.where(F.col("part") == part).select("body").first()["body"])
    return total


def write_ply_parts(df: DataFrame, folder: str, binary: bool = True) -> int:
    """A folder of PLY files of at most PART points, each written by the task that has them; returns how many points.

    Nothing passes through the driver, and a task holds one file. A task that runs again writes the same names.
    """
    normals, colors = set(NORMAL) <= set(df.columns), set(RGB) <= set(df.columns)
    names = [*XYZ, *(NORMAL if normals else ()), *(RGB if colors else ())]
    rows = df.select(*[F.col(c).cast("double" if c not in RGB else "int").alias(c) for c in names])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = locate(folder)
        system.create_dir(where, recursive=True)
        held, n, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            with system.open_output_stream(f"{where}/part-{TaskContext.get().partitionId():05d}-{number:05d}.ply") as f:
                f.write(header(n, normals, colors, binary))
                f.write(encode({c: table.column(c).to_numpy() for c in names}, normals, colors, binary))
            return pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                if held and n + part.num_rows > PART:
                    yield flush()
                    held, n, number = [], 0, number + 1
                held.append(part)
                n += part.num_rows
        if n:
            yield flush()

    total = rows.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
    if not total:  # a cloud without points is a file with a header
        system, where = locate(folder)
        system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{where}/part-00000-00000.ply") as f:
            f.write(header(0, normals, colors, binary))
    return total


def write_cloud(df: DataFrame, path: str, order: list[str], binary: bool = True) -> int:
    if extension(path) != ".ply":
        raise FormatError("clouds are written as .ply only")
    return write_ply(df, path, order, binary)


def convert(spark, source: str, target: str) -> int:
    """Any readable file to PLY."""
    from .reader import read_cloud

    return write_cloud(read_cloud(spark, source), target, ["point_id"])


def write_scene(cameras: DataFrame, points: DataFrame, folder: str, elapsed: float = 0.0, dense: DataFrame | None = None) -> dict:
    """sparse.ply, cameras.ply, dense.ply if there is a dense cloud, and scene.json; returns what scene.json says."""
    import json

    system, where = locate(folder)
    system.create_dir(where, recursive=True)
    write_ply(points, f"{folder}/sparse.ply", ["pid"])
    write_ply(camera_markers(cameras), f"{folder}/cameras.ply", ["point_id"])
    summary = scene_summary(cameras, points).first().asDict() | {"elapsed_s": round(elapsed, 1)}
    if dense is not None:
        summary["n_dense"] = write_ply(dense, f"{folder}/dense.ply", ["point_id"])
    with system.open_output_stream(f"{where}/scene.json") as f:
        f.write(json.dumps(summary, indent=2).encode())
    return summary

