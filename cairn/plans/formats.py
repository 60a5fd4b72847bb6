"""Queries that write a table in a format and read it back: one file from each task, so nothing passes through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import SH_C0
from ..sources import files, read_cloud, records
from ..tables import shared_dir
from . import encoders as E, views as V
from .queries import query, r6

Encoder = Callable[[E.Cloud], bytes]
KEY = "c_custkey"
PLACE = ("x", "y", "z")


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """customer as a cloud whose places are exact as 32-bit floats, or round alike."""
    rows = V.table(spark, sf, "customer")
    xyz = [F.col(c).cast("float").alias(n) for n, c in zip("xyz", (KEY, "c_acctbal", "c_nationkey"), strict=True)]
    return rows.select(*xyz, *[(F.col(c) * k % m).cast("int").alias(n) for n, c, k, m in (("r", KEY, 1, 200), ("g", "c_nationkey", 10, 250), ("b", KEY, 3, 7))])


SOURCE = """cloud AS (SELECT CAST(CAST(c_custkey AS REAL) AS DOUBLE) AS x, CAST(CAST(c_acctbal AS REAL) AS DOUBLE) AS y, CAST(CAST(c_nationkey AS REAL) AS DOUBLE) AS z,
    c_custkey % 200 AS r, c_nationkey * 10 % 250 AS g, c_custkey * 3 % 7 AS b FROM customer)"""
PLACES_SQL = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in PLACE)
COLORS_SQL = ", ".join(f"CAST({c} AS SMALLINT) AS {c}" for c in "rgb")


def written(df: DataFrame, ext: str, encode: Encoder) -> str:
    """The folder to which each task wrote its rows as one file; a task that runs again writes the same file."""
    folder = f"{shared_dir(df.sparkSession)}/format-{uuid.uuid4().hex}"
    names = df.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [b for b in batches if b.num_rows]
        if made:
            table = pa.Table.from_batches(made)
            system, where = files.locate(folder)
            system.create_dir(where, recursive=True)
            with system.open_output_stream(f"{where}/part-{TaskContext.get().partitionId():05d}{ext}") as f:
                f.write(encode({c: table.column(c).to_numpy() for c in names}))
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows])], ["n"])

    df.mapInArrow(put, "n long").agg(F.sum("n")).first()
    return folder


def places(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[r6(F.col(c).cast("double"), c) for c in PLACE], *more)


#: Query, extension, format (None: told from the bytes), encoder; with places and colours, each as it was.
COLORED: list[tuple[str, str, str | None, Encoder]] = [
    ("read_ply_ascii", ".ply", None, E.ply_ascii),
    ("read_ply_big_endian", ".ply", None, E.ply_big_endian),
    ("read_pcd_binary", ".pcd", None, E.pcd_binary),
    ("read_pcd_ascii", ".pcd", None, E.pcd_ascii),
    ("read_obj", ".obj", None, E.obj),
    ("read_text", ".csv", None, E.delimited),
    ("read_track_text", ".txt", None, E.track_text),
    ("read_track_binary", ".bin", None, E.track_binary),
    ("read_las", ".las", None, E.las),
    ("read_npy", ".npy", None, E.npy),
    ("read_npz", ".npz", None, E.npz),
    ("read_glb", ".glb", None, E.glb),
    ("read_gltf", ".gltf", None, E.gltf),
]


def _colored(ext: str, fmt: str | None, encode: Encoder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        back = read_cloud(spark, written(cloud(spark, sf), ext, encode), fmt)
        return places(back, *[F.col(c).cast("smallint").alias(c) for c in "rgb"])

    return run


for _name, _ext, _fmt, _encode in COLORED:
    query(_name, f"WITH {SOURCE} SELECT {PLACES_SQL}, {COLORS_SQL} FROM cloud")(_colored(_ext, _fmt, _encode))


@query("read_off", f"WITH {SOURCE} SELECT {PLACES_SQL} FROM cloud")
def read_off(spark: SparkSession, sf: str) -> DataFrame:
    return places(read_cloud(spark, written(cloud(spark, sf), ".off", E.off)))


@query("read_splat", f"WITH {SOURCE} SELECT {PLACES_SQL}, {COLORS_SQL}, round(CAST(CAST(b / 255.0::DOUBLE AS REAL) AS DOUBLE), 6) AS opacity, greatest(1e-6::DOUBLE, g + 1.0::DOUBLE) AS scale FROM cloud")
def read_splat(spark: SparkSession, sf: str) -> DataFrame:
    back = read_cloud(spark, written(cloud(spark, sf), ".splat", E.splat))
    return places(back, *"rgb", r6(F.col("opacity").cast("double"), "opacity"), F.col("scale").cast("double").alias("scale"))


def _shade(c: str) -> str:
    coefficient = f"CAST(CAST({c} / 100.0::DOUBLE - 1 AS REAL) AS DOUBLE)"
    return f"CAST(trunc(greatest(0, least(255, ({SH_C0!r}::DOUBLE * {coefficient} + 0.5::DOUBLE) * 255.0::DOUBLE))) AS SMALLINT) AS {c}"


@query(
    "read_ply_gaussians",
    f"""WITH {SOURCE} SELECT {PLACES_SQL}, {", ".join(map(_shade, "rgb"))}, round(1 / (1 + exp(-(b / 10.0::DOUBLE - 1))), 4) AS opacity,
    round((exp(g / 100.0::DOUBLE) + exp(g / 100.0::DOUBLE - 1) + exp(g / 100.0::DOUBLE - 2)) / 3, 4) AS scale FROM cloud""",
)
def read_ply_gaussians(spark: SparkSession, sf: str) -> DataFrame:
    back = read_cloud(spark, written(cloud(spark, sf), ".ply", E.ply_gaussians))
    return places(back, *"rgb", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("opacity", "scale")])


@query("read_vox", f"WITH {SOURCE} SELECT r + 0.5::DOUBLE AS x, g + 0.5::DOUBLE AS y, b + 0.5::DOUBLE AS z, CAST(g AS SMALLINT) AS r, CAST(255 - g AS SMALLINT) AS g, 3::SMALLINT AS b FROM cloud")
def read_vox(spark: SparkSession, sf: str) -> DataFrame:
    return places(read_cloud(spark, written(cloud(spark, sf), ".vox", E.vox)), *"rgb")


@query("ply_header_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer")
def ply_header_count(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices that the headers of all files promise; no body is read."""
    folder = written(cloud(spark, sf), ".ply", E.ply_big_endian)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([records.ply_count(p) for p in b.column(0).to_pylist()], pa.int64())], ["n"])

    paths = spark.createDataFrame([(p,) for p in files.expand(folder)], "path string")
    return paths.mapInArrow(count, "n long").agg(F.sum("n").alias("n"))


#: Meshes of equal triangles, one for each nation; the first corner of each is at the nation's key.
MESHES: list[tuple[str, str, Encoder]] = [("obj", ".obj", E.obj_faces), ("off", ".off", E.off_faces), ("stl", ".stl", E.stl), ("stl_ascii", ".stl", E.stl_ascii), ("gltf", ".gltf", E.gltf_faces)]


@query(
    "read_meshes",
    "SELECT f.format, CAST(n_nationkey AS INT) AS face, 200::BIGINT AS n, TRUE AS inside FROM nation, (VALUES " + ", ".join(f"('{n}')" for n, _, _ in MESHES) + ") AS f(format)",
)
def read_meshes(spark: SparkSession, sf: str) -> DataFrame:
    """Points drawn on each triangle (x - k, y >= 0 and their sum <= 1), and whether all are on it: k is even spaced by 2, so triangles do not touch."""
    nation = V.table(spark, sf, "nation").select((F.col("n_nationkey") * 2).cast("float").alias("x")).coalesce(1)
    out = []
    for name, ext, encode in MESHES:
        back = places(read_cloud(spark, written(nation, ext, encode)))
        face = F.floor(F.col("x") / 2)
        u = F.col("x") - 2 * face
        on = (u >= 0) & (F.col("y") >= 0) & (u + F.col("y") <= 1 + 1e-4) & (F.col("z") == 0)
        out.append(back.groupBy(face.cast("int").alias("face")).agg(F.count(F.lit(1)).alias("n"), F.every(on).alias("inside")).select(F.lit(name).alias("format"), "face", "n", "inside"))
    made = out[0]
    for one in out[1:]:
        made = made.unionByName(one)
    return made
