"""The `cloud` data source, and read_cloud(), which picks the reader of each format.

Formats of fixed-length records are split into ranges of rows, one partition each; others are one partition a
file. Only the columns asked for leave the Python worker. Text clouds, and PLY and PCD files of text, are read by Spark's
own text reader, in splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ByteType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from ..operators import cloud as ops
from . import files, lines, text
from .detect import detect
from .files import FormatError
from .records import read_rows, layout_of
from .whole import READERS

ORDER = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "opacity", "scale", "intensity")
SPARK_TYPES = {"r": ShortType(), "g": ShortType(), "b": ShortType(), "intensity": IntegerType()}
#: Records of a partition, unless the option rowsPerPartition says otherwise; rows of an Arrow batch.
ROWS, BATCH = 2_000_000, 1 << 16
#: point_id is the file's number times this plus the row in the file.
FILE_ROWS = 1 << 40


@dataclass
class Part(InputPartition):
    number: int
    path: str
    fmt: str
    first: int
    count: int


class CloudSource(DataSource):
    """spark.read.format("cloud").load(path); options format, columns, rowsPerPartition, splatOrder.

    All files of a load have the columns of the first; one that lacks a column gives NULL.
    """

    @classmethod
    def name(cls) -> str:
        return "cloud"

    def _files(self) -> list[str]:
        found = files.expand(self.options["path"])
        if not found:
            raise FormatError("no files")
        return found

    def schema(self) -> StructType:
        path = self._files()[0]
        fmt = self.options.get("format") or detect(path)
        layout = layout_of(path, fmt, self.options.get("splatorder", "color_first"))
        have = layout.columns() if layout else list(_whole(path, fmt))
        asked = self.options.get("columns")
        keep = [c for c in ORDER if c in have and (not asked or c in [a.strip() for a in asked.split(",")])]
        return StructType([StructField("point_id", LongType(), False)] + [StructField(c, SPARK_TYPES.get(c, FloatType())) for c in keep])

    def reader(self, schema: StructType) -> DataSourceReader:
        return CloudReader(schema, dict(self.options), self._files())


def _whole(path: str, fmt: str) -> dict[str, np.ndarray]:
    if fmt not in READERS:
        raise FormatError(f"{fmt} files are not read by this source")
    return READERS[fmt](path)


class CloudReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, paths: list[str]):
        self.schema, self.options, self.paths = schema, options, paths
        self.order = options.get("splatorder", "color_first")

    def partitions(self) -> list[Part]:
        step = int(self.options.get("rowsperpartition", ROWS))
        out = []
        for number, path in enumerate(self.paths):
            fmt = self.options.get("format") or detect(path)
            layout = layout_of(path, fmt, self.order)
            if layout:
                out += [Part(number, path, fmt, a, min(step, layout.count - a)) for a in range(0, layout.count, step)]
            else:
                out.append(Part(number, path, fmt, 0, -1))
        return out or [Part(0, "", "", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        if part.count < 0:
            made = _whole(part.path, part.fmt)
            n = len(made["x"])
            for at in range(0, n, BATCH):
                yield self._batch({k: v[at : at + BATCH] for k, v in made.items()}, part.number * FILE_ROWS + at)
            return
        layout = layout_of(part.path, part.fmt, self.order)
        for at in range(part.first, part.first + part.count, BATCH):
            made = read_rows(part.path, layout, at, min(BATCH, part.first + part.count - at))
            yield self._batch(made, part.number * FILE_ROWS + at)

    def _batch(self, made: dict[str, np.ndarray], first: int) -> pa.RecordBatch:
        n = len(made["x"])
        kinds = {LongType: pa.int64(), FloatType: pa.float32(), ShortType: pa.int16(), IntegerType: pa.int32(), ByteType: pa.int8()}
        arrays = [pa.array(np.arange(first, first + n))]
        for f in self.schema.fields[1:]:
            kind = kinds[type(f.dataType)]
            arrays.append(pa.array(made[f.name]).cast(kind) if f.name in made else pa.nulls(n, kind))
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema.fields])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CloudSource)


def read_cloud(spark: SparkSession, path: str, fmt: str | None = None, max_points: int | None = None, columns: list[str] | None = None, **options: object) -> DataFrame:
    """A cloud from files of one format: point_id, x, y, z and what colours, normals, opacity and scale they have.

    Scans without colours get grey from their intensity, by the largest of all. `max_points` keeps every
    k-th point, with the smallest whole k that is enough.
    """
    fmt = fmt or detect(files.expand(path)[0])
    if fmt == "text":
        out = text.read_text(spark, path)
    elif fmt in ("ply", "pcd") and all(lines.is_text(p, fmt) for p in files.expand(path)):
        out = lines.read_lines(spark, files.expand(path), fmt, columns, ORDER, SPARK_TYPES, FILE_ROWS)
    else:
        register(spark)
        reader = spark.read.format("cloud").option("format", fmt)
        if columns:
            reader = reader.option("columns", ",".join(columns))
        for k, v in options.items():
            reader = reader.option(k, str(v))
        out = reader.load(path)
    if "intensity" in out.columns:
        grey = F.when(F.col("__top") > 0, (F.col("intensity") / F.col("__top") * 255).cast("int").cast("smallint"))
        out = ops.with_stats(out, F.max("intensity").alias("__top")).withColumns(dict.fromkeys("rgb", grey)).drop("__top", "intensity")
    if max_points:
        n = out.count()
        if n > max_points:
            out = ops.stride_sample(out, math.ceil(n / max_points), ["point_id"])
    return out


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, r, g, b alone; grey 180 where a file has no colours."""
    out = read_cloud(spark, path)
    colors = [F.coalesce(F.col(c), F.lit(180).cast("smallint")).alias(c) if c in out.columns else F.lit(180).cast("smallint").alias(c) for c in "rgb"]
    return out.select("x", "y", "z", *colors)
