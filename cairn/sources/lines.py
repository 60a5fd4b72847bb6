"""PLY and PCD files of text, read by Spark in splits: one file is many tasks, and no task has all of it.

A first pass counts the lines of each split; with those sums a line knows its number in the file, and by that whether
it is a vertex and which. The parsers are those of the whole-file readers, on a batch of lines at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import FloatType, LongType, StructField, StructType

from . import files
from .files import FormatError
from .records import Columns, pcd_header, ply_header
from .whole import pcd_table, ply_table

#: monotonically_increasing_id() has the number of the partition above these bits.
SPLIT_BITS = 33
#: Rows that show which columns a file has.
HEAD = 8


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(n, line): the lines of a file, blank ones too, with their numbers from 0; a count of each split reaches the driver.

    With `keep`, a condition on `value`, lines that do not meet it are neither given nor counted.
    """
    text = spark.read.text(path)
    rows = (text if keep is None else text.where(keep)).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    split = F.shiftright("id", SPLIT_BITS)
    counts = dict(rows.groupBy(split.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([counts.get(s, 0) for s in range(max(counts, default=0) + 1)])]).tolist()
    first = F.element_at(F.array(*[F.lit(int(v)) for v in before]), (split + 1).cast("int"))
    return rows.select((first + F.col("id").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))).alias("n"), "line")


class _Body:
    """Where the points of a file are, by line, and how lines become columns."""

    def __init__(self, path: str, fmt: str):
        if fmt == "ply":
            header = ply_header(path)
            self.first = files.read(path, 0, header.size).count(b"\n")
            for name, count, props in header.elements:
                if name == "vertex" and props:
                    self.count, self.parse = count, lambda lines, props=props: ply_table(lines, props)
                    break
                self.first += count
            else:
                raise FormatError("no vertex element")
        else:
            found, at = pcd_header(path)
            self.first = files.read(path, 0, at).count(b"\n")
            self.count, self.parse = 1 << 62, lambda lines, names=[f.lower() for f in found["FIELDS"]]: pcd_table(lines, names)

    def head(self, path: str) -> Columns:
        """The columns of the first points."""
        size = 1 << 14
        while True:
            raw = files.read(path, 0, size)
            lines = raw.decode("latin-1").split("\n")
            whole = lines if len(raw) < size else lines[:-1]
            if len(whole) > self.first + HEAD or len(raw) < size:
                return self.parse([x for x in whole[self.first : self.first + min(HEAD, self.count)] if x.strip()])[1]
            size *= 4


def is_text(path: str, fmt: str) -> bool:
    return fmt == "ply" and ply_header(path).form == "ascii" or fmt == "pcd" and pcd_header(path)[0].get("DATA", [""])[0].lower() == "ascii"


def read_lines(spark: SparkSession, paths: list[str], fmt: str, columns: list[str] | None, order: tuple[str, ...], types: dict, file_rows: int) -> DataFrame:
    """point_id and the columns of `order` that the first file has. Ids count the lines of points from each file's first one, so they
    have gaps where a line has too few numbers; such lines are left out."""
    have = _Body(paths[0], fmt).head(paths[0])
    keep = [c for c in order if c in have and (not columns or c in columns)]
    schema = StructType([StructField("point_id", LongType(), False), *[StructField(c, types.get(c, FloatType())) for c in keep]])
    kinds = [pa.int16() if c in "rgb" else pa.int32() if c == "intensity" else pa.float32() for c in keep]
    out = None
    for number, path in enumerate(paths):
        body = _Body(path, fmt)

        def run(batches: Iterator[pa.RecordBatch], body: _Body = body, base: int = number * file_rows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                used, made = body.parse(batch.column(1).to_pylist())
                ids = batch.column(0).to_numpy()[used] - body.first + base
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(made[c]).cast(k) if c in made else pa.nulls(len(ids), k) for c, k in zip(keep, kinds, strict=True))], ["point_id", *keep])

        rows = numbered_lines(spark, path).where((F.col("n") >= body.first) & (F.col("n") < body.first + body.count) & (F.trim("line") != ""))
        part = rows.select("n", "line").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
