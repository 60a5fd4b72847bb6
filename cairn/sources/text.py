"""Text tables of points, and the text records of structure-from-motion tools, by Spark's text reader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.cloud import NORMAL, RGB, SYNONYMS, XYZ, normalize_colors, with_stats
from .files import FormatError
from .lines import numbered_lines

#: Lines that the driver looks at to learn the columns.
HEAD = 64


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments: line_id (in file order), line."""
    lines = spark.read.text([p.strip() for p in path.split(",")]).select(F.monotonically_increasing_id().alias("line_id"), F.trim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _separator(line: str) -> str:
    """A pattern for the most frequent of comma, tab and semicolon, else white space."""
    best = max((",", "\t", ";"), key=line.count)
    return rf"\s*{best}\s*" if best in line else r"\s+"


def _number(word: str) -> bool:
    try:
        float(word)
        return True
    except ValueError:
        return False


def is_track_points(words: list[str]) -> bool:
    """Does a row look like id, x, y, z, r, g, b of a sparse reconstruction, not like x, y, z and more?"""
    if len(words) < 7 or not all(map(_number, words[:4])) or not all(re.fullmatch(r"[+-]?\d+", w) for w in words[4:7]):
        return False
    return float(words[0]).is_integer() and all(0 <= int(w) <= 255 for w in words[4:7]) and any(abs(float(w)) > 2 for w in words[1:4])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A cloud from a text table: an optional header with names, an optional first line with the count, then rows.

    Without names: three columns are places; a fourth alone is intensity; the fourth to sixth are colours if all
    are within 0..255; the seventh to ninth are then normals. Rows without three numbers are left out.
    """
    lines = data_lines(spark, path)
    head = [r["line"] for r in lines.orderBy("line_id").limit(HEAD).collect()]
    if not head:
        raise FormatError("no data")
    sep = _separator(head[0])
    rows = [re.split(sep, h) for h in head]
    if is_track_points(head[0].split()):
        parts = F.split("line", r"\s+")
        value = lambda k: F.try_element_at(parts, F.lit(k + 1)).try_cast("double")
        out = lines.select(F.col("line_id").alias("point_id"), *[value(k + 1).cast("float").alias(c) for k, c in enumerate(XYZ)], *[value(k + 4).cast("smallint").alias(c) for k, c in enumerate(RGB)])
        return out.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    names = None if _number(rows[0][0]) else [w.strip().lower() for w in rows[0]]
    body = rows[1:] if names else rows
    if body and len(body[0]) < 3 and len(body) > 1:
        body = body[1:]  # a count alone on its line; its row has no three numbers
        sep = _separator(" ".join(body[0])) if len(body[0]) < 3 else sep
    width = len(names or (body[0] if body else []))
    if width < 3:
        raise FormatError("a cloud needs three columns")
    cells = F.split("line", sep)
    table = lines.select(F.col("line_id").alias("point_id"), *[F.try_element_at(cells, F.lit(k + 1)).try_cast("double").alias(f"c{k}") for k in range(width)])
    at = lambda c: next((names.index(s) for s in SYNONYMS[c] if s in names), None) if names else None
    place = [at(c) if at(c) is not None else k for k, c in enumerate(XYZ)]
    table = table.where(" AND ".join(f"c{k} IS NOT NULL" for k in sorted({*place, 0, 1, 2})))
    color, normal = [at(c) for c in RGB], [at(c) for c in NORMAL]
    xyz = [F.col(f"c{k}").cast("float").alias(c) for k, c in zip(place, XYZ, strict=True)]
    guess = None
    if None in color:
        color = [3, 4, 5] if width >= 6 else [3, 3, 3] if width == 4 else None
        guess = width >= 6
    if None in normal:
        normal = [6, 7, 8] if width >= 9 and color else None
    out = table.select("point_id", *xyz, *[F.col(f"c{k}").alias(c) for k, c in zip(color or [], RGB, strict=bool(color))], *[F.col(f"c{k}").cast("float").alias(c) for k, c in zip(normal or [], NORMAL, strict=bool(normal))])
    if not color:
        return out
    if guess:
        ranged = with_stats(out, F.min(F.least(*RGB)).alias("__low"), F.max(F.greatest(*RGB)).alias("__high"))
        fits = (F.col("__low") >= -1e-3) & (F.col("__high") <= 255.001)
        out = ranged.withColumns({c: F.when(fits, F.col(c)) for c in RGB}).drop("__low", "__high")
    return normalize_colors(out)


def read_sfm_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params array<double>) from cameras.txt."""
    parts = F.split("line", r"\s+")
    rows = data_lines(spark, path).select(parts.alias("p"))
    number: Column = F.transform(F.slice("p", 5, F.size("p")), lambda v: v.cast("double"))
    return rows.select(F.col("p")[0].cast("int").alias("camera_id"), F.col("p")[1].alias("model"), F.col("p")[2].cast("int").alias("width"), F.col("p")[3].cast("int").alias("height"), number.alias("params"))


def read_sfm_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, q array(4), t array(3), camera_id, name, points array of (u, v, point_id)) from images.txt.

    Records are two lines: a pose, then observations, which may be empty, so blank lines count here.
    """
    numbered = numbered_lines(spark, path, ~F.trim("value").startswith("#")).withColumn("line", F.trim("line"))
    pair = numbered.groupBy(F.floor(F.col("n") / 2).alias("k")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("line"))).alias("pose"), F.max(F.when(F.col("n") % 2 == 1, F.col("line"))).alias("seen"))
    p, s = F.split("pose", r"\s+"), F.filter(F.split(F.coalesce("seen", F.lit("")), r"\s+"), lambda v: v != "")
    pair = pair.where(F.col("pose") != "").select(p.alias("p"), s.alias("s"))
    seen = F.transform(F.when(F.size("s") >= 3, F.sequence(F.lit(0), (F.size("s") / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.get("s", 3 * k).cast("double").alias("u"), F.get("s", 3 * k + 1).cast("double").alias("v"), F.get("s", 3 * k + 2).cast("bigint").alias("point_id")))
    return pair.select(
        F.col("p")[0].cast("int").alias("image_id"),
        F.transform(F.slice("p", 2, 4), lambda v: v.cast("double")).alias("q"),
        F.transform(F.slice("p", 6, 3), lambda v: v.cast("double")).alias("t"),
        F.col("p")[8].cast("int").alias("camera_id"),
        F.array_join(F.slice("p", 10, F.size("p")), " ").alias("name"),
        seen.alias("points"),
    )
