"""Triangle meshes: verts (vid, x, y, z, ...), faces (fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import cross, norm, sub, vec
from ..tables import staged
from .cloud import running_sum


def fan(polygons: DataFrame, col: str = "idx") -> DataFrame:
    """Polygons (fid, idx array) to triangles (fid, part, a, b, c): the first corner with each edge not at it."""
    k = F.explode(F.sequence(F.lit(1), F.size(col) - 2)).alias("k")
    return polygons.where(F.size(col) >= 3).select("*", k).select("fid", (F.col("k") - 1).alias("part"), F.get(col, F.lit(0)).alias("a"), F.get(col, F.col("k")).alias("b"), F.get(col, F.col("k") + 1).alias("c"))


def strip(strips: DataFrame, col: str = "idx") -> DataFrame:
    """Triangle strips (fid, idx array) to triangles: each corner with the next two."""
    k = F.explode(F.sequence(F.lit(0), F.size(col) - 3)).alias("k")
    return strips.where(F.size(col) >= 3).select("*", k).select("fid", F.col("k").alias("part"), *[F.get(col, F.col("k") + n).alias(c) for n, c in enumerate("abc")])


def face_corners(verts: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the places (and colours, if any) of their corners as xa, ya, za, xb, ..."""
    out = faces
    for c in "abc":
        corner = verts.select(F.col("vid").alias(c), *[F.col(n).alias(f"{n}{c}") for n in verts.columns if n != "vid"])
        out = out.join(corner, c)
    return out


def face_areas(verts: DataFrame, faces: DataFrame) -> DataFrame:
    a, b, c = (vec(f"x{k}", f"y{k}", f"z{k}") for k in "abc")
    return face_corners(verts, faces).withColumn("area", F.greatest(norm(cross(sub(b, a), sub(c, a))) / 2, F.lit(1e-12)))


#: Steps of the two coordinates of points within their faces, fixed values: the powers of the number whose cube is itself plus one, inverted.
SPREAD = (0.7548776662466927, 0.5698402909980532)


def sample_surface(verts: DataFrame, faces: DataFrame, n: int = 300_000) -> DataFrame:
    """(fid, k, x, y, z, ...): about n points spread over the surface by area; n is at most a million and 200 a face. Colours are interpolated.

    The surface is laid out by `fid` and cut into n equal parts; point k, from 0, is in the face that has the middle of
    part k, so every face has its share, and at a place within it that a sequence of even spread gives for k. A mesh
    without faces gives its vertices.
    """
    count = faces.count()
    if not count:
        return verts.drop("vid")
    n = min(n, 1_000_000, max(1, 200 * count))
    areas = staged(running_sum(face_areas(verts, faces), "fid", "area", "upto"), "areas")
    total = areas.agg(F.sum("area").alias("total"))
    parts = areas.crossJoin(F.broadcast(total))
    first, last = (F.ceil(v / F.col("total") * n - 0.5).cast("long") for v in (F.col("upto") - F.col("area"), F.col("upto")))
    draws = parts.withColumns({"first": F.greatest(first, F.lit(0)), "last": F.least(last, F.lit(n)) - 1}).where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    s0, t0 = (F.col("k") * step - F.floor(F.col("k") * step) for step in SPREAD)
    over = s0 + t0 > 1
    s, t = F.when(over, 1 - s0).otherwise(s0), F.when(over, 1 - t0).otherwise(t0)
    names = [c for c in verts.columns if c != "vid"]
    return draws.select("fid", "k", *[((1 - s - t) * F.col(f"{c}a") + s * F.col(f"{c}b") + t * F.col(f"{c}c")).alias(c) for c in names])
