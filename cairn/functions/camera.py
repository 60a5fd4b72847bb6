"""Pinhole cameras: rows have r array<double>(9), t array<double>(3), fx, fy, cx, cy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .vectors import Vec


def _r(r: Column, i: int, j: int) -> Column:
    return r[3 * i + j]


def to_camera(r: Column, t: Column, p: Vec) -> Vec:
    """R p + t."""
    return tuple(_r(r, i, 0) * p[0] + _r(r, i, 1) * p[1] + _r(r, i, 2) * p[2] + t[i] for i in range(3))


def center(r: Column, t: Column) -> Vec:
    """The camera's place in the world, -R't."""
    return tuple(-(_r(r, 0, j) * t[0] + _r(r, 1, j) * t[1] + _r(r, 2, j) * t[2]) for j in range(3))


def direction(r: Column) -> Vec:
    return _r(r, 2, 0), _r(r, 2, 1), _r(r, 2, 2)


def projection_matrix(r: Column, t: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """K [R | t] as 12 numbers in row order."""
    rows = []
    for f, c, i in ((fx, cx, 0), (fy, cy, 1)):
        rows += [f * _r(r, i, j) + c * _r(r, 2, j) for j in range(3)] + [f * t[i] + c * t[2]]
    return F.array(*rows, *[_r(r, 2, j) for j in range(3)], t[2])


def reprojection_error(r: Column, t: Column, fx: Column, fy: Column, cx: Column, cy: Column, p: Vec, u: Column, v: Column) -> Column:
    """Pixels between (u, v) and the image of p; infinite for a point at or behind the camera."""
    x, y, z = to_camera(r, t, p)
    du, dv = fx * x / z + cx - u, fy * y / z + cy - v
    return F.when(z > 1e-8, F.sqrt(du * du + dv * dv)).otherwise(F.lit(float("inf")))


def guess_intrinsics(width: Column, height: Column, exif_focal: Column, factor: float = 1.2) -> tuple[Column, Column, Column]:
    """Focal length and centre in pixels: that of EXIF if positive, else `factor` times the longer side."""
    f = F.when(exif_focal > 0, exif_focal.cast("double")).otherwise(F.lit(factor) * F.greatest(width, height))
    return f, width / 2.0, height / 2.0


def exif_focal_px(longer: Column, original_longer: Column, focal_mm: Column, plane_resolution: Column, plane_unit: Column, focal_35mm: Column) -> Column:
    """Focal length in pixels of the working image, whose longer side is `longer`; NULL if EXIF does not tell.

    From the focal-plane resolution if it is given (EXIF unit 3 is centimetres, others inches), else from
    the 35 mm equivalent.
    """
    per_mm = plane_resolution / F.when(plane_unit == 3, 10.0).otherwise(25.4)
    by_plane = F.when((plane_resolution > 0) & (focal_mm > 0), focal_mm * per_mm * longer / original_longer)
    return F.coalesce(by_plane, F.when(focal_35mm > 0, focal_35mm / 36.0 * longer))


def scale_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> tuple[Column, ...]:
    return fx * sx, fy * sy, cx * sx, cy * sy


def disparity(focal: Column, baseline: Column, depth: Column) -> Column:
    return focal * baseline / depth


def back_project(u: Column, v: Column, d: Column, focal: Column, baseline: Column, cx: Column, cy: Column) -> Vec:
    """A rectified pixel with disparity d in the camera's frame; NULL where d is not positive."""
    z = F.when(d > 0, focal * baseline / d)
    return (u - cx) * z / focal, (v - cy) * z / focal, z
