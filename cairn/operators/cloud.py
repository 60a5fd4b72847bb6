"""Point clouds: point_id bigint, x, y, z, and optionally r, g, b, nx, ny, nz, opacity, scale.

Cloud-wide figures (bounds, ranges, counts) are one-row tables that are cross-joined, so a plan is built
without running anything, and Spark broadcasts the single row. Percentiles are worked out when they are asked
for, see percentiles().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import sh_to_unit, sigmoid, to_byte, viridis
from ..functions.vectors import clip, is_finite, norm, sub, vec
from ..tables import staged

XYZ = ("x", "y", "z")
RGB = ("r", "g", "b")
NORMAL = ("nx", "ny", "nz")
#: Other names of columns in files, fixed values.
SYNONYMS = {
    "x": ("x", "px", "pos_x", "position_x"),
    "y": ("y", "py", "pos_y", "position_y"),
    "z": ("z", "pz", "pos_z", "position_z"),
    "r": ("r", "red", "diffuse_red"),
    "g": ("g", "green", "diffuse_green"),
    "b": ("b", "blue", "diffuse_blue"),
    "nx": ("nx", "normal_x", "normalx"),
    "ny": ("ny", "normal_y", "normaly"),
    "nz": ("nz", "normal_z", "normalz"),
    "opacity": ("opacity", "alpha"),
    "scale": ("scale",),
}


#: Accuracy of the sketches that bracket a percentile; rows up to which the bracket is all of them.
SKETCH, FEW = 10_000, 100_000
#: Cuts of ranges that are skipped at once.
WIDE = 16


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename columns to this module's names by their synonyms, case ignored; a colour or normal is all three or none."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    found = {name: next((lower[s] for s in others if s in lower), None) for name, others in SYNONYMS.items()}
    for group in (RGB, NORMAL):
        if not all(found[c] for c in group):
            found |= dict.fromkeys(group)
    keep = [F.col(f"`{c}`") for c in df.columns if c == "point_id"]
    return df.select(*keep, *[F.col(f"`{c}`").alias(name) for name, c in found.items() if c])


def finalize(df: DataFrame) -> DataFrame:
    """The stored types: float coordinates, normals, opacity and scale, smallint colours clipped and truncated."""
    out = [F.col("point_id").cast("bigint")] if "point_id" in df.columns else []
    for c in df.columns:
        if c in RGB:
            out.append(to_byte(F.col(c)).alias(c))
        elif c in (*XYZ, *NORMAL, "opacity", "scale"):
            out.append(F.col(c).cast("float").alias(c))
    return df.select(*out)


def with_stats(df: DataFrame, *stats: Column) -> DataFrame:
    """`df` with aggregates over all its rows as further columns."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def normalize_colors(df: DataFrame) -> DataFrame:
    """Colours as 0..255: floating-point ones that are all at most 1 are scaled; clipped and truncated."""
    floating = any(df.schema[c].dataType.typeName() in ("float", "double") for c in RGB)
    if not floating:
        return df.withColumns({c: to_byte(F.col(c)) for c in RGB})
    top = F.greatest(*[F.max(F.col(c).cast("double")) for c in RGB]).alias("__top")
    factor = F.when(F.col("__top") <= 1.0 + 1e-6, 255.0).otherwise(1.0)
    return with_stats(df, top).withColumns({c: to_byte(F.col(c).cast("double") * factor) for c in RGB}).drop("__top")


def normalize_opacity(df: DataFrame, col: str = "opacity") -> DataFrame:
    """Opacity in 0..1: integers of 0..255 are divided, values outside 0..1 are logits."""
    whole = df.schema[col].dataType.typeName() not in ("float", "double", "decimal")
    x, low, high = F.col(col).cast("double"), F.col("__low"), F.col("__high")
    bytes_ = F.lit(whole) & (low >= 0) & (high <= 255)
    value = F.when(bytes_, x / 255.0).when((low < -0.001) | (high > 1.001), sigmoid(x)).otherwise(x)
    ranged = with_stats(df, F.min(F.col(col).cast("double")).alias("__low"), F.max(F.col(col).cast("double")).alias("__high"))
    return ranged.withColumn(col, clip(value, 0.0, 1.0).cast("float")).drop("__low", "__high")


def normalize_scale(df: DataFrame, cols: list[str], is_log: bool = False, out: str = "scale") -> DataFrame:
    """The mean of the axes, at least 1e-6; of log scales the exponential, unless that is absurd for some row."""
    mean = sum((F.col(c).cast("double") for c in cols[1:]), F.col(cols[0]).cast("double")) / len(cols)
    if not is_log:
        return df.withColumn(out, F.greatest(mean, F.lit(1e-6)).cast("float"))
    wide = with_stats(df.withColumn("__mean", mean), F.max(F.exp("__mean")).alias("__top"), F.bool_and(is_finite(F.exp("__mean"))).alias("__sane"))
    sane = F.col("__sane") & (F.col("__top") < 1e6) & (F.col("__top") > 1e-12)
    value = F.when(sane, F.exp("__mean")).otherwise(F.col("__mean"))
    return wide.withColumn(out, F.greatest(value, F.lit(1e-6)).cast("float")).drop("__mean", "__top", "__sane")


def gaussian_splats(df: DataFrame) -> DataFrame:
    """A splat file's raw columns to a cloud: f_dc_0..2 to colours, logit opacity, log scale_0..2 (the mean of exponentials)."""
    scale = (F.exp(F.col("scale_0")) + F.exp(F.col("scale_1")) + F.exp(F.col("scale_2"))) / 3.0
    colors = {c: to_byte(sh_to_unit(F.col(f"f_dc_{k}").cast("double")) * 255.0) for k, c in enumerate(RGB)}
    return df.withColumns(colors | {"opacity": sigmoid(F.col("opacity").cast("double")).cast("float"), "scale": scale.cast("float")}).drop("f_dc_0", "f_dc_1", "f_dc_2", "scale_0", "scale_1", "scale_2")


# Voxels


def voxel_keys(size: float) -> list[Column]:
    return [F.floor(F.col(c).cast("double") / F.lit(float(size))).alias(f"v{c}") for c in XYZ]


def voxel_downsample(df: DataFrame, size: float | Column) -> DataFrame:
    """One point per cell of a grid: mean place, mean colour (truncated), mean normal of length one.

    point_id is the least one of the cell. A size of zero or less returns the cloud. Partial sums are made before
    the shuffle, so a crowded cell is no hot spot.
    """
    if not isinstance(size, Column) and size <= 0:
        return df
    width = size if isinstance(size, Column) else F.lit(float(size))
    keys = [F.floor(F.col(c).cast("double") / width).alias(f"v{c}") for c in XYZ]
    aggs = [F.avg(F.col(c).cast("double")).alias(c) for c in (*XYZ, *RGB, *NORMAL) if c in df.columns]
    ids = [F.min("point_id").alias("point_id")] if "point_id" in df.columns else []
    out = df.groupBy(*keys).agg(*ids, *aggs).drop("vx", "vy", "vz")
    if "r" in df.columns:
        out = out.withColumns({c: to_byte(F.col(c)) for c in RGB})
    if "nx" in df.columns:
        length = F.greatest(norm(vec(*NORMAL)), F.lit(1e-12))
        out = out.withColumns({c: F.col(c) / length for c in NORMAL})
    return out


def voxel_group_ids(df: DataFrame, size: float) -> DataFrame:
    """Consecutive numbers of the occupied cells in (x, y, z) order, from 0, for each point.

    The numbers come from the distinct cells, in ranges, not from a sort of all points.
    """
    keyed = df.select("*", *voxel_keys(size))
    cells = keyed.select("vx", "vy", "vz").distinct()
    numbered = row_numbers(cells, ["vx", "vy", "vz"], "group_id")
    return keyed.join(numbered, ["vx", "vy", "vz"])


# Bounds and statistics


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Exact percentiles (interpolated) of doubles: name -> (column, fraction of 0..1). Nulls do not count; None if there is no value.

    Runs three aggregates: sketches that merge bracket each percentile, rows below the bracket are counted, and only
    values inside it, 4 / SKETCH of the rows, are held exactly. Of a table of FEW rows or less the bracket is everything.
    """
    near = lambda q: F.array(F.lit(max(0.0, q - 2 / SKETCH)), F.lit(min(1.0, q + 2 / SKETCH)))
    cols = {name: c.cast("double") for name, (c, _) in wanted.items()}
    first = df.agg(*[f.alias(f"{k}{i}") for i, (name, (_, q)) in enumerate(wanted.items()) for k, f in (("n", F.count(cols[name])), ("cut", F.percentile_approx(cols[name], near(q), SKETCH)))]).first()
    inside = {name: cols[name].isNotNull() if first[f"n{i}"] <= FEW else cols[name].between(*first[f"cut{i}"]) for i, name in enumerate(wanted)}
    below = {name: F.lit(False) if first[f"n{i}"] <= FEW else cols[name] < first[f"cut{i}"][0] for i, name in enumerate(wanted)}
    counts = df.agg(*[F.count_if(c).alias(f"{k}{i}") for k, side in (("below", below), ("in", inside)) for i, c in enumerate(side.values())]).first()
    # Where the percentile stands among the values inside.
    at = {}
    for i, (name, (_, q)) in enumerate(wanted.items()):
        place, held = q * (first[f"n{i}"] - 1) - counts[f"below{i}"], counts[f"in{i}"]
        if held and not 0 <= place <= held - 1:
            raise ArithmeticError(f"the sketch of {name} does not hold its percentile")
        at[name] = place / (held - 1) if held > 1 else 0.0
    made = df.agg(*[F.percentile(F.when(inside[name], cols[name]), at[name]).alias(f"p{i}") for i, name in enumerate(wanted)]).first()
    return {name: made[f"p{i}"] for i, name in enumerate(wanted)}


def bounds(df: DataFrame) -> DataFrame:
    """One row: min, max of each axis, the number of points, centre, radius (half the diagonal)."""
    out = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max)])
    diag = norm(tuple(F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ))
    return out.select("*", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"center_{c}") for c in XYZ], (diag / 2).alias("radius"))


def robust_bounds(df: DataFrame, low: float = 0.005, high: float = 0.995, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """One row: the `low` and `high` percentiles of each axis. Not `exact`: by mergeable sketches alone, in one pass and lazily."""
    wanted = {f"{name}_{c}": (F.col(c), q) for c in XYZ for name, q in (("lo", low), ("hi", high))}
    if not exact:
        return df.agg(*[F.percentile_approx(c.cast("double"), q, accuracy).alias(name) for name, (c, q) in wanted.items()])
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(name) for name, v in percentiles(df, wanted).items()])


def sparse_bound(points: DataFrame, percentile: float = 0.99, factor: float = 4.0, least: int = 8) -> DataFrame:
    """One row: the median centre and `factor` times a high percentile of the distance from it; NULL if too few points."""
    center = percentiles(points, {f"c{c}": (F.col(c), 0.5) for c in XYZ})
    lits = {name: F.lit(v).cast("double") for name, v in center.items()}
    far = points.withColumns({f"__{name}": v for name, v in lits.items()})
    reach = percentiles(far, {"p": (norm(sub(vec(*XYZ), vec("__cx", "__cy", "__cz"))), percentile)})["p"]
    known = points.count() >= least and reach is not None and reach > 0
    return points.sparkSession.range(1).select(*[v.alias(name) for name, v in lits.items()], F.lit(reach * factor if known else None).cast("double").alias("radius"))


def radius_clip(df: DataFrame, bound: DataFrame) -> DataFrame:
    """Points within the radius of sparse_bound(); all if the radius is NULL."""
    far = df.crossJoin(F.broadcast(bound)).withColumn("__d", norm(sub(vec(*XYZ), vec("cx", "cy", "cz"))))
    return far.where(F.col("radius").isNull() | (F.col("__d") <= F.col("radius"))).select(df.columns)


def opacity_filter(df: DataFrame, least: float = 0.05) -> DataFrame:
    """Points above an opacity; compared as floats, as stored, and NaN dropped."""
    return df.where((F.col("opacity") > F.lit(least).cast("float")) & ~F.isnan("opacity"))


# Samples


def stride_sample(df: DataFrame, step: int | Column, order: list[str]) -> DataFrame:
    """Every `step`-th row in `order`, the first included.

    Row numbers are made from counts of range partitions, not by one task that sees all rows.
    """
    numbered = row_numbers(df, order)
    return numbered.where(F.col("__row") % (F.lit(step) if isinstance(step, int) else step) == 0).drop("__row")


def _cuts(df: DataFrame, value: Column, parts: int) -> DataFrame:
    """One row: about the `parts` - 1 percentiles of `value` that cut it into even ranges, and every WIDE-th of them."""
    cuts = df.agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000).alias("__cuts"))
    return cuts.withColumn("__wide", F.filter("__cuts", lambda c, i: i % WIDE == WIDE - 1))


def _ranged(df: DataFrame, value: Column, parts: int) -> DataFrame:
    """`df` with __range, the number of cuts below `value`: every WIDE-th is compared, then those between two of them."""
    start = F.size(F.filter("__wide", lambda c: c < value)) * WIDE
    number = start + F.size(F.filter(F.slice("__cuts", start + 1, WIDE), lambda c: c < value))
    return df.crossJoin(F.broadcast(_cuts(df, value, parts))).withColumn("__range", number).drop("__cuts", "__wide")


def row_numbers(df: DataFrame, order: list[str], name: str = "__row") -> DataFrame:
    """Numbers from 0 in `order`, which must be unique: ranks within hashed ranges plus the counts of the ranges before.

    Ranges are cut at percentiles of the first column of `order`; equal values of it stay together.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = _ranged(df, F.col(order[0]).cast("double"), parts)
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = ranged.withColumn("__rank", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__range", "__rank", "__before")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over all rows up to each in `order`, a unique column of numbers: sums within ranges of it, and those of
    the ranges before; no task has all rows."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = _ranged(df, F.col(order).cast("double"), parts)
    total = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = total.select("__range", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))  # a row for each range
    own = F.sum(value).over(W.partitionBy("__range").orderBy(order))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + own).drop("__range", "__before")


def shuffle_prefix(df: DataFrame, n: int, seed: int = 12345, id_col: str = "point_id") -> DataFrame:
    """A uniform sample of n points: the first in the order of a hash of seed and id, a top-n that needs no full sort."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def decimate(df: DataFrame, most: int, order: list[str]) -> DataFrame:
    """At most about `most` points: a stride to twice that, voxels of the extent / sqrt(most), one finer try, a stride.

    Runs a count after each step, as the next depends on it.
    """
    n = df.count()
    if n <= most:
        return df
    base = staged(stride_sample(df, math.ceil(n / (2 * most)), order), "base") if n > 2 * most else df
    inner = list(percentiles(base, {f"{c}{q}": (F.col(c), q) for c in XYZ for q in (0.01, 0.99)}).values())
    span = max(b - a for a, b in zip(inner[::2], inner[1::2], strict=True))
    if span <= 0:
        span = base.agg(F.greatest(*[F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")) for c in XYZ])).first()[0]
    extent = span or 1.0
    size = extent / math.sqrt(most)
    out = staged(voxel_downsample(base, size), "voxels")
    m = out.count()
    if 0 < m < 0.75 * most:
        out = staged(voxel_downsample(base, size * math.sqrt(m / most)), "voxels")
        m = out.count()
    return stride_sample(out, math.ceil(m / most), ["x", "y", "z"]) if m > most else out


# Views


def height_colors(df: DataFrame, axis: str = "z") -> DataFrame:
    """Colours 0..1 (cr, cg, cb) by height between the least and the greatest."""
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9))
    ranged = with_stats(df, F.min(F.col(axis).cast("double")).alias("__lo"), F.max(F.col(axis).cast("double")).alias("__hi"))
    r, g, b = viridis((F.col(axis).cast("double") - F.col("__lo")) / span)
    return ranged.withColumns({"cr": r, "cg": g, "cb": b}).drop("__lo", "__hi")


def relative_scale(df: DataFrame, col: str = "scale", low: float = 0.1, high: float = 5.0) -> DataFrame:
    """rel_scale: the scale over its median, clipped."""
    median = percentiles(df, {"median": (F.col(col), 0.5)})["median"]
    return df.withColumn("rel_scale", clip(F.col(col) / F.lit(max(median or 0.0, 1e-12)), low, high))


def viewer_projection(df: DataFrame) -> DataFrame:
    """x, y, z, cr, cg, cb (0..1; by height if there are no colours), alpha, rel_scale: what a viewer draws."""
    out = df.withColumns({f"c{c}": F.col(c) / 255.0 for c in RGB}) if "r" in df.columns else height_colors(df)
    out = out.withColumn("alpha", F.col("opacity").cast("double") if "opacity" in df.columns else F.lit(1.0))
    out = relative_scale(out) if "scale" in df.columns else out.withColumn("rel_scale", F.lit(1.0))
    keep = ["point_id"] if "point_id" in df.columns else []
    return out.select(*keep, *XYZ, "cr", "cg", "cb", "alpha", "rel_scale")


def voxel_grid_points(grid: DataFrame) -> DataFrame:
    """Cells (z, y, x, value) above max(median + std/2, 1e-9) as points."""
    median = percentiles(grid, {"median": (F.col("value"), 0.5)})["median"]
    ranged = with_stats(grid, F.stddev_pop("value").alias("__s"))
    return ranged.where(F.col("value") > F.greatest(F.lit(median or 0.0) + 0.5 * F.col("__s"), F.lit(1e-9))).select(*[F.col(c).cast("float").alias(c) for c in XYZ])


def union_clouds(*clouds: DataFrame) -> DataFrame:
    """All points of several clouds; a column that one lacks is NULL there."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def palette_colors(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """voxels (x, y, z, index) with the colour of palette row index - 1, clipped to 0..255; palette: (slot, r, g, b), 256 rows at most."""
    slot = F.greatest(F.lit(0), F.least(F.lit(255), F.col("index") - 1))
    return voxels.withColumn("slot", slot).join(F.broadcast(palette), "slot", "left").drop("slot")


