"""Numeric and string expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .vectors import clip

#: Zeroth spherical-harmonic basis value, fixed value.
SH_C0 = 0.28209479177387814
#: A polynomial approximation of the viridis colour map, per channel from the constant term up, fixed values.
VIRIDIS = (
    (0.2777, 0.1050, -0.3308, -4.6342, 6.2282, 4.7763, -5.4354),
    (0.0054, 1.4046, 0.2148, -5.7991, 14.1799, -13.7451, 4.6459),
    (0.3341, 1.3845, -4.7716, -6.1689, 56.6905, -65.3529, 26.3124),
)


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def to_byte(x: Column) -> Column:
    """Clip to 0..255 and truncate; NULL and NaN give NULL."""
    return F.when(~F.isnan(x), clip(x.cast("double"), 0.0, 255.0).cast("int")).cast("smallint")


def sh_to_unit(c: Column) -> Column:
    """A colour channel (about 0..1) from its zeroth spherical-harmonic coefficient."""
    return F.lit(SH_C0) * c + 0.5


def viridis(t: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue in 0..1 of the colour map at t, clipped to 0..1."""
    t = clip(t, 0.0, 1.0)
    out = []
    for terms in VIRIDIS:
        value = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            value = F.lit(c) + t * value
        out.append(clip(value, 0.0, 1.0))
    return tuple(out)


def nice_step(x: Column) -> Column:
    """The nearest of 1, 2, 5, 10 times a power of ten below x; 1 if x is not positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)).cast("double"))
    f = x / base
    return F.when(x <= 0, 1.0).otherwise(F.when(f < 1.5, 1.0).when(f < 3.5, 2.0).when(f < 7.5, 5.0).otherwise(10.0) * base)


def pack_node(img: Column, feat: Column) -> Column:
    """One bigint for (image, feature): the feature in the low 24 bits; a feature that does not fit there fails."""
    fits = F.assert_true((feat >= 0) & (feat <= 0xFFFFFF) | feat.isNull(), F.concat(F.lit("feature number out of range: "), feat.cast("string")))
    node = F.shiftleft(img.cast("bigint"), 24).bitwiseOR(feat.cast("bigint").bitwiseAND(F.lit(0xFFFFFF).cast("bigint")))
    return F.coalesce(fits.cast("bigint"), node)


def unpack_node(node: Column) -> tuple[Column, Column]:
    return F.shiftright(node, 24).cast("int"), node.bitwiseAND(F.lit(0xFFFFFF).cast("bigint")).cast("int")


def hex_to_rgb(code: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of #rgb or #rrggbb."""
    bare = F.regexp_replace(code, "^#+", "")
    wide = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    return tuple(F.conv(F.substring(wide, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(3))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb in lower case; channels are rounded half to even and clipped."""
    part = lambda c: F.lower(F.lpad(F.hex(clip(F.bround(c.cast("double")), 0.0, 255.0).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def mix(a: Column, b: Column, t: float) -> Column:
    """A linear blend of two hex colours; t = 0 is a."""
    return rgb_to_hex(*[x + (y - x) * t for x, y in zip(hex_to_rgb(a), hex_to_rgb(b), strict=True)])


def lighten(code: Column, t: float) -> Column:
    return mix(code, F.lit("#ffffff"), t)


def darken(code: Column, t: float) -> Column:
    return mix(code, F.lit("#000000"), t)


def luminance(code: Column) -> Column:
    """Relative brightness, 0 to 1, with the Rec. 601 weights."""
    r, g, b = hex_to_rgb(code)
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255.0


def cache_key(path: Column, mtime: Column, size: Column, max_image_size: int, features: int, contrast: float, edge: float) -> Column:
    """16 hex digits that change with a file or with the settings of feature extraction."""
    return F.substring(F.sha1(F.concat_ws("|", path, mtime.cast("string"), size.cast("string"), *map(F.lit, map(str, (max_image_size, features, contrast, edge))))), 1, 16)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def data_uri(uri: Column) -> Column:
    """The bytes of a base64 data URI."""
    return F.unbase64(F.element_at(F.split(uri, ",", 2), 2))


def delimiter(row: Column) -> Column:
    """The most frequent of comma, tab and semicolon in a line, in this order on ties; NULL (white space) if there is none."""
    count = lambda c: F.length(row) - F.length(F.replace(row, F.lit(c)))
    n = [count(c) for c in (",", "\t", ";")]
    most = F.greatest(*n)
    return F.when(most == 0, F.lit(None).cast("string")).when(n[0] == most, ",").when(n[1] == most, "\t").otherwise(";")


def merge_maps(base: Column, over: Column) -> Column:
    """A map with the entries of both; those of `over` win."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(kept, over)


def draw_count(cost_ms: Column, points: Column, target_ms: float, ceiling: int, floor: int = 15_000) -> Column:
    """How many points to draw in `target_ms` at `cost_ms` a point; an eighth of the cloud before the cost is known."""
    top = F.greatest(F.lit(floor), F.least(F.lit(ceiling), points)).cast("bigint")
    first = F.least(top, F.greatest(F.lit(30_000), F.floor(points / 8)))
    wanted = F.when(cost_ms > 1e-6, F.floor(F.lit(target_ms) / cost_ms)).otherwise(first)
    return F.when(points <= 0, 0).otherwise(F.greatest(F.lit(floor), F.least(wanted, top))).cast("bigint")


def fit_distance(half: tuple[Column, Column, Column], radius: Column, yaw: float, pitch: float, fov: float, aspect: float, fill: float = 0.92) -> Column:
    """The camera distance at which a box of half sizes `half` fills `fill` of the view.

    The box's extent along an axis u is sum |u_i| half_i, so its corners need no enumeration.
    """
    d = (math.cos(pitch) * math.sin(yaw), math.sin(pitch), math.cos(pitch) * math.cos(yaw))
    length = math.hypot(d[0], d[2]) + 1e-12
    right = (-d[2] / length, 0.0, d[0] / length)
    up = (right[1] * d[2] - right[2] * d[1], right[2] * d[0] - right[0] * d[2], right[0] * d[1] - right[1] * d[0])
    reach = lambda u: abs(u[0]) * half[0] + abs(u[1]) * half[1] + abs(u[2]) * half[2]
    tan = math.tan(math.radians(fov) / 2)
    return F.greatest(reach(up) / max(fill * tan, 1e-6), reach(right) / max(fill * tan * aspect, 1e-6), radius * 0.25)
