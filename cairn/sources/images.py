"""Photographs: listing, and a cache of their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.camera import exif_focal_px
from ..functions.scalars import basename, cache_key

#: Extensions of photographs, fixed values.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, mtime, size) of the photographs in a folder, once each, by path; no file is opened."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS)
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{any_case}}}").load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return found.dropDuplicates(["path"]).select("path", basename(F.col("path")).alias("name"), "mtime", "size").orderBy("path")


def with_cache_key(images: DataFrame, max_image_size: int, features: int, contrast: float, edge: float) -> DataFrame:
    return images.withColumn("cache_key", cache_key(F.col("path"), F.col("mtime").cast("double"), F.col("size"), max_image_size, features, contrast, edge))


def write_features(features: DataFrame, folder: str) -> None:
    """features with cache_key, as Parquet by key; keys written again replace what was there."""
    before = features.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode")
    try:
        features.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        features.write.mode("overwrite").partitionBy("cache_key").parquet(folder)
    finally:
        features.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def split_cached(images: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images whose features are in the cache, and those that have to be extracted."""
    keys = cache.select("cache_key").distinct()
    return images.join(keys, "cache_key", "left_semi"), images.join(keys, "cache_key", "left_anti")


def load(images: DataFrame, max_size: int, factor: float = 1.2) -> DataFrame:
    """(img, path, width, height, scale, exif_focal, fx, fy, cx, cy, gray, red, green, blue) of photographs (img, path).

    Turned as EXIF says, and made smaller until the longer side is at most `max_size`. A file that cannot be
    read has NULLs and an `error`. Needs Pillow on the executors, and says so if it is missing.
    """
    from ..functions.camera import guess_intrinsics

    opened = images.sparkSession.read.format("binaryFile").load([r["path"] for r in images.select("path").collect()]).select("path", "content")

    def run(batches):
        import io

        import pandas as pd

        try:
            from PIL import Image, ImageOps
        except ImportError as e:
            raise RuntimeError("decoding photographs needs the package Pillow, which is not installed") from e
        for batch in batches:
            rows = []
            for img, path, content in batch.itertuples(index=False):
                try:
                    raw = Image.open(io.BytesIO(content))
                    exif = raw.getexif()
                    tags = dict(exif) | dict(exif.get_ifd(0x8769))
                    longer = max(raw.size)
                    made = ImageOps.exif_transpose(raw).convert("RGB")
                    scale = min(1.0, max_size / max(made.size))
                    if scale < 1:
                        made = made.resize([max(1, round(s * scale)) for s in made.size], Image.LANCZOS)
                    number = lambda tag: float(tags[tag]) if tags.get(tag) else None
                    # EXIF tags: focal length, focal-plane resolution and its unit, and the 35 mm equivalent.
                    rows.append((img, path, *made.size, scale, longer, number(37386), number(41486), tags.get(41488, 2), number(41989), made.convert("L").tobytes(), *[c.tobytes() for c in made.split()], None))
                except Exception as e:  # noqa: BLE001  one bad file is a row, not the end of the run
                    rows.append((img, path, *[None] * 12, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    schema = "img int, path string, width int, height int, scale double, original double, focal_mm double, plane double, unit int, focal_35 double, gray binary, red binary, green binary, blue binary, error string"
    out = images.select("img", "path").join(opened, "path").select("img", "path", "content").mapInPandas(run, schema)
    longer = F.greatest("width", "height").cast("double")
    out = out.withColumn("exif_focal", exif_focal_px(longer, F.col("original"), F.col("focal_mm"), F.col("plane"), F.col("unit"), F.col("focal_35")))
    f, cx, cy = guess_intrinsics(F.col("width"), F.col("height"), F.col("exif_focal"), factor)
    return out.withColumns({"fx": f, "fy": f, "cx": cx, "cy": cy}).drop("original", "focal_mm", "plane", "unit", "focal_35")


def extract_features(loaded: DataFrame, features: int = 8000, contrast: float = 0.004, edge: float = 10.0) -> DataFrame:
    """(img, feat, u, v, size, desc, r, g, b): SIFT features of loaded photographs. Needs OpenCV on the executors."""

    def run(batches):
        import numpy as np
        import pandas as pd

        try:
            import cv2
        except ImportError as e:
            raise RuntimeError("feature extraction needs the package opencv-python, which is not installed") from e
        sift = cv2.SIFT_create(nfeatures=features, contrastThreshold=contrast, edgeThreshold=edge)
        for batch in batches:
            for row in batch.itertuples(index=False):
                plane = lambda raw: np.frombuffer(raw, np.uint8).reshape(row.height, row.width)  # noqa: E731, B023
                points, desc = sift.detectAndCompute(plane(row.gray), None)
                if not points:
                    continue
                u, v = np.array([p.pt for p in points]).T
                yield pd.DataFrame({"img": row.img, "feat": np.arange(len(points)), "u": u, "v": v, "size": [p.size for p in points], "desc": list(desc.astype(np.float32))} | sample_colors(u, v, [plane(c) for c in (row.red, row.green, row.blue)]))

    return loaded.where("error IS NULL").select("img", "width", "height", "gray", "red", "green", "blue").mapInPandas(run, "img int, feat bigint, u double, v double, size double, desc array<float>, r smallint, g smallint, b smallint")


def sample_colors(u, v, planes) -> dict:
    """Colours of the pixels nearest to places, which are clipped to the image."""
    import numpy as np

    rows, cols = planes[0].shape
    at = np.clip(np.rint(v).astype(int), 0, rows - 1), np.clip(np.rint(u).astype(int), 0, cols - 1)
    return {c: p[at].astype(np.int16) for c, p in zip("rgb", planes, strict=True)}
