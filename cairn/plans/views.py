"""Stand-ins for photographs and clouds, made from the driver's tables; each with its DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import matching, tracks
from ..operators.cloud import row_numbers
from ..operators.geometry import rotation
from ..tables import staged

#: Columns that identify a row of lineitem.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
RATIO = 0.95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as descriptors: the label is the image."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("img"), F.col("vec_id").alias("feat"), F.col("embedding").alias("desc"))


def cloud_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    axes = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    colors = [(F.col("label") * k).cast("int").alias(c) for c, k in (("r", 20), ("g", 10), ("b", 5))]
    return e.select(F.col("vec_id").alias("point_id"), *axes, *colors)


def cloud_large(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """lineitem as a cloud; `keyed` keeps the identifying columns for an order instead of making none."""
    line = table(spark, sf_dir, "lineitem")
    colors = [(F.col("l_quantity") * 5).cast("int").alias("r"), F.round(F.col("l_discount") * 1000).cast("int").alias("g"), F.round(F.col("l_tax") * 1000).cast("int").alias("b")]
    xyz = [F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z")]
    return line.select(*(LINE_KEY if keyed else []), *xyz, *colors)


def cloud_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cloud_large with point_id from 0 in the order of the identifying columns."""
    rows = row_numbers(cloud_large(spark, sf_dir, keyed=True), LINE_KEY, "point_id")
    return rows.select("point_id", "x", "y", "z", "r", "g", "b")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(matching.match_all(features(spark, sf_dir), RATIO), "matches")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.match_components(matches(spark, sf_dir))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera per nation, on an arc that looks along z."""
    a = F.col("n_nationkey") * 0.05
    zero = F.lit(0.0)
    r = F.array(F.cos(a), zero, F.sin(a), zero, F.lit(1.0), zero, -F.sin(a), zero, F.cos(a))
    t = F.array(-(F.col("n_nationkey") * 0.1), zero, F.lit(1.0) + F.col("n_regionkey") * 0.1)
    k = [F.lit(v).alias(n) for n, v in (("fx", 800.0), ("fy", 800.0), ("cx", 320.0), ("cy", 240.0))]
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("img"), r.alias("r"), t.alias("t"), *k)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per part; every tenth is behind the cameras."""
    p = table(spark, sf_dir, "part")
    z = F.when(F.col("p_partkey") % 10 == 0, -5.0).otherwise(5.0 + F.col("p_size") / 10.0)
    return p.select(F.col("p_partkey").alias("pid"), F.col("p_partkey").alias("track_id"), (F.col("p_partkey") % 100 / 50.0 - 1).alias("x"), (F.col("p_partkey") % 37 / 20.0 - 1).alias("y"), z.alias("z"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, img, feat, u, v): each part is seen by four images, a few pixels off for some."""
    p = points(spark, sf_dir).select("track_id", "x", "y", "z")
    seen = p.select("*", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    seen = seen.withColumn("img", ((F.col("track_id") + F.col("k") * 7) % 25).cast("int")).join(F.broadcast(cameras(spark, sf_dir)), "img")
    cx, cz = (F.col("r")[3 * i] * F.col("x") + F.col("r")[3 * i + 2] * F.col("z") + F.col("t")[i] for i in (0, 2))
    off = F.when(F.col("track_id") % 6 == 0, 20.0).otherwise(F.col("k") / 4.0)
    safe = F.when(F.abs(cz) < 1e-3, 1e-3).otherwise(cz)
    return seen.select("track_id", "img", F.col("track_id").alias("feat"), (F.lit(800.0) * cx / safe + 320.0 + off).alias("u"), (F.lit(800.0) * F.col("y") / safe + 240.0).alias("v"))


#: The synthetic scene: a camera matrix, eight cameras on an arc, and a point for each customer in a cube before them.
K = np.array([[800.0, 0.0, 320.0], [0.0, 800.0, 240.0], [0.0, 0.0, 1.0]])


def scene_poses() -> list[tuple[np.ndarray, np.ndarray]]:
    return [(rotation(np.array([0.02 * k, 0.12 * k, 0.01 * k])), np.array([0.1 * k, 0.0, 6.0])) for k in range(8)]


def project(r: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact images of places."""
    c = x @ r.T + t
    return c[:, :2] / c[:, 2:] * 800 + [320, 240]


def scene_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    axes = [((key * step) % 2003 / 1001.5 - 1).alias(c) for c, step in zip("xyz", (1, 733, 1291), strict=True)]
    return table(spark, sf_dir, "customer").select(key.alias("pid"), *axes)


def scene_images(points: DataFrame) -> DataFrame:
    """(track_id, img, u, v): the exact place of each point in all eight images."""
    cameras = F.array(*[F.struct(F.lit(k).alias("img"), *[F.lit(float(v)).alias(f"m{n}") for n, v in enumerate([*r.ravel(), *t])]) for k, (r, t) in enumerate(scene_poses())])
    rows = points.select(F.col("pid").alias("track_id"), "x", "y", "z", F.explode(cameras).alias("c"))
    cx, cy, cz = (sum(F.col(f"c.m{3 * i + k}") * F.col(a) for k, a in enumerate("xyz")) + F.col(f"c.m{9 + i}") for i in range(3))
    return rows.select("track_id", F.col("c.img").alias("img"), (cx / cz * 800 + 320).alias("u"), (cy / cz * 800 + 240).alias("v"))


SCENE = """
scene_points AS (SELECT c_custkey AS pid FROM customer)"""
CLOUD = """
cloud AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z,
         CAST(trunc(l_quantity * 5) AS INT) AS r, CAST(round(l_discount * 1000) AS INT) AS g, CAST(round(l_tax * 1000) AS INT) AS b
  FROM lineitem
)"""
NUMBERED = (
    CLOUD
    + """,
numbered AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS point_id, x, y, z, r, g, b FROM cloud
)"""
)
SMALL = """
small AS (
  SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
         CAST(label * 20 AS INT) AS r, CAST(label * 10 AS INT) AS g, CAST(label * 5 AS INT) AS b
  FROM embeddings
)"""
MATCHES = f"""
pair AS (
  SELECT a.label AS img, a.vec_id AS feat, b.label AS other, b.vec_id AS ofeat,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS d
  FROM embeddings a JOIN embeddings b ON a.label <> b.label
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY img, feat, other ORDER BY d, ofeat) AS rk FROM pair),
two AS (
  SELECT img, feat, other, min(d) AS d1, max(d) AS d2, max(CASE WHEN rk = 1 THEN ofeat END) AS ofeat
  FROM ranked WHERE rk <= 2 GROUP BY ALL HAVING count(*) = 2
),
directed AS (SELECT img, feat, other, ofeat FROM two WHERE d1 < {RATIO} * d2),
matches AS (
  SELECT f.img AS i, f.other AS j, f.feat AS fi, f.ofeat AS fj FROM directed f
  JOIN directed g ON f.img = g.other AND f.other = g.img AND f.feat = g.ofeat AND f.ofeat = g.feat WHERE f.img < f.other
)"""
COMPONENTS = (
    MATCHES
    + """,
edge AS (
  SELECT i * 16777216 + fi AS a, j * 16777216 + fj AS b FROM matches
  UNION ALL SELECT j * 16777216 + fj, i * 16777216 + fi FROM matches
),
reach(node, root) AS (
  SELECT a, a FROM edge UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node
),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""
)
TRACKS = (
    COMPONENTS
    + """,
single AS (
  SELECT component AS track_id, node // 16777216 AS img, min(node % 16777216) AS feat FROM comp GROUP BY ALL HAVING count(*) = 1
),
tracks AS (SELECT * FROM single WHERE track_id IN (SELECT track_id FROM single GROUP BY track_id HAVING count(*) >= 2))"""
)
CAMERAS = """
cameras AS (
  SELECT n_nationkey AS img, n_nationkey * 0.05::DOUBLE AS a, -(n_nationkey * 0.1::DOUBLE) AS t0, 1.0::DOUBLE + n_regionkey * 0.1::DOUBLE AS t2 FROM nation
)"""
POINTS = (
    CAMERAS
    + """,
points AS (
  SELECT p_partkey AS pid, p_partkey AS track_id, p_partkey % 100 / 50.0::DOUBLE - 1 AS x, p_partkey % 37 / 20.0::DOUBLE - 1 AS y,
         CASE WHEN p_partkey % 10 = 0 THEN -5.0::DOUBLE ELSE 5.0::DOUBLE + p_size / 10.0::DOUBLE END AS z
  FROM part
)"""
)
SEEN = (
    POINTS
    + """,
seen AS (
  SELECT *, cos(a) * x + sin(a) * z + t0 AS px, -sin(a) * x + cos(a) * z + t2 AS pz
  FROM (SELECT points.*, k, CAST((track_id + k * 7) % 25 AS INT) AS img FROM points CROSS JOIN range(4) AS k(k)) JOIN cameras USING (img)
),
obs AS (
  SELECT *, 800.0::DOUBLE * px / CASE WHEN abs(pz) < 1e-3 THEN 1e-3::DOUBLE ELSE pz END + 320.0::DOUBLE + CASE WHEN track_id % 6 = 0 THEN 20.0::DOUBLE ELSE k / 4.0::DOUBLE END AS u,
         800.0::DOUBLE * y / CASE WHEN abs(pz) < 1e-3 THEN 1e-3::DOUBLE ELSE pz END + 240.0::DOUBLE AS v
  FROM seen
),
err AS (
  SELECT *, CASE WHEN pz > 1e-8 THEN sqrt((800.0::DOUBLE * px / pz + 320.0::DOUBLE - u) ** 2 + (800.0::DOUBLE * y / pz + 240.0::DOUBLE - v) ** 2) END AS error FROM obs
)"""
)
