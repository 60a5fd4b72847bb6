"""Approximate nearest descriptors: an inverted file of centres, so that a feature meets a few lists instead of the collection.

Centres are fitted to a bounded sample; every feature has its place in the list of its nearest centre. A feature asks the
lists of its `probes` nearest centres. How many that have to be is measured: features of a sample are compared with all
features of some images, and the ranks of the lists that hold both their true neighbours give the share that is found. Long
lists are cut into parts, and a part meets a part of those who ask in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..tables import staged
from .matching import _two

#: Descriptors that centres are fitted to; rounds of it; lists at most.
SAMPLE, ROUNDS, LISTS = 16_384, 12, 4096
#: Features and images that the number of probes is measured with.
ASKED, IMAGES = 256, 32
#: Features of a part of a list, about.
PART = 2048


@dataclass
class Index:
    """`homes` (list, img, feat, desc) of every feature; `recall` is the measured share of features and images whose two true neighbours are found at `probes`."""

    centers: np.ndarray
    homes: DataFrame
    probes: int
    recall: float


def _some(rows: DataFrame, total: int, most: int, *by: str) -> DataFrame:
    """About `most` of `total` rows, by hash; a bounded sample."""
    return rows.where(F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(1 << 20)) < F.lit(most / max(1, total) * (1 << 20) + 1)).limit(2 * most)


def fit_centers(x: np.ndarray, lists: int, seed: int = 42) -> np.ndarray:
    """Centres of `lists` groups of rows, by alternating means; fewer if there are fewer different rows."""
    x = np.unique(x, axis=0)
    centers = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        home = np.concatenate([nearest_lists(x[at : at + PART], centers, 1)[:, 0] for at in range(0, len(x), PART)])
        n = np.bincount(home, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, home, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest_lists(x: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the nearest centres of each row, nearest first."""
    d = (centers**2).sum(1) - 2 * x @ centers.T
    return np.argsort(d, axis=1, kind="stable")[:, :probes]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _listed(features: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """(list, img, feat, desc): a row of each feature for each of its nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found = nearest_lists(_matrix(part.column(2)), centers, probes)
                take = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel(), pa.int32()), *(c.take(take) for c in part.columns)], ["list", "img", "feat", "desc"])

    rows = features.select(F.col("img").cast("int").alias("img"), F.col("feat").cast("long").alias("feat"), F.col("desc").cast("array<float>").alias("desc"))
    return rows.mapInArrow(run, "list int, img int, feat long, desc array<float>")


def _two_best(x: np.ndarray, img: np.ndarray, y: np.ndarray, other: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): for each row of x the two nearest rows of y of each other image; ties to the lower feature."""
    order = np.lexsort((feat, other))
    rough = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
    found = []
    cuts = np.flatnonzero(np.diff(other[order], prepend=other[order][:1] - 1))
    for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:z]
        who = np.flatnonzero(img != other[own[0]])
        some = min(4, len(own))
        take = np.sort(np.argpartition(rough[np.ix_(who, own)], some - 1, axis=1)[:, :some], axis=1)
        d = np.sqrt(sum((x[who, k, None] - y[own[take], k]) ** 2 for k in range(x.shape[1])))
        first = np.argsort(d, axis=1, kind="stable")[:, :2]
        rows = np.arange(len(who))[:, None]
        found.append((np.repeat(who, first.shape[1]), own[take[rows, first]].ravel(), d[rows, first].ravel()))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def build(features: DataFrame, target: float = 0.95, lists: int | None = None, seed: int = 42) -> Index | None:
    """The index of `features` (img, feat, desc), with as many probes as find both of the two nearest for `target` of the features and images; None of none.

    Descriptors have one length; rows with a null one are left out.
    """
    features = features.where("desc IS NOT NULL")
    total = features.count()
    if not total:
        return None
    sample = _some(features.select("img", "feat", "desc"), total, SAMPLE, "img", "feat").collect()
    x = np.array([r["desc"] for r in sample], np.float64)
    centers = fit_centers(x, min(lists or math.ceil(math.sqrt(total)), LISTS), seed)
    homes = staged(_listed(features, centers, 1), "homes")
    # Measured on a few features against whole images.
    asked = sample[: min(len(sample), ASKED)]
    a, a_img = np.array([r["desc"] for r in asked], np.float64), np.array([r["img"] for r in asked])
    images = features.select("img").distinct()
    some = _some(images, images.count(), IMAGES, "img")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                home, img, feat = (part.column(c).to_numpy() for c in range(3))
                q, row, d = _two_best(a, a_img, _matrix(part.column(3)), img, feat)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(img[row], pa.int32()), pa.array(feat[row], pa.int64()), pa.array(home[row], pa.int32()), pa.array(d)], ["q", "other", "feat", "list", "d"])

    near = homes.join(F.broadcast(some), "img", "left_semi").select("list", "img", "feat", "desc").mapInArrow(compare, "q int, other int, feat long, list int, d double")
    rank = F.row_number().over(W.partitionBy("q", "other").orderBy("d", "feat"))
    enough = F.count(F.lit(1)).over(W.partitionBy("q", "other"))  # an image of one feature has no two nearest
    true = near.withColumns({"rank": rank, "n": enough}).where("rank <= 2 AND n >= 2").groupBy("q", "other").agg(F.collect_list("list").alias("lists")).collect()  # ASKED * IMAGES rows at most
    order = np.argsort(nearest_lists(a, centers, len(centers)), axis=1)
    ranks = np.sort(np.array([order[r["q"], r["lists"]].max() for r in true], int))
    probes = int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)))]) + 1 if len(ranks) else 1
    return Index(centers, homes, probes, float((ranks < probes).mean()) if len(ranks) else 1.0)


def search(index: Index, features: DataFrame, probes: int | None = None) -> DataFrame:
    """(img, feat, other, d1, d2, nearest): of each feature the two nearest of every other image, of those its lists hold.

    As matching.nearest_two(), but a pair of images has no row where fewer than two features were found.
    """
    asked = _listed(features.where("desc IS NOT NULL"), index.centers, probes or index.probes)

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias(name))

    sizes = staged(parts(index.homes, "h").join(parts(asked, "q"), "list"), "parts")

    def dealt(rows: DataFrame, own: str, others: str) -> DataFrame:
        numbered = rows.join(F.broadcast(sizes), "list").withColumn(f"{own}_part", F.pmod(F.xxhash64("img", "feat"), F.col(own)))  # LISTS rows at most
        return numbered.withColumn(f"{others}_part", F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select("list", F.col("h_part").cast("int").alias("h_part"), F.col("q_part").cast("int").alias("q_part"), "img", "feat", "desc")

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            q, row, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            q, row, d = _two_best(_matrix(a.column("desc").combine_chunks()), a.column("img").to_numpy(), _matrix(b.column("desc").combine_chunks()), b.column("img").to_numpy(), b.column("feat").to_numpy())
        take, got = pa.array(q), pa.array(row)
        return pa.table({"img": a.column("img").take(take), "feat": a.column("feat").take(take), "other": b.column("img").take(got), "ofeat": b.column("feat").take(got), "d": pa.array(d)})

    key = ["list", "h_part", "q_part"]
    met = dealt(asked, "q", "h").groupBy(*key).cogroup(dealt(index.homes, "h", "q").groupBy(*key)).applyInArrow(product, "img int, feat long, other int, ofeat long, d double")
    rank = F.row_number().over(W.partitionBy("img", "feat", "other").orderBy("d", "ofeat"))
    return _two(met.withColumn("rank", rank).where("rank <= 2"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(img, n, first, second): of each image, pairs of a feature and another image, and the shares whose nearest and second distance are right."""
    key = ["img", "feat", "other"]
    rows = exact.select(*key, "d1", "d2").join(found.select(*key, F.col("d1").alias("f1"), F.col("d2").alias("f2")), key, "left")
    same = [F.coalesce(F.abs(F.col(f"d{k}") - F.col(f"f{k}")) <= 1e-9, F.lit(False)).cast("int") for k in (1, 2)]
    return rows.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.avg(same[0]).alias("first"), F.avg(same[1]).alias("second"))
