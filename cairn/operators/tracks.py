"""Tracks: matches to (track_id, img, feat), through connected components and conflict resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import pack_node, unpack_node
from ..tables import discard, staged


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another but the least of its component, which is the root.

    Alternating star steps: neighbours above a node are tied to its least neighbour, then each node and its
    lower neighbours to the least of them. The number of steps is logarithmic in the longest path; each
    writes its edges to the shared folder, so lineage stays short and a lost executor repeats one step. A node with many
    edges is only a skewed join, which AQE splits. Null ends and loops are dropped. Ends may be of any type with an order.
    """
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    links = staged(links.distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").bitwiseAND(F.lit(0x7FFFFFFF)))).first()
        if state == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
        # Large star.
        both = links.select(F.col("hi").alias("at"), F.col("lo").alias("to")).union(links.select(F.col("lo").alias("at"), F.col("hi").alias("to")))
        least = both.groupBy("at").agg(F.min("to").alias("min_to")).select("at", F.least("at", "min_to").alias("root"))
        raised = both.join(least.hint("merge"), "at").where("to > at").select(F.col("to").alias("hi"), F.col("root").alias("lo")).where("hi <> lo").distinct()
        # Small star.
        lowest = raised.groupBy("hi").agg(F.min("lo").alias("root"))
        moved = raised.join(lowest.hint("merge"), "hi").where("lo > root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        before, links = links, staged(moved.union(lowest.select("hi", F.col("root").alias("lo"))).distinct(), "links")
        discard(before)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of `edges`."""
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).where("node IS NOT NULL").distinct()
    return nodes.join(roots(edges, a, b).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def match_components(matches: DataFrame) -> DataFrame:
    """(node, component) over packed (image, feature) nodes."""
    edges = matches.select(pack_node(F.col("i"), F.col("fi")).alias("a"), pack_node(F.col("j"), F.col("fj")).alias("b"))
    return connected_components(edges)


def resolve_conflicts(components: DataFrame, min_length: int = 2) -> DataFrame:
    """(track_id, img, feat): in each component, images with more than one feature are dropped; short rests too.

    A track's id is the least node of its component.
    """
    img, feat = unpack_node(F.col("node"))
    per_image = components.select(F.col("component").alias("track_id"), img.alias("img"), feat.alias("feat"))
    single = per_image.groupBy("track_id", "img").agg(F.count(F.lit(1)).alias("n"), F.min("feat").alias("feat")).where("n = 1")
    long = single.groupBy("track_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= max(2, min_length))
    return single.join(long.hint("merge"), "track_id", "left_semi").select("track_id", "img", "feat")


def build_tracks(matches: DataFrame, min_length: int = 2) -> DataFrame:
    return resolve_conflicts(match_components(matches), min_length)


def track_counts(components: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: components, those with a conflict, tracks kept, components dropped."""
    img, _ = unpack_node(F.col("node"))
    conflicted = components.groupBy("component", img.alias("img")).count().where("count > 1").agg(F.countDistinct("component").alias("conflicted"))
    total = components.agg(F.countDistinct("component").alias("components"))
    kept = tracks.agg(F.countDistinct("track_id").alias("tracks"))
    return total.crossJoin(conflicted).crossJoin(kept).withColumn("dropped", F.col("components") - F.col("tracks"))


def track_length_histogram(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
