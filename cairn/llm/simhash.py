"""SimHash fingerprints and exact near-duplicate classes through vantage-point trees.

Equal fingerprints are one node. A tree of vantage points, fitted to a bounded sample of the fingerprints,
splits them by Hamming distance, and shards that are still heavy get trees of their own: those up to `mu` bits from the vantage point go inside, the others outside.
If two fingerprints at most `radius` apart are split, the outer one is at most mu + radius away by the
triangle inequality; such boundary fingerprints go to both sides. So every pair within the radius meets in
some shard, whatever the sample was: the sample decides balance only. Inside a shard the same tree is
continued in memory. A shard gives a star for each group it finds, not the group's pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.tracks import roots
from ..tables import staged
from .common import balanced

#: Fingerprints of a sample that balances a tree, of a shard, about, and of those compared all with all.
SAMPLE, SHARD, LEAF = 20_000, 8_192, 384
#: Shards of more than this many fingerprints get a tree of their own, as long as that splits them; fingerprints of the sample of each.
HEAVY, SUBSAMPLE = 8 * SHARD, 2_048
#: Shingles hashed at once.
PORTION = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    from xxhash import xxh64_digest

    # bytes.lower() changes A-Z alone; bytes.split() splits at bytes 32 and 9 to 13 alone.
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = (np.cumsum([len(t) + 1 for t in tokens]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = ends[words - 1 :] or ends[-1:]
    count = np.zeros(64, np.int64)
    for at in range(0, len(last), PORTION):
        digests = b"".join([xxh64_digest(joined[a:z], 42) for a, z in zip(starts[at : at + PORTION], last[at : at + PORTION], strict=False)])
        count += bits_set(np.frombuffer(digests, np.uint8).reshape(-1, 8))
    return majority(count, len(last))


def bits_set(digests: np.ndarray) -> np.ndarray:
    """How many of (n, 8) bytes of big-endian hashes have each bit set."""
    bits = np.unpackbits(digests, axis=1)
    return sum((bits[at : at + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for at in range(0, len(bits), 255)), np.zeros(64, np.int64))


def majority(count: np.ndarray, total: int) -> int:
    """The bits that are set in over half of `total` hashes."""
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, fp long (the fingerprint's 64 bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 1):
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    kind = df.select(id_col).dtypes[0][1]
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def distance(fps: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(point)).astype(np.int64)


def choose(fps: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point and mu that split `fps` with few at the boundary; None if none of those tried splits them."""
    best, found = 0.97, None
    for k in np.linspace(0, len(fps) - 1, 8).astype(int):
        count = np.bincount(distance(fps, int(fps[k])), minlength=65)
        upto = np.cumsum(count)
        for mu in range(64):
            inside, outside = upto[min(64, mu + radius)], len(fps) - upto[mu]
            if outside and upto[mu] and (cost := (inside**2 + outside**2) / len(fps) ** 2) < best:
                best, found = cost, (int(fps[k]), mu)
    return found


class Tree:
    """Vantage points and boundaries as arrays; nodes without a vantage point are shards."""

    def __init__(self, sample: np.ndarray, total: int, radius: int, shard: int):
        self.radius = radius
        self.point: list[int] = []
        self.mu: list[int] = []
        self.child: list[tuple[int, int]] = []
        self._grow(np.unique(sample), total / max(1, len(sample)), shard)

    def _grow(self, fps: np.ndarray, scale: float, shard: int) -> int:
        node = len(self.point)
        self.point.append(0)
        self.mu.append(-1)
        self.child.append((-1, -1))
        split = choose(fps, self.radius) if len(fps) * scale > shard and len(fps) >= 16 else None
        if split:
            self.point[node], self.mu[node] = split
            d = distance(fps, split[0])
            inside = self._grow(fps[d <= split[1] + self.radius], scale, shard)
            self.child[node] = (inside, self._grow(fps[d > split[1]], scale, shard))
        return node

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every fingerprint and each shard that it must be in."""
        rows, found = [], []
        stack = [(0, np.arange(len(fps)))]
        while stack:
            node, who = stack.pop()
            if self.mu[node] < 0:
                rows.append(who)
                found.append(np.full(len(who), node))
            elif len(who):
                d = distance(fps[who], self.point[node])
                stack += [(self.child[node][0], who[d <= self.mu[node] + self.radius]), (self.child[node][1], who[d > self.mu[node]])]
        return np.concatenate(rows), np.concatenate(found)


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of i and j: label becomes the least index of each group."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def link(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of distinct `fps`, the least index of those reachable by steps of at most `radius` bits."""
    label = np.arange(len(fps))
    stack = [label.copy()]
    while stack:
        who = stack.pop()
        split = choose(fps[who], radius) if len(who) > LEAF else None
        if split:
            d = distance(fps[who], split[0])
            stack += [who[d <= split[1] + radius], who[d > split[1]]]
            continue
        step = max(1, (1 << 20) // max(1, len(who)))
        for at in range(0, len(who), step):
            near = np.bitwise_count(fps[who[at : at + step], None] ^ fps[None, who[at:]]) <= radius
            i, j = np.nonzero(near)
            off = i < j
            if off.any():
                _hook(label, who[at + i[off]], who[at + j[off]])
    return label


def _some(df: DataFrame, share: Column, salt: int) -> DataFrame:
    # By hash: it balances the trees and decides no link.
    return df.where(F.pmod(F.xxhash64("fp", F.lit(salt)), F.lit(1 << 20)) < share * (1 << 20) + 1)


def _split(heavy: DataFrame, level: int, radius: int) -> DataFrame:
    """(shard, fp, rep): `heavy` (shard, fp, rep, n), n rows a shard, dealt on by a tree for each shard.

    A tree is fitted to SUBSAMPLE rows in a task of the shard, and goes ahead of the rows to the tasks that deal them: about
    HEAVY rows each. Neither trees nor shard numbers pass through the driver.
    """
    kind, shard = dict(heavy.dtypes)["rep"], SHARD

    def fit(sample: pa.Table) -> pa.Table:
        n = sample.column("n")[0].as_py()
        tree = Tree(np.sort(sample.column("fp").to_numpy().view(np.uint64)), n, radius, shard)
        return pa.table({"shard": sample.column("shard")[:1], "n": pa.array([n], pa.int64()), "tree": pa.array([pickle.dumps((tree.point, tree.mu, tree.child))], pa.binary())})

    trees = _some(heavy, SUBSAMPLE / F.col("n"), level).select("shard", "n", "fp").groupBy("shard").applyInArrow(fit, "shard long, n long, tree binary")
    parts = F.ceil(F.col("n") / HEAVY)
    first = trees.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "tree", F.lit(None).cast("long").alias("fp"), F.lit(None).cast(kind).alias("rep"))
    rows = heavy.select("shard", F.pmod(F.xxhash64("fp", F.lit(-level)), parts).alias("part"), F.lit(None).cast("binary").alias("tree"), "fp", "rep")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            shard, fps = batch.column(0).to_numpy(), pc.fill_null(batch.column(3), 0).to_numpy().view(np.uint64)
            is_tree = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0]))
            for a, z in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                old = int(shard[a])
                if old != of:
                    tree, of = None, old
                if is_tree[a:z].any():
                    tree = object.__new__(Tree)
                    tree.radius = radius
                    tree.point, tree.mu, tree.child = pickle.loads(batch.column(2)[a + int(np.argmax(is_tree[a:z]))].as_py())
                mine = a + np.flatnonzero(~is_tree[a:z])
                if not len(mine):
                    continue
                at, leaf = tree.shards(fps[mine]) if tree and len(tree.point) > 1 else (np.arange(len(mine)), None)
                take = pa.array(mine[at])
                # Numbers of a level begin beyond those of the one before.
                new = np.full(len(mine), old) if leaf is None else leaf + ((old + 1) * (1 << 13) + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), batch.column(3).take(take), batch.column(4).take(take)], ["shard", "fp", "rep"])

    told = first.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("tree").isNull())
    return told.select("shard", "part", "tree", "fp", "rep").mapInArrow(deal, f"shard long, fp long, rep {kind}")


def dealt(nodes: DataFrame, total: int, radius: int) -> DataFrame:
    """(shard, fp, rep): `nodes` (fp, rep) in every shard that they must be in.

    The first tree is fitted to SAMPLE of all fingerprints, about, and that sample is all that reaches the driver. Shards
    that are HEAVY then get a tree each, up to three times: so depth grows with the corpus.
    """
    kind = nodes.select("rep").dtypes[0][1]
    sample = np.array([r["fp"] for r in _some(nodes, F.lit(min(1.0, SAMPLE / max(1, total))), 0).select("fp").limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    tree = Tree(np.sort(sample), total, radius, SHARD)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaf = tree.shards(batch.column(0).to_numpy().view(np.uint64))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column(0).take(take), batch.column(1).take(take)], ["shard", "fp", "rep"])

    now, done = staged(nodes.select("fp", "rep").mapInArrow(deal, f"shard long, fp long, rep {kind}"), "dealt"), []
    for level in range(1, 4):
        sizes = staged(now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY), "heavy")
        if sizes.isEmpty():
            break
        done.append(now.join(sizes, "shard", "left_anti"))
        now = staged(_split(now.join(sizes, "shard"), level, radius), "dealt")
    for part in done:
        now = now.unionByName(part.select("shard", "fp", "rep"))
    return now


def near_classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component) of every fingerprint in `prints` (id, fp): the least id reachable over links within `radius` bits.

    Rows with a null id are no nodes; a fingerprint that only such rows have gets a null component.
    """
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    nodes = classes.where("rep IS NOT NULL").select("fp", "rep")

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        label = link(table.column("fp").to_numpy().view(np.uint64), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        rep = table.column("rep")
        return pa.table([rep.take(pa.array(moved)), rep.take(pa.array(label[moved]))], ["a", "b"])

    kind = nodes.select("rep").dtypes[0][1]
    edges = dealt(nodes, nodes.count(), radius).groupBy("shard").applyInArrow(links, f"a {kind}, b {kind}")
    found = roots(edges).withColumnRenamed("node", "rep")
    return classes.join(found, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component"))


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, fingerprint (16 hex digits), component_id (least id reachable, its own included).

    Null and wordless texts have fingerprint zero and are linked like any other. Rows that repeat an id are
    separate texts of one node. A row with a null id is no node: it gets the component of documents with its
    fingerprint, or null. Other columns are not read. An empty table gives an empty one.
    """
    prints = staged(fingerprints(df, words, id_col, text_col), "prints")
    known = near_classes(prints, radius)
    return prints.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
