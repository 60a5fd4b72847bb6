"""Near-duplicates by the similarity of word shingles: SimHash trees and bands propose, exact Jaccard similarity decides.

Texts with the same set of shingles are one class. The SimHash of a class links it, through the vantage-point trees of
simhash.py, to those within RADIUS bits. No tree prunes the radius that would catch all of similarity 0.8 (about 15 % of the
bits, more than the spread of all distances), so what is further apart is proposed by ROWS * BANDS minima of the hashed
shingles: classes that agree in all rows of a band share a block, which a pair of similarity 0.8 misses with a chance of
(1 - 0.8^5)^26 = 3e-5. Inside a block, pairs whose signatures agree in less than MAYBE of their minima are left out (0.8
is more than five standard errors above it). What is linked is a candidate group. Only texts of candidate groups are
read again: pairs of a group are compared by their full shingle sets until the groups of those with `least` or more in
common are known. No text is dropped on an estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.tracks import roots
from ..tables import staged
from .common import balanced, sized
from .simhash import bits_set, majority, near_classes as near_prints

#: Words of a shingle, and least Jaccard similarity of near-duplicates.
WORDS, LEAST = 5, 0.8
#: Bands and minima of each; least share of equal minima of a candidate pair.
BANDS, ROWS, MAYBE = 26, 5, 0.6
#: Bits in which fingerprints linked by the trees differ at most.
RADIUS = 2
#: Shingles whose minima are taken at once.
PORTION = 512

_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_digest

    tokens = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = (np.cumsum([len(t) + 1 for t in tokens]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = ends[words - 1 :] or ends[-1:]
    return np.unique(np.frombuffer(b"".join([xxh64_digest(joined[a:z], 42) for a, z in zip(starts, last, strict=False)]), np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The high halves of the minima of `hashes` under each permutation."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PORTION):
        least = np.minimum(least, ((hashes[at : at + PORTION] ^ _FLIP) * _FACTOR).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that join the same groups of 0 to n - 1 as all pairs for which `near` holds."""
    rest, links = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found, rest = rest[hit].tolist(), rest[~hit]
            links += [(i, j) for j in found]
            queue += found
    return links


def similar(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that join all sets whose Jaccard similarity is `least` or more."""
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), np.int64)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = np.minimum(sizes[rest], sizes[i]) >= least * np.maximum(sizes[rest], sizes[i])
        hit &= np.minimum(sizes[rest], sizes[i]) > 0
        who = rest[hit]
        if len(who):
            mark[codes[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([codes[j] for j in who])], np.cumsum(sizes[who]) - sizes[who])
            mark[codes[i]] = 0
            hit[hit] = both >= least * (sizes[who] + sizes[i] - both) - 1e-9
        return hit

    return spanning(len(sets), near)


def signed(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, print (a hash of the text), same (a hash of its shingle set), fp (its SimHash) and sig of each row with an id, staged."""
    kind = df.select(id_col).dtypes[0][1]
    docs = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("print"), df[text_col].alias("text")).where("id IS NOT NULL")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 2):
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            fps = np.array([majority(bits_set(s.byteswap().view(np.uint8).reshape(-1, 8)), len(s)) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], same, pa.array(fps), pa.array([signature(s).tobytes() for s in sets], pa.binary())], ["id", "print", "same", "fp", "sig"])

    return staged(docs.mapInArrow(sign, f"id {kind}, print long, same binary, fp long, sig binary"), "signed")


def near_classes(rows: DataFrame, df: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of the classes of equal shingle sets in `rows` (of signed()) that have near-duplicates, but for the least of a group."""
    kind = rows.select("id").dtypes[0][1]
    classes = staged(rows.groupBy("same").agg(F.min(F.struct("id", "print")).alias("one"), F.first("fp").alias("fp"), F.first("sig").alias("sig")).select("same", "one.id", "one.print", "fp", "sig"), "classes")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest

        for batch in batches:
            sigs = batch.column(1).to_pylist()
            keys = np.frombuffer(b"".join([xxh64_digest(s[4 * ROWS * k : 4 * ROWS * (k + 1)], k) for s in sigs for k in range(BANDS)]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(np.repeat(np.arange(len(sigs)), BANDS)))], ["key", "same"])

    def maybe(table: pa.Table) -> pa.Table:
        same, sigs = table.column("same"), np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        links = spanning(len(sigs), lambda i, rest: (sigs[rest] == sigs[i]).mean(axis=1) >= MAYBE)
        return pa.table([same.take(pa.array([i for i, _ in links], pa.int64())), same.take(pa.array([j for _, j in links], pa.int64()))], ["a", "b"])

    def confirm(table: pa.Table) -> pa.Table:
        # Rows that are equal in id and text may come more than once.
        same = table.column("same").to_pylist()
        first = pa.array(sorted({s: k for k, s in reversed(list(enumerate(same)))}.values()), pa.int64())
        table = table.take(first)
        links = similar([shingles(t, words) for t in table.column("text").to_pylist()], least)
        return pa.table([table.column("same").take(pa.array([k for k, _ in links], pa.int64())), table.column("same").take(pa.array([k for _, k in links], pa.int64()))], ["a", "b"])

    bands = classes.select("same", "sig").mapInArrow(band, "key long, same binary")
    # The same members meet in many bands: such blocks are one.
    blocks = bands.groupBy("key").agg(F.sort_array(F.collect_set("same")).alias("members")).where(F.size("members") > 1).select("members").distinct()
    members = blocks.select(F.xxhash64("members").alias("block"), F.explode("members").alias("same")).join(classes.select("same", "sig"), "same")
    close = near_prints(classes.select(F.col("same").alias("id"), "fp"), RADIUS)
    close = classes.select("same", "fp").join(close, "fp").select(F.col("same").alias("a"), F.col("component").alias("b")).where("a <> b")
    maybes = roots(members.groupBy("block").applyInArrow(maybe, "a binary, b binary").unionByName(close))
    groups = maybes.union(maybes.select("root", "root").distinct())
    # One text of each class of a candidate group is read again.
    chosen = sized(groups.join(classes.select("same", "id", "print"), groups["node"] == classes["same"]).select("root", "same", F.col("id").alias("__id"), F.col("print").alias("__print")), "chosen")
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("print"))
    texts = texts.join(chosen, (texts["id"] == chosen["__id"]) & (texts["print"] == chosen["__print"])).select("root", "same", "text")
    return roots(texts.groupBy("root").applyInArrow(confirm, "a binary, b binary"))


def keep_one(df: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the least id (then of the least hash of the text); rows with a null id stay as they are.

    Near-duplicates are those that steps between texts of `least` or more reach. Null and wordless texts are
    near-duplicates of each other. Different texts under one id are documents of their own; of rows equal in id and text
    one stays, whose columns hash least. An empty table gives an empty one.
    """
    rows = signed(df, words, id_col, text_col)
    roots = near_classes(rows, df, words, least, id_col, text_col)
    grouped = rows.select("id", "print", "same").join(roots, rows["same"] == roots["node"], "left").select("id", "print", F.coalesce("root", "same").alias("group"))
    grouped = staged(grouped.groupBy("id", "print", "group").agg(F.count(F.lit(1)).alias("n")), "grouped")
    best = grouped.groupBy("group").agg(F.min(F.struct("id", "print")).alias("best"), F.count(F.lit(1)).alias("members"))
    # What goes is listed, not what stays: texts are only shuffled if the list is too long to be broadcast.
    some = best.where("members > 1").select("group", "best")
    gone = grouped.join(some, "group").where(F.struct("id", "print") != F.col("best")).select(F.col("id").alias("__cairn_id"), F.col("print").alias("__cairn_print"))
    gone = sized(gone, "gone")
    mine = (df[id_col] == F.col("__cairn_id")) & (F.xxhash64(df[text_col]) == F.col("__cairn_print"))
    kept = df.join(gone, mine, "left_anti")
    twice = sized(grouped.where("n > 1").select(F.col("id").alias("__cairn_id"), F.col("print").alias("__cairn_print")), "twice")
    if twice.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    again = kept.join(twice, mine, "left_semi").groupBy(F.col(f"`{id_col}`").alias("__cairn_id"), F.xxhash64(f"`{text_col}`").alias("__cairn_print"))
    one = again.agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("__cairn_row")).select("__cairn_row.*")
    return kept.join(twice, mine, "left_anti").unionByName(one)
