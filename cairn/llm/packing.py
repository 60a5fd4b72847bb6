"""Best-fit packing of token pieces into fixed-length sequences, after Martello-Toth dominance reduction.

A document is cut into pieces of at most `capacity` tokens; all but the first are full and are a sequence
by themselves. What is left to pack is described completely by how many pieces there are of each length,
at most capacity - 1 numbers however large the corpus is. The driver solves that instance exactly as a
best-fit-decreasing run over all pieces would, in kinds of equal sequences rather than single ones, so the
plan stays a few thousand rows. Each piece then finds its place by its rank among the pieces of its length;
ranks come from salted groups, so a length that a third of the corpus shares is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..tables import staged
from .bpe import coder
from .common import balanced

#: Rows of one rank group, about; a length with more pieces has more groups, not larger ones.
GROUP_ROWS = 512


@dataclass
class Kind:
    """`times` equal sequences, each holding `parts`: (length, how many), longest first."""

    parts: tuple[tuple[int, int], ...]
    times: int


def dominance(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Fix sets that dominate every other feasible set with the same piece, and take them from `counts`.

    For a piece x let y be the longest other piece that fits with it. {x} dominates if none fits. {x, y}
    dominates if every other set of pieces that fits beside x could take the place of y: that holds if the
    largest sum at most capacity - x that pieces can reach is y (a perfect fit is such a case), and if the
    two shortest others are too long to go together. Each step uses up a length, so there are few steps.
    """
    fixed: list[Kind] = []
    changed = True
    while changed:
        changed = False
        reach = _reachable(counts, capacity)
        for x in range(capacity, 0, -1):
            while counts[x]:
                counts[x] -= 1
                others = np.flatnonzero(counts[: capacity - x + 1])
                if not len(others):
                    fixed.append(Kind(((x, 1),), int(counts[x]) + 1))
                    counts[x] = 0
                    changed = True
                    break
                y, least = int(others[-1]), int(others[0])
                second = least if counts[least] > 1 else int(others[1]) if len(others) > 1 else capacity + 1
                mask = (1 << (capacity - x + 1)) - 1
                if (reach & mask).bit_length() - 1 > y and least + second <= capacity - x:
                    counts[x] += 1
                    break
                counts[x] += 1
                if x == y:
                    times = int(counts[x]) // 2
                    fixed.append(Kind(((x, 2),), times))
                else:
                    times = int(min(counts[x], counts[y]))
                    fixed.append(Kind(((max(x, y), 1), (min(x, y), 1)), times))
                counts[x] -= times
                counts[y] -= times
                changed = True
    return fixed


def _reachable(counts: np.ndarray, capacity: int) -> int:
    """Bit s is set if pieces of lengths in use, each as often as wanted, can sum to s; a superset of what counts allow."""
    reach, full = 1, (1 << (capacity + 1)) - 1
    for s in np.flatnonzero(counts).tolist():
        shift = s
        while shift <= capacity:
            reach |= (reach << shift) & full
            shift *= 2
    return reach


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Best-fit decreasing over counts: equal sequences are handled together."""
    open_kinds: dict[int, list[Kind]] = {}
    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            room = min((r for r, kinds in open_kinds.items() if r >= s and kinds), default=None)
            if room is None:
                room, kind = capacity, Kind((), left)
            else:
                kind = open_kinds[room].pop()
            each = room // s
            whole = min(kind.times, left // each)
            if whole:
                open_kinds.setdefault(room - each * s, []).append(Kind((*kind.parts, (s, each)), whole))
                left -= whole * each
            rest = kind.times - whole
            if rest and 0 < left < each:
                open_kinds.setdefault(room - left * s, []).append(Kind((*kind.parts, (s, left)), 1))
                left, rest = 0, rest - 1
            if rest and kind.parts:
                open_kinds.setdefault(room, []).append(Kind(kind.parts, rest))
    return [k for kinds in open_kinds.values() for k in kinds]


def plan(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Kinds of sequences for `counts` pieces of each length below capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    return dominance(left, capacity) + best_fit(left, capacity)


def slots(kinds: list[Kind], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of it in a sequence, first sequence, offset), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for kind in kinds:
        offset = 0
        for s, each in kind.parts:
            out.setdefault(s, []).append((used.get(s, 0), each, sequence, offset))
            used[s] = used.get(s, 0) + each * kind.times
            offset += each * s
        sequence += kind.times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def tokenized(df: DataFrame, tokenizer_file: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_ids, crcs array<long> (of each piece's little-endian 32-bit ids); no ids leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        bpe = coder(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        for batch in balanced(batches, 1):
            n, crcs = [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                raw = ids.astype("<u4").tobytes() + end
                n.append(len(ids) + 1)
                first = len(raw) % (4 * capacity)
                cuts = [0, *range(first or 4 * capacity, len(raw) + 1, 4 * capacity)]
                crcs.append([crc32(raw[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "n_ids", "crcs"])

    kind = df.select(id_col).dtypes[0][1]
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_ids long, crcs array<long>")


def pack(df: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Ids may be null or repeat: each row is packed
    as a document of its own, and rows equal in everything are interchangeable. Other columns are not
    read. An empty table gives an empty one. sequence_id is negative for a piece that fills a sequence.
    """
    # Rows have numbers of their own once they are written: equal rows spread over the rank groups like any others.
    items = staged(tokenized(df, tokenizer_file, end_id, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    items = items.withColumn("rest", (F.col("n_ids") % capacity).cast("int"))
    # At most `capacity` rows, whatever the corpus holds.
    counts = {r["rest"]: r["count"] for r in items.groupBy("rest").count().collect()}
    groups = F.array(*[F.lit(max(1, -(-counts.get(s, 0) // GROUP_ROWS))) for s in range(capacity)])
    items = items.withColumn("salt", F.pmod(F.xxhash64("row"), F.element_at(groups, F.col("rest") + 1)).cast("int"))
    sizes = items.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    counts.pop(0, None)
    places = slots(plan(counts, capacity), capacity)
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("rest", "salt").orderBy("row")))
    ranked = ranked.join(before.select("rest", "salt", "before"), ["rest", "salt"]).withColumn("rank", F.col("rank") - 1 + F.coalesce("before", F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            sequence, offset = np.full(len(rest), -1, np.int64), np.zeros(len(rest), np.int64)
            order = np.argsort(rest, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(rest[order])) + 1):
                if len(part) and rest[part[0]]:
                    table = places[int(rest[part[0]])]
                    row = table[np.searchsorted(table[:, 0], rank[part], "right") - 1]
                    within = rank[part] - row[:, 0]
                    sequence[part] = row[:, 2] + within // row[:, 1]
                    offset[part] = row[:, 3] + within % row[:, 1] * rest[part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], ["rest", "rank", "id", "n_ids", "crcs", "sequence", "offset"])

    kind = items.select("id").dtypes[0][1]
    placed = ranked.select("rest", "rank", "id", "n_ids", "crcs").mapInArrow(place, f"rest int, rank long, id {kind}, n_ids long, crcs array<long>, sequence long, offset long")
    pieces = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = (F.col("piece") == 0) & (F.col("rest") > 0)
    shift = F.when(F.col("rest") > 0, F.col("rest") - capacity).otherwise(0)
    return pieces.select(
        F.col("id").alias(id_col),
        "piece",
        F.when(head, 0).otherwise(shift + F.col("piece").cast("long") * capacity).cast("long").alias("start"),
        F.when(head, F.col("rest")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        # A full piece has a sequence of its own: (length class, rank, piece) is unique, 2^21 pieces hold any Spark string.
        F.when(head, F.col("sequence")).otherwise(-1 - ((F.col("rank") * capacity + F.col("rest")) * (1 << 21) + F.col("piece"))).alias("sequence_id"),
        F.when(head, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )
