"""Language-model scores through weighted backoff automata whose counts come from the whole corpus.

Texts travel in bundles of a few megabytes. A bundle sends the hashes of its different n-grams, with how often its
training texts hold them, to shards by ranges of the hashes; a shard adds up what all bundles sent and answers each one.
So a frequent n-gram is one entry of a bundle, no count is pruned, and what is gathered grows with the corpus.

With the answers a bundle has its automaton. A state is an n-gram of less than `order` tokens that training knows; an
arc carries log10 P(token | state) of an n-gram that training knows; the failure arc of a state drops its
first token at a weight. The probability of a token after a state h of k tokens is

    P(w | h) = (c(hw) + m P(w | h without its first)) / (c(h) + m)

which sums to one whatever m is. m = scale * c(h) ** power grows with the count of the state as the number of different
tokens after it does, so a frequent state does not rule out new ones. Below all is (c(w) + 0.5) / (N + 0.5 (V + 1)), one of
which is for unknown tokens. For an n-gram that training does not know, P is m / (c(h) + m), the failure weight, times
the probability below.
Each text is read once from left to right; the state is all that is carried on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..tables import staged
from .common import balanced

#: Bytes of text of a bundle, about; a longer text is cut at white space into pieces.
BUNDLE = 4 << 20
#: Bytes of text whose n-grams one shard counts, about.
SHARD = 16 << 20
#: Bits of the hash of an n-gram of several tokens beyond log2 of their number: one of them shares its hash with a chance of 2^-24. Single tokens have 64.
SPARE_BITS = 24
#: Scale and power of m after one token, after two, and so on.
STRENGTH = ((4.0, 0.8), (2.0, 0.9))
BEGIN, END = b"\n<begin>", b"\n<end>"  # no word holds white space


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = made = xxh64_intdigest(word)
        return made


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers, small ones in few bytes: byte planes through zstd."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def tokens(text: bytes) -> list[bytes]:
    # bytes.lower() changes A-Z alone; bytes.split() splits at bytes 32 and 9 to 13 alone.
    return text.lower().split()


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """Pieces of about `most` bytes of a text, cut in front of white space; a longer token stays whole."""
    at = 0
    while len(text) - at > most:
        end = at + most
        stops = [p for c in b" \t\n\v\f\r" if (p := text.find(bytes([c]), end, end + (1 << 16))) >= 0] or [p for c in b" \t\n\v\f\r" if (p := text.find(bytes([c]), end)) >= 0]
        if not stops:
            break
        yield text[at : min(stops)]
        at = min(stops)
    yield text[at:]


class Bundle:
    """Pieces of texts as tables of an Arrow stream: id, learn, body, before (tokens that precede it), starts, ends, whole (of one text)."""

    @staticmethod
    def made(rows: list[tuple], kind: pa.DataType) -> bytes:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], kind), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.binary())), pa.array(columns[4], pa.bool_()), pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.int64())]
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(arrays, ["id", "learn", "body", "before", "starts", "ends", "whole"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return zstandard.compress(sink.getvalue().to_pybytes(), 6)

    def __init__(self, body: bytes, order: int, bits: int):
        self.rows = pa.ipc.open_stream(zstandard.decompress(body)).read_all()
        hashes = _Hashes()
        known, self.first, self.start = [], [], []
        for text, before, ends in zip(*(self.rows.column(c).to_pylist() for c in ("body", "before", "ends")), strict=True):
            words = [*before, *tokens(text)]
            if ends:
                words.append(END)
            self.start.append(len(known))
            self.first.append(len(known) + len(before))  # tokens before it are context, counted elsewhere
            known += map(hashes.__getitem__, words)
        self.start.append(len(known))
        self.token = np.array(known, np.uint64)
        size = np.diff(self.start)
        depth = np.arange(len(known)) - np.repeat(self.start[:-1], size)
        own = np.arange(len(known)) >= np.repeat(np.array(self.first, np.int64), size)
        # The begin of a text is counted too, as it is the context of the first token.
        begin = (depth == 0) & np.repeat(self.rows.column("starts").to_numpy(), size)
        learns = np.repeat(self.rows.column("learn").to_numpy(), size)
        #: By k - 1: the different hashes of k-grams in order, how often training texts here hold each, the place of each position's, -1 without one.
        self.keys, self.counts, self.gram = [], [], []
        hash_k = self.token
        for k in range(1, order + 1):
            if k > 1:
                hash_k = mixed(np.concatenate([hash_k[:1], hash_k[:-1]]), self.token)
            key = hash_k if k == 1 else hash_k >> np.uint64(64 - bits)
            there = np.flatnonzero(depth >= k - 1)
            found, place = np.unique(key[there], return_inverse=True)
            gram = np.full(len(key), -1, np.int64)
            gram[there] = place
            counted = learns & (own | begin if k == 1 else own) & (gram >= 0)
            self.keys.append(found)
            self.counts.append(np.bincount(gram[counted], minlength=len(found)))
            self.gram.append(gram)
        self.begin = hashes[BEGIN]


def _strength(count: np.ndarray, of: tuple[float, float]) -> np.ndarray:
    return of[0] * np.maximum(count, 1) ** of[1]


class Automaton:
    """The part of the model that a bundle's texts can reach.

    States and arcs are named by the n-grams of the bundle. arc[k][g] is the weight of the arc that completes g, of k + 1
    tokens, from the state of its first k; nan where training doesn't know g. The state g of k tokens fails to g without
    its first token at fall[k - 1][g]. `base` is log10 of the base probability of each token.
    """

    def __init__(self, bundle: Bundle, totals: list[np.ndarray], n: int, v: int, strength: tuple[tuple[float, float], ...]):
        self.bundle, self.order = bundle, len(totals)
        self.arc: list[np.ndarray] = []
        self.fall: list[np.ndarray] = []
        self.unknown = math.log10(0.5 / (n + 0.5 * (v + 1)))
        lower = (totals[0] + 0.5) / (n + 0.5 * (v + 1))
        self.base = np.log10(lower)
        for k, total in enumerate(totals):
            if k:
                # A position that shows each n-gram gives those without its last and without its first token.
                place = bundle.gram[k]
                there = np.flatnonzero(place >= 0)
                at = np.zeros(len(total), np.int64)
                at[place[there]] = there
                count = totals[k - 1][bundle.gram[k - 1][at - 1]]
                m = _strength(count, strength[k - 1])
                lower = (total + m * lower[bundle.gram[k - 1][at]]) / (count + m)
            self.arc.append(np.append(np.where(total > 0, np.log10(lower), np.nan), np.nan))  # the last is for places without an n-gram
            if k + 1 < self.order:
                m = _strength(total, strength[k])
                self.fall.append(np.append(np.log10(m / (total + m)), 0.0))
        begin = np.searchsorted(bundle.keys[0], np.uint64(bundle.begin))
        self.begins = self.order > 1 and bool(begin < len(totals[0]) and bundle.keys[0][begin] == np.uint64(bundle.begin) and totals[0][begin] > 0)

    def read(self, start: int, first: int, end: int) -> float:
        """log10 of the probability of the tokens at `first` to `end` of the bundle; those from `start` on only lead to the state before."""
        bundle, order, top, unknown = self.bundle, self.order, self.order - 1, self.unknown
        # For each place the weights of arcs after 0, 1, .. tokens, then the falls of the states of 1, 2, .. tokens that end there.
        columns = [table[bundle.gram[k][start:end]].tolist() for k, table in [*enumerate(self.arc), *enumerate(self.fall)]]
        total, depth, row, lead = 0.0, 0, (), first - start
        for at, now in enumerate(zip(*columns, strict=True)):
            if at == lead:
                total = 0.0
            if at == 0 and lead and bundle.token[start] == np.uint64(bundle.begin):
                depth, row = int(self.begins), now  # begin is a state, never a token
                continue
            arc = now[depth]
            while depth and arc != arc:
                total += row[order + depth - 1]
                depth -= 1
                arc = now[depth]
            if arc == arc:
                total += arc
                depth = depth + 1 if depth < top else depth
            else:
                total += unknown
            row = now
        return total


def bundles(df: DataFrame, learn, order: int, id_col: str, text_col: str) -> DataFrame:
    """(block, size, body): texts in bundles of about BUNDLE bytes, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows, size, number, whole = [], 0, 0, 0

        def full() -> pa.RecordBatch:
            nonlocal rows, size, number
            body = Bundle.made(rows, id_type)
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([size], pa.int64()), pa.array([body], pa.binary())], ["block", "size", "body"])
            rows, size, number = [], 0, number + 1
            return out

        for batch in balanced(batches, 2):
            id_type = batch.schema.field(0).type
            for who, ok, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces, before = [*cut((text or "").encode(), BUNDLE)], [BEGIN]
                for i, piece in enumerate(pieces):
                    rows.append((who, ok, piece, before, i == 0, i == len(pieces) - 1, (part << 32) + whole))
                    size += len(piece) + 16
                    if len(pieces) > 1:
                        before = [*before, *tokens(piece)][-(order - 1) :] if order > 1 else []
                    if size >= BUNDLE:
                        yield full()
                whole += 1
        if rows:
            yield full()

    return staged(df.select(df[id_col].alias("id"), learn.alias("learn"), df[text_col].alias("text")).mapInArrow(run, "block long, size long, body binary"), "bundles")


def answers(table: DataFrame, order: int, bits: int, shards: int) -> DataFrame:
    """(block, k, shard, totals, n, v): how often training holds the n-grams that each bundle asked for, in the order of
    their hashes. Rows of a null block have n and v instead: all and different tokens of a shard, begins left out."""
    step = [(1 << (64 if k == 1 else bits)) / shards for k in range(1, order + 1)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bundle = Bundle(body, order, bits)
                out: list[tuple] = []
                for k in range(1, order + 1):
                    key, count = bundle.keys[k - 1], bundle.counts[k - 1]
                    edges = np.searchsorted(key, np.array([min(int(s * step[k - 1]), (1 << 64) - 1) for s in range(1, shards)], np.uint64))
                    for s, (a, z) in enumerate(zip([0, *edges], [*edges, len(key)], strict=True)):
                        if z > a:
                            out.append((k, s, block, packed(np.diff(key[a:z], prepend=np.uint64(0))), packed(count[a:z])))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], ["k", "shard", "block", "keys", "counts"])

    begin = np.uint64(_Hashes()[BEGIN])

    def add(asked: pa.Table) -> pa.Table:
        k, shard = asked.column("k")[0].as_py(), asked.column("shard")[0].as_py()
        keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in asked.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in asked.column("counts").to_pylist()]).astype(np.int64)
        ends = np.cumsum([len(x) for x in keys])
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, counts)
        told = total[place]
        own = total[found != begin] if k == 1 else total[:0]
        blocks = asked.column("block").to_pylist()
        return pa.table({
            "block": pa.array([*blocks, None], pa.int64()), "k": pa.array([k] * (len(blocks) + 1), pa.int32()), "shard": pa.array([shard] * (len(blocks) + 1), pa.int32()),
            "totals": pa.array([*(packed(told[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)), None], pa.binary()),
            "n": pa.array([None] * len(blocks) + [int(own.sum())], pa.int64()), "v": pa.array([None] * len(blocks) + [int((own > 0).sum())], pa.int64()),
        })

    asked = table.select("block", "body").mapInArrow(ask, "k int, shard int, block long, keys binary, counts binary")
    return staged(asked.groupBy("k", "shard").applyInArrow(add, "block long, k int, shard int, totals binary, n long, v long"), "answers")


def score(df: DataFrame, learn, order: int = 3, strength: tuple[tuple[float, float], ...] = STRENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `df`: id, learned, n_tokens, n_known, train_tokens, base_score, score; learning from rows where `learn` holds.

    Tokens are words of bytes other than 32 and 9 to 13, A-Z in lower case, then one end; a null text is empty, which is
    one token. A null `learn` is no. n_known counts tokens that training holds, train_tokens is N. base_score is log10 of the
    text's probability by single tokens, score by the automaton; without training texts every token is unknown, with
    probability one. Ids may be null or repeat, each row is scored by itself; other columns are not read. An empty table
    gives an empty one. Long texts are cut and added up again; a single token of many megabytes stays whole.
    """
    if len(strength) < order - 1:
        raise ValueError(f"order {order} needs {order - 1} strengths")
    kind = df.select(id_col).dtypes[0][1]
    table = bundles(df, F.coalesce(learn, F.lit(False)), order, id_col, text_col)
    size = table.agg(F.sum("size")).first()[0] or 0
    bits = min(64, math.ceil(math.log2(max(2, size))) + SPARE_BITS)
    shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    told = answers(table, order, bits, shards)
    row = told.where("block IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = row["n"] or 0, row["v"] or 0

    def run(text: pa.Table, counts: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for body in text.column("body").to_pylist():
            bundle = Bundle(body, order, bits)
            got = sorted(zip(counts.column("k").to_pylist(), counts.column("shard").to_pylist(), counts.column("totals").to_pylist(), strict=True))
            totals = [np.concatenate([unpacked(x) for j, _, x in got if j == k] or [np.zeros(0, np.uint64)]).astype(np.int64) for k in range(1, order + 1)]
            auto = Automaton(bundle, totals, n, v, strength)
            word, known = bundle.gram[0], totals[0] > 0
            for a, first, z in zip(bundle.start, bundle.first, bundle.start[1:], strict=False):
                own = word[first:z]
                out.append((len(own), int(known[own].sum()), float(auto.base[own].sum()), auto.read(a, first, z)))
            columns = list(zip(*out, strict=True))
            return pa.table({
                "id": bundle.rows.column("id"), "whole": bundle.rows.column("whole"), "learned": bundle.rows.column("learn"), "n_tokens": pa.array(columns[0], pa.int64()),
                "n_known": pa.array(columns[1], pa.int64()), "base_score": pa.array(columns[2], pa.float64()), "score": pa.array(columns[3], pa.float64()),
            })

    made = table.select("block", "body").groupBy("block").cogroup(told.where("block IS NOT NULL").select("block", "k", "shard", "totals").groupBy("block")).applyInArrow(
        run, f"id {kind}, whole long, learned boolean, n_tokens long, n_known long, base_score double, score double"
    )
    added = made.groupBy("whole").agg(F.first("id").alias("id"), F.first("learned").alias("learned"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return added.select(F.col("id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def score_corpus(documents: DataFrame) -> DataFrame:
    """score() of `documents`, learning from those whose crc32 of the decimal doc_id mod 5 is not 1; those of a null id are learned from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score(documents, ~held).select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
