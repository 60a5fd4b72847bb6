"""Byte-level BPE encoding and decoding with arrays instead of regular expressions.

Pre-tokenisation. Every code point gets a class (letter, number, white space, space, other) and, with
one or two code points of look-ahead, a symbol. A symbol is a function on the states of a small
automaton; composing such functions is associative, and the functions that symbols generate are few,
so they are numbered and composed by table. A blocked scan over a whole batch of texts gives the state
before each code point, hence where each pre-token begins.

Pair merging. Pre-tokens of up to 23 bytes are exact three-word keys of an open-addressing table that
remembers their ids; those not yet known are merged together, one merge for each word and round, in
matrices. Longer ones are kept in a dictionary.

Decoding concatenates token bytes; the byte offset at which each token begins is kept.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import balanced

U64 = np.uint64
#: Code points handled at once, which bounds the memory of a worker; longer texts are cut at safe boundaries.
PORTION = 1 << 19
#: Pre-tokens looked up at once: far fewer than the table holds, so one call cannot fill it.
LOOKUPS = 1 << 18
#: States: runs of letters, numbers, others, white space; a space that opens the next token; 1 or 2
#: letters left of a contraction; between tokens.
LETTER, NUMBER, OTHER, WHITES, SPACE, LEFT1, LEFT2, FREE = range(8)
#: Symbols: letter, number, other, apostrophe of a contraction with 1 or 2 letters, white space before more
#: white space or the end, the last white space before something visible if not a space, or if a space.
SYM_L, SYM_N, SYM_O, SYM_A1, SYM_A2, SYM_W, SYM_WLAST, SYM_SLAST = range(8)
#: Contractions of the public pattern, fixed values.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a token begins with it."""
    if symbol == SYM_L and state in (LEFT1, LEFT2):
        return (FREE if state == LEFT1 else LEFT1), False
    if symbol in (SYM_L, SYM_N, SYM_O):
        run = (LETTER, NUMBER, OTHER)[symbol]
        return run, state not in (run, SPACE)
    if symbol in (SYM_A1, SYM_A2):
        if state in (OTHER, SPACE):
            return OTHER, False
        return (LEFT1 if symbol == SYM_A1 else LEFT2), True
    if symbol == SYM_W:
        return WHITES, state != WHITES
    return (FREE if symbol == SYM_WLAST else SPACE), True


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, functions (number, state) -> state, and begins (symbol, state) -> boolean.

    Symbols 8 to 15 are those at the first code point of a text: they act as from FREE. 16 is the identity.
    """
    maps = [tuple(_step(s, q)[0] for q in range(8)) for s in range(8)]
    maps += [(_step(s, FREE)[0],) * 8 for s in range(8)] + [tuple(range(8))]
    begins = np.array([[_step(s, q)[1] for q in range(8)] for s in range(8)] + [[True] * 8] * 8 + [[False] * 8])
    known = {m: i for i, m in reversed(list(enumerate(maps)))}
    elements = list(maps)
    rows: list[list[int]] = []
    at = 0
    while at < len(elements):
        for g in maps:
            new = tuple(g[x] for x in elements[at])
            if new not in known:
                known[new] = len(elements)
                elements.append(new)
        at += 1
    for f in elements:
        rows.append([known[tuple(g[x] for x in f)] for g in elements])
    return np.array(rows, np.uint8).ravel(), np.array(elements, np.uint8).ravel(), begins.ravel()


@lru_cache(maxsize=2)
def classes(library: str) -> np.ndarray:
    """The symbol of each code point by itself: letter, number, white space or other.

    The library (tiktoken or tokenizers) is asked for each, once a worker: its Unicode version is not the interpreter's.
    """
    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = codes.astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, SYM_O, np.uint8)
    for kind, symbol in ((r"\p{L}", SYM_L), (r"\p{N}", SYM_N), (r"\s", SYM_W)):
        of = np.zeros(0x110000, bool)
        if library == "tiktoken":
            import tiktoken

            # What no match of the pattern covers has no token.
            found = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
            of[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = True
        else:
            from tokenizers import Regex, normalizers

            # What is left when the class is removed does not belong to it; short strings, as long ones cost far more.
            remove = normalizers.Replace(Regex(kind + "+"), "").normalize_str
            of[codes] = True
            of[np.frombuffer("".join([remove(every[at : at + 4096]) for at in range(0, len(every), 4096)]).encode("utf-32-le"), np.uint32)] = False
        table[of] = symbol
    return table


def scan(symbols: np.ndarray, width: int = 128) -> np.ndarray:
    """The state before each symbol: a blocked prefix scan of transition functions under composition."""
    compose, apply, _ = _machine()
    n = int(len(apply) // 8)
    rows = -(-len(symbols) // width)
    grid = np.full(rows * width, 16, np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    prefix = np.empty_like(grid)  # function of what precedes a symbol within its block
    total = np.full(rows, 16, np.int64)
    for k in range(width):
        prefix[k] = total
        total = compose[total * n + grid[k]].astype(np.int64)
    if rows <= 64:
        carry, state = np.empty(rows, np.uint8), FREE
        for b in range(rows):
            carry[b] = state
            state = apply[total[b] * 8 + state]
    else:
        carry = _scan_blocks(total, n)
    return apply[prefix.astype(np.int64) * 8 + carry].T.ravel()[: len(symbols)]


def _scan_blocks(total: np.ndarray, n: int, width: int = 64) -> np.ndarray:
    """The state at the beginning of each block, by the same scan over the blocks' functions."""
    compose, apply, _ = _machine()
    rows = -(-len(total) // width)
    grid = np.full(rows * width, 16, np.int64)
    grid[: len(total)] = total
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    prefix = np.empty_like(grid)
    whole = np.full(rows, 16, np.int64)
    for k in range(width):
        prefix[k] = whole
        whole = compose[whole * n + grid[k]].astype(np.int64)
    carry, state = np.empty(rows, np.int64), FREE
    for b in range(rows):
        carry[b] = state
        state = apply[whole[b] * 8 + state]
    return apply[prefix * 8 + carry].T.ravel()[: len(total)]


def pre_tokens(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions at which tokens begin, in the code points of texts laid end to end; `first`: where texts begin; `table`: classes()."""
    if not len(codes):
        return np.empty(0, np.int64)
    symbols = table[codes]
    ends = np.zeros(len(codes) + 2, bool)  # is there no more of the text from here on
    ends[first] = True
    ends[len(codes) :] = True
    white = symbols == SYM_W
    last = white & ~ends[1:-1]
    last[:-1] &= ~white[1:]
    symbols[last] = SYM_WLAST
    symbols[last & (codes == 32)] = SYM_SLAST
    quote = np.flatnonzero(codes == 39)
    quote = quote[~ends[quote + 1]]
    a, b = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
    short = np.isin(a, [ord(c) for c in SHORT])
    long = ~ends[quote + 2] & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in LONG])
    symbols[quote[short]] = SYM_A1
    symbols[quote[long]] = SYM_A2
    symbols[first] += 8
    return np.flatnonzero(_machine()[2][symbols.astype(np.int64) * 8 + scan(symbols)])


def pieces(text: str, most: int, table: np.ndarray) -> Iterator[str]:
    """A long text in pieces of about `most` code points, cut where tokens begin that follow something visible.

    What is left of such a place ends there whatever follows, and no token depends on what is left of its begin. A
    begin is certain if the two code points after it were seen. A single longer token makes a longer piece.
    """
    at = 0
    while len(text) - at > most:
        size, cut = most, np.empty(0, np.int64)
        while not len(cut) and at + size < len(text):
            codes = np.frombuffer(text[at : at + size].encode("utf-32-le"), np.uint32)
            cut = pre_tokens(codes, np.zeros(1, np.int64), table)
            cut = cut[(cut > 0) & (cut + 2 < len(codes))]
            cut = cut[table[codes[cut - 1]] != SYM_W]
            size *= 2
        if not len(cut):
            break
        yield text[at : at + int(cut[-1])]
        at += int(cut[-1])
    yield text[at:]


def _mix(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of three-word keys."""
    with np.errstate(over="ignore"):
        h = (lo ^ (mid * U64(0x9E3779B97F4A7C15)) ^ (hi * U64(0xC2B2AE3D27D4EB4F))) * U64(0xFF51AFD7ED558CCD)
        return (h ^ (h >> U64(32))) * U64(0xC4CEB9FE1A85EC53)


class PairTable:
    """Pairs of token ids -> (rank, merged id), by open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, np.iinfo(np.int32).max, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            slots, who = np.unique(at[todo[free]], return_index=True)
            won = todo[free][who]
            self.keys[slots], self.rank[slots], self.made[slots] = keys[won], values[won, 0], values[won, 1]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; rank[slot] is the largest int32 for a pair that does not merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._slot(keys)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return at


class Spans(NamedTuple):
    """Pre-tokens of texts laid end to end: UTF-8 bytes (buf with 24 spare ones), begin and length of each, and the first of each text."""

    raw: bytes
    buf: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text_token: np.ndarray


class PreTokens:
    """An open-addressing table of pre-tokens of up to SHORT bytes; what is stored for each is up to a subclass."""

    TABLE_BITS, SHORT = 20, 23
    #: The table is emptied beyond this many entries, two thirds of its slots.
    MOST = 700_000

    def __init__(self, library: str):
        self.classes = classes(library)
        self._reset()

    def _reset(self) -> None:
        n = 1 << self.TABLE_BITS
        self.lo, self.mid, self.hi = np.zeros(n, U64), np.zeros(n, U64), np.zeros(n, U64)
        self.at, self.num = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.held = 0

    def spans(self, texts: list[str]) -> Spans:
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_first = np.cumsum(sizes) - sizes
        begin = pre_tokens(codes, text_first[sizes > 0], self.classes)
        raw = joined.encode()
        buf = np.zeros(len(raw) + 24, np.uint8)
        buf[: len(raw)] = np.frombuffer(raw, np.uint8)
        start = begin if len(raw) == len(codes) else np.flatnonzero((buf[: len(raw)] & 0xC0) != 0x80)[begin]
        return Spans(raw, buf, start, np.diff(start, append=len(raw)), np.searchsorted(begin, np.concatenate([text_first, [len(codes)]])))

    def lookup(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where what is known of each short pre-token is stored, and its number of ids."""
        if self.held > self.MOST:
            self._reset()
        words = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
        keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
        lo = words[start] & keep[np.minimum(length, 8)]
        mid = words[start + 8] & keep[np.clip(length - 8, 0, 8)]
        hi = words[start + 16] & keep[np.clip(length - 16, 0, 7)] | length.astype(U64) << U64(56)
        slot = (_mix(lo, mid, hi) >> U64(64 - self.TABLE_BITS)).astype(np.int64)
        wrap = (1 << self.TABLE_BITS) - 1
        todo = np.arange(len(slot))
        missing = []
        while len(todo):
            s = slot[todo]
            same = (self.lo[s] == lo[todo]) & (self.hi[s] == hi[todo]) & (self.mid[s] == mid[todo])
            free = self.hi[s] == 0
            missing.append(todo[free])
            todo = todo[~same & ~free]
            slot[todo] = (slot[todo] + 1) & wrap
        miss = np.concatenate(missing) if missing else np.empty(0, np.int64)
        if len(miss):
            keys = np.empty(len(miss), [("hi", "<u8"), ("lo", "<u8"), ("mid", "<u8")])
            keys["hi"], keys["lo"], keys["mid"] = hi[miss], lo[miss], mid[miss]
            order = np.lexsort((mid[miss], lo[miss], hi[miss]))  # by length first
            ranked = keys[order]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            group = np.cumsum(new) - 1
            one = miss[order[new]]
            at, num = self._merge_new(buf, start[one], length[one])
            home = self._insert(lo[one], mid[one], hi[one], at, num)
            slot[miss[order]] = home[group]
        return self.at[slot], self.num[slot]

    def _insert(self, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, at: np.ndarray, num: np.ndarray) -> np.ndarray:
        slot = (_mix(lo, mid, hi) >> U64(64 - self.TABLE_BITS)).astype(np.int64)
        todo = np.arange(len(slot))
        self.held += len(slot)
        while len(todo):
            free = todo[self.hi[slot[todo]] == 0]
            s, who = np.unique(slot[free], return_index=True)
            won = free[who]
            self.lo[s], self.mid[s], self.hi[s], self.at[s], self.num[s] = lo[won], mid[won], hi[won], at[won], num[won]
            placed = np.zeros(len(slot), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.TABLE_BITS) - 1)
        return slot


class ByteBPE(PreTokens):
    """An encoder and decoder from a public vocabulary: a tiktoken rank file or a tokenizers JSON file."""

    MEMO_LONG = 20_000

    def __init__(self, path: str):
        self.special: dict[str, int] = {}
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            plain = byte_alphabet()
            self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
            token = {v: bytes(plain[c] for c in k) for k, v in vocab.items()}
            merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
            pairs = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
            token = {v: k for k, v in ranks.items()}
            pairs = {}
            for whole, rank in ranks.items():
                for cut in range(1, len(whole)):
                    a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                    if a is not None and b is not None:
                        pairs[a, b] = (rank, rank)
        self.pairs = PairTable(pairs)
        self.pair_dict = pairs
        token |= {v: k.encode() for k, v in self.special.items()}
        size = max(token) + 1
        self.token_bytes = [token.get(i, b"") for i in range(size)]
        self.token_len = np.array([len(t) for t in self.token_bytes], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_buf = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        single = {t: i for i, t in token.items() if len(t) == 1}
        self.byte_id = np.array([single[bytes([b])] for b in range(256)], np.int32)
        super().__init__("tokenizers" if path.endswith(".json") else "tiktoken")

    def _reset(self) -> None:
        super()._reset()
        self.store, self.used = np.zeros(1 << 20, np.int32), 0
        self.long: dict[bytes, np.ndarray] = {}

    # Merging

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one pre-token of any length: a heap of pairs over a linked list, O(n log n)."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pair_dict
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if p := pairs.get((ids[i], ids[right[i]])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[right[i]]))
            if left[i] >= 0 and (p := pairs.get((ids[left[i]], ids[i]))):
                heapq.heappush(heap, (p[0], left[i], ids[left[i]], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_many(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens: words is (n, width) of bytes. The lowest, then leftmost, pair of each merges in each round."""
        ids = self.byte_id[words]
        n, width = ids.shape
        length = length.copy()
        if width < 2:
            return ids, length
        none = np.iinfo(np.int32).max
        rank = self.pairs.rank[self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())].reshape(n, width - 1)
        rank[np.arange(width - 1)[None, :] >= (length - 1)[:, None]] = none
        rank = np.concatenate([rank, np.full((n, 1), none, np.int32)], axis=1)
        out, live, column = ids.copy(), np.arange(n), np.arange(width)[None, :]
        while len(live):
            where = rank.argmin(axis=1)
            row = np.arange(len(live))
            more = rank[row, where] < none
            if not more.all():
                out[live[~more]] = ids[~more]
                live, ids, rank, where = live[more], ids[more], rank[more], where[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            made = self.pairs.made[self.pairs.find(ids[row, where], ids[row, where + 1])]
            shift = column > where[:, None]
            source = np.minimum(column + shift, width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[row, where] = made
            rank = np.take_along_axis(rank, source, 1)
            rank[:, -1] = none
            length[live] -= 1
            n_now = length[live]
            for p, ok in ((where - 1, where > 0), (where, where + 1 < n_now)):
                p, r = np.where(ok, p, 0), row
                new = self.pairs.rank[self.pairs.find(ids[r, p], ids[r, p + 1])]
                rank[r[ok], p[ok]] = new[ok]
            rank[row, n_now - 1] = none
        return out, length

    # Encoding

    def _merge_new(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge distinct pre-tokens, sorted by length, and store their ids."""
        at, num = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        begin = 0
        for top in (2, 4, 6, 8, 10, 12, 16, 23):
            end = int(np.searchsorted(length, top, "right"))
            for a in range(begin, end, 65_536):
                z = min(end, a + 65_536)
                ids, n = self.merge_many(buf[start[a:z, None] + np.arange(top)], length[a:z])
                flat = ids[np.arange(top)[None, :] < n[:, None]]
                while self.used + len(flat) > len(self.store):
                    self.store = np.concatenate([self.store, np.zeros_like(self.store)])
                self.store[self.used : self.used + len(flat)] = flat
                at[a:z], num[a:z] = self.used + np.cumsum(n) - n, n
                self.used += len(flat)
            begin = end
        return at, num

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.long.get(word)
        if ids is None:
            ids = self.merge_one(word)
            if len(word) <= 256:
                if len(self.long) >= self.MEMO_LONG:
                    self.long.clear()
                self.long[word] = ids
        return ids

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and each text's number of ids."""
        spans = self.spans(texts)
        n = len(spans.start)
        made = [self._ids(spans, a, min(n, a + LOOKUPS)) for a in range(0, n, LOOKUPS)]
        num = np.concatenate([np.empty(0, np.int64), *[m[1] for m in made]])
        ids = np.concatenate([np.empty(0, np.int32), *[m[0] for m in made]])
        return ids, np.diff(np.concatenate([[0], np.cumsum(num)])[spans.text_token])

    def _ids(self, spans: Spans, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens a to z - 1 laid end to end, and how many each has."""
        raw, start, length = spans.raw, spans.start[a:z], spans.length[a:z]
        short = length <= self.SHORT
        num, at = np.empty(len(start), np.int64), np.zeros(len(start), np.int64)
        at[short], num[short] = self.lookup(spans.buf, start[short], length[short])
        long = {}
        for i in np.flatnonzero(~short):
            ids = long[i] = self._long(raw[start[i] : start[i] + length[i]])
            num[i] = len(ids)
        end = np.cumsum(num)
        out = np.empty(int(end[-1]), np.int32)
        if not long:
            out[:] = self.store[np.repeat(at - (end - num), num) + np.arange(len(out))]
            return out, num
        num_short = np.where(short, num, 0)
        within = _within(num_short)
        out[np.repeat(end - num, num_short) + within] = self.store[np.repeat(at, num_short) + within]
        for i, ids in long.items():
            out[end[i] - num[i] : end[i]] = ids
        return out, num

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text (null: empty), in order. Strings of added tokens become their ids."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < PORTION):
                size += len(texts[end] or "")
                end += 1
            part = [t or "" for t in texts[at:end]]
            if len(part) == 1 and size > PORTION:
                yield self._one(part[0])
            elif self.special and any(s in t for t in part for s in self.special):
                for t in part:
                    yield self._one(t)
            else:
                ids, n = self._encode(part)
                stop = np.cumsum(n)
                for a, z in zip((stop - n).tolist(), stop.tolist(), strict=True):
                    yield ids[a:z]
            at = end

    def _one(self, text: str) -> np.ndarray:
        """Ids of a text that may spell added tokens."""
        parts: list[str | int] = [text]
        for s, i in self.special.items():
            parts = [y for x in parts for y in ([x] if isinstance(x, int) else [z for k, w in enumerate(x.split(s)) for z in ([i] if k else []) + [w]])]
        return np.concatenate([np.array([x], np.int32) if isinstance(x, int) else self._encode([p])[0] for x in parts for p in ([x] if isinstance(x, int) or len(x) <= PORTION else pieces(x, PORTION, self.classes))])

    # Decoding

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        n = self.token_len[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.token_len[ids]
        if not len(ids):
            return b""
        return self.token_buf[np.repeat(self.token_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0]-1, 0, 1, ... n[1]-1, ..."""
    end = np.cumsum(n)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - n, n)


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBPE:
    """One encoder for each Python worker and file, as workers are used again for later tasks."""
    return ByteBPE(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids array<int>, offsets array<int> (the UTF-8 byte at which each token begins).

    Null and empty texts give empty arrays; ids may be null or repeat; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in balanced(batches, 1):
            ids = list(bpe.encode(batch.column(1).to_pylist()))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int32)) for x in (ids, [bpe.offsets(x) for x in ids])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "ids", "offsets"])

    kind = df.select(id_col).dtypes[0][1]
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, offsets array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, bytes (what the ids stand for; null ids: empty). An id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            made = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "bytes"])

    kind = df.select(id_col).dtypes[0][1]
    out = df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and keep digests only, in one pass: id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = coder(path)
        name = [str(i) for i in range(len(bpe.token_bytes))]
        for batch in balanced(batches, 1):
            n, a, b = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(sha256(" ".join([name[i] for i in ids.tolist()]).encode()).hexdigest())
                b.append(sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.select(id_col).dtypes[0][1]
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
