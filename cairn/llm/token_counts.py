"""Token counts with a public tokenizer file: batch encoding inside Arrow functions, lengths only.

Texts are batched by bytes and cut at safe boundaries: where the byte-level pattern begins a
pre-token, found for a whole batch at once with arrays. No token spans such a place, so a text has the
tokens of its pre-tokens. The library encodes each new pre-token, many in a call, and its length is
remembered, as natural text repeats its words. Files of other kinds, and texts that spell an added
token, get whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import LOOKUPS, PORTION, PreTokens, pieces
from .common import balanced

#: UTF-8 bytes encoded by one call of the library at most, unless a single segment is longer.
BATCH_BYTES = 1 << 18


class _Lengths(PreTokens):
    """Remembers the number of tokens of each pre-token, asked of the library in batches."""

    def __init__(self, library):
        super().__init__("tokenizers")
        self.library = library

    def _merge_new(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, words = buf.tobytes(), []
        for a, z in zip(start.tolist(), (start + length).tolist(), strict=True):
            words.append(raw[a:z].decode())
        return np.zeros(len(words), np.int64), np.array(self.library(words), np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        spans = self.spans(texts)
        num = np.zeros(len(spans.start), np.int64)
        for a in range(0, len(num), LOOKUPS):
            start, length = spans.start[a : a + LOOKUPS], spans.length[a : a + LOOKUPS]
            short = length <= self.SHORT
            own = num[a : a + LOOKUPS]
            _, own[short] = self.lookup(spans.buf, start[short], length[short])
            own[~short] = self.library([spans.raw[b : b + n].decode() for b, n in zip(start[~short].tolist(), length[~short].tolist(), strict=True)])
        return np.diff(np.concatenate([[0], np.cumsum(num)])[spans.text_token]).tolist()


class TokenCounter:
    """Numbers of tokens of whole texts, by the library for the file: tokenizers (.json) or sentencepiece (.model)."""

    def __init__(self, path: str):
        self.lengths, self.added = None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.batch = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        #: The pre-tokens of bpe.py are safe boundaries for this kind only; other kinds get whole texts.
        if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and spec["normalizer"] is None:
            if self.added:
                self.mark, self.mark_id = self.added[0], spec["added_tokens"][0]["id"]
            self.lengths = _Lengths(self._batch_words)

    def _batch_words(self, words: list[str]) -> list[int]:
        """Lengths of pre-tokens. An added token, which always stands alone, is put between those of one call."""
        if not self.added:
            return [n for part in by_bytes(words) for n in self.batch(part)]
        out: list[int] = []
        for part in by_bytes(words):
            ids = np.array(self.ids([self.mark.join(part)])[0], np.int64)
            ends = np.flatnonzero(ids == self.mark_id)
            out += (np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1).tolist()
        return out

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        """The number of tokens of each text (null: 0), in order; about a megabyte of text is worked on at once."""
        for part in by_bytes([t or "" for t in texts], 4 * BATCH_BYTES):
            if self.lengths is None or any(a in t for t in part for a in self.added):
                yield from self.batch(part)
            elif len(part) == 1 and len(part[0]) > PORTION:
                yield sum(sum(self.lengths.counts([p])) for p in pieces(part[0], PORTION, self.lengths.classes))
            else:
                yield from self.lengths.counts(part)


def by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts in batches of at most `most` UTF-8 bytes each; a longer text is a batch by itself."""
    sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield texts[at:end]
        at = end


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter for each Python worker and file, as workers are used again for later tasks."""
    return TokenCounter(path)


def token_counts(df: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have zero bytes and tokens; ids may be null or repeat, each row is counted
    on its own; other columns are ignored, so their names cannot clash. An empty table gives an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_file)
        for batch in balanced(batches, 1):
            n = list(tokens.counts(batch.column(1).to_pylist()))
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.select(id_col).dtypes[0][1]
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
