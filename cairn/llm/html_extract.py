"""Main text of web pages: a suffix array over each host's pages, and page structure.

A page is parsed once into blocks of words, each with what the markup says of it: chrome (menus, headers, footers,
sidebars, notices, adverts, forms, comments), inside a main container, or neither. The words of all different pages of
a host are laid end to end, and their suffix array with its common prefixes gives the runs that pages share.

Template text is what enough different pages share: runs of 16 words or more on a fifth of the host's pages, of 64 or
more on a tenth (RUNS), and whole blocks, or neighbouring whole blocks, of BLOCK words or more. Fewer words in the middle
of a block are language. Inside main containers it takes MAIN of the pages, as passages of articles do repeat. Words so
covered go, whatever the markup says; unique runs stay. Copies of a page count once, so a copied article is no template.

The markup is asked for what no other page repeats: chrome goes, and if main containers hold most of what is left, the
rest goes too. `n_repeated` and `n_marked` tell how many words each of the two took.

The pages of a host are dealt by hash to shards of about SHARD_WORDS words, each with an array of its own, so no task
grows with a host. What has a share of a host has it in some shard: such units are candidates, are counted again over
all pages of the host, and the thresholds hold once for all its pages, however many shards there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..tables import staged
from .common import balanced, sized
from .line_dedup import host_of

#: Runs: (words at least, share of the host's different pages at least); whole blocks of at least BLOCK words take the first share.
RUNS, BLOCK = ((16, 0.2), (64, 0.1)), 4
#: Different pages at least, outside and inside main containers, and the share of pages inside them.
NEUTRAL, MAIN = 3, (10, 0.5)
#: Words of a shard, about, and its pages, at least: with fewer pages a share is too few of them to mean anything.
SHARD_WORDS, SHARD_PAGES = 1 << 17, 32
#: What the markup says of a block. Blocks are kept as text: a line feed and one of these, then the words, all with one space between.
MARKS = CHROME_MARK, MAIN_MARK, OTHER_MARK = ("\nc", "\nm", "\no")
#: Between pages of a bundle.
PAGE_MARK = "\n;"

#: Names of elements, fixed values.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title", "math", "audio", "video")
CHROME = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "head", "header"}
CONTAINERS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
#: Elements that hold text itself: their ids say nothing, as site generators make them from the text.
TEXTS = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr", "table", "tbody", "thead", "caption", "figure", "figcaption", "address", "details", "summary"}
#: Words in class names and ids, fixed values. Those of chrome; those that may stand beside them in a name of chrome
#: ("ad-slot", "share-buttons"), where any other word ("share-price", "related-work") takes the name for what it is about.
CHROME_PARTS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "widget", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "comment", "comments", "disqus", "pagination", "pager", "login", "search"}
WEAK_PARTS = {"header", "masthead", "banner", "notice", "alert", "toolbar", "reply", "replies"}
FRAME_PARTS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "holder", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "placeholder", "posts", "articles", "primary", "right", "secondary", "section", "site", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper"}
#: Parts of the same that an article inside does not end, and those that no container does.
FIRM_PARTS = {"related", "sidebar", "widget", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "footer"}
COMMENT_PARTS = {"comment", "comments", "disqus", "reply", "replies"}
CONTENT_PARTS = {"article", "post", "entry", "content", "body", "main", "story", "text"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
#: What a name of which only a part is chrome has to hold besides: this share of its words in links.
LINKS = 0.5
#: Strength of chrome: what any main container, what a main element, what nothing inside ends.
LOOSE, FIRM, LASTING = 1, 2, 3

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|\Z))", re.I)
PART = re.compile(r"[a-z0-9]+")


def _names(values: dict[str, str], *attributes: str) -> list[set[str]]:
    """The words of each class name and id."""
    names = " ".join(values.get(a, "") for a in attributes).split()
    return [set(PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower())) for n in names]


def _role(name: str, attrs: str, inside: bool) -> tuple[int, bool, bool]:
    """How firmly an element is chrome (0: not), is it a main container, and is it chrome if most of its words are links."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if "=" in attrs or "hidden" in attrs.lower() else {}
    role = values.get("role", "").lower()
    names = _names(values, "class") if name in TEXTS else _names(values, "class", "id")
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return LASTING, False, False
    if name in CONTAINERS or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody":
        comment = name == "article" and any(n & {"comment", "comments"} for n in names)
        return LASTING * comment, not comment, False
    if name in ("html", "body"):
        return 0, False, False
    if role in CHROME_ROLES:
        return (LOOSE if role in ("banner", "form", "search") else FIRM), False, False
    if name in CHROME and not (name == "header" and inside):
        return (LOOSE if name in ("form", "header") else FIRM), False, False
    frame, content = CHROME_PARTS | WEAK_PARTS | FRAME_PARTS, any(n & CONTENT_PARTS for n in names)
    whole = [n for n in names if all(x in frame or x.isdigit() for x in n) and (n & CHROME_PARTS or n & WEAK_PARTS and not content and not (inside and "header" in n))]
    if whole:
        return max(LASTING if n & COMMENT_PARTS else FIRM if n & FIRM_PARTS else LOOSE for n in whole), False, False
    return 0, False, name not in TEXTS and any(n & CHROME_PARTS for n in names)


def blocks(html: str) -> list[tuple[bool, bool, list[str]]]:
    """(chrome, inside a main container, words) of each block of a page with words, in page order.

    What an element outside a main container says of itself ends at the container, unless it is firm; headings,
    paragraphs and other elements of text are chrome by a whole class name only, never by an id.
    """
    out: list[tuple[bool, bool, list[str], int]] = []
    stack: list[tuple[str, int, bool, bool, tuple[int, int, int, int]]] = []
    opened: Counter[str] = Counter()
    level, main, links = (0, 0, 0, 0), 0, 0  # open elements by strength; main containers; links
    doubt, above = 0, [0]  # the innermost doubtful element (0: none), and the one around each
    words_of = [[0, 0]]  # the words of each, and those in links
    text: list[str] = []

    def say(part: str) -> None:
        text.append(part)
        if doubt:
            n = len(part.split())
            words_of[doubt][0] += n
            words_of[doubt][1] += n * (links > 0)

    def close() -> None:
        words = unescape("".join(text)).split()
        text.clear()
        if words:
            out.append((any(level), main > 0, words, doubt))

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name not in INLINE:
            close()
        if m["end"]:
            while opened[name]:
                tag, was_chrome, was_main, was_doubtful, before = stack.pop()
                opened[tag] -= 1
                links -= tag == "a"
                if was_chrome or was_main or was_doubtful:
                    close()
                    level, main = before, main - was_main
                    doubt = above[doubt] if was_doubtful else doubt
                if tag == name:
                    break
        elif name not in VOID:
            chrome, is_main, is_doubtful = _role(name, m["attrs"], main > 0)
            before = level
            if chrome or is_main or is_doubtful:
                close()
                if chrome:
                    level = tuple(n + (k == chrome) for k, n in enumerate(level))
                elif is_main:
                    main += 1
                    level = (0, 0, 0 if name == "main" else level[FIRM], level[LASTING])
                else:
                    above.append(doubt)
                    doubt = len(words_of)
                    words_of.append([0, 0])
            if name not in INLINE or chrome or is_main or is_doubtful or m["attrs"] or name == "a":
                stack.append((name, chrome, is_main, is_doubtful, before))
                opened[name] += 1
                links += name == "a"
    say(html[at:])
    close()
    for d in range(len(above) - 1, 0, -1):
        for k in (0, 1):
            words_of[above[d]][k] += words_of[d][k]
    linked = [False]
    for d in range(1, len(above)):
        linked.append(linked[above[d]] or 0 < LINKS * words_of[d][0] <= words_of[d][1])
    return [(chrome or linked[d], is_main, words) for chrome, is_main, words, d in out]


def spelt(html: str | None) -> str | None:
    """The blocks of a page as text, see MARKS; null if it has no words."""
    return " ".join(f"{CHROME_MARK if c else MAIN_MARK if m else OTHER_MARK} {' '.join(words)}" for c, m, words in blocks(html or "")) or None


# Pages laid end to end


BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of BASE and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, base, np.uint64)]))
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


class Pages(NamedTuple):
    """Words of pages laid end to end: words (a dictionary array), sums of word hashes, first word of each page and block
    (and the end), the page and the mark (0 to 2, as MARKS) of each block."""

    words: pa.DictionaryArray
    sums: np.ndarray
    first: np.ndarray
    block: np.ndarray
    block_page: np.ndarray
    block_mark: np.ndarray

    def hashes(self, a: np.ndarray, z: np.ndarray, kind: int) -> np.ndarray:
        """Hashes of the words a to z - 1, equal for equal words wherever they are; the lowest bit is `kind`."""
        with np.errstate(over="ignore"):
            h = (self.sums[z] - self.sums[a]) * _powers(len(self.sums))[1][a] + (z - a).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64) & -2 | kind

    def runs(self, length: int) -> np.ndarray:
        """Where runs of `length` words begin that end within their page."""
        if not self.first[-1]:
            return np.zeros(0, np.int64)
        at = np.arange(self.first[-1])
        return at[at + length <= np.repeat(self.first[1:], np.diff(self.first))]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, page) of the fewest whole blocks from each block on that have BLOCK words on the page."""
        end = self.block[np.minimum(np.searchsorted(self.block, self.block[:-1] + BLOCK), len(self.block) - 1)]
        fits = (end - self.block[:-1] >= BLOCK) & (end <= self.first[1:][self.block_page])
        return self.block[:-1][fits], end[fits], self.block_page[fits]

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, end) of all runs and whole blocks."""
        found = []
        for kind, (length, _) in enumerate(RUNS):
            a = self.runs(length)
            found.append((self.hashes(a, a + length, kind), a, a + length))
        a, z, _ = self.whole()
        found.append((self.hashes(a, z, 0), a, z))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def streams(self) -> np.ndarray:
        """A hash of all words of each page."""
        return self.hashes(self.first[:-1], self.first[1:], 0)


def lay(texts: pa.Array) -> Pages:
    """Pages from the texts of spelt(); null: a page without words."""
    from xxhash import xxh64_digest

    lists = pc.split_pattern(texts.cast(pa.string()), " ")
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists).dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    names = flat.dictionary
    cut = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].tolist() if len(names) else []
    raw = names.buffers()[2].to_pybytes() if len(names) else b""
    digests = np.frombuffer(b"".join([xxh64_digest(raw[a:z]) for a, z in zip(cut, cut[1:])]), ">u8").astype(np.uint64)
    code = flat.indices.to_numpy().astype(np.int64)
    mark = pc.fill_null(pc.index_in(names, value_set=pa.array(MARKS)), -1).to_numpy()
    is_mark = mark[code] >= 0
    word = flat.filter(pa.array(~is_mark))
    hashed = digests[code[~is_mark]]
    before = np.concatenate([[0], np.cumsum(~is_mark)])  # words before each token
    edge = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.flatnonzero(is_mark)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _powers(len(hashed))[0][1:])])
    return Pages(word, sums, before[edge], np.concatenate([before[marks], before[-1:]]), np.searchsorted(edge, marks, "right") - 1, mark[code[marks]])


# Suffix array


def _dense(key: np.ndarray) -> np.ndarray:
    """The number of each key among the different keys, ascending."""
    order = np.argsort(key, kind="stable")
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if len(key) else 0
    return out


def suffix_array(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and how many tokens each has in common with the one before (0 if fewer than `least`).

    `tokens`: pages, each followed by a negative number of its own, so that no run crosses pages. Prefix doubling over all
    suffixes up to `least` tokens, then over those alone that still have an equal.
    """
    n, rank, known = len(tokens), _dense(tokens), 1
    while known < least:
        step = min(known, least - known)
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1
        rank, known = _dense(rank * (int(second.max(initial=0)) + 1) + second), known + step
    order = np.argsort(rank, kind="stable")
    changes = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])[:n]
    equal = ~changes
    place = np.maximum.accumulate(np.where(changes, np.arange(n), 0))  # of the first of equals
    rank[order] = place
    while True:
        alone = changes & np.concatenate([changes[1:], [True]])[:n]
        some = np.flatnonzero(~alone)
        if not len(some):
            break
        who = order[some]
        key = place[some] * (n + 1) + rank[who + known]
        by = np.argsort(key, kind="stable")
        order[some], key = who[by], key[by]
        changes[some] = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(changes, np.arange(n), 0))
        rank[order] = place
        known *= 2
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(equal)
    a, b = order[pair - 1], order[pair]
    with np.errstate(over="ignore"):
        power, inverse = _powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((tokens.astype(np.uint64) * np.uint64(BASE) ^ np.uint64(0x5851F42D4C957F2D)) * power[1:])])
        same, step = np.full(len(pair), least), 1 << max(0, n.bit_length() - 1)
        while step:
            ends = np.maximum(a, b) + same + step
            ok = ends <= n
            i, j = a[ok] + same[ok], b[ok] + same[ok]
            ok[ok] = (sums[i + step] - sums[i]) * inverse[i] == (sums[j + step] - sums[j]) * inverse[j]
            same[ok] += step
            step //= 2
    common[pair] = same
    return order, common


def spread(order: np.ndarray, common: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(a first token, pages) of each run of `length` tokens that occurs more than once; `page` of each token."""
    group = np.cumsum(common < length) - 1
    often = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.zeros(0, np.int64)
    pages = int(page.max(initial=0)) + 1
    pairs = np.unique(group[often] * pages + page[order[often]]) // pages
    first, count = np.unique(pairs, return_counts=True)
    return order[np.searchsorted(group, first)], count


def candidates(texts: pa.Array) -> np.ndarray:
    """Hashes of the units that have their share of these different pages, each page once."""
    pages = lay(texts)
    n, words = len(pages.first) - 1, pages.first[-1]
    if not words:
        return np.zeros(0, np.int64)
    # A number of its own ends each page.
    at = np.arange(words) + np.repeat(np.arange(n), np.diff(pages.first))
    tokens, page = np.empty(words + n, np.int64), np.repeat(np.arange(n), np.diff(pages.first) + 1)
    tokens[pages.first[1:] + np.arange(n)] = -1 - np.arange(n)
    tokens[at] = pages.words.indices.to_numpy()
    order, common = suffix_array(tokens, RUNS[0][0])
    found = []
    for kind, (length, share) in enumerate(RUNS):
        start, count = spread(order, common, page, length)
        start = start[count >= share * n]
        start -= page[start]
        found.append(pages.hashes(start, start + length, kind))
    a, z, block_page = pages.whole()
    pairs = np.unique(np.stack([pages.hashes(a, z, 0), block_page]), axis=1)[0]
    unit, count = np.unique(pairs, return_counts=True)
    found.append(unit[count >= RUNS[0][1] * n])
    return np.unique(np.concatenate(found))


def counted(texts: pa.Array, listed: np.ndarray) -> np.ndarray:
    """The units of `listed` (sorted) on each of these pages, once a page, laid end to end."""
    pages = lay(texts)
    unit, a, _ = pages.units()
    there = np.isin(unit, listed)
    page = np.searchsorted(pages.first, a[there], "right") - 1
    return np.unique(np.stack([page, unit[there]]), axis=1)[1]


def strip(texts: pa.Array, neutral: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The main text of each of a host's pages, given the template units outside and inside main containers, and how many
    words they covered and the markup took."""
    pages = lay(texts)
    n, words = len(pages.first) - 1, int(pages.first[-1])
    unit, a, z = pages.units()
    covered = []
    for listed in (neutral, inside):
        there = np.isin(unit, listed)
        edge = np.bincount(a[there], minlength=words + 1) - np.bincount(z[there], minlength=words + 1)
        covered.append(np.cumsum(edge)[:words] > 0)
    mark = np.repeat(pages.block_mark, np.diff(pages.block))
    page = np.repeat(np.arange(n), np.diff(pages.first))
    repeated = np.where(mark == 1, covered[1], covered[0])
    left = [np.bincount(page[~repeated & (mark == m)], minlength=n) for m in (1, 2)]
    marked = ~repeated & ((mark == 0) | (mark == 2) & ((left[0] > 0) & (left[0] >= left[1]))[page])
    keep = ~repeated & ~marked
    size = np.bincount(page[keep], minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pages.words.filter(pa.array(keep)).dictionary_decode())
    return pc.binary_join(lists, " "), np.bincount(page[repeated], minlength=n), np.bincount(page[marked], minlength=n)


def thresholds(pages: int) -> tuple[dict[int, float], dict[int, float]]:
    """The pages that a unit must be on, by its lowest bit, outside and inside main containers of a host of `pages` different ones."""
    return {k: max(NEUTRAL, s * pages) for k, (_, s) in enumerate(RUNS)}, dict.fromkeys(range(len(RUNS)), max(MAIN[0], MAIN[1] * pages))


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page of one host, in one array."""
    texts = pa.array([spelt(p) for p in pages], pa.string())
    _, own = np.unique(lay(texts).streams(), return_index=True)
    own = texts.take(pa.array(np.sort(own))).drop_null()
    unit, count = np.unique(counted(own, candidates(own)), return_counts=True)
    lists = [unit[count >= np.array([t[k] for k in range(len(RUNS))])[unit & 1]] for t in thresholds(len(own))]
    return strip(texts, *lists)[0].to_pylist()


# Tables


def by_host(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(row numbers, rows) of each host of a batch, whose first column it is."""
    code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(rows):
            yield rows, batch.take(pa.array(rows))


def parse(pages: DataFrame) -> DataFrame:
    """host, id, url, words (see spelt), stream, n_words of each row of host, id, url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 3):
            texts = pa.array([spelt(h) for h in batch.column(3).to_pylist()], pa.string())
            laid = lay(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts, pa.array(laid.streams()), pa.array(np.diff(laid.first))], ["host", "id", "url", "words", "stream", "n_words"])

    kinds = dict(pages.dtypes)
    return pages.select("host", "id", "url", "html").mapInArrow(run, f"host string, id {kinds['id']}, url {kinds['url']}, words string, stream long, n_words long")


def templates(parsed: DataFrame) -> DataFrame:
    """(host, neutral, inside): the template units of each host that has any, as bytes of 64-bit hashes; `parsed` also has `row`."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 2):
            for _, part in by_host(batch):
                shard = part.column(1).to_numpy()
                order = np.argsort(shard, kind="stable")
                rows = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
                raw = [PAGE_MARK.join(part.column(2).take(pa.array(r)).to_pylist()).encode() for r in rows]
                first = pa.array([int(r[0]) for r in rows])
                yield pa.RecordBatch.from_arrays([part.column(0).take(first), part.column(1).take(first), pa.array(map(len, raw), pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())], ["host", "shard", "size", "pages"])

    def propose(table: pa.Table) -> pa.Table:
        raw = [pa.decompress(x, n, "zstd", asbytes=True).decode() for x, n in zip(table.column("pages").to_pylist(), table.column("size").to_pylist(), strict=True)]
        units = candidates(pa.array([t for x in raw for t in x.split(PAGE_MARK)], pa.string()))
        return pa.table([table.column("host").take(pa.array(np.zeros(len(units), np.int64))), pa.array(units)], ["host", "unit"])

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 1):
            for _, part in by_host(batch):
                found = counted(part.column(1), np.frombuffer(part.column(2)[0].as_py(), np.int64))
                # Partial counts: one row a unit and batch.
                unit, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.zeros(len(unit), np.int64))), pa.array(unit), pa.array(n)], ["host", "unit", "n"])

    def listed(units: DataFrame, *conditions: str) -> DataFrame:
        """The units of each host that meet each of the conditions, as bytes."""

        def pack(table: pa.Table) -> pa.Table:
            lists = [np.sort(table.column("unit").filter(table.column(f"is{k}")).to_numpy()).tobytes() for k in range(len(conditions))]
            return pa.table([table.column("host").slice(0, 1), *[pa.array([b], pa.binary()) for b in lists]], ["host", *[f"list{k}" for k in range(len(conditions))]])

        marked = units.select("host", "unit", *[F.expr(c).alias(f"is{k}") for k, c in enumerate(conditions)])
        return marked.groupBy("host").applyInArrow(pack, "host string, " + ", ".join(f"list{k} binary" for k in range(len(conditions))))

    # Copies of a page: the one with the least blocks' hash speaks for all.
    different = parsed.where("n_words > 0").groupBy("host", "stream").agg(F.min(F.struct(F.xxhash64("words"), "row")).alias("least"), F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"))
    different = staged(different.select("host", "stream", F.col("least.row").alias("keep"), "n_words", "n"), "different")
    hosts = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_words").alias("host_words"))
    # A host of less pages than make a template has none.
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("host_words") / SHARD_WORDS), F.floor(F.col("pages") / SHARD_PAGES))).cast("bigint")
    hosts = sized(hosts.where(F.col("pages") >= NEUTRAL).select("host", "pages", shards.alias("shards")), "hosts")
    copies = sized(different.where("n > 1").select("host", "stream", "keep"), "copies")
    own = parsed.where("n_words > 0").join(hosts, "host").join(copies, ["host", "stream"], "left").where("keep IS NULL OR keep = row")
    # The words of a task's pages of a shard travel as one compressed bundle.
    bundles = own.select("host", F.pmod("stream", "shards").alias("shard"), "words").mapInArrow(bundle, "host string, shard long, size long, pages binary")
    proposed = bundles.groupBy("host", "shard").applyInArrow(propose, "host string, unit long").distinct()
    lists = sized(listed(proposed, "true"), "candidates")
    counts = own.join(lists, "host").select("host", "words", "list0").mapInArrow(occur, "host string, unit long, n long").groupBy("host", "unit").agg(F.sum("n").alias("n"))
    share = F.element_at(F.array(*[F.lit(s) for _, s in RUNS]), (F.col("unit").bitwiseAND(F.lit(1)) + 1).cast("int"))
    counts = counts.join(hosts, "host").withColumn("least", F.greatest(F.lit(float(NEUTRAL)), share * F.col("pages"))).withColumn("least_inside", F.greatest(F.lit(float(MAIN[0])), MAIN[1] * F.col("pages")))
    made = listed(counts.where("n >= least OR n >= least_inside"), "n >= least", "n >= least_inside")
    return made.select("host", F.col("list0").alias("neutral"), F.col("list1").alias("inside"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: id, url, text (empty if the page has none), n_chars (its code points), n_repeated, n_marked.

    n_repeated: words that went as template text of the host; n_marked: words that went for their markup alone. Null
    html: as if empty. Pages without a host are one host. Rows may repeat; copies of a page count once as evidence and
    each gets its text. Other columns are not read. An empty table gives an empty one.
    """
    pages = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].alias("html")).withColumn("host", F.coalesce(host_of("url"), F.lit("")))
    parsed = staged(parse(pages).withColumn("row", F.monotonically_increasing_id()), "parsed")
    lists = sized(templates(parsed), "templates")
    kinds = dict(parsed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 3):
            for _, part in by_host(batch):
                units = [np.frombuffer(part.column(k)[0].as_py() or b"", np.int64) for k in (4, 5)]
                texts, repeated, marked = strip(part.column(3), *units)
                yield pa.RecordBatch.from_arrays([*part.columns[1:3], texts, pc.utf8_length(texts).cast(pa.int64()), pa.array(repeated, pa.int64()), pa.array(marked, pa.int64())], ["id", "url", "text", "n_chars", "n_repeated", "n_marked"])

    out = parsed.join(lists, "host", "left").select("host", "id", "url", "words", "neutral", "inside")
    out = out.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long, n_repeated long, n_marked long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
