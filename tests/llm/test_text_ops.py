"""Language identification, line dedup, packing, BPE and token counts."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import DOC, WORDS, prose

from cairn.llm import bpe, lang_id, line_dedup, packing, token_counts

P = pytest.importorskip("public_tokenizers")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def tik():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange(rng, n=4000):
    parts = ["a", " ", "  ", "'", "'s", "'ll", "\n", "\t", "!", "1", "½", "é", "中", "🙂", "\x1c", "\x00", "　", "re", "<|endoftext|>", "word", "अ", "́"]
    return ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(n)] + ["", "x" * 5000, "a b" * 4000, "'" * 300 + "s"]


# Byte-level BPE


def test_ids_match_both_libraries(rng):
    texts = strange(rng)
    enc = tik()
    want = [enc.encode_ordinary(t) for t in texts]
    coder = bpe.ByteBPE(RANKS)
    got = list(coder.encode(texts))
    assert [g.tolist() for g in got] == want
    for t, g in zip(texts, got):
        assert coder.decode(g) == t.encode()
        at = coder.offsets(g)
        assert all(t.encode()[a : a + len(coder.token_bytes[i])] == coder.token_bytes[i] for a, i in zip(at, g))
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in bpe.ByteBPE(JSON).encode(texts)] == want


def test_long_texts_are_cut_safely(rng, monkeypatch):
    texts = [t for t in strange(rng) if t] + [prose(rng, 3000), "x" * 3000, ("ab  c\n d'll " * 300)]
    enc = tik()
    want = [enc.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "PORTION", 40)
    monkeypatch.setattr(bpe, "LOOKUPS", 7)
    monkeypatch.setattr(token_counts, "PORTION", 40)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 16)
    assert [g.tolist() for g in bpe.ByteBPE(RANKS).encode(texts)] == want
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert list(token_counts.TokenCounter(JSON).counts(texts)) == want


def test_a_full_table_is_emptied(rng, monkeypatch):
    texts = [prose(rng, 300) for _ in range(20)]
    enc = tik()
    monkeypatch.setattr(bpe.PreTokens, "MOST", 50)
    assert [g.tolist() for g in bpe.ByteBPE(RANKS).encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_every_code_point():
    """All 1,112,064 code points beside spaces, letters, digits, signs and apostrophes: the ids of both libraries, for both files."""
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}'s!{c}\n'{c}" for c in codes[k : k + 2048]) for k in range(0, len(codes), 2048)]
    enc, lib = tik(), library()
    for t, got in zip(texts, bpe.ByteBPE(RANKS).encode(texts), strict=True):
        assert got.tolist() == enc.encode_ordinary(t)
    want = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    for ids, got in zip(want, bpe.ByteBPE(JSON).encode(texts), strict=True):
        assert got.tolist() == ids
    assert list(token_counts.TokenCounter(JSON).counts(texts)) == [len(ids) for ids in want]


def test_long_texts_without_spaces(rng, monkeypatch):
    """Base64, Chinese and one endless word are cut at token begins alone; the last is one piece."""
    import base64 as b64

    texts = [b64.b64encode(rng.bytes(3000)).decode(), "".join(map(chr, rng.integers(0x4E00, 0x9000, 2000))) + "。" + "好" * 500, "x" * 3000, "\n".join("ab" for _ in range(500)), ("a \n" * 400) + "b", "<|endoftext|>" * 60]
    table = bpe.classes("tokenizers")
    for t in texts:
        parts = list(bpe.pieces(t, 64, table))
        assert "".join(parts) == t and (len(parts) > 1 or t[0] == "x")
    monkeypatch.setattr(bpe, "PORTION", 64)
    monkeypatch.setattr(token_counts, "PORTION", 64)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 16)
    enc, lib = tik(), library()
    assert [g.tolist() for g in bpe.ByteBPE(RANKS).encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in bpe.ByteBPE(JSON).encode(texts)] == want
    assert list(token_counts.TokenCounter(JSON).counts(texts)) == list(map(len, want))


def test_scan_is_the_automaton(rng):
    for n in (0, 1, 127, 128, 129, 20_000):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        state, want = bpe.FREE, []
        for s in symbols:
            want.append(state)
            state = bpe._step(int(s) % 8, bpe.FREE if s >= 8 else state)[0]
        assert bpe.scan(symbols).tolist() == want


def test_merge_one_is_merge_many(rng):
    coder = bpe.ByteBPE(RANKS)
    for w in [b"a", b"thethe", b"  x", bytes(range(23)), "éèê".encode()]:
        buf = np.frombuffer(w.ljust(23, b"\0"), np.uint8)[None]
        ids, n = coder.merge_many(buf, np.array([len(w)]))
        assert ids[0, : n[0]].tolist() == coder.merge_one(w).tolist()


def test_encode_tables(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    enc = tik()
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or "")) for r in rows)
    made = bpe.encode(odd, RANKS)
    assert sorted((str(r.doc_id), r.ids) for r in made.collect()) == want
    assert sorted(bytes(r.bytes) for r in bpe.decode(made, RANKS).collect()) == sorted((r.text or "").encode() for r in rows)
    digests = bpe.encode_digests(odd, RANKS).collect()
    assert sorted((r.n_tokens, r.ids_sha256) for r in digests) == sorted((len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for _, i in want)
    assert bpe.encode(odd.limit(0), RANKS).count() == 0


# Token counts


def test_counts_match_library(rng):
    texts = strange(rng) + [None]
    want = [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert list(token_counts.TokenCounter(JSON).counts(texts)) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_get_whole_texts(rng, name):
    texts = [prose(rng, 40), "", "Ünïcode  text\n"]
    counter = token_counts.TokenCounter(P.path(name))
    assert list(counter.counts(texts)) == counter.batch(texts)


def test_count_table(spark, odd):
    rows = {(r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, JSON, 512).collect()}
    lib = library()
    want = {(len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for (t,) in odd.select("text").collect()}
    assert rows == want and token_counts.token_counts(odd.limit(0), JSON).count() == 0


# Packing


def brute_best_fit(items, capacity):
    bins = []
    for s in sorted(items, reverse=True):
        fits = [r for r in bins if r >= s]
        if fits:
            bins[bins.index(min(fits))] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def fewest(items, capacity):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in {b: None for b in bins}:
            if b >= items[k]:
                rest = list(bins)
                rest.remove(b)
                go(k + 1, [*rest, b - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_plan_against_brute_force(rng):
    for _ in range(60):
        capacity, n = int(rng.choice([10, 16, 30])), int(rng.integers(0, 9))
        items = rng.integers(1, capacity, n).tolist()
        counts = np.bincount(items, minlength=capacity + 1) if n else np.zeros(capacity + 1, int)
        assert sum(k.times for k in packing.best_fit(counts.copy(), capacity)) == brute_best_fit(items, capacity)
        left = counts.copy()
        fixed = packing.dominance(left, capacity)
        rest = [s for s, c in enumerate(left) for _ in range(c)]
        # Dominance keeps an optimal solution.
        assert sum(k.times for k in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        kinds = packing.plan({s: int(c) for s, c in enumerate(counts) if c}, capacity)
        used = np.zeros(capacity + 1, int)
        for k in kinds:
            assert sum(s * m for s, m in k.parts) <= capacity
            for s, m in k.parts:
                used[s] += m * k.times
        assert (used == counts).all()


def check_packing(rows, ids, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, want in ids.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity) and 0 < r.length <= capacity
            assert zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_pack(spark, rng):
    texts = [prose(rng, int(n)) for n in rng.integers(0, 400, 200)] + ["", None, prose(rng, 3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    ids = {k: e.ids + [2] for k, e in enumerate(library().encode_batch([t or "" for t in texts], add_special_tokens=False))}
    sequences = check_packing(packing.pack(df, JSON, 128).collect(), ids, 128)
    assert sequences <= -(-sum(map(len, ids.values())) // 128) + 2


def test_pack_odd(spark, odd):
    made = packing.pack(odd, JSON).collect()
    lib = library()
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for (t,) in odd.select("text").collect())
    assert sum(r.length for r in made) == total
    assert len({(r.sequence_id, r.offset) for r in made}) == len(made)
    assert packing.pack(odd.limit(0), JSON).count() == 0


# Language


def test_languages(spark, rng):
    rows = [(k, prose(rng, int(rng.integers(4, 60)), lang), lang, "s", 0) for k, lang in enumerate(rng.choice(list(WORDS), 600))]
    made = lang_id.identify(spark.createDataFrame(rows, DOC)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in made if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in made)


def brute_predict(rows):
    """The whole method in plain Python: n-gram counts in dictionaries, the same machines, votes counted pair by pair."""
    import xxhash

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = " " + " ".join(letters.split()) + " "
        return Counter(padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1)) if letters.strip() else None

    def column(gram):
        h = g = None
        for c in gram:
            h = ord(c) * 0x9E3779B1 % 2**32
            g = h if g is None else ((g ^ g >> 15) * 0x85EBCA77 + h) % 2**32
        return g * 0xC2B2AE3D % 2**32 >> 20

    def vector(text):
        counts = grams(text)
        if counts is None:
            return None
        x = np.zeros(lang_id.WIDTH)
        for g, n in counts.items():
            x[column(g)] += n
        return np.sqrt(x / x.sum()).astype(np.float32)

    vectors = {k: vector(t) for k, t, *_ in rows}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    place = lambda k, t: signed(xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42))) % (1 << 30)
    labelled = [(lang, place(k, t), k) for k, t, lang, *_ in rows if lang and t is not None and vectors[k] is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    x, y = np.array([vectors[k] for _, _, k in sorted(labelled, key=lambda r: (r[0], vectors[r[2]].tobytes()))]), sorted(lang for lang, _, _ in labelled)
    model = lang_id.train(x, y)
    made = {}
    for k, v in vectors.items():
        if v is None:
            made[k] = ("und", 0.0)
            continue
        margin = [float(v.astype(np.float64) @ model.weights[:, j].astype(np.float64) + model.bias[j]) for j in range(model.weights.shape[1])]
        odds = [1 / (1 + np.exp(-model.slope[j] * m)) for j, m in enumerate(margin)]
        family = int(np.argmax(margin[: len(model.families)]))
        duels = [(a, b, j) for j, (f, a, b) in enumerate(model.pairs, len(model.families)) if f == family]
        votes, sums = Counter(), Counter()
        for a, b, j in duels:
            votes[a if margin[j] >= 0 else b] += 1
            sums[a] += margin[j]
            sums[b] -= margin[j]
        pick = max(range(len(model.members[family])), key=lambda i: (votes[i], sums[i], -i))
        sure = [odds[j] if a == pick else 1 - odds[j] for a, b, j in duels if pick == (a if margin[j] >= 0 else b)]
        made[k] = (model.members[family][pick], odds[family] * min(sure, default=1.0))
    return made


def test_language_against_brute_force(spark, rng):
    """Every prediction and score, three languages in one family, fewer rows than the sample takes."""
    rows = [(k, prose(rng, int(rng.integers(1, 40)), lang) + str(rng.choice(["", "!? 12", " Éß"])), "nl" if lang == "en" and k % 3 == 0 else lang, "s", 0) for k, lang in enumerate(rng.choice(list(WORDS), 240))]
    rows += [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, "1 2 3", None, "s", 0), (903, "ein Text ohne Marke", None, "s", 0)]
    made = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(spark.createDataFrame(rows, DOC)).collect()}
    want = brute_predict(rows)
    assert {k: v[0] for k, v in made.items()} == {k: v[0] for k, v in want.items()}
    assert max(abs(made[k][1] - want[k][1]) for k in want) < 1e-3


def test_every_language_is_learned(spark, rng, monkeypatch):
    """No cap on languages: with more of them each has fewer rows in the sample."""
    monkeypatch.setattr(lang_id, "SAMPLE", 90)
    monkeypatch.setattr(lang_id, "EACH", 2)
    words = {f"l{k}": ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(12)] for k in range(30)}
    rows = [(k, " ".join(rng.choice(words[f"l{k % 30}"], 20)), f"l{k % 30}", "s", 0) for k in range(360)]
    made = lang_id.identify(spark.createDataFrame(rows, DOC)).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 30}" for r in made]) > 0.9


def test_language_odd(spark, odd):
    made = lang_id.identify(odd).collect()
    assert len(made) == odd.count()
    by_text = {r.doc_id: r.lang_pred for r in made}
    assert by_text[2] == by_text[3] == by_text[4] == by_text[7] == "und" and by_text[8] in ("de", "en", "fr")
    assert lang_id.identify(odd.limit(0)).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in lang_id.identify(unlabelled).collect()} == {"und"}


def test_prediction_reads_text_alone(rng):
    x = np.array([lang_id.features(prose(rng, 30, lang)) for lang in ("en", "de", "fr", "es") for _ in range(20)])
    model = lang_id.train(x, [lang for lang in ("en", "de", "fr", "es") for _ in range(20)])
    assert len(model.families) == 2 and len(model.pairs) == 2
    assert lang_id.features("!? 12") is None and np.allclose(lang_id.features("Ab, cd"), lang_id.features("ab  cd"))
    long = prose(rng, 200_000)
    whole = lang_id.features(long)
    lang_id.PORTION, before = 1 << 12, lang_id.PORTION
    try:
        assert np.allclose(lang_id.features(long), whole)
    finally:
        lang_id.PORTION = before


# Lines


def brute_lines(rows, ratio, least, once):
    pages, on = {}, {}
    for k, (_, text, _, host, _) in enumerate(rows):
        if text is not None and host is not None:
            page = text if once else k
            pages.setdefault(host, set()).add(page)
            for line in set(text.split("\n")):
                on.setdefault((host, line), set()).add(page)
    gone = {k for k, v in on.items() if k[1].strip(" ") and len(v) >= least and len(v) > ratio * len(pages[k[0]])}
    return sorted(((str(d), t if t is None or h is None else "\n".join(x for x in t.split("\n") if (h, x) not in gone)) for d, t, _, h, _ in rows), key=str)


def test_lines_against_brute_force(spark, rng):
    lines = [prose(rng, 3) for _ in range(30)] + ["", " "]
    rows = [(k, "\n".join(rng.choice(lines, 4, p=None)), "en", f"h{min(2, k % 5)}", 1) for k in range(300)] + [(900 + k, "same\nagain", "en", "h9", 1) for k in range(50)]
    for ratio, least, once in ((0.1, 5, True), (0.2, 3, True), (0.0, 1, False), (0.1, 1, False), (0.3, 1, True)):
        made = line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOC), ratio=ratio, least_pages=least, same_once=once, dropped_col="gone")
        assert sorted(((str(r.doc_id), r.text) for r in made.collect()), key=str) == brute_lines(rows, ratio, least, once)


def test_lines_odd(spark, odd):
    made = line_dedup.drop_boilerplate(odd, least_pages=5, same_once=True, dropped_col="gone")
    assert made.columns == [*odd.columns, "gone"]
    assert sorted(str(r.text) for r in made.collect()) == sorted(str(t) for (t,) in odd.select("text").collect())
    assert line_dedup.drop_boilerplate(odd.limit(0)).count() == 0
    by_rule = line_dedup.drop_boilerplate(odd).collect()
    rows = [(r.doc_id, r.text, None, r.source, None) for r in odd.collect()]
    assert sorted(map(str, [(str(r.doc_id), r.text) for r in by_rule])) == sorted(map(str, brute_lines(rows, 0.1, 1, False)))
    urls = spark.createDataFrame([("http://A.example.org/x",), ("odd",), (None,)], "url string")
    assert [r[0] for r in urls.select(line_dedup.host_of("url")).collect()] == ["a.example.org", None, None]
