"""SimHash, weighted samples, HTML, sound, licences, and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import DOC, prose
from pyspark.sql import functions as F

from cairn.operators.tracks import roots
from cairn.llm import audio_features, cws, html_extract, license_scan, simhash


# SimHash


def brute_print(text, words=3):
    import xxhash

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, ids, radius):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, pa_ in zip(ids, prints):
        for b, pb in zip(ids, prints):
            if (pa_ ^ pb).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints(rng):
    for t in [None, "", " \n", "A", "a b", "a b c", "Ä a É", prose(rng, 500), prose(rng, 100_000), "a\x0bb\x1cc d"]:
        if t is None or len(t) < 10_000:
            assert simhash.fingerprint(t) == brute_print(t)
        assert 0 <= simhash.fingerprint(t) < 1 << 64


def test_spark_hash_is_the_same(spark):
    import xxhash

    for t in ("", "a", "the cat sat on the mat and looked at the dog for a while"):
        got = spark.sql("SELECT xxhash64(:t) AS h", args={"t": t}).first().h
        assert got % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), seed=42)


def test_vantage_points_lose_no_pair(rng):
    base = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    near = [base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4)]
    center = [base[0] ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (800, 2))]
    fps = np.unique(np.concatenate([base, *near, np.array(center, np.uint64)]))
    tree = simhash.Tree(fps[::7], len(fps), 2, shard=200)
    rows, shard = tree.shards(fps)
    home = [set() for _ in fps]
    for r, s in zip(rows, shard):
        home[r].add(s)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    assert len(set(shard)) > 5 and all(home[a] & home[b] for a, b in zip(i, j))
    want = brute_groups([int(f) for f in fps[:700]], list(range(700)), 2)
    assert simhash.link(fps[:700], 2).tolist() == [want[k] for k in range(700)]


def test_near_duplicates(spark, rng):
    texts = [prose(rng, 200) for _ in range(60)]
    for k in range(40):
        words = texts[k % 20].split()
        words[int(rng.integers(200))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0]] * 30 + ["", None, "  "]
    ids = rng.permutation(len(texts)).tolist()
    made = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    prints = [brute_print(t) for t in texts]
    want = brute_groups(prints, ids, 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in made} == {i: (f"{p:016x}", want[i]) for i, p in zip(ids, prints)}


def test_heavy_shards_get_trees_of_their_own(spark, rng, monkeypatch):
    """A sample far too small for the corpus: shards are split again, and no link is lost."""
    for name, value in (("SAMPLE", 64), ("SHARD", 40), ("HEAVY", 120), ("SUBSAMPLE", 64)):
        monkeypatch.setattr(simhash, name, value)
    # Fingerprints around a few hundred centres, so that trees have something to split by.
    centre = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    fps = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 3), dtype=np.uint64), axis=1) for c in centre])
    fps = np.unique(np.concatenate([fps, fps[::9] ^ np.uint64(5)]))
    rows = [(k, int(f) if f < 1 << 63 else int(f) - (1 << 64)) for k, f in enumerate(fps.tolist())]
    nodes = spark.createDataFrame(rows, "rep long, fp long").select("fp", "rep")
    home, got, collect = {}, [], type(nodes).collect
    with monkeypatch.context() as m:
        m.setattr(type(nodes), "collect", lambda df: got.append(len(out := collect(df))) or out)
        placed = simhash.dealt(nodes, len(rows), 2)
    assert max(got) <= 128  # the first sample; no trees, shards or counts of them
    for r in placed.collect():
        home.setdefault(r.rep, set()).add(r.shard)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    assert set(home) == set(range(len(fps))) and all(home[a] & home[b] for a, b in zip(i.tolist(), j.tolist()))
    assert max(s for h in home.values() for s in h) > 1 << 16
    made = {r.fp: r.component for r in simhash.near_classes(nodes.withColumnRenamed("rep", "id"), 2).collect()}
    want = brute_groups([int(f) for f in fps], list(range(len(fps))), 2)
    assert made == {f: want[k] for k, f in rows}


def test_near_duplicates_odd(spark, odd):
    made = simhash.near_duplicates(odd).collect()
    assert len(made) == odd.count()
    assert {r.component_id for r in made if r.doc_id in (1, None)} == {1}
    assert {r.component_id for r in made if r.doc_id in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark, rng):
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5)]
    made = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert made == {k: v for k, v in root.items() if k != v}


# Weighted samples


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collision_rate_is_generalised_jaccard(spark, rng):
    rows = []
    for k in range(300):
        words = prose(rng, 120).split()
        cut = int(rng.integers(0, 120))
        rows.append((k, " ".join(words), " ".join(words[cut:] + prose(rng, cut).split())))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    sigs = {}
    for r in cws.signatures(df, ["k"], ["a", "b"]).collect():
        sigs[r.k, r.which] = np.array(r.sig)
    true = np.array([jaccard(a, b) for _, a, b in rows])
    got = np.array([(sigs[k, 0] == sigs[k, 1]).mean() for k in range(300)])
    assert abs((got - true).mean()) < 0.015
    assert abs(np.sqrt(((got - true) ** 2).mean()) - np.sqrt((true * (1 - true)).mean() / cws.SAMPLES)) < 0.02


def test_edit_likeness(spark, rng):
    texts = [prose(rng, int(n)) for n in rng.integers(0, 60, 700)] + ["", "é🙂" * 50]
    ids = sorted(rng.choice(10**9, len(texts), replace=False).tolist())
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    made = {r.doc_id: r for r in cws.edit_likeness(df).collect()}
    assert len(made) == len(ids)
    for k, (i, t) in enumerate(zip(ids, texts)):
        after = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert made[i].n_chars == len(t) and made[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = lambda a, b: sum(a[j : j + 6] == b[j : j + 6] for j in range(0, len(a), 6)) / cws.SAMPLES
        assert made[i].near_edited == same(made[i].fingerprint, made[i].edited_fingerprint)
        assert made[i].near_next == same(made[i].fingerprint, made[ids[(k + 1) % len(ids)]].fingerprint)
    single = {r.doc_id: r.fingerprint for r in cws.fingerprint(df).collect()}
    assert all(single[i] == made[i].fingerprint for i in ids)


def test_edit_likeness_odd(spark, odd):
    made = cws.edit_likeness(odd).collect()
    assert len(made) == odd.count()
    assert len({r.fingerprint for r in made if r.doc_id in (1, None)}) == 1
    assert len({r.fingerprint for r in made if r.doc_id in (2, 3, 4)}) == 1
    assert cws.edit_likeness(odd.limit(0)).count() == 0
    with pytest.raises(TypeError):
        cws.edit_likeness(odd.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"))


def test_edit_likeness_buckets(spark, rng, monkeypatch):
    """Ids far apart, at the ends of their range, null and repeated: buckets stay small and successors right."""
    monkeypatch.setattr(cws, "BUCKET_ROWS", 8)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 30, 500)]
    ids = [None] * 120 + [7] * 150 + list(range(10, 230)) + [(1 << 63) - 1, -(1 << 63), 1 << 62] + [1 << 61] * 7
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    docs, used = cws._bucketed(df.select(F.col("doc_id").alias("id"), "text"))
    sizes = [r["count"] for r in docs.groupBy("bucket").count().collect()]
    assert len(sizes) == len(used) and max(sizes) < 60
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, q = order[(k + 1) % len(order)][1], len(t) // 4
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in cws.edit_likeness(df).collect()) == sorted(want)


# HTML


def page(title, body, nav="Home News Sport Weather", wrap="article"):
    return f"<!DOCTYPE html><html><head><title>x</title><style>a{{}}</style></head><body class='has-sidebar'><nav><ul><li>{nav}</li></ul></nav><{wrap}><h1>{title}</h1>{body}</{wrap}><footer>&copy; all</footer></body></html>"


def test_structure():
    html = page("Hi &amp; <i>th</i>ere", "<p><b>one<br>two<p>a&nbsp; b</p><script>var t='</p>';</script><!-- <p>no</p> --><div class='share'>no</div><aside>no</aside><form>no</form><div id='comments'><p>no</p></div><p title='a>b'>end")
    assert html_extract.main_texts([html]) == ["Hi & there one two a b end"]
    assert html_extract.main_texts([None, "", "plain <b>te</b>xt", "<div class=cookie-banner>no</div><div class='post-header'>yes</div>"]) == ["", "", "plain text", "yes"]
    assert html_extract.main_texts(["<nav>no<div>yes</nav><p>1 &lt; 2</p>"]) == ["1 < 2"]


@pytest.mark.parametrize(("html", "text"), [
    ('<article><h2 id="search-algorithms">Search algorithms</h2><p>Body one.</p><h2 id="related-work">Related work</h2><p>Body two.</p></article>', "Search algorithms Body one. Related work Body two."),
    ('<article><p class="share-price">The price rose.</p><div id="social-history"><p>Long ago.</p></div></article>', "The price rose. Long ago."),
    ('<form id="aspnetForm"><article><p>Text</p></article></form>', "Text"),
    ('<div class="login-page"><main><h1>Title</h1><p>Text</p></main></div><div class="login-box">Name</div>', "Title Text"),
    ('<div class="modal"><header><article>Text</article></header></div>', "Text"),
    ('<div id="comments"><article><p>I like it</p></article><main>no</main></div><article>Text</article>', "Text"),
    ('<aside><article>teaser</article></aside><div class="related-posts"><article>more</article></div><article>Text</article>', "Text"),
    ('<article>Text<div class="ad-slot">buy</div><div class="ad-3">buy</div><p class="advert">buy</p><ul class="share-buttons"><li><a href=x>Tell</a></ul><section class="comment-list"><p>me too</p></section></article>', "Text"),
    ('<article>Text<div class="related-reading-extra"><a href=x>One more text</a> or <a href=y>another one</a></div></article>', "Text"),
    ('<article>Text<div class="related-reading-extra">This has much to say beside <a href=y>one</a></div></article>', "Text This has much to say beside one"),
    ('<article><header><h1>Title</h1></header><section id="login"><p>x</p></section><td class="menu-card">Soup</td></article>', "Title Soup"),
    ('<main hidden>no</main><article aria-hidden=true>no</article><article>Text</article>', "Text"),
])
def test_article_text_is_not_lost_by_names(html, text):
    assert html_extract.main_texts([html]) == [text]


def test_very_long_page():
    part = '<div class="related-x"><p id="menu">some words <a href=y>here</a></p>'
    html = "<article>" + part * 20_000 + "</div>" * 20_000 + "</article>"
    assert html_extract.main_texts([html]) == [" ".join(["some words here"] * 20_000)]


def test_suffix_array_against_brute_force(rng):
    """Order, common prefixes and page counts, on pages that repeat runs of every length."""
    long = rng.integers(0, 50, 90)
    pages = [rng.integers(0, 4, int(n)) for n in rng.integers(0, 60, 30)] + [np.arange(10), np.arange(10), long, np.concatenate([long[:70], long[:30]])]
    tokens = np.concatenate([x for k, p in enumerate(pages) for x in (p, [-1 - k])])
    page = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    order, common = html_extract.suffix_array(tokens, 4)
    tails = [tuple(tokens[k:]) for k in range(len(tokens))]
    want = sorted(range(len(tokens)), key=lambda k: tails[k])
    assert order.tolist() == want
    for k in range(1, len(want)):
        n = next(i for i, (x, y) in enumerate(zip(tails[want[k - 1]], tails[want[k]])) if x != y)
        assert common[k] == (n if n >= 4 else 0)
    assert common.max() >= 70
    for length in (4, 7, 40):
        on = {}
        for k, p in enumerate(pages):
            for j in range(len(p) - length + 1):
                on.setdefault(tuple(p[j : j + length]), []).append(k)
        start, count = html_extract.spread(order, common, page, length)
        assert {tuple(tokens[a : a + length]): n for a, n in zip(start.tolist(), count.tolist())} == {r: len(set(w)) for r, w in on.items() if len(w) > 1}


def brute_extract(pages):
    """Template words by sets of word tuples, then the markup's say: (text, words taken by each) of each page of one host."""
    parsed = [html_extract.blocks(p or "") for p in pages]
    streams = [[w for _, _, words in p for w in words] for p in parsed]
    different = {tuple(s): k for k, s in reversed(list(enumerate(streams))) if s}

    def units(k):
        s, cuts = streams[k], np.cumsum([0] + [len(words) for _, _, words in parsed[k]]).tolist()
        out = [(c, a, a + n) for c, (n, _) in enumerate(html_extract.RUNS) for a in range(len(s) - n + 1)]
        for a in cuts[:-1]:
            z = next((z for z in cuts if z >= a + html_extract.BLOCK), None)
            out += [] if z is None else [(0, a, z)]
        return out

    on = Counter(u for k in different.values() for u in {(c, tuple(streams[k][a:z])) for c, a, z in units(k)})
    n, made = len(different), []
    for k, p in enumerate(parsed):
        s, rows = streams[k], []
        flags = [(c, m) for c, m, words in p for _ in words]
        covered = [set(), set()]
        for c, a, z in units(k):
            often = on[c, tuple(s[a:z])]
            if often >= max(3, html_extract.RUNS[c][1] * n):
                covered[0] |= set(range(a, z))
            if often >= max(10, 0.5 * n):
                covered[1] |= set(range(a, z))
        gone = {i for i, (c, m) in enumerate(flags) if i in covered[m and not c]}
        inside = sum(m and not c and i not in gone for i, (c, m) in enumerate(flags))
        outside = sum(not m and not c and i not in gone for i, (c, m) in enumerate(flags))
        keep = [i for i, (c, m) in enumerate(flags) if i not in gone and not c and (m or not inside or inside < outside)]
        made.append((" ".join(s[i] for i in keep), len(gone), len(s) - len(gone) - len(keep)))
    return made


def host_pages(rng, n, wrap):
    """Pages with a menu, a teaser, an aside with words of its own, long notices on some pages and a phrase in every article."""
    notice, long = prose(rng, 20), prose(rng, 70)
    out = []
    for k in range(n):
        body = f"<p>{prose(rng, int(rng.integers(5, 60)))} it was one of the first of its kind {prose(rng, 20)}</p>"
        body += f"<p>before {notice} after</p>" * (k % 4 == 0) + f"<p>{prose(rng, 3)} {long}</p>" * (k % 9 == 0)
        out.append(f"<nav>Home News Sport Weather</nav><div>Read on</div><div>and more</div><{wrap}>{body}</{wrap}><aside>{prose(rng, 5)}</aside><div>Follow us on every network</div>")
    return out + out[:2] + ["", None]


@pytest.mark.parametrize("wrap", ["article", "div"])
def test_extraction_against_brute_force(spark, rng, monkeypatch, wrap):
    """Texts and who took how many words, on hosts of one shard and of many."""
    monkeypatch.setattr(html_extract, "SHARD_WORDS", 400)
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 5)
    hosts = {f"h{k}.example.org": host_pages(rng, n, wrap) for k, n in enumerate((1, 2, 4, 30, 90))}
    rows = [(100 * k + j, f"http://{h}/{j}", p) for k, (h, pages) in enumerate(hosts.items()) for j, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    made = {r.page_id: (r.text, r.n_repeated, r.n_marked) for r in html_extract.extract(df).collect()}
    for k, pages in enumerate(hosts.values()):
        want = brute_extract(pages)
        assert [made[100 * k + j] for j in range(len(pages))] == want
        assert html_extract.main_texts(pages) == [t for t, _, _ in want]
    # The array takes the notices and menus of plain blocks, and nothing from the middle of sentences.
    if wrap == "div":
        assert sum(r for _, r, _ in made.values()) > 1000 and all("first of its kind" in made[400 + j][0] for j in range(90))


def test_main_container_with_a_teaser():
    """A main container that holds less than what is beside it is no reason to drop that."""
    assert html_extract.main_texts(["<div>real article text here</div><main><p>teaser</p></main>"]) == ["real article text here teaser"]
    assert html_extract.main_texts(["<div>one</div><main><p>real article text</p></main>"]) == ["real article text"]


def test_deep_nesting_is_linear():
    import time

    def cost(n):
        html = "<div><span class=x>" * n + "</p>" * n + "word"
        at = time.perf_counter()
        assert html_extract.main_texts([html]) == ["word"]
        return time.perf_counter() - at

    cost(10)
    assert cost(32_000) < 12 * cost(8_000) + 0.5


def test_template_text_without_markup(rng):
    """On pages of plain blocks, runs that a host's pages share go and unique runs stay; copied pages do not count."""
    articles = [prose(rng, 60) for _ in range(30)]
    pages = [f"<div>Home Products About Contact Imprint</div><div>{a}</div><div>Follow us on every network today</div>" for a in articles]
    assert html_extract.main_texts(pages) == articles
    copies = [f"<div>{articles[0]}</div>"] * 20
    assert html_extract.main_texts(copies) == [articles[0]] * 20


def test_extract_table(spark, rng):
    (html_extract.SHARD_WORDS, html_extract.SHARD_PAGES), before = (300, 16), (html_extract.SHARD_WORDS, html_extract.SHARD_PAGES)
    try:
        rows = [(k, f"http://h{k % 3 if k % 2 else 0}.example.org/{k}", page(f"t{k}", f"<p>{prose(rng, 30)}</p>")) for k in range(120)]
        rows += [(500, None, "<p>x</p>"), (501, "odd", None), (None, "http://h0.example.org/", ""), (0, rows[0][1], rows[0][2])]
        made = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "1 AS count", "2 AS shard"))
        got = {(r.page_id, r.url): r for r in made.collect()}
        assert made.count() == len(rows)
        for k, url, html in rows:
            want = " ".join(re.sub("<[^>]*>", " ", (re.search("<article>(.*)</article>", html or "") or re.search("()(x?)", "x"))[1]).split())
            assert got[k, url].text == (want if want else {500: "x"}.get(k, "")) and got[k, url].n_chars == len(got[k, url].text)
        assert html_extract.extract(made.selectExpr("page_id", "url", "text AS html").limit(0)).count() == 0
    finally:
        html_extract.SHARD_WORDS, html_extract.SHARD_PAGES = before


def test_template_share_is_of_the_whole_host(spark, rng):
    """A host of many shards and many copies of one page gives the texts of the same pages in one array."""
    (html_extract.SHARD_WORDS, html_extract.SHARD_PAGES), before = (300, 16), (html_extract.SHARD_WORDS, html_extract.SHARD_PAGES)
    try:
        extra = lambda k: "<div>" + "Read more of our special offers every week and every month of the whole year here now " * (k % 4 == 0) + "</div>"
        pages = [f"<div>{prose(rng, 40)}</div>{extra(k)}" for k in range(120)] + [f"<div>{prose(rng, 40)}</div>"] * 400
        rows = [(k, f"http://big.example.org/{k}", p) for k, p in enumerate(pages)]
        made = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert [made[k] for k in range(len(pages))] == html_extract.main_texts(pages)
        assert not any("special offers" in t for t in made.values()) and made[200] == made[519] != ""
    finally:
        html_extract.SHARD_WORDS, html_extract.SHARD_PAGES = before


def test_articles_outside_containers_keep_phrases(rng):
    """Phrases of a few words inside the sentences of plain blocks stay, repeated whole blocks go, menus of short blocks too."""
    phrase = "it was one of the first of its kind"
    articles = [f"{prose(rng, 30)} {phrase} {prose(rng, 30)}" for _ in range(12)]
    menu = "<div>Home</div><div>News</div><div>Sport</div><div>Weather</div><div>Imprint</div>"
    assert html_extract.main_texts([f"{menu}<div>{a}</div><div>Follow us on every network</div>" for a in articles]) == articles
    few = [f"<div>{a}</div>" + "<p>This line is on two pages of twenty alone</p>" * (k < 3) for k, a in enumerate(prose(rng, 40) for _ in range(20))]
    assert sum("This line" in t for t in html_extract.main_texts(few)) == 3


# Sound


def test_wav_round_trip_and_resampling(rng):
    import io
    import wave

    for t in ("", "a" * 191, "a" * 192, "é" * 97):
        data = audio_features.payload(t)
        assert len(data) % 192 == 0 and len(data) >= 192 and data.rstrip(b" ") == t.encode().rstrip(b" ")
        assert audio_features.from_wav(audio_features.to_wav(data)) == data
        with wave.open(io.BytesIO(audio_features.to_wav(data))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(10**6)) == (1, 1, data)
    with pytest.raises(ValueError):
        audio_features.from_wav(b"RIFF0000WAVE")
    bank = audio_features._phases()
    taps = bank[:, ::-1].T.ravel()
    for n in (1, 192, 3001):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        up = np.zeros(n * audio_features.UP)
        up[:: audio_features.UP] = (raw - 128.0) / 128
        full = np.convolve(up, taps)
        size = audio_features.length_of(n)
        got = audio_features.resample(raw, 0, size)
        lag = (bank.shape[1] - 1 - bank.shape[1] // 2) * audio_features.UP
        want = np.concatenate([full[lag :: audio_features.DOWN], np.zeros(2)])[:size]
        assert np.abs(got - want).max() < 1e-9
        for first in range(0, size, 500):
            assert np.abs(audio_features.resample(raw, first, min(size, first + 501)) - got[first : first + 501]).max() < 1e-12
    tone = (np.sin(2 * np.pi * 1000 * np.arange(24_000) / 24_000) * 100 + 128).astype(np.uint8)
    assert np.abs(np.fft.rfft(audio_features.resample(tone, 0, 16_000))[1:]).argmax() == 999


def plain_feature(data):
    """The feature of a payload by definition: whole resampling by convolution, one DFT sum per frame, hysteresis frame by frame."""
    A = audio_features
    x = (np.frombuffer(data, np.uint8) - 128.0) / 128
    n = np.arange(32) - 15.5
    h = np.sinc(n / 3) * np.hamming(32)
    up = np.zeros(2 * len(x))
    up[::2] = x
    y = np.convolve(up, 2 * h / h.sum())[14::3]
    y = np.concatenate([y, np.zeros(2)])[: -(-len(x) * 2 // 3)]
    y = np.concatenate([y, np.zeros(max(0, 400 - len(y)))])
    count = (len(y) - 400) // 160 + 1
    angle = np.exp(-2j * np.pi * np.outer(np.arange(400), np.arange(257)) / 512)
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42) / 2595) - 1)
    freq = np.arange(257) * 16_000 / 512
    bank = np.array([[max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for lo, mid, hi in zip(edge, edge[1:], edge[2:])] for f in freq])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399)
    mel = np.array([np.round(10 * np.log10((np.abs((y[160 * k : 160 * k + 400] * window) @ angle) ** 2) @ bank + 1e-6), 4) for k in range(count)]).astype(np.float32)
    energy = np.round(mel.astype(float).mean(axis=1), 6)
    floor, on, parts = sorted(energy)[count // 10], None, []
    for k, e in enumerate([*energy, -1e9]):
        if on is None and e >= floor + 3.0:
            on = k
        elif on is not None and e < floor + 1.5:
            parts.append((10.0 * on, 10.0 * (k - 1) + 25.0))
            on = None
    full = np.zeros((-(-count // 64) * 64, 40))
    full[:count] = mel
    spans = [(640.0 * t, 10.0 * (min(count, 64 * t + 64) - 1) + 25.0) for t in range(len(full) // 64)]
    digest = hashlib.sha256(np.rint(full).astype(np.int8).tobytes())
    digest.update(np.array([*spans, *parts]).round(3).tobytes())
    return f"frames={count};tensors={len(spans)};end_ms={spans[-1][1]:.1f};segments={len(parts)};active_ms={sum(z - a for a, z in parts):.1f};mel={digest.hexdigest()[:32]}"


def test_features_against_a_plain_transform(rng, monkeypatch):
    """Tensors, spans and segments of sounds, in one portion and in many."""
    texts = ["", "a", "hello world " * 30, prose(rng, 900), "x" * 5000 + prose(rng, 500) + " " * 4000 + prose(rng, 200)]
    for portion in (4096, 7):
        monkeypatch.setattr(audio_features, "PORTION", portion)
        for t in texts:
            data = audio_features.payload(t)
            assert audio_features.summary(audio_features.tensors_of(audio_features.to_wav(data))) == plain_feature(data)


def test_segments_and_tensors(spark, rng):
    energy = np.concatenate([np.zeros(50), np.full(10, 2.0), np.full(10, 5.0), np.full(10, 2.0), np.zeros(20), np.full(5, 2.0), np.zeros(10)])
    assert audio_features.segments(energy) == [(60, 80)]
    df = spark.createDataFrame([(1, prose(rng, 6000)), (2, None)], "doc_id long, text string")
    made = audio_features.tensors(audio_features.store(df)).toArrow().sort_by([("doc_id", "ascending"), ("tensor", "ascending")])
    table = audio_features.as_tensor_table(made)
    assert isinstance(table.schema.field("mel").type, pa.FixedShapeTensorType) and table.schema.field("mel").type.shape == list(audio_features.TENSOR_SHAPE)
    flat = np.array(made.column("mel").to_pylist()).reshape(-1, audio_features.MELS)
    mel, _ = audio_features.features(audio_features.payload(df.first().text))
    held = made.column("frames").to_pylist()
    assert np.abs(flat[: len(mel)] - mel).max() == 0 and sum(held[:-1]) == len(mel)
    assert made.column("start_ms").to_pylist()[:2] == [0.0, 640.0]


def test_media_digests(spark, odd):
    made = audio_features.media_digests(odd).collect()
    for r, (t,) in zip(sorted(made, key=lambda r: (r.n_bytes, r.payload_sha256)), sorted(odd.select("text").collect(), key=lambda t: (len((t[0] or "").encode()), hashlib.sha256(audio_features.payload(t[0])).hexdigest()))):
        data = audio_features.payload(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert r.media_sha256 == hashlib.sha256(audio_features.to_wav(data)).hexdigest()
    assert audio_features.media_digests(odd.limit(0)).count() == 0


# Licences


def test_licences(spark, odd):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "The license of the driver was revoked."]
    text = "\n".join(["A line of prose."] + lines)
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string").selectExpr("*", "1 AS line", "2 AS words", "3 AS family")
    made = {r.paragraph: r for r in license_scan.scan(df).collect()}
    assert [made[k].family for k in range(1, 6)] == ["apache", "mit", "gpl", "cc-by-nc", "proprietary"] and all(made[k].confirmed for k in range(1, 6))
    assert made[6].family == made[0].family == "unknown" and not made[6].confirmed and sorted(made) == list(range(7))
    assert all(0 <= r.probability <= 1 for r in made.values())
    assert license_scan.scan(odd).where("confirmed").count() == 0 and license_scan.scan(odd.limit(0)).count() == 0


def test_licence_scores_against_numpy(spark):
    m = license_scan.model()
    text = "Copyright 2021 Acme. All rights reserved under the MIT license\n\nfree software public license\n \n\nno word of it"
    made = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block").collect()
    assert [r.block for r in made] == [0, 1, 2]
    for line, r in zip([x for x in text.split("\n") if x.strip()], made, strict=True):
        z = np.array(m["bias"])
        for g in license_scan.grams(license_scan.tokens(line)):
            z = z + np.array(m["weights"].get(g, np.zeros(len(z))))
        p = np.exp((z - z.max()) / m["heat"])
        assert abs(p.max() / p.sum() - r.probability) < 1e-6


def test_family_names_alone_tell(spark):
    """A line that names only its licence is scored; German "mit" is no licence."""
    plain = {w for t in license_scan.PLAIN for w in license_scan.tokens(t)}
    assert not plain & {"mit", "apache", "gpl", "lgpl", "agpl", "bsd", "mpl", "cc", "cc0", "gnu", "mozilla", "license", "licensed", "spdx"}
    lines = ["This project is under MIT", "Our code is under MIT", "Er kam mit dem Hund in die Stadt", "Das Haus mit einer Wiese und mit der Allee ist alt", "Das Kind spielt mit Freude und mit Freunden im Garten"]
    made = {r.block: r.family for r in license_scan.scan(spark.createDataFrame([(1, "\n\n".join(lines))], "doc_id long, text string")).collect()}
    assert made == {0: "mit", 1: "mit", 2: "unknown", 3: "unknown", 4: "unknown"}


WRAPPED = {
    "mit": license_scan.NOTICES["mit"][7],
    "bsd": license_scan.NOTICES["bsd"][6],
    "gpl": license_scan.NOTICES["gpl"][1],
    "apache": license_scan.NOTICES["apache"][7],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices_are_paragraphs(spark, mark):
    """Notices wrapped at 72 columns, with comment marks and a copyright line above, are one paragraph each and confirmed."""
    import textwrap

    text = "\n\n".join(textwrap.fill(t, 72, initial_indent=mark, subsequent_indent=mark) for t in WRAPPED.values())
    text = f"{mark}Copyright (c) 2021 Some Body\n" + text + "\n\nA short line.\nAnother short line that is longer.\nReleased under the MIT License.\nThe end."
    made = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block", "paragraph").collect()
    assert [(r.block, r.paragraph, r.family) for r in made if r.confirmed] == [(0, 1, "mit"), (1, 0, "bsd"), (2, 0, "gpl"), (3, 0, "apache"), (4, 2, "mit")]
    assert [(r.block, r.paragraph) for r in made] == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 2), (4, 3)]


def test_licences_of_no_family_are_unknown(spark):
    """Names that training never saw; what models say of notices that they were not trained on."""
    lines = ["Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "Distributed under the Boost Software License, Version 1.0.", "Released under the ISC License.", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: BSL-1.0"]
    seen = {w for group in [license_scan.OTHERS, license_scan.HARD, license_scan.PLAIN, *license_scan.NOTICES.values()] for t in group for w in license_scan.tokens(t)}
    assert not seen & {"eclipse", "boost", "isc", "artistic", "bsl"}
    made = license_scan.scan(spark.createDataFrame([(1, "\n\n".join(lines))], "doc_id long, text string")).collect()
    assert len(made) == 6 and {r.family for r in made} == {"unknown"}
    assert license_scan.model()["unseen"] > 0.65


def test_feature_table(spark):
    shifts, keys, names = license_scan.table()
    assert sorted(n for n in names if n) == sorted(license_scan.model()["weights"])
    grams = ["mit", "mit license", "gnu", "é"]
    got = spark.createDataFrame([(g,) for g in grams], "g string").selectExpr("xxhash64(g) AS h", "pmod(xxhash64(3, xxhash64(g)), 1024) AS s").collect()
    assert [(r.h, r.s) for r in got] == [(license_scan.hash_of(g), license_scan._slot(3, license_scan.hash_of(g), 1024)) for g in grams]
    for k, n in enumerate(names):
        if n:
            h = license_scan.hash_of(n)
            assert keys[k] == h and license_scan._slot(shifts[h % len(shifts)], h, len(keys)) == k


def test_licence_sql(spark, rng, tmp_path):
    """The SQL of the scan on wrapped, short, long, blank, null and repeated texts."""
    import duckdb

    notices = [t for group in license_scan.NOTICES.values() for t in group]
    import textwrap

    texts = [None, "", "\n\n\n", " \n\t\n x"]
    for _ in range(60):
        parts = [str(rng.choice(notices)) if rng.random() < 0.4 else prose(rng, int(rng.integers(1, 40)), str(rng.choice(["en", "de", "fr"]))) + str(rng.choice([".", "", "?"])) for _ in range(4)]
        parts = [textwrap.fill(x, int(rng.choice([30, 60, 500]))) for x in parts]
        texts.append(str(rng.choice(["\n", "\n\n", "\n  \n"])).join(parts))
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    made = license_scan.scan(df)
    want = con.execute(license_scan.oracle_sql()).fetchall()
    names = [c[0] for c in con.description]
    assert names == made.columns
    assert sorted(tuple(r) for r in made.collect()) == sorted(want)


# Pipeline


def test_pipeline_stages(spark, rng):
    import corpus_pipeline

    rows = [(k, prose(rng, 80, lang), lang, f"s{k % 2}", 0) for k, lang in enumerate(rng.choice(["en", "de", "fr", "es"], 200))]
    rows = [(k, "Shared template line here\n" + t if k % 3 == 0 else t, lang, s, len(t)) for k, t, lang, s, _ in rows]
    rows += [(1000 + k, rows[7][1], "en", "s0", 1) for k in range(5)] + [(2000, "12345 ...", None, "s0", 9), (2001, None, "en", None, None)]
    docs = spark.createDataFrame(rows, DOC)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], "").cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    language, lines, near, packed = (set(r.doc_id for r in d.select("doc_id").collect()) for d in kept[1:])
    assert language == {r[0] for r in rows if r[0] < 2000} and lines == language
    assert all("Shared template" not in r.text and r.n_chars == len(r.text) for r in kept[2].where("doc_id < 1000").collect() if r.doc_id % 3 == 0)
    assert near == lines - set(range(1000, 1005)) and packed == near
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_stages_lose_no_document_without_a_reason(spark, rng):
    """A corpus without labels, ids that repeat with other texts, columns that clash, a very long text."""
    import corpus_pipeline

    texts = [prose(rng, 40) for _ in range(12)] + [prose(rng, 60_000), "x" * 50_000]
    rows = [(k // 2, t, None, "s", len(t)) for k, t in enumerate(texts)] + [(0, texts[0], None, "s", 1), (0, texts[0], "en", "t", 1), (9, None, None, "s", 0), (9, "1 2", None, "s", 0), (None, texts[0], None, "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    for c in ("same", "print", "fp", "group", "root", "node", "n", "id"):
        docs = docs.withColumn(c, F.lit(c))
    language = corpus_pipeline.language_stage(spark, docs, "")
    assert language.columns == docs.columns and sorted(str(r.text) for r in language.collect()) == sorted(t for _, t, *_ in rows if t and t != "1 2")
    near = corpus_pipeline.near_stage(spark, language, "")
    assert near.columns == docs.columns
    kept = near.collect()
    assert sorted(r.text for r in kept if r.doc_id is not None) == sorted(texts) and [r.text for r in kept if r.doc_id is None] == [texts[0]]


def test_near_stage_drops_what_is_similar_and_nothing_else(spark, rng):
    """Texts with one or two changed words go (Jaccard of 0.8 or more), those with many changed words stay."""
    import corpus_pipeline

    texts = [prose(rng, 150) for _ in range(40)]
    for k, changes in enumerate([1, 2, 3, 5, 8, 12] * 10):
        words = texts[k % 40].split()
        for at in rng.choice(150, changes, replace=False):
            words[at] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [texts[1].upper(), texts[2] + " tail", "a b", "a b", "A  b"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOC)
    made = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert made == {k for k in range(len(texts)) if root[k] == k} and 40 < len(made) < 90
