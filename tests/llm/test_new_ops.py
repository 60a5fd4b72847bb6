"""The co-bucketed pair, whitening and language-model scores against brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpus import prose
from pyspark.sql import functions as F

from cairn.llm import co_bucket, lm_scoring, whitening

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp, there string"
LINES = "sale_id long, line_no int, item_id long, amount double, flag string"


# --- co-bucketed pair ------------------------------------------------------------------------------------------


def test_surrogates_hit_their_partitions(spark):
    keys = co_bucket.surrogates(spark, 37)
    df = spark.createDataFrame([(n,) for n in range(37)] * 3, "n int")
    placed = co_bucket.dealt(df, F.col("n"), 37).select("n", F.spark_partition_id().alias("p")).collect()
    assert len(set(keys)) == 37 and all(r["n"] == r["p"] for r in placed)


def in_order(rows, columns):
    def part(v):
        return (0, 0) if v is None else (1, v.encode() if isinstance(v, str) else v)

    return sorted(rows, key=lambda r: ((0, 0) if r["sale_id"] is None else (1, -r["sale_id"]), *(part(r[c]) for c in columns if c != "sale_id")))


def expected(sales, lines):
    """(table, bucket) -> (rows in order, stays, lineage) in plain Python."""
    ids = {r["sale_id"] for r in sales} - {None}

    def bucket(k, known):
        return 151 if k is None else 150 if k not in known else zlib.crc32(f"pair{k}".encode()) % 150

    out = {}
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        final, came, size = defaultdict(list), defaultdict(Counter), Counter()
        for r in rows:
            b = bucket(r["sale_id"], ids)
            s = b - (b % 5 == 1) if name == "sales" else 0 if r["item_id"] is None else zlib.crc32(str(r["item_id"]).encode()) % 150
            final[b].append(r)
            came[b][s] += 1
            size[s] += 1
        for b, own in final.items():
            stays = len(came[b]) == 1 and size[next(iter(came[b]))] == len(own)
            out[name, b] = in_order(own, list(own[0])), stays, ",".join(f"{s}:{n}" for s, n in sorted(came[b].items()))
    return out


def same_files(made, sales, lines):
    want, rows = expected(sales, lines), made.collect()
    assert {(r["table_name"], r["bucket"]) for r in rows} == set(want) and len(rows) == len(want)
    ids = {n: Counter(r["sale_id"] for r in t if r["sale_id"] is not None) for n, t in (("sales", sales), ("sale_lines", lines))}
    for r in rows:
        own, stays, lineage = want[r["table_name"], r["bucket"]]
        file = pq.ParquetFile(r["path"].removeprefix("file:"))
        got = [{k: v.replace(tzinfo=None) if isinstance(v, datetime) else v for k, v in x.items()} for x in file.read().to_pylist()]
        assert got == own and r["columns"] == ",".join(own[0]) == ",".join(file.schema_arrow.names)
        assert r["n_rows"] == len(own) and r["rewritten"] == (not stays)
        assert r["ids_sha256"] == hashlib.sha256(",".join("" if x["sale_id"] is None else str(x["sale_id"]) for x in own).encode()).hexdigest()
        assert r["lineage_sha256"] == hashlib.sha256(lineage.encode()).hexdigest()
        here = [k for k in ids["sales"] if zlib.crc32(f"pair{k}".encode()) % 150 == r["bucket"]]
        assert r["n_joined"] == sum(ids["sales"][k] * ids["sale_lines"][k] for k in here)
    if rows:
        root = os.path.dirname(os.path.dirname(os.path.dirname(rows[0]["path"].removeprefix("file:"))))
        assert {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")} == {r["path"].removeprefix("file:") for r in rows}
    return rows


def shop(spark, rng, n, hot=0.0):
    def maybe(v, share=0.05):
        return None if rng.random() < share else v

    sales = [(int(rng.integers(n)), maybe(int(rng.integers(9))), maybe(["open", "done", "é", "z\U0001f600", ""][rng.integers(5)]), maybe(float(rng.integers(50))), maybe(datetime(2024, 1, 1 + int(rng.integers(20)))), "x") for _ in range(n)]
    sales += sales[:3] + [(None, 1, None, None, None, None)]
    lines = [(7 if rng.random() < hot else maybe(int(rng.integers(2 * n))), int(rng.integers(3)), maybe(int(rng.integers(n))), maybe(1.5), "kept") for _ in range(3 * n)]
    return spark.createDataFrame(sales, SALES), spark.createDataFrame(lines + lines[:3], LINES)


@pytest.mark.parametrize(("n", "hot"), [(12, 0.0), (400, 0.4)])
def test_pair_against_brute_force(spark, rng, n, hot):
    sales, lines = shop(spark, rng, n, hot)
    as_rows = [[r.asDict() for r in t.collect()] for t in (sales, lines)]
    rows = same_files(co_bucket.shop_pair(sales, lines), *as_rows)
    assert {r["rewritten"] for r in rows} == {True, False}


def test_pair_of_empty_tables(spark, rng):
    sales, lines = shop(spark, rng, 5)
    as_rows = [[r.asDict() for r in t.collect()] for t in (sales, lines)]
    assert co_bucket.shop_pair(sales.limit(0), lines.limit(0)).count() == 0
    same_files(co_bucket.shop_pair(sales, lines.limit(0)), as_rows[0], [])
    rows = same_files(co_bucket.shop_pair(sales.limit(0), lines), [], as_rows[1])
    assert {r["bucket"] for r in rows} <= {150, 151}


def test_pair_files_of_more_partitions(spark, rng):
    sales, lines = shop(spark, rng, 40)
    as_rows = [[r.asDict() for r in t.collect()] for t in (sales, lines)]
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        same_files(co_bucket.shop_pair(sales, lines), *as_rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_digest_wants_runs_together(spark):
    runs = spark.createDataFrame([(3, 9, 2, 0, 2), (3, 8, 1, 1, 1)], "bucket int, k long, n long, first long, last long")
    with pytest.raises(Exception, match="stand together"):
        co_bucket.id_digests(runs, 5).collect()


# --- whitening -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spectrum", [np.exp(-np.arange(150) / 5), 1 + 1 / (1 + np.arange(150)), np.linspace(70, 60, 64), np.array([5, 5, 5, 0, 0.0])], ids=["decaying", "flat", "close", "equal"])
def test_subspace_is_certified(rng, spectrum):
    d = len(spectrum)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * spectrum) @ q.T
    values, vectors, residual, passes = whitening.subspace(lambda block: v @ block, d, 16, 32)
    assert residual <= whitening.TOLERANCE and passes < 20
    assert np.allclose(values, np.sort(spectrum)[::-1][:16], rtol=0, atol=1e-12 * spectrum.max())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def whitened(rows, k):
    """Plain whitening of (id, vector) rows with a dense covariance."""
    x = {i: np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = fit - total / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return {i: (int(((n * v.astype(object) - total) ** 2).sum()), (v - total / n) @ q / np.sqrt(e)) for i, v in x.items()}, n, e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("dim", [3, 24])
def test_whitening_against_dense(spark, rng, dim):
    good = [(i, (rng.standard_normal(dim) * (1 + np.arange(dim))).tolist()) for i in range(300)]
    good += [(300 + i, good[0][1]) for i in range(200)]  # a hot vector is fitted once
    bad = [(900, None), (901, [None] * dim), (902, [1.0] * (dim - 1) + [math.nan]), (903, [math.inf] * dim), (904, [1.0] * (dim + 1)), (905, []), (906, [1e30] * dim)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("id", "x", "d", "component", "n")})
    rows = whitening.whiten(df, k=5, block=6).collect()
    want, n, explained = whitened(good, 5)
    k = min(5, dim)
    assert len(rows) == k * len(good) and {r["n"] for r in rows} == {n}
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r["whitened"]
        assert r["deviation"] == want[r["vec_id"]][0] and abs(r["explained"] - explained[r["component"] - 1]) < 1e-12 and r["identity_error"] < 1e-10
    signs = [np.sign(got[0][c] * want[0][1][c - 1]) for c in range(1, k + 1)]
    assert all(abs(got[i][c] * signs[c - 1] - w[c - 1]) < 1e-9 for i, (_, w) in want.items() for c in range(1, k + 1))


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 2.0]), (1, [1.0, 2.0])], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], round(abs(r["whitened"]), 9)) for r in rows) == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0)]


def test_deviation_beyond_a_long_is_null(spark):
    rows = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [6e13]), (3, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in rows}[2] is None and len(rows) == 3


# --- language-model scores ------------------------------------------------------------------------------------


def plain_scores(rows, strength, order):
    """(n_tokens, n_known, N, base, score) of (text, learn) rows by the formulas."""
    docs = [["<s>", *(t or "").encode().lower().split(), "</s>"] for t, _ in rows]
    c = Counter(tuple(d[j - k : j]) for d, (_, learn) in zip(docs, rows, strict=True) if learn for k in range(1, order + 1) for j in range(k, len(d) + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in c)

    def p(h, w):
        if not h:
            return (c[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        a, b = strength[len(h) - 1]
        m = a * max(1, c[h]) ** b
        return (c[(*h, w)] + m * p(h[1:], w)) / (c[h] + m)

    out = []
    for d in docs:
        base = sum(math.log10(p((), w)) for w in d[1:])
        out.append((len(d) - 1, sum(c[(w,)] > 0 for w in d[1:]), n, base, sum(math.log10(p(tuple(d[max(0, j - order + 1) : j]), d[j])) for j in range(1, len(d)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_scores_against_formulas(spark, rng, odd, order, small, monkeypatch):
    if small:  # texts of several pieces, bundles of a few words
        monkeypatch.setattr(lm_scoring, "BUNDLE", 300)
        odd = odd.withColumn("text", F.substring("text", 1, 4000))
    more = spark.createDataFrame([(100 + i, prose(rng, int(rng.integers(40))) + (" \n" * 200 if i % 7 == 0 else " odd%d" % i), "en", "a", 0) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    df = odd.unionByName(more, allowMissingColumns=True).repartition(3, "doc_id")
    strength = ((4.0, 0.8), (2.0, 0.9), (1.0, 1.0))
    learn = F.pmod(F.col("doc_id"), F.lit(5)) != 1
    got = [tuple(r) for r in lm_scoring.score(df, learn, order, strength).collect()]
    rows = df.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn")).collect()
    want = plain_scores([(r["text"], r["learn"]) for r in rows], strength, order)
    assert len(got) == len(rows)
    near = lambda i, ok, a, b, c, x, y: (-1 if i is None else i, ok, a, b, c, round(x, 4), round(y, 4))
    for g, w in zip(sorted(near(*g) for g in got), sorted(near(r["doc_id"], r["learn"], *w) for r, w in zip(rows, want, strict=True)), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 2e-4 and abs(g[6] - w[6]) < 2e-4


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_sums_to_one(order):
    """Over all known tokens, the end and an unknown one, after known and unknown histories."""
    learn, histories, words = b"a b a c a b", [b"", b"a", b"b", b"a b", b"b a", b"c zz", b"zz a"], [b"a", b"b", b"c", b"unseen"]
    rows = [(0, True, learn, [lm_scoring.BEGIN], True, True, 0)]
    rows += [(1, False, h + b" " + w, [lm_scoring.BEGIN], True, False, 0) for h in histories for w in [b"", *words]]
    rows += [(2, False, h, [lm_scoring.BEGIN], True, True, 0) for h in histories]
    bundle = lm_scoring.Bundle(lm_scoring.Bundle.made(rows, pa.int64()), order, 64)
    counts = bundle.counts
    auto = lm_scoring.Automaton(bundle, counts, 7, 4, lm_scoring.STRENGTH)
    score = [auto.read(a, f, z) for a, f, z in zip(bundle.start, bundle.first, bundle.start[1:], strict=False)]
    for i in range(len(histories)):
        alone, *after = score[1 + 5 * i : 6 + 5 * i]
        assert abs(sum(10 ** (x - alone) for x in [*after, score[1 + 5 * len(histories) + i]]) - 1) < 1e-12


def test_scores_without_training_or_rows(spark, odd):
    none = lm_scoring.score(odd, F.lit(False)).collect()
    assert len(none) == odd.count() and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)
    assert lm_scoring.score(odd.limit(0), F.lit(True)).count() == 0
    empty = lm_scoring.score(spark.createDataFrame([(1, None), (2, " "), (2, " ")], "doc_id long, text string"), F.col("doc_id") == 1).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in empty] == [(1, 1, 1)] * 3 and len({r["score"] for r in empty}) == 1


def test_held_out_follows_the_id(spark, odd):
    rows = lm_scoring.score_corpus(odd).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
