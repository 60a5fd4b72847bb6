"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it.

Features are hashed counts of letter n-grams (1 to 3) over the whole text, case folded, with everything
that is no letter as a word end. The family level is one linear SVM per family against the others; within a family
each pair of languages has a linear SVM of its own, and the languages vote. All are L2-regularised,
squared-hinge machines, solved by Newton's method, so training is deterministic.

Training takes a bounded sample: about PER_LANGUAGE labelled rows of each language, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import balanced

#: Labelled rows that training takes of each language at most, and of all together, about, but EACH of a language: this bounds the sample.
PER_LANGUAGE, SAMPLE, EACH = 400, 40_000, 16
#: The prediction for a text without a letter, and for texts with one where there is no model.
UNDETERMINED, NO_MODEL = "und", "zxx"
#: Hashed features.
WIDTH = 1 << 12
#: Families of languages, fixed values; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Code points whose n-grams are counted at once, and bytes of texts and rows whose features are held at once.
PORTION, SLICE, ROWS = 1 << 17, 2 << 20, 512


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams of code points."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
        gram = h
        for n in (1, 2, 3):
            if n > 1:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h[n - 1 :]
            mixed = gram * np.uint32(0xC2B2AE3D)
            yield mixed >> np.uint32(20)  # 12 bits: WIDTH


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram shares of a whole text, of length one; None for a text without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter | np.concatenate([[False], letter[:-1]])  # one word end after each run of letters
    codes = np.where(letter, codes, 32)[keep]
    codes = np.concatenate([[32], codes, [32]] if codes[-1] != 32 else [[32], codes])
    count = np.zeros(WIDTH)
    for at in range(0, len(codes), PORTION):
        for gram in _hashes(codes[at : at + PORTION + 2]):
            count += np.bincount(gram[:PORTION], minlength=WIDTH)
    root = np.sqrt(count)
    return (root / np.sqrt(count.sum())).astype(np.float32)


def _letters(cache: list = []) -> np.ndarray:  # noqa: B006
    """Which code points are letters."""
    if not cache:
        cache.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool))
    return cache[0]


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 20.0) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + penalty * sum(max(0, 1 - y(xw+b))^2), classes weighted evenly; Newton with conjugate gradients."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    cost = penalty * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w = np.zeros(x.shape[1], x.dtype)
    cost, y = cost.astype(x.dtype), y.astype(x.dtype)
    for _ in range(12):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = w - 2 * x[on].T @ (cost[on] * y[on] * slack[on])
        if np.linalg.norm(grad) < 1e-3 * max(1, np.linalg.norm(w)):
            break
        xa, ca = x[on], 2 * cost[on]
        step, r = np.zeros_like(w), -grad
        p, rr = r.copy(), r @ r
        for _ in range(25):
            hp = p + xa.T @ (ca * (xa @ p))
            a = rr / (p @ hp)
            step += a * p
            r -= a * hp
            new = r @ r
            if new < 1e-6 * (grad @ grad):
                break
            p = r + (new / rr) * p
            rr = new
        size, loss = 1.0, _loss(x, y, cost, w)
        while _loss(x, y, cost, w + size * step) > loss and size > 1e-4:
            size /= 2
        w = w + size * step
    return w[:-1], float(w[-1])


def _loss(x: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray) -> float:
    return 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of a sigmoid that turns margins into probabilities, by a short maximum-likelihood search."""
    slopes = np.geomspace(0.5, 8, 17)
    return float(slopes[np.argmin([np.log1p(np.exp(-np.clip(s * y * margin, -50, 50))).sum() + 0.05 * s for s in slopes])])


@dataclass
class Model:
    """Columns of `weights`: first one machine per family, then one per pair of languages of a family."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each row of features."""
        margin = x @ self.weights + self.bias
        odds = 1 / (1 + np.exp(-np.clip(self.slope * margin, -50, 50)))
        n = len(self.families)
        best = margin[:, :n].argmax(axis=1)
        langs: list[str] = []
        score = odds[np.arange(len(x)), best] if n > 1 else np.ones(len(x))
        for row, family in enumerate(best):
            names = self.members[family]
            votes, sums, sure = np.zeros(len(names)), np.zeros(len(names)), {}
            for k, (f, a, b) in enumerate(self.pairs, n):
                if f == family:
                    won, lost, p = (a, b, odds[row, k]) if margin[row, k] >= 0 else (b, a, 1 - odds[row, k])
                    votes[won] += 1
                    sums[a] += margin[row, k]
                    sums[b] -= margin[row, k]
                    sure[won, lost] = p
            pick = max(range(len(names)), key=lambda i: (votes[i], sums[i], -i))
            langs.append(names[pick])
            score[row] *= min([p for (w, _), p in sure.items() if w == pick], default=1.0)
        return langs, np.clip(score, 0.0, 1.0)


def train(x: np.ndarray, lang: list[str], families: dict[str, str] | None = None) -> Model:
    """Fit the family machines on all rows, and each pair's machine on the rows of its two languages."""
    family_of = {name: (FAMILY if families is None else families).get(name, name) for name in set(lang)}
    names = sorted(set(family_of.values()))
    members = [sorted(k for k, v in family_of.items() if v == f) for f in names]
    y = np.array(lang, object)
    fam = np.array([family_of[k] for k in lang], object)
    weights, bias, slope, pairs = [], [], [], []

    def fit(rows: np.ndarray, sign: np.ndarray) -> None:
        w, b = svm(x[rows], sign) if len(set(sign)) > 1 else (np.zeros(x.shape[1]), 1.0)
        weights.append(w)
        bias.append(b)
        slope.append(_slope(x[rows] @ w + b, sign))

    for f in names:
        fit(np.arange(len(x)), np.where(fam == f, 1.0, -1.0))
    for f, langs in enumerate(members):
        for a, b in combinations(range(len(langs)), 2):
            rows = np.flatnonzero((y == langs[a]) | (y == langs[b]))
            fit(rows, np.where(y[rows] == langs[a], 1.0, -1.0))
            pairs.append((f, a, b))
    return Model(names, members, pairs, np.array(weights, np.float32).T.copy(), np.array(bias, np.float32), np.array(slope, np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """Is crc32 of the id as text, modulo 4, equal to 2 (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the labelled rows of `df` that are not held out; None if there are none.

    The sample: up to PER_LANGUAGE rows with a letter of every language, fewer if there are more than SAMPLE / PER_LANGUAGE
    languages. Only their features go to the driver, 16 kB each.
    """
    known = df.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(EACH, min(PER_LANGUAGE, SAMPLE // len(counts)))
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.2 * most / n))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    some = known.withColumn("place", place).where(F.col("place") < F.coalesce(F.element_at(rate, F.col("lang")), F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 0, SLICE):
            made = [features(t) for t in batch.column(0).to_pylist()]
            there = [k for k, x in enumerate(made) if x is not None]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(there, pa.int64())), batch.column(2).take(pa.array(there, pa.int64())), pa.array([made[k].tobytes() for k in there], pa.binary())], ["lang", "place", "x"])

    from pyspark.sql import Window as W

    taken = some.select("text", "lang", "place").mapInArrow(run, "lang string, place double, x binary")
    taken = taken.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("place", "x"))).where(F.col("n") <= most)
    rows = sorted(taken.select("lang", "x").collect())
    if not rows:
        return None
    return train(np.array([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def language(df: DataFrame, model: Model | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` of `df`, then lang_pred and score; `und` and 0 where the text is null or has no letter; `zxx` and 0 where it has one and there is no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = len(columns)
        for batch in balanced(batches, text, SLICE):
            langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(text)
            for at in range(0, batch.num_rows, ROWS):
                made = {at + k: x for k, t in enumerate(texts.slice(at, ROWS).to_pylist()) if (x := features(t)) is not None}
                found, sure = model.predict(np.array(list(made.values()))) if model and made else ([NO_MODEL] * len(made), np.zeros(len(made)))
                scores[list(made)] = sure
                for k, name in zip(made, found, strict=True):
                    langs[k] = name
            kept = [batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(f"c{k}" for k in range(len(columns))), "lang_pred", "score"])

    kinds = [df.select(F.col(f"`{c}`")).schema[0].dataType.simpleString() for c in columns]
    schema = ", ".join([f"c{k} {kind}" for k, kind in enumerate(kinds)] + ["lang_pred string", "score double"])
    out = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col(text_col).alias("__text")).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "lang_pred", "score")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `df`: id, held_out, lang_pred, score. Learns from the rows of `df` that are not held out.

    A null language is no label; a null id is not held out; other columns are not read. Without any labelled row there is
    no learned value: every prediction is `und`.
    """
    model = fit(df, id_col, text_col, lang_col)
    found = language(df, model, [id_col], text_col)
    lang = F.when(F.col("lang_pred") == NO_MODEL, UNDETERMINED).otherwise(F.col("lang_pred")) if model is None else F.col("lang_pred")
    return found.select(id_col, held_out(id_col).alias("held_out"), lang.alias("lang_pred"), "score")
