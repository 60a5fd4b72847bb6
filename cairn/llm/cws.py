"""Document fingerprints by improved consistent weighted sampling, as DataFrame operations.

The weighted terms of a text are its words and how often each occurs. For each of SAMPLES independent draws a
term gets, from hashes of itself, r and c of a Gamma(2, 1) and b of a uniform distribution; with weight w,

    t = floor(ln w / r + b),  ln a = ln c - r (t - b) - r,

and the draw samples the (term, t) of least a. Two texts agree in a draw with a probability that equals the
generalised Jaccard similarity of their weights. The order of ln a and 24 bits of (term, t) are one long, so
that a draw is a plain minimum, computed in generated code.

The successor of each document is found inside buckets of consecutive ids; the one document after a bucket's
last comes from a small table of the buckets' first documents. So no window spans the whole corpus.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from ..tables import staged


SAMPLES = 32
#: Documents of a bucket, about; buckets, at most about, which is the size of driver-side lists; ids of the sample for each.
BUCKET_ROWS, BUCKETS, PER_BUCKET = 128, 1 << 16, 16
#: Bits of a sample in the fingerprint.
SIG_BITS = 24


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number inside (0, 1) from `width` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def _draw(term: Column, log_weight: Column, h: int) -> Column:
    """Draw h of one weighted term: the order of ln a in the high bits, the sample in the low SIG_BITS."""
    first, second = F.xxhash64(term, F.lit(2 * h)), F.xxhash64(term, F.lit(2 * h + 1))
    r = -F.log(_uniform(first, 0, 21) * _uniform(first, 21, 21))
    b = _uniform(first, 42, 21)
    c = -F.log(_uniform(second, 0, 31) * _uniform(second, 31, 31))
    t = F.floor(log_weight / r + b)
    order = F.log(c) - r * (t.cast("double") - b) - r
    sample = F.shiftrightunsigned(term, 8).bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << SIG_BITS) - 1))
    # ln a is well inside +-128 here: c and r are products of 21- and 31-bit uniforms.
    return F.shiftleft(((order + 128.0) * float(1 << 30)).cast("bigint"), SIG_BITS).bitwiseOR(sample)


def signatures(df: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, which (0, 1, ... for each of `texts`), carry, sig array<bigint>: the samples, -1 in a text without words.

    `keys` are unique; `carry` are other numeric columns. The group of a text is made where its row is, so nothing is shuffled if `df` already is by a key.
    """
    hashed = [F.sort_array(F.transform(F.filter(F.split(F.coalesce(F.col(t), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))) for t in texts]
    words = df.select(*keys, *carry, F.posexplode(F.array(*hashed)).alias("which", "hs"))
    at = F.filter(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: (i == 0) | (F.get("hs", i) != F.get("hs", i - 1)))
    runs = words.select(*keys, *carry, "which", "hs", F.when(F.size("hs") > 0, at).otherwise(F.array().cast("array<int>")).alias("at"))
    each = F.transform("at", lambda i, j: F.struct(F.get("hs", i).alias("term"), F.log((F.coalesce(F.get("at", j + 1), F.size("hs")) - i).cast("double")).alias("lw")))
    terms = runs.select(*keys, *carry, "which", F.explode_outer(each).alias("x")).select(*keys, *carry, "which", "x.term", "x.lw")
    least = terms.groupBy(*keys, "which").agg(*[F.min(c).alias(c) for c in carry], *[F.min(_draw(F.col("term"), F.col("lw"), h)).alias(f"m{h}") for h in range(samples)])
    sig = F.array(*[F.coalesce(F.col(f"m{h}").bitwiseAND(F.lit((1 << SIG_BITS) - 1)), F.lit(-1).cast("bigint")) for h in range(samples)])
    return least.select(*keys, "which", *carry, sig.alias("sig"))


def to_hex(sig: Column) -> Column:
    """A fingerprint as text: 6 hex digits for each sample; a text without words has - in their place."""
    return F.array_join(F.transform(sig, lambda s: F.when(s < 0, F.lit("------")).otherwise(F.lower(F.lpad(F.hex(s), SIG_BITS // 4, "0")))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row: id, fingerprint. Null text: as if empty; every wordless text has the same one.

    Rows may repeat or have a null id: each is a text of its own.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).withColumn("row", F.monotonically_increasing_id())
    return signatures(rows, ["row", "id"], ["text"], samples).select(F.col("id").alias(id_col), to_hex(F.col("sig")).alias("fingerprint"))


def _bounds(ids: list[int], buckets: int) -> list[int]:
    """Least ids of buckets: quantiles of a sample; an id that is several of them gets a bucket of its own."""
    ids = sorted(ids)
    found = Counter(ids[len(ids) * k // buckets] for k in range(1, buckets)) if ids else Counter()
    return sorted({i for i in found} | {i + 1 for i, n in found.items() if n > 1 and i < (1 << 63) - 1})


def _search(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most `value`, by bisection."""
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at)) if bounds else F.lit(0)


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)


def _bucketed(df: DataFrame) -> tuple[DataFrame, list[int]]:
    """`df` (id, text) with tie (a hash of the text) and bucket, and the buckets that have rows, ascending.

    Buckets hold about as many rows each and follow the order of (id, tie), null ids first. Their bounds are quantiles of a
    bounded sample of the ids, which balances them and decides nothing else; a bucket of one id, or of null ids, that has
    many rows is split by tie.
    """
    rows = df.count()
    wanted = max(1, min(BUCKETS, rows // BUCKET_ROWS))
    size = max(BUCKET_ROWS, rows / wanted)
    ids = df.select(F.col("id").cast("bigint").alias("id"))
    sample = ids.where("id IS NOT NULL")
    if rows > wanted * PER_BUCKET:
        sample = sample.sample(wanted * PER_BUCKET / rows, seed=42)
    bounds = _bounds([r["id"] for r in sample.collect()], wanted)
    place = F.when(F.col("id").isNull(), 0).otherwise(1 + _search(bounds, F.col("id").cast("bigint")))
    counts = {r["b"]: r["n"] for r in ids.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # Buckets that can hold one id only, by their bounds, are split if they are heavy.
    single = {0} | {k + 1 for k in range(1, len(bounds)) if bounds[k] == bounds[k - 1] + 1}
    parts = [max(1, int(counts.get(b, 0) // size)) if b in single else 1 for b in range(len(bounds) + 2)]
    first = list(accumulate(parts, initial=0))
    docs = df.withColumn("tie", F.xxhash64("text"))
    if max(parts) == 1:
        return docs.withColumn("bucket", place), sorted(counts)
    # The upper half of the hash as a share of its range: in the order of ties.
    share = (F.shiftright("tie", 32) + F.lit(1 << 31)).cast("double") / float(1 << 32)
    docs = docs.withColumn("__b", place).withColumn("bucket", _lookup(first, F.col("__b")) + F.floor(share * _lookup(parts, F.col("__b"))).cast("int")).drop("__b")
    return docs, sorted(r["bucket"] for r in docs.select("bucket").distinct().collect())


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of an edited copy, and their likeness; see the columns below.

    The edited text has its last quarter (floor of the code points / 4) replaced by as many code points, or all, from
    the beginning of the next document, by ascending id and then text; the first follows the last. Returns id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text: as if empty. Null ids come
    first; rows that repeat an id are separate documents in the order of their texts. An empty table gives an empty one.
    """
    from pyspark.sql.types import IntegralType

    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError("the id column must hold integers")
    docs, used = _bucketed(df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text")))
    before = {b: used[k - 1] for k, b in enumerate(used)}
    order = W.partitionBy("bucket").orderBy("id", "tie", "text")

    # The first document of each bucket, under the bucket before it; one row a bucket.
    least = F.broadcast(docs.groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("least")).select(F.col("bucket").alias("b"), F.col("least.id").alias("i"), F.col("least.tie").alias("t")))
    first = docs.join(least, (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    first = first.groupBy("bucket").agg(F.min("text").alias("text"))
    owner = _lookup([before.get(b, 0) for b in range(max(used, default=0) + 1)], F.col("bucket"))
    first = staged(first.select(owner.alias("bucket"), "text"), "first")
    first = staged(signatures(first, ["bucket", "text"], ["text"], samples).select("bucket", F.col("text").alias("first_text"), F.col("sig").alias("first_sig")), "first")

    ranked = docs.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    cond = (F.col("d.bucket") == F.col("f.bucket")) & F.col("d.next").isNull()
    ranked = ranked.alias("d").join(first.alias("f"), cond, "left").select("d.bucket", "d.n", "d.id", "d.text", F.coalesce("d.next", "f.first_text", F.lit("")).alias("next"))
    size = F.char_length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next", F.lit(1), quarter))
    both = ranked.select("bucket", "n", "id", "text", edited.alias("edited"))
    # The digest rides along as four numbers: no second pass over the texts and no join back to them.
    digest = F.sha2("edited", 256)
    parts = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("bigint").alias(f"sha{k}") for k in range(4)]
    both = both.select("*", F.char_length("text").cast("bigint").alias("n_chars"), *parts)
    names = ("id", "n_chars", "sha0", "sha1", "sha2", "sha3")

    sigs = signatures(both, ["bucket", "n"], ["text", "edited"], samples, names)
    along = W.partitionBy("bucket").orderBy("n", "which")
    sigs = sigs.withColumn("edited_sig", F.lead("sig", 1).over(along)).withColumn("next_sig", F.lead("sig", 2).over(along)).where("which = 0")
    last = (F.col("s.bucket") == F.col("f.bucket")) & F.col("s.next_sig").isNull()
    out = sigs.alias("s").join(first.alias("f"), last, "left").select("s.*", F.coalesce("s.next_sig", "f.first_sig").alias("after_sig"))
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.concat(*[F.lower(F.lpad(F.hex(f"sha{k}"), 16, "0")) for k in range(4)]).alias("edited_sha256"),
        to_hex(F.col("sig")).alias("fingerprint"),
        to_hex(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig"), samples).alias("near_edited"),
        likeness(F.col("sig"), F.col("after_sig"), samples).alias("near_next"),
    )
