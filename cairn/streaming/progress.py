"""Progress of a run from its log lines, in batch and as a stream, and running costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of log lines and the share of the whole run at which their stages begin, fixed values.
STAGES = (("features", 0.0), ("match", 0.2), ("tracks", 0.4), ("sfm", 0.45), ("dense", 0.7), ("clean", 0.92), ("pipeline] Done", 1.0))


def _by_stage(line: Column, values: list) -> Column:
    out = F.when(line.contains(STAGES[0][0]), values[0])
    for (word, _), value in zip(STAGES[1:], values[1:], strict=True):
        out = out.when(line.contains(word), value)
    return out


def parse(lines: DataFrame, col: str = "line") -> DataFrame:
    """Lines of a known stage, with stage and percent (0 to 100); a fraction a/b places the line within its stage."""
    line = F.col(col)
    starts = [s for _, s in STAGES]
    spans = [max(b - a, 0.0) for a, b in zip(starts, [*starts[1:], 1.0], strict=True)]
    done, total = (F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", k).try_cast("double") for k in (1, 2))
    share = F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(0.0)
    overall = _by_stage(line, starts) + _by_stage(line, [F.lit(round(s, 6)) for s in spans]) * share
    staged = lines.withColumns({"stage": _by_stage(line, [w for w, _ in STAGES]), "percent": F.bround(overall * 100).cast("int")})
    return staged.where(F.col("stage").isNotNull())


def latest(lines: DataFrame, order: str) -> DataFrame:
    """One row: the stage and percent of the last line of a known stage."""
    return parse(lines).agg(F.max_by("stage", order).alias("stage"), F.max_by("percent", order).alias("percent"))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Log files that arrive in a folder, as a stream of parsed lines; write it with a checkpoint location of its own."""
    return parse(spark.readStream.text(folder).withColumnRenamed("value", "line"))


def ema(rows: DataFrame, key: str, order: list[str], col: str, keep: float = 0.7) -> DataFrame:
    """(key, n, ema): keep * before + (1 - keep) * value, folded in order; the first value starts it.

    A closed form over windows, so that a long key is no list in one row: the sum of value * weight, where the
    weight of a row is (1 - keep) * keep ^ (rows after it), and keep ^ (n - 1) for the first.
    """
    from pyspark.sql import Window as W

    ranked = rows.select(key, col, F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order])).alias("after"))
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    power = F.pow(F.lit(keep), (F.col("after") - 1).cast("double"))
    weight = F.when(F.col("after") == F.col("n"), power).otherwise(power * (1 - keep))
    return ranked.join(total, key).groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col(col) * weight).alias("ema"))
