"""What is known of each run while its rows arrive: running cost and latest stage, as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "seen bigint, n bigint, ema double, stage string, percent int"


class RunState(StatefulProcessor):
    """Folds the rows of a run, (ordinal, value, stage, percent), into (seen, n, ema, stage, percent), which is kept
    between batches: seen counts all rows, n those with a value.

    ema is keep * before + (1 - keep) * value; the first value starts it. A batch's rows of a
    run are taken by ordinal, two numbers of each are held meanwhile; batches are taken as they come. Null values count as no row of the cost, rows without a
    stage leave stage and percent as they are.
    """

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, n, ema, stage, percent = self.state.get() if self.state.exists() else (0, 0, None, None, None)
        order, value, last = [], [], None
        for part in rows:
            seen += len(part)
            known = part[part["value"].notna()]
            order.append(known["ordinal"].to_numpy())
            value.append(known["value"].to_numpy(float))
            staged = part[part["stage"].notna()]
            if len(staged):
                at = staged["ordinal"].to_numpy().argmax()
                now = (staged["ordinal"].iloc[at], staged["stage"].iloc[at], int(staged["percent"].iloc[at]))
                last = now if last is None or now[0] > last[0] else last
        for v in np.concatenate(value)[np.argsort(np.concatenate(order), kind="stable")].tolist():
            ema = v if ema is None else self.keep * ema + (1 - self.keep) * v
            n += 1
        if last:
            _, stage, percent = last
        self.state.update((seen, n, ema, stage, percent))
        yield pd.DataFrame({"run": [key[0]], "seen": [seen], "n": [n], "ema": [ema], "stage": [stage], "percent": pd.array([percent], dtype="Int32")})

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that this needs, for streams that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def follow(rows: DataFrame, keep: float = 0.7) -> DataFrame:
    """A stream of (run, ordinal, value, stage, percent) to one of (run, seen, n, ema, stage, percent): a row for each run with rows in a batch.

    The row of a run with the greatest `seen` is its latest; start it within rocks_state().
    """
    kind = dict(rows.dtypes)["run"]
    asked = rows.where("run IS NOT NULL").select("run", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("value").cast("double").alias("value"), "stage", F.col("percent").cast("int").alias("percent"))
    return asked.groupBy("run").transformWithStateInPandas(RunState(keep), f"run {kind}, {STATE}", "append", "none")


def advance(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str, keep: float = 0.7, files: int = 1000) -> None:
    """Take in the Parquet files that `source` has got since the last call, some files a batch, and add what follows to `sink`."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    with rocks_state(spark):
        query = follow(rows, keep).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """(run, n, ema, stage, percent) of each run now."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("run").agg(*[F.max_by(c, "seen").alias(c) for c in ("n", "ema", "stage", "percent")])
