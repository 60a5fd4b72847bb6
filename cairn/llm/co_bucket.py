"""Two tables in the same hash buckets, one sorted file per table and bucket, placed by surrogate partition keys.

Spark deals rows to partition pmod(murmur3(key), n). For each partition an integer is looked up beforehand whose
hash hits just that partition; a row of bucket b carries the integer of partition b, so an ordinary
repartition() puts each crc32 bucket into the partition, and by that into the part file, of its own number.
Sorting and writing are Spark's own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import shared_dir, staged

#: Repeats of one id that are hashed at once.
REPEATS = 1 << 14


def surrogates(spark: SparkSession, n: int) -> list[int]:
    """For each of `n` partitions the least integer from 0 that hash partitioning sends there."""
    upto, found = 16 * n + 64, {}
    while len(found) < n:
        k = F.col("id").cast("int")
        found = dict(spark.range(upto).groupBy(F.pmod(F.hash(k), F.lit(n)).alias("at")).agg(F.min(k)).collect())
        upto *= 4
    return [found[at] for at in range(n)]


def dealt(df: DataFrame, number: Column, numbers: int) -> DataFrame:
    """`df` with the rows of `number` (0 to numbers - 1) in the partition of that number, alone.

    There are as many partitions as the session asks for, if that is more than `numbers`.
    """
    spark = df.sparkSession
    n = max(numbers, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = F.array(*[F.lit(k) for k in surrogates(spark, n)])
    return df.repartition(n, F.element_at(keys, (number + 1).cast("int")))


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def write_numbered(df: DataFrame, number: Column, numbers: int, folder: str, key: str) -> None:
    """One part file per number, holding the columns of `df`, by `key` descending and the others ascending, nulls first."""
    order = [_name(key).desc_nulls_first(), *[_name(c).asc_nulls_first() for c in df.columns if c != key]]
    dealt(df, number, numbers).sortWithinPartitions(*order).write.parquet(folder)


def crc_bucket(key: Column, salt: str, buckets: int) -> Column:
    """Unsigned crc32 of `salt` and the decimal key, mod `buckets`."""
    return F.crc32(F.concat(F.lit(salt), key.cast("string"))) % buckets


class _Folder:
    """The part files of a folder by their numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        self.files = {int(m[1]): x for x in names if (m := re.match(r"part-(\d+)-.*\.parquet$", x))}

    def keep(self, numbers: set[int]) -> None:
        """Delete all part files but those of `numbers`. Spark leaves an empty file for a partition 0 without rows; it goes too."""
        for number in [*self.files]:
            if number not in numbers:
                self._fs.delete(self._make(f"{self.path}/{self.files.pop(number)}"), False)

    def read(self, spark: SparkSession, without: set[int] = frozenset()) -> DataFrame | None:
        """Rows with `_metadata`; the schema is that of the files."""
        paths = [f"{self.path}/{x}" for number, x in sorted(self.files.items()) if number not in without]
        return spark.read.parquet(*paths) if paths else None


def file_number() -> Column:
    return F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("int")


@dataclass
class Side:
    """A table of the pair: its rows, and the number of the file in which each one starts."""

    name: str
    rows: DataFrame
    start: Column


def _started(side: Side, root: str, key: str, numbers: int) -> _Folder:
    spark = side.rows.sparkSession
    at = f"{root}/{side.name}/start"
    write_numbered(side.rows, side.start, numbers, at, key)
    folder = _Folder(spark, at)
    read = folder.read(spark)
    # Partition 0 writes a file even without rows.
    if 0 in folder.files and read.where(file_number() == 0).isEmpty():
        folder.keep({*folder.files} - {0})
    return folder


def _final(side: Side, root: str, key: str, numbers: int, start: _Folder, bucket, known: DataFrame | None):
    """Write the final files of a table. (start number -> bucket of files that stay, final folder, moves s, b, n).

    `bucket` gives a row's bucket from its key and from whether the other table has that key.
    """
    spark = side.rows.sparkSession
    k, there = _name(key), F.col("there")
    none = spark.createDataFrame([], "s int, b int, n long")
    read = start.read(spark)
    if read is None:
        return {}, _Folder(spark, f"{root}/{side.name}/final"), none

    def told(df: DataFrame) -> DataFrame:
        # A hot key is a skewed side of this join, which Spark splits; the other side has each key once.
        return df.withColumn("there", F.lit(True)) if known is None else df.join(known.hint("merge"), "k", "left").withColumn("there", F.coalesce("there", F.lit(False)))

    counted = read.select(k.alias("k"), file_number().alias("s")).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"))
    moves = staged(told(counted).groupBy("s", bucket(F.col("k"), there).cast("int").alias("b")).agg(F.sum("n").alias("n")), "moves")
    one_b = moves.groupBy("s").agg(F.count(F.lit(1)).alias("bs"), F.min("b").alias("b")).where("bs = 1")
    one_s = moves.groupBy("b").agg(F.count(F.lit(1)).alias("ss")).where("ss = 1")
    stays = {r["s"]: r["b"] for r in one_b.join(one_s, "b").select("s", "b").collect()}  # at most one per file number
    target = f"{root}/{side.name}/final"
    rest = start.read(spark, without={*stays})
    if rest is not None:
        rows = told(rest.select(k.alias("k"), F.struct(*[_name(c) for c in rest.columns]).alias("row")))
        b = bucket(F.col("k"), there)
        columns = [F.col("row").getField(c).alias(c) for c in rest.columns]
        order = [F.col("row").getField(key).desc_nulls_first(), *[F.col("row").getField(c).asc_nulls_first() for c in rest.columns if c != key]]
        dealt(rows, b, numbers).sortWithinPartitions(*order).select(*columns).write.parquet(target)
    final = _Folder(spark, target)
    final.keep({r["b"] for r in moves.select("b").distinct().collect()} - {*stays.values()})
    start.keep({*stays})
    return stays, final, moves


def id_digests(runs: DataFrame, numbers: int) -> DataFrame:
    """(bucket, n_rows, ids_sha256) from `runs` (bucket, k, n, first, last): the sha256 of comma-joined ids in file order.

    A run is all rows of an id in a file. A hot id is one row here, so a bucket's task streams its distinct ids only.
    """

    def row(bucket: int, n: int, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["bucket", "n_rows", "ids_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, digest, n = None, None, 0
        for batch in batches:
            for b, k, count, first, last in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if b != bucket:
                    if digest:
                        yield row(bucket, n, digest)
                    bucket, digest, n = b, hashlib.sha256(), 0
                if first != n or last != first + count - 1:
                    raise ValueError(f"the rows of id {k!r} don't stand together in the file of bucket {b}")
                text = ("," + (k or "")).encode()
                if not n:
                    digest.update(text[1:])
                left = count - (not n)
                for at in range(0, left, REPEATS):
                    digest.update(text * min(REPEATS, left - at))
                n += count
        if digest:
            yield row(bucket, n, digest)

    placed = dealt(runs.select("bucket", F.col("k").cast("string").alias("k"), "n", "first", "last"), F.col("bucket"), numbers)
    return placed.sortWithinPartitions("bucket", "first").mapInArrow(run, "bucket int, n_rows long, ids_sha256 string")


def co_bucket(left: Side, right: Side, key: str = "sale_id", salt: str = "pair", buckets: int = 150, root: str | None = None) -> DataFrame:
    """Write both tables under a new folder and rewrite them there, one file per table and bucket; a row per final file.

    A row's bucket is crc_bucket of its key. Keys of `right` that `left` has not go to `buckets`, null keys of either to
    buckets + 1. Start files come first, by the numbers of the sides (0 to buckets + 1). A start file stays if the final
    file of a bucket has just its rows; all others are read again, and deleted once the final files are there.
    Nothing that grows with the tables reaches the driver: file numbers, names and the numbers that stay do.

    The result has table_name, path, columns, bucket, n_rows, n_joined (pairs of an inner join of the bucket), ids_sha256,
    lineage_sha256 and rewritten; rows, ids and columns are those read back. An empty table has no file and no row.
    Columns may have any names; they must be of types that Spark can sort. Rows that are equal are kept each.
    """
    spark = left.rows.sparkSession
    root = root or f"{shared_dir(spark)}/pair-{uuid.uuid4().hex}"
    numbers = buckets + 2
    starts = [_started(side, root, key, numbers) for side in (left, right)]

    def bucket(k: Column, there: Column) -> Column:
        return F.when(k.isNull(), buckets + 1).when(~there, buckets).otherwise(crc_bucket(k, salt, buckets))

    ids = starts[0].read(spark)
    kind = left.rows.select(_name(key)).dtypes[0][1]
    known = spark.createDataFrame([], f"k {kind}") if ids is None else ids.select(_name(key).alias("k")).where("k IS NOT NULL").distinct()
    known = staged(known, "keys").withColumn("there", F.lit(True))
    out, runs = [], []
    for side, start, there in ((left, starts[0], None), (right, starts[1], known)):
        stays, final, moves = _final(side, root, key, numbers, start, bucket, there)
        parts = []
        for folder, of in ((start, stays), (final, None)):
            read = folder.read(spark)
            if read is not None:
                number = F.element_at(F.array(*[F.lit(of.get(s, -1)) for s in range(numbers)]), file_number() + 1) if of else file_number()
                parts.append((read.columns, read.select(number.alias("bucket"), _name(key).alias("k"), F.col("_metadata.row_index").alias("i"))))
        if not parts:
            runs.append(spark.createDataFrame([], f"bucket int, k {kind}, n long, first long, last long"))
            continue
        rows = parts[0][1].unionByName(parts[1][1]) if len(parts) > 1 else parts[0][1]
        runs.append(staged(rows.groupBy("bucket", "k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last")), "runs"))
        files = [(b, f"{start.path}/{start.files[s]}", False) for s, b in stays.items()] + [(b, f"{final.path}/{x}", True) for b, x in final.files.items()]
        named = spark.createDataFrame(files, "bucket int, path string, rewritten boolean")
        line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws(":", x["s"], x["n"])), ",")
        lineage = moves.groupBy(F.col("b").alias("bucket")).agg(F.sha2(line, 256).alias("lineage_sha256"))
        out.append(id_digests(runs[-1], numbers).join(lineage, "bucket").join(named, "bucket").withColumns({"table_name": F.lit(side.name), "columns": F.lit(",".join(parts[0][0]))}))
    a, b = (r.select("bucket", "k", F.col("n").alias(f"n{i}")) for i, r in enumerate(runs))
    joined = a.join(b.hint("merge"), ["bucket", "k"]).groupBy("bucket").agg(F.sum(F.col("n0") * F.col("n1")).alias("n_joined"))
    columns = ["table_name", "path", "columns", F.col("bucket").cast("long").alias("bucket"), "n_rows", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), "ids_sha256", "lineage_sha256", "rewritten"]
    if not out:
        return spark.createDataFrame([], "table_name string, path string, columns string, bucket long, n_rows long, n_joined long, ids_sha256 string, lineage_sha256 string, rewritten boolean")
    made = out[0].unionByName(out[1]) if len(out) > 1 else out[0]
    return made.join(joined, "bucket", "left").select(*columns)


def shop_pair(sales: DataFrame, lines: DataFrame, buckets: int = 150, salt: str = "pair") -> DataFrame:
    """`sales` and `sale_lines` in the same buckets. Sales start in the file of their bucket, or of the one before if
    that is 1 mod 5; lines in that of their item's crc32, 0 without item."""
    k = F.col("sale_id")
    b = F.when(k.isNull(), buckets + 1).otherwise(crc_bucket(k, salt, buckets))
    item = F.col("item_id")
    return co_bucket(Side("sales", sales, b - (b % 5 == 1).cast("int")), Side("sale_lines", lines, F.coalesce(crc_bucket(item, "", buckets), F.lit(0))), "sale_id", salt, buckets)
