"""What several training-data operators share: checkpointing, input shaping, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import checkpoint_dir as checkpoint_dir
from ..scratch import checkpointed as checkpointed

#: ASCII white space as the operators' contracts define it, and what lies between.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables of one operator's run in the shared checkpoint folder, each dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.place = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back."""
        df.write.option("compression", "zstd").parquet(f"{self.place}/{name}")
        return self.spark.read.parquet(f"{self.place}/{name}")

    def close(self) -> None:
        """Drops all that is left."""
        self.drop("")

    def drop(self, *names: str) -> None:
        for name in names:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    """A table of ``sf_dir``; with ``columns``, these alone."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator's result uses itself."""
    return df.drop(*names)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: str | Column) -> Column:
    """A-Z in lower case and all else, other scripts' capitals too, as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_offsets(df: DataFrame, key: str, n: str, group: int = 1024) -> DataFrame:
    """Adds ``offset``, the sum of ``n`` over all smaller integer ``key``.

    Two levels: within runs of ``group`` keys, then over the runs' totals, so that the one
    window without a partition sees a row for each run only.
    """
    runs = df.withColumn("_run", F.floor(F.col(key) / group))
    before = F.sum(n).over(W.partitionBy("_run").orderBy(key).rowsBetween(W.unboundedPreceding, -1))
    totals = runs.groupBy("_run").agg(F.sum(n).alias("_total"))
    first = F.sum("_total").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("_run", F.coalesce(first, F.lit(0)).alias("_first"))
    return (
        runs.withColumn("_before", F.coalesce(before, F.lit(0)))
        .join(starts, "_run")
        .withColumn("offset", F.col("_before") + F.col("_first"))
        .drop("_run", "_before", "_first")
    )


def numbered(df: DataFrame, keys: list[str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``, the number (long, from 0 without gaps) of each row among those of equal ``keys``, in no particular order.

    Rows are numbered within the tasks that write them, and tasks' numbers follow each other, so
    that no key, however frequent, meets in one task. The rows are written, for their numbers to stay.
    """
    held = scratch.table(df.withColumn("_at", F.monotonically_increasing_id()), f"numbered-{name}").withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = held.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_at")) - 1)
    return own.join(before, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part", "_at")


#: Bits of a sieve: 64 for each entry of an array of fixed length (2 MB), however many hashes it holds.
SIEVE_BITS = 1 << 24


def sieve(hashes: DataFrame) -> Column:
    """A set of the hashes in the one long column of ``hashes``, as a subquery of fixed size: see :func:`may_hold`."""
    spot = F.pmod(F.col(hashes.columns[0]), F.lit(SIEVE_BITS)).cast("long")
    held = hashes.select(spot.alias("h")).groupBy(F.expr("h div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    dense = hashes.sparkSession.range(0, SIEVE_BITS // 64, 1, 1).join(held, "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("a")).select(F.col("a.b")).scalar()


def may_hold(bits: Column, hash_: Column) -> Column:
    """False only for hashes that a sieve doesn't hold; the fuller it is, the more others pass."""
    spot = F.pmod(hash_, F.lit(SIEVE_BITS)).cast("long")
    return F.getbit(F.get(bits, F.shiftright(spot, 6).cast("int")), F.pmod(spot, F.lit(64)).cast("int")) == 1


def slices(batch, column: str, most: int) -> Iterator:
    """Consecutive slices of a batch, each of about ``most`` bytes in ``column`` or of one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
