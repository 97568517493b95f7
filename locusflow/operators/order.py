"""Numbers and sums in the order of rows, in two levels: within ranges of the order, then over the ranges' totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(df: DataFrame, keys: Sequence[str], part: Column, within: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: how many rows of equal ``keys`` come before each.

    Rows are ordered by ``part``, a range of the order of bounded length, and within it by
    ``within``. A window sees a key's rows of one range, another a row for each range, so that
    no key, however frequent, meets in one task.
    """
    ranged = df.withColumn("_part", part)
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = ranged.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*within)) - 1)
    return own.join(counts, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")
