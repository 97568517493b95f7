"""Sizes of references and what aligners' indexes take from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def genome_shape(sizes: DataFrame, *by: str) -> DataFrame:
    return sizes.groupBy(*by).agg(F.sum("size").cast("long").alias("genome_length"), F.count("*").alias("n_sequences"), F.avg("size").alias("mean_length"))


def sa_index_nbases(length: Column) -> Column:
    return F.least(F.lit(14), F.greatest(F.lit(2), (F.log2(length) / 2 - 1).cast("int")))


def chr_bin_nbits(mean: Column, overhang: int = 100) -> Column:
    return F.least(F.lit(18), F.log2(F.greatest(mean, F.lit(float(overhang + 1)))).cast("int"))


def index_parameters(sizes: DataFrame, *by: str, overhang: int = 100) -> DataFrame:
    shape = genome_shape(sizes.filter("size > 0"), *by)
    return shape.select(*by, sa_index_nbases(F.col("genome_length")).alias("sa_index_nbases"), chr_bin_nbits(F.col("mean_length"), overhang).alias("chr_bin_nbits"))


def fai(records: DataFrame, by: str = "component") -> DataFrame:
    """FASTA index entries of (by, ord, chrom, size, header_bytes, width): length, offset, bases and bytes a line.

    A file's records follow one another: header line, then lines of ``width`` bases.
    """
    body = F.col("size") + F.ceil(F.col("size") / F.col("width"))
    before = F.sum(F.col("header_bytes") + 1 + body).over(W.partitionBy(by).orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    offset = F.coalesce(before, F.lit(0)) + F.col("header_bytes") + 1
    return records.select(by, "ord", "chrom", F.col("size").alias("length"), offset.cast("long").alias("offset"), F.least("width", "size").cast("long").alias("line_bases"), (F.least("width", "size") + 1).cast("long").alias("line_width"))
