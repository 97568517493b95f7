"""GTF as features: 0-based half-open inside, attributes with all their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotation import data_lines, merged_lines

ATTRIBUTE = r'(\w[\w.-]*)\s+"([^"]*)"'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_ord, value): lines in file order, bytes that are no UTF-8 replaced."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("line_ord"), F.make_valid_utf8("value").alias("value"))


def features(found: DataFrame) -> DataFrame:
    """Typed features of data lines; attribute values are sorted and distinct, as the reference's database keeps them. Coordinates that are no numbers are null, with an ``error``."""
    parts = F.split("value", "\t")
    cell = lambda i: F.try_element_at(parts, F.lit(i))
    keys, values = (F.regexp_extract_all(cell(9), F.lit(ATTRIBUTE), F.lit(g)) for g in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    attributes = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))))
    return data_lines(found).select(
        cell(1).alias("seqname"), cell(2).alias("source"), cell(3).alias("feature"), (cell(4).try_cast("bigint") - 1).alias("start"), cell(5).try_cast("bigint").alias("end"), cell(6).alias("score"), cell(7).alias("strand"), cell(8).alias("frame"),
        F.coalesce(attributes, F.expr("map()").cast("map<string,array<string>>")).alias("attributes"), "line_ord",
        F.when(cell(4).try_cast("bigint").isNull() | cell(5).try_cast("bigint").isNull(), "a coordinate is no number").alias("error"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return features(lines(spark, path))


def merged(sources: list[tuple[str, DataFrame]], separator: str) -> DataFrame:
    """(component, ord, value): components' data lines in component order, column 1 suffixed."""
    every = None
    for i, (component, found) in enumerate(sources):
        mine = merged_lines(found.select(F.lit(component).alias("component"), F.struct(F.lit(i).alias("part"), "line_ord").alias("ord"), "value"), F.lit(separator))
        every = mine if every is None else every.unionByName(mine)
    return every


def write_merged(sources: list[tuple[str, DataFrame]], path: str, separator: str) -> None:
    """Components' GTF lines as one: text files that follow each other in the order of their names."""
    merged(sources, separator).repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.text(path)
