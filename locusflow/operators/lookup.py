"""Metadata lookups: the first row that a name matches, totals for names that none does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_assembly(asked: DataFrame, table: DataFrame) -> DataFrame:
    """For each ``name``, the first row by ``ord`` whose ucsc_name or assembly_name it is: two equality joins, the least place kept.

    A null ucsc_name matches nothing.
    """
    row = F.struct("ord", *[c for c in table.columns if c != "ord"]).alias("row")
    by = lambda column: asked.join(table.select(F.col(column).alias("name"), row), "name")
    found = by("ucsc_name").unionByName(by("assembly_name"))
    return found.groupBy("name").agg(F.min_by("row", F.col("row.ord")).alias("row")).select("name", "row.*")


def assembly_or_unknown(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Every name: its row, or a record that has the name alone."""
    found = asked.join(first_assembly(asked.distinct(), table), "name", "left")
    return found.withColumn("assembly_name", F.coalesce("assembly_name", "name"))


def annotation(asked: DataFrame, table: DataFrame) -> DataFrame:
    """For each (assembly, name), the table's first row by ``ord``."""
    keys = ["assembly", "name"]
    rest = [c for c in table.columns if c not in keys]
    first = table.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("row")).select(*keys, "row.*")
    return asked.join(first, keys)
