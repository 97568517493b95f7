"""Relations over chimera names: spellings, expected sizes, first differences, round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names


def separator_of(sequences: DataFrame) -> DataFrame:
    """One row: the ``separator`` that no name of any component can be mistaken for."""
    return sequences.agg(F.coalesce(F.max(names.underscore_run(F.col("chrom"))), F.lit(0)).alias("longest")).select("longest", names.separator(F.col("longest")).alias("separator"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def expected_sizes(components: DataFrame, sep: Column) -> DataFrame:
    """(component, ord, chrom, size) in the order of the built reference: components by name, each in its own order."""
    return components.select("component", "ord", names.suffixed(F.col("chrom"), F.col("component"), sep).alias("chrom"), "size")


def first_difference(built: DataFrame, expected: DataFrame, by: str = "part") -> DataFrame:
    """For each ``by``, the first place (from 0) where two ordered lists of (chrom, size) differ, and what is there.

    ``built`` and ``expected`` are (by, ord, chrom, size). A list's end counts as a difference if
    the other goes on; equal lists give no row.
    """
    numbered = lambda df, side: df.select(by, (F.row_number().over(W.partitionBy(by).orderBy("ord")) - 1).alias("place"), F.col("chrom").alias(f"{side}_chrom"), F.col("size").alias(f"{side}_size"))
    both = numbered(built, "built").join(numbered(expected, "expected"), [by, "place"], "full")
    same = F.col("built_chrom").eqNullSafe(F.col("expected_chrom")) & F.col("built_size").eqNullSafe(F.col("expected_size"))
    at = F.min(F.struct("place", "built_chrom", "built_size", "expected_chrom", "expected_size")).alias("x")
    return both.filter(~same).groupBy(by).agg(at).select(by, "x.*")


def bare_spellings(asked: DataFrame, chromosomes: DataFrame, sep: Column) -> DataFrame:
    """For bare names that no chromosome has: the suffixed spellings there are, in reference order."""
    bare = chromosomes.select("ord", F.col("chrom").alias("spelling"), names.split_suffixed(F.col("chrom"), sep)[0].alias("name"))
    return asked.join(bare, "name").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "spelling"))), lambda x: x["spelling"]).alias("spellings"))


def separator_mismatch(chromosomes: DataFrame, given: Column) -> DataFrame:
    """(given, derived) where a separator isn't the one that the chromosomes' names derive; a shorter one would come apart all the same."""
    return separator_of(chromosomes).select(given.alias("given"), F.col("separator").alias("derived")).filter("given <> derived")


def not_round_tripping(chromosomes: DataFrame, sep: Column) -> DataFrame:
    """(component, chrom) whose suffixed spelling doesn't come apart into them again."""
    chrom, component = names.split_suffixed(names.suffixed(F.col("chrom"), F.col("component"), sep), sep)
    return chromosomes.filter(~(chrom.eqNullSafe(F.col("chrom")) & component.eqNullSafe(F.col("component"))))
