"""Curated gene lists: (annotation, assembly, category, cat_ord, gene_ord, gene_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contributing(contributors: DataFrame, lists: DataFrame) -> DataFrame:
    """The lists of an annotation's contributors (name, part_ord, annotation); those without a list drop out."""
    return contributors.join(lists, "annotation")


def gene_list(parts: DataFrame, key: list[str]) -> DataFrame:
    """Ids of each ``key`` in the order of contributors and of each list, never made distinct, with their number."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_ord", "gene_ord", "gene_id"))), lambda x: x["gene_id"])
    return parts.groupBy(*key).agg(ordered.alias("gene_ids"), F.count("*").alias("n_genes"))


def sources(parts: DataFrame, key: list[str]) -> DataFrame:
    """Genes of each contributor to each ``key``."""
    return parts.groupBy(*key, "annotation", "part_ord").agg(F.count("*").alias("n_genes"))


def declared(parts: DataFrame, key: list[str]) -> DataFrame:
    """Categories in the order in which contributors first declare them."""
    first = parts.groupBy(*key, "category").agg(F.min(F.struct("part_ord", "cat_ord")).alias("at"))
    return first.select(*key, "category", F.col("at.part_ord").alias("part_ord"), F.col("at.cat_ord").alias("cat_ord"))


def repeated_genes(lists: DataFrame) -> DataFrame:
    """Gene ids that a list has more than once, over all its categories."""
    return lists.groupBy("annotation", "gene_id").agg(F.count("*").alias("n")).filter("n > 1")


def faults(lists: DataFrame) -> DataFrame:
    """(annotation, category, error): a blank description or source, no genes, a blank gene, a gene twice in a category or in two."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    prose = lists.filter(blank("description") | blank("source")).select("annotation", "category", F.lit("prose is blank").alias("error")).distinct()
    empty = lists.groupBy("annotation", "category").agg(F.count("gene_id").alias("n")).filter("n = 0").select("annotation", "category", F.lit("no genes").alias("error"))
    unnamed = lists.filter(F.trim("gene_id") == "").select("annotation", "category", F.lit("a gene is blank").alias("error")).distinct()
    held = lists.filter(F.trim("gene_id") != "").groupBy("annotation", "gene_id", "category").agg(F.count("*").alias("n"))
    twice = held.filter("n > 1").select("annotation", "category", F.concat(F.lit("gene repeats: "), "gene_id").alias("error"))
    several = held.groupBy("annotation", "gene_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("c")).filter("n > 1")
    several = several.select("annotation", F.lit(None).cast("string").alias("category"), F.concat("gene_id", F.lit(" is in several categories: "), "c").alias("error"))
    return prose.unionByName(empty).unionByName(unnamed).unionByName(twice).unionByName(several)


def wrong_assembly(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (annotation, assembly) whose list is another assembly's; lists refuse rather than filter."""
    mine = lists.select("annotation", F.col("assembly").alias("list_assembly")).distinct()
    return asked.join(mine, "annotation").filter(F.col("assembly") != F.col("list_assembly"))
