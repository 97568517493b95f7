"""Annotations: names checked against an assembly, features, merges, status and the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, names
from . import order


def data_lines(lines: DataFrame) -> DataFrame:
    """GTF lines (``value``) that carry data: no comments, and at least one tab."""
    return lines.filter(~F.startswith("value", F.lit("#")) & F.contains("value", F.lit("\t")))


def seqname(line: Column) -> Column:
    return F.substring_index(line, "\t", 1)


def distinct_chromosomes(features: DataFrame) -> DataFrame:
    return features.select("seqname").distinct()


def missing_chromosomes(features: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sequence names that the assembly lacks; the other direction is no fault."""
    known = sizes.select(F.col("chrom").alias("seqname"))
    return distinct_chromosomes(features).join(known, "seqname", "left_anti")


def merged_lines(lines: DataFrame, sep: Column) -> DataFrame:
    """GTF data lines of several components (component, ord, value), suffixed in column 1, all else to the byte."""
    first = seqname(F.col("value"))
    return data_lines(lines).select("component", "ord", F.concat(names.suffixed(first, F.col("component"), sep), F.substring("value", F.length(first) + 1, F.length("value"))).alias("value"))


def numbered_ids(rows: DataFrame, part: Column, within: list[str | Column]) -> DataFrame:
    """``rows`` (feature, named, ...) with a unique ``id``: ``named``, from its second row on with ``_1``, ``_2``, ..., in order.

    Rows that nothing names are called after their feature, with a number from 1. ``part`` and
    ``within`` are the order, see :func:`locusflow.operators.order.numbered`.
    """
    called = rows.withColumns({"_nameless": F.col("named").isNull(), "_stem": F.coalesce("named", "feature", F.lit(""))})
    counted = order.numbered(called, ["_nameless", "_stem"], part, within, "_k")
    number = F.when(F.col("_nameless"), F.concat_ws("_", "_stem", F.col("_k") + 1)).when(F.col("_k") == 0, F.col("_stem")).otherwise(F.concat_ws("_", "_stem", "_k"))
    return counted.withColumn("id", number).drop("_nameless", "_stem", "_k")


def unique_ids(found: DataFrame) -> DataFrame:
    """GTF features (feature, attributes, line_ord) with unique ids in the order of their lines: a gene's ``gene_id``, a transcript's ``transcript_id``."""
    value = lambda name: F.element_at(F.try_element_at("attributes", F.lit(name)), 1)
    named = F.when(F.col("feature") == "gene", value("gene_id")).when(F.col("feature") == "transcript", value("transcript_id"))
    split = F.struct(F.col("line_ord.block"), F.shiftright("line_ord.id", 33))  # the split of a file that a task read
    return numbered_ids(found.withColumn("named", named), split, ["line_ord"]).drop("named")


def inferred(exons: DataFrame, feature: str, id_col: str) -> DataFrame:
    """The extent of each transcript or gene over its exons."""
    return exons.groupBy("seqname", "strand", id_col).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("feature", F.lit(feature))


def status(offered: DataFrame, registered: DataFrame, broken: DataFrame) -> DataFrame:
    """(assembly, name): offered (with ``ord``), registered and broken, joined in full, with ``state``.

    Offered ones sort by ``ord``, the rest behind them by name: order by (ord is null, ord, name).
    """
    keys = ["assembly", "name"]
    flagged = lambda df, name: df.select(*keys, F.lit(True).alias(name))
    both = offered.select(*keys, "ord", F.lit(True).alias("offered")).join(flagged(registered, "registered"), keys, "full").join(flagged(broken, "broken"), keys, "full")
    filled = both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("offered", "registered", "broken")})
    return filled.withColumn("state", cells.annotation_state(F.col("broken"), F.col("offered"), F.col("registered")))


def defaults(rows: DataFrame) -> DataFrame:
    """The default of each assembly from (assembly, name, ord, default, registered, explicit): said, else first flagged, else the sole one registered."""
    flagged = F.min(F.when(F.col("default"), F.struct("ord", "name")))["name"]
    sole = F.when(F.sum(F.col("registered").cast("int")) == 1, F.max(F.when(F.col("registered"), F.col("name"))))
    return rows.groupBy("assembly").agg(F.coalesce(F.max("explicit"), flagged, sole).alias("default_annotation"))


def contributions(rows: DataFrame) -> DataFrame:
    """What each assembly of (assembly, name, registered) with its ``default_annotation`` gives a chimera.

    ``contributes`` its default if that is registered, ``unregistered`` if it isn't, ``ambiguous`` if
    there are registered ones and no default, and ``nothing`` otherwise.
    """
    here = F.count_if(F.col("registered"))
    has = F.bool_or(F.col("registered") & (F.col("name") == F.col("default_annotation")))
    found = rows.groupBy("assembly").agg(F.max("default_annotation").alias("default_annotation"), here.alias("n_registered"), F.coalesce(has, F.lit(False)).alias("_has"))
    state = F.when(F.col("default_annotation").isNull(), F.when(F.col("n_registered") > 0, "ambiguous").otherwise("nothing")).when(F.col("_has"), "contributes").otherwise("unregistered")
    return found.select("assembly", "default_annotation", "n_registered", state.alias("state"))


def merged_names(parts: DataFrame, key: str = "name") -> DataFrame:
    """(key, merged): contributing annotations (key, part_ord, annotation) joined with ``+`` in order; null where none contributes."""
    held = F.array_sort(F.collect_list(F.when(F.col("annotation").isNotNull(), F.struct("part_ord", "annotation"))))
    joined = F.array_join(F.transform(held, lambda x: x["annotation"]), "+")
    return parts.groupBy(key).agg(F.nullif(joined, F.lit("")).alias("merged"))
