"""What assembly names mean: components to be put together, or a FASTA to be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, names


def sources(asked: DataFrame, recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, kind, components, url, derived, error) of asked (name).

    ``recorded`` is (name, components) of the records here, components null for a plain assembly;
    ``listed`` is (name, source_url) of the curated table. In this order: a record here says what
    the assembly is; else a name whose parts are all recorded or listed is a chimera, an error if
    they aren't in order; else it is read from the listed URL or, ``derived``, from the usual one.
    """
    asked = asked.select("name").distinct()
    records = recorded.select("name", F.lit(True).alias("here"), F.col("components").alias("known"))
    parts = asked.select("name", F.explode(names.split_name(F.col("name"))).alias("part"))
    could_be = recorded.select(F.col("name").alias("part")).unionByName(listed.select(F.col("name").alias("part"))).distinct()
    whole = parts.join(could_be.withColumn("_hit", F.lit(1)), "part", "left").groupBy("name").agg((F.count("_hit") == F.count("*")).alias("spelled"))
    rows = asked.join(records, "name", "left").join(whole, "name", "left").join(listed.select("name", "source_url"), "name", "left")
    spelled = F.col("here").isNull() & F.coalesce("spelled", F.lit(False))
    split = names.split_name(F.col("name"))
    canonical = names.derive_name(split)
    good = spelled & (canonical == F.col("name"))
    kind = F.when(spelled & ~good, "misspelled").when(good | F.col("known").isNotNull(), "components").otherwise("fetch")
    rows = rows.withColumn("kind", kind)
    fetched = F.col("kind") == "fetch"
    return rows.select(
        "name", "kind", F.when(F.col("kind") == "components", F.coalesce("known", split)).alias("components"),
        F.when(fetched, F.coalesce("source_url", cells.golden_path_url(F.col("name")))).alias("url"), F.when(fetched, F.col("source_url").isNull()).alias("derived"),
        F.when(F.col("kind") == "misspelled", F.concat(F.lit("components are in order in a chimera's name: "), canonical)).alias("error"),
    )
