"""Completion records against what is on disk; digests; the state of components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells


def disagreements(claimed: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Claimed files (key, expected) that are absent or of another size (key, actual)."""
    return claimed.join(actual, key, "left").filter(F.col("actual").isNull() | (F.col("actual") != F.col("expected")))


def gate(directories: DataFrame, claimed: DataFrame, actual: DataFrame, key: str, file: str) -> DataFrame:
    """Each directory's state: ``mismatch`` if its record disagrees, ``finished``, ``unfinished`` without record but with files, or ``fresh``."""
    wrong = disagreements(claimed, actual, [key, file]).groupBy(key).agg(F.count("*").alias("n_wrong"))
    recorded = claimed.select(key).distinct().withColumn("recorded", F.lit(True))
    held = actual.groupBy(key).agg(F.count("*").alias("n_files"))
    joined = directories.join(recorded, key, "left").join(wrong, key, "left").join(held, key, "left")
    state = F.when(F.col("n_wrong") > 0, "mismatch").when(F.col("recorded"), "finished").when(F.col("n_files") > 0, "unfinished").otherwise("fresh")
    return joined.select(key, state.alias("state"), F.coalesce("n_wrong", F.lit(0)).cast("long").alias("n_wrong"))


def unclaimed(contents: DataFrame, claimed: DataFrame, key: list[str]) -> DataFrame:
    """Contents that no record claims."""
    return contents.join(claimed.select(*key), key, "left_anti")


def component_status(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Chimeras (chimera, component, sha256) against components' digests now: changed, unchanged, or unknown if any can't be compared."""
    both = entries.join(current.select("component", F.col("sha256").alias("now")), "component", "left")
    rows = both.groupBy("chimera").agg(
        F.bool_or(cells.disagree(F.col("sha256"), F.col("now"))).alias("changed"), F.bool_and(cells.both_known(F.col("sha256"), F.col("now"))).alias("compared"), F.count("*").alias("n_components"),
    )
    return rows.select("chimera", "n_components", F.when(F.col("changed"), "changed").when(F.col("compared"), "unchanged").otherwise("unknown").alias("status"))


def expected_digest(rows: DataFrame, table: str = "table_sha256", record: str = "record_sha256") -> DataFrame:
    """The digest to expect and where it comes from: the table's pin, else the record's, else none."""
    return rows.withColumns({"expected": F.coalesce(table, record), "expected_from": F.when(F.col(table).isNotNull(), "table").when(F.col(record).isNotNull(), "record")})


def missing_components(entries: DataFrame, prepared: DataFrame) -> DataFrame:
    """Components of chimeras (chimera, component) that aren't prepared."""
    return entries.select("chimera", "component").distinct().join(prepared.select("component"), "component", "left_anti")


def index_state(indexes: DataFrame, current: DataFrame) -> DataFrame:
    """Indexes (component, sha256 of what they were built from) against digests now: ``stale``, ``current``, or ``unknown`` if either side has none."""
    both = indexes.join(current.select("component", F.col("sha256").alias("now")), "component", "left")
    state = F.when(~cells.both_known(F.col("sha256"), F.col("now")), "unknown").when(F.col("sha256") != F.col("now"), "stale").otherwise("current")
    return both.withColumn("state", state).drop("now")


def fresh(outputs: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """(key, fresh): whether an output (key, size, mtime) has content and is as new as all inputs (key, mtime) there are."""
    newest = inputs.groupBy(key).agg(F.max("mtime").alias("newest"))
    state = (F.coalesce("size", F.lit(0)) > 0) & F.coalesce(F.col("mtime") >= F.col("newest"), F.col("newest").isNull())
    return outputs.join(newest, key, "left").select(key, state.alias("fresh"))
