"""An extension: folders watched as streams. Each micro-batch runs the batch operators on what arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import region
from ..operators import annotation, fetch
from ..sources import gtf


def watch_gtf(spark: SparkSession, folder: str, sizes: DataFrame, checkpoint: str, accept: Callable[[DataFrame], None], refuse: Callable[[DataFrame], None]) -> StreamingQuery:
    """GTF lines as they arrive: features of known chromosomes go to ``accept``, names the assembly lacks to ``refuse``."""

    def batch(found: DataFrame, _: int) -> None:
        rows = gtf.features(found.withColumn("line_ord", F.monotonically_increasing_id()))
        known = sizes.select(F.col("chrom").alias("seqname"))
        accept(rows.join(known, "seqname", "left_semi"))
        refuse(annotation.missing_chromosomes(rows, sizes))

    return spark.readStream.text(folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def resolve_loci(loci: DataFrame, sizes: DataFrame) -> DataFrame:
    """A stream (rid, locus) parsed and resolved against an assembly's sizes, by a stream-static join."""
    parsed = loci.select("rid", *[c.alias(k if k != "error" else "malformed") for k, c in region.parse(F.col("locus")).items()])
    return fetch.resolved(parsed, sizes).withColumn("error", F.coalesce("malformed", "error")).drop("malformed")
