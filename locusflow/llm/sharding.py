"""Operator 6, sharding: a two-pass external shuffle into shards of near-equal row counts.

Pass one hashes every record with a seed into buckets that fit in memory and counts them, which
fixes where each bucket starts in the shuffled order. Pass two brings each bucket's records
together, permutes them by Spark's ``shuffle`` (an inside-out Fisher-Yates) and numbers them.
Numbers are cut into runs of equal length, one for each shard, so counts are at most one apart.
Records that repeat in full would all hash alike: where they overfill a bucket, they are numbered
and dealt to buckets in chunks of their numbers. Every record travels itself, whatever it is alike to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, numbered, running_offsets, text_or_empty, without

#: There are at most so many buckets, larger ones beyond: their (bucket, offset, n), 24 bytes each, are sent to every task that permutes indices.
MOST_BUCKETS = 1_000_000


def record_size(text: str | Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the record's frame."""
    return (F.octet_length(text_or_empty(text)) + 16).cast("long")


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 17, bucket_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """Every record of ``docs``, all its columns, with ``shard`` (int) and ``slot`` (long, from 0 without gaps).

    The law is ``rows``: shards' counts are at most one apart, in a seeded random order. Reruns on
    the same records agree, whatever the files or partitions they come in.

    Nulls in any column, and within lists, structs and maps, are values like others, and so is -0.0.
    Rows repeated in full are kept as often as they come; as they can't be told apart, any of them
    has any of their places. Maps of the same entries in another order count as different. Empty
    input gives no rows; with fewer rows than shards, some shards stay empty. Columns of ``docs``
    named ``shard`` or ``slot`` give way to the result's; any other name is free.
    """
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot")
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    hashed = [c for c, kind in zip(columns, kinds, strict=True) if "map<" not in kind]
    # A hash takes nulls within values as absent, zeros as one and no maps at all: such columns are spelled out as well.
    deep = [c for c, kind in zip(columns, kinds, strict=True) if "<" in kind or kind in ("float", "double")]
    spelled = [F.to_json(F.struct(*deep), {"ignoreNullFields": "false"}), F.struct(*deep).cast("string")] if deep else []
    digest = lambda n: F.xxhash64(F.lit(n), *[c.isNull() for c in hashed], *hashed, *spelled)
    size = record_size(F.col(text_col))
    keyed = docs.select(F.struct(digest(seed).alias("a"), digest(~seed).alias("b")).alias("key"), size.alias("size"), F.struct(*columns).alias("record"))
    bytes_, rows = docs.agg(F.sum(size), F.count("*")).first()
    buckets = min(MOST_BUCKETS, max(1, math.ceil((bytes_ or 0) / bucket_bytes)))
    most = 2 * max(bucket_bytes, math.ceil((bytes_ or 0) / buckets))
    into = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("long")
    keyed = keyed.withColumn("bucket", into(F.col("key")))

    full = keyed.groupBy("bucket").agg(F.sum("size").alias("held")).filter(F.col("held") > most).select("bucket")  # few
    often = keyed.join(F.broadcast(full), "bucket").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    often = checkpointed(often.filter((F.col("held") > most) & (F.col("n") > 1)).withColumn("run", F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("n") / F.col("held"))).cast("long")))
    if often.limit(1).count():
        mine = keyed.join(F.broadcast(often.select("key", "run")), "key", "left")  # at most one for each bucket's bytes
        copies = numbered(mine.filter("run IS NOT NULL"), ["key"], "copy", Scratch(spark, "sharding"))
        again = copies.withColumn("bucket", into(F.col("key"), F.expr("copy div run")))
        keyed = mine.filter("run IS NULL").select("key", "size", "record", "bucket").unionByName(again.select("key", "size", "record", "bucket"))

    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = checkpointed(running_offsets(counts, "bucket", "n"))
    # The indices are permuted over a range, whose partitions and order never change, so the seed decides alone.
    numbers = spark.range(0, buckets, 1, max(1, math.ceil(buckets / 64))).withColumnRenamed("id", "bucket")
    orders = numbers.join(F.broadcast(starts), "bucket").select("bucket", "offset", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("order"))

    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    filled = keyed.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "record")), by_key).alias("records"))
    dealt = filled.join(orders, "bucket").select(
        F.explode(F.transform("order", lambda at, i: F.struct((F.col("offset") + i).alias("rank"), F.element_at("records", at + 1)["record"].alias("record")))).alias("x")
    )
    number = f"(x.rank * {n_shards} div {max(1, rows)})"
    first = f"({number} * {rows} + {n_shards - 1}) div {n_shards}"
    return dealt.select("x.record.*", F.expr(number).cast("int").alias("shard"), F.expr(f"x.rank - {first}").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes a folder for each shard: files of successive slots, each in the order of its slots, as many as the ranges give."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("errorifexists").partitionBy("shard").parquet(path)
    )
