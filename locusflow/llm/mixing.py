"""Operator 1, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

A target in words for each source comes from the weights, limited to ``cap`` passes over the
source (water-filling). The targets are turned into whole blocks of ``block`` words by the highest
quotients t / (2k + 1), first among sources, then among each source's shards. Within a shard the
documents stand in a seeded order; its quota is taken as whole passes plus one run of blocks from
a seeded start. Everything is arithmetic on positions: no row is made for a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, checkpointed, numbered, without, word_count

ADDED = ("size", "source_size", "target", "taken", "passes", "head_words", "part_from", "part_words", "shard", "skey")

#: Up to so many sources (some 20 MB) are sent to every task; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_key(source: str) -> Column:
    """A string that sorts sources by code point with null last, and is never null itself."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target): ``share`` of all words by weight, none over ``cap`` x its size.

    Sources in order of cap / weight fill up first; the level that the rest reaches is
    (total - full ones' caps) / (rest's weights), taken at the first source that stays below its cap.
    """
    place = F.row_number().over(W.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", limit)
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    every, before = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(every)["level"]
    target = F.coalesce(F.least("limit", reached * F.col("weight")), F.col("limit"))
    return ranked.select("skey", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: Sequence[str], name: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: each group's ``seats`` dealt among its rows by the highest quotients weight / (2k + 1).

    With n parties the last quotient awarded lies between those of seats - n/2 and seats + n/2, so
    each party's seats below the one bound are sure and only those between, some 3n, are ranked.
    """
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total, n = F.sum(F.col(weight).cast("double")).over(over), F.count("*").over(over)
    at = lambda s: F.when(F.col("_total") > 0, F.col(weight) * (s / F.col("_total"))).otherwise(F.lit(0.0))
    bounded = parties.withColumns({"_total": total, "_n": n}).withColumns(
        {"_sure": F.greatest(F.lit(0), F.floor(at(F.col(seats) - F.col("_n") / 2) + 0.5) - 1), "_most": F.greatest(F.lit(0), F.floor(at(F.col(seats) + F.col("_n") / 2) + 0.5) + 1)}
    )
    left = bounded.withColumn("_left", F.col(seats) - F.sum("_sure").over(over))
    asked = left.filter((F.col(weight) > 0) & (F.col("_most") > F.col("_sure"))).select(*group, name, "_left", F.col(weight).alias("_w"), F.explode(F.expr("sequence(_sure, _most - 1)")).alias("_seat"))
    asked = asked.withColumn("_rank", F.row_number().over(over.orderBy(F.desc(F.col("_w") / (2 * F.col("_seat") + 1)), name, "_seat")))
    won = asked.filter(F.col("_rank") <= F.col("_left")).groupBy(*group, name).agg(F.count("*").alias("_won"))
    return left.join(won, [*group, name], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_total", "_n", "_sure", "_most", "_left", "_won")


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def number_of(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


#: Up to so many sets of rows alike (some 20 MB) are sent to every task; more are joined by shuffle.
BROADCAST_ALIKE = 100_000


def _runs(rows: DataFrame, repeats: int) -> DataFrame:
    """``rows`` (skey, _digest, size, ...) with ``_run``: the number of each among those alike, div ``repeats``."""
    alike = ["skey", "_digest", "size"]
    often = checkpointed(rows.filter("size > 0").groupBy(*alike).agg(F.count("*").alias("_n")).filter(F.col("_n") > repeats).select(*alike))
    n = often.limit(BROADCAST_ALIKE + 1).count()
    if not n:
        return rows.withColumn("_run", F.lit(0).cast("long"))
    often = F.broadcast(often) if n <= BROADCAST_ALIKE else often
    counted = numbered(rows.join(often, alike, "left_semi"), alike, "_run", Scratch(rows.sparkSession, "mixing"))
    others = rows.join(often, alike, "left_anti").withColumn("_run", F.lit(0).cast("long"))
    return others.unionByName(counted.withColumn("_run", F.expr(f"_run div {repeats}")))


def mix(
    docs: DataFrame, size: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11,
    block_words: int = 256, shard_words: int = 2_000_000, shard_rows: int = 4_096, repeats: int = 1_024, id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and what is taken.

    ``taken`` is ``passes`` whole copies, the first ``head_words`` words and ``part_words`` words
    from word ``part_from`` on (a run that wraps round can end and begin in one row); see
    :func:`mixed_rows`. ``size`` counts a row's words (default: of ``text``). A block has
    ``block_words`` words, or fewer where the smallest target would have under 1,000 blocks. A
    source has a shard for each ``shard_words`` words or ``shard_rows`` rows with words, whichever
    are more. Rows without words take no part in a shard's order.

    A null source is a source, last in order; null texts have size 0 and nothing taken. Repeated
    rows count each. The seeded order is that of a digest of the id and the text (if there is one),
    then size; both choose the shard, and so does the number of a row among those alike, in runs of
    ``repeats``: alike rows are interchangeable, and no shard gets all of them. No rows give no rows;
    sources without words have target 0. Columns of ``docs`` named as the result's own give way; any
    other name is free.
    """
    size = word_count("text") if size is None else size
    record = F.struct(*[F.col(f"`{c}`") for c in without(docs, *ADDED).columns])
    content = [F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.col("text").isNull()] if "text" in docs.columns else []
    wide = docs.select(record.alias("_record"), source_key(source_col).alias("skey"), size.cast("long").alias("size"), seeded(seed, F.col(id_col), *content).alias("_digest"))
    wide = _runs(wide, repeats)
    narrow = checkpointed(wide.select("skey", "size", "_digest", "_run"))
    totals = checkpointed(narrow.groupBy("skey").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("_rows")))
    sources = checkpointed(targets(totals.select("skey", "source_size"), weights, share, cap).join(totals.select("skey", "_rows"), "skey"))
    least, total, n_sources = sources.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("target"), F.count("*")).first()
    block = int(min(block_words, max(1, (least or 0) // 1000)))
    seats = int((total or 0) / block + 0.5)
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_rows") / shard_rows))
    sources = apportion(sources.withColumns({"_seats": F.lit(seats), "_parts": parts}), [], "skey", "target", "_seats").withColumnRenamed("quota", "_seats2").drop("_seats", "_rows")
    sources = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources

    into = lambda df: df.join(sources, "skey").withColumn("shard", F.pmod(number_of(F.md5(F.concat_ws("|", "_digest", "size", "_run"))), F.col("_parts")))
    cells = into(narrow).groupBy("skey", "shard").agg(F.sum("size").alias("cell"), F.max("_seats2").alias("_seats2"))
    cells = apportion(cells, ["skey"], "shard", "cell", "_seats2")
    n = F.ceil(F.col("cell") / block)
    cells = cells.withColumn("n", n).withColumn("quota", F.least("quota", F.floor(F.lit(float(cap)) * F.col("n"))))
    cells = cells.withColumns({"passes": F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(0), "run": F.when(F.col("n") > 0, F.expr("quota % n")).otherwise(0)})
    begin = F.when(F.col("n") > 0, F.pmod(number_of(seeded(seed, F.col("skey"), F.col("shard"))), F.col("n"))).otherwise(0)
    cells = cells.withColumn("_begin", begin).select(
        "skey", "shard", "passes", (F.col("_begin") * block).alias("a1"), F.least("cell", (F.col("_begin") + F.col("run")) * block).alias("b1"), F.greatest(F.lit(0), (F.col("_begin") + F.col("run") - F.col("n")) * block).alias("b2")
    )

    spread = F.when(F.col("size") > 0, F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(4_096)))  # their sums are 0 in any order
    order = W.partitionBy("skey", "shard", "_spread").orderBy("_digest", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = into(wide).withColumn("_spread", spread).withColumn("_from", F.coalesce(F.sum("size").over(order), F.lit(0)))
    both = placed.join(checkpointed(cells), ["skey", "shard"])
    start, end = F.col("_from"), F.col("_from") + F.col("size")
    late = F.greatest(F.lit(0), F.least(end, F.col("b1")) - F.greatest(start, F.col("a1")))
    early = F.greatest(F.lit(0), F.least(end, F.col("b2")) - start)
    both = both.withColumns({"_late": late, "_early": early})
    columns = {"taken": F.col("passes") * F.col("size") + F.col("_late") + F.col("_early"), "head_words": F.col("_early"), "part_from": F.when(F.col("_late") > 0, F.greatest(start, F.col("a1")) - start).otherwise(0), "part_words": F.col("_late")}
    return both.select("_record.*", "size", "source_size", "target", F.col("passes").cast("int").alias("passes"), *[c.cast("long").alias(k) for k, c in columns.items()])


def mixed_rows(mixed: DataFrame, columns: Sequence[str], text_col: str = "text") -> DataFrame:
    """The mix itself: ``columns`` of each row once for each whole pass and once for each part taken, cut to it.

    A part of all words is the text as it is; a shorter one keeps the white space before its words.
    Texts without words come once for each whole pass; rows that repeat are taken each as
    :func:`mix` says, and an empty table gives no rows. ``columns`` may not be named ``_copy``.
    """
    pieces = F.split(text_col, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = lambda start, n: F.when(n == F.col("size"), F.col(text_col)).otherwise(F.array_join(F.slice(pieces, start.cast("int") + 1, n.cast("int")), ""))
    head, part = F.col("head_words"), F.col("part_words")
    copies = F.concat(
        F.array_repeat(F.lit(0), F.col("passes")), F.when(head > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(part > 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    )
    text = F.when(F.col("_copy") == 1, cut(F.lit(0), head)).when(F.col("_copy") == 2, cut(F.col("part_from"), part)).otherwise(F.col(text_col))
    return mixed.withColumn("_copy", F.explode(copies)).withColumn(text_col, text).select(*columns)
