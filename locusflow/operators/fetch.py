"""Tiles of sequences, and the bases of many regions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packing, region, sequence

TILE = 65_536
#: A sizes table of so many chromosomes (some 10 MB) is sent to every task; a larger one is joined by shuffle.
BROADCAST_CHROMOSOMES = 100_000
#: So many tiles asked for (some 30 MB) are sent to every task; more are joined by shuffle.
BROADCAST_ASKED = 200_000
#: So many regions are asked for by predicates that the store is pruned by.
PRUNED = 256
#: Bytes of a store's row groups: what a lookup of one tile reads at most, beside footers and indexes.
ROW_GROUP = 4 << 20


def pieces(text: Column, size: Column | int) -> Column:
    """``text`` in pieces of ``size`` characters, the last one shorter, in one pass over it; an empty text is one empty piece."""
    pattern = F.concat(F.lit("(?s).{1,"), (size if isinstance(size, Column) else F.lit(size)).cast("string"), F.lit("}"))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, pattern, F.lit(0)))


def tiles(sequences: DataFrame, tile: int = TILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, size, tile, bases) of (chrom, seq), with ``keep``: pieces of ``tile`` bases; an empty sequence has one empty piece."""
    cut = sequences.select("chrom", F.length("seq").cast("long").alias("size"), *keep, F.posexplode(pieces(F.col("seq"), tile)).alias("tile", "bases"))
    return cut.select("chrom", "size", "tile", "bases", *keep)


def resolved(regions: DataFrame, sizes: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``regions`` (chrom, start, end, ...) with nulls made whole chromosomes, ``size`` and ``error``.

    ``sizes`` is (chrom, size), counted first unless ``broadcast`` says whether it is small.
    """
    if broadcast is None:
        broadcast = sizes.limit(BROADCAST_CHROMOSOMES + 1).count() <= BROADCAST_CHROMOSOMES
    known = sizes.select("chrom", F.col("size").alias("_size"))
    joined = regions.join(F.broadcast(known) if broadcast else known, "chrom", "left").withColumnRenamed("_size", "size")
    bare = F.col("start").isNull() | F.col("end").isNull()
    whole = joined.withColumns({"start": F.when(bare, F.lit(0)).otherwise(F.col("start")).cast("long"), "end": F.when(bare, F.col("size")).otherwise(F.col("end")).cast("long")})
    return whole.withColumn("error", region.unresolved(F.col("size"), F.col("start"), F.col("end")))


def packed_tiles(cut: DataFrame) -> DataFrame:
    """Tiles with their ``bases`` in two bits each where these are sequences of letters: see :mod:`locusflow.functions.packing`."""
    return cut.withColumns(packing.packed(F.col("bases")))


def only_asked(store: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """The tiles of a few (chrom, first, last), as predicates that Parquet's row groups and pages are held to."""
    by_chrom: dict[str, list[list[int]]] = {}
    for chrom, first, last in sorted(ranges):
        mine = by_chrom.setdefault(chrom, [])
        if mine and first <= mine[-1][1] + 1:
            mine[-1][1] = max(mine[-1][1], last)
        else:
            mine.append([first, last])
    asked = F.lit(False)
    for chrom, spans in by_chrom.items():
        for first, last in spans:
            asked = asked | ((F.col("chrom") == chrom) & F.col("tile").between(first, last))
    return store.filter(asked)


def fetch(regions: DataFrame, store: DataFrame, key: str = "rid", tile: int = TILE, masked: bool = True, checked: bool = True, pruned: int = PRUNED) -> DataFrame:
    """Resolved regions with ``bases``: each region's covering tiles by an equality join, cut, and put together in order.

    A minus strand is given as the reverse complement. ``masked=False`` drops soft-masking (upper
    case). Regions with an error have null bases; ``checked=False`` cuts ends past the chromosome
    off instead, only unknown chromosomes staying errors. Empty intervals give ``''``. ``key`` must
    tell the regions apart. A region's tiles are bounded by its own length.

    Up to ``pruned`` regions are asked of the store as predicates on its sorted tiles, so that a
    lookup reads what it needs. More regions go to the tiles, if they are few enough to be sent to
    every task, else both sides meet by shuffle. What then moves on is pieces, never tiles.
    """
    end = F.col("end") if checked else F.least("end", "size")
    start = F.col("start") if checked else F.greatest(F.col("start"), F.lit(0))
    wrong = F.col("error").isNotNull() if checked else F.col("size").isNull()
    asked = regions.withColumns({"_a": start, "_b": end, "_wrong": wrong})
    spans = asked.filter(~F.col("_wrong") & (F.col("_b") > F.col("_a"))).select(key, "chrom", "_a", "_b", F.expr(f"_a div {tile}").alias("_first"), F.expr(f"(_b - 1) div {tile}").alias("_last"))
    n, n_tiles = spans.agg(F.count("*"), F.sum(F.col("_last") - F.col("_first") + 1)).first()
    if n <= pruned:
        store = only_asked(store, [(r.chrom, r._first, r._last) for r in spans.select("chrom", "_first", "_last").collect()])
    wanted = spans.select(key, "chrom", "_a", "_b", F.explode(F.sequence("_first", "_last")).alias("tile"))
    wanted = F.broadcast(wanted) if (n_tiles or 0) <= BROADCAST_ASKED else wanted
    columns = ("packed", "other", "masked", "bases") if "packed" in store.columns else ("bases",)
    found = store.select("chrom", F.col("tile").cast("long").alias("tile"), *[F.col(c).alias(f"_{c}") for c in columns]).join(wanted, ["chrom", "tile"])
    first = F.greatest(F.col("_a") - F.col("tile") * tile, F.lit(0)).cast("int")
    last = F.least(F.col("_b") - F.col("tile") * tile, F.lit(tile)).cast("int")
    piece = packing.unpacked({c: F.col(f"_{c}") for c in columns}, first, last, masked) if len(columns) > 1 else F.substring("_bases", first + 1, last - first)
    pieces_ = found.select(key, "tile", piece.alias("_piece"))
    # Regions and their pieces come together by one exchange; a region without any piece is still there.
    kept = [c for c in asked.columns if c not in (key, "_a", "_b")]
    both = asked.select(key, F.struct(*kept).alias("_row"), F.lit(None).cast("long").alias("tile"), F.lit(None).cast("string").alias("_piece")).unionByName(pieces_, allowMissingColumns=True)
    ordered = F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("tile", "_piece"))))
    joined = both.groupBy(key).agg(F.first("_row", ignorenulls=True).alias("_row"), F.array_join(F.transform(ordered, lambda x: x["_piece"]), "").alias("_found")).select(key, "_row.*", "_found")
    bases = F.when(~F.col("_wrong"), F.col("_found"))
    bases = bases if masked else sequence.unmasked(bases)
    strand = F.when(F.col("strand") == "-", sequence.reverse_complement(bases)).otherwise(bases)
    return joined.withColumn("bases", strand).select(*regions.columns, "bases")
