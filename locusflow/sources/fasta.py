"""FASTA as records and tiles; chromosome sizes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: The numbers of so many records (some 10 MB) are sent to every task; more are joined by shuffle.
BROADCAST_RECORDS = 100_000
SIZES = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("length", T.LongType())])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, header, chrom, seq, width) of each record of plain or gzipped FASTA files.

    A record begins at a line's start with ``>``, so one inside a description is no boundary. The
    place orders records within a file: by the split that holds them, then by their order in it.
    ``width`` is the first line's number of bases. A record is one row: chromosomes are limited by a
    row's 2 GB.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    found = raw.filter(F.trim(F.substring(F.regexp_replace("value", r"\A>", ""), 1, 4096)) != "")
    # Only (file, block, id) is sorted and numbered; the numbers go back to the sequences where these are.
    order = W.partitionBy("file").orderBy("block", "id")
    places = found.select("file", "block", "id").withColumn("place", F.row_number().over(order) - 1)
    places = F.broadcast(places) if places.limit(BROADCAST_RECORDS + 1).count() <= BROADCAST_RECORDS else places
    text = F.regexp_replace("value", r"\A>", "")
    placed = found.join(places, ["file", "block", "id"]).select("file", "place", F.regexp_extract(text, r"\A([^\r\n]*)", 1).alias("header"), F.regexp_replace(text, r"\A[^\n]*\n?", "").alias("body"))
    return placed.select("file", "place", "header", F.regexp_extract("header", r"\A\s*(\S*)", 1).alias("chrom"), F.regexp_replace("body", r"\s+", "").alias("seq"), F.length(F.regexp_extract("body", r"\A([^\r\n]*)", 1)).alias("width"))


#: Bases of a fragment, unless a line alone has more.
FRAGMENT = 1 << 20
FRAGMENTS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("k", T.LongType()), T.StructField("header", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("bases", T.StringType()),
])


def _cut(batches: Iterator) -> Iterator:
    """Arrow batches of lines (file, block, value) as fragments: a row for each header, and for each run of lines between, their bases."""
    import numpy as np
    import pyarrow as pa

    now, k = (None, None), 0
    for batch in batches:
        n, out = batch.num_rows, []
        values, blocks, files = batch.column("value").cast(pa.large_binary()), batch.column("block").to_numpy(zero_copy_only=False), batch.column("file")
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
        data = values.buffers()[2] or pa.py_buffer(b"")
        bytes_ = np.frombuffer(data, np.uint8)
        full = np.flatnonzero(np.diff(ends) > 0)
        heads = full[bytes_[ends[full]] == ord(">")]
        names = pa.compute.dictionary_encode(files)
        codes = names.indices.to_numpy(zero_copy_only=False)
        changed = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        long = np.searchsorted(ends, np.arange(ends[0] + FRAGMENT, ends[-1], FRAGMENT)) if n else []
        cuts = np.unique(np.concatenate([[0, n], heads, heads + 1, changed, long]).astype(int))
        is_head = set(heads.tolist())
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = (names.dictionary[int(codes[a])].as_py(), int(blocks[a]))
            now, k = (now, k) if here == now else (here, 0)
            text = data[int(ends[a]) : int(ends[b])].to_pybytes()
            if a in is_head:
                out.append((*here, k, text[1:].rstrip(b"\r"), None, None))
            else:
                out.append((*here, k, None, int(ends[a + 1] - ends[a]) - int(data[int(ends[a]) : int(ends[a + 1])].to_pybytes().endswith(b"\r")), text.translate(None, b" \t\r\x0b\x0c")))
            k += 1
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        made = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        made[3], made[5] = (c.cast(pa.string()) for c in (made[3], made[5]))
        yield pa.RecordBatch.from_arrays(made, names=[f.name for f in FRAGMENTS.fields])


def fragments(spark: SparkSession, path: str, place: str) -> DataFrame:
    """(file, block, k, header, width, bases): plain or gzipped FASTA files as headers and bounded runs of bases between them, written to ``place``.

    Lines are read wherever a file's splits are, so that one long record is read by all cores; ``k``
    orders the fragments of a split. Only a line itself is never cut.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").cast("binary").alias("value"))
    raw.mapInArrow(_cut, FRAGMENTS).write.parquet(place)
    return spark.read.parquet(place)


def placed(found: DataFrame) -> DataFrame:
    """(file, block, k, folder, place, offset, n) of fragments: which record of its folder each belongs to, and how many of its bases come before.

    The files read of one folder follow each other by name, so a record may go on in the next file,
    as it does where lines were dealt to files by ranges. Prefix sums in two levels, over a split's
    fragments and over the splits; what stands before a folder's first header has place -1.
    """
    n = F.coalesce(F.length("bases"), F.lit(0)).cast("long")
    rows = found.select("file", "block", "k", F.col("header").isNotNull().alias("head"), n.alias("n"))
    local = W.partitionBy("file", "block").orderBy("k")
    rows = rows.withColumns({"rec": F.sum(F.col("head").cast("int")).over(local), "pos": F.coalesce(F.sum("n").over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumn("from", F.max(F.when(F.col("head"), F.col("pos"))).over(local.rowsBetween(W.unboundedPreceding, 0)))
    splits = rows.groupBy("file", "block").agg(F.sum(F.col("head").cast("int")).alias("heads"), F.sum("n").alias("bases"), F.max("from").alias("last"))
    splits = splits.withColumn("folder", F.regexp_replace("file", r"/[^/]*\z", ""))
    earlier = W.partitionBy("folder").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumns({"heads_before": F.coalesce(F.sum("heads").over(earlier), F.lit(0)), "bases_before": F.coalesce(F.sum("bases").over(earlier), F.lit(0))})
    opened = F.coalesce(F.last(F.col("bases_before") + F.col("last"), ignorenulls=True).over(earlier), F.lit(0))
    splits = splits.withColumn("open", F.col("bases_before") - opened).select("file", "block", "folder", "heads_before", "open")
    offset = F.when(F.col("rec") > 0, F.col("pos") - F.col("from")).otherwise(F.col("open") + F.col("pos"))
    return rows.join(splits, ["file", "block"]).select("file", "block", "k", "folder", (F.col("heads_before") + F.col("rec") - 1).cast("int").alias("place"), offset.alias("offset"), "n")


def tiles(found: DataFrame, tile: int) -> DataFrame:
    """(chrom, size, tile, bases, place, header, width) of fragments, each of which goes in pieces to the tiles it covers; a record without bases has one empty tile.

    No row is longer than a tile or a fragment. Files of one folder follow each other by name, like
    those that :func:`write_concatenated` writes, and bases before their first header are an error.
    """
    key = ["file", "block", "k"]
    where = placed(found)
    small = where.limit(BROADCAST_RECORDS + 1).count() <= BROADCAST_RECORDS
    hint = F.broadcast if small else (lambda df: df)
    both = found.join(hint(where), key)
    sums = both.groupBy("folder", "place").agg(F.sum("n").alias("size"), F.max("header").alias("header"), F.min(F.when(F.col("width").isNotNull(), F.struct("file", "block", "k", "width")))["width"].alias("width"))
    lost = F.when((F.col("place") < 0) & (F.col("size") > 0), F.raise_error(F.lit("bases before the first header")))
    records_ = sums.withColumns({"chrom": lost.otherwise(F.regexp_extract("header", r"\A\s*(\S*)", 1)), "width": F.coalesce("width", F.lit(0))})
    covered = F.explode(F.sequence(F.expr(f"offset div {tile}"), F.expr(f"(offset + n - 1) div {tile}")))
    at = F.greatest(F.col("offset"), F.col("tile") * tile)
    piece = F.substring("bases", (at - F.col("offset") + 1).cast("int"), (F.least(F.col("offset") + F.col("n"), (F.col("tile") + 1) * tile) - at).cast("int"))
    pieces = both.filter("n > 0").withColumn("tile", covered).select("folder", "place", "tile", F.struct(at.alias("at"), piece.alias("piece")).alias("x"))
    joined = pieces.groupBy("folder", "place", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("bases"))
    empty = records_.filter("size = 0 AND place >= 0").select("folder", "place", F.lit(0).cast("long").alias("tile"), F.lit("").alias("bases"))
    known = records_.select("folder", "place", "chrom", "size", "header", "width")
    known = F.broadcast(known) if small else known
    return joined.unionByName(empty).join(known, ["folder", "place"]).select("chrom", "size", F.col("tile").cast("int").alias("tile"), "bases", "place", "header", "width")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): every line to the byte, carriage returns and blank ones too, and what orders them."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"), "value")


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, length) of a two-column table, in the file's order."""
    lines = spark.read.schema(SIZES).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return lines.withColumn("_id", F.monotonically_increasing_id()).select((F.row_number().over(W.orderBy("_id")) - 1).alias("ord"), "chrom", "length")


def write_chrom_sizes(sizes: DataFrame, path: str) -> None:
    """``chrom<TAB>length`` lines in order of ``ord``, one file: sizes are a small table."""
    sizes.coalesce(1).sortWithinPartitions("ord").select("chrom", "length").write.option("sep", "\t").csv(path)


def extend_headers(lines: DataFrame, component: str, separator: str) -> DataFrame:
    """FASTA lines (``value``) with the first token of headers suffixed; leading blanks and descriptions stay."""
    suffix = F.lit(f"{separator}{component}")
    head = F.regexp_extract("value", r"\A(>\s*\S+)", 1)
    extended = F.concat(head, suffix, F.substring("value", F.length(head) + 1, F.length("value")))
    return lines.withColumn("value", F.when(F.startswith("value", F.lit(">")), F.when(head != "", extended).otherwise(F.raise_error(F.lit("a header without a name")))).otherwise(F.col("value")))


def concatenated(parts: list[tuple[str, DataFrame]], separator: str) -> DataFrame:
    """(part, at, value): the lines (at, value) of components, sorted by name, to the byte but for the suffixes of their headers."""
    every = None
    for i, (component, found) in enumerate(sorted(parts, key=lambda p: p[0])):
        mine = extend_headers(found, component, separator).select(F.lit(i).alias("part"), "at", "value")
        every = mine if every is None else every.unionByName(mine)
    return every


def write_concatenated(parts: list[tuple[str, DataFrame]], path: str, separator: str) -> None:
    """Several components' lines as one FASTA: text files that follow each other in the order of their names."""
    concatenated(parts, separator).repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.text(path)
