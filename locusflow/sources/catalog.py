"""Metadata tables, curated gene lists and completion records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..errors import CuratedGeneListError
from ..functions import cells

RECORD_NAME = "registration.json"
CATEGORY = T.StructType([T.StructField("description", T.StringType()), T.StructField("source", T.StringType()), T.StructField("gene_ids", T.ArrayType(T.StringType()))])
GENE_LIST = T.StructType([T.StructField("annotation", T.StringType()), T.StructField("assembly", T.StringType()), T.StructField("categories", T.MapType(T.StringType(), CATEGORY))])
RECORD = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("files", T.MapType(T.StringType(), T.LongType())), T.StructField("source_url", T.StringType()), T.StructField("sha256", T.StringType()),
    T.StructField("tool_versions", T.MapType(T.StringType(), T.StringType())), T.StructField("package_version", T.StringType()), T.StructField("completed_at", T.StringType()), T.StructField("details", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def table(spark: SparkSession, path: str, ints: tuple[str, ...] = (), required: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated table with a header: ``ord``, cells typed (blank: null), and the first ``error`` of a row."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    error, typed = F.lit(None).cast("string"), []
    for c in raw.columns:
        cell = F.col(f"`{c}`")
        faults = [cells.required_error(cell, c)] * (c in required) + [cells.int_error(cell, c)] * (c in ints) + [F.when(cells.flag(cell).isNull(), F.lit(f"{c} is no flag"))] * (c in flags)
        error = F.coalesce(error, *faults) if faults else error
        typed.append((cells.int_cell(cell) if c in ints else cells.flag(cell) if c in flags else cells.text_cell(cell)).alias(c))
    numbered = raw.withColumn("_id", F.monotonically_increasing_id())
    return numbered.select((F.row_number().over(W.orderBy("_id")) - 1).alias("ord"), *typed, error.alias("error"))


def gene_lists(spark: SparkSession, path: str) -> DataFrame:
    """(annotation, assembly, category, cat_ord, description, source, gene_ord, gene_id) of JSON lists, curated order kept; a category without genes has one null gene."""
    lists = spark.read.schema(GENE_LIST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    by_category = lists.select("annotation", "assembly", F.posexplode(F.map_entries("categories")).alias("cat_ord", "c"))
    return by_category.select("annotation", "assembly", F.col("c.key").alias("category"), "cat_ord", F.col("c.value.description").alias("description"), F.col("c.value.source").alias("source"), F.posexplode_outer("c.value.gene_ids").alias("gene_ord", "gene_id"))


def gene_list_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, category, error) of JSON lists: every way in which a file isn't a curated list named for its annotation; none if all are."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*?)(\.json)?\z", 1).alias("file"), F.try_parse_json("value").alias("v"))
    of = lambda v, key, kind: F.try_variant_get(v, f"$.{key}", kind)
    is_ = lambda v, kind: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))
    top = raw.withColumns({k: F.try_variant_get("v", f"$.{k}", "variant") for k in ("annotation", "assembly", "categories")})
    whole = is_(F.col("v"), "OBJECT")
    lacks = [F.when(whole & F.col(k).isNull(), f"no {k}") for k in ("annotation", "assembly", "categories")]
    listed = F.col("categories").isNotNull()
    errors = F.array_compact(F.array(
        F.when(F.col("v").isNull(), "not JSON"), F.when(F.col("v").isNotNull() & ~whole, "not an object"), *lacks,
        F.when(F.col("annotation").isNotNull() & ~F.coalesce(of(F.col("v"), "annotation", "string") == F.col("file"), F.lit(False)), "the file is named for another annotation"),
        F.when(listed & (~is_(F.col("categories"), "OBJECT") | (F.size(F.map_keys(F.try_variant_get("categories", "$", "map<string,variant>"))) == 0)), "categories are none"),
    ))
    files = top.select("file", F.lit(None).cast("string").alias("category"), F.explode(errors).alias("error"))
    entries = top.filter(is_(F.col("categories"), "OBJECT")).select("file", F.explode(F.try_variant_get("categories", "$", "map<string,variant>")).alias("category", "entry"))
    good = is_(F.col("entry"), "OBJECT")
    prose = [F.when(good & (~is_(F.try_variant_get("entry", f"$.{k}", "variant"), "STRING") | (F.trim(of(F.col("entry"), k, "string")) == "")), f"{k} is blank") for k in ("description", "source")]
    ids = F.try_variant_get("entry", "$.gene_ids", "array<variant>")
    genes = F.when(good & (ids.isNull() | (F.size(ids) == 0)), "no genes")
    odd = F.when(good & F.exists(ids, lambda g: ~is_(g, "STRING") | (F.trim(F.try_variant_get(g, "$", "string")) == "")), "a gene is no text or blank")
    shaped = entries.select("file", "category", F.explode(F.array_compact(F.array(F.when(~good, "not an object"), *prose, genes, odd))).alias("error"))
    named = entries.filter(good).select("file", "category", F.explode(F.try_variant_get("entry", "$.gene_ids", "array<string>")).alias("gene"))
    held = named.groupBy("file", "gene", "category").agg(F.count("*").alias("n"))
    twice = held.filter("n > 1").select("file", "category", F.concat(F.lit("gene repeats: "), "gene").alias("error"))
    several = held.groupBy("file", "gene").agg(F.count("*").alias("n"), F.max("category").alias("category")).filter("n > 1").select("file", "category", F.concat("gene", F.lit(" is in several categories")).alias("error"))
    return files.unionByName(shaped).unionByName(twice).unionByName(several)


def checked_gene_lists(spark: SparkSession, path: str) -> DataFrame:
    """:func:`gene_lists` of files that have no faults; the first ones there are are raised."""
    if wrong := gene_list_faults(spark, path).orderBy("file", "category", "error").limit(5).collect():
        raise CuratedGeneListError("; ".join(f"{r.file}{': ' + r.category if r.category else ''}: {r.error}" for r in wrong))
    return gene_lists(spark, path)


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Completion records with their ``directory``; one that can't be read, or lacks a kind, name or files, reads as none."""
    found = spark.read.schema(RECORD).option("multiLine", True).json(paths).withColumn("directory", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*\z", ""))
    return found.filter(F.col("_corrupt_record").isNull() & F.col("kind").isNotNull() & F.col("name").isNotNull() & F.col("files").isNotNull()).drop("_corrupt_record")


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder, their content unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def content_sha256(spark: SparkSession, path: str) -> str:
    """The digest of what is at ``path``, gzipped files unpacked, of any size; of a folder, that of its files one after the other.

    A digest depends on the order of all bytes, so one task reads the files' splits one after the
    other, as they are listed, a batch of lines at a time; nothing is shuffled or sorted. Should the
    splits ever come out of order, that is an error.
    """
    files = [r for r in files_below(spark, path).orderBy("path").collect() if not r.path.rpartition("/")[2].startswith(("_", "."))]
    packed = [r for r in files if r.path.endswith(".gz") and r.length <= WHOLE_BYTES]
    if len(files) == len(packed) == 1:
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unpacked_sha256, "sha256 string").first().sha256
    rows = None
    for i, file in enumerate(files):
        raw = spark.read.option("lineSep", "\n").text(file.path)
        closed = F.lit(_ends_a_line(spark, file.path) if file.path.endswith(".gz") else None).cast("boolean")
        size = F.when(closed.isNull(), F.col("_metadata.file_size"))
        mine = raw.select(F.lit(i).alias("file"), size.alias("size"), closed.alias("closed"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
        rows = mine if rows is None else rows.union(mine)
    digest = rows.coalesce(1).mapInArrow(_line_sha256, "sha256 string").first() if files else None
    return digest.sha256 if digest else hashlib.sha256().hexdigest()


def _ends_a_line(spark: SparkSession, path: str) -> bool:
    """Whether a gzipped file of any size ends in a line end: split at either of two letters, its last piece does.

    A piece loses the letter it ends in, so after a last letter A the pieces cut at A may seem to end
    a line, but not those cut at C.
    """
    def last(letter: str) -> bool:
        pieces = spark.read.option("lineSep", letter).text(path).select(F.monotonically_increasing_id().alias("id"), F.endswith("value", F.lit("\n")).alias("closed"))
        row = pieces.agg(F.max_by("closed", "id")).first()
        return bool(row[0])

    return last("A") and last("C")


#: A gzipped file of so many bytes is held packed by the task that unpacks it.
WHOLE_BYTES = 1_000_000_000


def _unpacked_sha256(batches: Iterator) -> Iterator:
    import gzip
    import io

    import pandas as pd

    for batch in batches:
        yield pd.DataFrame({"sha256": [hashlib.file_digest(gzip.GzipFile(fileobj=io.BytesIO(data)), "sha256").hexdigest() for data in batch["content"]]})


def _line_sha256(batches: Iterator) -> Iterator:
    """Hashes lines (file, size, closed, block, value) in order; a file's last line gets its end if the file's size, or else ``closed``, says there is one."""
    import pyarrow as pa

    digest, now, known, ended, n = hashlib.sha256(), (-1, -1), None, None, 0
    last = lambda: b"\n" if now[0] >= 0 and (ended if known is None else n <= known) else b""
    for batch in batches:
        for file, size, closed, block, value in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if (file, block) < now:
                raise RuntimeError("the splits of a file came out of order")
            digest.update(last() if file != now[0] else b"\n")
            if file != now[0]:
                known, ended, n = size, closed, 0
            now = (file, block)
            digest.update(value)
            n += len(value) + 1
    if now[0] >= 0:
        digest.update(last())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["sha256"])
