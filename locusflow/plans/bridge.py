"""The genomic relations that the driver's tables stand for, in Spark and, spelled alike, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences of components (their sources)."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("chr"), F.col("doc_id").cast("string")).alias("chrom"), F.col("source").alias("component"), F.col("text").alias("seq"),
        F.length("text").cast("long").alias("size"), F.col("doc_id").alias("ord"),
    )


#: Letters of documents and the bases they stand for, each case for itself.
_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' letters as bases, digits as runs of N, all else left out."""
    text = F.regexp_replace(F.regexp_replace("text", "[0-9]", "N"), "[^A-Za-z]", "")
    bases = F.translate(text, _LETTERS + _LETTERS.upper().replace("N", ""), _BASES + "".join(b for a, b in zip(_LETTERS, _BASES.upper(), strict=True) if a != "n"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("chr"), F.col("doc_id").cast("string")).alias("chrom"), bases.alias("seq"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("ord", "component", "chrom", "size")


def suffixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes of a chimera: suffixed by their component."""
    return sizes(spark, sf_dir).withColumn("chrom", F.concat("chrom", F.lit("__"), "component"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loci; some name no chromosome or reach past its end."""
    n = F.lit(table(spark, sf_dir, "documents").count())
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rid"), F.concat(F.lit("chr"), (F.col("event_id") * 7 % (n + 5)).cast("string")).alias("chrom"), F.col("user_id").alias("start"),
        (F.col("user_id") + F.floor(F.abs("value"))).cast("long").alias("end"), F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("event_id") % 3 + 1).cast("int")).alias("strand"),
    )


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as locus text: well formed, with commas, bare, or broken."""
    r = regions(spark, sf_dir)
    kind = F.col("rid") % 5
    grouped = F.format_string("%s:%,d-%,d", F.col("chrom"), F.col("start") * 1000, F.col("end") * 1000)
    text = (
        F.when(kind == 0, F.format_string("%s:%d-%d", "chrom", "start", "end")).when(kind == 1, F.col("chrom"))
        .when(kind == 2, F.concat("chrom", F.lit(":x"))).when(kind == 3, F.concat(F.lit("  "), F.format_string("%s:%d-%d", "chrom", "end", "start"), F.lit(" "))).otherwise(grouped)
    )
    return r.select("rid", text.alias("locus"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as exons: an order is a gene, its odd and even lines its two transcripts."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey")
    return li.select(
        F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("seqname"), F.col("l_shipdate").isNotNull().alias("dated"), F.element_at(F.array(*map(F.lit, ("exon", "CDS", "start_codon"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("feature"),
        start.alias("start"), (start + F.floor("l_quantity")).cast("long").alias("end"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat(F.lit("g"), F.col("l_orderkey").cast("string")).alias("gene_id"), F.concat(F.lit("g"), F.col("l_orderkey").cast("string"), F.lit("."), (F.col("l_linenumber") % 2).cast("string")).alias("transcript_id"),
    ).drop("dated")


def named_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of genes (their orders): the first is called by its part, of which there are few, the second by its supplier, the others by nothing."""
    n = F.col("l_linenumber")
    named = F.when(n == 1, F.concat(F.lit("g"), (F.col("l_partkey") % 50).cast("string"))).when(n == 2, F.concat(F.lit("t"), F.col("l_suppkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gene"), n.cast("long").alias("line"), F.when(n == 1, "gene").when(n == 2, "transcript").otherwise("exon").alias("feature"), named.alias("named"))


def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as GTF lines of components (their nations), some comments and some without tabs among them."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("#!"), "s_name")).when(F.col("s_suppkey") % 10 == 5, F.col("s_name")).otherwise(F.concat(F.lit("chr"), k, F.lit("\tsrc\texon\t1\t"), k, F.lit("\t.\t+\t.\tgene_id \""), "s_name", F.lit("\";")))
    return s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("component"), F.col("s_suppkey").alias("ord"), line.alias("value"))


def assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as assemblies, every third without a UCSC name, some with another's assembly name as theirs."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    number = F.col("n_nationkey").cast("string")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("assembly_name"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("uc"), ((F.col("n_nationkey") / 2).cast("int")).cast("string"))).alias("ucsc_name"),
        F.col("r_name").alias("species"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit(" "), number)).when(F.col("n_nationkey") % 4 == 1, F.lit("  ")).when(F.col("n_nationkey") % 4 == 2, number).otherwise(F.lit("x")).alias("taxid_cell"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as annotations of assemblies (their nations): flags spelled in several ways, digests for some."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("assembly"), F.col("s_name").alias("name"), k.alias("ord"),
        F.element_at(F.array(*map(F.lit, ("yes", "No", " TRUE ", "0", "", "maybe"))), (k % 6 + 1).cast("int")).alias("flag_cell"), F.when(k % 2 == 0, F.md5(F.col("s_name"))).alias("sha256"),
        (k % 3 == 0).alias("is_registered"), (k % 7 == 0).alias("is_broken"), (k % 5 != 0).alias("is_offered"),
    )


def gene_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as genes: a brand is an annotation, a type a category."""
    p = table(spark, sf_dir, "part")
    ranked = F.dense_rank().over(W.partitionBy("p_brand").orderBy("p_type")) - 1
    return p.select(
        F.col("p_brand").alias("annotation"), F.concat(F.lit("asm"), F.substring("p_brand", -1, 1)).alias("assembly"), F.col("p_type").alias("category"), ranked.cast("long").alias("cat_ord"),
        F.col("p_partkey").alias("gene_ord"), F.concat(F.lit("G"), (F.col("p_partkey") % 150).cast("string")).alias("gene_id"),
    )


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand alone, and ``all-<d>``, merged from the brands of last digit d; one that has no list among them."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("annotation")).distinct()
    alone = p.select(F.col("annotation").alias("name"), F.lit(0).cast("long").alias("part_ord"), "annotation")
    digit = F.substring("annotation", -1, 1)
    merged = p.select(F.concat(F.lit("all-"), digit).alias("name"), (F.row_number().over(W.partitionBy(digit).orderBy("annotation"))).cast("long").alias("part_ord"), "annotation")
    missing = merged.select("name").distinct().select("name", F.lit(99).cast("long").alias("part_ord"), F.lit("no list").alias("annotation"))
    return alone.unionByName(merged).unionByName(missing)


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that orders claim: (dir, file, expected); two for each of two orders in three."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 != 0)
    return o.select(F.col("o_orderkey").alias("dir"), F.explode(F.array(F.lit(1), F.lit(2))).alias("file"), (F.col("o_orderkey") % 50).alias("expected"))


def on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files: (dir, file, actual)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("file"), F.floor("l_quantity").cast("long").alias("actual")).groupBy("dir", "file").agg(F.max("actual").alias("actual"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as components' entries of chimeras: (chimera, component, sha256)."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select((k / 4).cast("long").alias("chimera"), (k % 97).alias("component"), F.when(k % 11 != 0, F.md5(F.when(k % 13 == 0, F.lit("x")).otherwise((k % 97).cast("string")))).alias("sha256"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components' digests now: some unknown, some components gone."""
    rows = spark.range(97).filter("id % 19 <> 3")
    return rows.select(F.col("id").alias("component"), F.when(F.col("id") % 23 != 5, F.md5(F.col("id").cast("string"))).alias("sha256"))


#: The same relations as DuckDB common table expressions.
SQL = {
    "sequences": "SELECT 'chr' || doc_id AS chrom, source AS component, text AS seq, length(text) AS size, doc_id AS ord FROM documents",
    "sizes": "SELECT doc_id AS ord, source AS component, 'chr' || doc_id AS chrom, length(text) AS size FROM documents",
    "suffixed": "SELECT doc_id AS ord, source AS component, 'chr' || doc_id || '__' || source AS chrom, length(text) AS size FROM documents",
    "regions": """SELECT event_id AS rid, 'chr' || (event_id * 7 % ((SELECT count(*) FROM documents) + 5)) AS chrom, user_id AS start, user_id + CAST(floor(abs(value)) AS BIGINT) AS "end", ['+', '-', '.'][event_id % 3 + 1] AS strand FROM events""",
    "loci": """SELECT rid, CASE rid % 5 WHEN 0 THEN chrom || ':' || start || '-' || "end" WHEN 1 THEN chrom WHEN 2 THEN chrom || ':x' WHEN 3 THEN '  ' || chrom || ':' || "end" || '-' || start || ' ' ELSE chrom || ':' || format('{:,}', start * 1000) || '-' || format('{:,}', "end" * 1000) END AS locus FROM regions""",
    "features": """SELECT 'chr' || l_suppkey AS seqname, ['exon', 'CDS', 'start_codon'][l_linenumber % 3 + 1] AS feature, l_partkey AS start, l_partkey + CAST(floor(l_quantity) AS BIGINT) AS "end", CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || l_orderkey AS gene_id, 'g' || l_orderkey || '.' || (l_linenumber % 2) AS transcript_id FROM lineitem""",
    "gtf": r"""SELECT 'n' || s_nationkey AS component, s_suppkey AS ord, CASE WHEN s_suppkey % 10 = 0 THEN '#!' || s_name WHEN s_suppkey % 10 = 5 THEN s_name ELSE 'chr' || s_suppkey || chr(9) || 'src' || chr(9) || 'exon' || chr(9) || '1' || chr(9) || s_suppkey || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'gene_id "' || s_name || '";' END AS value FROM supplier""",
    "assemblies": "SELECT CAST(n_nationkey AS BIGINT) AS ord, n_name AS assembly_name, CASE WHEN n_nationkey % 3 <> 0 THEN 'uc' || (n_nationkey // 2) END AS ucsc_name, r_name AS species, CASE n_nationkey % 4 WHEN 0 THEN ' ' || n_nationkey WHEN 1 THEN '  ' WHEN 2 THEN '' || n_nationkey ELSE 'x' END AS taxid_cell FROM nation JOIN region ON n_regionkey = r_regionkey",
    "annotations": "SELECT 'n' || s_nationkey AS assembly, s_name AS name, s_suppkey AS ord, ['yes', 'No', ' TRUE ', '0', '', 'maybe'][s_suppkey % 6 + 1] AS flag_cell, CASE WHEN s_suppkey % 2 = 0 THEN md5(s_name) END AS sha256, s_suppkey % 3 = 0 AS is_registered, s_suppkey % 7 = 0 AS is_broken, s_suppkey % 5 <> 0 AS is_offered FROM supplier",
    "gene_lists": "SELECT p_brand AS annotation, 'asm' || right(p_brand, 1) AS assembly, p_type AS category, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS cat_ord, p_partkey AS gene_ord, 'G' || (p_partkey % 150) AS gene_id FROM part",
    "contributors": """SELECT DISTINCT p_brand AS name, CAST(0 AS BIGINT) AS part_ord, p_brand AS annotation FROM part UNION ALL SELECT 'all-' || right(b, 1), row_number() OVER (PARTITION BY right(b, 1) ORDER BY b), b FROM (SELECT DISTINCT p_brand AS b FROM part) UNION ALL SELECT DISTINCT 'all-' || right(p_brand, 1), 99, 'no list' FROM part""",
    "claimed": "SELECT o_orderkey AS dir, unnest([1, 2]) AS file, o_orderkey % 50 AS expected FROM orders WHERE o_orderkey % 3 <> 0",
    "on_disk": "SELECT l_orderkey AS dir, l_linenumber AS file, max(CAST(floor(l_quantity) AS BIGINT)) AS actual FROM lineitem GROUP BY ALL",
    "entries": "SELECT c_custkey // 4 AS chimera, c_custkey % 97 AS component, CASE WHEN c_custkey % 11 <> 0 THEN md5(CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE CAST(c_custkey % 97 AS VARCHAR) END) END AS sha256 FROM customer",
    "digests": "SELECT range AS component, CASE WHEN range % 23 <> 5 THEN md5(CAST(range AS VARCHAR)) END AS sha256 FROM range(97) WHERE range % 19 <> 3",
}
SQL["dna"] = f"""SELECT chrom, seq, length(seq) AS size FROM (SELECT 'chr' || doc_id AS chrom, translate(regexp_replace(regexp_replace(text, '[0-9]', 'N', 'g'), '[^A-Za-z]', '', 'g'), '{_LETTERS}{_LETTERS.upper().replace("N", "")}',
  '{_BASES}{"".join(b for a, b in zip(_LETTERS, _BASES.upper(), strict=True) if a != "n")}') AS seq FROM documents)"""
SQL["named_features"] = """SELECT l_orderkey AS gene, CAST(l_linenumber AS BIGINT) AS line, CASE l_linenumber WHEN 1 THEN 'gene' WHEN 2 THEN 'transcript' ELSE 'exon' END AS feature,
  CASE l_linenumber WHEN 1 THEN 'g' || (l_partkey % 50) WHEN 2 THEN 't' || l_suppkey END AS named FROM lineitem"""
#: What each expression needs before it.
NEEDS = {"loci": ["regions"]}


def with_sql(names: list[str], body: str) -> str:
    ordered = [m for n in names for m in (*NEEDS.get(n, []), n)]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in dict.fromkeys(ordered)) + "\n" + body
