"""The catalogue: a query for each operator, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, names, region, sequence
from ..operators import annotation, fetch, genes, lookup, naming, records, resolve, shape
from ..sources import fasta
from . import bridge as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEP = "__"
#: Tile of the fetch queries; a region over the stand-in sequences mostly covers one.
TILE = 4096


def add(name: str, query: Query, needs: list[str], sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = b.with_sql(needs, sql) if needs else sql


# --- sequences ---
def _scalar(name: str, make: Callable, sql: str, alias: str = "result") -> None:
    add(name, lambda s, d: b.sequences(s, d).select("chrom", make(F.col("seq")).alias(alias)), ["sequences"], f"SELECT chrom, {sql} AS {alias} FROM sequences")


_scalar("seq_complement", sequence.complement, "translate(seq, 'ACGTacgt', 'TGCAtgca')")
_scalar("seq_reverse_complement", sequence.reverse_complement, "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))")
_scalar("seq_transcribe", sequence.transcribe, "translate(seq, 'Tt', 'Uu')")
_scalar("seq_back_transcribe", sequence.back_transcribe, "translate(seq, 'Uu', 'Tt')")
_scalar("rna_complement", lambda c: sequence.complement(c, "rna"), "translate(seq, 'ACGUacgu', 'UGCAugca')")
_scalar("rna_reverse_complement", lambda c: sequence.reverse_complement(c, "rna"), "reverse(translate(seq, 'ACGUacgu', 'UGCAugca'))")
_scalar("seq_gc_content", sequence.gc_content, "CASE WHEN length(seq) = 0 THEN 0.0::DOUBLE ELSE (length(seq) - length(translate(seq, 'GCgc', ''))) / length(seq) END")
_scalar("seq_slice", lambda c: sequence.slice_(c, 5, -5), "substring(seq, 6, greatest(0, length(seq) - 10))")
_scalar("seq_slice_step", lambda c: sequence.slice_(c, 40, 0, -3), "coalesce(array_to_string([substring(seq, i + 1, 1) FOR i IN range(least(40, length(seq) - 1), 0, -3)], ''), '')")


def seq_index(s: SparkSession, d: str) -> DataFrame:
    """A place of each sequence, some before its start and some behind its end."""
    at = F.col("ord") * 7 % 900 - 450
    return b.sequences(s, d).select("chrom", sequence.index(F.col("seq"), at).alias("base"), sequence.index_error(F.col("seq"), at).alias("error"))


_AT = "(ord * 7 % 900 - 450)"
add("seq_index", seq_index, ["sequences"],
    f"""SELECT chrom, CASE WHEN {_AT} >= -length(seq) AND {_AT} < length(seq) THEN substring(seq, CASE WHEN {_AT} < 0 THEN {_AT} + length(seq) ELSE {_AT} END + 1, 1) END AS base,
  CASE WHEN {_AT} < -length(seq) OR {_AT} >= length(seq) THEN 'no place ' || {_AT} || ' in ' || length(seq) END AS error FROM sequences""")  # fmt: skip
_scalar("seq_repr", sequence.as_repr, "'DNA(''' || seq || ''')'")
_scalar("text_sha256", lambda c: F.sha2(c.cast("binary"), 256), "sha256(seq)")
for _name, _letters in sequence.ALPHABETS.items():
    _scalar(
        f"seq_outside_alphabet_{_name}", lambda c, n=_name: sequence.outside_alphabet(c, n),
        f"list_sort(list_distinct([c FOR c IN string_split(seq, '') IF c <> '' AND NOT list_contains(string_split('{_letters}', ''), upper(c))]))",
    )


# --- regions ---
def region_parse(s: SparkSession, d: str) -> DataFrame:
    return b.loci(s, d).select("rid", *[c.alias(k) for k, c in region.parse(F.col("locus")).items()])


_PARSED = r"""SELECT rid, CASE WHEN bad THEN NULL WHEN ok THEN regexp_extract(t, '^(.+):([\d,]+)-([\d,]+)$', 1) ELSE t END AS chrom,
  CASE WHEN ok THEN TRY_CAST(replace(regexp_extract(t, '^(.+):([\d,]+)-([\d,]+)$', 2), ',', '') AS BIGINT) END AS start,
  CASE WHEN ok THEN TRY_CAST(replace(regexp_extract(t, '^(.+):([\d,]+)-([\d,]+)$', 3), ',', '') AS BIGINT) END AS "end", CASE WHEN bad THEN 'malformed region' END AS error
FROM (SELECT rid, t, regexp_matches(t, '^(.+):([\d,]+)-([\d,]+)$') AS ok, contains(t, ':') AND NOT regexp_matches(t, '^(.+):([\d,]+)-([\d,]+)$') AS bad FROM (SELECT rid, trim(locus) AS t FROM loci))"""
add("region_parse", region_parse, ["loci"], _PARSED)
add("region_validate", lambda s, d: b.regions(s, d).select("rid", region.invalid(F.col("start") - 20, F.col("end") - F.col("rid") % 300, F.when(F.col("rid") % 11 == 0, "x").otherwise(F.col("strand"))).alias("error")), ["regions"],
    """SELECT rid, CASE WHEN start - 20 < 0 THEN 'start must be >= 0' WHEN "end" - rid % 300 < start - 20 THEN 'end must be >= start' WHEN rid % 11 = 0 THEN 'strand must be one of + - .' END AS error FROM regions""")  # fmt: skip
add("region_length", lambda s, d: b.regions(s, d).select("rid", region.length(F.col("start"), F.col("end")).alias("length")), ["regions"], 'SELECT rid, "end" - start AS length FROM regions')
add("region_format", lambda s, d: b.regions(s, d).select("rid", region.spelled(F.col("chrom"), F.col("start"), F.col("end")).alias("locus")), ["regions"], """SELECT rid, chrom || ':' || start || '-' || "end" AS locus FROM regions""")
_ERROR = """CASE WHEN size IS NULL THEN 'unknown chromosome' WHEN start < 0 THEN 'start must be >= 0' WHEN start > "end" THEN 'start is past end' WHEN "end" > size THEN 'end exceeds chromosome length' END"""


def region_resolve(s: SparkSession, d: str) -> DataFrame:
    """Parsed loci, bare ones whole, against the sizes."""
    parsed = region_parse(s, d).filter(F.col("error").isNull()).drop("error").withColumn("strand", F.lit("."))
    return fetch.resolved(parsed, b.sizes(s, d)).select("rid", "chrom", "start", "end", "size", "error")


add("region_resolve", region_resolve, ["loci", "sizes"],
    f"""SELECT rid, chrom, start, "end", size, {_ERROR} AS error FROM (SELECT rid, p.chrom, coalesce(start, 0) AS start, coalesce("end", size) AS "end", size FROM ({_PARSED}) p LEFT JOIN sizes USING (chrom) WHERE error IS NULL)""")


def _fetched(s: SparkSession, d: str, **how: bool) -> DataFrame:
    asked = fetch.resolved(b.regions(s, d), b.sizes(s, d))
    return fetch.fetch(asked, fetch.tiles(b.sequences(s, d), TILE), "rid", TILE, **how)


_BASES = "CASE WHEN strand = '-' THEN reverse(translate({0}, 'ACGTacgt', 'TGCAtgca')) ELSE {0} END"
_UPPERED = """translate(substring(seq, start + 1, "end" - start), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"""
_JOINED = "regions LEFT JOIN sequences USING (chrom)"
add("fetch_sequence", lambda s, d: _fetched(s, d).select("rid", "chrom", "start", "end", "strand", "error", "bases"), ["regions", "sequences"],
    f"""SELECT rid, chrom, start, "end", strand, {_ERROR} AS error, CASE WHEN ({_ERROR}) IS NULL THEN {_BASES.format('substring(seq, start + 1, "end" - start)')} END AS bases FROM {_JOINED}""")
add("fetch_sequence_unchecked", lambda s, d: _fetched(s, d, checked=False).select("rid", "bases"), ["regions", "sequences"],
    f"""SELECT rid, CASE WHEN size IS NOT NULL THEN {_BASES.format('substring(seq, start + 1, greatest(0, least("end", size) - start))')} END AS bases FROM {_JOINED}""")
add("fetch_unmasked", lambda s, d: _fetched(s, d, masked=False).filter("error IS NULL").select("rid", "bases"), ["regions", "sequences"],
    f"""SELECT rid, {_BASES.format(_UPPERED)} AS bases FROM {_JOINED} WHERE ({_ERROR}) IS NULL""")



def fetch_packed(s: SparkSession, d: str) -> DataFrame:
    """The loci over documents turned into bases, kept in two bits each."""
    dna = b.dna(s, d)
    store = fetch.packed_tiles(fetch.tiles(dna, TILE))
    found = fetch.fetch(fetch.resolved(b.regions(s, d), dna.select("chrom", F.length("seq").cast("long").alias("size"))), store, "rid", TILE)
    return found.select("rid", "error", "bases")


add("fetch_packed", fetch_packed, ["regions", "dna"],
    f"""SELECT rid, {_ERROR} AS error, CASE WHEN ({_ERROR}) IS NULL THEN {_BASES.format('substring(seq, start + 1, "end" - start)')} END AS bases FROM regions LEFT JOIN dna USING (chrom)""")

# --- sizes and names ---
add("chrom_sizes", lambda s, d: b.sizes(s, d).select("ord", "chrom", F.col("size").alias("length")), ["sizes"], "SELECT ord, chrom, size AS length FROM sizes")
add("chrom_components", lambda s, d: b.suffixed_sizes(s, d).select("chrom", names.component_of(F.col("chrom"), F.lit(SEP), F.lit("asm")).alias("component")), ["suffixed"], "SELECT chrom, component FROM suffixed")
_COMPONENTS = lambda s, d: b.sequences(s, d).groupBy((F.col("ord") % 40).alias("k")).agg(F.collect_set("component").alias("parts"))
_PARTS = "(SELECT ord % 40 AS k, list(DISTINCT component) AS parts FROM sequences GROUP BY 1)"
add("chimera_name", lambda s, d: _COMPONENTS(s, d).select("k", names.derive_name(F.col("parts")).alias("name"), names.components_error(F.col("parts")).alias("error")), ["sequences"],
    f"SELECT k, array_to_string(list_sort(parts), '_') AS name, CASE WHEN len(parts) < 2 THEN 'a chimera has at least two components' END AS error FROM {_PARTS}")
add("chimera_split_name", lambda s, d: b.table(s, d, "part").select("p_partkey", names.split_name(F.regexp_replace("p_name", " ", "_")).alias("parts")), [],
    "SELECT p_partkey, CASE WHEN regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z0-9]+(_[A-Za-z0-9]+)+') THEN string_split(replace(p_name, ' ', '_'), '_') END AS parts FROM part")
add("chimera_separator", lambda s, d: naming.separator_of(b.sequences(s, d).withColumn("chrom", F.concat("chrom", F.repeat(F.lit("_"), (F.col("ord") % 4).cast("int")), F.lit("x")))), ["sequences"],
    "SELECT CAST(max(ord % 4) AS INTEGER) AS longest, repeat('_', CAST(greatest(2, max(ord % 4) + 1) AS INTEGER)) AS separator FROM sequences")
add("chimera_separator_check", lambda s, d: naming.separator_mismatch(b.sequences(s, d).withColumn("chrom", F.concat("chrom", F.repeat(F.lit("_"), (F.col("ord") % 4).cast("int")), F.lit("x"))), F.lit(SEP)), ["sequences"],
    "SELECT '__' AS given, derived FROM (SELECT repeat('_', CAST(greatest(2, max(ord % 4) + 1) AS INTEGER)) AS derived FROM sequences) WHERE derived <> '__'")
add("chimera_suffix", lambda s, d: b.sizes(s, d).select("ord", names.suffixed(F.col("chrom"), F.col("component"), F.lit(SEP)).alias("chrom"), names.suffix_pattern(F.lit(SEP)).alias("pattern")), ["sizes"],
    "SELECT ord, chrom || '__' || component AS chrom, '^(?P<chromosome>.+)__(?P<component>[A-Za-z0-9]+)$' AS pattern FROM sizes")

def chimera_split_suffix(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("ord") % 3 == 0, F.col("chrom")).when(F.col("ord") % 3 == 1, F.concat("chrom", F.lit("__a__"), "component")).otherwise(F.concat(F.lit("__"), "component"))
    chrom, component = names.split_suffixed(F.col("name"), F.lit(SEP))
    return b.sizes(s, d).select("ord", name.alias("name")).select("ord", chrom.alias("chrom"), component.alias("component"))


add("chimera_split_suffix", chimera_split_suffix, ["sizes"],
    """SELECT ord, nullif(regexp_extract(n, '^(.+)__([A-Za-z0-9]+)$', 1), '') AS chrom, nullif(regexp_extract(n, '^(.+)__([A-Za-z0-9]+)$', 2), '') AS component
FROM (SELECT ord, CASE ord % 3 WHEN 0 THEN chrom WHEN 1 THEN chrom || '__a__' || component ELSE '__' || component END AS n FROM sizes)""")  # fmt: skip
add("chimera_roundtrip", lambda s, d: naming.not_round_tripping(b.sizes(s, d).withColumn("component", F.when(F.col("ord") % 9 == 0, F.concat("component", F.lit("-x"))).otherwise(F.col("component"))), F.lit(SEP)).select("ord", "chrom", "component"), ["sizes"],
    "SELECT ord, chrom, component || '-x' AS component FROM sizes WHERE ord % 9 = 0")


def chimera_bare_spellings(s: SparkSession, d: str) -> DataFrame:
    names_ = b.sizes(s, d).select(F.col("chrom").alias("name"))
    asked = names_.unionByName(names_.select(F.concat("name", F.lit("?")).alias("name")))  # half of them are no chromosome's
    return naming.bare_spellings(asked, b.suffixed_sizes(s, d), F.lit(SEP))


add("chimera_bare_spellings", chimera_bare_spellings, ["sizes"], "SELECT chrom AS name, [chrom || '__' || component] AS spellings FROM sizes")
add("chimera_expected_sizes", lambda s, d: naming.expected_sizes(b.sizes(s, d), F.lit(SEP)), ["sizes"], "SELECT component, ord, chrom || '__' || component AS chrom, size FROM sizes")


def chimera_first_difference(s: SparkSession, d: str) -> DataFrame:
    mine = lambda df: df.select(F.col("component").alias("part"), "ord", "chrom", "size")
    built = mine(b.sizes(s, d)).filter("ord % 37 <> 5").withColumn("size", F.when(F.col("ord") % 41 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return naming.first_difference(built, mine(b.sizes(s, d)))


add("chimera_first_difference", chimera_first_difference, ["sizes"],
    """, e AS (SELECT component AS part, row_number() OVER (PARTITION BY component ORDER BY ord) - 1 AS place, chrom, size FROM sizes),
u AS (SELECT component AS part, row_number() OVER (PARTITION BY component ORDER BY ord) - 1 AS place, chrom, CASE WHEN ord % 41 = 0 THEN size + 1 ELSE size END AS size FROM sizes WHERE ord % 37 <> 5),
j AS (SELECT coalesce(u.part, e.part) AS part, CAST(coalesce(u.place, e.place) AS INTEGER) AS place, u.chrom AS built_chrom, u.size AS built_size, e.chrom AS expected_chrom, e.size AS expected_size FROM u FULL JOIN e ON u.part = e.part AND u.place = e.place)
SELECT part, place, built_chrom, built_size, expected_chrom, expected_size FROM j WHERE built_chrom IS DISTINCT FROM expected_chrom OR built_size IS DISTINCT FROM expected_size
QUALIFY row_number() OVER (PARTITION BY part ORDER BY place) = 1""")  # fmt: skip
add("duplicate_components", lambda s, d: naming.duplicates(b.sequences(s, d), "component"), ["sequences"], "SELECT component, count(*) AS n FROM sequences GROUP BY 1 HAVING count(*) > 1")

# --- annotations ---
add("annotation_distinct_chromosomes", lambda s, d: annotation.distinct_chromosomes(b.features(s, d)), ["features"], "SELECT DISTINCT seqname FROM features")
add("annotation_missing_chromosomes", lambda s, d: annotation.missing_chromosomes(b.features(s, d), b.sizes(s, d).filter("ord % 4 <> 1")), ["features", "sizes"], "SELECT DISTINCT seqname FROM features EXCEPT SELECT chrom FROM sizes WHERE ord % 4 <> 1")
add("gtf_data_lines", lambda s, d: annotation.data_lines(b.gtf_lines(s, d)).select("ord", annotation.seqname(F.col("value")).alias("seqname")), ["gtf"], "SELECT ord, string_split(value, chr(9))[1] AS seqname FROM gtf WHERE NOT starts_with(value, '#') AND contains(value, chr(9))")
add("annotation_merge", lambda s, d: annotation.merged_lines(b.gtf_lines(s, d), F.lit(SEP)), ["gtf"],
    "SELECT component, ord, string_split(value, chr(9))[1] || '__' || component || substring(value, strpos(value, chr(9))) AS value FROM gtf WHERE NOT starts_with(value, '#') AND contains(value, chr(9))")
add("features_by_type", lambda s, d: b.features(s, d).filter("feature = 'CDS'"), ["features"], "SELECT * FROM features WHERE feature = 'CDS'")


def feature_ids(s: SparkSession, d: str) -> DataFrame:
    """Line items as lines of an annotation, a third of them nameless, whose names collide; ids are unique."""
    rows = b.named_features(s, d)
    found = annotation.numbered_ids(rows, F.floor(F.col("gene") / 1000), ["gene", "line"])
    return found.select("gene", "line", "feature", "id")


add("feature_ids", feature_ids, ["named_features"],
    """SELECT gene, line, feature, CASE WHEN named IS NULL THEN feature || '_' || k WHEN k = 1 THEN named ELSE named || '_' || (k - 1) END AS id
FROM (SELECT *, row_number() OVER (PARTITION BY named IS NULL, coalesce(named, feature) ORDER BY gene, line) AS k FROM named_features)""")  # fmt: skip
add("feature_types", lambda s, d: b.features(s, d).groupBy("feature").agg(F.count("*").alias("n")), ["features"], "SELECT feature, count(*) AS n FROM features GROUP BY 1")
for _f, _id in (("transcript", "transcript_id"), ("gene", "gene_id")):
    add(f"infer_{_f}s", lambda s, d, f=_f, i=_id: annotation.inferred(b.features(s, d).filter("feature = 'exon'"), f, i), ["features"],
        f"""SELECT seqname, strand, {_id}, min(start) AS start, max("end") AS "end", '{_f}' AS feature FROM features WHERE feature = 'exon' GROUP BY ALL""")


def annotation_status(s: SparkSession, d: str) -> DataFrame:
    a = b.annotations(s, d)
    return annotation.status(a.filter("is_offered"), a.filter("is_registered AND NOT is_broken"), a.filter("is_broken"))


_STATUS = """SELECT assembly, name, CASE WHEN is_offered THEN ord END AS ord, is_offered AS offered, is_registered AND NOT is_broken AS registered, is_broken AS broken,
  CASE WHEN is_broken THEN 'broken' WHEN NOT is_offered THEN 'registered, not offered' WHEN is_registered THEN 'registered' ELSE 'offered, not registered' END AS state
FROM annotations WHERE is_offered OR is_registered OR is_broken"""
add("annotation_status", annotation_status, ["annotations"], _STATUS)


def _defaults(s: SparkSession, d: str) -> DataFrame:
    rows = b.annotations(s, d).select(
        "assembly", "name", "ord", (F.coalesce(cells.flag(F.col("flag_cell")), F.lit(False)) & F.col("is_offered")).alias("default"), (F.col("is_registered") & ~F.col("is_broken")).alias("registered"),
        F.when((F.col("assembly") == "n3"), F.lit("chosen")).alias("explicit"),
    )
    return annotation.defaults(rows)


_DEFAULT = """SELECT assembly, coalesce(CASE WHEN assembly = 'n3' THEN 'chosen' END, arg_min(name, ord) FILTER (WHERE lower(trim(flag_cell)) IN ('yes', 'true') AND is_offered),
  CASE WHEN count(*) FILTER (WHERE is_registered AND NOT is_broken) = 1 THEN max(name) FILTER (WHERE is_registered AND NOT is_broken) END) AS default_annotation FROM annotations GROUP BY assembly"""
add("default_annotation", _defaults, ["annotations"], _DEFAULT)


def default_summary(s: SparkSession, d: str) -> DataFrame:
    """Each assembly's sentence, a broken default's repair being its own row's: merged ones (every other here), offered ones, and ones by path."""
    key = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    repair = cells.repair_command(F.col("assembly"), F.col("name"), key % 2 == 0, F.col("offered"), F.concat(F.lit("/gtf/"), F.col("name")))
    rows = annotation_status(s, d).select("assembly", F.col("name").alias("default_annotation"), "broken", "registered", repair.alias("repair"))
    joined = _defaults(s, d).join(rows, ["assembly", "default_annotation"], "left")
    wrong, there = F.coalesce("broken", F.lit(False)), F.coalesce("registered", F.lit(False))
    return joined.select("assembly", cells.default_sentence(F.col("assembly"), F.col("default_annotation"), wrong, there, F.col("repair")).alias("summary"))


add("default_summary", default_summary, ["annotations"], f""", st AS ({_STATUS}), df AS ({_DEFAULT})
SELECT df.assembly, 'default annotation: ' || CASE WHEN default_annotation IS NULL THEN 'none' WHEN broken THEN default_annotation || ', broken: run ' ||
    CASE WHEN CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) % 2 = 0 THEN 'register ' || df.assembly WHEN offered THEN 'register-annotation ' || df.assembly || ' ' || name ELSE 'register-gtf ' || df.assembly || ' /gtf/' || name || ' ' || name END || ' --force'
  WHEN registered THEN default_annotation ELSE default_annotation || ', absent: run register-annotation ' || df.assembly || ' ' || default_annotation END AS summary
FROM df LEFT JOIN st ON st.assembly = df.assembly AND st.name = default_annotation""")  # fmt: skip
add("chromosome_check", lambda s, d: b.table(s, d, "supplier").select("s_suppkey", cells.check_sentence(F.when(F.col("s_suppkey") % 4 != 3, F.col("s_suppkey") % 4 == 0), F.element_at(F.array(F.lit("no-chrom-sizes"), F.lit("caller-override"), F.lit("later")), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("summary")), [],
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'chromosomes checked' WHEN s_suppkey % 3 = 0 THEN 'chromosomes not checked: the assembly has no sizes' WHEN s_suppkey % 3 = 1 THEN 'chromosomes not checked: the caller stood the check down' ELSE 'chromosomes not checked: the record does not say why' END AS summary FROM supplier""")  # fmt: skip


# --- metadata ---
def _asked(s: SparkSession, d: str) -> DataFrame:
    a = b.assemblies(s, d)
    return a.select(F.col("assembly_name").alias("name")).unionByName(a.select(F.concat(F.lit("uc"), F.col("ord").cast("string")).alias("name")))


_ASKED = "(SELECT assembly_name AS name FROM assemblies UNION ALL SELECT 'uc' || ord FROM assemblies)"
_FIRST = "(SELECT q.name, a.* FROM (SELECT DISTINCT name FROM " + _ASKED + ") q JOIN assemblies a ON a.ucsc_name = q.name OR a.assembly_name = q.name QUALIFY row_number() OVER (PARTITION BY q.name ORDER BY a.ord) = 1)"
add("lookup_assembly", lambda s, d: lookup.first_assembly(_asked(s, d), b.assemblies(s, d)), ["assemblies"], f"SELECT name, ord, assembly_name, ucsc_name, species, taxid_cell FROM {_FIRST}")
add("assembly_metadata_total", lambda s, d: lookup.assembly_or_unknown(_asked(s, d), b.assemblies(s, d)), ["assemblies"], f"SELECT q.name, f.ord, coalesce(f.assembly_name, q.name) AS assembly_name, ucsc_name, species, taxid_cell FROM {_ASKED} q LEFT JOIN {_FIRST} f ON q.name = f.name")
def _asked_annotations(s: SparkSession, d: str) -> DataFrame:
    """Every annotation of its own assembly, and under the name of none."""
    a = b.annotations(s, d).select("assembly", "name")
    return a.unionByName(a.select(F.lit("no assembly").alias("assembly"), "name"))


add("lookup_annotation", lambda s, d: lookup.annotation(_asked_annotations(s, d), b.annotations(s, d).select("assembly", "name", "ord", "sha256")), ["annotations"], "SELECT assembly, name, ord, sha256 FROM annotations")
add("list_annotation_metadata", lambda s, d: b.annotations(s, d).filter("assembly = 'n7'").select("ord", "name"), ["annotations"], "SELECT ord, name FROM annotations WHERE assembly = 'n7'")
add("parse_flags", lambda s, d: b.annotations(s, d).select("ord", cells.flag(F.col("flag_cell")).alias("flag")), ["annotations"], "SELECT ord, CASE WHEN lower(trim(flag_cell)) IN ('yes', 'true', '1') THEN true WHEN lower(trim(flag_cell)) IN ('no', 'false', '0', '') THEN false END AS flag FROM annotations")
add("parse_cells", lambda s, d: b.assemblies(s, d).select("ord", cells.text_cell(F.col("taxid_cell")).alias("text"), cells.int_cell(F.col("taxid_cell")).alias("number"), F.coalesce(cells.required_error(F.col("taxid_cell"), "ncbi_taxid"), cells.int_error(F.col("taxid_cell"), "ncbi_taxid")).alias("error")), ["assemblies"],
    "SELECT ord, nullif(trim(taxid_cell), '') AS text, TRY_CAST(nullif(trim(taxid_cell), '') AS BIGINT) AS number, CASE WHEN trim(taxid_cell) = '' THEN 'ncbi_taxid is blank' WHEN TRY_CAST(trim(taxid_cell) AS BIGINT) IS NULL THEN 'ncbi_taxid is not an integer' END AS error FROM assemblies")
add("format_table_row", lambda s, d: b.assemblies(s, d).select("ord", cells.table_row(*map(F.col, ("assembly_name", "species", "ucsc_name", "ord"))).alias("line")), ["assemblies"], "SELECT ord, assembly_name || chr(9) || species || chr(9) || coalesce(ucsc_name, '') || chr(9) || ord AS line FROM assemblies")
add("source_urls", lambda s, d: b.assemblies(s, d).select("ord", cells.golden_path_url(F.coalesce("ucsc_name", "assembly_name")).alias("url"), cells.is_url(cells.golden_path_url(F.col("assembly_name"))).alias("is_url"), cells.without_fasta_suffix(F.concat("assembly_name", F.lit(".fa.gz"))).alias("stem")), ["assemblies"],
    "SELECT ord, 'https://hgdownload.soe.ucsc.edu/goldenPath/' || coalesce(ucsc_name, assembly_name) || '/bigZips/' || coalesce(ucsc_name, assembly_name) || '.fa.gz' AS url, true AS is_url, assembly_name AS stem FROM assemblies")

add("assembly_urls", lambda s, d: b.assemblies(s, d).select("ord", cells.assembly_url(F.coalesce("ucsc_name", "assembly_name")).alias("folder"), cells.fasta_url(F.when(F.col("ord") % 3 == 0, F.concat(F.lit("s3://x/"), "assembly_name")), F.coalesce("ucsc_name", "assembly_name")).alias("fasta")), ["assemblies"],
    """SELECT ord, 'https://hgdownload.soe.ucsc.edu/goldenPath/' || n || '/' AS folder, CASE WHEN ord % 3 = 0 THEN 's3://x/' || assembly_name ELSE 'https://hgdownload.soe.ucsc.edu/goldenPath/' || n || '/bigZips/' || n || '.fa.gz' END AS fasta FROM (SELECT *, coalesce(ucsc_name, assembly_name) AS n FROM assemblies)""")  # fmt: skip

# --- gene lists ---
_parts = lambda s, d: genes.contributing(b.contributors(s, d), b.gene_lists(s, d))
_PJ = "contributors JOIN gene_lists USING (annotation)"
add("gene_list", lambda s, d: genes.gene_list(_parts(s, d), ["name", "category"]), ["contributors", "gene_lists"], f"SELECT name, category, list(gene_id ORDER BY part_ord, gene_ord, gene_id) AS gene_ids, count(*) AS n_genes FROM {_PJ} GROUP BY 1, 2")
add("gene_lists", lambda s, d: genes.gene_list(_parts(s, d), ["name"]), ["contributors", "gene_lists"], f"SELECT name, list(gene_id ORDER BY part_ord, gene_ord, gene_id) AS gene_ids, count(*) AS n_genes FROM {_PJ} GROUP BY 1")
add("gene_categories", lambda s, d: genes.sources(_parts(s, d), ["name", "category"]), ["contributors", "gene_lists"], f"SELECT name, category, annotation, part_ord, count(*) AS n_genes FROM {_PJ} GROUP BY ALL")
add("declared_categories", lambda s, d: genes.declared(_parts(s, d), ["name"]), ["contributors", "gene_lists"], f"SELECT name, category, arg_min(part_ord, (part_ord, cat_ord)) AS part_ord, arg_min(cat_ord, (part_ord, cat_ord)) AS cat_ord FROM {_PJ} GROUP BY 1, 2")
add("gene_list_uniqueness", lambda s, d: genes.repeated_genes(b.gene_lists(s, d)), ["gene_lists"], "SELECT annotation, gene_id, count(*) AS n FROM gene_lists GROUP BY 1, 2 HAVING count(*) > 1")
add("gene_list_assembly_guard", lambda s, d: genes.wrong_assembly(b.gene_lists(s, d), b.gene_lists(s, d).select("annotation", F.lit("asm1").alias("assembly")).distinct()), ["gene_lists"], "SELECT DISTINCT annotation, 'asm1' AS assembly, assembly AS list_assembly FROM gene_lists WHERE assembly <> 'asm1'")
add("curated_annotations", lambda s, d: b.gene_lists(s, d).select("annotation").distinct(), ["gene_lists"], "SELECT DISTINCT annotation FROM gene_lists")
add("elided_names", lambda s, d: b.gene_lists(s, d).groupBy("annotation").agg(F.array_sort(F.collect_set("category")).alias("c")).select("annotation", cells.elided(F.col("c"), 3).alias("names")), ["gene_lists"],
    "SELECT annotation, array_to_string(c[1:3], ', ') || CASE WHEN len(c) > 3 THEN ', and ' || (len(c) - 3) || ' more' ELSE '' END AS names FROM (SELECT annotation, list_sort(list(DISTINCT category)) AS c FROM gene_lists GROUP BY 1)")

_PROSE = "CASE WHEN gene_ord % 40 = 7 THEN ' ' ELSE 'why' END AS description, 'where' AS source"


def _described(s: SparkSession, d: str) -> DataFrame:
    """Parts as genes with prose, some blank, and some genes blank or none."""
    rows = b.gene_lists(s, d).withColumns({"description": F.when(F.col("gene_ord") % 40 == 7, " ").otherwise("why"), "source": F.lit("where")})
    gene = F.when(F.col("category").startswith("PROMO"), F.lit(None)).when(F.col("gene_ord") % 50 == 9, " ").otherwise(F.col("gene_id"))
    return rows.withColumn("gene_id", gene.cast("string"))


add("gene_list_faults", lambda s, d: genes.faults(_described(s, d)), ["gene_lists"], f""", l AS (SELECT annotation, category, CASE WHEN category LIKE 'PROMO%' THEN NULL WHEN gene_ord % 50 = 9 THEN ' ' ELSE gene_id END AS gene_id, {_PROSE} FROM gene_lists),
h AS (SELECT annotation, gene_id, category, count(*) AS n FROM l WHERE trim(gene_id) <> '' GROUP BY ALL)
SELECT DISTINCT annotation, category, 'prose is blank' AS error FROM l WHERE trim(description) = '' OR trim(source) = ''
UNION ALL SELECT annotation, category, 'no genes' FROM l GROUP BY 1, 2 HAVING count(gene_id) = 0
UNION ALL SELECT DISTINCT annotation, category, 'a gene is blank' FROM l WHERE trim(gene_id) = ''
UNION ALL SELECT annotation, category, 'gene repeats: ' || gene_id FROM h WHERE n > 1
UNION ALL SELECT annotation, NULL, gene_id || ' is in several categories: ' || string_agg(category, ', ' ORDER BY category) FROM h GROUP BY annotation, gene_id HAVING count(*) > 1""")  # fmt: skip


def resolve_source(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations by pairs as names: in order and not, with parts that aren't known, and some on record."""
    k = F.col("s_suppkey")
    n = lambda x: F.concat(F.lit("n"), (x % 30).cast("string"))
    suppliers = b.table(s, d, "supplier")
    asked = suppliers.select(F.when(k % 4 == 0, n(k)).when(k % 4 == 1, F.concat(n(k), F.lit("_"), n(k * 7))).when(k % 4 == 2, F.concat(F.lit("my_"), n(k))).otherwise(F.concat_ws("_", n(k), n(k * 3), n(k * 5))).alias("name"))
    parts = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("n1"), F.lit("n2")))
    recorded = suppliers.filter("s_suppkey <= 20").select(n(k).alias("name"), parts.alias("components"))
    listed = b.table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("s3://f/"), "n_name")).alias("source_url"))
    return resolve.sources(asked, recorded, listed)


add("resolve_source", resolve_source, [], r"""WITH asked AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'n' || s_suppkey % 30 WHEN 1 THEN 'n' || s_suppkey % 30 || '_n' || s_suppkey * 7 % 30 WHEN 2 THEN 'my_n' || s_suppkey % 30
    ELSE 'n' || s_suppkey % 30 || '_n' || s_suppkey * 3 % 30 || '_n' || s_suppkey * 5 % 30 END AS name FROM supplier),
rec AS (SELECT 'n' || s_suppkey % 30 AS name, CASE WHEN s_suppkey % 5 = 0 THEN ['n1', 'n2'] END AS known FROM supplier WHERE s_suppkey <= 20),
lst AS (SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 's3://f/' || n_name END AS source_url FROM nation),
p AS (SELECT name, string_split(name, '_') AS parts, array_to_string(list_sort(string_split(name, '_')), '_') AS canonical FROM asked),
k AS (SELECT p.*, rec.name IS NOT NULL AS here, known, source_url, rec.name IS NULL AND len(parts) > 1 AND list_has_all(every, parts) AS spelled
  FROM p CROSS JOIN (SELECT list(name) AS every FROM (SELECT name FROM rec UNION SELECT name FROM lst)) LEFT JOIN rec USING (name) LEFT JOIN lst USING (name)),
t AS (SELECT *, CASE WHEN spelled AND canonical <> name THEN 'misspelled' WHEN spelled OR known IS NOT NULL THEN 'components' ELSE 'fetch' END AS kind FROM k)
SELECT name, kind, CASE WHEN kind = 'components' THEN coalesce(known, parts) END AS components,
  CASE WHEN kind = 'fetch' THEN coalesce(source_url, 'https://hgdownload.soe.ucsc.edu/goldenPath/' || name || '/bigZips/' || name || '.fa.gz') END AS url, CASE WHEN kind = 'fetch' THEN source_url IS NULL END AS derived,
  CASE WHEN kind = 'misspelled' THEN 'components are in order in a chimera''s name: ' || canonical END AS error FROM t""")  # fmt: skip

# --- records ---
add("record_disagreements", lambda s, d: records.disagreements(b.claimed(s, d), b.on_disk(s, d), ["dir", "file"]), ["claimed", "on_disk"], "SELECT dir, file, expected, actual FROM claimed LEFT JOIN on_disk USING (dir, file) WHERE actual IS NULL OR actual <> expected")
add("registration_gate", lambda s, d: records.gate(b.table(s, d, "orders").select(F.col("o_orderkey").alias("dir")), b.claimed(s, d), b.on_disk(s, d), "dir", "file"), ["claimed", "on_disk"],
    """SELECT dir, CASE WHEN w > 0 THEN 'mismatch' WHEN dir IN (SELECT dir FROM claimed) THEN 'finished' WHEN dir IN (SELECT dir FROM on_disk) THEN 'unfinished' ELSE 'fresh' END AS state, coalesce(w, 0) AS n_wrong
FROM (SELECT o_orderkey AS dir FROM orders) LEFT JOIN (SELECT dir, count(*) AS w FROM claimed LEFT JOIN on_disk USING (dir, file) WHERE actual IS NULL OR actual <> expected GROUP BY 1) USING (dir)""")  # fmt: skip
add("unclaimed_contents", lambda s, d: records.unclaimed(b.on_disk(s, d), b.claimed(s, d), ["dir", "file"]).select("dir", "file"), ["claimed", "on_disk"], "SELECT dir, file FROM on_disk EXCEPT SELECT dir, file FROM claimed")
add("component_status", lambda s, d: records.component_status(b.entries(s, d), b.digests(s, d)), ["entries", "digests"],
    """SELECT chimera, count(*) AS n_components, CASE WHEN bool_or(coalesce(e.sha256 <> g.sha256, false)) THEN 'changed' WHEN bool_and(e.sha256 IS NOT NULL AND g.sha256 IS NOT NULL) THEN 'unchanged' ELSE 'unknown' END AS status FROM entries e LEFT JOIN digests g USING (component) GROUP BY 1""")  # fmt: skip
add("expected_digest", lambda s, d: records.expected_digest(b.annotations(s, d).select("name", F.col("sha256").alias("table_sha256"), F.when(F.col("is_registered"), F.lit("r")).alias("record_sha256"))).select("name", "expected", "expected_from", F.col("expected").isNotNull().alias("verified")), ["annotations"],
    "SELECT name, coalesce(sha256, CASE WHEN is_registered THEN 'r' END) AS expected, CASE WHEN sha256 IS NOT NULL THEN 'table' WHEN is_registered THEN 'record' END AS expected_from, sha256 IS NOT NULL OR is_registered AS verified FROM annotations")

add("disagreement_text", lambda s, d: records.disagreements(b.claimed(s, d), b.on_disk(s, d), ["dir", "file"]).select("dir", "file", cells.disagreement_sentence(F.concat(F.lit("f"), F.col("file").cast("string")), F.col("expected"), F.col("actual")).alias("text")), ["claimed", "on_disk"],
    "SELECT dir, file, 'f' || file || ': recorded ' || expected || ' bytes, ' || coalesce('found ' || actual, 'missing') AS text FROM claimed LEFT JOIN on_disk USING (dir, file) WHERE actual IS NULL OR actual <> expected")
add("missing_components", lambda s, d: records.missing_components(b.entries(s, d), b.digests(s, d)), ["entries", "digests"], "SELECT DISTINCT chimera, component FROM entries WHERE component NOT IN (SELECT component FROM digests)")
add("index_state", lambda s, d: records.index_state(b.entries(s, d), b.digests(s, d)), ["entries", "digests"],
    "SELECT chimera, component, e.sha256, CASE WHEN e.sha256 IS NULL OR g.sha256 IS NULL THEN 'unknown' WHEN e.sha256 <> g.sha256 THEN 'stale' ELSE 'current' END AS state FROM entries e LEFT JOIN digests g USING (component)")


def file_freshness(s: SparkSession, d: str) -> DataFrame:
    """Orders as outputs, one in 17 of them empty, and their lines as inputs, a third of which are gone."""
    size = F.when(F.col("o_orderkey") % 17 != 0, F.floor("o_totalprice")).otherwise(0)
    outputs = b.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), size.alias("size"), F.date_add("o_orderdate", 60).alias("mtime"))
    inputs = b.table(s, d, "lineitem").filter("l_linenumber % 3 <> 0").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").cast("date").alias("mtime"))
    return records.fresh(outputs, inputs, "key")


add("file_freshness", file_freshness, [],
    """SELECT o_orderkey AS key, o_orderkey % 17 <> 0 AND floor(o_totalprice) > 0 AND coalesce((CAST(o_orderdate AS DATE) + 60) >= newest, newest IS NULL) AS fresh
FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS newest FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey""")  # fmt: skip


def component_contributions(s: SparkSession, d: str) -> DataFrame:
    rows = b.annotations(s, d).select("assembly", "name", (F.col("is_registered") & ~F.col("is_broken")).alias("registered"))
    return annotation.contributions(rows.join(_defaults(s, d), "assembly", "left"))


add("component_contributions", component_contributions, ["annotations"], f""", df AS ({_DEFAULT})
SELECT assembly, max(default_annotation) AS default_annotation, count(*) FILTER (WHERE is_registered AND NOT is_broken) AS n_registered,
  CASE WHEN max(default_annotation) IS NULL THEN CASE WHEN bool_or(is_registered AND NOT is_broken) THEN 'ambiguous' ELSE 'nothing' END WHEN bool_or(is_registered AND NOT is_broken AND name = default_annotation) THEN 'contributes' ELSE 'unregistered' END AS state
FROM annotations JOIN df USING (assembly) GROUP BY assembly""")  # fmt: skip
add("merged_annotation_name", lambda s, d: annotation.merged_names(b.annotations(s, d).select(F.col("assembly").alias("name"), F.col("ord").alias("part_ord"), F.when(F.col("is_registered"), F.col("name")).alias("annotation"))), ["annotations"],
    "SELECT assembly AS name, string_agg(name, '+' ORDER BY ord) FILTER (WHERE is_registered) AS merged FROM annotations GROUP BY 1")
add("annotation_repair", lambda s, d: b.annotations(s, d).filter("is_broken").select("assembly", "name", cells.repair_command(F.col("assembly"), F.col("name"), F.col("ord") % 4 == 0, F.col("is_offered"), F.when(F.col("ord") % 2 == 1, F.lit("a.gtf"))).alias("command")), ["annotations"],
    "SELECT assembly, name, CASE WHEN ord % 4 = 0 THEN 'register ' || assembly WHEN is_offered THEN 'register-annotation ' || assembly || ' ' || name ELSE 'register-gtf ' || assembly || CASE WHEN ord % 2 = 1 THEN ' a.gtf ' ELSE ' <path> ' END || name END || ' --force' AS command FROM annotations WHERE is_broken")


def fasta_headers(s: SparkSession, d: str) -> DataFrame:
    """Header lines, every fifth with blanks before its name, suffixed; sequence lines stay."""
    blanks = F.repeat(F.lit(" "), (F.col("ord") % 5).cast("int"))
    line = F.when(F.col("ord") % 3 == 0, F.lit("ACGT>x")).otherwise(F.concat(F.lit(">"), blanks, F.col("chrom"), F.lit(" of "), F.col("component")))
    return fasta.extend_headers(b.sizes(s, d).select("ord", line.alias("value")), "asm", SEP)


add("fasta_headers", fasta_headers, ["sizes"], "SELECT ord, CASE WHEN ord % 3 = 0 THEN 'ACGT>x' ELSE '>' || repeat(' ', CAST(ord % 5 AS INTEGER)) || chrom || '__asm of ' || component END AS value FROM sizes")

# --- shapes and indexes ---
add("genome_shape", lambda s, d: shape.genome_shape(b.sizes(s, d), "component"), ["sizes"], "SELECT component, CAST(sum(size) AS BIGINT) AS genome_length, count(*) AS n_sequences, avg(size) AS mean_length FROM sizes GROUP BY 1")
add("index_parameters", lambda s, d: shape.index_parameters(b.sizes(s, d), "component"), ["sizes"],
    "SELECT component, CAST(least(14, greatest(2, trunc(log2(sum(size)) / 2 - 1))) AS INTEGER) AS sa_index_nbases, CAST(least(18, trunc(log2(greatest(avg(size), 101)))) AS INTEGER) AS chr_bin_nbits FROM sizes WHERE size > 0 GROUP BY 1")
add("fai_offsets", lambda s, d: shape.fai(b.sizes(s, d).filter("size > 0").withColumns({"header_bytes": F.length("chrom") + 1, "width": F.lit(60)})), ["sizes"],
    """SELECT component, ord, chrom, size AS length, CAST(coalesce(sum(length(chrom) + 2 + size + (size + 59) // 60) OVER (PARTITION BY component ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(chrom) + 2 AS BIGINT) AS "offset", least(60, size) AS line_bases, least(60, size) + 1 AS line_width FROM sizes WHERE size > 0""")  # fmt: skip
