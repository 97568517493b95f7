"""Files in, answers out: FASTA and GTF ingest, the facade, chimeras, records, CLI."""

import gzip
import hashlib
import json

import pytest

from locusflow import cli, errors, indexes, payloads, values
from locusflow.genome import Genome, Place, read_record, register, register_assembly, resolve_source, table_row, verify_assembly, write_record
from locusflow.operators import genes
from locusflow.regions import Region, parse
from locusflow.sources import catalog, fasta, gtf
from locusflow.streaming import ingest

# The two-chromosome fixture and its answers.
TWO = ">chrA a > in a description\nACGTACGTac\ngtACGTACGT\n>chrB\nTTTTGGGG\n"
THREE = '#!comment\nchrA\tsrc\texon\t1\t8\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "b"; tag "a";\nchrA\tsrc\texon\t12\t18\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchrB\tsrc\tCDS\t2\t4\t.\t-\t0\tgene_id "g2"; transcript_id "t2";\nno tab\n'


@pytest.fixture
def root(spark, tmp_path):
    (tmp_path / "two.fa").write_text(TWO)
    register_assembly(spark, "two", f"{tmp_path}/two.fa", str(tmp_path), hashlib.sha256(TWO.encode()).hexdigest())
    return tmp_path


def test_fasta_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(TWO)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(TWO)
    for name in ("a.fa", "b.fa.gz"):
        rows = fasta.records(spark, f"{tmp_path}/{name}").orderBy("place").collect()
        assert [(r.place, r.chrom, r.seq, r.width) for r in rows] == [(0, "chrA", "ACGTACGTacgtACGTACGT", 10), (1, "chrB", "TTTTGGGG", 8)]


@pytest.mark.parametrize(
    ("locus", "strand", "bases"),
    [("chrA:0-8", ".", "ACGTACGT"), ("chrA:8-12", ".", "acgt"), ("chrA:0-6", "-", "GTACGT"), ("chrA:0-20", "+", "ACGTACGTacgtACGTACGT"), ("chrB", ".", "TTTTGGGG"), ("chrA:5-5", ".", ""), (" chrA:1-3 ", ".", "CG")],
)
def test_fetch(spark, root, locus, strand, bases):
    assert Genome(spark, "two", str(root)).fetch_sequence(locus, strand) == bases


@pytest.mark.parametrize("locus", ["chrA:0-21", "chrA:10-5", "chrZ:0-5", "chrA:bad"])
def test_fetch_errors(spark, root, locus):
    with pytest.raises(errors.RegionError):
        Genome(spark, "two", str(root)).fetch_sequence(locus)


def test_record_gate(spark, root):
    genome = Genome(spark, "two", str(root))
    assert genome.record["kind"] == "genome" and genome.chromosomes == ["chrA", "chrB"] and genome.shape()["genome_length"] == 28
    assert [(r.length, r.offset, r.line_bases, r.line_width) for r in genome.fai().orderBy("ord").collect()] == [(20, 27, 10, 11), (8, 55, 8, 9)]
    assert verify_assembly(spark, "two", f"{root}/two.fa", root=str(root))["verified"]
    with pytest.raises(errors.ChecksumMismatchError):
        verify_assembly(spark, "two", f"{root}/two.fa", "0" * 64, str(root))
    claimed = next(f for f in genome.record["files"] if "/store/" in f and f.endswith(".parquet"))
    (root / "genome/two" / claimed).unlink()
    with pytest.raises(errors.RegistrationMismatchError):
        Genome(spark, "two", str(root))
    (root / "genome/two/registration.json").unlink()
    with pytest.raises(errors.UnfinishedRegistrationError):
        Genome(spark, "two", str(root))


def test_annotations(spark, root):
    (root / "a.gtf").write_text(THREE)
    (root / "bad.gtf").write_text(THREE.replace("chrB", "B"))
    genome = Genome(spark, "two", str(root))
    with pytest.raises(errors.ChromosomeMismatchError) as wrong:
        genome.register_gtf("bad", f"{root}/bad.gtf")
    assert wrong.value.missing == ["B"]
    genome.register_gtf("a", f"{root}/a.gtf", infer=True)
    assert genome.default_annotation == "a"
    rows = {(r.feature, r.start, r.end) for r in genome.features().collect()}
    assert rows == {("exon", 0, 8), ("exon", 11, 18), ("CDS", 1, 4), ("transcript", 0, 18), ("gene", 0, 18)}
    assert genome.features().filter("start = 0 AND feature = 'exon'").first().attributes["tag"] == ["a", "b"]
    offered = spark.createDataFrame([("two", "b", 0), ("two", "a", 1), ("other", "c", 0)], "assembly string, name string, ord int")
    assert {(r.name, r.state) for r in genome.annotation_status(offered).collect()} == {("a", "registered"), ("b", "offered, not registered")}
    with pytest.raises(errors.AnnotationNotRegisteredError):
        genome.features("b")


def test_chimera(spark, root):
    (root / "x.fa").write_text(">chrA\nGGCC\n>c_1\nAA\n")
    register_assembly(spark, "axe", f"{root}/x.fa", str(root))
    both = Genome.chimera(spark, ["two", "axe"], str(root))
    assert both.place.assembly == "axe_two" and both.separator == "__" and both.components == ["axe", "two"]
    assert both.chromosomes == ["chrA__axe", "c_1__axe", "chrA__two", "chrB__two"] and both.fetch_sequence("chrA__two:8-12") == "acgt"
    assert {(r.chrom, r.component) for r in both.chrom_components().collect()} == {("chrA__axe", "axe"), ("c_1__axe", "axe"), ("chrA__two", "two"), ("chrB__two", "two")}
    assert both.component_status() == "unchanged" and both.merged_annotation is None
    with pytest.raises(errors.ChimeraNamingError):
        Genome.chimera(spark, ["two"], str(root))
    with pytest.raises(errors.ChimeraNamingError):
        Genome.chimera(spark, ["axe_two", "two"], str(root))


def test_chimera_merges_annotations(spark, root):
    (root / "x.fa").write_text(">chrA\nGGCC\n>c_1\nAA\n")
    with gzip.open(root / "a.gtf.gz", "wt") as f:
        f.write(THREE)
    register_assembly(spark, "axe", f"{root}/x.fa", str(root))
    two = Genome(spark, "two", str(root))
    pin = hashlib.sha256(THREE.encode()).hexdigest()
    assert two.register_gtf("a", f"{root}/a.gtf.gz", sha256=pin)["sha256"] == pin  # a digest is of unpacked bytes
    with pytest.raises(errors.ChecksumMismatchError):
        two.register_gtf("c", f"{root}/a.gtf.gz", sha256="0" * 64)
    table = spark.createDataFrame([("axe", "x", 0, f"{root}/x.gtf", None, False), ("axe", "y", 1, f"{root}/x.gtf", None, True)], "assembly string, name string, ord int, url string, sha256 string, default boolean")
    (root / "x.gtf").write_text('c_1\tsrc\texon\t1\t2\t.\t+\t.\tgene_id "h1";')
    axe = Genome(spark, "axe", str(root), offered=table)
    with pytest.raises(errors.AnnotationNotRegisteredError):
        Genome.chimera(spark, [axe, "two"], str(root))
    axe.register_annotation("x")
    axe.register_annotation("y")
    with pytest.raises(errors.AmbiguousDefaultAnnotationError):
        Genome.chimera(spark, ["axe", "two"], str(root))
    both = Genome.chimera(spark, [axe, "two"], str(root))
    assert both.merged_annotation == both.default_annotation == "y+a" and both.component_annotations == {"axe": "y", "two": "a"}
    assert both.component_status() == "unchanged"
    assert {(r.seqname, r.start) for r in both.features().collect()} == {("c_1__axe", 0), ("chrA__two", 0), ("chrA__two", 11), ("chrB__two", 1)}
    for name, assembly, ids in (("a", "two", ["g2", "g1"]), ("y", "axe", ["h1"])):
        (root / f"{name}.json").write_text(json.dumps({"annotation": name, "assembly": assembly, "categories": {"rRNA": {"description": "d", "source": "s", "gene_ids": ids}, f"of {name}": {"description": "d", "source": "s", "gene_ids": ids}}}))
    lists = catalog.gene_lists(spark, f"{root}/*.json")
    assert both.gene_list("rRNA", lists) == ["h1", "g2", "g1"] and list(both.gene_lists(lists)) == ["rRNA", "of y", "of a"]
    with pytest.raises(errors.GeneListAssemblyMismatchError):
        two.gene_list("rRNA", lists, "y")
    (root / "x.gtf").write_text('c_1\tsrc\texon\t1\t1\t.\t+\t.\tgene_id "h1";')
    axe.register_annotation("y", force=True)
    with pytest.raises(errors.RegistrationMismatchError):
        both.component_status()
    again = Genome.chimera(spark, [Genome(spark, "axe", str(root), "x"), "two"], str(root), force=True)
    assert again.default_annotation == "x+a" and again.component_status() == "unchanged"


def test_files_written(spark, root):
    parts = [("two", fasta.lines(spark, f"{root}/two.fa"))]
    fasta.write_concatenated(parts, f"{root}/out.fa", "__")
    text = "".join(p.read_text() for p in sorted((root / "out.fa").glob("part-*")))
    assert text == TWO.replace(">chrA ", ">chrA__two ").replace(">chrB", ">chrB__two")
    (root / "a.gtf").write_text(THREE)
    gtf.write_merged([("two", gtf.lines(spark, f"{root}/a.gtf"))], f"{root}/merged", "__")
    lines = "".join(p.read_text() for p in sorted((root / "merged").glob("part-*"))).splitlines()
    assert lines == [x.replace("\tsrc", "__two\tsrc", 1) for x in THREE.splitlines() if "\t" in x]
    fasta.write_chrom_sizes(Genome(spark, "two", str(root)).sizes.withColumnRenamed("size", "length"), f"{root}/sizes")
    assert "".join(p.read_text() for p in (root / "sizes").glob("part-*")) == "chrA\t20\nchrB\t8\n"


def test_gene_lists(spark, root):
    payload = {"annotation": "a", "assembly": "two", "categories": {"rRNA": {"description": "d", "source": "s", "gene_ids": ["g9", "g1"]}, "empty": {"description": " ", "source": "s", "gene_ids": []}}}
    (root / "a.json").write_text(json.dumps(payload))
    lists = catalog.gene_lists(spark, f"{root}/a.json")
    genome = Genome(spark, "two", str(root))
    assert genome.gene_list("rRNA", lists, "a") == ["g9", "g1"]
    assert {(r.category, r.error) for r in genes.faults(lists).collect()} == {("empty", "prose is blank"), ("empty", "no genes")}
    with pytest.raises(errors.GeneCategoryNotDeclaredError):
        genome.gene_list("tRNA", lists, "a")
    with pytest.raises(errors.NoGeneCategoriesError):
        genome.gene_list("rRNA", lists, "b")


def test_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("assembly_name\tucsc_name\tncbi_taxid\tdefault\nhg\t\t9606\tYes\nmm\t mm1 \tx\t\n\tq\t1\tmaybe\n")
    rows = catalog.table(spark, f"{tmp_path}/t.tsv", ("ncbi_taxid",), ("assembly_name",), ("default",)).collect()
    assert [tuple(r) for r in rows] == [(0, "hg", None, 9606, True, None), (1, "mm", "mm1", None, False, "ncbi_taxid is not an integer"), (2, None, "q", 1, None, "assembly_name is blank")]


def test_cli(spark, root, capsys):
    assert cli.run(spark, ["revcomp", "ACGTac"]) == 0 and capsys.readouterr().out == "gtACGT\n"
    assert cli.run(spark, ["revcomp", "AXQ"]) == 2
    assert cli.run(spark, ["--data", str(root), "verify", "two", f"{root}/two.fa", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["verified"]
    assert cli.run(spark, ["--data", str(root), "annotations", "none"]) == 1


def test_stream(spark, root):
    (root / "in").mkdir()
    (root / "in/a.gtf").write_text(THREE.replace("chrB", "B"))
    good, bad = [], []
    sizes = Genome(spark, "two", str(root)).sizes
    query = ingest.watch_gtf(spark, f"{root}/in", sizes, f"{root}/cp", lambda d: good.extend(d.collect()), lambda d: bad.extend(d.collect()))
    query.awaitTermination(60)
    assert len(good) == 2 and [r.seqname for r in bad] == ["B"]


def test_coordinates_that_are_no_numbers(spark, root):
    (root / "odd.gtf").write_text(THREE.replace("exon\t12", "exon\tx12"))
    rows = [(r.feature, r.start, r.error) for r in gtf.read(spark, f"{root}/odd.gtf").collect()]
    assert rows == [("exon", 0, None), ("exon", None, "a coordinate is no number"), ("CDS", 1, None)]


def test_loci_of_a_stream(spark, root):
    (root / "loci").mkdir()
    (root / "loci/a.csv").write_text("1,chrA:0-4\n2,chrA:0-99\n3,x:y\n4,chrB\n")
    sizes = Genome(spark, "two", str(root)).sizes.select("chrom", "size")
    loci = spark.readStream.schema("rid long, locus string").csv(f"{root}/loci")
    found = []
    query = ingest.resolve_loci(loci, sizes).writeStream.option("checkpointLocation", f"{root}/cp2").trigger(availableNow=True).foreachBatch(lambda d, _: found.extend(d.collect())).start()
    query.awaitTermination(60)
    assert sorted((r.rid, r.start, r.end, r.error) for r in found) == [(1, 0, 4, None), (2, 0, 99, "end exceeds chromosome length"), (3, 0, None, "malformed region"), (4, 0, 8, None)]


def test_no_record_is_none(spark, tmp_path):
    assert read_record(spark, Place(str(tmp_path), "x").path) is None


ODD = ">chrA  a > in a description\r\nACGTAC\r\nGT\r\n\r\n>c_1\tx\nAA\nA"  # carriage returns, a blank line, no last line end


def test_chimera_fasta_is_verbatim(spark, root):
    (root / "x.fa").write_bytes(ODD.encode())
    with gzip.open(root / "z.fa.gz", "wb") as f:
        f.write(TWO.encode())
    register_assembly(spark, "axe", f"{root}/x.fa", str(root), hashlib.sha256(ODD.encode()).hexdigest())
    register_assembly(spark, "zed", f"{root}/z.fa.gz", str(root), hashlib.sha256(TWO.encode()).hexdigest())
    both = Genome.chimera(spark, ["zed", "axe"], str(root))
    suffixed = lambda text, to: text.replace(">chrA ", f">chrA__{to} ").replace(">c_1", f">c_1__{to}").replace(">chrB", f">chrB__{to}")
    want = (suffixed(ODD, "axe") + "\n" + suffixed(TWO, "zed")).encode()
    held = b"".join(p.read_bytes() for p in sorted((root / "genome/axe_zed").glob("build-*/fasta/part-*")))
    assert held == want and both.record["sha256"] == hashlib.sha256(want).hexdigest()
    assert verify_assembly(spark, "axe_zed", root=str(root)) == {"assembly": "axe_zed", "fasta": both.part("fasta"), "sha256": both.record["sha256"], "expected": both.record["sha256"], "expected_from": "record", "verified": True, "components": "unchanged"}
    assert both["chrA__axe:4-8"] == "ACGT" and both["c_1__axe"] == "AAA"


@pytest.mark.parametrize("text", ["", "\n", "a", "A", "C", "xA\nA", "AC\n", "A\nC", "a\n", "a\n\n", "a\r\nb", "x\n" * 5000])
def test_digests(spark, tmp_path, text, monkeypatch):
    (tmp_path / "t").write_bytes(text.encode())
    want = hashlib.sha256(text.encode()).hexdigest()
    assert catalog.content_sha256(spark, f"{tmp_path}/t") == want
    with gzip.open(tmp_path / "t.gz", "wb") as f:
        f.write(text.encode())
    assert catalog.content_sha256(spark, f"{tmp_path}/t.gz") == want
    monkeypatch.setattr(catalog, "WHOLE_BYTES", 0)
    assert catalog.content_sha256(spark, f"{tmp_path}/t.gz") == want


def test_digest_of_many_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(60_000)) + "the end"
    (tmp_path / "t").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert catalog.content_sha256(spark, f"{tmp_path}/t") == hashlib.sha256(text.encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cutting_takes_time_in_proportion(spark):
    """Four times the bases, at most some eight times the seconds; quadratic cutting took sixteen."""
    import time

    from pyspark.sql import functions as F

    from locusflow.operators import fetch

    def seconds(n):
        row = spark.range(1).select(F.lit("c").alias("chrom"), F.expr(f"repeat('ACGTN', {n // 5})").alias("seq"))
        begin = time.time()
        got = fetch.tiles(row, 60).agg(F.count("*"), F.sum(F.length("bases"))).first()
        assert tuple(got) == (-(-n // 60), n)
        return time.time() - begin

    seconds(100_000)
    assert seconds(8_000_000) < 8 * seconds(2_000_000) + 1


def test_regions(spark, root):
    r = Region.from_string(" chrA:1,0-12 ", "-")
    assert (r.chrom, r.start, r.end, len(r), r.length, str(r)) == ("chrA", 10, 12, 2, 2, "chrA:10-12")
    for bad in ("chrA", "chrA:x", "chrA:5-3"):
        with pytest.raises(errors.RegionError):
            Region.from_string(bad)
    for wrong in ((-1, 2, "."), (1, 2, "x")):
        with pytest.raises(ValueError):
            Region("c", *wrong)
    with Genome(spark, "two", str(root)) as genome:
        assert genome[Region("chrA", 0, 6, "-")] == "GTACGT" and genome["chrA:8-12"] == "acgt"
        assert genome.resolve("chrB") == Region("chrB", 0, 8)
        with pytest.raises(errors.RegionError, match="chrA, chrB"):
            genome["chrQ:0-1"]
    with pytest.raises(errors.ClosedGenomeError):
        genome["chrB"]
    register_assembly(spark, "axe", f"{root}/two.fa", str(root))
    both = Genome.chimera(spark, ["two", "axe"], str(root))
    with pytest.raises(errors.RegionError, match="chrA__axe, chrA__two"):
        both["chrA:0-4"]


def test_sources_of_names(spark, root):
    table = spark.createDataFrame([("hg", "s3://x/hg.fa", "aa"), ("two", None, None)], "assembly_name string, source_url string, sha256 string")
    means = lambda name: resolve_source(spark, name, str(root), table)
    assert means("hg")["url"] == "s3://x/hg.fa" and not means("hg")["derived"] and means("mm")["derived"]
    assert means("hg_two")["components"] == ["hg", "two"] and means("my_two")["kind"] == "fetch"
    with pytest.raises(errors.ChimeraNamingError, match="hg_two"):
        means("two_hg")
    register_assembly(spark, "hg_two", f"{root}/two.fa", str(root))  # a record is believed before a name
    assert means("hg_two")["kind"] == "fetch"
    register_assembly(spark, "axe", f"{root}/two.fa", str(root))
    assert register(spark, "axe_two", str(root))["details"]
    assert means("axe_two")["components"] == ["axe", "two"]
    with pytest.raises(ValueError, match="chimera"):
        table_row(spark, "axe_two", table, root=str(root))
    row = table_row(spark, "two", table, f"{root}/two.fa", str(root))
    assert row == {"assembly_name": "two", "source_url": f"{root}/two.fa", "sha256": hashlib.sha256(TWO.encode()).hexdigest()}


def test_half_a_chimera_is_refused(spark, root):
    place = Place(str(root), "two").path
    write_record(spark, place, "genome", "two", details={"components": [{"name": "a"}]})
    with pytest.raises(errors.RegistrationError, match="half"):
        Genome(spark, "two", str(root))


def test_indexes(spark, root):
    genome = Genome(spark, "two", str(root))
    with pytest.raises(errors.IndexNotBuiltError):
        indexes.index_path(genome, "star")
    place = root / "genome/two/index/star"
    place.mkdir(parents=True)
    (place / "SA").write_text("x")
    with pytest.raises(errors.UnfinishedRegistrationError):
        indexes.index_path(genome, "star")
    record = indexes.record_index(genome, "star", {"sjdb_overhang": 99, "many": [1, 2]})
    assert indexes.index_path(genome, "star") == str(place) and indexes.index_state(genome, "star") == "current"
    assert "--sjdb_overhang" in record["details"]["command"] and indexes.aligner("chromap").flags({"a_b": (1, 2)}) == ["--a-b", "1", "2"]
    Genome(spark, "two", str(root))  # an index isn't one of the assembly's own files
    (root / "other.fa").write_text(TWO.replace("GGGG", "GGGA"))
    register_assembly(spark, "two", f"{root}/other.fa", str(root), force=True)
    assert indexes.index_state(genome, "star") == "stale"
    with pytest.raises(errors.RegistrationMismatchError):
        indexes.index_path(Genome(spark, "two", str(root)), "star")
    with pytest.raises(LookupError):
        indexes.aligner("none")


def test_gene_list_files(spark, tmp_path):
    good = {"annotation": "good", "assembly": "two", "categories": {"rRNA": {"description": "d", "source": "s", "gene_ids": ["g1", "g2"]}}}
    category = lambda **change: json.dumps(good | {"annotation": "x", "categories": {"c": {"description": "d", "source": "s", "gene_ids": ["g"]} | change}})
    files = {
        "good": json.dumps(good), "broken": "{", "array": "[1]", "bare": "{}", "renamed": json.dumps(good), "none": json.dumps(good | {"annotation": "none", "categories": {}}),
        "word": json.dumps(good | {"annotation": "word", "categories": "c"}), "entry": json.dumps(good | {"annotation": "entry", "categories": {"c": 3}}),
        "prose": category(description=" ", source=4), "ids": category(gene_ids=[]), "number": category(gene_ids=["g", 5, " "]), "twice": category(gene_ids=["g", "g"]),
        "both": json.dumps(good | {"annotation": "both", "categories": {c: good["categories"]["rRNA"] for c in "ab"}}),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text.replace('"annotation": "x"', f'"annotation": "{name}"'))
    found = {}
    for r in catalog.gene_list_faults(spark, f"{tmp_path}/*.json").collect():
        found.setdefault(r.file, set()).add(r.error)
    assert found == {
        "broken": {"not JSON"}, "array": {"not an object"}, "bare": {"no annotation", "no assembly", "no categories"}, "renamed": {"the file is named for another annotation"}, "none": {"categories are none"},
        "word": {"categories are none"}, "entry": {"not an object"}, "prose": {"description is blank", "source is blank"}, "ids": {"no genes"}, "number": {"a gene is no text or blank"}, "twice": {"gene repeats: g"},
        "both": {"g1 is in several categories", "g2 is in several categories"},
    }
    assert catalog.checked_gene_lists(spark, f"{tmp_path}/good.json").count() == 2
    with pytest.raises(errors.CuratedGeneListError, match="twice"):
        catalog.checked_gene_lists(spark, f"{tmp_path}/twice.json")


def test_cli_lists_and_rows(spark, root, capsys):
    data = ["--data", str(root)]
    (root / "a.gtf").write_text(THREE)
    register_assembly(spark, "axe", f"{root}/two.fa", str(root))
    for name in ("two", "axe"):
        assert cli.run(spark, [*data, "register-gtf", name, f"{root}/a.gtf", f"a{name}"]) == 0
        (root / f"a{name}.json").write_text(json.dumps({"annotation": f"a{name}", "assembly": name, "categories": {"rRNA": {"description": "d", "source": "s", "gene_ids": [f"g{name}"]}}}))
    assert cli.run(spark, [*data, "register", "axe_two"]) == 0
    capsys.readouterr()
    assert cli.run(spark, [*data, "gene-categories", "axe_two", "--lists", f"{root}/*.json"]) == 0
    assert capsys.readouterr().out == "categories of aaxe+atwo of axe_two\nrRNA  2\n"
    assert cli.run(spark, [*data, "gene-list", "axe_two", "rRNA", "--lists", f"{root}/*.json"]) == 0 and capsys.readouterr().out == "gaxe\ngtwo\n"
    (root / "none").mkdir()
    (root / "none/x.json").write_text(json.dumps({"annotation": "x", "assembly": "two", "categories": {"c": {"description": "d", "source": "s", "gene_ids": ["g"]}}}))
    assert cli.run(spark, [*data, "gene-categories", "two", "--lists", f"{root}/none/*.json"]) == 1
    capsys.readouterr()
    assert cli.run(spark, [*data, "annotations", "two"]) == 0 and capsys.readouterr().out == "atwo  registered, not offered\ndefault annotation: atwo\n"
    assert cli.run(spark, [*data, "verify", "axe_two"]) == 0 and capsys.readouterr().out.endswith("components: unchanged\n")
    (root / "t.tsv").write_text("assembly_name\tspecies\tsource_url\tsha256\ntwo\tyeast\t\told\n")
    assert cli.run(spark, [*data, "table-row", "two", "--table", f"{root}/t.tsv", "--source", f"{root}/two.fa"]) == 0
    assert capsys.readouterr().out == f"two\tyeast\t{root}/two.fa\t{hashlib.sha256(TWO.encode()).hexdigest()}\n"
    assert cli.run(spark, [*data, "table-row", "axe_two", "--table", f"{root}/t.tsv"]) == 1
    for f in (root / "genome/axe_two/gtf/aaxe+atwo").glob("build-*/features/*"):
        f.unlink()
    assert Genome(spark, "axe_two", str(root), "aaxe+atwo").default_summary().endswith(", broken: run register axe_two --force")
    assert cli.run(spark, [*data, "annotations", "axe_two", "--json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert list(report) == ["assembly", "directory", "default_annotation", "annotations"] and list(report["annotations"][0]) == list(payloads.STATUS_ROW)
    assert report["annotations"][0]["repair"] == "register axe_two --force" and report["annotations"][0]["problem"].endswith("disagrees with its record")
    assert cli.run(spark, [*data, "gene-list", "two", "rRNA", "--lists", f"{root}/a*.json", "--json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"assembly": "two", "annotation": "atwo", "category": "rRNA", "gene_ids": ["gtwo"], "sources": [{"component": None, "annotation": "atwo", "description": "d", "source": "s", "gene_ids": ["gtwo"]}]}
    assert cli.run(spark, [*data, "register", "two", "--json"]) == 0
    assert list(json.loads(capsys.readouterr().out)) == [*payloads.RECORD, "assembly", "directory"]


def test_typed_sequences(spark, root):
    seq = values.DNA("ACgtN")
    assert isinstance(seq, str) and repr(seq) == "DNA('ACgtN')" and repr(seq[1:3]) == "DNA('Cg')" and repr(seq[-1]) == "DNA('N')" and seq[::-2] == "NgA"
    assert repr(seq.reverse_complement()) == "DNA('NacGT')" and repr(seq.transcribe()) == "RNA('ACguN')" and seq.gc_content() == 0.4 and values.DNA("").gc_content() == 0.0
    assert repr(seq.transcribe().back_transcribe()) == "DNA('ACgtN')" and values.RNA("ACU").complement() == "UGA" and values.RNA.outside("ATCN") == ["N", "T"] and values.Protein.outside("MKZ") == ["Z"]
    with pytest.raises(IndexError):
        seq[5]
    with pytest.raises(TypeError):
        values.Sequence("ACGT")
    assert repr(Genome(spark, "two", str(root))["chrA:8-12"]) == "DNA('acgt')"


@pytest.mark.parametrize("text", ["c:1", "c:1-", "c:-1", "c:1-2-3", ":1-2", "a:b", "c:1-2:", "c:,-2", "c:1.5-2", "a\nb:1-2", "c:\u0661-2"])
def test_loci_that_are_none(text):
    with pytest.raises(errors.RegionError):
        parse(text)
