"""Registrations that are always whole: staged builds, proven parts, the registry, index rebuilds."""

import hashlib
import json
import uuid

import pytest

from locusflow import errors, genome, indexes, publication
from locusflow.genome import Genome, Place, read_record, register_assembly
from locusflow.sources import catalog, fasta

FIRST, SECOND = ">chrA one\nACGTNNac\nGT\n>chrB\nTTTT\n", ">chrA one\nGGGGGGGG\nGG\n>chrB\nCCCC\n"


@pytest.fixture
def root(spark, tmp_path):
    for name, text in (("first", FIRST), ("second", SECOND)):
        (tmp_path / f"{name}.fa").write_text(text)
    register_assembly(spark, "two", f"{tmp_path}/first.fa", str(tmp_path))
    return tmp_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tamper(path, data):
    """Other bytes in a file, without its checksum file, which would tell."""
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def builds(root):
    return sorted(p.name for p in (root / "genome/two").glob("build-*"))


@pytest.mark.parametrize("stage", ["fragments", "tiles", "lines", "publish", "record"])
def test_a_build_that_dies_leaves_the_old_one(spark, root, monkeypatch, stage):
    """Whatever stage it dies in, the assembly answers as before; the next build sweeps what was left."""
    opened, before = Genome(spark, "two", str(root)), builds(root)

    def die(*_, **__):
        raise OSError("killed")

    with monkeypatch.context() as m:
        if stage in ("fragments", "tiles", "lines"):
            m.setattr(fasta, stage, die)
        elif stage == "publish":
            m.setattr(publication.Build, "publish", die)
        else:
            m.setattr(publication, "replace_text", die)
        with pytest.raises(OSError, match="killed"):
            register_assembly(spark, "two", f"{root}/second.fa", str(root), force=True)
    again = Genome(spark, "two", str(root))
    assert again["chrA:4-10"] == opened["chrA:4-10"] == "NNacGT" and again.record == opened.record
    register_assembly(spark, "two", f"{root}/second.fa", str(root), force=True)
    assert Genome(spark, "two", str(root))["chrA:4-10"] == "GGGGGG" and len(builds(root)) == 1 and builds(root) != before


def test_a_first_build_that_dies_is_unfinished(spark, root, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(publication, "replace_text", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            register_assembly(spark, "new", f"{root}/first.fa", str(root))
    with pytest.raises(errors.UnfinishedRegistrationError):
        Genome(spark, "new", str(root))
    register_assembly(spark, "new", f"{root}/first.fa", str(root), force=True)
    assert Genome(spark, "new", str(root))["chrB"] == "TTTT"


def test_records_with_other_keys_are_none(spark, root):
    at = root / "genome/two/registration.json"
    whole = json.loads(at.read_text())
    for wrong in ({k: v for k, v in whole.items() if k != "sha256"}, whole | {"more": 1}, [whole], "text", whole | {"files": []}, whole | {"kind": None}):
        tamper(at, json.dumps(wrong))
        assert read_record(spark, str(root / "genome/two")) is None
    tamper(at, "{")
    assert read_record(spark, str(root / "genome/two")) is None
    tamper(at, json.dumps(whole))
    assert read_record(spark, str(root / "genome/two"))["sha256"] == sha(FIRST)


def test_what_is_proven_is_kept(spark, root):
    """With the right pin only what is missing is built, and the source is read only if that takes it."""
    place = root / "genome/two"
    folder = next(place.glob("build-*"))
    for f in (folder / "sizes").glob("*"):
        f.unlink()
    (root / "first.fa").rename(root / "away.fa")
    record = register_assembly(spark, "two", f"{root}/first.fa", str(root), sha(FIRST), force=True)
    assert record["details"]["kept"] == ["fasta", "store"] and Genome(spark, "two", str(root))["chrA:4-10"] == "NNacGT"
    store = next(p for p in place.glob("build-*/store/*.parquet"))
    data = bytearray(store.read_bytes())
    data[10] ^= 1
    tamper(store, bytes(data))  # as long as before, so that sizes don't tell
    with pytest.raises(Exception, match="first.fa"):
        register_assembly(spark, "two", f"{root}/first.fa", str(root), sha(FIRST), force=True)
    (root / "away.fa").rename(root / "first.fa")
    record = register_assembly(spark, "two", f"{root}/first.fa", str(root), sha(FIRST), force=True)
    assert record["details"]["kept"] == ["fasta"] and Genome(spark, "two", str(root))["chrB"] == "TTTT" and Genome(spark, "two", str(root)).chromosomes == ["chrA", "chrB"]
    with pytest.raises(errors.ChecksumMismatchError):
        register_assembly(spark, "two", f"{root}/first.fa", str(root), sha(SECOND), force=True)
    record = register_assembly(spark, "two", f"{root}/second.fa", str(root), sha(SECOND), force=True)
    assert record["details"]["kept"] == [] and Genome(spark, "two", str(root))["chrB"] == "CCCC"
    assert register_assembly(spark, "two", f"{root}/first.fa", str(root), force=True)["details"]["kept"] == []  # no pin proves nothing


def test_proven_lines_of_an_annotation(spark, root):
    text = 'chrA\ts\texon\t1\t4\t.\t+\t.\tgene_id "g"; transcript_id "t";\n'
    (root / "a.gtf").write_text(text)
    opened = Genome(spark, "two", str(root))
    opened.register_gtf("a", f"{root}/a.gtf", sha256=sha(text))
    (root / "a.gtf").unlink()
    record = opened.register_gtf("a", f"{root}/a.gtf", infer=True, force=True, sha256=sha(text))
    assert record["details"]["kept"] == ["lines"] and {(r.feature, r.id) for r in opened.features("a").collect()} == {("exon", "exon_1"), ("transcript", "t"), ("gene", "g")}


def jobs(spark, what):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    out = what()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_the_registry_takes_as_many_jobs_for_any_number_of_annotations(spark, root):
    place = Place(str(root), "two")

    def fake(*names):
        for name in names:
            folder = root / "genome/two/gtf" / name / "build-0/features"
            folder.mkdir(parents=True)
            (folder / "part-0.txt").write_text("x" * 10)
            publication.write_record(spark, place.annotation(name), "annotation", name, sha256="d", parts=["build-0/features"])

    fake("a+b", *[f"n{i}" for i in range(40)])  # Spark lists more than 32 folders by a job
    _, few = jobs(spark, lambda: Genome(spark, "two", str(root)).registry())
    fake(*[f"n{i}" for i in range(40, 120)])
    tamper(root / "genome/two/gtf/n7/build-0/features/part-0.txt", "longer than before")
    (root / "genome/two/gtf/n8/registration.json").unlink()
    tamper(root / "genome/two/gtf/n9/registration.json", "{}")
    (root / "genome/two/gtf/empty").mkdir()
    opened = Genome(spark, "two", str(root))
    states, many = jobs(spark, opened.registry)
    assert many <= few + 4  # joins run as what they meet suggests
    assert {n: s for n, s in states.items() if s != "finished"} == {"n7": "mismatch", "n8": "unfinished", "n9": "unfinished", "empty": "fresh"} and len(states) == 122
    _, none = jobs(spark, opened.registry)
    assert none == 0  # remembered
    assert {r.name for r in opened.annotation_status().filter("broken").collect()} == {"n7", "n8", "n9", "empty"}
    publication.remove(spark, place.annotation("n7"))
    assert "n7" not in opened.registry()


def test_index_rebuilds_by_stages(spark, root):
    opened = Genome(spark, "two", str(root))
    place = root / "genome/two/index/star"
    command = indexes.build_star_index(opened, limitGenomeGenerateRAM=5)
    assert command[0] == "STAR" and "--limitGenomeGenerateRAM" in command and indexes.index_state(opened, "star") == "unfinished"
    with pytest.raises(errors.UnfinishedRegistrationError):
        indexes.get_star_index(opened)
    with pytest.raises(errors.IndexNotBuiltError):
        indexes.record_index(opened, "star")
    (place / "SA").write_text("x")
    assert indexes.record_index(opened, "STAR", tools={"star": "2.7"})["tool_versions"]["star"] == "2.7"
    assert indexes.get_star_index(opened) == str(place) and not (place / "building.json").exists()
    assert indexes.build_star_index(opened) is None  # it is current
    assert indexes.build_star_index(opened, force=True) and indexes.index_state(opened, "star") == "unfinished" and not (place / "SA").exists()
    (place / "SA").write_text("y")  # the build dies here: nothing vouches for it
    with pytest.raises(errors.UnfinishedRegistrationError):
        indexes.get_star_index(opened)
    indexes.build_star_index(opened)
    (place / "SA").write_text("z")
    register_assembly(spark, "two", f"{root}/second.fa", str(root), force=True)
    changed = Genome(spark, "two", str(root))
    indexes.record_index(changed, "star")  # begun for the assembly of before
    assert indexes.index_state(changed, "star") == "stale" and indexes.build_star_index(changed) is not None
    with pytest.raises(errors.IndexNotBuiltError):
        indexes.get_chromap_index(changed)
    assert indexes.build_chromap_index(changed)[0] == "chromap"


def test_a_digest_is_one_stage(spark, root, monkeypatch):
    monkeypatch.setattr(catalog, "WHOLE_BYTES", 0)
    (root / "many").mkdir()
    for i in range(5):
        (root / f"many/part-{i}").write_text(f"{i}\n" * 1000 + "end" * (i == 2))
    whole = "".join((root / f"many/part-{i}").read_text() for i in range(5))
    spark.sparkContext.setJobGroup("digest", "one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert catalog.content_sha256(spark, f"{root}/many") == sha(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("digest")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages[0] == 1  # the last job, listed first, is the digest's; the listing of files is sorted


def test_facade_reads_given_metadata(spark, root):
    given = {"assembly_name": "two", "species": "yeast"}
    assert Genome(spark, "two", str(root), metadata=given).assembly_metadata() == given
    table = spark.createDataFrame([("two", "worm", 0), ("other", "x", 1)], "assembly_name string, species string, ord int")
    assert Genome(spark, "two", str(root), listed=table).assembly_metadata() == {"assembly_name": "two", "species": "worm"}
    assert Genome(spark, "two", str(root), metadata=given, listed=table).assembly_metadata() == given
    assert genome.Genome(spark, "two", str(root)).assembly_metadata() == {"assembly_name": "two"}
