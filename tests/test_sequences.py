"""Sequences cut from lines, packed tiles, pruned lookups, unique ids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusflow.functions import packing
from locusflow.genome import Genome, register_assembly
from locusflow.operators import annotation, fetch
from locusflow.sources import fasta, gtf


def drawn(draw, n):
    """Bases with runs of N, of other letters and of lower case."""
    out = [draw.choice("ACGT") for _ in range(n)]
    for letter in "NNNR":
        if n:
            at = draw.randrange(n)
            k = min(n - at, draw.randrange(1, max(2, n // 8)))
            out[at : at + k] = letter * k
    text = "".join(out)
    for _ in range(5):
        at = draw.randrange(n + 1)
        text = text[:at] + text[at : at + n // 10].lower() + text[at + n // 10 :]
    return text


@pytest.fixture(scope="module")
def records():
    draw = random.Random(8)
    out = [("chr1 long > one", drawn(draw, 1_000_000), 61), ("empty", "", 60), ("chr2", drawn(draw, 70), 70), (" padded\tname", drawn(draw, 5_001), 50)]
    return out + [(f"scaffold{i}", drawn(draw, draw.randrange(300)), 60) for i in range(300)] + [("last", "", 60)]


def spelled(records, end="\n"):
    return "".join(f">{header}{end}" + "".join(f"{seq[i : i + width]}{end}" for i in range(0, len(seq), width)) for header, seq, width in records)


@pytest.mark.parametrize(("end", "split"), [("\n", "65536"), ("\r\n", "7000"), ("\n", "134217728")])
def test_tiles_from_lines(spark, tmp_path, records, end, split):
    text = spelled(records, end)
    (tmp_path / "a.fa").write_bytes((text if end == "\n" else text + "\r\n\r\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = fasta.fragments(spark, f"{tmp_path}/a.fa", f"{tmp_path}/pieces")
        splits = found.select("block").distinct().count()
        got = {(r.place, r.tile): r for r in fasta.tiles(found, 4096).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits >= (10 if split != "134217728" else 1)  # one long record is read by many tasks
    assert found.agg(F.max(F.length("bases"))).first()[0] <= fasta.FRAGMENT
    want = {(place, i // 4096): seq[i : i + 4096] for place, (_, seq, _) in enumerate(records) for i in range(0, max(1, len(seq)), 4096)}
    assert {k: r.bases for k, r in got.items()} == want
    for (place, _), r in got.items():
        header, seq, width = records[place]
        assert (r.header, r.chrom, r.size, r.width) == (header, header.split()[0], len(seq), min(width, len(seq)))


def test_fragments_of_gzipped_files_and_of_none(spark, tmp_path, records):
    import gzip

    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(spelled(records[1:40]))
    found = fasta.tiles(fasta.fragments(spark, f"{tmp_path}/a.fa.gz", f"{tmp_path}/p"), 4096)
    assert Counter((r.place, len(r.bases)) for r in found.collect()) == Counter((p, len(seq[i : i + 4096])) for p, (_, seq, _) in enumerate(records[1:40]) for i in range(0, max(1, len(seq)), 4096))
    (tmp_path / "b.fa").write_text("")
    assert fasta.tiles(fasta.fragments(spark, f"{tmp_path}/b.fa", f"{tmp_path}/q"), 4096).collect() == []
    (tmp_path / "c.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.tiles(fasta.fragments(spark, f"{tmp_path}/c.fa", f"{tmp_path}/r"), 4096).collect()


def test_records_that_go_on_in_the_next_file(spark, tmp_path, records):
    """A folder's files are one FASTA, wherever lines were dealt to them: inside a record, before a header, none at all."""
    text = spelled(records).splitlines(keepends=True)
    cuts = [0, 1, 9_000, 9_000, 16_395, 17_000, len(text) - 1, len(text)]
    (tmp_path / "fa").mkdir()
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"fa/part-{i:05}.txt").write_text("".join(text[a:b]))
    rows = fasta.tiles(fasta.fragments(spark, f"{tmp_path}/fa", f"{tmp_path}/pieces"), 4096).collect()
    assert Counter((r.place, r.tile) for r in rows).most_common(1)[0][1] == 1
    assert {(r.place, r.tile): r.bases for r in rows} == {(place, i // 4096): seq[i : i + 4096] for place, (_, seq, _) in enumerate(records) for i in range(0, max(1, len(seq)), 4096)}
    assert {(r.place, r.header, r.size, r.width) for r in rows} == {(place, header, len(seq), min(width, len(seq))) for place, (header, seq, width) in enumerate(records)}


def test_packed_tiles_lose_nothing(spark):
    draw = random.Random(2)
    texts = ["", "A", "ACGTACG", "NNNN", "acgtn", "ACGTé", "AC-GT*", "Hello, World", "aC" * 2000, "N" * 65_536, drawn(draw, 65_536), drawn(draw, 65_535), "t" * 9, *[drawn(draw, draw.randrange(200)) for _ in range(150)]]
    rows = [(i, t, a := draw.randrange(len(t) + 1), draw.randrange(a, len(t) + 1)) for i, t in enumerate(texts)]
    rows += [(len(texts) + i, t, 0, len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, a int, b int")
    kept = df.select("id", "a", "b", *[c.alias(k) for k, c in packing.packed(F.col("text")).items()])
    columns = {c: F.col(c) for c in ("packed", "other", "masked", "bases")}
    got = {r.id: r for r in kept.select("id", packing.unpacked(columns, F.col("a"), F.col("b")).alias("x"), packing.unpacked(columns, F.col("a"), F.col("b"), False).alias("y"), F.col("packed").isNull().alias("plain")).collect()}
    for i, t, a, b in rows:
        assert got[i].x == t[a:b] and (got[i].plain or got[i].y == t[a:b].upper())
    assert {texts[i] for i in range(len(texts)) if got[i].plain} == {"ACGTé", "Hello, World", "aC" * 2000}


def test_a_packed_store_is_a_quarter(spark, tmp_path, records):
    (tmp_path / "a.fa").write_text(spelled(records[:1]))
    register_assembly(spark, "a", f"{tmp_path}/a.fa", str(tmp_path))
    held = sum(p.stat().st_size for p in tmp_path.glob("genome/a/build-*/store/*.parquet"))
    assert held < 0.3 * 1_000_000
    with Genome(spark, "a", str(tmp_path)) as opened:
        seq = records[0][1]
        for a, b in ((0, 10), (65_530, 65_545), (131_000, 400_123), (999_990, 1_000_000), (5, 5)):
            assert opened.fetch_sequence(f"chr1:{a}-{b}") == seq[a:b] and opened.fetch_sequence(f"chr1:{a}-{b}", masked=False) == seq[a:b].upper()


def read_rows(df):
    """Rows that the scan of a store gave out, once ``df`` has run."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        node = node.executedPlan() if node.nodeName().startswith("AdaptiveSparkPlan") else node.plan() if "QueryStage" in node.nodeName() else node
        if node.nodeName().startswith("Scan parquet"):
            out.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return out


def test_a_lookup_reads_what_it_needs(spark, tmp_path):
    """Keys are pushed to the scan, and the rows that it reads don't grow with the store."""
    read = {}
    for n in (300, 3_000):
        rows = spark.range(n * 40).select(F.concat(F.lit("chr"), F.lpad((F.col("id") / 40).cast("int").cast("string"), 5, "0")).alias("chrom"), F.lit(40 * 64).cast("long").alias("size"), (F.col("id") % 40).cast("int").alias("tile"), F.repeat(F.lit("ACGT"), 16).alias("bases"))
        ordered = fetch.packed_tiles(rows).repartitionByRange(4, "chrom", "tile").sortWithinPartitions("chrom", "tile")
        ordered.write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 500).parquet(f"file://{tmp_path}/{n}")
        store = spark.read.parquet(f"file://{tmp_path}/{n}")
        asked = spark.createDataFrame([(0, "chr00007", 100, 230, "+", 2560, None), (1, "chr00200", 0, 4, "-", 2560, None), (2, "chr9", 0, 4, ".", None, "unknown chromosome")], "rid long, chrom string, start long, end long, strand string, size long, error string")
        found = fetch.fetch(asked, store, tile=64)
        assert {r.rid: r.bases for r in found.collect()} == {0: ("ACGT" * 640)[100:230], 1: "ACGT", 2: None}
        assert "PushedFilters: [" in (plan := found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")) and "EqualTo(chrom,chr00007)" in plan
        read[n] = sum(read_rows(found))
        many = fetch.fetch(asked, store, tile=64, pruned=0)  # the other way gives the same
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, found.collect()))
    assert read[3_000] <= 1.5 * read[300] + 100 and read[3_000] < 0.2 * 3_000 * 40


def test_regions_by_shuffle_and_by_broadcast(spark, monkeypatch):
    draw = random.Random(5)
    seqs = {f"c{i}": drawn(draw, draw.randrange(900)) for i in range(30)}
    store = fetch.packed_tiles(fetch.tiles(spark.createDataFrame(list(seqs.items()), "chrom string, seq string"), 64))
    sizes = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "chrom string, size long")
    loci = []
    for i in range(400):
        c = draw.choice([*seqs, "none"])
        a = draw.randrange(len(seqs.get(c, "")) + 9)
        loci.append((i, c, a, a + draw.randrange(200), draw.choice("+-.")))
    asked = fetch.resolved(spark.createDataFrame(loci, "rid long, chrom string, start long, end long, strand string"), sizes)
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    want = {i: None if c not in seqs or b > len(seqs[c]) else seqs[c][a:b].translate(turn)[::-1] if s == "-" else seqs[c][a:b] for i, c, a, b, s in loci}
    assert {r.rid: r.bases for r in fetch.fetch(asked, store, tile=64).collect()} == want
    monkeypatch.setattr(fetch, "BROADCAST_ASKED", 300)
    assert {r.rid: r.bases for r in fetch.fetch(asked, store, tile=64).collect()} == want


def test_unique_ids_in_the_order_of_lines(spark, tmp_path):
    draw = random.Random(6)
    lines = []
    for _ in range(3_000):
        feature, name = draw.choice(["gene", "transcript", "exon", "CDS"]), draw.choice(["a", "b", "c"])
        attributes = draw.choice([f'gene_id "{name}"; transcript_id "{name}.1";', f'gene_id "{name}";', 'note "x";'])
        lines.append(f"chr1\ts\t{feature}\t1\t5\t.\t+\t.\t{attributes}")
    (tmp_path / "a.gtf").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = annotation.unique_ids(gtf.read(spark, f"{tmp_path}/a.gtf")).orderBy("line_ord").select("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    seen, want = Counter(), []
    for line in lines:
        feature, attributes = line.split("\t")[2], dict(x.strip().split(" ", 1) for x in line.split("\t")[8].rstrip(";").split(";"))
        key = {"gene": "gene_id", "transcript": "transcript_id"}.get(feature)
        named = attributes.get(key, "").strip('"') or None
        seen[named, feature if named is None else None] += 1
        k = seen[named, feature if named is None else None]
        want.append(f"{feature}_{k}" if named is None else named if k == 1 else f"{named}_{k - 1}")
    assert [r.id for r in found] == want and len(set(want)) == len(want)
