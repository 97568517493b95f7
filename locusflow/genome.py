"""The scalar facade: an assembly by name in a data folder, whose answers come from the bulk operators.

Below ``<data>/genome/<assembly>`` are an assembly's registration, ``gtf/<annotation>`` with one for
each annotation, and ``index/<aligner>`` likewise. The parts of an assembly are ``store`` (tiles),
``sizes`` (ordered) and ``fasta`` (its lines to the byte; text of a chimera), those of an annotation
``lines`` (or the ``merged`` file of a chimera) and ``features``; see :mod:`locusflow.publication`.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors, publication
from .functions import cells, names, region, sequence
from .operators import annotation as annotation_ops
from .operators import fetch, genes, naming, resolve, shape
from .operators import records as record_ops
from .publication import Build, check_registration, read_record, write_record
from .regions import Region, parse
from .sources import catalog, fasta, gtf
from .values import DNA

SEQUENCES, SIZES, FASTA, FEATURES, LINES, MERGED = "store", "sizes", "fasta", "features", "lines", "merged"
__all__ = ["Genome", "Place", "check_registration", "data_dir", "read_record", "register", "register_assembly", "resolve_source", "reverse_complement", "table_row", "verify_assembly", "write_record"]


def data_dir(spark: SparkSession) -> str:
    """The data folder: ``spark.locusflow.data``, else ``$LOCUSFLOW_DATA``, else one below the home folder."""
    return spark.conf.get("spark.locusflow.data", None) or os.environ.get("LOCUSFLOW_DATA") or os.path.expanduser("~/locusflow_data")


@dataclass(frozen=True)
class Place:
    """Where an assembly's parts are."""

    root: str
    assembly: str

    @property
    def path(self) -> str:
        return f"{self.root}/genome/{self.assembly}"

    def annotation(self, name: str) -> str:
        return f"{self.path}/gtf/{name}"


def write_store(cut: DataFrame, path: str) -> None:
    """Tiles (chrom, tile, bases, ...) in two bits a base, sorted, in row groups so small that a lookup reads little."""
    ordered = fetch.packed_tiles(cut).repartitionByRange("chrom", "tile").sortWithinPartitions("chrom", "tile")
    ordered.write.option("parquet.block.size", fetch.ROW_GROUP).parquet(path)


def register_assembly(spark: SparkSession, assembly: str, source: str, root: str | None = None, sha256: str | None = None, force: bool = False) -> dict:
    """Ingests a FASTA (plain or gzipped) as tiles, sizes and lines, proves its digest if one is given, and records it.

    What is registered stays until all is built. With ``force`` and the digest that the record
    has, what is there to the byte is kept, only the rest is built, and the source is read only if that
    takes it.
    """
    place = Place(root or data_dir(spark), assembly)
    if not force and (done := check_registration(spark, place.path, f"register {assembly} --force")):
        return done
    old = read_record(spark, place.path)
    proven = bool(force and sha256 and old and old["sha256"] == sha256)
    build = Build(spark, place.path, publication.intact(spark, place.path, old) if proven else None)
    digest = sha256
    if not (SEQUENCES in build and FASTA in build):
        digest = catalog.content_sha256(spark, source)
        if sha256 and digest != sha256:
            raise errors.ChecksumMismatchError(f"{source}: expected {sha256}, got {digest}")
    if SEQUENCES not in build:
        build.kept.pop(SIZES, None)
        pieces = f"{build.part('pieces')}"
        # Pieces of lines are written once and then dealt to their tiles; what describes a sequence goes with its tiles.
        write_store(fasta.tiles(fasta.fragments(spark, source, pieces), fetch.TILE), build.part(SEQUENCES))
        del build.made["pieces"]
        publication.remove(spark, pieces)
    if SIZES not in build:
        first = spark.read.parquet(build.part(SEQUENCES)).filter("tile = 0")
        first.select(F.col("place").alias("ord"), "chrom", "size", F.length("header").alias("header_bytes"), "width", "header").write.parquet(build.part(SIZES))
    if FASTA not in build:
        fasta.lines(spark, source).write.parquet(build.part(FASTA))
    return build.publish("genome", place.assembly, source, digest)


def resolve_source(spark: SparkSession, assembly: str, root: str | None = None, listed: DataFrame | None = None) -> dict:
    """What an assembly's name means here: a dict of kind, components, url and derived; a chimera's name out of order is an error.

    ``listed`` is the curated table (assembly_name, source_url). See :func:`locusflow.operators.resolve.sources`.
    """
    place = Place(root or data_dir(spark), assembly)
    known = {n: read_record(spark, f"{place.root}/genome/{n}") for n in {assembly, *assembly.split("_")} if n}
    rows = [(n, [c["name"] for c in (r["details"].get("components") or [])] or None) for n, r in known.items() if r]
    recorded = spark.createDataFrame(rows, "name string, components array<string>")
    curated = spark.createDataFrame([], "name string, source_url string") if listed is None else listed.select(F.col("assembly_name").alias("name"), "source_url")
    row = resolve.sources(spark.createDataFrame([(assembly,)], "name string"), recorded, curated).first()
    if row.error:
        raise errors.ChimeraNamingError(f"{assembly}: {row.error}")
    return row.asDict()


def register(spark: SparkSession, assembly: str, root: str | None = None, listed: DataFrame | None = None, force: bool = False) -> dict:
    """Registers what a name means: a chimera from its components, else the FASTA that its row or its record names."""
    found = resolve_source(spark, assembly, root, listed)
    if found["kind"] == "components":
        return Genome.chimera(spark, found["components"], root, force).record
    place = Place(root or data_dir(spark), assembly)
    record = read_record(spark, place.path) or {}
    row = None if listed is None else listed.filter(F.col("assembly_name") == assembly).first()
    pinned = row["sha256"] if row is not None and "sha256" in listed.columns else None
    return register_assembly(spark, assembly, record.get("source_url") or found["url"], root, pinned, force)


class Genome:
    """A registered assembly. Loci are 0-based, half-open; case is kept; a minus strand is reverse-complemented."""

    def __init__(self, spark: SparkSession, assembly: str, root: str | None = None, default: str | None = None, offered: DataFrame | None = None, metadata: dict | None = None, listed: DataFrame | None = None) -> None:
        """``default`` names the default annotation; ``offered`` is the table of annotations (assembly, name, ord, url, sha256, default); ``metadata`` stands in, whole, for the assembly's row of the curated table ``listed``."""
        self.spark, self.place, self._explicit, self.offered = spark, Place(root or data_dir(spark), assembly), default, offered
        self.metadata, self.listed, self.closed, self._known = metadata, listed, False, None
        self.record = check_registration(spark, self.place.path, f"register {assembly} --force")
        if self.record is None:
            raise errors.RegistrationError(f"{assembly} isn't registered; register it with `register {assembly} --source FASTA`")
        _component_entries(self.record, assembly)

    def assembly_metadata(self) -> dict:
        """What is known of the assembly: the metadata given at opening, else its curated row, else its name alone."""
        if self.metadata is not None:
            return dict(self.metadata)
        name = self.place.assembly
        row = None if self.listed is None else self.listed.filter(F.col("assembly_name") == name).drop("ord", "error").first()
        return row.asDict() if row is not None else {"assembly_name": name}

    def close(self) -> None:
        """After this, sequences can't be asked for any more."""
        self.closed = True

    def __enter__(self) -> Genome:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __getitem__(self, locus: str | Region) -> str:
        return self.fetch_sequence(locus)

    # --- sequences ---
    @property
    def sizes(self) -> DataFrame:
        """(ord, chrom, size) in the assembly's order."""
        return self.spark.read.parquet(self.part(SIZES)).select("ord", "chrom", "size")

    def part(self, name: str) -> str:
        """Where a part of the assembly is: ``store``, ``sizes`` or ``fasta``."""
        return publication.part(self.record, self.place.path, name)

    def annotation_part(self, name: str, annotation: str | None = None) -> str:
        """Where a part of an annotation is, by default of the default one: ``lines`` (``merged`` if it is that) or ``features``."""
        annotation = annotation or self.default_annotation
        record = annotation and read_record(self.spark, self.place.annotation(annotation))
        if not record:
            raise errors.AnnotationNotRegisteredError(annotation)
        return publication.part(record, self.place.annotation(annotation), name)

    @property
    def chromosomes(self) -> list[str]:
        return [r.chrom for r in self.sizes.orderBy("ord").collect()]

    @property
    def store(self) -> DataFrame:
        if self.closed:
            raise errors.ClosedGenomeError(f"{self.place.assembly} is closed")
        return self.spark.read.parquet(self.part(SEQUENCES)).select("chrom", "size", "tile", "packed", "other", "masked", "bases")

    @property
    def fasta_lines(self) -> DataFrame:
        """(at, value): the lines of the assembly's FASTA to the byte, ordered by ``at``."""
        place = self.part(FASTA)
        return fasta.lines(self.spark, place) if self.components else self.spark.read.parquet(place)

    def fetch(self, regions: DataFrame, masked: bool = True, checked: bool = True) -> DataFrame:
        """Many regions (rid, chrom, start, end, strand) with their bases and errors."""
        return fetch.fetch(fetch.resolved(regions, self.sizes), self.store, masked=masked, checked=checked)

    def resolve(self, locus: str | Region, strand: str | None = None) -> Region:
        """A locus as a region of this assembly; what is wrong with it is raised, with the names that would do."""
        if isinstance(locus, Region):
            chrom, start, end, strand = locus.chrom, locus.start, locus.end, strand or locus.strand
        else:
            chrom, start, end = parse(locus)
        asked = self.spark.createDataFrame([(chrom, start, end)], "chrom string, start long, end long")
        row = fetch.resolved(asked, self.sizes.select("chrom", "size")).first()
        if row.size is None:
            raise errors.RegionError(self._unknown_chromosome(chrom))
        if row.error:
            raise errors.RegionError(f"region {locus!s}: {row.error}; {chrom} has {row.size} bases")
        return Region(chrom, row.start, row.end, strand or ".")

    def _unknown_chromosome(self, chrom: str) -> str:
        if self.separator:
            asked = self.spark.createDataFrame([(chrom,)], "name string")
            row = naming.bare_spellings(asked, self.sizes, F.lit(self.separator)).first()
            if row:
                return f"unknown chromosome {chrom!r}: {self.place.assembly} is a chimera, which has it as {', '.join(row.spellings)}"
        known = [r.chrom for r in self.sizes.orderBy("ord").limit(5).collect()]
        return f"unknown chromosome {chrom!r}: {self.place.assembly} has {', '.join(known)}, ..."

    def fetch_sequence(self, locus: str | Region, strand: str | None = None, masked: bool = True) -> DNA:
        """The bases of one locus; what is wrong with it is raised."""
        found = self.resolve(locus, strand)
        asked = self.spark.createDataFrame([(0, found.chrom, found.start, found.end, found.strand)], "rid long, chrom string, start long, end long, strand string")
        return DNA(self.fetch(asked, masked).first().bases)

    def shape(self) -> dict:
        return shape.genome_shape(self.sizes).first().asDict()

    def index_parameters(self, overhang: int = 100) -> dict:
        return shape.index_parameters(self.sizes, overhang=overhang).first().asDict()

    def fai(self) -> DataFrame:
        """The index of the assembly's FASTA as it was read."""
        rows = self.spark.read.parquet(self.part(SIZES)).filter("size > 0")
        return shape.fai(rows.withColumns({"component": F.lit(self.place.assembly), "header_bytes": F.col("header_bytes") + 1}))

    # --- chimeras ---
    @property
    def components(self) -> list[str] | None:
        found = self.record["details"].get("components")
        return [c["name"] for c in found] if found else None

    @property
    def separator(self) -> str | None:
        return self.record["details"].get("separator")

    def chrom_components(self) -> DataFrame:
        """(chrom, component), total: a plain assembly's chromosomes are its own."""
        sep = F.lit(self.separator).cast("string")
        return self.sizes.select("ord", "chrom", names.component_of(F.col("chrom"), sep, F.lit(self.place.assembly)).alias("component"))

    @classmethod
    def chimera(cls, spark: SparkSession, components: list[str | Genome], root: str | None = None, force: bool = False) -> Genome:
        """Builds, from registered assemblies, the reference of all their sequences, suffixed, components by name.

        Components' default annotations are merged into one, named by theirs joined with ``+``; a
        component without annotations contributes none, and one whose default is unclear is refused.
        """
        root = root or data_dir(spark)
        opened = {c.place.assembly: c for c in components if isinstance(c, Genome)}
        components = [c.place.assembly if isinstance(c, Genome) else c for c in components]
        why = spark.createDataFrame([(components,)], "c array<string>").select(names.components_error(F.col("c")), names.derive_name(F.col("c"))).first()
        if why[0]:
            raise errors.ChimeraNamingError(f"{', '.join(components)}: {why[0]}")
        place = Place(root, why[1])
        if not force and check_registration(spark, place.path, f"register {why[1]} --force"):
            return cls(spark, why[1], root)
        parts = [opened.get(c) or cls(spark, c, root) for c in sorted(components)]
        if nested := [p.place.assembly for p in parts if p.components]:
            raise errors.ChimeraNamingError(f"{', '.join(nested)}: chimeras don't nest")
        giving = {p.place.assembly: p.contribution() for p in parts}
        every = None
        for i, p in enumerate(parts):
            mine = p.sizes.select(F.lit(i).alias("part"), F.lit(p.place.assembly).alias("component"), "ord", "chrom", "size")
            every = mine if every is None else every.unionByName(mine)
        longest = every.agg(F.max(names.underscore_run(F.col("chrom")))).first()[0]
        sep = "_" * max(2, longest + 1)
        chrom, component = names.split_suffixed(names.suffixed(F.col("chrom"), F.col("component"), F.lit(sep)), F.lit(sep))
        if bad := every.filter(~(chrom.eqNullSafe(F.col("chrom")) & component.eqNullSafe(F.col("component")))).select("chrom").limit(5).collect():
            raise errors.ChimeraNamingError(f"names don't come apart again: {', '.join(r.chrom for r in bad)}")
        build = Build(spark, place.path)
        store, sizes, before = None, None, 0
        for p in parts:
            suffix = F.concat("chrom", F.lit(f"{sep}{p.place.assembly}"))
            mine = p.store.withColumn("chrom", suffix)
            own = spark.read.parquet(p.part(SIZES))
            extended = F.col("header_bytes") + len(sep) + len(p.place.assembly)
            rows = own.withColumns({"ord": F.col("ord") + before, "chrom": suffix, "header_bytes": extended.cast("int"), "header": F.concat(F.regexp_extract("header", r"\A(\s*\S+)", 1), F.lit(f"{sep}{p.place.assembly}"), F.regexp_extract("header", r"\A\s*\S+((?s).*)\z", 1))})
            before += own.count()
            store, sizes = (mine, rows) if store is None else (store.unionByName(mine), sizes.unionByName(rows))
        ordered = store.repartitionByRange("chrom", "tile").sortWithinPartitions("chrom", "tile")
        ordered.write.option("parquet.block.size", fetch.ROW_GROUP).parquet(build.part(SEQUENCES))
        sizes.write.parquet(build.part(SIZES))
        fasta.write_concatenated([(p.place.assembly, p.fasta_lines) for p in parts], build.part(FASTA), sep)
        given = lambda c: {"annotation": giving[c][0], "annotation_sha256": giving[c][1]} if giving[c] else {}
        details = {"separator": sep, "components": [{"name": p.place.assembly, "sha256": p.record["sha256"], **given(p.place.assembly)} for p in parts]}
        build.publish("genome", place.assembly, sha256=catalog.content_sha256(spark, build.part(FASTA)), details=details)
        for old in publication.children(spark, f"{place.path}/gtf"):  # merged by an earlier build
            if ((read_record(spark, place.annotation(old)) or {}).get("details") or {}).get("merged_from"):
                publication.remove(spark, place.annotation(old))
        built = cls(spark, place.assembly, root)
        if sources := [(p, giving[p.place.assembly][0]) for p in parts if giving[p.place.assembly]]:
            built._register_merged(sources, sep)
        return built

    def contribution(self) -> tuple[str, str | None] | None:
        """What a chimera takes from this assembly: its default annotation and that one's digest, or nothing."""
        name = self.default_annotation
        here = sorted(r.name for r in self.annotation_status().filter("registered").collect())
        if name is None:
            if here:
                raise errors.AmbiguousDefaultAnnotationError(f"{self.place.assembly} has {', '.join(here)} and no default; open it with one of them as default")
            return None
        if name not in here:
            raise errors.AnnotationNotRegisteredError(name)
        return name, read_record(self.spark, self.place.annotation(name))["sha256"]

    def _register_merged(self, sources: list[tuple[Genome, str]], sep: str) -> dict:
        """The components' lines as one GTF, its names held to the chimera's, its features, and a record of who contributed."""
        name = "+".join(n for _, n in sources)
        build = Build(self.spark, self.place.annotation(name))
        lines = [(p.place.assembly, self.spark.read.parquet(p.annotation_part(LINES, n))) for p, n in sources]
        gtf.write_merged(lines, build.part(MERGED), sep)
        found = gtf.read(self.spark, build.part(MERGED))
        self._check_names(found)
        annotation_ops.unique_ids(found).drop("line_ord", "file").write.parquet(build.part(FEATURES))
        merged_from = [{"assembly": p.place.assembly, "annotation": n} for p, n in sources]
        return build.publish("annotation", name, None, catalog.content_sha256(self.spark, build.part(MERGED)), {"chromosomes_checked": True, "merged_from": merged_from})

    @property
    def component_annotations(self) -> dict[str, str | None] | None:
        """The annotation that each component contributed; none for a plain assembly."""
        found = self.record["details"].get("components")
        return {c["name"]: c.get("annotation") for c in found} if found else None

    @property
    def merged_annotation(self) -> str | None:
        """The name of the annotation that this build merged, if any."""
        return "+".join(a for a in (self.component_annotations or {}).values() if a) or None

    def component_status(self) -> str | None:
        """Whether the components are still what the chimera was built from: unchanged or unknown; a change raises."""
        entries = self.record["details"].get("components")
        if not entries:
            return None
        pinned = lambda path: (read_record(self.spark, path) or {}).get("sha256")
        pairs = [(e["name"], e["sha256"], pinned(Place(self.place.root, e["name"]).path)) for e in entries]
        pairs += [(f"{e['name']}'s {e['annotation']}", e["annotation_sha256"], pinned(Place(self.place.root, e["name"]).annotation(e["annotation"]))) for e in entries if e.get("annotation")]
        if changed := [what for what, then, now in pairs if then and now and then != now]:
            raise errors.RegistrationMismatchError(f"{', '.join(changed)} changed since {self.place.assembly} was built")
        return "unchanged" if all(then and now for _, then, now in pairs) else "unknown"

    # --- annotations ---
    def _check_names(self, found: DataFrame) -> None:
        if missing := annotation_ops.missing_chromosomes(found, self.sizes).orderBy("seqname").collect():
            raise errors.ChromosomeMismatchError([r.seqname for r in missing])

    def register_gtf(self, name: str, path: str, check_chromosomes: bool = True, infer: bool | tuple[str, ...] = False, force: bool = False, sha256: str | None = None) -> dict:
        """Registers a GTF: digest and names checked first, then lines and features written, then the record.

        ``infer`` adds the extents of exons: of ``transcript``, ``gene``, or, if true, both.
        """
        place = self.place.annotation(name)
        if not force and (done := check_registration(self.spark, place, f"register-gtf {self.place.assembly} {path} {name} --force")):
            return done
        old = read_record(self.spark, place)
        proven = bool(force and sha256 and old and old["sha256"] == sha256)
        kept = publication.intact(self.spark, place, old) if proven else {}
        build = Build(self.spark, place, {p: kept[p] for p in (LINES,) if p in kept})  # features depend on how they are asked for
        digest = sha256
        if LINES in build:
            lines = self.spark.read.parquet(build.part(LINES))
        else:
            digest = catalog.content_sha256(self.spark, path)
            if sha256 and digest != sha256:
                raise errors.ChecksumMismatchError(f"{path}: expected {sha256}, got {digest}")
            lines = gtf.lines(self.spark, path)
        found = gtf.features(lines)
        if check_chromosomes:
            self._check_names(found)
        rows = annotation_ops.unique_ids(found).drop("line_ord", "file")
        wanted = ("transcript", "gene") if infer is True else infer or ()
        exons = rows.filter("feature = 'exon'").withColumns({i: F.element_at(F.col("attributes")[i], 1) for i in ("transcript_id", "gene_id")})
        for feature in wanted:
            id_col = f"{feature}_id"
            extent = annotation_ops.inferred(exons, feature, id_col).withColumns({"attributes": F.create_map(F.lit(id_col), F.array(id_col)), "id": F.col(id_col)})
            rows = rows.unionByName(extent.drop(id_col), allowMissingColumns=True)
        if LINES not in build:
            lines.select("line_ord", "value").write.parquet(build.part(LINES))
        rows.write.parquet(build.part(FEATURES))
        checked = {"chromosomes_checked": True} if check_chromosomes else {"chromosomes_unchecked_because": "caller-override"}
        return build.publish("annotation", name, path, digest, checked)

    def register_annotation(self, name: str, check_chromosomes: bool = True, infer: bool | tuple[str, ...] = False, force: bool = False) -> dict:
        """Registers an offered annotation from its ``url``, a path that Spark reads, held to its ``sha256``."""
        row = None if self.offered is None else self.offered.filter((F.col("assembly") == self.place.assembly) & (F.col("name") == name)).orderBy("ord").first()
        if row is None:
            raise LookupError(f"{name} isn't offered for {self.place.assembly}")
        return self.register_gtf(name, row.url, check_chromosomes, infer, force, row.sha256)

    def features(self, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.annotation_part(FEATURES, name))

    def registry(self) -> dict[str, str]:
        """The state of each annotation's folder: finished, unfinished, mismatch or fresh.

        All records and all files are read by one query, whatever their number, and remembered until a folder is changed.
        """
        place = f"{self.place.path}/gtf"
        stamps = publication.children(self.spark, place)
        if self._known is None or self._known[0] != stamps:
            self._known = (stamps, self._gated(place, list(stamps)))
        return self._known[1]

    def _gated(self, place: str, names_: list[str]) -> dict[str, str]:
        if not names_:
            return {}
        folders = self.spark.createDataFrame([(n,) for n in names_], "name string")
        below = F.substring_index("path", f"{self.place.path.rpartition(':')[2]}/gtf/", -1)
        name = F.substring_index(below, "/", 1)
        found = catalog.files_below(self.spark, place).select(name.alias("name"), F.substring(below, F.length(name) + 2, F.length(below)).alias("file"), F.col("length").alias("actual"))
        recorded = catalog.records(self.spark, f"{place}/*/{catalog.RECORD_NAME}") if any(publication.exists(self.spark, f"{place}/{n}/{catalog.RECORD_NAME}") for n in names_) else None
        none = self.spark.createDataFrame([], "name string, file string, expected long")
        claimed = none if recorded is None else recorded.select("name", F.explode_outer("files").alias("file", "expected"))
        return {r.name: r.state for r in record_ops.gate(folders, claimed, found, "name", "file").collect()}

    def annotation_status(self, offered: DataFrame | None = None) -> DataFrame:
        """(assembly, name, ord, offered, registered, broken, state) of what is offered and what is here."""
        here = self.spark.createDataFrame([(self.place.assembly, n, state != "finished") for n, state in self.registry().items()], "assembly string, name string, wrong boolean")
        offered = self.offered if offered is None else offered
        offered = self.spark.createDataFrame([], "assembly string, name string, ord int") if offered is None else offered.filter(F.col("assembly") == self.place.assembly).select("assembly", "name", "ord")
        return annotation_ops.status(offered, here.filter("NOT wrong"), here.filter("wrong"))

    def annotation_report(self) -> list[dict]:
        """The rows of :meth:`annotation_status` with what the table says of each, where it is, what is wrong with it and the command that repairs it.

        The records of all annotations here are read by one query.
        """
        place, default, states = f"{self.place.path}/gtf", self.default_annotation, self.registry()
        rows = self.annotation_status()
        if self.offered is not None:
            known = [c for c in ("provider", "version", "url", "sha256") if c in self.offered.columns]
            mine = self.offered.filter(F.col("assembly") == self.place.assembly).groupBy("name").agg(*[F.min_by(c, "ord").alias(c) for c in known])
            rows = rows.join(mine, "name", "left")
        held = {}
        if any(state in ("finished", "mismatch") for state in states.values()):
            found = catalog.records(self.spark, f"{place}/*/{catalog.RECORD_NAME}").select("name", "source_url", F.get_json_object("details", "$.merged_from").isNotNull().alias("merged"))
            held = {r.name: r for r in found.collect()}
        text = lambda c: F.col(c).cast("string")
        kept = self.spark.createDataFrame([(n, r.source_url, r.merged) for n, r in held.items()], "name string, _source string, _merged boolean")
        repair = cells.repair_command(text("assembly"), text("name"), F.coalesce("_merged", F.lit(False)), F.col("offered"), text("_source"))
        wrong = {"unfinished": "holds files but no record", "mismatch": "disagrees with its record", "fresh": "is empty"}
        out = rows.join(F.broadcast(kept), "name", "left").withColumn("repair", F.when(F.col("broken"), repair)).drop("_source", "_merged")
        return [
            r.asDict() | {"default": r.name == default, "path": f"{place}/{r.name}" if r.registered else None, "problem": f"{place}/{r.name} {wrong[states[r.name]]}" if r.broken else None}
            for r in out.orderBy(F.col("ord").isNull(), "ord", "name").collect()
        ]

    @property
    def default_annotation(self) -> str | None:
        """The one said at opening, else the first that the table flags, else the sole registered one."""
        if self._explicit:
            return self._explicit
        if self.offered is not None:
            flagged = self.offered.filter((F.col("assembly") == self.place.assembly) & F.col("default")).agg(F.min_by("name", "ord")).first()[0]
            if flagged:
                return flagged
        here = [r.name for r in self.annotation_status().filter("registered").collect()]
        return here[0] if len(here) == 1 else None

    def default_row(self) -> dict | None:
        """The status row of the default annotation, with the command that would ``repair`` it; None without a default or a row."""
        name = self.default_annotation
        rows = self.annotation_status().filter(F.col("name") == name) if name else None
        if rows is None:
            return None
        record = read_record(self.spark, self.place.annotation(name)) or {"details": {}, "source_url": None}
        merged, source = F.lit(bool(record["details"].get("merged_from"))), F.lit(record["source_url"]).cast("string")
        row = rows.withColumn("repair", cells.repair_command(F.col("assembly"), F.col("name"), merged, F.col("offered"), source)).first()
        return row.asDict() if row else None

    def default_summary(self) -> str:
        """One line about the default annotation and what would mend it."""
        name, row = self.default_annotation, self.default_row() or {}
        text = lambda v: F.lit(v).cast("string")
        sentence = cells.default_sentence(F.lit(self.place.assembly), text(name), F.lit(bool(row.get("broken"))), F.lit(bool(row.get("registered"))), text(row.get("repair")))
        return self.spark.range(1).select(sentence).first()[0]

    def contributors(self, annotation: str | None = None) -> DataFrame:
        """(name, part_ord, annotation, part): what an annotation was merged from as its record says, else itself."""
        name = annotation or self.default_annotation
        record = (name and read_record(self.spark, self.place.annotation(name))) or {"details": {}}
        parts = record["details"].get("merged_from") or [{"assembly": self.place.assembly, "annotation": name}]
        rows = [(name, i, p["annotation"], p["assembly"]) for i, p in enumerate(parts)]
        return self.spark.createDataFrame(rows, "name string, part_ord long, annotation string, part string")

    def _listed(self, lists: DataFrame, annotation: str | None) -> DataFrame:
        """The contributors' curated genes; none at all, or another assembly's, is an error."""
        parts = genes.contributing(self.contributors(annotation), lists)
        found = parts.select("annotation", "assembly", "part").distinct().collect()
        if not found:
            raise errors.NoGeneCategoriesError(f"no gene list ships for {annotation or self.default_annotation}")
        if wrong := sorted({r.annotation for r in found if r.assembly != r.part}):
            raise errors.GeneListAssemblyMismatchError(f"{', '.join(wrong)}: the list is another assembly's")
        return parts

    def gene_list(self, category: str, lists: DataFrame, annotation: str | None = None) -> list[str]:
        """The curated ids of a category, contributors in order; ``lists`` as :func:`locusflow.sources.catalog.gene_lists` reads them."""
        parts = self._listed(lists, annotation)
        mine = genes.gene_list(parts.filter((F.col("category") == category)), ["name"]).first()
        if mine is None:
            declared = sorted(r.category for r in parts.select("category").distinct().collect())
            raise errors.GeneCategoryNotDeclaredError(f"{annotation or self.default_annotation} declares {', '.join(declared)}, not {category}")
        return [g for g in mine.gene_ids if g is not None]

    def gene_lists(self, lists: DataFrame, annotation: str | None = None) -> dict[str, list[str]]:
        """Every category that a contributor declares, in the order first declared, with its ids."""
        parts = self._listed(lists, annotation)
        ids = {r.category: [g for g in r.gene_ids if g is not None] for r in genes.gene_list(parts, ["category"]).collect()}
        return {r.category: ids[r.category] for r in genes.declared(parts, ["name"]).orderBy("part_ord", "cat_ord").collect()}


def reverse_complement(spark: SparkSession, bases: str) -> str:
    """One string; a character outside the DNA alphabet is an error."""
    row = spark.createDataFrame([(bases,)], "s string").select(sequence.reverse_complement(F.col("s")), sequence.outside_alphabet(F.col("s"), "dna")).first()
    if row[1]:
        raise ValueError(f"not DNA: {' '.join(row[1])}")
    return row[0]


def _component_entries(record: dict, assembly: str) -> list[dict] | None:
    """The components of a record's details, None for a plain assembly; details that have but a half of a chimera's are refused."""
    details = record["details"]
    entries, sep = details.get("components"), details.get("separator")
    if entries is None and sep is None:
        return None
    if not entries or not sep or not all(isinstance(e, dict) and e.get("name") for e in entries):
        raise errors.RegistrationError(f"the record of {assembly} says half of what a chimera's does; register it again with `register {assembly} --force`")
    return entries


def verify_assembly(spark: SparkSession, assembly: str, fasta_path: str | None = None, expected: str | None = None, root: str | None = None) -> dict:
    """A FASTA's digest, by default that of the lines kept here, against the one expected, or the record's; ``verified`` only if there is one.

    A chimera is also held to its components: ``components`` is unchanged or unknown, and a change raises.
    """
    place = Place(root or data_dir(spark), assembly)
    record = read_record(spark, place.path) or {}
    want = expected or record.get("sha256")
    if fasta_path is None and not record:
        raise errors.RegistrationError(f"{assembly} isn't registered")
    held = fasta_path or (publication.part(record, place.path, FASTA) if record["details"].get("components") else record["source_url"])
    got = catalog.content_sha256(spark, held)
    if want and got != want:
        raise errors.ChecksumMismatchError(f"{held}: expected {want}, got {got}")
    components = Genome(spark, assembly, root).component_status() if record and record["details"].get("components") else None
    return {"assembly": assembly, "fasta": held, "sha256": got, "expected": want, "expected_from": "table" if expected else "record" if want else None, "verified": want is not None, "components": components}


def table_row(spark: SparkSession, assembly: str, table: DataFrame, source: str | None = None, root: str | None = None) -> dict:
    """The curated row of an assembly with its source and the digest computed from it, blank where the table has no row; chimeras have none."""
    found = resolve_source(spark, assembly, root, table)
    if found["kind"] == "components":
        raise ValueError(f"{assembly} is a chimera of {', '.join(found['components'])}: its bytes come from them, so there is no row to compute")
    columns = [c for c in table.columns if c not in ("ord", "error")]
    row = table.filter(F.col("assembly_name") == assembly).first()
    if row is not None and "error" in table.columns and row["error"]:
        raise errors.MetadataRowError(f"{assembly}: {row['error']}")
    known = {c: row[c] if row is not None else None for c in columns}
    url = source or found["url"]
    return known | {"assembly_name": assembly, "source_url": url, "sha256": catalog.content_sha256(spark, url)}
