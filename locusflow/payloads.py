"""What commands print as JSON: each answer's keys, in the order they are printed in (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .genome import Genome, verify_assembly
from .operators import genes

RECORD = ("kind", "name", "files", "source_url", "sha256", "tool_versions", "package_version", "completed_at", "details")
STATUS_ROW = ("name", "offered", "registered", "broken", "default", "provider", "version", "url", "sha256", "path", "problem", "repair")


def registered(record: dict, assembly: str, directory: str) -> dict:
    """A registration of an assembly or an annotation: the record's fields, then what it doesn't hold of itself."""
    return {k: record[k] for k in RECORD} | {"assembly": assembly, "directory": directory}


def verified(spark, assembly: str, fasta: str | None = None, expected: str | None = None, root: str | None = None) -> dict:
    found = verify_assembly(spark, assembly, fasta, expected, root)
    return {k: found[k] for k in ("assembly", "fasta", "sha256", "expected", "expected_from", "verified", "components")}


def gene_list(genome: Genome, category: str, lists: DataFrame, annotation: str | None = None) -> dict:
    """A category's genes, in all and by the list that each source has of them; a plain assembly's source has no component."""
    return {"assembly": genome.place.assembly, **_gene_lists(genome, lists, annotation, category)[0]}


def gene_lists(genome: Genome, lists: DataFrame, annotation: str | None = None) -> dict:
    name = annotation or genome.default_annotation
    return {"assembly": genome.place.assembly, "annotation": name, "categories": [{k: v for k, v in x.items() if k != "annotation"} for x in _gene_lists(genome, lists, annotation, None)]}


def _gene_lists(genome: Genome, lists: DataFrame, annotation: str | None, category: str | None) -> list[dict]:
    name = annotation or genome.default_annotation
    ids = genome.gene_lists(lists, annotation) if category is None else {category: genome.gene_list(category, lists, annotation)}
    parts = genes.contributing(genome.contributors(annotation), lists)
    held = F.transform(F.array_sort(F.collect_list(F.struct("gene_ord", "gene_id"))), lambda x: x["gene_id"])
    rows = parts.groupBy("category", "part_ord", "part", "annotation", "description", "source").agg(held.alias("gene_ids")).orderBy("part_ord").collect()
    component = lambda r: r.part if genome.components else None
    of = lambda c: [{"component": component(r), "annotation": r.annotation, "description": r.description, "source": r.source, "gene_ids": [g for g in r.gene_ids if g is not None]} for r in rows if r.category == c]
    return [{"annotation": name, "category": c, "gene_ids": found, "sources": of(c)} for c, found in ids.items()]


def annotations(genome: Genome) -> dict:
    """All annotations offered or here, in the order of the table, then by name; what is wrong with a broken one, and what would mend it."""
    rows = [{k: row.get(k) for k in STATUS_ROW} for row in genome.annotation_report()]
    return {"assembly": genome.place.assembly, "directory": f"{genome.place.path}/gtf", "default_annotation": genome.default_annotation, "annotations": rows}
