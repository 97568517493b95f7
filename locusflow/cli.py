"""Commands: ``python -m locusflow.cli COMMAND``. Exit 2 for invalid input, 1 for everything else that fails."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, genome, payloads
from .functions import cells
from .sources import catalog


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="locusflow")
    parser.add_argument("--data", help="data folder")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options: dict) -> None:
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        for o, how in options.items():
            sub.add_argument(f"--{o.replace('_', '-')}", **how)
        sub.add_argument("--json", action="store_true")

    yes = {"action": "store_true"}
    add("version")
    add("revcomp", "sequence")
    add("register", "assembly", source={}, table={}, sha256={}, force=yes)
    add("register-gtf", "assembly", "gtf", "name", force=yes, no_check_chromosomes=yes, infer_genes=yes, infer_transcripts=yes)
    add("register-annotation", "assembly", "name", table={"required": True}, force=yes, no_check_chromosomes=yes, infer_genes=yes, infer_transcripts=yes)
    add("annotations", "assembly", table={})
    add("gene-list", "assembly", "category", lists={"required": True}, annotation={})
    add("gene-categories", "assembly", lists={"required": True}, annotation={})
    add("verify", "assembly", "fasta?", sha256={})
    add("table-row", "assembly", table={"required": True}, source={})
    return parser


def _assemblies(spark: SparkSession, path: str) -> DataFrame:
    return catalog.table(spark, path, ints=("ncbi_taxid", "intron_length_cap"), required=("assembly_name",))


def _aligned(rows: list[tuple[str, ...]]) -> list[str]:
    """Rows as lines whose columns are as wide as their longest cell."""
    wide = [max(map(len, column)) for column in zip(*rows, strict=True)] if rows else []
    return ["  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in rows]


def run(spark: SparkSession, argv: list[str]) -> int:
    args = _parser().parse_args(argv)

    def say(payload: dict, text: str) -> int:
        print(json.dumps(payload, default=str) if args.json else text)
        return 0

    if args.command == "version":
        return say({"version": __version__}, __version__)
    if args.command == "revcomp":
        try:
            out = genome.reverse_complement(spark, args.sequence)
        except ValueError as wrong:
            print(wrong, file=sys.stderr)
            return 2
        return say({"sequence": out}, out)
    try:
        if args.command == "register":
            if args.source:
                record = genome.register_assembly(spark, args.assembly, args.source, args.data, args.sha256, args.force)
            else:
                record = genome.register(spark, args.assembly, args.data, _assemblies(spark, args.table) if args.table else None, args.force)
            where = genome.Place(args.data or genome.data_dir(spark), args.assembly)
            return say(payloads.registered(record, args.assembly, where.path), f"registered {args.assembly}")
        if args.command in ("register-gtf", "register-annotation"):
            how = (not args.no_check_chromosomes, ("transcript",) * args.infer_transcripts + ("gene",) * args.infer_genes, args.force)
            if args.command == "register-gtf":
                record = genome.Genome(spark, args.assembly, args.data).register_gtf(args.name, args.gtf, *how)
            else:
                record = genome.Genome(spark, args.assembly, args.data, offered=catalog.table(spark, args.table, flags=("default",))).register_annotation(args.name, *how)
            where = genome.Place(args.data or genome.data_dir(spark), args.assembly)
            return say(payloads.registered(record, args.assembly, where.annotation(args.name)), f"registered {args.name} of {args.assembly}")
        if args.command == "annotations":
            offered = catalog.table(spark, args.table, flags=("default",)) if args.table else None
            opened = genome.Genome(spark, args.assembly, args.data, offered=offered)
            found = payloads.annotations(opened)
            states = {r.name: r.state for r in opened.annotation_status().collect()}
            lines = _aligned([(r["name"], states[r["name"]], *([r["problem"], f"`{r['repair']}`"] if r["broken"] else ["", ""])) for r in found["annotations"]])
            return say(found, "\n".join([*lines, opened.default_summary()]))
        if args.command == "gene-list":
            found = payloads.gene_list(genome.Genome(spark, args.assembly, args.data), args.category, catalog.checked_gene_lists(spark, args.lists), args.annotation)
            print(f"{len(found['gene_ids'])} genes of {args.category}", file=sys.stderr)
            return say(found, "\n".join(found["gene_ids"]))
        if args.command == "gene-categories":
            found = payloads.gene_lists(genome.Genome(spark, args.assembly, args.data), catalog.checked_gene_lists(spark, args.lists), args.annotation)
            lines = [f"categories of {found['annotation']} of {args.assembly}", *_aligned([(c["category"], str(len(c["gene_ids"]))) for c in found["categories"]])]
            return say(found, "\n".join(lines))
        if args.command == "verify":
            out = payloads.verified(spark, args.assembly, args.fasta, args.sha256, args.data)
            text = f"{args.assembly}: {'verified' if out['verified'] else 'nothing to verify against'} {out['sha256']}"
            return say(out, text + (f"\ncomponents: {out['components']}" if out["components"] else ""))
        row = genome.table_row(spark, args.assembly, _assemblies(spark, args.table), args.source, args.data)
        cell = [F.lit(v).cast("string") for v in row.values()]
        return say(row, spark.range(1).select(cells.table_row(*cell)).first()[0])
    except Exception as wrong:  # noqa: BLE001
        print(wrong, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("locusflow").getOrCreate(), sys.argv[1:]))
