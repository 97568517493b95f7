"""Indexes that aligners build from an assembly: their parameters, records and whether they are still current.

Running the aligners is left to the caller, between :func:`begin_index` and :func:`record_index`. An
index counts as built once its record is written; a rebuild withdraws the old record before it
touches anything, so that one which dies vouches for nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from . import errors, publication
from .genome import Genome
from .publication import check_registration, read_record, write_record
from .sources import catalog


@dataclass(frozen=True)
class Aligner:
    """A kind of index: the program's name, how it spells long options, and the sizing it takes from the assembly."""

    name: str
    binary: str
    separator: str
    parameters: Callable[[Genome], dict]

    def flags(self, options: Mapping[str, object]) -> list[str]:
        """Options as arguments; a list or tuple gives several values after one flag."""
        out: list[str] = []
        for key, value in options.items():
            out.append(f"--{key.replace('_', self.separator)}")
            out += map(str, value if isinstance(value, (list, tuple)) else [value])
        return out


#: The aligners known here; others can be added.
ALIGNERS = {
    "star": Aligner("star", "STAR", "_", lambda genome: genome.index_parameters()),
    "chromap": Aligner("chromap", "chromap", "-", lambda genome: {}),
}


def aligner(name: str) -> Aligner:
    """The aligner of a name, in letters of either case."""
    found = {n.lower(): a for n, a in ALIGNERS.items()}.get(name.lower())
    if found is None:
        raise LookupError(f"no aligner is called {name}; there are {', '.join(sorted(ALIGNERS))}")
    return found


def index_place(genome: Genome, name: str, annotation: str | None = None) -> str:
    """The folder of an index, one for each annotation that it was built with."""
    return f"{genome.place.path}/index/{aligner(name).name}{'-' + annotation if annotation else ''}"


def _plan(genome: Genome, name: str, options: Mapping[str, object] | None) -> dict:
    kind = aligner(name)
    parameters = kind.parameters(genome) | dict(options or {})
    digest = genome.record["sha256"]
    details = {"aligner": kind.name, "binary": kind.binary, "assembly": genome.place.assembly, "parameters": parameters, "command": [kind.binary, *kind.flags(parameters)]}
    return details | ({"assembly_sha256": digest} if digest else {})


def begin_index(genome: Genome, name: str, options: Mapping[str, object] | None = None, annotation: str | None = None, force: bool = False) -> list[str] | None:
    """Clears the folder of an index for a build and gives its command; None if it is there and current, or unknown, unless ``force``.

    The old record goes first, then the old files, and what is being built is noted, so that at any time
    a build that died reads as unfinished. An index of another assembly than is registered now is built anew.
    """
    place = index_place(genome, name, annotation)
    state = index_state(genome, name, annotation)
    if not force and state in ("current", "unknown"):
        check_registration(genome.spark, place, f"begin_index for {name}, by force")
        return None
    publication.remove(genome.spark, f"{place}/{catalog.RECORD_NAME}")
    publication.remove(genome.spark, place)
    details = _plan(genome, name, options)
    publication.make_folder(genome.spark, place)
    publication.replace_text(genome.spark, f"{place}/{publication.BUILDING}", json.dumps(details))
    return details["command"]


def record_index(genome: Genome, name: str, options: Mapping[str, object] | None = None, annotation: str | None = None, tools: Mapping[str, str] | None = None) -> dict:
    """Writes the record of the files now in an index's folder, with the assembly's digest, the last step of a build.

    A build that was begun is recorded as it was begun: an assembly that changed meanwhile makes it stale
    at once. ``tools`` are the versions of what built it.
    """
    place = index_place(genome, name, annotation)
    begun = f"{place}/{publication.BUILDING}"
    details = json.loads(publication.read_text(genome.spark, begun)) if publication.exists(genome.spark, begun) else _plan(genome, name, options)
    if not [f for f in publication.files(genome.spark, place) if f not in (publication.BUILDING, catalog.RECORD_NAME)]:
        raise errors.IndexNotBuiltError(f"{place} holds no index to record")
    record = write_record(genome.spark, place, "index", place.rpartition("/")[2], details=details, tools=dict(tools or {}))
    publication.remove(genome.spark, begun)
    return record


def index_path(genome: Genome, name: str, annotation: str | None = None) -> str:
    """Where a finished index is; raises if there is none, if its files disagree, or if the assembly changed since."""
    place = index_place(genome, name, annotation)
    record = check_registration(genome.spark, place, f"record_index for {name}")
    if record is None:
        raise errors.IndexNotBuiltError(f"{genome.place.assembly} has no {name} index in {place}")
    if index_state(genome, name, annotation) == "stale":
        raise errors.RegistrationMismatchError(f"the {name} index in {place} was built from another {genome.place.assembly} than is registered now; build it again")
    return place


def index_state(genome: Genome, name: str, annotation: str | None = None) -> str:
    """current, stale, unknown (a digest isn't on record), unfinished (files or a build begun, no record) or not built."""
    place = index_place(genome, name, annotation)
    record = read_record(genome.spark, place)
    if record is None:
        return "unfinished" if publication.children(genome.spark, place) else "not built"
    then, now = record["details"].get("assembly_sha256"), (read_record(genome.spark, genome.place.path) or {}).get("sha256")
    return "unknown" if not then or not now else "current" if then == now else "stale"


def build_star_index(genome: Genome, annotation: str | None = None, overhang: int = 100, force: bool = False, **options: object) -> list[str] | None:
    """The command of a STAR index of the assembly, with junctions of an annotation if one is named; see :func:`begin_index`."""
    own = {"runMode": "genomeGenerate", "genomeFastaFiles": genome.part("fasta")} | genome.index_parameters(overhang)
    if annotation:
        own |= {"sjdbGTFfile": genome.annotation_part("lines", annotation), "sjdbOverhang": overhang}
    return begin_index(genome, "star", own | options, annotation, force)


def build_chromap_index(genome: Genome, force: bool = False, **options: object) -> list[str] | None:
    """The command of a chromap index of the assembly; see :func:`begin_index`."""
    return begin_index(genome, "chromap", {"build_index": True, "ref": genome.part("fasta")} | options, None, force)


def get_star_index(genome: Genome, annotation: str | None = None) -> str:
    return index_path(genome, "star", annotation)


def get_chromap_index(genome: Genome) -> str:
    return index_path(genome, "chromap")
