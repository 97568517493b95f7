"""Table cells, states and sentences as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(cell: Column) -> Column:
    return F.regexp_replace(cell, r"^\s+|\s+\z", "")


def text_cell(cell: Column) -> Column:
    """A cell's text; null if blank."""
    return F.nullif(stripped(F.coalesce(cell, F.lit(""))), F.lit(""))


def int_cell(cell: Column) -> Column:
    return text_cell(cell).try_cast("bigint")


def int_error(cell: Column, column: str) -> Column:
    return F.when(text_cell(cell).isNotNull() & int_cell(cell).isNull(), F.lit(f"{column} is not an integer"))


def required_error(cell: Column, column: str) -> Column:
    return F.when(text_cell(cell).isNull(), F.lit(f"{column} is blank"))


# The spellings of a flag.
YES, NO = ("yes", "true", "1"), ("no", "false", "0")


def flag(cell: Column) -> Column:
    """True or false as spelled, false if blank, null if it is neither."""
    word = F.lower(stripped(F.coalesce(cell, F.lit(""))))
    return F.when(word.isin(*YES), True).when(word.isin(*NO) | (word == ""), False)


def table_row(*cells: Column) -> Column:
    """Cells as a line of tab-separated text, blank for null."""
    return F.array_join(F.transform(F.array(*[c.cast("string") for c in cells]), lambda c: F.coalesce(c, F.lit(""))), "\t")


def elided(names: Column, limit: int = 10) -> Column:
    """The first ``limit`` names and how many more there are."""
    rest = F.size(names) - limit
    shown = F.array_join(F.slice(names, 1, limit), ", ")
    return F.when(rest > 0, F.concat(shown, F.lit(", and "), rest.cast("string"), F.lit(" more"))).otherwise(shown)


def disagree(a: Column, b: Column) -> Column:
    """Whether two digests are both known and differ."""
    return F.coalesce(a != b, F.lit(False))


def both_known(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def annotation_state(broken: Column, offered: Column, registered: Column) -> Column:
    return F.when(broken, "broken").when(~offered, "registered, not offered").when(registered, "registered").otherwise("offered, not registered")


def register_command(assembly: Column, name: Column) -> Column:
    return F.concat(F.lit("register-annotation "), assembly, F.lit(" "), name)


def repair_command(assembly: Column, name: Column, merged: Column, offered: Column, source: Column) -> Column:
    """What registers a broken annotation again: its chimera if it was merged, its name if it is offered, else its file, if that is known."""
    by_path = F.concat(F.lit("register-gtf "), assembly, F.lit(" "), F.coalesce(source, F.lit("<path>")), F.lit(" "), name)
    return F.concat(F.when(merged, F.concat(F.lit("register "), assembly)).when(offered, register_command(assembly, name)).otherwise(by_path), F.lit(" --force"))


def disagreement_sentence(file: Column, expected: Column, actual: Column) -> Column:
    """How a file differs from what its record claims."""
    found = F.coalesce(F.concat(F.lit("found "), actual.cast("string")), F.lit("missing"))
    return F.concat(file, F.lit(": recorded "), expected.cast("string"), F.lit(" bytes, "), found)


def default_sentence(assembly: Column, default: Column, broken: Column, registered: Column, repair: Column) -> Column:
    """The default annotation, and, where it can't be used as it is, the command to run: its own row's ``repair``, or its registration."""
    command = F.when(broken, repair).when(~registered, register_command(assembly, default))
    state = F.when(broken, "broken").when(~registered, "absent")
    named = F.concat_ws(", ", default, F.concat(state, F.lit(": run "), command))
    return F.concat(F.lit("default annotation: "), F.when(default.isNull(), "none").otherwise(named))


# The reasons that a record gives for a check that wasn't made.
NO_SIZES, OVERRIDE = "no-chrom-sizes", "caller-override"


def check_sentence(checked: Column, because: Column) -> Column:
    """What a record says of its chromosome check; a reason not known reads as unknown."""
    return (
        F.when(F.coalesce(checked, F.lit(False)), "chromosomes checked")
        .when(because == NO_SIZES, "chromosomes not checked: the assembly has no sizes")
        .when(because == OVERRIDE, "chromosomes not checked: the caller stood the check down")
        .otherwise("chromosomes not checked: the record does not say why")
    )


def is_url(source: Column) -> Column:
    return source.rlike(r"(?i)\A(https?|s?ftp)://")


def without_fasta_suffix(name: Column) -> Column:
    """A file name less its FASTA suffix, else less its last suffix."""
    known = r"\.(fa|fasta|fna)(\.gz)?\z"
    return F.when(name.rlike(known), F.regexp_replace(name, known, "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""))


# The folder of an assembly's files, and where its FASTA is in it unless its row says otherwise.
ASSEMBLY_FOLDER = "https://hgdownload.soe.ucsc.edu/goldenPath/%s/"
GOLDEN_PATH = ASSEMBLY_FOLDER + "bigZips/%s.fa.gz"


def assembly_url(ucsc_name: Column) -> Column:
    return F.format_string(ASSEMBLY_FOLDER, ucsc_name)


def fasta_url(pinned: Column, ucsc_name: Column) -> Column:
    """Where an assembly's FASTA is: where its row says, else where such files are."""
    return F.coalesce(pinned, golden_path_url(ucsc_name))


def golden_path_url(ucsc_name: Column) -> Column:
    return F.format_string(GOLDEN_PATH, ucsc_name, ucsc_name)
