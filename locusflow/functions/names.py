"""Names of multi-organism references: components joined by ``_``, chromosomes suffixed by a separator and component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENT = r"\A[A-Za-z0-9]+\z"


def derive_name(components: Column) -> Column:
    """Components in code-point order, joined."""
    return F.array_join(F.array_sort(components), "_")


def components_error(components: Column) -> Column:
    """Why an array of components makes no name, or null."""
    return (
        F.when(F.size(components) < 2, "a chimera has at least two components")
        .when(~F.forall(components, lambda c: c.rlike(COMPONENT)), "component names are alphanumeric")
        .when(F.size(F.array_distinct(components)) < F.size(components), "components repeat")
    )


def split_name(name: Column) -> Column:
    """A name's components, or null if it isn't two or more alphanumeric parts."""
    parts = F.split(name, "_")
    return F.when((F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(COMPONENT)), parts)


def underscore_run(name: Column) -> Column:
    """The longest run of underscores in a name."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(name, F.lit("_+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))


def separator(longest_run: Column) -> Column:
    """One underscore more than any name has in a row, and two at least."""
    return F.repeat(F.lit("_"), F.greatest(F.lit(2), longest_run + 1))


def separator_error(sep: Column) -> Column:
    return F.when(~sep.rlike(r"\A__+\z"), "a separator is two underscores or more")


def suffixed(chrom: Column, component: Column, sep: Column) -> Column:
    return F.concat(chrom, sep, component)


# Fixed value: the published expression that takes a suffixed name apart, around the separator.
PUBLISHED = ("^(?P<chromosome>.+)", "(?P<component>[A-Za-z0-9]+)$")


def suffix_pattern(sep: Column) -> Column:
    """The published expression that takes a suffixed name apart; an error where ``sep`` is no separator."""
    return F.when(separator_error(sep).isNull(), F.concat(F.lit(PUBLISHED[0]), sep, F.lit(PUBLISHED[1]))).otherwise(F.raise_error(separator_error(sep)))


def split_suffixed(name: Column, sep: Column) -> tuple[Column, Column]:
    """(chromosome, component) at the last separator; both null if the name carries no suffix."""
    component = F.call_function("substring_index", name, sep, F.lit(-1))
    head = F.length(name) - F.length(component) - F.length(sep)
    good = (head > 0) & component.rlike(COMPONENT) & F.contains(name, sep)
    return F.when(good, F.substring(name, F.lit(1), head)), F.when(good, component)


def component_of(name: Column, sep: Column, assembly: Column) -> Column:
    """A chromosome's component; a plain assembly (null separator) is its own."""
    return F.coalesce(F.when(sep.isNotNull(), split_suffixed(name, F.coalesce(sep, F.lit("__")))[1]), assembly)
