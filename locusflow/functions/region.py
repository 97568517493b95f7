"""Loci as columns: 0-based, half-open. What is wrong with a row is said in its ``error`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCUS = r"\A(.+):([\d,]+)-([\d,]+)\z"
STRANDS = ("+", "-", ".")


def parse(text: Column) -> dict[str, Column]:
    """``chrom``, ``start``, ``end`` and ``error`` of ``chrom:start-end`` or a bare chromosome (null start and end)."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+\z", "")
    found = trimmed.rlike(LOCUS)
    number = lambda g: F.when(found, F.replace(F.regexp_extract(trimmed, LOCUS, g), F.lit(","), F.lit("")).try_cast("bigint"))
    broken = (~found & F.contains(trimmed, F.lit(":"))) | (found & (number(2).isNull() | number(3).isNull()))
    return {
        "chrom": F.when(broken, F.lit(None)).when(found, F.regexp_extract(trimmed, LOCUS, 1)).otherwise(trimmed),
        "start": F.when(~broken, number(2)), "end": F.when(~broken, number(3)),
        "error": F.when(broken, F.lit("malformed region")),
    }


def invalid(start: Column, end: Column, strand: Column) -> Column:
    """What a region itself violates, the first of: start, end, strand; else null."""
    return F.when(start < 0, "start must be >= 0").when(end < start, "end must be >= start").when(~strand.isin(*STRANDS) | strand.isNull(), "strand must be one of + - .")


def length(start: Column, end: Column) -> Column:
    return end - start


def spelled(chrom: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", chrom, start, end)


def unresolved(size: Column, start: Column, end: Column) -> Column:
    """What is wrong with a region on a chromosome of ``size`` (null: unknown), in the order that it is checked."""
    return F.when(size.isNull(), "unknown chromosome").when(start < 0, "start must be >= 0").when(start > end, "start is past end").when(end > size, "end exceeds chromosome length")
