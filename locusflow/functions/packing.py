"""Bases in two bits each, with runs of what two bits can't say, as columns: packed whole, unpacked for a range alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases in the order of their codes (fixed values); a hexadecimal digit is two of them.
BASES = "ACGT"
#: A tile with more runs than this of other letters, or of lower case, is kept as text.
MOST_RUNS = 512
RUNS = "array<struct<start:int,length:int,base:string>>"
_DIGITS = [(f"{4 * i + j:x}", a + b) for i, a in enumerate(BASES) for j, b in enumerate(BASES)]


def _runs(text: Column, pattern: str) -> Column:
    """(start, length, first letter) of each match: gaps and matches laid end to end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("run"))

    def place(done: Column, x: Column) -> Column:
        start = done["end"] + F.length(x["gap"])
        run = F.struct(start.alias("start"), F.length(x["run"]).alias("length"), F.substring(x["run"], 1, 1).alias("base"))
        return F.struct((start + F.length(x["run"])).alias("end"), F.concat(done["runs"], F.array(run)).alias("runs"))

    return F.aggregate(both, F.struct(F.lit(0).alias("end"), F.array().cast(RUNS).alias("runs")), place, lambda done: done["runs"])


def packed(bases: Column) -> dict[str, Column]:
    """Columns ``packed`` (four bases a byte), ``other`` (runs of letters besides A, C, G, T), ``masked`` (runs in lower case) and ``bases``.

    ``bases`` has the text itself where it isn't made of ASCII letters or has too many runs; the
    others are null then. Nothing is lost either way.
    """
    other, lower = r"([^ACGT])\1*", "[a-z]+"
    large = F.upper(bases)
    fits = bases.rlike(r"\A[A-Za-z*-]*\z") & (F.regexp_count(large, F.lit(other)) <= MOST_RUNS) & (F.regexp_count(bases, F.lit(lower)) <= MOST_RUNS)
    plain = F.regexp_replace(large, "[^ACGT]", BASES[0])
    pairs = F.regexp_replace(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, BASES[0]), "(..)", "$1,")
    for digit, two in _DIGITS:
        pairs = F.replace(pairs, F.lit(f"{two},"), F.lit(digit))
    return {"packed": F.when(fits, F.unhex(pairs)), "other": F.when(fits, _runs(large, other)), "masked": F.when(fits, _runs(bases, lower)), "bases": F.when(~fits, bases)}


def unpacked(row: dict[str, Column], start: Column, end: Column, masked: bool = True) -> Column:
    """The bases from ``start`` to ``end`` (0-based, end exclusive, within the tile) of a tile's columns as :func:`packed` makes them."""
    start, end = start.cast("int"), end.cast("int")
    first = F.floor(start / 4).cast("int")
    bytes_ = F.substring(row["packed"], first + 1, F.ceil(end / 4).cast("int") - first)
    text = F.lower(F.hex(bytes_))
    for digit, two in _DIGITS:
        text = F.replace(text, F.lit(digit), F.lit(two))
    text = F.substring(text, start - first * 4 + 1, end - start)

    def over(runs: Column, text: Column, new) -> Column:
        mine = F.filter(runs, lambda r: (r["start"] < end) & (r["start"] + r["length"] > start))

        def put(so_far: Column, r: Column) -> Column:
            a = F.greatest(r["start"], start)
            n = F.least(r["start"] + r["length"], end) - a
            return F.overlay(so_far, new(so_far, a - start + 1, n, r), a - start + 1, n)

        return F.when(F.size(mine) > 0, F.aggregate(mine, text, put)).otherwise(text)

    text = over(row["other"], text, lambda s, at, n, r: F.repeat(r["base"], n))
    if masked:
        text = over(row["masked"], text, lambda s, at, n, r: F.lower(F.substring(s, at, n)))
    return F.when(row["packed"].isNotNull(), text).otherwise(F.substring(row["bases"], start + 1, end - start))
