"""Nucleotide and protein strings as columns. Case is data and survives; alphabets are documentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of each alphabet and their complements.
ALPHABETS = {"dna": "ACGT", "rna": "ACGU", "protein": "ACDEFGHIKLMNPQRSTVWY"}
DNA_PAIRS = ("ACGTacgt", "TGCAtgca")
RNA_PAIRS = ("ACGUacgu", "UGCAugca")


def complement(seq: Column, alphabet: str = "dna") -> Column:
    """Each base's partner; all other characters stay."""
    return F.translate(seq, *(DNA_PAIRS if alphabet == "dna" else RNA_PAIRS))


def reverse_complement(seq: Column, alphabet: str = "dna") -> Column:
    return F.reverse(complement(seq, alphabet))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def back_transcribe(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def unmasked(seq: Column) -> Column:
    """Without soft-masking: a-z in upper case."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def gc_content(seq: Column) -> Column:
    """Share of G and C in all characters, N too; 0.0 for an empty sequence."""
    n = F.length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(seq, "GCgc", ""))) / n)


def outside_alphabet(seq: Column, alphabet: str) -> Column:
    """Distinct characters that are not of the alphabet in either case, as spelled, by code point."""
    letters = ALPHABETS[alphabet]
    rest = F.translate(seq, letters + letters.lower(), "")  # what is left is split, not the sequence
    return F.array_sort(F.filter(F.array_distinct(F.split(rest, "")), lambda c: c != ""))


def slice_(seq: Column, start: Column | int | None = None, stop: Column | int | None = None, step: int = 1) -> Column:
    """``seq[start:stop:step]`` as Python has it, negative positions and steps too."""
    n = F.length(seq)
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def at(x: Column | int | None, default: Column) -> Column:
        if x is None:
            return default
        x = whole(x)
        return F.greatest(low, F.least(high, F.when(x < 0, x + n).otherwise(x)))

    a, b = at(start, low if step > 0 else high), at(stop, high if step > 0 else low)
    if step == 1:
        return F.when(b > a, F.substring(seq, a + 1, b - a)).otherwise(F.lit(""))
    run = F.when(b > a, F.substring(seq, a + 1, b - a)) if step > 0 else F.when(a > b, F.reverse(F.substring(seq, b + 2, a - b)))
    every = run if abs(step) == 1 else F.regexp_replace(run, f"(?s)(.).{{0,{abs(step) - 1}}}", "$1")
    return F.coalesce(F.when(seq.isNotNull(), F.coalesce(every, F.lit(""))), seq)


def index(seq: Column, at: Column) -> Column:
    """The character at a place as Python has it, from the end for a negative one; null where there is none, see :func:`index_error`."""
    place = F.when(at < 0, at + F.length(seq)).otherwise(at)
    return F.when(index_error(seq, at).isNull(), F.substring(seq, place.cast("int") + 1, F.lit(1)))


def index_error(seq: Column, at: Column) -> Column:
    n = F.length(seq)
    return F.when((at >= n) | (at < -n), F.concat(F.lit("no place "), at.cast("string"), F.lit(" in "), n.cast("string")))


def as_repr(seq: Column, alphabet: str = "dna") -> Column:
    name = {"dna": "DNA", "rna": "RNA", "protein": "Protein"}[alphabet]
    return F.concat(F.lit(f"{name}('"), seq, F.lit("')"))
