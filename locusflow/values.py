"""Sequences as values: text that knows its alphabet, and whose parts and transforms know theirs."""

from __future__ import annotations

from typing import ClassVar

from .functions.sequence import ALPHABETS, DNA_PAIRS, RNA_PAIRS


class Sequence(str):
    """Text of one kind of sequence. Any characters are kept, as they are; :meth:`outside` tells which the alphabet lacks."""

    kind: ClassVar[str] = ""
    __slots__ = ()

    def __new__(cls, text: str = "") -> Sequence:
        if not cls.kind:
            raise TypeError("a sequence is DNA, RNA or Protein")
        return super().__new__(cls, text)

    @classmethod
    def outside(cls, text: str) -> list[str]:
        """Characters of ``text`` that the alphabet has in neither case, each once, by code point."""
        letters = ALPHABETS[cls.kind]
        return sorted(set(text).difference(letters, letters.lower()))

    def __getitem__(self, at: int | slice) -> Sequence:
        return type(self)(super().__getitem__(at))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({super().__repr__()})"


class _Nucleotides(Sequence):
    __slots__ = ()
    pairs: ClassVar[dict[int, int]] = {}

    def complement(self) -> _Nucleotides:
        return type(self)(self.translate(self.pairs))

    def reverse_complement(self) -> _Nucleotides:
        return self.complement()[::-1]

    def gc_content(self) -> float:
        """The share of G and C in all characters; 0.0 for an empty sequence."""
        return sum(map(self.count, "GCgc")) / max(1, len(self))


class DNA(_Nucleotides):
    __slots__ = ()
    kind, pairs = "dna", str.maketrans(*DNA_PAIRS)

    def transcribe(self) -> RNA:
        return RNA(self.replace("T", "U").replace("t", "u"))


class RNA(_Nucleotides):
    __slots__ = ()
    kind, pairs = "rna", str.maketrans(*RNA_PAIRS)

    def back_transcribe(self) -> DNA:
        return DNA(self.replace("U", "T").replace("u", "t"))


class Protein(Sequence):
    __slots__ = ()
    kind = "protein"
