"""Operator 10, token counts: prefix dynamic programming gives the exact count at every prefix.

Where no piece of the vocabulary joins two neighbouring characters, a text's encoding is that of
its two sides. So it falls into segments: space marks, then characters that pieces do join. Within a segment the encoding of a prefix
ends in the one vocabulary piece that is compatible with the last piece of the shorter prefix
before it; its count is that prefix's plus one. Segments are worked out once a worker and kept in a
bounded table; a text's counts are its segments' counts laid end to end, one small difference for
each character, from which truncation and budgets are read without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import sub
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without

MARK = "▁"
#: Segments and pairs that a worker keeps before it starts anew (some 150 MB).
KEPT = 800_000
ADDED = ("n_bytes", "n_tokens", "keep_chars", "prefix_deltas")


class PrefixCounter:
    """Counts of a SentencePiece BPE model with byte fallback, at every prefix."""

    def __init__(self, model: str) -> None:
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        ordinary = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in ordinary}
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.cut = self.segments()
        self.lead = len(lib.encode("\n"))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, bytes]] = {}

    def segments(self) -> re.Pattern:
        """An expression for a text's segments: characters that some piece joins, directly or through others, stay together.

        Space marks go with what follows them; they must end no piece that holds anything else.
        """
        parent: dict[str, str] = {}

        def root(c: str) -> str:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        for piece in self.scores:
            body = piece.lstrip(MARK)
            if MARK in body:
                return re.compile(r"(?s).+")
            for a, b in zip(body, body[1:], strict=False):
                parent[root(a)] = root(b)
        groups: dict[str, list[str]] = {}
        for c in parent:
            groups.setdefault(root(c), []).append(c)
        kinds = ["[" + "".join(map(re.escape, sorted(g))) + "]+" for g in sorted(groups.values(), key=len, reverse=True) if len(g) > 1]
        return re.compile(f"(?s){MARK}*(?:{'|'.join([*kinds, f'[^{MARK}]'])})|{MARK}+")

    def pieces(self, text: str) -> list[str]:
        """Pieces of a short string, encoded behind a newline, which is a byte piece that joins nothing."""
        return self.library.encode("\n" + text.replace(MARK, " "), out_type=str)[self.lead :]

    def stand_together(self, left: str, right: str) -> bool:
        """Whether two pieces encode to themselves side by side; a character of no piece stands with anything."""
        key = (left, right)
        if (out := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            parts = [p for p in (left, right) if p]
            known = all(p in self.scores for p in parts)
            out = self.pairs[key] = not known or self.pieces(left + right) == parts
        return out

    def counts(self, segment: str) -> list[int]:
        """Tokens of segment[:1], segment[:2], ... by dynamic programming over the last piece of each prefix.

        An automaton gives the pieces that end at each character, longest first.
        """
        scores, pairs, together = self.scores, self.pairs, self.stand_together
        last, count, done = [""], [0], 0
        for at, piece in self.automaton.iter(segment):
            if at < done:
                continue
            if at > done:
                if not self._alone(segment[done:at], last, count):
                    return []
                done = at
            before = at + 1 - len(piece)
            fits = pairs.get((last[before], piece))
            if together(last[before], piece) if fits is None else fits:
                last.append(piece)
                count.append(count[before] + 1)
                done = at + 1
        return count[1:] if self._alone(segment[done:], last, count) else []

    def _alone(self, characters: str, last: list[str], count: list[int]) -> bool:
        """Adds characters that end no fitting piece, as bytes; False if one is a piece itself."""
        for c in characters:
            if c in self.scores:
                return False
            last.append(c)
            count.append(count[-1] + len(c.encode("utf-8", "replace")))
        return True

    def by_library(self, segment: str) -> int:
        return len(self.library.encode("\n" + segment.replace(MARK, " "))) - self.lead

    def learn(self, segments: list[str]) -> None:
        """Adds the segments' counts and differences at each character to what is known; the library has the last word."""
        totals = self.library.encode(["\n" + s.replace(MARK, " ") for s in segments], num_threads=1)
        for segment, ids in zip(segments, totals, strict=True):
            found = self.counts(segment)
            if not found or found[-1] != len(ids) - self.lead:
                found = [self.by_library(segment[:i]) for i in range(1, len(segment) + 1)]
            self.known[segment] = found[-1], pack(f"<{len(found)}h", *map(sub, found, [0, *found]))

    def deltas(self, text: str) -> tuple[int, bytes]:
        """The text's count and, as 16-bit integers, how the count changes with each character.

        The first difference holds the space mark that the model puts before a text.
        """
        if not text:
            return 0, b""
        parts = self.cut.findall(MARK + text.replace(" ", MARK))
        if len(self.known) >= KEPT:
            self.known.clear()
        known = self.known
        if new := list(set(parts).difference(known)):
            self.learn(new)
        entries = [known[p] for p in parts]
        joined = b"".join([e[1] for e in entries])
        first = np.frombuffer(joined[:4], "<i2").sum().astype("<i2").tobytes()
        return sum(e[0] for e in entries), first + joined[4:]


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Token counts of the text's prefixes of 0, 1, 2, ... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64)])


def truncation(deltas: bytes, budget: int) -> int:
    """The most characters from the start whose encoding has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``, ``keep_chars`` and ``prefix_deltas``.

    ``keep_chars`` is the longest prefix within ``limit`` tokens; ``prefix_deltas`` is what
    :func:`prefix_counts` and :func:`truncation` read. Null and empty texts have 0 tokens and an
    empty array. Every row is counted by itself, so repeated rows and null ids need no rule; an
    empty table gives no rows. ``model`` must be a path that every executor has.
    """
    import pyarrow as pa

    docs = without(docs, *ADDED)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("keep_chars", T.LongType()), T.StructField("prefix_deltas", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = [counter.deltas(t) for t in texts]
            keep = [len(t) if n <= limit else truncation(d, limit) for t, (n, d) in zip(texts, found, strict=True)]
            more = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array(keep, pa.int64()), pa.array([d for _, d in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *ADDED])

    return docs.mapInArrow(each, schema)


_COUNTERS: dict[str, PrefixCounter] = {}


def worker_counter(model: str) -> PrefixCounter:
    """One counter for each model in a Python worker, kept between tasks."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]
