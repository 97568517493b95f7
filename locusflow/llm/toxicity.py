"""Operator 12, toxicity: maximum-scoring segments over token log-odds, made a score by extreme-value calibration.

Words and their beginnings get log-odds of standing in toxic rather than clean documents, with a
Dirichlet prior at the classes' own rates; those whose odds are beyond doubt score, every other word
costs a little. One linear scan finds all maximal scoring segments of a text. As scores are
log-odds, a text of m words has by chance K m exp(-S) segments of score S or more; what its segments
exceed that by is summed, and the sum turned into a probability by isotonic regression on documents
that the odds were not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, checkpointed, slices, text_or_empty, without
from .quality import isotonic

FOLDS, HELD, CALIBRATING = 4, 2, 3
THRESHOLD = 0.3
#: Letters that a word's beginnings have: words inflected or spelled anew share these.
BEGINNINGS = (7, 6, 5, 4)
#: Words whose score a worker remembers before it starts anew (some 20 MB).
KEPT = 200_000
#: Evidence sums are told apart to 1 / STEPS, up to MOST, when calibrated.
STEPS, MOST = 4, 64

PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("excess", T.DoubleType())]))


def fold(id_: Column) -> Column:
    """The fold of a document, 0 to 3; a null id is of fold 0."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def spelled(text: Column) -> Column:
    """A text's words (letters and digits, in lower case) with one space between."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+", " "))


def beginnings(word: str) -> list[str]:
    """A word's features, most specific first: itself, then its first letters where it goes on."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def _features(words: Column) -> Column:
    """The distinct features of an array of words, as :func:`beginnings` has them."""
    of = [words, *[F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-"))) for n in BEGINNINGS]]  # noqa: B023
    return F.array_distinct(F.concat(*of))


@dataclass(frozen=True)
class Model:
    """All that scoring takes: at most ``max_features`` odds and as many exceptions, and a few hundred numbers."""

    odds: dict[str, float] = field(default_factory=dict)
    cost: float = 0.01
    chance: float = 1.0
    knots: Sequence[float] = (0.0,)
    levels: Sequence[float] = (0.0,)

    def of(self, word: str) -> float:
        """A word's log-odds, of its most specific known feature; 0 if none is known."""
        return next((self.odds[f] for f in beginnings(word) if f in self.odds), 0.0)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(np.minimum(evidence, MOST), self.knots, self.levels), 0, 1)


class _Remembered(dict):
    """Odds by word, worked out when first asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        self[word] = value = max(0.0, self.model.of(word))
        return value


def segments(at: Sequence[int], odds: Sequence[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments: (start, end, score), by position, end exclusive.

    ``at`` are the places of the words that score, ``odds`` what they score; every other word costs
    ``cost``. Each word joins the segments before it that it makes better, from the nearest with less
    before it on; the links from each to that one keep all searches together linear.
    """
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum behind
    links: list[int] = []
    total, last = 0.0, 0
    for place, value in zip(at, odds, strict=True):
        total -= cost * (place - last)
        start, before, total, last = place, total, total + value, place + 1
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = links[j]
            if j < 0 or kept[j][3] >= total:
                break
            start, before = kept[j][0], kept[j][2]
            del kept[j:], links[j:]
            j -= 1
        kept.append((start, last, before, total))
        links.append(j)
    return [(a, b, high - low) for a, b, low, high in kept]


def passages(at: Sequence[int], odds: Sequence[float], n_words: int, model: Model) -> list[tuple[int, int, float, float]]:
    """The segments that chance doesn't explain, with the excess of their score over what it reaches in so long a text."""
    by_chance = log(max(model.chance * n_words, 1e-300))
    return [(a, b, s, s - by_chance) for a, b, s in segments(at, odds, model.cost) if s > by_chance]


def _marked(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """``rows`` with ``n_words``, and ``at`` and ``odds`` of the words that score, in place of the spelled text."""
    import pyarrow as pa

    kept = [f for f in rows.schema.fields if f.name != text]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(model)
        for batch in (part for whole in batches for part in slices(whole, text, 8 << 20)):
            counts, places, values = [], [], []
            for words in batch.column(text).to_pylist():
                found = np.fromiter(map(known.__getitem__, words.split()), np.float64)
                full = np.flatnonzero(found)
                counts.append(len(found))
                places.append(full.astype(np.int32))
                values.append(found[full])
            made = [pa.array(counts, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), "n_words", "at", "odds"])

    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    return rows.mapInArrow(each, T.StructType([*kept, T.StructField("n_words", T.IntegerType()), T.StructField("at", ints), T.StructField("odds", doubles)]))


def _evident(marked: DataFrame, model: Model) -> DataFrame:
    """``marked`` with ``passages`` and ``score`` in place of the words that score."""
    import pyarrow as pa

    kept = [f for f in marked.schema.fields if f.name not in ("at", "odds")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("at", "odds", "n_words")), strict=True)
            found = [passages(at, odds, n, model) if at else [] for at, odds, n in rows]
            spans = pa.array([[dict(zip(("start", "end", "score", "excess"), p, strict=True)) for p in of] for of in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("excess", pa.float64())])))
            scores = model.scores(np.array([sum(p[3] for p in of) for of in found], np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), spans, pa.array(scores, pa.float64())], names=[*(f.name for f in kept), "passages", "score"])

    return marked.mapInArrow(each, T.StructType([*kept, T.StructField("passages", PASSAGES), T.StructField("score", T.DoubleType())]))


def teaching(docs: DataFrame, labels: DataFrame, max_rows: int, label_col: str = "toxic") -> DataFrame:
    """(text, label, fold) of ``docs`` (id, text) that ``labels`` knows outside the held-out fold: at most about ``max_rows``, by a hash of the text.

    Equal texts count once, with the mean of their labels, so that copies are no evidence of their own.
    The fold is then the least of their ids'. Null ids and labels teach nothing.
    """
    known = labels.filter(F.col("id").isNotNull() & F.col(label_col).isNotNull()).groupBy("id").agg(F.avg(label_col).alias("label"))
    keyed = docs.withColumns({"fold": fold(F.col("id")), "key": F.sha2(text_or_empty(F.col("text")).cast("binary"), 256)}).filter(F.col("fold") != HELD)
    chosen = keyed.select("id", "key", "fold").distinct().join(known, "id").groupBy("key").agg(F.min(F.struct("id", "fold")).alias("first"), F.avg("label").alias("label"))
    chosen = checkpointed(chosen.select("key", "first.id", "first.fold", "label"))
    share = min(1.0, max_rows / max(1, chosen.count()))
    chosen = chosen.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_rows rows of some 150 bytes; an id with equal texts comes once
    return keyed.drop("fold").join(F.broadcast(chosen), ["id", "key"]).dropDuplicates(["id", "key"]).select("text", "label", "fold")


def _odds(counts: DataFrame, toxic: str, clean: str, sums: tuple[float, float], prior: float, surely: float, max_features: int) -> dict[str, float]:
    """Log-odds of the features that are toxic beyond doubt, and 0 for those below them that are known not to be."""
    t, c = (max(s, 1e-9) for s in sums)
    a, b = F.col(toxic) + prior * t / (t + c), F.col(clean) + prior * c / (t + c)
    rated = counts.withColumn("odds", F.log(a / b) - log(t / c)).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b))
    strong = rated.filter(F.col("z") > surely).orderBy(F.desc("z"), "feature").limit(max_features).select("feature", "odds").collect()
    found = {r.feature: r.odds for r in strong}
    stems = sorted(f for f in found if f.endswith("-"))
    if stems:
        below = F.array(*[F.concat(F.substring("feature", 1, n), F.lit("-")) for n in BEGINNINGS])
        under = counts.sparkSession.createDataFrame([(s,) for s in stems], "stem string")
        tame = rated.filter((F.col("odds") <= 0) & (F.col(clean) >= 2)).withColumn("stem", F.explode(below)).join(F.broadcast(under), "stem")
        found |= {r.feature: 0.0 for r in tame.select("feature", F.col(clean).alias("n")).distinct().orderBy(F.desc("n"), "feature").limit(max_features).collect() if r.feature not in found}
    return found


def fit(rows: DataFrame, prior: float = 2.0, surely: float = 4.0, max_features: int = 100_000) -> Model:
    """A model of (text, label, fold): odds learnt without the calibrating fold are calibrated on it, then learnt anew from all.

    ``prior`` is the Dirichlet prior's weight in documents, ``surely`` the standard errors by which
    odds must exceed 0, ``max_features`` the most that have odds, the surest first. Without labels
    of both kinds nothing has odds, and all scores are 0, or 1 if all labels are.
    """
    scratch = Scratch(rows.sparkSession, "toxicity")
    rows = scratch.table(rows.select(spelled(F.col("text")).alias("words"), "label", "fold"), "rows")
    weights = [F.col("label"), 1 - F.col("label")]
    learning = [F.when(F.col("fold") != CALIBRATING, w).otherwise(0.0) for w in weights]
    names = ["t", "c", "t0", "c0"]
    sums = [float(v or 0) for v in rows.agg(*[F.sum(w) for w in weights + learning]).first()]
    if not sums[0] or not sums[1]:
        return Model(levels=(1.0 if sums[0] else 0.0,))
    each = rows.select(*[w.alias(n) for w, n in zip(weights + learning, names, strict=True)], F.explode(_features(F.split("words", " "))).alias("feature"))
    counts = scratch.table(each.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).filter("t >= 1 OR c >= 2"), "counts")
    final = _odds(counts, "t", "c", (sums[0], sums[1]), prior, surely, max_features)
    trial = Model(_odds(counts, "t0", "c0", (sums[2], sums[3]), prior, surely, max_features) if sums[2] and sums[3] else final)
    marked = scratch.table(_marked(rows.filter(F.col("fold") == CALIBRATING) if sums[2] and sums[3] else rows, trial, "words"), "marked")
    toxic = F.col("label") >= 0.5
    hits, words = marked.filter(toxic).agg(F.sum(F.size("at")), F.sum("n_words")).first()
    cost = max(0.01, -log(1 - min(0.5, (hits or 0) / max(1, words or 0))))
    trial = Model(trial.odds, cost, 0.0)
    clean = _evident(marked.filter(~toxic), trial).agg(F.sum(F.size("passages")), F.sum("n_words")).first()
    least = min((v for v in trial.odds.values() if v > 0), default=0.0)
    chance = ((clean[0] or 0) + 1) * np.exp(least) / ((clean[1] or 0) + 1)
    found = _evident(marked, Model(trial.odds, cost, float(chance)))
    evidence = F.least(F.aggregate("passages", F.lit(0.0), lambda a, p: a + p["excess"]), F.lit(float(MOST)))
    bins = found.groupBy(F.round(evidence * STEPS).alias("x")).agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("x").collect()
    scratch.close()
    knots, levels = isotonic(*(np.array([float(r[k]) for r in bins]) for k in ("x", "n", "ones"))) if bins else (np.zeros(1), np.zeros(1))
    return Model(final, cost, float(chance), (knots / STEPS).tolist(), levels.tolist())


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``passages`` (start and end word, score, excess over chance) and ``score``.

    Words are runs of letters and digits. Null and empty texts have none. Columns of ``docs`` of
    these three names give way; any other name is free.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in without(docs, "n_words", "passages", "score").columns])
    return _evident(_marked(docs.select(record.alias("record"), spelled(F.col(text_col)).alias("words")), model, "words"), model).select("record.*", "n_words", "passages", "score")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each document: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.3 on), ``passages``.

    Learnt from at most about ``max_rows`` labelled texts outside the held-out fold; scored are all
    texts, whole. Null and empty texts have no passage and the score of a text without any; equal
    texts have equal scores; repeated rows keep a row each; rows with a null id are scored too. No
    labels: all scores are 0. An empty table gives no rows. Other columns of ``docs`` take no part.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
    out = scored(docs, fit(teaching(docs, known, max_rows)))
    return out.select(F.col("id").alias(id_col), (fold(F.col("id")) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
