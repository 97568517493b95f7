"""Operator 9, quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a vector of statistics (lengths, character classes, repetition). Standardised,
these are mapped to cosines of random projections, whose inner products approximate a Gaussian
kernel. Normal equations are summed within partitions and solved once; raw scores of a part of the
training rows that the fit did not see are made probabilities by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, without

FOLDS = 5
THRESHOLD = 0.3
_ENDS = frozenset(b"!#$%&*+,-./:;<=>?@^_|~")


def statistics(text: str | None) -> list[float]:
    """What the classifier sees of a text; null is as empty. All of the text counts, and nothing but the text."""
    data = (text or "").encode()
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    n, w = max(1, len(data)), max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    of = lambda chars: float(c[list(chars)].sum()) / n
    letters = max(1, int(c[65:91].sum() + c[97:123].sum() + c[128:].sum()))
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)),
        lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        of(range(48, 58)), float(c[65:91].sum()) / letters, float(c[128:].sum()) / n, of(b" "), of(b"\n\t\r"), of(b".,;:"), of(b"!?"), of(b"|"), of(b"#$%&*@^~"), of(b"<>{}[]()/\\=_+-"), of(b"\"'"),
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:], strict=False))) / w, len(set(lines)) / len(lines),
        sum(x[-1] in _ENDS for x in words) / w, sum(map(bytes.isupper, words)) / w, float((lengths == 1).sum()) / w,
        (len(data) - len(b" ".join(words))) / n,
    ]


N_STATS = len(statistics(""))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats``, an array of doubles, in place of the text."""
    import pyarrow as pa

    docs = without(docs, "stats")
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t) for t in batch.column(text_col).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), found], names=[*(f.name for f in kept), "stats"])

    return docs.mapInArrow(each, T.StructType([*kept, T.StructField("stats", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Model:
    """All that scoring takes: some hundred kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    intercept: float
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights + self.intercept

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def held_out(id_: Column) -> Column:
    """The fold of a document, 0 to 4; a null id is of fold 1 (it has no label to learn)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS, F.lit(1))


def _matrix(stats) -> np.ndarray:
    return np.stack(stats.to_numpy()).astype(np.float64) if len(stats) else np.zeros((0, N_STATS))


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum over partitions of what ``part`` makes of a pandas batch, a vector of ``width``; a vector a partition travels."""
    import pandas as pd

    def each(batches: Iterator) -> Iterator:
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += part(batch)
        yield pd.DataFrame({"v": [total]})

    return sum((np.array(r[0]) for r in rows.mapInPandas(each, "v array<double>").collect()), np.zeros(width))


def fit(train: DataFrame, n_features: int = 256, ridge: float = 1e-3, bandwidth: float = 1.0, seed: int = 5, partitions: int = 16) -> Model:
    """A model of training rows (stats, label, fold); rows of fold 1 calibrate what the others fit.

    ``train`` is bounded by its maker and dealt to ``partitions``, so the driver gets that many
    sums of n_features squared. With no rows all scores are 0.5; with one class, its rate.
    """
    rows = checkpointed(train.repartition(partitions))
    d, k = N_STATS, n_features
    moments = _summed(rows, lambda b: np.concatenate([[len(b)], _matrix(b["stats"]).sum(0), (_matrix(b["stats"]) ** 2).sum(0)]), 1 + 2 * d)
    n = max(1.0, moments[0])
    mean = moments[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    draws = np.random.default_rng(seed)
    blank = Model(mean, scale, draws.normal(size=(d, k)) / (bandwidth * np.sqrt(d)), draws.uniform(0, 2 * np.pi, k), np.zeros(k), 0.0, np.array([0.0]), np.array([0.5]))
    if not moments[0]:
        return blank

    def equations(batch) -> np.ndarray:
        mine = batch[batch["fold"] != 1]
        z = np.hstack([blank.features(_matrix(mine["stats"])), np.ones((len(mine), 1))])
        return np.concatenate([(z.T @ z).ravel(), z.T @ mine["label"].to_numpy(np.float64)])

    sums = _summed(rows, equations, (k + 1) ** 2 + k + 1)
    gram, right = sums[: (k + 1) ** 2].reshape(k + 1, k + 1), sums[(k + 1) ** 2 :]
    penalty = np.diag([ridge * max(1.0, gram[-1, -1]) / k] * k + [1e-9])
    solved = np.linalg.solve(gram + penalty, right)
    model = Model(mean, scale, blank.directions, blank.phases, solved[:-1], float(solved[-1]), blank.knots, blank.levels)
    knots, levels = isotonic(*_binned(rows, model))
    return Model(mean, scale, blank.directions, blank.phases, solved[:-1], float(solved[-1]), knots, levels)


#: Raw scores are told apart to this step when calibrated, between -1 and 2.
STEP = 1 / 1000


def _binned(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibration rows by raw score: centres, numbers, and sums of labels (at most 3,001 bins); of all rows if fold 1 has none."""

    def bins(only: bool):
        def part(batch) -> np.ndarray:
            mine = batch[batch["fold"] == 1] if only else batch
            at = np.rint((np.clip(model.raw(_matrix(mine["stats"])), -1, 2) + 1) / STEP).astype(int)
            width = round(3 / STEP) + 1
            return np.concatenate([np.bincount(at, minlength=width), np.bincount(at, mine["label"].to_numpy(np.float64), minlength=width)])

        return _summed(rows, part, 2 * (round(3 / STEP) + 1)).reshape(2, -1)

    counts, ones = bins(True)
    if not counts.sum():
        counts, ones = bins(False)
    full = np.flatnonzero(counts)
    return full * STEP - 1, counts[full], ones[full]


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooling adjacent violators: non-decreasing rates over ``x``, as knots for interpolation."""
    blocks: list[list[float]] = []  # rate, rows, first x, last x
    for a, m, s in zip(x, n, ones, strict=True):
        blocks.append([s / m, m, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            rate, rows, _, last = blocks.pop()
            head = blocks[-1]
            head[0] = (head[0] * head[1] + rate * rows) / (head[1] + rows)
            head[1] += rows
            head[3] = last
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] for b in blocks for _ in (0, 1)])


def train_rows(stats: DataFrame, labels: DataFrame, max_rows: int = 200_000, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stats, label, fold) of labelled documents outside fold 0, at most about ``max_rows``, chosen by a hash of the id.

    Repeated labels of an id count as their mean; null ids and labels teach nothing.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(label_col).alias("label"))
    rows = stats.withColumn("fold", held_out(F.col(id_col))).filter("fold <> 0").join(known, id_col)
    n = known.count()
    share = min(1.0, max_rows / max(1, n))
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)).select("stats", "label", "fold")


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score``."""
    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(values), pa.float64())], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(each, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on).

    Null and empty texts are scored by the statistics of an empty text. Equal texts have equal
    scores; repeated rows keep a row each. Without labels every score is 0.5.
    """
    stats = checkpointed(with_statistics(docs.select(id_col, F.col(text_col).alias("text"))))
    model = fit(train_rows(stats, labels, max_rows, id_col))
    out = scored(stats, model)
    return out.select(id_col, (held_out(F.col(id_col)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted 0, in their own columns, whatever their names.

    The labelled ones fit the model (at most about ``max_rows``), then each text is scored where it
    is. Null and empty texts are scored like others, repeated rows alike, and rows without an id
    too; without any label all scores are 0.5, with one kind of label its rate. An empty table gives no rows.
    """
    import pyarrow as pa

    teaching = docs.select(id_col, F.col(text_col).alias("text")).join(labels.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), id_col, "left_semi")
    model = fit(train_rows(checkpointed(with_statistics(teaching)), labels, max_rows, id_col))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(text_col).to_pylist()], np.float64).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(stats) >= THRESHOLD))

    return docs.mapInArrow(each, docs.schema)
