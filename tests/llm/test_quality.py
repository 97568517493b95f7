"""Operator 9 against an independent fit: least squares of its own, and pooling by its definition."""

import random

import numpy as np
from pyspark.sql import functions as F

from locusflow.llm import quality


def pooled(x, n, ones):
    """Isotonic rates by the min-max formula: the least, over ends at or after a place, of the greatest mean that ends there."""
    means = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()
    k = len(x)
    return np.array([min(max(means(a, b) for a in range(i + 1)) for b in range(i, k)) for i in range(k)])


def test_pooling():
    draw = random.Random(2)
    for k in (1, 2, 7, 40):
        x = np.arange(k) / 10
        n = np.array([draw.randrange(1, 9) for _ in range(k)], float)
        ones = np.array([draw.randrange(int(m) + 1) for m in n], float)
        knots, levels = quality.isotonic(x, n, ones)
        assert np.allclose(np.interp(x, knots, levels), pooled(x, n, ones))


def test_the_fit_is_the_ridge_solution(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["good", "Bad", "42", "#!", "word, word."]) for _ in range(draw.randrange(1, 80))) for _ in range(300)]
    rows = [(t, float("#!" in t[:30]), i % 5) for i, t in enumerate(texts) if i % 5]
    stats = np.array([quality.statistics(t) for t, _, _ in rows])
    labels, folds = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    df = quality.with_statistics(spark.createDataFrame(rows, "text string, label double, fold int"))
    model = quality.fit(df, n_features=16, ridge=1e-2)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale[stats.std(0) > 1e-6], stats.std(0)[stats.std(0) > 1e-6])
    mine = folds != 1
    z = np.hstack([model.features(stats[mine]), np.ones((mine.sum(), 1))])
    # the ridge as more rows of a least-squares problem, solved without normal equations
    weight = np.sqrt(1e-2 * mine.sum() / 16)
    more = np.hstack([weight * np.eye(16), np.zeros((16, 1))])
    solved = np.linalg.lstsq(np.vstack([z, more]), np.concatenate([labels[mine], np.zeros(16)]), rcond=None)[0]
    assert np.allclose(model.weights, solved[:-1], atol=1e-6) and abs(model.intercept - solved[-1]) < 1e-6
    raw = np.rint((np.clip(model.raw(stats[~mine]), -1, 2) + 1) * 1000)
    x = np.unique(raw)
    n = np.array([(raw == v).sum() for v in x], float)
    ones = np.array([labels[~mine][raw == v].sum() for v in x])
    assert np.allclose(np.interp(x / 1000 - 1, model.knots, model.levels), pooled(x, n, ones), atol=1e-9)


def test_gaussian_kernel(spark):
    """Products of many random features come near the kernel that they stand for."""
    stats = np.random.default_rng(1).normal(size=(20, quality.N_STATS))
    df = spark.createDataFrame([(s.tolist(), float(i % 2), 2) for i, s in enumerate(stats)], "stats array<double>, label double, fold int")
    model = quality.fit(df.select("stats", "label", F.col("fold").cast("int").alias("fold")), n_features=20_000 // 20)
    z = np.clip((stats - model.mean) / model.scale, -4, 4)
    exact = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * quality.N_STATS))
    assert np.abs(model.features(stats) @ model.features(stats).T - exact).max() < 0.15
