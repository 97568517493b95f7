"""Operator 12: segments against their definition, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import queries, toxicity
from locusflow.llm.common import documents

from ..conftest import SF
from .test_edges import DDL, all_ids, rows


def defined(values):
    """Maximal scoring segments by their definition: the best one, then those of what is left and right of it."""

    def of(a, b):
        best = max(((sum(values[i:j]), -i, -(j - i)) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[1]
        j = i - best[2]
        return [*of(a, i), (i, j, best[0]), *of(j, b)]

    return of(0, len(values))


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_those_of_the_definition(seed):
    draw = random.Random(seed)
    cost = draw.choice([0.25, 0.5, 1.0])
    values = [draw.choice([0, 0, 0, 0.5, 1.0, 2.0, 3.25]) + draw.random() / 1000 * draw.choice([0, 1]) for _ in range(draw.randrange(30))]
    at = [i for i, v in enumerate(values) if v > 0]
    found = toxicity.segments(at, [values[i] for i in at], cost)
    wanted = defined([v if v > 0 else -cost for v in values])
    # a segment may be cut where its sum so far is nought: both ways are maximal
    assert sum(s for _, _, s in found) == pytest.approx(sum(s for _, _, s in wanted))
    assert {i for a, b, _ in found for i in range(a, b)} >= {i for i in at if any(a <= i < b for a, b, _ in wanted)}
    assert max((s for _, _, s in found), default=0) == pytest.approx(max((s for _, _, s in wanted), default=0))


def test_segments_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        toxicity.segments(range(0, 2 * n, 2), [1.0 + (i % 7) / 10 for i in range(n)], 1.3)
        return time.perf_counter() - began

    assert seconds(400_000) < 40 * max(seconds(40_000), 0.005)


def labelled(spark, n=1200):
    """Clean texts of common words; toxic ones with a few foul words, some inflected, at one place; very long clean ones."""
    draw = random.Random(1)
    common = [f"w{i}" for i in range(400)]
    foul = ["scumbag", "vilest", "rottener"]
    out = []
    for i in range(n):
        words = draw.choices(common, k=draw.choice([30, 120, 5000 if i % 50 == 0 else 60]))
        toxic = int(draw.random() < 0.15)
        for _ in range(draw.randrange(1, 4) * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(foul) + draw.choice(["", "", "ish", "ly", "s", f"q{i}"]))
        out.append((i, " ".join(words), toxic))
    return spark.createDataFrame(out, "doc_id long, text string, toxic int")


def test_held_out_documents(spark):
    docs = labelled(spark)
    found = toxicity.classify(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert 200 < len(held) < 400
    assert all(r.predicted == r.toxic for r in held), [(r.toxic, r.score) for r in held if r.predicted != r.toxic]
    for r in found:
        assert 0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3)
        words = r.text.split()
        if r.toxic:  # passages hold the foul words
            assert all(any(p.start <= i < p.end for p in r.passages) for i, w in enumerate(words) if not w.startswith("w"))


def test_no_held_out_label_is_used(spark):
    docs = labelled(spark, 400)
    turned = docs.select("doc_id", F.when(toxicity.fold(F.col("doc_id")) == toxicity.HELD, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    scores = lambda labels: sorted((r.doc_id, r.score) for r in toxicity.classify(docs.drop("toxic"), labels).collect())
    assert scores(turned) == scores(docs.select("doc_id", "toxic"))


def test_exceptions_below_a_stem(spark):
    """A clean word that begins as foul ones do isn't foul."""
    words = [("stupidly", 1), ("stupids", 1), ("stupidest", 1), ("stupa", 0), ("stupendous", 0)]
    docs = [(i, f"{w} in some words here", t) for i in range(400) for w, t in [words[i % 5]]]
    df = spark.createDataFrame(docs, "id long, text string, toxic int")
    model = toxicity.fit(toxicity.teaching(df.select("id", "text"), df.select("id", "toxic"), 1000))
    assert not any(model.of(w) > 0 for w in ("stupa", "stupendous", "words"))
    equal = spark.createDataFrame([(i, docs[i % 5][1] + f" {i}", docs[i % 5][2]) for i in range(400)], "id long, text string, toxic int")
    model = toxicity.fit(toxicity.teaching(equal.select("id", "text"), equal.select("id", "toxic"), 1000))
    assert model.of("stupidly") > 0 and model.of("stupidish") > 0 and not any(model.of(w) > 0 for w in ("stupendous", "words", "stupa"))


def test_odd_rows(spark):
    odd, none = spark.createDataFrame(rows(), DDL), spark.createDataFrame([], DDL)
    labels = labelled(spark, 300)
    both = odd.select("doc_id", "text").unionByName(labels.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    known = labels.select((F.col("doc_id") + 1000).alias("doc_id"), "toxic").unionByName(spark.createDataFrame([(None, 1), (1000, None), (1001, 0), (1001, 0)], "doc_id long, toxic int"))
    found = [r for r in toxicity.classify(both, known).collect() if r.doc_id is None or r.doc_id < 1000]
    assert sorted(str(r.doc_id) for r in found) == all_ids() and len({r.score for r in found}) == 1 and not any(r.predicted for r in found)
    blank = known.limit(0)
    assert {r.score for r in toxicity.classify(odd, blank).collect()} == {0.0}
    assert toxicity.classify(none, known).collect() == [] and toxicity.classify(none, blank).collect() == []
    clashing = toxicity.scored(odd.withColumn("passages", F.lit("x")), toxicity.Model())
    assert clashing.count() == len(rows()) and set(odd.columns) - {"score"} < set(clashing.columns)


def test_copies_are_one_text(spark):
    """A thousand copies of one toxic text don't make its words foul."""
    base = labelled(spark, 400)
    copies = spark.range(5000, 6000).select(F.col("id").alias("doc_id"), F.lit("peculiar harmless marker text").alias("text"), F.lit(1).alias("toxic"))
    docs = base.unionByName(copies).withColumnRenamed("doc_id", "id")
    model = toxicity.fit(toxicity.teaching(docs.select("id", "text"), docs.select("id", "toxic"), 10_000))
    assert model.of("peculiar") == 0 and model.of("scumbag") > 0


def test_query_on_the_smallest_tables(spark):
    found = queries.op12_toxicity(spark, SF).collect()
    assert len(found) == documents(spark, SF).count() and all(0 <= r.score <= 1 for r in found)
    assert np.isfinite([r.score for r in found]).all()
