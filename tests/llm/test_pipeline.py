"""The pipeline's stages, each on what the one before kept, against plain code over all rows."""

import re
from collections import Counter

import corpus_pipeline
from locusflow.llm import quality
from locusflow.llm.common import documents

from ..conftest import SF
from .test_near import slow_kept


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_clean(texts, items, n=10):
    """Ids of the texts that hold no run of ``n`` words of an item, or no shorter item whole."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = {tuple(w[i : i + n]) for w in map(split, items) if w for i in range(max(1, len(w) - n + 1))}
    lengths = {len(w) for w in windows}
    runs = lambda w: {tuple(w[i : i + k]) for k in lengths for i in range(len(w) - k + 1)}
    return {i for i, t in texts.items() if not runs(split(t)) & windows}


def test_stages_by_brute_force(spark, tmp_path):
    docs, held = documents(spark, SF), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        held.append(docs.collect())
    whole = documents(spark, SF).collect()
    scored = {r.doc_id: r.predicted for r in quality.classify(documents(spark, SF), documents(spark, SF, table="labels")).collect()}
    kept = {r.doc_id for r in held[0]}
    assert kept <= set(scored) and sum(scored[i] for i in kept) == sum(scored.values()) > 0.5 * len(whole)
    as_rows = lambda rows: Counter(map(tuple, rows))
    assert as_rows(held[0]) == as_rows([r for r in whole if r.doc_id in kept])

    alone = slow_kept({r.doc_id: r.text for r in held[0]})
    assert as_rows(held[1]) == as_rows([r for r in held[0] if r.doc_id in alone])
    items = [r.text for r in documents(spark, SF, table="benchmark").collect()]
    clean = slow_clean({r.doc_id: r.text for r in held[1]}, items)
    assert as_rows(held[2]) == as_rows([r for r in held[1] if r.doc_id in clean])

    # The mix: parts of documents as they stand there, no document over twice its words, sources near 3 : 1 : 2 up to twice their size.
    texts, sizes, taken = {r.doc_id: r for r in held[2]}, Counter(), Counter()
    for r in held[2]:
        sizes[r.source] += len(words(r.text))
    by_doc = Counter()
    for r in held[3]:
        assert r.text.strip() in texts[r.doc_id].text and tuple(r[c] for c in ("doc_id", "lang", "source")) == tuple(texts[r.doc_id][c] for c in ("doc_id", "lang", "source"))
        by_doc[r.doc_id] += len(words(r.text))
        taken[r.source] += len(words(r.text))
    assert all(n <= 2 * len(words(texts[i].text)) for i, n in by_doc.items())
    weight = dict(zip(sorted(sizes), (3, 1, 2) * len(sizes), strict=False))
    target, left = {}, 1.5 * sum(sizes.values())
    while len(target) < len(sizes):
        level = left / sum(w for s, w in weight.items() if s not in target)
        full = [s for s in sizes if s not in target and level * weight[s] > 2 * sizes[s]]
        for s in full or [s for s in sizes if s not in target]:
            target[s] = 2 * sizes[s] if full else level * weight[s]
            left -= target[s] if full else 0
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 2 for s in sizes)

    assert as_rows(tuple(r[c] for c in held[3][0].asDict()) for r in held[4]) == as_rows(held[3])
    counts = Counter(r.shard for r in held[4])
    assert max(counts.values()) - min(counts.values()) <= 1 and {(r.shard, r.slot) for r in held[4]} == {(s, i) for s, n in counts.items() for i in range(n)}
