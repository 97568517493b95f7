"""Near copies in the pipeline against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import drop_near_duplicates
from locusflow.llm import simhash
from locusflow.llm.common import Scratch, documents

from ..conftest import SF


def slow_kept(texts: dict[int, str]) -> set[int]:
    """Least ids of the parts that pairs of 5-word Jaccard >= 0.8 connect."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            A, B = sets[a], sets[b]
            if A == B or len(A & B) >= 0.8 * len(A | B):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {root(i) for i in ids}


def test_near_copies_go(spark):
    """Chains of copies edited a word at a time, a dense group, and near misses."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    texts, i = {}, 0
    for _ in range(40):
        words = [word() for _ in range(draw.randrange(60, 200))]
        for _ in range(draw.randrange(1, 6)):
            texts[i], i = " ".join(words), i + 1
            for at in draw.sample(range(len(words)), draw.randrange(1, 5)):
                words[at] = word()
    base = [word() for _ in range(120)]
    for _ in range(60):
        texts[i], i = " ".join(w if draw.random() > 0.012 else word() for w in base), i + 1
    texts |= {i: "", i + 1: None, i + 2: "few words", i + 3: "few WORDS"}
    rows = [(k, "s", t) for k, t in texts.items()]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == slow_kept(texts)


def test_near_copies_of_documents(spark):
    docs = documents(spark, SF)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = [r.doc_id for r in drop_near_duplicates(spark, docs, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == slow_kept(texts)


def dense_nodes(spark):
    """Nodes of a group so dense that its keys are crowded, of strangers and of one text twice; (nodes, texts by node)."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base = [word() for _ in range(150)]
    texts = [" ".join(w if draw.random() > 0.025 else word() for w in base) for _ in range(90)]
    texts += [" ".join(word() for _ in range(80)) for _ in range(20)]
    texts = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "id long, text string").withColumn("content", F.xxhash64("text"))
    marked = simhash.sketched(texts)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("best")
    longs = [f"b{i}" for i in range(simhash.LONGS)]
    nodes = marked.groupBy("node").agg(best, F.first("words").alias("words"), *[F.first(b).alias(b) for b in longs]).cache()
    held = {r.node: (tuple(r[b] & (2**64 - 1) for b in longs), r.best.id) for r in nodes.collect()}
    said = {r.id: r.text for r in texts.collect()}
    return nodes, texts, {n: (bits, said[i]) for n, (bits, i) in held.items()}


def slow_candidates(held) -> set[tuple[int, int]]:
    """All pairs of nodes with a segment that differs in one bit at most, near in the last long and in all."""
    found, nodes = set(), sorted(held)
    per, mask = 64 // simhash.WIDTH, (1 << simhash.WIDTH) - 1
    for n, u in enumerate(nodes):
        for v in nodes[n + 1 :]:
            differ = [a ^ b for a, b in zip(held[u][0], held[v][0], strict=True)]
            cuts = [differ[i // per] >> simhash.WIDTH * (i % per) & mask for i in range(simhash.SEGMENTS)]
            if min(c.bit_count() for c in cuts) <= 1 and differ[-1].bit_count() <= simhash.NEAR_BITS and sum(d.bit_count() for d in differ) <= simhash.MOST_BITS:
                found.add((u, v))
    return found


@pytest.mark.parametrize("part_rows", [7, 4096])
def test_crowded_keys_give_all_pairs(spark, part_rows):
    """All near pairs of different roots and no other, in however many parts the nodes of a key meet."""
    nodes, _, held = dense_nodes(spark)
    roots = {n: min(held) if i % 3 == 0 else n for i, n in enumerate(sorted(held))}
    rows = nodes.join(spark.createDataFrame(list(roots.items()), "node long, root long"), "node")
    wanted = {(u, v) for u, v in slow_candidates(held) if roots[u] != roots[v]}
    got = [tuple(r) for r in simhash.crowded(rows, part_rows).collect()]
    assert len(wanted) > 500 and len(got) == len(set(got)) and set(got) == wanted
    one = rows.withColumn("root", F.lit(1).cast("long"))
    assert simhash.crowded(one, part_rows).count() == 0 == simhash.crowded(rows.limit(0), part_rows).count()


@pytest.mark.parametrize("few", [1, 8])
def test_links_are_those_of_all_candidates(spark, few):
    """What is connected doesn't depend on how many nodes of a key are compared at once."""
    nodes, texts, held = dense_nodes(spark)
    sets = {n: simhash.shingles(text) for n, (_, text) in held.items()}
    parent = {n: n for n in held}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in slow_candidates(held):
        if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]):
            x, y = root(u), root(v)
            parent[max(x, y)] = min(x, y)
    scratch = Scratch(spark, "near-test")
    edges = simhash.similar(nodes, texts.select("content", "text"), scratch, few=few, part_rows=16)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {n: got.get(n, n) for n in held} == {n: root(n) for n in held}
    assert 10 < len({root(n) for n in held}) < len(held) - 10
    scratch.close()


@pytest.mark.parametrize("part_rows", [20, 4096])
def test_groups_give_connecting_pairs_alone(spark, part_rows):
    """In however many parts a dense group meets, what is written connects it as all pairs do, and isn't all pairs."""
    nodes, texts, held = dense_nodes(spark)
    sets = {n: simhash.shingles(text) for n, (_, text) in held.items()}
    ids, parent, near = sorted(held), {n: n for n in held}, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, u in enumerate(ids):
        for v in ids[n + 1 :]:
            if sum((a ^ b).bit_count() for a, b in zip(held[u][0], held[v][0], strict=True)) <= simhash.MOST_BITS and len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]):
                near += 1
                x, y = root(u), root(v)
                parent[max(x, y)] = min(x, y)
    hubs = spark.createDataFrame([(ids[0], n) for n in ids[1:]], "hub long, node long")
    scratch = Scratch(spark, "groups-test")
    edges = simhash.across_groups(hubs, spark.createDataFrame([], "node long, root long"), nodes, texts.select("content", "text"), scratch, 0.8, part_rows)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    parts = -(-len(ids) // part_rows)
    assert {n: got.get(n, n) for n in ids} == {n: root(n) for n in ids}
    assert edges.count() <= min(near, len(ids) * parts)
    scratch.close()


def test_rows_of_a_dense_group_are_few(spark):
    """Texts that share keys by the dozen without being alike: no step writes, or joins, rows as their pairs."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base = [word() for _ in range(150)]
    said = [" ".join(w if draw.random() > 0.04 else word() for w in base) for _ in range(300)]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string").withColumn("content", F.xxhash64("text"))
    best = F.struct(F.lit(False).alias("none"), "id", "content").alias("best")
    nodes = simhash.sketched(texts).withColumn("best", best).cache()
    written = {}

    class Counted(Scratch):
        def table(self, df, name):
            held = super().table(df, name)
            written[name] = held.count()
            return held

    scratch = Counted(spark, "dense-test")
    edges = simhash.similar(nodes, texts.select("content", "text"), scratch)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    sets = {r.node: simhash.shingles(said[r.id]) for r in nodes.collect()}
    parent = {n: n for n in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, u in enumerate(ids := sorted(sets)):
        for v in ids[n + 1 :]:
            if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]):
                x, y = root(u), root(v)
                parent[max(x, y)] = min(x, y)
    assert {n: got.get(n, n) for n in ids} == {n: root(n) for n in ids} and 10 < len(got) < len(ids)
    assert max(written.values()) <= 10 * len(ids), written
    scratch.close()
