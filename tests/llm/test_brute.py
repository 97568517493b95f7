"""Operators that SQL can't express, against plain code that does the same the slow way."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusflow.llm import chaining, media, quality, queries, secrets, sharding, simhash, tokens
from locusflow.llm.common import documents

from ..conftest import SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in documents(spark, SF, "doc_id", "text").collect()}


# --- media ---
def test_media_round_trip(spark, texts):
    for r in queries.op3_media(spark, SF).collect():
        data = texts[r.doc_id].encode()
        full = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-64:])
        file = media.write_media([full])[0]
        assert r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest()


def test_media_any_bytes():
    draw = random.Random(3)
    payloads = [bytes(draw.randrange(256) for _ in range(64 * n)) for n in (1, 32, 33, 100)] + [bytes(64), b"\xff" * 128, bytes([0, 255] * 64)]
    back = media.read_media(media.write_media(payloads))
    assert [b"".join(f.tobytes() for f in frames) for frames in back] == payloads


def test_media_decodes_bit_by_bit():
    """A frame decoded by the standard's own procedure, a bit at a time."""
    payload = bytes(random.Random(4).randrange(256) for _ in range(64 * 5))
    (width, quantiser, dc, _), rows = media.jpeg_rows(media.riff_frames(media.write_media([payload])[0])[0])
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(dc[0][length - 1]):
            codes[(length, code)] = dc[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    out = []
    for row in rows:
        bits, at, level = "".join(f"{b:08b}" for b in row), 0, 0
        for _ in range(width):
            n = next(n for n in range(1, 17) if (n, int(bits[at : at + n], 2)) in codes)
            size = codes[(n, int(bits[at : at + n], 2))]
            extra = bits[at + n : at + n + size]
            level += 0 if not size else int(extra, 2) if extra[0] == "1" else int(extra, 2) - (1 << size) + 1
            at += n + size + 1
            out.append(level * quantiser // 8 + 128)
    assert bytes(out) == payload


def test_shots():
    dark, light = np.full((32, 64), 20, np.uint8), np.full((32, 64), 220, np.uint8)
    assert media.shots([dark] * 5 + [light] * 4 + [dark] * 2) == [(0, 5), (5, 9), (9, 11)]
    assert media.shots([dark]) == [(0, 1)]


# --- near duplicates ---
def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash(spark, texts):
    found = queries.op7_simhash(spark, SF).collect()
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    roots = slow_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{f:016x}", least[roots[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("bucket", [1, 3, 2048])
def test_links_of_dense_groups(spark, bucket):
    """Whatever the size at which signatures are split, the same fingerprints are connected."""
    draw, fps = random.Random(9), set()
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 2, bucket)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = slow_components(fps)
    groups = lambda pairs: {frozenset(g) for g in pairs.values() if len(g) > 1}
    mine, theirs = {}, {}
    for (f,) in signed:
        mine.setdefault(got.get(f, f), set()).add(f % (1 << 64))
    for f, r in want.items():
        theirs.setdefault(r, set()).add(f)
    assert groups(mine) == groups(theirs)


# --- passages ---
def test_passages_find_planted_ones(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    passage = [word() for _ in range(80)]
    fuzzy = [w if i % 20 else word() for i, w in enumerate(passage)]
    less = passage[:30]
    docs = {0: passage, 1: fuzzy, 2: passage[10:75], 3: less, 4: passage[:55] + passage[56:], 5: []}
    rows = [(i, " ".join([word() for _ in range(40)] + p + [word() for _ in range(25)])) for i, p in docs.items()]
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} >= {(1, 0), (2, 0), (4, 0)} and not {3, 5} & {i for r in found for i in (r.doc_id, r.ref_doc_id)}
    exact = next(r for r in found if (r.doc_id, r.ref_doc_id) == (2, 0))
    assert (exact.start, exact.end, exact.ref_start, exact.ref_end) == (40, 105, 50, 115)


def test_chains_are_best():
    """The Fenwick tree's scores are those of trying every predecessor."""
    draw = random.Random(6)
    for _ in range(200):
        points = sorted({(draw.randrange(60), draw.randrange(60)) for _ in range(draw.randrange(1, 14))})
        best = []
        for i, (p, r) in enumerate(points):
            before = [best[j] - 0.05 * (p + r - points[j][0] - points[j][1]) for j in range(i) if points[j][0] < p and points[j][1] < r]
            best.append(8 + max([0, *before]))
        got = chaining.chains([p for p, _ in points], [r for _, r in points], 8)
        a, b, c, d, n = got[0]
        assert sum(x[4] for x in got) == len(points)
        assert 8 * n - 0.05 * ((b - 8 - a) + (d - 8 - c)) == pytest.approx(max(best))


def test_alignment_counts_common_words():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    draw = random.Random(7)
    for _ in range(100):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(30))] for _ in range(2))
        assert chaining.common_words(a, b) == slow(a, b)


# --- sharding ---
def test_shards_hold_every_record_once(spark, texts):
    found = queries.op6_sharding(spark, SF).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in found} == {(s, i) for s, n in counts.items() for i in range(n)}
    places = sorted((r.doc_id, r.shard) for r in found)
    assert 0.2 < np.mean([b[1] > a[1] for a, b in zip(places, places[1:], strict=False)]) < 0.8


def test_shuffle_law_does_not_depend_on_buckets(spark):
    docs = documents(spark, SF)
    for size in (2_000, 50_000):
        found = sharding.shard(docs, 7, bucket_bytes=size).collect()
        assert len({(r.shard, r.slot) for r in found}) == len(found) == docs.count()


# --- quality ---
def test_quality_on_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    found = queries.op9_quality(spark, sf).join(documents(spark, sf, table="labels"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r.predicted == r.quality for r in found]) > 0.9


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = documents(spark, SF, "doc_id", "text"), documents(spark, SF, table="labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda known: {r.doc_id: round(r.score, 9) for r in quality.classify(docs, known).collect()}
    assert score(labels) == score(flipped)


def test_isotonic():
    x, n, ones = np.array([0.0, 1, 2, 3, 4]), np.array([1.0, 2, 1, 1, 1]), np.array([0.0, 2, 0, 1, 1])
    knots, levels = quality.isotonic(x, n, ones)
    assert np.allclose(np.interp(x, knots, levels), [0, 2 / 3, 2 / 3, 1, 1])


# --- tokens ---
def test_counts_at_every_prefix(texts):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    counter, lib = tokens.PrefixCounter(model), sentencepiece.SentencePieceProcessor(model_file=model)
    odd = ["", " ", "a ", "x   y", "\n\n a\tb", "日本語 漢字", "<s> </s> <unk>", "▁▁x", "\x00a", "é 😀😀", " " * 40 + "b", "    \n  x", "12 345"]
    for text in [*odd, *(t[:300] for t in list(texts.values())[:40])]:
        _, deltas = counter.deltas(text)
        counts = tokens.prefix_counts(deltas)
        assert counts.tolist() == [len(lib.encode(text[:i])) for i in range(len(text) + 1)]
        for budget in (0, 1, 7, 10_000):
            keep = tokens.truncation(deltas, budget)
            assert keep == max(i for i, c in enumerate(counts) if c <= budget)


def test_token_query(spark, texts):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op10_tokens(spark, SF).collect():
        n = len(lib.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


# --- secrets ---
def test_trigram_queries():
    """Every match of a rule holds what its query asks for; queries are none where nothing is mandatory."""
    assert secrets.trigram_query("[0-9a-f]{32,}") == [] and secrets.trigram_query("a.b.c") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({frozenset({"aki", "kia"})})]
    assert secrets.trigram_query("(abc|xyz)?q") == []
    import re

    for rule, text in zip(secrets.RULES, ["Api_Key: 'abcdefghij'", "AKIAABCDEFGHIJKL", "", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJa.eyJb.c", "-----BEGIN RSA PRIVATE KEY-----"], strict=True):
        for match in re.finditer(rule.pattern, text):
            assert all(any(all(t in match[0].lower() for t in needed) for needed in member) for member in secrets.trigram_query(rule.pattern))
