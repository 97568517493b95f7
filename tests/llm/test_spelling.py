"""Operator 13 against comparing all words with each other, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from locusflow.llm import spelling
from locusflow.llm.common import Scratch

from .test_edges import DDL, rows


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, least_length=5, least=3):
    counts = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least_length
    n = {w: c for w, c in counts.items() if c >= least}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(around[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= 2 * n[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n)


def found(df, **options):
    return sorted((tuple(r) for r in spelling.variants(df, **options).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("most", [2, 64])
def test_near_words_of_crowded_blocks(spark, most):
    """Words over three letters, so that blocks are crowded on every level."""
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 9))) for _ in range(700)} | {"a" * n for n in (20, 21, 22)} | {"é" * 6, "é" * 7, "éÉéééé"})
    pairs = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark, "test"), most)
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]


@pytest.mark.parametrize("most", [3, 64])
def test_equals_comparing_all(spark, most):
    draw = random.Random(4)
    stems = ["spelling", "variant", "größe", "Straße", "abcde", "lettered"]

    def edited(w):
        i = draw.randrange(len(w))
        return draw.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + draw.choice("abxé") + w[i:], w[:i] + draw.choice("abxé") + w[i + 1 :], w.upper()])

    docs = [(draw.choice([None, i]), " ".join(edited(edited(draw.choice(stems))) + draw.choice(["", "1", "-", "."]) for _ in range(80))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, most=most) == plain(docs)
    assert any(r[1] and r[1] != r[2] for r in plain(docs))  # forms of forms


def test_ties_and_long_chains(spark):
    """Each word twice as frequent as the one before, an edit apart; and two equally frequent near words."""
    docs = [(None, f"{'a' * (6 + i)} " * (3 << i)) for i in range(8)] + [(None, "bbbbbx " * 3 + "bbbbby " * 6 + "bbbbbz " * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df) == plain(docs)
    assert {r[2] for r in found(df) if r[0].startswith("a")} == {"a" * 13}


def test_odd_rows(spark):
    docs = spark.createDataFrame(rows(), DDL)
    assert found(docs) == plain([(r[0], r[1]) for r in rows()])
    assert found(spark.createDataFrame([], DDL)) == [] and found(docs.filter("doc_id < 3")) == []


def test_damage_depends_on_the_row(spark):
    """The checksum of id and run strikes a character out of some."""
    hit = [i for i in range(3000) if zlib.crc32(f"{i}:vowel".encode()) % 97 == 0] + [i for i in range(3000) if zlib.crc32(f"{i}:vowels".encode()) % 97 == 0][:9]
    docs = [(i, "Vowel VOWELS") for i in range(3000)]
    assert hit and found(spark.createDataFrame(docs, "doc_id long, text string")) == plain(docs)
