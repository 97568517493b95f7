"""Operator 11 against plain counting, and odd rows."""

import random
import re
from collections import Counter

import pytest

from locusflow.llm import collocations

from .test_edges import DDL, rows


def plain(docs, longest, least, subsumed, top):
    """The same by counting everything."""
    counts, sums = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sums[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, phrase), a in found.items():
        score, k = min((1_000_000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase)))
        inside = lambda longer: any(longer[i : i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))  # noqa: B023, E731
        if not any(other == lang and len(longer) > len(phrase) and 100 * n >= subsumed * a and inside(longer) for (other, longer), n in found.items()):
            out.append((lang, " ".join(phrase), a, counts[lang, phrase[:k]], counts[lang, phrase[k:]], sums[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def found(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 3, 2000), (5, 2, 7), (2, 1, 5)])
def test_equals_plain_counting(spark, longest, least, top):
    draw = random.Random(longest)
    words = ["the", "The", "of", "new", "york", "é", "É", "x-y", "z's", "\x00", "𝔘", "a"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \r\n "]) for _ in range(draw.randrange(60)))
    docs = [(draw.choice(["en", "de", None]), text()) for _ in range(60)] + [("en", None), (None, ""), ("fr", "only once here")]
    docs += [("en", "New York is of the new york")] * 5
    df = spark.createDataFrame(docs, "lang string, text string")
    assert found(df, longest=longest, least=least, top=top) == plain(docs, longest, least, 50, top)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    row = spark.createDataFrame([(10**12, 10**13 + 7, 3 * 10**12)], "a long, l long, r long")
    score = row.select(collocations.score()).first()[0]
    assert score == 1_000_000 * 10**24 // ((10**13 + 7) * 3 * 10**12)


def test_odd_rows(spark):
    docs = spark.createDataFrame(rows(), DDL)
    assert found(docs, least=2) == plain([(r[2], r[1]) for r in rows()], 3, 2, 50, 2000)
    assert found(spark.createDataFrame([], DDL)) == [] and found(docs.filter("doc_id < 3")) == []


def test_one_phrase_everywhere(spark):
    docs = spark.range(30_000).selectExpr("'en' AS lang", "'very common words ' || id AS text")
    assert found(docs) == [("en", 1, "very common words", 30_000, 30_000, 30_000, 120_000, 1_000_000)]
