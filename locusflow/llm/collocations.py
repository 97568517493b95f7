"""Operator 11, phrase collocation mining: phrases counted and named level by level, as pairs of shorter ones.

A phrase of k words is the pair of the two phrases of k - 1 words that overlap in it: its first and
its last k - 1 words. Level by level, each place of a text is read as such a pair; a sieve of the
frequent shorter phrases lets only those places through of which both halves may be frequent (no
phrase is more frequent than its parts), what passes is counted, and frequent pairs are joined with
the names of their halves and get a name themselves. The two names a phrase is made of are its
parents: they give the counts of its cuts, and, read the other way, the longer phrases it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, Scratch, checkpointed, may_hold, sieve, text_or_empty

#: Where pieces end, and white space between words (fixed values).
ENDS = ".,;:!?\n\x0b\x0c\r"


def tokens(text: Column) -> Column:
    """Words of a text in lower case (A-Z alone), a line end for each end of a piece; words hold no line end."""
    flat = F.translate(text, ENDS + "\t" + UPPER, "\n" * len(ENDS) + " " + LOWER)
    return F.split(F.trim(F.replace(flat, F.lit("\n"), F.lit(" \n "))), " +")


def _pairs(docs: DataFrame, k: int) -> DataFrame:
    """(lang, first, last) for each place where k words stand in one piece: its first and its last k - 1 words."""
    at = docs.select("lang", "words", F.posexplode("words").alias("pos", "w0"))
    at = at.filter(~F.col("w0").isin("", "\n"))
    for i in range(1, k):
        at = at.withColumn(f"w{i}", F.get("words", F.col("pos") + i)).filter(F.col(f"w{i}") != "\n")
    of = lambda a, b: F.concat_ws(" ", *[f"w{i}" for i in range(a, b)])
    return at.select("lang", of(0, k - 1).alias("first"), of(1, k).alias("last"))


def levels(docs: DataFrame, scratch: Scratch, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Named phrases of 1 to ``longest`` words, and (lang, n) of all words.

    A phrase has ``id``, ``k`` words, ``a`` occurrences, and the ids ``p`` and ``q`` of its first and
    last k - 1 words with their counts ``pa`` and ``qa`` (null for words). ``docs`` is (lang, words).
    """
    first = docs.select("lang", F.explode("words").alias("phrase")).filter(~F.col("phrase").isin("", "\n"))
    counted = scratch.table(first.groupBy("lang", "phrase").agg(F.count("*").alias("a")), "words")
    sums = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    none = F.lit(None).cast("long")
    below = counted.filter(F.col("a") >= least).select("lang", "phrase", F.monotonically_increasing_id().alias("id"), F.lit(1).alias("k"), "a", *[none.alias(c) for c in ("p", "q", "pa", "qa")])
    below = scratch.table(below, "named-1")
    every = below
    for k in range(2, longest + 1):
        bits = sieve(below.select(F.xxhash64("lang", "phrase")))
        places = _pairs(docs, k).filter(may_hold(bits, F.xxhash64("lang", "first")) & may_hold(bits, F.xxhash64("lang", "last")))
        often = places.groupBy("lang", "first", "last").agg(F.count("*").alias("a")).filter(F.col("a") >= least)
        half = lambda name, id_, n: below.select("lang", F.col("phrase").alias(name), F.col("id").alias(id_), F.col("a").alias(n))  # noqa: B023, E731
        pairs = scratch.table(often, f"pairs-{k}").join(half("first", "p", "pa"), ["lang", "first"]).join(half("last", "q", "qa"), ["lang", "last"])
        phrase = F.concat_ws(" ", "first", F.substring_index("last", " ", -1))
        below = pairs.select("lang", phrase.alias("phrase"), (F.monotonically_increasing_id() + (k << 59)).alias("id"), F.lit(k).alias("k"), "a", "p", "q", "pa", "qa")
        below = scratch.table(below, f"named-{k}")
        every = every.unionByName(below)
    return every, sums


def _cuts(named: DataFrame, longest: int) -> DataFrame:
    """A row for each ``cut`` of each phrase of two words and more, with the counts ``l`` and ``r`` of the two parts.

    Heads are reached by following first parents, tails by following last ones, a word less each step.
    """
    up = named.select(F.col("id").alias("up"), *[F.col(c).alias(f"up_{c}") for c in ("p", "q", "pa", "qa")])

    def ends(side: str, name: str) -> DataFrame:
        at = named.filter("k >= 2").select("id", "k", (F.col("k") - 1).alias("m"), F.col(side).alias("up"), F.col(f"{side}a").alias(name))
        found = at
        for _ in range(2, longest):
            at = at.filter("m > 1").drop(name).join(up, "up").select("id", "k", (F.col("m") - 1).alias("m"), F.col(f"up_{side}").alias("up"), F.col(f"up_{side}a").alias(name))
            found = found.unionByName(at)
        return found

    heads = ends("p", "l").select("id", F.col("m").alias("cut"), "l")
    return heads.join(ends("q", "r").select("id", (F.col("k") - F.col("m")).alias("cut"), "r"), ["id", "cut"])


def score() -> Column:
    """floor(1000000 a a / (l r)) of the columns a, l and r, in decimals of 38 digits."""
    return F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, subsumed: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` (15 at most) words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts all occurrences within pieces, overlaps included, and is at least ``least``; ``l``
    and ``r`` are those of the parts of the cut that scores lowest (ties: the earliest), ``n`` all
    words of the language, ``score`` floor(1000000 a a / (l r)), exact up to counts of 10^15.
    Phrases inside a longer candidate of at least ``subsumed`` percent of their count are left out.

    Null texts have no words; a null language is ``und``. Repeated rows count each. Ties of score
    and count go by the phrase's bytes, so results don't depend on how rows are dealt. Long texts
    are read whole. Empty tables and texts without frequent phrases give no rows. Other columns of
    ``docs``, whatever their names, take no part.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    spelled = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.array_join(tokens(text_or_empty(F.col(text_col))), " ").alias("spelled"))
    spelled = scratch.table(spelled, "spelled")  # each level reads the texts anew; their words are found once
    named, sums = levels(spelled.select("lang", F.split("spelled", " ").alias("words")), scratch, longest, least)

    cuts = _cuts(named, longest).join(named.select("id", "a"), "id").withColumn("score", score())
    best = cuts.groupBy("id").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    # Of the longer phrases around one, those of one word more are the most frequent.
    around = named.filter("k >= 3").select(F.explode(F.array("p", "q")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("within"))
    left = named.filter("k >= 2").join(best, "id").join(around, "id", "left").filter(F.coalesce(F.col("within") * 100 < F.col("a") * subsumed, F.lit(True)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    found = checkpointed(ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    scratch.close()
    return found
