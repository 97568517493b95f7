"""Operator 13, spelling variant grouping: forward and reversed sorted dictionaries, scanned by shared-prefix and shared-suffix blocks.

Two words, the longer of m characters, that are one edit apart agree before the edit and behind it
on m - 1 characters in all, so on half of them, rounded up, at the front or at the back. Sorted by
their heads the words of a pair stand in one block of the forward dictionary, or else, sorted by
their reversed tails, in one of the reversed. A crowded block is subdivided by the same argument: the part not
yet shared is cut into its two halves, until blocks are small or all but one character is shared.
Blocks are runs of equal keys in sorted order, which a sort-merge join reads; pairs are verified there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, text_or_empty

#: What lies between words once A-Z are in lower case.
BETWEEN = "[^a-zÀ-ÿ]+"

#: Up to so many crowded blocks' keys (some 30 MB) are sent to every task; more are joined by shuffle.
BROADCAST_BLOCKS = 200_000

#: A run is damaged when this divides its checksum.
DAMAGE = 97


def dictionary(docs: DataFrame, least_length: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of runs of letters in lower case (A-Z alone), some of them damaged as their row's id has it; n >= ``least``.

    The unsigned crc32 h of ``<id>:<run>`` (a null id is empty) tells: where 97 divides it, the
    character h % length is struck out.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(lower_ascii(text_or_empty(F.col(text_col))), BETWEEN)).alias("run"))
    runs = runs.filter(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    struck = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGE == 0, struck).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row once with half of what isn't shared yet added to its head, once added to its tail.

    ``m`` is the longer word's length in the pairs sought, ``lo`` and ``hi`` the characters shared at front and back.
    """
    half = F.ceil((F.col("m") - F.col("lo") - F.col("hi") - 1) / 2).cast("int")
    new = F.explode(F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi"))))
    rows = rows.select("word", "length", "m", new.alias("x")).select("word", "length", "m", "x.lo", "x.hi")
    tail = F.reverse(F.substring("word", F.col("length") - F.col("hi") + 1, F.col("hi")))
    return rows.withColumn("shared", F.concat(F.substring("word", F.lit(1), F.col("lo")), tail)).distinct()


def near_words(words: DataFrame, scratch: Scratch, most: int = 64) -> DataFrame:
    """Distinct pairs (a, b), a before b, of ``words.word`` that one inserted, deleted or replaced character tells apart.

    Blocks of over ``most`` words are subdivided for as long as more than one character isn't shared.
    """
    length = F.length("word")
    rows = words.select("word", length.alias("length"), F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    key, parts, i = ["m", "lo", "shared"], [], 0
    while True:
        rows = scratch.table(_halved(rows), f"blocks-{i}")
        # words of m characters or one less: so a block that shares all but one holds one for each letter at most, and one without
        crowded = scratch.table(rows.filter(F.col("m") - F.col("lo") - F.col("hi") > 1).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key), f"crowded-{i}")
        n = crowded.count()
        if not n:
            parts.append(rows)
            break
        crowded = F.broadcast(crowded) if n <= BROADCAST_BLOCKS else crowded
        parts.append(rows.join(crowded, key, "left_anti"))
        rows, i = rows.join(crowded, key, "left_semi"), i + 1
    pairs = None
    for blocks in parts:
        side = lambda name: blocks.select(*key, F.col("word").alias(name), F.col("length").alias(f"{name}_length"))  # noqa: B023, E731
        met = side("a").hint("merge").join(side("b"), key).filter("a < b AND greatest(a_length, b_length) = m AND levenshtein(a, b, 1) = 1").select("a", "b")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far each round. A form is twice as frequent, so rounds are few."""
    at, i = scratch.table(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = scratch.table(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{i + 1}")
        if not step.filter("moved").limit(1).count():
            return step.select("word", "root")
        at, i = step.select("word", "root"), i + 1


def variants(docs: DataFrame, least_length: int = 5, least: int = 3, most: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word of at least ``least_length`` characters and ``least`` occurrences: word, form, root, n, n_near, form_n.

    Two words are near if one edit tells them apart. ``form`` is the near word of largest n (ties:
    the first by code points), if that is twice the word's n or more, else null; ``root`` is the
    last form that is reached from the word (itself without one). See :func:`dictionary` for words.

    Null and empty texts have no words; repeated rows count each; texts and words of any length are
    taken whole. No words give no rows. Columns of ``docs`` besides id and text, whatever their names, take no part.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(dictionary(docs, least_length, least, id_col, text_col), "words")
    pairs = scratch.table(near_words(words, scratch, most), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("x")).select("x.*")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
    formed = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.rank") >= 2 * F.col("n"), -F.col("best.rank")))
    formed = scratch.table(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "form_n"), "formed")
    roots = _roots(formed.filter("form IS NOT NULL"), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
