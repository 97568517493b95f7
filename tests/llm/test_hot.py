"""One value that repeats very often, and sets beyond the bound of what is broadcast."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusflow.llm import decontamination, mixing, sharding, simhash
from locusflow.llm.common import documents

from ..conftest import SF

MANY = 100_000


@pytest.fixture(scope="module")
def hot(spark):
    """A source of empty texts, a null id with one text, and some other rows."""
    empty = spark.range(MANY).select("id", F.lit("").alias("text"), F.lit("hot").alias("source"), F.lit("en").alias("lang"))
    same = spark.range(MANY).select(F.lit(None).cast("long").alias("id"), F.lit("the very same words").alias("text"), F.lit("hot").alias("source"), F.lit("en").alias("lang"))
    other = spark.range(3_000).select("id", F.concat_ws(" ", F.lit("w"), "id", F.lit("x y z")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(None).cast("string").alias("lang"))
    return empty.unionByName(same).unionByName(other).withColumnRenamed("id", "doc_id")


def test_mixing(hot):
    found = mixing.mix(hot, shard_words=50_000).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 2 * MANY + 3_000 and all(r.over <= 0 for r in found)
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 2 for r in found)


def test_mixing_with_a_cap_that_is_no_integer(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    found = mixing.mix(docs, cap=1.5, share=1.4).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert sorted(round(r.target) for r in found) == [26_000, 30_000] and all(abs(r.taken - r.target) < 300 for r in found)


def test_mixing_keeps_any_column(spark):
    docs = documents(spark, SF, "doc_id", "source", "text").withColumns({c: F.lit(c) for c in ("a1", "b1", "b2", "_from", "_rows", "_id", "_spread", "n", "quota")})
    out = mixing.mix(docs)
    assert set(docs.columns) < set(out.columns) and out.filter("a1 = 'a1' AND _from = '_from'").count() == docs.count()


def test_sharding_repeated_rows(hot):
    found = sharding.shard(hot, 7, bucket_bytes=1 << 16)
    rows = found.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    n = 2 * MANY + 3_000
    assert len(rows) == 7 and sum(r.n for r in rows) == n and all(r.n == r.slots == r["last"] + 1 and n // 7 <= r.n <= n // 7 + 1 for r in rows)
    count = lambda df: {tuple(r[:4]): r["count"] for r in df.groupBy("doc_id", "text", "source", "lang").count().collect()}
    assert count(found) == count(hot)


def test_sharding_reruns_agree(hot, spark):
    """Rows alike but in one column, and rows alike in all, in other partitions."""
    docs = hot.limit(0).unionByName(hot.filter("doc_id < 100 OR text LIKE '%x y z'")).withColumn("other", F.pmod(F.xxhash64("text", "doc_id"), F.lit(5)))
    docs = docs.unionByName(spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.col("id").alias("other")))
    take = lambda df: sorted(map(repr, sharding.shard(df, 3, bucket_bytes=5_000).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        nine = take(docs.repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert take(docs.coalesce(1)) == nine


def test_a_giant_component(spark):
    """A star, a path and a clique of edges: least nodes, whatever their shape."""
    star = spark.range(1, 20_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    path = spark.range(30_000, 30_200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = {r.root: r.n for r in simhash.components(star.unionByName(path)).groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert found in ({0: 20_000, 30_000: 201}, {0: 19_999, 30_000: 200})


def test_a_large_benchmark(spark):
    """300,000 windows, joined by hash, against what they hold."""
    draw = random.Random(8)
    items = [[f"b{draw.randrange(10**6)}" for _ in range(2_009)] for _ in range(150)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").repartition(4)
    docs, want = [], {}
    for i in range(300):
        words = [f"d{draw.randrange(10**6)}" for _ in range(40)]
        if i % 3 == 0:
            item, at = draw.randrange(150), draw.randrange(1_900)
            words[20:20] = items[item][at : at + 25]
            want[i] = 25
        elif i % 3 == 1:
            words[20:20] = items[0][5:14]  # nine words only
        docs.append((i, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontamination.scan(table, bench).collect()
    assert {r.doc_id: r.n_hit for r in found if r.contaminated} == want and len(found) == 300
    left = {r.doc_id for r in decontamination.remove_documents(table, bench).collect()}
    assert left == set(range(300)) - set(want)
    cut = Counter(len(r.text.split()) for r in decontamination.remove_spans(table, bench).collect())
    assert cut == Counter({40: 200, 49: 100})


def test_long_contaminated_text_is_cut_in_proportion(spark):
    """Four times the words take at most some eight times as long; asking a list for each word took sixteen."""
    import time

    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")

    def seconds(n):
        docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(f"x {item}, y. "), n).alias("text"))
        begin = time.time()
        assert decontamination.remove_spans(docs, bench).first().text == "x y. " * n
        return time.time() - begin

    seconds(500)
    assert seconds(16_000) < 8 * seconds(4_000) + 3
