"""The operators' queries against their SQL on the smallest tables."""

import pytest

from locusflow.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def test_mixing_with_several_shards_a_source(spark, same_rows, tmp_path):
    """Sources of many rows, of many words, of rows that repeat thousands of times, and without words."""
    import duckdb
    from pyspark.sql import functions as F

    of = lambda n, source, id_, words: spark.range(n).select(id_.alias("doc_id"), F.lit(source).alias("source"), F.repeat(F.lit("w "), words).alias("text"))
    i = F.col("id")
    docs = of(9_000, "a", i, (i % 50).cast("int")).unionByName(of(1_000, "b", i + 9_000, F.lit(3))).unionByName(of(700, None, i + 20_000, F.lit(9_000)))
    docs = docs.unionByName(of(6_000, "a", F.lit(7), F.lit(4))).unionByName(of(5_000, "c", F.lit(None).cast("long"), F.lit(2))).unionByName(of(300, "d", i, F.lit(0)))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op1_mixing(spark, f"file://{tmp_path}")
    same_rows(found, con, queries.ORACLES["op1_mixing"])
    by = found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 1 and r.over <= 0 for r in by)
