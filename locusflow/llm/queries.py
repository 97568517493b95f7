"""The operators' queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, collocations, decontamination, media, mixing, quality, secrets, sharding, simhash, spelling, tokens, toxicity, warc
from .common import checkpoint_dir, checkpointed, documents, text_or_empty, word_count
from .sql import ORACLES


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets; words counted once, then only narrow rows move."""
    sized = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count("text").alias("words"))
    mixed = mixing.mix(checkpointed(sized), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text under every rule; digests of the spans found."""
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text"))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in secrets.RULES if r.base]))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"),
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as an AVI media column, and what reading that back gives."""
    read = media.analyse(media.store(documents(spark, sf_dir, "doc_id", "text")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("clips").alias("n_clips"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fuzzy passage of 50 words and more that documents share, in a row for either document."""
    return chaining.both_sides(chaining.passages(documents(spark, sf_dir, "doc_id", "text")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back, assembled into captures and summed up; the archives are then deleted."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = documents(spark, sf_dir, table="pages")
    warc.write(pages, path)
    found = checkpointed(warc.captures(warc.assemble(warc.read(spark, path)), pages.schema["page_id"].dataType.simpleString()))
    warc.remove(spark, path)
    return found


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, shuffled into 40 shards; the digests come from the shuffled records."""
    dealt = sharding.shard(documents(spark, sf_dir), 40)
    text = text_or_empty("text")
    return dealt.select("doc_id", sharding.record_size("text").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text against every window of the benchmark."""
    return decontamination.scan(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, table="benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labels outside the held-out fold."""
    return quality.classify(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, table="labels"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text counted as the 32k piece model has it; the limit is read off the prefix counts."""
    import public_tokenizers

    counted = tokens.count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "keep_chars")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of 2 to 3 words over the whole texts of all documents."""
    return collocations.collocations(documents(spark, sf_dir, "lang", "text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score over its whole text, learnt from labels outside the held-out fold."""
    found = toxicity.classify(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, table="labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents' whole texts with its near words, form and root."""
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_secrets, op3_media, op4_passages, op5_warc, op6_sharding, op7_simhash, op8_decontamination, op9_quality, op10_tokens, op11_collocations, op12_toxicity, op13_spelling)
}
