"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import chunks, convrepair, crosstoken, decontam, hamming, langid, mixture, neardup, reshard, suffix, tokenbin, urls, warc
from driftmark.llm.common import table, text_bytes
from driftmark.llm.oracles import ORACLES
from driftmark.session import scratch_dir

#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
OLD_SHARDS, NEW_SHARDS = 7, 8


def op1_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokenbin.token_files(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("word_bpe_49k.json"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of(table(spark, sf_dir, "documents"), 85)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20."""
    return hamming.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 10)


def op6_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 7 shards (by a checksum of the id) to 8 of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(OLD_SHARDS))
    text = F.coalesce("text", F.lit(""))
    return reshard.reshard(docs.select("doc_id", "text"), old, OLD_SHARDS, NEW_SHARDS).select(
        "doc_id", (text_bytes(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicate(table(spark, sf_dir, "documents"))


def op8_cover_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.spans(table(spark, sf_dir, "documents"), 50)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, ["doc_id"]).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return crosstoken.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))[0]


def op12_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return convrepair.repair(convrepair.damage(rows), rows)


QUERIES = {
    "op1_url_aliases": op1_url_aliases,
    "op2_token_files": op2_token_files,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_code_neighbours": op5_code_neighbours,
    "op6_flow_reshard": op6_flow_reshard,
    "op7_gear_chunks": op7_gear_chunks,
    "op8_cover_suffixes": op8_cover_suffixes,
    "op9_language": op9_language,
    "op10_cube_mix": op10_cube_mix,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_warc_pages": op12_warc_pages,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["ORACLES", "QUERIES"]
