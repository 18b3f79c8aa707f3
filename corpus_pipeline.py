"""A corpus from ``documents``: language ID, near-dedup, benchmark
decontamination, mixing to target weights, sharding.

Each stage reads what the one before it kept and returns the columns of
``documents``; the last adds ``shard`` and ``slot``.  ``run`` writes every
stage's result below the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftmark.llm import decontam, langid, mixture, neardup, reshard  # noqa: E402
from driftmark.llm.common import cut, free, quoted, table  # noqa: E402

#: A document stays if its language is known with at least this probability.
MIN_SCORE = 0.5
OLD_SHARDS, NEW_SHARDS = 7, 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (so also those whose text is NULL or empty)
    or without a likely language go.  Rows with equal or NULL ids are judged
    each by itself; an empty table, or one without a known language to learn
    from, keeps nothing."""
    lang, score = free(docs.columns, "__lang"), free(docs.columns, "__score")
    seen = langid.identify(docs, docs.columns, out=(lang, score))
    return seen.where((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE)).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least
    id (NULL last; among equal ids any one).  The similarity is 0.8 or more, on
    shingles of five words; texts without words are linked with nothing and
    stay.  An empty table stays empty."""
    return neardup.drop_copies(docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, every row by its own text; a
    NULL or empty text contains none, a NULL item is none.  An empty table or
    benchmark changes nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, by ``source`` (NULL is one, ordered
    last).  A text without words has no size and stays 0 to 2 times like any
    other; rows with equal or NULL ids are drawn each by itself.  An empty
    table stays empty."""
    return mixture.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """From 7 shards (by a checksum of the id; NULL ids in the first) to 8 of
    near equal bytes; a NULL text has none.  Columns called shard or slot, in
    any case of letters, give way to the new ones.  Equal rows are separate
    rows; an empty table stays empty."""
    old = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(OLD_SHARDS))
    return reshard.reshard(docs, old, OLD_SHARDS, NEW_SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SQL cannot train the classifier or sample by the cube method.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
