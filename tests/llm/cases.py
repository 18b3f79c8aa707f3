"""Awkward inputs that every training-data operator must take."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHES = ["size", "path", "n", "block", "digest", "h", "comp", "tokens", "copies", "part", "row", "nth", "id",
           "code", "label", "shard_", "hub", "answers", "target", "p", "whole", "old", "url", "html", "node",
           "a.b", "Shard", "Slot", "__row", "__c", "__lang", "__score", "__key", "__nth", "__copies", "own", "band"]

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 3),
    (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
    (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
    (None, "no id here but some words to read", "de", "c", None),
    (None, None, None, None, None),
    (6, "one", "de", None, 3),
    (7, "1234 5678 !!!!", "en", "c", 3),
    (8, LONG, "en", "c", 3),
    (9, "été \U0001f600 ÀÉÎ ñandú <|endoftext|> don't x́", "fr", "a", 3),
    (-4, "!" * 5000, "fr", "a", 3),
]


def awkward(spark, clash=True):
    df = spark.createDataFrame(ROWS, DOCS)
    for c in CLASHES if clash else ():
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
