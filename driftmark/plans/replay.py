"""Tables replayed as live streams, for the registered queries and the tests.

The rows are staged once, by arrival slice, in one job.  Slices are then
handed to the running operator one after the other: each becomes one
micro-batch, whatever number of files it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.session import scratch_dir


#: Rows that a micro-batch holds, about; larger tables come in more slices.
BATCH_ROWS = 2_000_000


def enough(df: DataFrame, slices: int) -> int:
    """``slices`` or, for a large table, as many as keep a slice near ``BATCH_ROWS``."""
    return max(slices, -(-df.count() // BATCH_ROWS))


def staged(df: DataFrame, slices: int) -> DataFrame:
    """``df`` written by ``__slice`` (equal spans of ``arr``; rows without an
    arrival time come with the first)."""
    spark = df.sparkSession
    lo, hi = df.agg(F.min("arr"), F.max("arr")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    span = max(1, (hi - lo) // slices + 1)
    path = scratch_dir(spark, "staged")
    (df.withColumn("__slice", F.coalesce(F.floor((F.col("arr") - F.lit(lo)) / F.lit(span)), F.lit(0)).cast("int"))
       .repartition("__slice", F.pmod(F.hash("arr"), F.lit(8))).write.partitionBy("__slice").parquet(path))
    return spark.read.schema(_with_slice(df)).parquet(path)


def _with_slice(df: DataFrame):
    from pyspark.sql.types import IntegerType, StructField, StructType
    return StructType([*df.schema.fields, StructField("__slice", IntegerType())])


def feed(df: DataFrame, slices: int, run: Callable[[DataFrame], None]) -> None:
    """``run`` with a streaming DataFrame over the rows so far, after each slice
    has been added; ``run`` keeps its checkpoint, so it sees each slice once."""
    spark = df.sparkSession
    rows, folder = staged(df, slices), scratch_dir(spark, "feed")
    for i in range(slices):
        rows.where(F.col("__slice") == i).drop("__slice").write.mode("append").parquet(folder)
        run(spark.readStream.schema(df.schema).parquet(folder))


def replayed(df: DataFrame, name: str, live: Callable[[DataFrame], DataFrame], slices: int = 4,
             exactly: bool = False) -> DataFrame:
    """What ``live`` appends while ``df`` comes in slices (``exactly`` so many, or
    more if it is large), as a batch DataFrame."""
    from driftmark.streaming.live import drain
    spark, made = df.sparkSession, []
    out, ckpt = scratch_dir(spark, f"{name}-out"), scratch_dir(spark, f"{name}-ckpt")

    def run(sdf: DataFrame) -> None:
        got = live(sdf)
        made.append(got.schema)
        drain(got, out, ckpt)

    feed(df, slices if exactly else enough(df, slices), run)
    return spark.read.schema(made[0]).parquet(out)
