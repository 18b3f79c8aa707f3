"""Helpers shared by the training-data operators.

Empty-input and NULL rules that hold everywhere unless an operator says
otherwise: a missing text is an empty text, a row whose id is NULL is kept,
and only the columns an operator names are read, so other columns of the
input may have any name.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.session import scratch_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table written within go as soon as it is written:
    nothing reads them again, and else they stay until the driver happens to
    collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table below the shared checkpoint folder and
    return it as read from there: what follows neither recomputes it nor
    depends on the executors that made it."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df`` in a quarter of the shuffle's partitions, though eight a core: a
    task's own cost, a Python worker's call and a file each, is then paid for
    more rows."""
    spark = df.sparkSession
    return df.coalesce(max(8 * spark.sparkContext.defaultParallelism, partitions(spark) // 4))


def ready(spark: SparkSession) -> None:
    """Python workers can import this package from here on."""
    ship_package(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(names: Sequence[str], base: str) -> str:
    """``base``, made longer until no column of ``names`` is called so (in any
    case of letters)."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def attach(docs: DataFrame, found: DataFrame, key: dict[str, Column], cols: list[str]) -> DataFrame:
    """The rows of ``docs`` with the columns ``cols`` of ``found``, which has a
    row for each of them, met by ``key`` (name in ``found``: expression over
    ``docs``; NULL meets NULL).  Columns of ``docs`` that are called like one of
    ``cols``, in any case of letters, give way.

    ``docs`` move once.  Both sides have as many rows as each other, so neither
    is broadcast, however few bytes a small table's files have.  If keys
    repeat, rows with equal ones are paired by an ordinal: both sides are dealt
    out by key together, numbered and met there, where a join by key and
    ordinal would move all of them again."""
    gone = {c.lower() for c in cols}
    kept = [c for c in docs.columns if c.lower() not in gone]
    k, nth, side, met = (free([*kept, *cols], x) for x in ("__key", "__nth", "__side", "__met"))
    left = docs.select(*map(quoted, kept), F.struct(*(v.alias(c) for c, v in key.items())).alias(k))
    right = found.select(F.struct(*list(key)).alias(k), *cols)
    if right.groupBy(k).count().where("count > 1").isEmpty():
        return left.join(right.hint("merge"), k).drop(k)
    void, types = F.lit(None), found.schema
    both = left.select(k, F.lit(0).alias(side), *map(quoted, kept), *(void.cast(types[c].dataType).alias(c) for c in cols)).union(
        right.select(k, F.lit(1).alias(side), *(void.cast(docs.schema[c].dataType).alias(c) for c in kept), *cols))
    pair = Window.partitionBy(k, nth)
    return (both.repartition(k).withColumn(nth, F.row_number().over(Window.partitionBy(k, side).orderBy(F.lit(0))))
            .select(side, *map(quoted, kept), F.max(side).over(pair).alias(met), *(F.max(c).over(pair).alias(c) for c in cols))
            .where((F.col(side) == 0) & (F.col(met) == 1)).drop(side, met))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15  # odd: invertible modulo 2**64


@functools.cache
def letters() -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n.  With sums S of
    ``code * BASE**i``, the bytes i to j - 1 hash to
    ``(S[j] - S[i]) * BASE**-i`` wherever they stand."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def release() -> None:
    """Give memory that a finished task no longer needs back to the system:
    Python workers live on and would hold it beside the executor's heap."""
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def pack_ints(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    return pa.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack_ints(b: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view("<u8").ravel()
