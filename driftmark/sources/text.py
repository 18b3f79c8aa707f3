"""Line-oriented text formats.

Line order is the arrival order of these sources.  ``monotonically_increasing_id``
alone does not give it once a file is split or several files are read, so
``with_line_numbers`` derives a global 1-based line number from
``(file path, split start, id)``: one small row per split carries the split's
line count, an exclusive prefix sum over splits (one row per split, so a
table the size of the driver's own split list) gives each split's offset.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.functions.text import java_round2, java_split, parse_double, parse_long
from driftmark.functions.time import LONG_MAX
from driftmark.functions.util import col_of

# The reference fills a missing reading with N(20, 5) rounded
# to two decimals.
FILL_MEAN = 20.0
FILL_STDDEV = 5.0
DUMMY_KEY = "DUMMY"
MARKER_KEY = "W"
COMMENT_PREFIX = "*"


def with_line_numbers(df: DataFrame) -> DataFrame:
    """``df`` read by ``spark.read.text``; adds ``line`` (1-based, global)."""
    x = df.select("*",
                  F.col("_metadata.file_path").alias("__f"),
                  F.col("_metadata.file_block_start").alias("__b"),
                  F.monotonically_increasing_id().alias("__m"))
    splits = x.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"),
                                         F.min("__m").alias("__m0"))
    # names of one writer sort by their part number, which outgrows its padding
    part = F.regexp_extract("__f", r"part-(\d+)[^/]*$", 1).try_cast("long")
    folder = F.regexp_extract("__f", r"^(.*/)[^/]*$", 1)
    w = (Window.orderBy(folder, F.asc_nulls_first(part), "__f", "__b")
         .rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    out = x.join(splits.drop("__n"), ["__f", "__b"], "inner")
    return (out.withColumn("line", (F.col("__off") + F.col("__m") - F.col("__m0") + 1).cast("long"))
               .drop("__f", "__b", "__m", "__m0", "__off"))


def fill_value(df: DataFrame, value: str = "value", default: float = FILL_MEAN,
               noise: float | None = None, seed: int = 0, id_col: str = "line") -> DataFrame:
    """S3: missing ``value`` := ``default`` or, with ``noise``, a seeded
    normal draw ``N(default, noise)`` rounded like the reference
    (``Math.round(x*100)/100``).  The draw is a function of ``(seed, id)``
    (Box-Muller on two xxhash64 uniforms), so it does not depend on
    partitioning, unlike ``randn``."""
    if noise is None:
        fill = F.lit(float(default))
    else:
        two52 = float(2 ** 52)
        u1 = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(2 ** 52)) + 0.5) / two52
        u2 = (F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.lit(2 ** 52)) + 0.5) / two52
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
        fill = java_round2(F.lit(float(default)) + F.lit(float(noise)) * z)
    return df.withColumn(value, F.coalesce(F.col(value), fill))


def _parse_timed(x: DataFrame, default: float, noise: float | None, seed: int,
                 id_col: str) -> DataFrame:
    f = java_split("value")
    x = x.select(*[c for c in x.columns if c != "value"], f.alias("__f"))
    two = F.size("__f") == 2
    x = x.select(
        *[c for c in x.columns if c != "__f"],
        parse_long(F.col("__f")[0]).alias("ts"),
        F.when(two, parse_double(F.col("__f")[1])).alias("value"),
        two.alias("__two"))
    x = x.withColumn("bad", F.col("ts").isNull() |
                     (F.col("__two") & F.col("value").isNull()))
    return fill_value(x, "value", default, noise, seed, id_col).drop("__two")


def read_timed_values(spark: SparkSession, path: str, default: float = FILL_MEAN,
                      noise: float | None = None, seed: int = 0,
                      streaming: bool = False) -> DataFrame:
    """``ts[,value]`` lines.  Exactly two fields -> (ts, value); any
    other count -> ts from field 0 and a filled value.  A ts that does not
    parse as a long sets ``bad`` (the reference would abort the job).

    Batch output carries the global ``line`` number.  ``streaming=True``
    parses files as they appear (``readStream.text``); a live stream has no
    global line order, so rows carry their ``file`` instead and the seeded
    fill is keyed by ``(file, ts)``."""
    if streaming:
        raw = spark.readStream.text(path).select(
            "value", F.col("_metadata.file_path").alias("file"))
        raw = raw.withColumn("__id", F.xxhash64("file", F.col("value")))
        return _parse_timed(raw, default, noise, seed, "__id").drop("__id")
    raw = with_line_numbers(spark.read.text(path))
    return _parse_timed(raw, default, noise, seed, "line")


def read_marked_events(spark: SparkSession, path: str, default: float = FILL_MEAN,
                       noise: float | None = None, seed: int = 0) -> DataFrame:
    """``ts,key,value`` lines; ``*`` lines are comments; other field
    counts give key ``DUMMY`` and a filled value; key ``W`` marks a
    watermark (``is_marker``).  Output ``line, ts, key, value, is_marker, bad``."""
    raw = with_line_numbers(spark.read.text(path))
    raw = raw.where(~F.col("value").startswith(COMMENT_PREFIX))
    f = java_split("value")
    x = raw.select("line", f.alias("__f"))
    three = F.size("__f") == 3
    x = x.select(
        "line",
        parse_long(F.col("__f")[0]).alias("ts"),
        F.when(three, F.col("__f")[1]).otherwise(F.lit(DUMMY_KEY)).alias("key"),
        F.when(three, parse_double(F.col("__f")[2])).alias("value"),
        three.alias("__three"))
    x = x.withColumn("is_marker", F.col("key") == MARKER_KEY)
    x = x.withColumn("bad", F.col("ts").isNull() | (F.col("__three") & F.col("value").isNull()))
    return fill_value(x, "value", default, noise, seed).drop("__three")


def marked_stream(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split S2 output into (events, markers, rejects), the first two with
    canonical ``seq``/``t``; rejects are the ``bad`` rows as they are."""
    base = marked.where(~F.col("bad")).select(
        F.col("line").alias("seq"), F.col("ts").alias("t"), "key", "value", "is_marker")
    ev = base.where(~F.col("is_marker")).drop("is_marker")
    mk = base.where(F.col("is_marker")).select("seq", "t")
    return ev, mk, marked.where("bad")


def pane_line(wstart="wstart", wend="wend", cnt="cnt", lag="lag") -> Column:
    """K1 text of a pane; a flushed pane carries ``Long.MAX - wend`` as lag,
    the value the end-of-stream watermark would have produced."""
    lag_out = F.coalesce(col_of(lag), F.lit(LONG_MAX) - col_of(wend))
    return F.format_string("(TimeWindow{start=%d, end=%d},%d,%d)",
                           col_of(wstart), col_of(wend), col_of(cnt), lag_out)


def write_panes(panes: DataFrame, path: str, fmt: str = "text",
                partition_col: str | None = None, compression: str | None = None) -> None:
    """K1: overwrite ``path`` with the panes; ``text`` renders the pane
    lines, one folder per ``partition_col`` value (e.g. the run name).  With
    ``partition_col`` only the folders that get panes are replaced.
    ``compression``: codec of the files (``gzip``), the lines stay the same."""
    w = None
    if fmt == "text":
        cols = [pane_line().alias("value")]
        if partition_col:
            cols.append(F.col(partition_col))
        w = panes.select(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if compression:
            w = w.option("compression", compression)
        if partition_col:
            w = w.partitionBy(partition_col)
        w.text(path)
    else:
        w = panes.write.mode("overwrite")
        if partition_col:
            w = w.partitionBy(partition_col)
        w.format(fmt).save(path)


PANE_RE = r"^\(TimeWindow\{start=(-?[0-9]+), end=(-?[0-9]+)\},(-?[0-9]+),(-?[0-9]+)\)$"


def read_panes_text(spark: SparkSession, path: str) -> DataFrame:
    """K2: parse pane lines; ``flushed`` when ``wend + lag`` is Long.MAX.
    The run name is the partition folder (``run=...``) if present, else the
    file name.  Every file under ``path`` is read in one job."""
    raw = spark.read.text(path)
    has_run = "run" in raw.columns
    x = raw.select(
        "value",
        (F.col("run") if has_run else
         F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).alias("run"))
    g = lambda i: F.regexp_extract("value", PANE_RE, i)
    x = x.select("run",
                 g(1).cast("long").alias("wstart"), g(2).cast("long").alias("wend"),
                 g(3).cast("long").alias("cnt"), g(4).cast("long").alias("lag"))
    return x.withColumn("flushed", F.col("lag") == F.lit(LONG_MAX) - F.col("wend"))
