"""Structured Streaming entry points.

* ``bounded_panes_stream`` / ``time_lag_panes_stream`` / ``marker_panes_stream`` /
  ``adaptive_panes_stream``: T1 with L3 and L4 under W2, W4, W5 and W1, exact: the
  panes are those of the batch operators for any division into micro-batches.
  Two chained stateful stages (see ``processors``), so that windows may be
  keyed finer than the stream.
* ``running_average_stream``: T8.
* ``tumbling_counts_native`` / ``session_windows_stream``: Spark's own
  ``withWatermark`` event-time windows.  Its watermark is one fixed delay
  behind the max event time and advances only between micro-batches, so
  this is the approximate, built-in counterpart of the bounded watermark.
* ``write_panes_stream``: K1, pane lines by ``foreachBatch``; a repeated batch
  replaces its own output.
* ``run_available_now``: drains a streaming DataFrame into a parquet sink
  under the checkpoint root and returns the sink as a batch DataFrame.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftmark.operators.drift import AdaptiveParams
from driftmark.operators.windows import expand_runs
from driftmark.session import scratch_dir
from driftmark.streaming import processors as P

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ensure_rocksdb(spark: SparkSession) -> None:
    from driftmark.session import ship_package
    ship_package(spark)     # the processors are unpickled in Python workers
    key = "spark.sql.streaming.stateStore.providerClass"
    cur = spark.conf.get(key, None)
    if not cur or "HDFSBackedStateStoreProvider" in cur:
        spark.conf.set(key, ROCKSDB)


def run_available_now(sdf: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    spark = sdf.sparkSession
    out = scratch_dir(spark, f"{name}-out")
    drain(sdf, out, scratch_dir(spark, f"{name}-ckpt"), output_mode)
    return spark.read.schema(sdf.schema).parquet(out)


def drain(sdf: DataFrame, out: str, checkpoint: str, output_mode: str = "append") -> None:
    """Append what is there now to the Parquet folder ``out``."""
    finish(sdf.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(out))


def finish(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


#: Batches without input after which what a stream has not brought is missed.
QUIET_LIMIT = 300


def until_idle(q: StreamingQuery, rows: int, quiet: int = 3) -> None:
    """Stop ``q``, a query with timers, which always has a next batch, once it has
    taken in ``rows`` rows and ``quiet`` batches without input have followed; that
    may take any time.  A query that ends before that, or rows that do not
    come, are an error: what it has put out until then is not its result."""
    taken: dict[int, int] = {}
    try:
        while q.isActive:
            time.sleep(0.25)
            taken |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
            order = sorted(taken, reverse=True)
            idle = next((i for i, b in enumerate(order) if taken[b]), len(order))
            if idle >= quiet and sum(taken.values()) >= rows:
                return
            if idle > QUIET_LIMIT:
                break
    finally:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    raise RuntimeError(f"the stream stopped after {sum(taken.values())} of {rows} rows")


def _panes(sdf: DataFrame, policy: Callable, stream_cols: list[str], key_cols: list[str], width: int, allowed: int,
           ref: str = "arr", idle: bool = False, speed: float = 1.0, period: int | None = None) -> DataFrame:
    """The two stages.  ``sdf`` has the stream and key columns, ``seq``, ``t``, ``arr``
    and, if it holds more than events, ``kind`` (``processors.EVENT`` etc.)."""
    missing = [c for c in stream_cols if c not in key_cols]
    if missing:
        raise ValueError(f"stream columns {missing} must be part of the window key")
    _ensure_rocksdb(sdf.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    finer = [c for c in key_cols if c not in stream_cols]
    kind = F.col("kind").cast("int") if "kind" in sdf.columns else F.lit(P.EVENT)
    # keys travel as text: on the way through pandas a whole number beside a
    # NULL would become a float, and wide ones would fall together
    bucket = F.pmod(F.xxhash64(*finer), F.lit(P.BUCKETS)).cast("int") if finer else F.lit(0)
    text = lambda cols: F.to_json(F.struct(*cols)) if cols else F.lit("")
    x = sdf.select(text(stream_cols).alias("skey"), "seq", "t", "arr", F.col(ref).alias("ref"), kind.alias("kind"),
                   bucket.alias("bucket"), text(finer).alias("wkey"))
    told = x.groupBy("skey").transformWithStateInPandas(
        P.ClockProcessor(policy, width, allowed, idle, speed, None if "kind" in sdf.columns else period),
        "skey string, bucket int, wend long, kind int, ord long, wm long, wkey string, n long", "Append", "ProcessingTime" if idle else "None")
    out = told.groupBy("skey", "bucket", "wend").transformWithStateInPandas(
        P.WindowProcessor(width),
        "skey string, wkey string, wstart long, wend long, cnt long, lag long, flushed boolean, late_fire boolean, n long", "Append", "None")
    back = lambda k, cols: F.from_json(k, ", ".join(f"`{c}` {types[c]}" for c in cols)) if cols else None
    own = {c: back(k, cols)[c].alias(c) for k, cols in (("skey", stream_cols), ("wkey", finer)) for c in cols}
    return expand_runs(out.select(*[own[c] for c in key_cols], "wstart", "wend", "cnt", "lag", "flushed", "late_fire", "n"))


def adaptive_panes_stream(sdf: DataFrame, stream_cols: list[str], key_cols: list[str], width: int, allowed: int = 0,
                          params: AdaptiveParams = AdaptiveParams(), ref: str = "arr") -> DataFrame:
    """W1 + T1 on a live stream."""
    return _panes(sdf, partial(P.AdaptivePolicy, params), stream_cols, key_cols, width, allowed, ref)


def bounded_panes_stream(sdf: DataFrame, stream_cols: list[str], key_cols: list[str], max_ooo: int, period: int,
                         width: int, allowed: int = 0, idle: bool = False, speed: float = 1.0) -> DataFrame:
    """W2 + T1 + L3/L4 on a live stream with exact batch semantics (unlike
    ``withWatermark``, the watermark moves at arrival ticks, not between
    micro-batches).  ``idle``: ticks also fire by the clock while nothing
    arrives; ``speed``: arrival milliseconds that pass in one of the clock
    (1 for a live stream, more for a log that is replayed faster)."""
    return _panes(sdf, partial(P.BoundedPolicy, max_ooo, period), stream_cols, key_cols, width, allowed, idle=idle, speed=speed,
                  period=period)


def time_lag_panes_stream(sdf: DataFrame, stream_cols: list[str], key_cols: list[str], lag: int, period: int,
                          width: int, allowed: int = 0, idle: bool = False, speed: float = 1.0) -> DataFrame:
    """W4 + T1 + L3/L4 on a live stream; ``idle`` and ``speed`` as above."""
    return _panes(sdf, partial(P.TimeLagPolicy, lag, period), stream_cols, key_cols, width, allowed, idle=idle, speed=speed,
                  period=period)


def marker_panes_stream(sdf: DataFrame, key_cols: list[str], width: int, allowed: int = 0, buckets: int = P.BUCKETS) -> DataFrame:
    """W5 + T1 + L3/L4 on a live stream whose rows are events or markers
    (``kind``), in the order of ``arr``.  A marker holds for all keys: it is sent
    to each of ``buckets`` groups of keys, which judge their events by it."""
    group = F.pmod(F.xxhash64(*key_cols), F.lit(buckets)).cast("int")
    to = F.when(F.col("kind") == P.EVENT, F.array(group)).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))
    x = sdf.select("*", F.explode(to).alias("__group"))
    return _panes(x, P.MarkerPolicy, ["__group"], ["__group", *key_cols], width, allowed).drop("__group")


def write_panes_stream(panes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """K1 on a live stream: each micro-batch writes its pane lines to a folder
    of its own, replacing it, so a batch that is repeated after a failure
    changes nothing.  ``read_panes_text`` reads the folder ``path``."""
    from driftmark.sources.text import write_panes
    stream = (panes.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch: write_panes(df, f"{path}/batch={batch}", "text")))
    return (stream.trigger(availableNow=True) if once else stream).start()


def running_average_stream(sdf: DataFrame, key_cols: list[str], value: str = "value",
                           scale: int | None = None) -> DataFrame:
    """T8 on a live stream: one output row per input row."""
    _ensure_rocksdb(sdf.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    v = F.col(value).cast(f"decimal(38,{scale})") if scale is not None else F.col(value).cast("double")
    key = F.to_json(F.struct(*key_cols)) if key_cols else F.lit("")  # as text, like that of the panes
    out = (sdf.select(key.alias("skey"), "seq", "arr", v.alias("value")).groupBy("skey")
              .transformWithStateInPandas(P.RunningAverageProcessor(["skey"], scale),
                                          "skey string, seq long, running_avg double", "Append", "None"))
    own = F.from_json("skey", ", ".join(f"`{c}` {types[c]}" for c in key_cols)) if key_cols else None
    return out.select(*[own[c].alias(c) for c in key_cols], "seq", "running_avg")


def tumbling_counts_native(sdf: DataFrame, key_cols: list[str], width_ms: int,
                           delay_ms: int) -> DataFrame:
    """Spark-native event-time tumbling counts behind ``withWatermark``."""
    ts = F.timestamp_millis(F.col("t"))
    x = sdf.withColumn("__ts", ts).withWatermark("__ts", f"{delay_ms} milliseconds")
    g = x.groupBy(*key_cols, F.window("__ts", f"{width_ms} milliseconds").alias("w")) \
         .agg(F.count(F.lit(1)).alias("cnt"))
    return g.select(*key_cols, F.unix_millis(F.col("w.start")).alias("wstart"),
                    F.unix_millis(F.col("w.end")).alias("wend"), "cnt")


def session_windows_stream(sdf: DataFrame, key_cols: list[str], gap_ms: int,
                           delay_ms: int) -> DataFrame:
    """T7 live: ``session_window`` behind ``withWatermark`` (append mode
    emits a session once the watermark passes its end)."""
    ts = F.timestamp_millis(F.col("t"))
    x = sdf.withColumn("__ts", ts).withWatermark("__ts", f"{delay_ms} milliseconds")
    g = x.groupBy(*key_cols, F.session_window("__ts", f"{gap_ms} milliseconds").alias("s")) \
         .agg(F.count(F.lit(1)).alias("cnt"))
    return g.select(*key_cols, F.unix_millis(F.col("s.start")).alias("sstart"),
                    F.unix_millis(F.col("s.end")).alias("send"), "cnt")
