"""Drift-driven (adaptive) watermark, W1 and its parts W1a-W1f.

The watermark is a sequential decision per stream: each event updates an
ADWIN detector fed with ``|ref - t| / allowed_lateness``, and a detection
may (or may not) move the watermark.  Nothing about it is associative, so
the exact operator is one ordered fold per stream:

    repartition(stream) -> sortWithinPartitions(stream, arr, seq) -> mapInArrow

The fold streams Arrow batches through O(log n) state per stream (the
exponential histogram), so a huge stream never has to fit in memory; streams
run in parallel.  Keys and other columns pass through as Arrow, so a NULL or a
64-bit key stays what it is.  ``adaptive_steps`` folds a stream once for many
configurations and returns only detections and emitted watermarks; which
watermark an event met is then looked up in the JVM (``watermark_at_events``).  A single stream is inherently one
sequential task; that is the algorithm, not the plan.

Warm-up skew (W1a) and the deviation ratio (W1b) *are* plain aggregates and
are computed as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.functions.util import join_nullsafe
from driftmark.operators.drift import Adwin, AdaptiveParams, AdaptiveState


# Constructor defaults of the reference estimator.
DEFAULT_THRESHOLD = 1.1
DEFAULT_CHANGE_RATE = 1.0
DEFAULT_MAX_LATENESS = 1000
DEFAULT_WARMUP = 3000
DEFAULT_CLOCK = 32
MIN_SENSITIVITY = 1e-23
#: Groups of configurations that are folded side by side.
SPLIT = 4


def adaptive_preset(name: str, sensitivity: float = 1.0, change_rate: float = 1.0,
                    threshold: float = DEFAULT_THRESHOLD, max_lateness: int = 1000) -> dict:
    """W1f: the four constructor forms of the reference estimator.

    ``default``       clock 1 (the int constructor is picked), allowed 0
    ``sensitivity``   clock 32, allowed starts at 1000
    ``three``         as above with change rate and threshold
    ``four``          allowed reset to 0 because warm-up is on; the lateness
                      argument has no effect (the sweep's path)
    """
    if name == "default":
        return dict(sensitivity=1.0, change_rate=DEFAULT_CHANGE_RATE,
                    threshold=DEFAULT_THRESHOLD, max_lateness=0, clock=1)
    if name == "sensitivity":
        return dict(sensitivity=sensitivity, change_rate=DEFAULT_CHANGE_RATE,
                    threshold=DEFAULT_THRESHOLD, max_lateness=DEFAULT_MAX_LATENESS,
                    clock=DEFAULT_CLOCK)
    if name == "three":
        return dict(sensitivity=sensitivity, change_rate=change_rate, threshold=threshold,
                    max_lateness=DEFAULT_MAX_LATENESS, clock=DEFAULT_CLOCK)
    if name == "four":
        return dict(sensitivity=sensitivity, change_rate=change_rate, threshold=threshold,
                    max_lateness=0, clock=DEFAULT_CLOCK)
    raise ValueError(f"unknown preset {name!r}")


# --- W1a / W1b: aggregates ---------------------------------------------------

def warmup_skew(df: DataFrame, stream_cols: list[str], n: int,
                max_lateness: int = 0, ref: str = "arr") -> DataFrame:
    """Allowed lateness after warm-up = max(start value, max |ref - t|
    over the first ``n`` events of each stream in arrival order)."""
    from driftmark.operators.windows import arrival_ordinal
    x = arrival_ordinal(df, stream_cols).where(F.col("ordinal") <= n)
    return (x.groupBy(*stream_cols)
             .agg(F.greatest(F.lit(max_lateness).cast("long"),
                             F.max(F.abs(F.col(ref) - F.col("t")))).alias("allowed")))


def deviation_ratio(df: DataFrame, stream_cols: list[str], n: int,
                    max_lateness: int = 0, ref: str = "arr") -> DataFrame:
    """``|ref - t| / allowed`` for every post-warm-up event (the value
    the detector is fed while the lateness estimate is not re-adapted).
    A zero allowance yields NULL instead of NaN/Infinity."""
    from driftmark.functions.scan import sized
    from driftmark.operators.windows import arrival_ordinal
    allowed, _ = sized(warmup_skew(df, stream_cols, n, max_lateness, ref))
    x = arrival_ordinal(df, stream_cols).where(F.col("ordinal") > n)
    if stream_cols:
        x = join_nullsafe(x, allowed, stream_cols, "left")
    else:
        x = join_nullsafe(x.withColumn("__g", F.lit(0)), allowed.withColumn("__g", F.lit(0)),
                          ["__g"], "left").drop("__g")
    dev = F.abs(F.col(ref) - F.col("t"))
    return (x.withColumn("deviation", dev)
             .withColumn("ratio", F.try_divide(dev.cast("double"), F.col("allowed"))))


# --- W1: the ordered fold ----------------------------------------------------

FOLD_FIELDS = [
    ("wm_before", T.LongType()), ("wm_after", T.LongType()), ("wm_raw", T.LongType()),
    ("late", T.BooleanType()), ("detected", T.BooleanType()),
    ("cur_sensitivity", T.DoubleType()), ("allowed", T.LongType()), ("adwin_width", T.LongType()),
    ("chunk_span", T.LongType()), ("chunk_elements", T.LongType()),
    ("chunk_late_ratio", T.DoubleType()), ("accepted", T.BooleanType()),
    ("proposed_wm", T.LongType()), ("accepted_width", T.LongType()),
]
PARAM_COLS = ("sensitivity", "change_rate", "threshold")


def _changes(col: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it (NULL equals NULL, NaN
    equals NaN), from the second on."""
    a, b = col.slice(0, len(col) - 1), col.slice(1)
    if pa.types.is_nested(col.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], dtype=bool)
    both_null = pc.and_(a.is_null(), b.is_null())
    same = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(col.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)


def by_stream(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool]]]]:
    """Batches sorted by their first ``keys`` columns, each with its stretches
    ``(from, to, begins)`` of one stream; ``begins``: no batch before had it."""
    last: list[pa.Array] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, dtype=bool)
        for k in range(keys):
            col = b.column(k)
            new[1:] |= _changes(col)
            if last is not None:
                new[0] |= bool(_changes(pa.concat_arrays([last[k], col.slice(0, 1)]))[0])
        new[0] |= last is None
        last = [b.column(k).slice(b.num_rows - 1) for k in range(keys)]
        starts = np.unique(np.append(np.flatnonzero(new), 0)).tolist()
        yield b, [(i, j, bool(new[i])) for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True)]


def _numbers(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def _judged(parts: list) -> list[pa.Array]:
    """The columns of ``FOLD_FIELDS`` from the stretches of a batch."""
    n = sum(len(p.late) for p in parts)
    one = [np.concatenate([getattr(p, f) for p in parts]) for f in
           ("wm_before", "wm_after", "wm_raw", "late", "detected", "sens", "allowed", "width", "accepted_width")]
    chunk: list[list] = [[None] * n for _ in range(5)]
    at = 0
    for p in parts:
        for i, c in p.chunks.items():
            for k, v in enumerate((c[0], c[1], c[2], c[4], c[5])):
                chunk[k][at + i] = v
        at += len(p.late)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
    return [*map(pa.array, one[:8]), *(pa.array(c, k) for c, k in zip(chunk, kinds, strict=True)), pa.array(one[8])]


def _adaptive_fold(keys: int, params: AdaptiveParams, config: int | None, names: list[str]):
    """Columns: stream keys, others to pass, ``t``, ``__ref`` last; ``config``:
    where the parameter columns begin, if they are columns."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = None
        for b, stretches in by_stream(batches, keys):
            t, ref, parts = _numbers(b.column(b.num_columns - 2)), _numbers(b.column(b.num_columns - 1)), []
            for i, j, begins in stretches:
                if begins:
                    p = params
                    if config is not None:
                        p = replace(params, **{c: b.column(config + k)[i].as_py() for k, c in enumerate(PARAM_COLS)})
                    st = AdaptiveState(p)
                parts.append(st.extend(t[i:j], ref[i:j]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *_judged(parts)], names=names)
    return fold


def ordered_by_stream(df: DataFrame, stream_cols: list[str],
                      partitions: int | None = None) -> DataFrame:
    """Exchange by stream and sort each partition by (stream, arrival)."""
    if stream_cols:
        x = (df.repartition(partitions, *stream_cols) if partitions
             else df.repartition(*stream_cols))
    else:
        x = df.repartition(1)   # one stream is one sequential fold
    return x.sortWithinPartitions(*stream_cols, "arr", "seq")


def adaptive_watermark(df: DataFrame, stream_cols: list[str],
                       params: AdaptiveParams = AdaptiveParams(), ref: str = "arr",
                       pass_cols: list[str] | tuple = (), param_cols: bool = False,
                       partitions: int | None = None) -> DataFrame:
    """W1 (+ W1c-W1e): drift-driven watermark per stream.

    Output: stream and pass-through columns, ``seq, t, arr`` and the fold
    columns (``wm_before``, ``wm_after``, ``wm_raw``, ``late`` (vs. the raw
    watermark, as the reference counts it), ``detected``, ``sensitivity``,
    ``allowed``, ``adwin_width`` and, on detections, the chunk report).
    With ``param_cols`` the sensitivity / change rate / threshold come from
    columns of the same names (one sweep configuration per stream key).
    Only the needed columns cross into Python."""
    from driftmark.session import ship_package
    ship_package(df.sparkSession)
    extra = list(PARAM_COLS) if param_cols else []
    cols = list(dict.fromkeys([*stream_cols, *pass_cols, *extra, "seq", "t", "arr"]))
    x = df.select(*cols, F.col("t").alias("__t"), F.coalesce(F.col(ref), F.col("t")).alias("__ref"))
    x = ordered_by_stream(x, stream_cols, partitions)
    schema = T.StructType([*(f for f in x.schema.fields if f.name not in ("__t", "__ref")),
                           *(T.StructField(n, t, True) for n, t in FOLD_FIELDS)])
    config = cols.index(PARAM_COLS[0]) if param_cols else None
    return x.mapInArrow(_adaptive_fold(len(stream_cols), params, config, schema.names), schema)


def adaptive_steps(df: DataFrame, stream_cols: list[str], configs: list[AdaptiveParams],
                   ref: str = "arr") -> DataFrame:
    """W1 for many configurations in one ordered pass: the configurations are
    dealt into ``SPLIT`` groups that run side by side, an event crosses into Python
    once for each, and only detections come back.

    Output: stream columns, ``config`` (position in ``configs``), ``arr, seq`` of
    the event, ``wm`` (the watermark emitted after it), ``rose`` (it is higher than
    before), and the chunk report."""
    from driftmark.session import ship_package
    ship_package(df.sparkSession)
    stream_cols, groups = [*stream_cols, "__group"], min(SPLIT, len(configs))
    keys = len(stream_cols)
    x = df.select("*", F.explode(F.array(*map(F.lit, range(groups)))).alias("__group"))
    x = ordered_by_stream(x.select(*stream_cols, "arr", "seq", "t", F.coalesce(F.col(ref), F.col("t")).alias("__ref")), stream_cols,
                          groups * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = [("config", T.IntegerType()), ("wm", T.LongType()), ("rose", T.BooleanType()), ("chunk_span", T.LongType()),
            ("chunk_elements", T.LongType()), ("chunk_late_ratio", T.DoubleType()), ("cur_sensitivity", T.DoubleType()),
            ("accepted", T.BooleanType()), ("proposed_wm", T.LongType())]
    schema = T.StructType([*x.schema.fields[:keys + 2], *(T.StructField(n, t, True) for n, t in more)])
    names = schema.names
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[tuple[int, AdaptiveState]] = []
        for b, stretches in by_stream(batches, keys):
            t, ref_ = _numbers(b.column(keys + 2)), _numbers(b.column(keys + 3))
            rows, out = [], []
            for i, j, begins in stretches:
                if begins:
                    group = b.column(keys - 1)[i].as_py()
                    states = [(k, AdaptiveState(p)) for k, p in enumerate(configs) if k % groups == group]
                for k, st in states:
                    got = st.extend(t[i:j], ref_[i:j])
                    for at, c in got.chunks.items():
                        rows.append(i + at)
                        out.append((k, int(got.wm_after[at]), bool(got.wm_after[at] > got.wm_before[at]), *c))
            if rows:
                own = pa.RecordBatch.from_arrays(b.columns[:keys + 2], names=names[:keys + 2]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    return x.mapInArrow(fold, schema).drop("__group")


def chunk_report(folded: DataFrame, stream_cols: list[str]) -> DataFrame:
    """One row per detection."""
    return folded.where(F.col("detected")).select(
        *stream_cols, "seq", "arr", "chunk_span", "chunk_elements", "chunk_late_ratio",
        "cur_sensitivity", "accepted", "proposed_wm", "wm_raw", "wm_after")


def adaptive_panes(df: DataFrame, stream_cols: list[str], key_cols: list[str], width,
                   allowed=0, params: AdaptiveParams = AdaptiveParams(), ref: str = "arr") -> DataFrame:
    """W1 -> T1: panes under the adaptive watermark.  The fold returns only the
    watermarks it emits; the events meet them in one scan and are combined
    by window before anything is joined."""
    from driftmark.operators.windows import tumbling_panes_from_groups, window_start
    from driftmark.plans.sweep import watermarks_met
    from driftmark.session import materialize
    x = df.select(*dict.fromkeys([*key_cols, "t", "arr", "seq", ref]))
    steps = materialize(adaptive_steps(x, stream_cols, [params], ref).where("rose")
                        .select(*stream_cols, "config", "arr", "seq", "wm"))
    met, held = watermarks_met(x, steps, stream_cols, "config", 1)
    groups = (met.groupBy(*key_cols, "mark", window_start("t", width).alias("wstart"))
              .agg(F.count(F.lit(1)).alias("n")))
    groups = (join_nullsafe(groups, held, [*stream_cols, "mark"], "left")
              .withColumn("wm_before", F.coalesce(F.element_at("wms", F.lit(0)), F.lit(0)).cast("long"))
              .groupBy(*key_cols, "wstart", "wm_before").agg(F.sum("n").cast("long").alias("n")))
    return tumbling_panes_from_groups(groups, steps.select(*stream_cols, "wm"), stream_cols, key_cols, width, allowed)


# --- D1-D3: ADWIN over a value column ----------------------------------------

DETECT_FIELDS = [
    ("changed", T.BooleanType()), ("width", T.LongType()), ("mean", T.DoubleType()),
    ("variance", T.DoubleType()), ("total", T.DoubleType()), ("detections", T.LongType()),
    ("cum_width", T.DoubleType()), ("peak_buckets", T.LongType()),
]


def _detect_fold(keys: int, delta: float, clock: int, names: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ad, peak = None, 0
        for b, stretches in by_stream(batches, keys):
            xs, parts = _numbers(b.column(b.num_columns - 1)), []
            for i, j, begins in stretches:
                if begins:
                    ad, peak = Adwin(delta, clock), 0
                found, wide = ad.detections, ad.cum_width
                tr = ad.extend(xs[i:j])
                peaks = np.maximum(np.maximum.accumulate(tr.buckets), peak)
                peak = int(peaks[-1])
                width = np.maximum(tr.width, 1)
                parts.append((tr.changed, tr.width, tr.total / width, tr.spread / width, tr.total,
                              found + np.cumsum(tr.changed), wide + np.cumsum(tr.width, dtype="float64"), peaks))
            cols = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=names)
    return fold


def adwin_detect(df: DataFrame, stream_cols: list[str], value: str,
                 delta: float = 0.002, clock: int = 32,
                 pass_cols: list[str] | tuple = ()) -> DataFrame:
    """ADWIN per series (order ``arr, seq``) over ``value``; NULL
    values are skipped (not fed).  ``clock`` = inserts between cut tests."""
    from driftmark.session import ship_package
    ship_package(df.sparkSession)
    cols = list(dict.fromkeys([*stream_cols, *pass_cols, "seq", "arr"]))
    x = df.where(F.col(value).isNotNull()).select(*cols, F.col(value).cast("double").alias("__x"))
    x = ordered_by_stream(x, stream_cols)
    schema = T.StructType([f for f in x.schema.fields if f.name != "__x"] +
                          [T.StructField(n, t, True) for n, t in DETECT_FIELDS])
    return x.mapInArrow(_detect_fold(len(stream_cols), delta, clock, schema.names), schema)
