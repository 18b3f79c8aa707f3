"""Parameter sweep (P1-P3): many runs in one Spark job.

Each configuration becomes a key (``cfg``, its position in the grid, which is a
small, fixed-size parameter), and every downstream operator keys on it in
addition to the stream key, so all runs execute in parallel in the same
stages.  Events are combined before they are fanned out to the runs; a run's
parameters are looked up where an operator needs them (``config_param``).
"""

from __future__ import annotations

import functools
import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.functions.scan import Scan, blocked_scan, sized
from driftmark.functions.util import join_nullsafe

# The reference's experiment grid.
ADAPTIVE_SENSITIVITIES = [1.0]
ADAPTIVE_CHANGE_RATES = [1.0, 0.1, 0.01]
ADAPTIVE_THRESHOLDS = [1.1, 0.1, 0.01]
WINDOW_WIDTHS = [100, 1000]
PERIODS = [200, 10]
MAX_OOO = [100, 1000]
ADAPTIVE_LATENESS = 1000
SUGGESTED_WAIT_MS = 92672393

PERIODIC_KEYS = ["run", "period", "max_ooo", "width", "allowed"]
ADAPTIVE_KEYS = ["run", "sensitivity", "change_rate", "threshold", "width"]


def _num(x) -> str:
    """Java ``String.valueOf`` for the grid's doubles and longs."""
    return repr(float(x)) if isinstance(x, float) else str(x)


def periodic_run_name(dataset: str, max_ooo: int, period: int, width: int) -> str:
    return f"{dataset}PeriodicL-{max_ooo}P-{period}W-{width}.txt"


def adaptive_run_name(dataset: str, lateness: int, threshold: float, sensitivity: float,
                      change_rate: float, width: int) -> str:
    return (f"{dataset}AdaptiveL-{lateness}OOO-{_num(threshold)}S-{_num(sensitivity)}"
            f"SCR-{_num(change_rate)}W-{width}.txt")


def periodic_grid(dataset: str = "events") -> list[dict]:
    """8 runs: period x bound x width, allowed lateness fixed."""
    return [dict(run=periodic_run_name(dataset, l, p, w), period=p, max_ooo=l,
                 width=w, allowed=SUGGESTED_WAIT_MS)
            for p, l, w in product(PERIODS, MAX_OOO, WINDOW_WIDTHS)]


def adaptive_grid(dataset: str = "events") -> list[dict]:
    """18 runs: change rate x threshold x width x sensitivity."""
    return [dict(run=adaptive_run_name(dataset, ADAPTIVE_LATENESS, t, s, r, w),
                 sensitivity=s, change_rate=r, threshold=t, width=w)
            for r, t, w, s in product(ADAPTIVE_CHANGE_RATES, ADAPTIVE_THRESHOLDS,
                                      WINDOW_WIDTHS, ADAPTIVE_SENSITIVITIES)]


def replicate_ids(events: DataFrame, n: int, name: str = "cfg") -> DataFrame:
    """Every event once per configuration id ``0 .. n-1``."""
    return events.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def config_param(configs: list[dict], field: str, id_col: str = "cfg") -> Column:
    """Value of ``field`` for the row's configuration id, from a literal map:
    runs are keyed by one small integer, parameters are looked up where an
    operator needs them (narrow sort and hash keys)."""
    from driftmark.functions.util import col_of
    pairs = []
    for i, c in enumerate(configs):
        v = c[field]
        pairs += [F.lit(i), F.lit(v) if isinstance(v, str) else col_of(v)]
    return F.element_at(F.create_map(*pairs), F.col(id_col))


def with_config(df: DataFrame, configs: list[dict], fields: list[str],
                id_col: str = "cfg") -> DataFrame:
    return df.select(*[config_param(configs, f, id_col).alias(f) for f in fields], "*")


def sweep_periodic_panes(events: DataFrame, configs: list[dict], stream_cols: list[str],
                         key_cols: list[str], runs: bool = False) -> DataFrame:
    """P1, periodic half: bounded watermark -> tumbling panes per run,
    keyed by the configuration id ``cfg``.

    One scan says for every period what each event has met
    (``maxima_met``); a run's watermark is that less its bound, and the
    watermarks that a run emits are those its events have met."""
    from driftmark.operators.watermarks import maxima_met
    from driftmark.session import materialize
    periods = list(dict.fromkeys(c["period"] for c in configs))
    met = materialize(maxima_met(events, stream_cols, key_cols, periods, math.gcd(*[c["width"] for c in configs])))
    values = [F.coalesce(f"max{i}", F.lit(0)) for i in range(len(periods))]
    steps = (met.select(*stream_cols, F.posexplode(F.array(*values)).alias("source", "value"))
             .where("value > 0").distinct())
    # events without an arrival time come before every tick: what they bring is
    # met by all others, but no timer has emitted it
    first = events.where("arr is null").groupBy(*stream_cols).agg(F.max("t").alias("__first"))
    if stream_cols:
        steps = join_nullsafe(steps, first, stream_cols, "left")
    else:
        steps = steps.crossJoin(first)
    steps = steps.where(F.col("__first").isNull() | (F.col("value") > F.col("__first"))).drop("__first")
    source, shift = [periods.index(c["period"]) for c in configs], [c["max_ooo"] for c in configs]
    return run_panes(met, values, steps, configs, source, shift, stream_cols, key_cols, runs)


#: Columns by which runs of panes are partitioned: a window's are in one place.
PLACE = ("__h", "__k")


def _first_ends(met: DataFrame, steps: DataFrame, pairs: list[tuple[int, int]], stream_cols: list[str],
                slot: int, span: int) -> DataFrame:
    """What fires the windows that end in a span: ``(place, near, next)``.

    ``near``: the watermarks whose first window end is there, as ``(pair, wm)``, the
    least for each end; ``next``: for each of ``pairs`` the first one beyond."""
    from driftmark.functions.time import floor_div
    of = F.array(*[F.array(*[F.lit(i) for i, (s, _) in enumerate(pairs) if s == k]) for k in range(max(s for s, _ in pairs) + 1)])
    less = F.array(*[F.lit(b).cast("long") for _, b in pairs])
    end = floor_div(F.col("wm") + 1, F.lit(slot).cast("long")) * slot
    wms = (steps.select(*stream_cols, "value", F.explode(F.get(of, F.col("source"))).alias("pair"))
           .select(*stream_cols, "pair", (F.col("value") - F.get(less, F.col("pair"))).alias("wm")).where("wm > 0")
           .groupBy(*stream_cols, "pair", floor_div(end - 1, F.lit(span).cast("long")).alias("__b"), end.alias("end"))
           .agg(F.min("wm").alias("wm")))
    firsts = [F.min(F.when(F.col("pair") == i, F.col("wm"))).alias(f"first{i}") for i in range(len(pairs))]
    wms = wms.groupBy(*stream_cols, "__b").agg(F.collect_list(F.struct("pair", "wm")).alias("near"), *firsts)
    spans = met.select(*stream_cols, floor_div(F.col("t"), F.lit(span).cast("long")).alias("__b")).distinct()
    both = spans.unionByName(wms, allowMissingColumns=True).groupBy(*stream_cols, "__b").agg(
        F.first("near", True).alias("near"), *[F.max(f"first{i}").alias(f"first{i}") for i in range(len(pairs))])
    both = blocked_scan(both, stream_cols, None, ["__b"], [Scan(f"next{i}", f"first{i}", "min", backward=True, inclusive=False)
                                                            for i in range(len(pairs))])
    k = F.struct(*stream_cols, "__b")
    return both.select(F.xxhash64(k).alias("__h"), k.alias("__k"), "near", F.array(*[f"next{i}" for i in range(len(pairs))]).alias("next"))


def run_panes(met: DataFrame, values: list[Column], steps: DataFrame, configs: list[dict], source: list[int],
              shift: list[int], stream_cols: list[str], key_cols: list[str], runs: bool,
              ids: list[int] | None = None) -> DataFrame:
    """Panes of every run, keyed by ``cfg`` (with ``runs`` as runs, with the columns
    ``PLACE``), from ``met`` (``key, t, n``: events, their number, and what ``values`` are
    computed from).  The watermark that events have met in a run is the value of its
    ``source`` less its ``shift``, and at least 0; ``steps`` has all values
    ``(stream, source, value)``.

    The rows move once, before they are fanned out: to the span of their
    stream that holds whole windows of every width.  All runs find their
    windows there, and the watermarks that fire them."""
    from driftmark.functions.time import floor_div, window_start
    from driftmark.operators.lateness import LATE_KEPT, ON_TIME, window_class
    from driftmark.operators.windows import PANE_COLS, expand_runs
    ids = list(range(len(configs))) if ids is None else ids
    widths = list(dict.fromkeys(configs[i]["width"] for i in ids))
    span = math.lcm(*widths)
    if span > 16 * max(widths):  # no common span: the runs of each width by themselves
        parts = [run_panes(met, values, steps, configs, source, shift, stream_cols, key_cols, runs,
                           [i for i in ids if configs[i]["width"] == w]) for w in widths]
        return functools.reduce(DataFrame.unionByName, parts)
    pairs = list(dict.fromkeys((source[i], shift[i]) for i in ids))
    fires = _first_ends(met, steps, pairs, stream_cols, math.gcd(*widths), span)

    # runs of one source and width see a window's events in the same order
    grains = list(dict.fromkeys((source[i], configs[i]["width"]) for i in ids))
    pick = lambda vs: F.get(F.array(*[F.lit(v).cast("long") for v in vs]), F.col("__g"))
    x = (met.withColumn("__k", F.struct(*stream_cols, floor_div(F.col("t"), F.lit(span).cast("long")).alias("__b")))
         .withColumn("__h", F.xxhash64("__k")).repartition(*PLACE))
    x = replicate_ids(x.select(*PLACE, *key_cols, "t", "n", F.array(*values).alias("__v")), len(grains), "__g")
    x = x.select(*PLACE, "__g", *key_cols, window_start("t", pick([w for _, w in grains])).alias("wstart"),
                 F.get("__v", pick([s for s, _ in grains]).cast("int")).alias("__m"), "n")
    w = Window.partitionBy(*PLACE, "__g", *key_cols, "wstart").orderBy("__m")
    x = x.select("*", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("__before"),
                 F.lead("__m").over(w).alias("__then"))
    of = F.array(*[F.array(*[F.lit(i) for i in ids if (source[i], configs[i]["width"]) == g]) for g in grains])
    x = x.select("*", F.explode(F.get(of, F.col("__g"))).alias("cfg"))
    by_run = lambda vs: F.get(F.array(*[F.lit(v).cast("long") for v in vs]), F.col("cfg"))
    wm = lambda c: F.greatest(F.col(c) - by_run(shift), F.lit(0))
    x = x.select("*", (F.col("wstart") + by_run([c["width"] for c in configs])).alias("wend"),
                 wm("__m").alias("__wm"), F.when(F.col("__then").isNotNull(), wm("__then")).alias("__next"))
    # in the order of watermarks a window's on-time events come first: the last
    # of them know how many there are; each kept late one re-fires
    allowed = by_run([c.get("allowed", 0) for c in configs])
    cls, then = window_class("wend", "__wm", allowed), window_class("wend", "__next", allowed)
    late = F.col("__late")
    x = (x.withColumn("__late", cls == LATE_KEPT)
          .where(late | ((cls == ON_TIME) & (F.col("__next").isNull() | (then != ON_TIME)))))
    x = x.join(fires, list(PLACE), "left")
    pair = by_run([pairs.index((s, b)) if (s, b) in pairs else 0 for s, b in zip(source, shift, strict=True)]).cast("int")
    near = F.array_min(F.transform(F.filter("near", lambda e: (e["pair"] == pair) & (e["wm"] >= F.col("wend") - 1)), lambda e: e["wm"]))
    out = x.select(
        *PLACE, "cfg", *key_cols, "wstart", "wend", (F.col("__before") + F.when(late, 1).otherwise(F.col("n"))).cast("long").alias("cnt"),
        (F.when(late, F.col("__wm")).otherwise(F.coalesce(near, F.get("next", pair))) - F.col("wend")).alias("lag"),
        "__late", F.when(late, F.col("n")).otherwise(1).cast("long").alias("n"))
    out = out.select(*PLACE, "cfg", *key_cols, "wstart", "wend", "cnt", "lag", (~late & F.col("lag").isNull()).alias("flushed"),
                     late.alias("late_fire"), "n")
    return out if runs else expand_runs(out.drop(*PLACE)).select("cfg", *key_cols, *PANE_COLS)


def sweep_periodic(events: DataFrame, configs: list[dict], stream_cols: list[str],
                   key_cols: list[str]) -> DataFrame:
    """Panes of every periodic run with the run's parameters as columns."""
    panes = sweep_periodic_panes(events, configs, stream_cols, key_cols)
    return with_config(panes, configs, PERIODIC_KEYS).drop("cfg")


MANIFEST = "_runs"  # below the pane folders; readers of panes pass over it


def finish_runs(panes: DataFrame, configs: list[dict], path: str) -> None:
    """Write the panes of ``configs`` (column ``run``) as text below ``path`` and then
    record each of these runs as finished, those without panes too."""
    from driftmark.sources.text import write_panes
    spark = panes.sparkSession
    write_panes(panes, path, "text", "run", "gzip")
    runs = spark.createDataFrame([(c["run"],) for c in configs], "run string")
    lines = spark.read.text(path)
    n = (lines.groupBy("run").agg(F.count(F.lit(1)).alias("panes")) if "run" in lines.columns
         else runs.where("false").select("run", F.lit(0).cast("long").alias("panes")))
    (runs.join(n, "run", "left").select("run", F.coalesce("panes", F.lit(0)).alias("panes"))
     .coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}"))


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """``(run, panes)`` of the runs recorded below ``path``; no pane is read."""
    from pyspark.errors import AnalysisException
    try:
        done = spark.read.schema("run string, panes long").parquet(f"{path}/{MANIFEST}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run string, panes long")
    return done.groupBy("run").agg(F.max("panes").alias("panes"))


def pending_configs(spark: SparkSession, configs: list[dict], done_path: str | None) -> list[dict]:
    """The runs that are not finished, by a left-anti join of the grid
    against the manifest.  Only the grid itself (bounded by its literal size)
    comes back to the driver."""
    if not done_path:
        return list(configs)
    grid = spark.createDataFrame([(c["run"],) for c in configs], "run string")
    left = {r.run for r in grid.join(finished_runs(spark, done_path), "run", "left_anti").collect()}
    return [c for c in configs if c["run"] in left]


RUN_NAME_RE = (r"^(.*?)(Adaptive|Periodic)L-(-?[0-9]+)"
               r"(?:OOO-([0-9.Ee-]+)S-([0-9.Ee-]+)SCR-([0-9.Ee-]+))?"
               r"(?:P-([0-9]+))?W-([0-9]+)\.txt$")


def parse_run_name(name) -> list[Column]:
    """Columns parsed from a run name (dataset, approach, lateness,
    threshold, sensitivity, change_rate, period, width)."""
    c = F.col(name) if isinstance(name, str) else name
    g = lambda i: F.regexp_extract(c, RUN_NAME_RE, i)
    nz = lambda e: F.when(e != "", e)
    return [g(1).alias("dataset"), g(2).alias("approach"),
            g(3).cast("long").alias("lateness"),
            nz(g(4)).cast("double").alias("threshold"),
            nz(g(5)).cast("double").alias("sensitivity"),
            nz(g(6)).cast("double").alias("change_rate"),
            nz(g(7)).cast("long").alias("period"),
            g(8).cast("long").alias("width")]


def watermarks_met(events: DataFrame, steps: DataFrame, stream_cols: list[str], run: str, runs: int) -> tuple[DataFrame, DataFrame]:
    """Which watermark each event met, for many runs at once.

    ``steps``: ``(stream, run, arr, seq, wm)``, a watermark that run emitted after that
    event.  Returns the events with ``mark``, the last event before them (in
    arrival order) after which *any* run emitted one, and ``(stream, mark, wms)``
    with the watermark of every run at that point (an array by run; NULL: none
    yet).  One scan of the events in arrival order, whatever the number of runs."""
    marks = steps.select(*stream_cols, "arr", "seq").distinct()
    null = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    at = F.struct("arr", "seq")
    none = F.lit(None).cast("struct<arr:bigint,seq:bigint>")
    both = events.select("*", F.lit(0).alias("__kind"), none.alias("__at")).unionByName(
        marks.select(*[F.col(c) if c in marks.columns else null(c) for c in events.columns], F.lit(1).alias("__kind"),
                     at.cast("struct<arr:bigint,seq:bigint>").alias("__at")))
    # a mark sorts after its own event, which met what was before
    met = (blocked_scan(both, stream_cols, None, ["arr", "seq", "__kind"], [Scan("mark", "__at", "max")])
           .where("__kind = 0").drop("__kind", "__at"))
    # per mark the watermark of each run: its own, or that of an earlier mark
    every = marks.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias(run))
    held = join_nullsafe(every, steps.select(*stream_cols, run, "arr", "seq", "wm"), [*stream_cols, run, "arr", "seq"], "left")
    held = blocked_scan(held, [*stream_cols, run], None, ["arr", "seq"], [Scan("held", "wm", "max")])
    table = (held.groupBy(*stream_cols, at.cast("struct<arr:bigint,seq:bigint>").alias("mark"))
             .agg(F.map_from_entries(F.collect_list(F.struct(F.col(run), F.coalesce("held", F.lit(0))))).alias("wms")))
    return met, table


def adaptive_folds(configs: list[dict], warmup: int) -> tuple[list, list[tuple]]:
    """The estimators of a grid, one for each (sensitivity, change rate,
    threshold), in the sweep's constructor form: allowed lateness starts at
    0 and comes from the warm-up."""
    from driftmark.operators.adaptive import adaptive_preset
    from driftmark.operators.drift import AdaptiveParams
    keys = ("sensitivity", "change_rate", "threshold")
    folds = list({tuple(c[k] for k in keys): None for c in configs})
    return [AdaptiveParams(**adaptive_preset("four", *f), warmup=warmup) for f in folds], folds


def sweep_adaptive_panes(events: DataFrame, dataset: str, stream_cols: list[str],
                         key_cols: list[str], warmup: int, configs: list[dict] | None = None,
                         as_runs: bool = False):
    """P1, adaptive half: one ordered pass over each stream advances the
    estimators of all runs and returns only the watermarks they emit (runs
    that differ only in width share an estimator).  The events meet those
    in one scan, are combined to (key, event-time slot, mark) once for all
    runs, and only that is fanned out to the runs.  Returns (panes keyed by
    ``cfg``, configs)."""
    from driftmark.functions.time import window_start
    from driftmark.operators.adaptive import adaptive_steps
    from driftmark.session import materialize
    configs = configs or adaptive_grid(dataset)
    params, folds = adaptive_folds(configs, warmup)
    fold_of = [folds.index((c["sensitivity"], c["change_rate"], c["threshold"])) for c in configs]
    events = events.select(*dict.fromkeys([*key_cols, "t", "arr", "seq"]))
    steps = materialize(adaptive_steps(events, stream_cols, params).where("rose")
                        .select(*stream_cols, F.col("config").alias("fold"), "arr", "seq", "wm"))
    met, held = watermarks_met(events, steps, stream_cols, "fold", len(folds))
    slot = math.gcd(*[c["width"] for c in configs])
    slots = (met.groupBy(*key_cols, "mark", window_start("t", F.lit(slot).cast("long")).alias("t"))
             .agg(F.count(F.lit(1)).alias("n")))
    # the watermark of each run's estimator, 0 before the first mark
    held, _ = sized(held)
    slots = join_nullsafe(slots, held, [*stream_cols, "mark"], "left")
    values = [F.coalesce(F.element_at("wms", F.lit(k)), F.lit(0)).cast("long") for k in range(len(folds))]
    emitted = steps.select(*stream_cols, F.col("fold").alias("source"), F.col("wm").alias("value"))
    return run_panes(slots, values, emitted, configs, fold_of, [0] * len(configs), stream_cols, key_cols, as_runs), configs
