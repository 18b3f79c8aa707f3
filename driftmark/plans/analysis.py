"""Run analysis (A1-A4): panes -> one summary row per run.

The reference folds each result file line by line; here every run is a
group key, so all runs are summarised by two aggregations in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.windows import pane_count
from driftmark.plans.sweep import parse_run_name
from driftmark.sources.text import read_panes_text

REPORT_COLS = ["dataset", "approach", "lateness", "sensitivity", "change_rate", "threshold",
               "period", "width", "windows", "elements", "mean_lag", "not_processed"]


def collapse_panes(panes: DataFrame, group_cols: list[str]) -> DataFrame:
    """A1: one row per (group, window end) over non-flushed panes.

    elements = first pane's count + 1 per re-fire, lag = first pane's lag.
    Counts only grow within a window, so "first" is the smallest count and
    the result does not depend on pane order."""
    live = panes.where(~F.col("flushed"))
    return live.groupBy(*group_cols, "wend").agg(
        (F.min("cnt") + F.sum(pane_count(live)) - 1).cast("long").alias("elements"),
        F.min_by("lag", "cnt").alias("lag"))


def analyze_runs(panes: DataFrame, run_cols: list[str], stream_cols: list[str],
                 runs: DataFrame | None = None) -> DataFrame:
    """A2: per run windows, elements, mean lag and elements only flushed
    at end of stream.  Windows are (stream, window end) pairs.  ``runs`` lists
    all runs (columns ``run_cols``): one without panes has 0 windows."""
    from driftmark.plans.sweep import PLACE
    flushed = F.col("flushed")
    # runs of panes lie in one place for each window already
    place = PLACE if set(PLACE) <= set(panes.columns) else ()
    per_window = panes.groupBy(*place, *run_cols, *stream_cols, "wend").agg(
        F.min(F.when(~flushed, F.col("cnt"))).alias("first_cnt"),
        F.sum(F.when(~flushed, pane_count(panes))).alias("npanes"),
        F.min_by(F.when(~flushed, F.col("lag")), F.when(~flushed, F.col("cnt"))).alias("first_lag"),
        F.sum(F.when(flushed, F.col("cnt"))).alias("flushed_cnt"))
    out = per_window.groupBy(*run_cols).agg(
        F.count("first_cnt").alias("windows"),
        F.coalesce(F.sum(F.col("first_cnt") + F.col("npanes") - 1), F.lit(0)).cast("long").alias("elements"),
        F.try_divide(F.sum("first_lag").cast("double"), F.count("first_cnt")).alias("mean_lag"),
        F.coalesce(F.sum("flushed_cnt"), F.lit(0)).cast("long").alias("not_processed"))
    if runs is not None:
        out = runs.select(*run_cols).distinct().join(out, run_cols, "left")
        out = out.fillna(0, ["windows", "elements", "not_processed"])
    return out


REPORT_TYPES = {"dataset": "string", "approach": "string", "lateness": "bigint",
                "sensitivity": "double", "change_rate": "double", "threshold": "double",
                "period": "bigint", "width": "bigint", "windows": "bigint",
                "elements": "bigint", "mean_lag": "double", "not_processed": "bigint"}


def report(summary: DataFrame) -> DataFrame:
    """A3: the 12-column report; parameters of the other approach are NULL."""
    cols = [(F.col(c) if c in summary.columns else F.lit(None)).cast(REPORT_TYPES[c]).alias(c)
            for c in REPORT_COLS]
    return summary.select(*cols)


def write_report(rep: DataFrame, path: str) -> None:
    rep.write.mode("overwrite").option("header", True).csv(path)


def compare_runs(spark: SparkSession, path: str) -> DataFrame:
    """A4: every pane file under ``path`` -> parse run names -> report, one job."""
    panes = read_panes_text(spark, path)
    summary = analyze_runs(panes, ["run"], [])
    return report(summary.select("*", *parse_run_name("run")))
