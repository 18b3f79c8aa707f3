"""Streams derived from the driver's parquet tables.

The tables carry event time only; arrival order is produced by a fixed
integer formula so that Spark and the SQL oracle see the same disorder:

    t   = epoch ms of ``ts`` (truncated)
    arr = t + ((event_id * 7919 + 104729) % 1009) * delay_unit

``delay_unit`` 21600 spreads arrivals over 0 .. 6.05 h.  ``drifting=True``
alternates the unit between 3600 and 21600 every 500 events, a change in
the delay distribution for the drift detector to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.time import epoch_ms

# Fixed values of the fixture formula (shared with the SQL oracles).
DELAY_MULT = 7919
DELAY_ADD = 104729
DELAY_MOD = 1009
DELAY_UNIT_MS = 21600
DRIFT_UNIT_MS = 3600
DRIFT_PERIOD = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delay_ms(event_id: str = "event_id", unit: int = DELAY_UNIT_MS,
             drifting: bool = False):
    step = F.pmod(F.col(event_id) * DELAY_MULT + DELAY_ADD, F.lit(DELAY_MOD))
    if drifting:
        phase = F.pmod(F.expr(f"`{event_id}` div {DRIFT_PERIOD}"), F.lit(2))
        unit_col = F.lit(DRIFT_UNIT_MS) * (F.lit(1) + F.lit(5) * phase)
        return step * unit_col
    return step * F.lit(unit)


def event_stream(spark: SparkSession, sf_dir: str, *extra: str,
                 drifting: bool = False) -> DataFrame:
    """``events`` as a stream: ``seq, t, arr`` plus the requested columns
    (``event_type``, ``user_id``, ``value`` ...).  Only those columns are
    read from parquet."""
    ev = table(spark, sf_dir, "events")
    t = epoch_ms("ts")
    return ev.select(
        F.col("event_id").alias("seq"),
        t.alias("t"),
        (t + delay_ms(drifting=drifting)).alias("arr"),
        *extra,
    )


def lineitem_stream(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``lineitem`` replayed in order-key order against ship date, which is
    disordered already: ``arr`` is the order key (an arrival ordinal, so
    ticks count order keys), ``t`` the ship date in epoch ms.  The tie-break
    hashes the whole row: (l_orderkey, l_linenumber) is not unique, and rows
    equal in every column are interchangeable."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.xxhash64(*li.columns).alias("seq"),
        epoch_ms("l_shipdate").alias("t"),
        F.col("l_orderkey").alias("arr"),
        *extra,
    )
