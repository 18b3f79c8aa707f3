"""Integer time arithmetic and time text, all JVM-side column expressions.

Everything is BIGINT milliseconds: double division loses the floor for
epoch-ms values once the divisor is large, so floors go through ``pmod``
and integral ``div``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.util import col_of

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
LONG_MAX = 9223372036854775807


def epoch_ms(ts: str) -> Column:
    """TIMESTAMP_NTZ column -> epoch milliseconds (sub-ms digits dropped).

    Built from the value's own date and time-of-day fields, so no session
    time zone is involved (``timestampdiff`` would cast through the session
    zone and shift values across daylight-saving changes)."""
    c = f"`{ts}`"
    return F.expr(
        f"unix_date(to_date({c})) * 86400000L + hour({c}) * 3600000L + minute({c}) * 60000L"
        f" + CAST(floor(extract(SECOND FROM {c}) * 1000) AS BIGINT)")


def ms_to_ntz(ms) -> Column:
    """Epoch milliseconds -> TIMESTAMP_NTZ, no session time zone involved."""
    return F.timestamp_add("MILLISECOND", col_of(ms),
                           F.expr(EPOCH_NTZ))


def int_div(a, b) -> Column:
    """BIGINT ``a div b`` (truncating)."""
    return F.call_function("div", col_of(a), col_of(b))


def floor_div(a, b) -> Column:
    """Exact floor division of BIGINTs, also for negative ``a``."""
    a, b = col_of(a), col_of(b)
    return int_div(a - F.pmod(a, b), b)


def window_start(t, width) -> Column:
    """Start of the tumbling window of ``width`` ms containing ``t``."""
    t, width = col_of(t), col_of(width)
    return t - F.pmod(t, width)


def gmt_text_ss(ms) -> Column:
    """Java ``yyyy-MM-dd HH:mm:ss.SS`` in GMT.  Java's ``SS`` prints the
    *milliseconds* zero-padded to at least two digits (7 -> 07, 123 -> 123);
    Spark's ``SS`` would print hundredths, so the fraction is formatted here."""
    ms = col_of(ms)
    return F.concat(
        F.date_format(ms_to_ntz(ms), "yyyy-MM-dd HH:mm:ss"),
        F.lit("."),
        F.format_string("%02d", F.pmod(ms, F.lit(1000)).cast("int")),
    )


def local_text_sss(ms) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` with the zone pinned to UTC."""
    return F.date_format(ms_to_ntz(ms), "yyyy-MM-dd HH:mm:ss.SSS")
