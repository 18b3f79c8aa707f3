"""Java-compatible text helpers (splitting, rounding, parsing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.util import col_of


def java_split(line, sep: str = ",") -> Column:
    """``String.split(sep)`` as Java does it: trailing empty fields are
    dropped ("5," has one field), Spark's ``split`` would keep them."""
    esc = "\\" + sep if sep in ".$^|*+?()[]{}\\" else sep
    return F.split(F.regexp_replace(col_of(line), f"({esc})+$", ""), esc)


def java_round2(x) -> Column:
    """``Math.round(x * 100.0) / 100.0``: half-up towards +infinity, which
    differs from Spark's ``round`` (half away from zero) on negative halves."""
    return F.floor(col_of(x) * 100.0 + 0.5) / 100.0


def parse_long(s) -> Column:
    """Strict ``Long.parseLong``: NULL unless the text is an optional sign
    and digits (``try_cast`` alone would accept surrounding spaces)."""
    s = col_of(s)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("long"))


def parse_double(s) -> Column:
    """``Double.parseDouble``: leading/trailing blanks are allowed by Java."""
    return F.trim(col_of(s)).try_cast("double")
