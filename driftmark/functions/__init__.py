"""Column-level helpers shared by the operators."""

from driftmark.functions.scan import Scan, blocked_scan
from driftmark.functions.text import java_round2, java_split, parse_double, parse_long
from driftmark.functions.time import (LONG_MAX, epoch_ms, floor_div, gmt_text_ss,
                                      int_div, local_text_sss, ms_to_ntz, window_start)
from driftmark.functions.util import col_of, join_nullsafe

__all__ = [
    "LONG_MAX", "Scan", "blocked_scan", "col_of", "epoch_ms", "floor_div",
    "gmt_text_ss", "int_div", "java_round2", "java_split", "join_nullsafe",
    "local_text_sss", "ms_to_ntz", "parse_double", "parse_long", "window_start",
]
