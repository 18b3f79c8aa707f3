"""driftmark: event-time progress (watermarks), lateness accounting and
windowed counts for out-of-order data, expressed as Spark DataFrame plans.

Canonical stream columns used throughout the library:

``t``    event time, BIGINT epoch milliseconds
``arr``  arrival (reference) time, BIGINT epoch milliseconds
``seq``  unique BIGINT tie-break; arrival order is ``(arr, seq)``

Any other columns (stream keys, window keys, payload) pass through.
"""

from driftmark.session import checkpoint_root, get_spark, scratch_dir

__all__ = ["checkpoint_root", "get_spark", "scratch_dir"]
