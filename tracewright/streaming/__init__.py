"""Count windows of a line stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import anomalous, window_id


def window_labels(lines: DataFrame, size: int = 10, step: int = 10, wait: str = "1 hour") -> DataFrame:
    """``(session_id, start_idx, label, n_lines)`` of each window as soon as its last line is in.

    ``lines(line_no, ts, line)`` is a stream with 0-based numbers, in any order.  The state of a window
    is two numbers; a window that lacks lines when the watermark has passed its last one by
    ``wait`` is given up, so that state is bounded by the windows of that span.
    """
    no = F.col("line_no")
    lo, hi = F.greatest(F.lit(0), F.ceil((no - size + 1) / step)).cast("bigint"), F.floor(no / step).cast("bigint")
    starts = F.explode(F.sequence(lo * step, hi * step, F.lit(step).cast("bigint"))).alias("start_idx")
    bad = F.coalesce(anomalous(F.col("line")), F.lit(False)).cast("int").alias("bad")
    rows = lines.where(lo <= hi).select("ts", bad, starts).withWatermark("ts", wait)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, label = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        latest = 0
        for part in parts:
            n, label = n + len(part), max(label, int(part["bad"].max()))
            latest = max(latest, int(part["ts"].max().timestamp() * 1000))
        if n >= size:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"start_idx": [key[0]], "label": [label], "n_lines": [n]})
        else:
            state.update((n, label))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    whole = rows.groupBy("start_idx").applyInPandasWithState(fold, "start_idx long, label int, n_lines int", "n int, label int", "append", "EventTimeTimeout")
    return whole.select(window_id(F.col("start_idx")).alias("session_id"), "start_idx", "label", "n_lines")
