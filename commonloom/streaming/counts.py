"""The group counts of the engine over a stream, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, time: str, keys: Sequence[str], length: str, late: str, where: Column | None = None) -> DataFrame:
    """Counts by keys and tumbling window of `time`; state is dropped once the watermark, `late` behind, has passed a window.

    Works on a batch as well; the result has `window_start`, the keys and `cnt`.
    """
    rows = rows if where is None else rows.filter(where)
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    counts = rows.groupBy(F.window(time, length).alias("_window"), *keys).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(F.col("_window.start").alias("window_start"), *keys, "cnt")
