"""Sessions of a stream by gaps, closed by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, *, gap: str = "6 seconds", late: str = "0 seconds") -> DataFrame:
    """take, start, last, n of each session of a stream (take, ts): events up to `gap` apart. A session comes out when the watermark, `late` behind the
    latest event of all takes, has passed its end."""
    window = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy("take", window.alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return found.select("take", F.col("w.start").alias("start"), "last", "n")
