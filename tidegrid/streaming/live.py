"""Bars and level crossings as seen live, on Structured Streaming.

Both take and return streaming DataFrames with an event-time column; state is
bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_minute_bars(ticks: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Minute bars; a bar is final when the watermark has passed it, later prints are dropped.

    First and last price order by (time, sequence), as in the batch bars.
    """
    order = F.struct(ts, "seq")
    return (
        ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("volume"), F.max("price").alias("high"), F.min("price").alias("low"), F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"))
        .select(*keys, F.col("w.start").alias("minute"), "n_trades", "volume", "high", "low", "first_price", "last_price")
    )


def live_crossings(ticks: DataFrame, anchors: DataFrame, keys: list[str], multiple: float, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first print seen of each key at or over a multiple of its anchor price.

    ``anchors`` is a batch table (a row a key). One row a key leaves within the
    watermark's span; null anchors never cross.
    """
    over = ticks.withWatermark(ts, late).join(anchors, keys).filter(F.col("price") >= F.lit(multiple) * F.col("anchor_price"))
    return over.dropDuplicatesWithinWatermark(keys).select(*keys, F.col(ts).alias("crossed_at"), "price", "anchor_price")
