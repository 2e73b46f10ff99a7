"""Running statistics over a stream of calls (an extension: the gateway itself has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(calls: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls and tokens saved by action and time window; rows later than the watermark are dropped."""
    saved = F.greatest(F.col("original_tokens") - F.col("result_tokens"), F.lit(0))
    return calls.withWatermark(ts, late).groupBy(F.window(ts, width), "action").agg(F.count(F.lit(1)).alias("calls"), F.sum(saved).alias("tokens_saved"))
