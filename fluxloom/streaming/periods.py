"""Block means and sub-period statistics of a sample stream.

The same tumbling periods as the batch form, closed by a watermark. The state
is one partial aggregate per open (key, period).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_block_means(stream: DataFrame, keys, ts: str, period: str, cols, lateness: str) -> DataFrame:
    """Mean, population sd, last stamp and count per start-labelled period."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.count(c).alias(f"{c}_n")]
    g = stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, period).alias("w")).agg(
        *aggs, F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "last_ts", "n",
                    *[f"{c}_{s}" for c in cols for s in ("mean", "sd", "n")])
