"""All stages for chosen sites and dates, and the ingest of raw logger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import joins, qc, sequence
from ..session import cut_lineage
from .flux_job import FluxOptions, flux_job

DAY_US = 86_400_000_000


def condition(samples: DataFrame, limits: dict[str, tuple[float, float]], spikes: dict[str, float], window_us: int,
              longest: int, chunk: int) -> DataFrame:
    """Absolute limits, then spike test, long-run release and repair inside each averaging period until a pass is clean."""
    keys = ["site", "height"]
    if not spikes:
        return qc.absolute_limits(samples, limits)
    return qc.despike_passes(qc.absolute_limits(samples, limits).select(*samples.columns), keys, "us", spikes, window_us, longest, qc.MOST_PASSES,
                             chunk, lambda df: cut_lineage(df, "despike"), [*keys, "period_us"])


def run_pipeline(samples: DataFrame, opts: FluxOptions, limits, spikes, window_us: int, chunk: int, longest: int = 10,
                 fits: DataFrame | None = None) -> DataFrame:
    """Condition, rotate and compute fluxes of every (site, height, period)."""
    return flux_job(condition(samples, limits, spikes, window_us, longest, chunk), opts, fits)


def status(expected: DataFrame, produced: DataFrame, keys, usable: str) -> DataFrame:
    """Per expected unit: complete, empty (produced without a usable value) or missing."""
    keys = list(keys)
    got = produced.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_periods"), F.count(usable).alias("n_usable"))
    s = expected.join(got, keys, "left")
    return s.withColumn("status", F.when(F.col("n_periods").isNull(), "missing").when(F.col("n_usable") == 0, "empty").otherwise("complete"))


def ingest(grid_of: DataFrame, keys, us: str, step_us: int, sources: dict[str, tuple[DataFrame | None, list[str], int]],
           fill_limit: int, chunk: int) -> DataFrame:
    """Loggers and statistics logs of a site on one complete grid, short gaps filled.

    *sources* maps a name to (frame or None, columns, clock lag); an optional
    source that is absent gives missing columns.
    """
    spans = grid_of.groupBy(*keys).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    # close the day: the first stamp of the next day aligns the clocks of adjoining files
    hi = F.col("hi") + F.pmod(-F.col("hi"), F.lit(DAY_US))
    grid = joins.grid_stamps(spans.withColumn("hi", hi), keys, "lo", "hi", step_us, us)
    wide = joins.join_sources(grid, keys, us, sources)
    cols = [f"{n}_{c}" for n, (frame, cs, _) in sources.items() if frame is not None for c in cs]
    filled = sequence.fill_linear(wide, keys, us, cols, chunk, limit_us=fill_limit * step_us)
    return filled.select(*keys, us, *[F.col(f"{c}_filled").alias(c) if c in cols else F.col(c) for c in wide.columns if c not in (*keys, us)])
