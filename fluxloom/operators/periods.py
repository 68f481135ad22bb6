"""Averaging periods: assignment, block means, coverage and step-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timecodes import period_end, period_start
from . import scan


def assign_periods(df: DataFrame, us: str, period_us: int) -> DataFrame:
    """Add the right-closed end label and the left-closed start label."""
    return (df.withColumn("period_end", period_end(F.col(us), period_us))
            .withColumn("period_start", period_start(F.col(us), period_us)))


def period_counts(df: DataFrame, keys, us: str, period_us: int) -> DataFrame:
    """Number of periods per series: whole days covered and blocks of the span."""
    g = df.groupBy(*keys).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    return g.select(*keys, (
        (period_end(F.col("hi"), period_us) - period_start(F.col("lo"), period_us)) / period_us
    ).cast("long").alias("n_periods"))


def monotone_blocks(df: DataFrame, keys, order: str, us: str, period_us: int, chunk: int) -> DataFrame:
    """Clock blocks on the running-maximum stamp, so a backward clock step stays in its block."""
    mono = scan.running(df, keys, order, {"us_mono": ("max", F.col(us))}, chunk)
    return mono.withColumn("block_us", period_start(F.col("us_mono"), period_us))


def block_means(df: DataFrame, keys, cols, us: str = "us") -> DataFrame:
    """Mean of each column per key and the last stamp of the block; missing values skipped."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], F.max(us).alias("last_us"),
        F.count(F.lit(1)).alias("n"))


def vector_mean_direction(direction: Column, speed: Column) -> Column:
    """Speed-weighted mean direction in [0, 360)."""
    rad = F.radians(direction)
    return F.pmod(F.degrees(F.atan2(F.avg(speed * F.sin(rad)), F.avg(speed * F.cos(rad)))), F.lit(360.0))


def step_down(df: DataFrame, keys, order: str, cols, n: int, chunk: int) -> DataFrame:
    """Mean of every *n* consecutive rows; an incomplete last group is dropped."""
    ranked = scan.row_index(df, keys, order, chunk).withColumn(
        "step", F.floor((F.col("rn") - 1) / n).cast("long"))
    return (ranked.groupBy(*keys, "step")
            .agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in cols])
            .filter(F.col("n_rows") == n).drop("n_rows"))


def sub_period_stats(df: DataFrame, keys, us: str, sub_us: int, cols, expected: float,
                     min_frac) -> DataFrame:
    """Mean, population sd and coverage per sub-period; blank below the channel's minimum."""
    g = df.groupBy(*keys, period_start(F.col(us), sub_us).alias("sub_us")).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols],
        *[(F.count(c) / float(expected)).alias(f"{c}_cover") for c in cols])
    out = []
    for c in cols:
        ok = F.col(f"{c}_cover") >= float(min_frac[c])
        out += [F.when(ok, F.col(f"_m_{c}")).alias(f"{c}_mean"),
                F.when(ok, F.col(f"_s_{c}")).alias(f"{c}_sd"), F.col(f"{c}_cover")]
    return g.select(*keys, "sub_us", *out)


def equal_period_check(df: DataFrame, keys, period: str) -> DataFrame:
    """Whether every period of a series holds the same number of rows."""
    per = df.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.min("n").alias("n_min"), F.max("n").alias("n_max"),
        (F.min("n") == F.max("n")).cast("int").alias("equal"))
