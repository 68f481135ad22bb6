"""Analysis windows: preparation, diagnostics and the packed one-row-per-window form.

A packed window carries each signal as an array. Its length is bounded by
sampling rate times window length, so whole-window kernels run row by row
inside the partition that already holds the window: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def taylor_diagnostics(df: DataFrame, keys, max_ratio: float = 0.5) -> DataFrame:
    """Residual means after rotation and the frozen-turbulence criterion per window."""
    g = df.groupBy(*keys).agg(
        F.avg("u").alias("u_mean"), F.avg("v").alias("v_mean"), F.avg("w").alias("w_mean"),
        F.stddev_pop("w").alias("_sw"), F.stddev_pop(F.hypot("u", "v")).alias("sigma_m"))
    mean_wind = F.hypot("u_mean", "v_mean")
    ratio = F.try_divide(F.col("sigma_m"), mean_wind)
    return g.select(*keys, "u_mean", "v_mean", "w_mean", F.try_divide("w_mean", "_sw").alias("w_over_sigma"),
                    mean_wind.alias("mean_wind"), "sigma_m", ratio.alias("taylor_ratio"),
                    F.coalesce(ratio < max_ratio, F.lit(False)).alias("taylor_ok"))


def pack(df: DataFrame, keys, slot: str, cols) -> DataFrame:
    """One row per window with each column as an array ordered by *slot*.

    Equal slots are averaged first, so a window holds at most one value per
    slot and its size is bounded by the number of slots.
    """
    one = df.groupBy(*keys, slot).agg(*[F.avg(c).alias(c) for c in cols])
    rows = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(slot, *cols))).alias("_r"))
    return rows.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def unpack(df: DataFrame, keys, cols, slot: str = "i") -> DataFrame:
    """Long rows of packed windows."""
    z = F.arrays_zip(*cols)
    return df.select(*keys, F.posexplode(z).alias(slot, "_z")).select(*keys, slot, *[F.col(f"_z.{c}").alias(c) for c in cols])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of *value*, which is evaluated once.

    The optimizer inlines a column that a lambda refers to into the lambda, which would evaluate it anew for every
    element; it does not inline a lambda's variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_mean(x: Column) -> Column:
    """Mean of the valid values of an array."""
    return bound(F.filter(x, lambda a: a.isNotNull()),
                 lambda ok: F.try_divide(F.aggregate(ok, F.lit(0.0), lambda s, a: s + a), F.size(ok)))


def demeaned(df: DataFrame, cols) -> DataFrame:
    """Packed windows with each signal about its own mean."""
    centre = lambda x: bound(array_mean(x), lambda m: F.transform(x, lambda a: a - m))
    return df.withColumns({c: bound(F.col(c), centre) for c in cols})


def prepare(df: DataFrame, keys, us: str, cols, max_missing: float, chunk: int, order: str = "constant",
            t: str | None = None) -> DataFrame:
    """Accept, gap-fill and detrend each signal of each window; a rejected signal is missing."""
    from .moments import detrend
    from .sequence import fill_linear

    frac = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in cols])
    filled = fill_linear(df, keys, us, cols, chunk).join(frac, list(keys))
    for c in cols:
        filled = filled.withColumn(c, F.when((F.col(f"{c}_missing") <= max_missing) & (F.col(f"{c}_missing") < 1),
                                             F.col(f"{c}_filled"))).drop(f"{c}_filled", f"{c}_was_missing")
    return detrend(filled, keys, cols, order, t)
