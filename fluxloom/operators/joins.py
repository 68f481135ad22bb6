"""Grid, as-of, height, interval and comparison joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import scan

DAY_US = 86_400_000_000


def grid_stamps(spans: DataFrame, keys, lo: str, hi: str, step_us: int, us: str = "us") -> DataFrame:
    """Uniform stamps ``lo, lo+step, ... <= hi`` per key.

    Expanded in two levels, blocks first and samples second, so no row ever
    carries the array of a whole series.
    """
    block = max(step_us, (DAY_US // step_us) * step_us)
    blocks = spans.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).select(
        *keys, "_hi", F.explode(F.sequence("_lo", "_hi", F.lit(block))).alias("_b"))
    last = F.least(F.col("_hi"), F.col("_b") + (block - step_us))
    return blocks.select(*keys, F.explode(F.sequence(F.col("_b"), last, F.lit(step_us))).alias(us))


def complete_grid(df: DataFrame, keys, us: str, step_us: int) -> DataFrame:
    """Left join onto the complete grid of each series, exposing gaps as missing rows."""
    keys = list(keys)
    spans = df.groupBy(*keys).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    return grid_stamps(spans, keys, "lo", "hi", step_us, us).join(df, [*keys, us], "left")


def join_sources(grid: DataFrame, keys, us: str, sources: dict[str, tuple[DataFrame, list[str], int]]) -> DataFrame:
    """Join the columns of several loggers onto one grid, each shifted by its clock lag.

    *sources* maps a name to (frame, columns, lag in micros). An absent frame
    (None) contributes missing columns.
    """
    keys, out = list(keys), grid
    for name, (frame, cols, lag_us) in sources.items():
        if frame is None:
            out = out.select("*", *[F.lit(None).cast("double").alias(f"{name}_{c}") for c in cols])
            continue
        shifted = frame.select(*keys, (F.col(us) + lag_us).alias(us), *[F.col(c).alias(f"{name}_{c}") for c in cols])
        out = out.join(shifted, [*keys, us], "left")
    return out


def bracketed(left: DataFrame, right: DataFrame, keys, us: str, cols, chunk: int) -> DataFrame:
    """*left* with the nearest valid sample of *right* on both sides of each stamp.

    The two sides are stacked and scanned, never range-joined. ``before_<c>``
    and ``after_<c>`` are structs (o, x); a right sample on the stamp itself
    is found as *before*.
    """
    keys, payload = list(keys), [c for c in left.columns if c not in (*keys, us)]
    both = (left.select(*keys, us, F.struct(F.lit(True).alias("_is_left"), *payload).alias("_row"), F.lit(1).alias("_side"),
                        *[F.lit(None).cast("double").alias(c + "_r") for c in cols])
            .unionByName(right.select(*keys, us, F.lit(0).alias("_side"), *[F.col(c).cast("double").alias(c + "_r")
                                                                          for c in cols]), allowMissingColumns=True))
    out = scan.brackets(both, keys, us, [c + "_r" for c in cols], chunk, ties=["_side"])
    out = out.filter(F.col("_side") == 1).select(
        *keys, us, "_row.*", *[F.col(f"before_{c}_r").alias(f"before_{c}") for c in cols],
        *[F.col(f"after_{c}_r").alias(f"after_{c}") for c in cols])
    return out.drop("_is_left")


def nearest_value(c: str, us: str, tolerance_us: int) -> Column:
    """The nearer bracketing sample within the tolerance; the earlier one on a tie."""
    b, a, t = F.col(f"before_{c}"), F.col(f"after_{c}"), F.col(us)
    db, da = t - b["o"], a["o"] - t
    take_before = b.isNotNull() & (a.isNull() | (db <= da))
    best = F.when(take_before, b["x"]).otherwise(a["x"])
    dist = F.when(take_before, db).otherwise(da)
    return F.when(dist <= tolerance_us, best)


def linear_value(c: str, us: str, max_gap_us: int | None = None, hold_edges: bool = False) -> Column:
    """Linear interpolation between the bracketing samples.

    Missing across gaps above *max_gap_us*; outside the record missing, or the
    edge value with *hold_edges*.
    """
    b, a, t = F.col(f"before_{c}"), F.col(f"after_{c}"), F.col(us)
    gap = a["o"] - b["o"]
    frac = F.try_divide((t - b["o"]).cast("double"), gap.cast("double"))
    inner = F.when(b["o"] == t, b["x"]).when(a["o"] == t, a["x"]).otherwise(b["x"] + (a["x"] - b["x"]) * frac)
    if max_gap_us is not None:
        inner = F.when((b["o"] == t) | (a["o"] == t) | (gap <= max_gap_us), inner)
    edge = F.coalesce(b["x"], a["x"]) if hold_edges else F.when(b["o"] == t, b["x"])
    return F.when(b.isNotNull() & a.isNotNull(), inner).otherwise(edge)


def height_key(h: Column) -> Column:
    """Join key of a height, equal within one centimetre."""
    return F.round(h * 100).cast("long")


def join_by_height(left: DataFrame, right: DataFrame, on=()) -> DataFrame:
    """Equi join on *on* and the centimetre height; the right height is dropped."""
    r = right.withColumn("_h", height_key(F.col("height"))).drop("height")
    return left.withColumn("_h", height_key(F.col("height"))).join(r, [*on, "_h"]).drop("_h")


def nearest_height(levels: DataFrame, sensors: DataFrame, on, tolerance: float | None = None) -> DataFrame:
    """For each level the nearest sensor height of the same site, optionally within a tolerance.

    Both sides are height dimensions (one row per site and height).
    """
    on = list(on)
    pairs = levels.join(sensors.withColumnRenamed("height", "sensor_height"), on)
    gap = F.abs(F.col("sensor_height") - F.col("height"))
    best = pairs.groupBy(*on, "height").agg(
        F.min_by("sensor_height", F.struct(gap, F.col("sensor_height"))).alias("sensor_height"),
        F.count(F.lit(1)).alias("n_sensors"))
    if tolerance is not None:
        near = F.abs(F.col("sensor_height") - F.col("height")) <= tolerance
        best = best.withColumn("sensor_height", F.when(near | (F.col("n_sensors") == 1), F.col("sensor_height")))
    return best.drop("n_sensors")


def fit_for_period(periods: DataFrame, keys, fits: DataFrame, day: Column, direction: Column, by=("site",)) -> DataFrame:
    """Attach the planar-fit record valid for each period: *by*, height, inclusive dates, sector.

    Of several valid records the one with the highest ``rec`` wins; a period
    without one keeps missing coefficients. The equi part of the join is
    *by* and the centimetre height, so no cross product is formed.
    """
    from ..functions.wind import in_sector

    keys = list(keys)
    left = periods.withColumn("_h", height_key(F.col("height"))).withColumn("_day", day).withColumn("_dir", direction)
    right = fits.select(*by, height_key(F.col("height")).alias("_h"), "rec", "day_lo", "day_hi", "sector_lo", "sector_hi",
                        "b0", "b1", "b2")
    for c in by:
        right = right.withColumnRenamed(c, f"_{c}")
    same = left["_h"] == right["_h"]
    for c in by:
        same = same & (left[c] == right[f"_{c}"])
    cond = (same & left["_day"].between(right["day_lo"], right["day_hi"])
            & in_sector(left["_dir"], right["sector_lo"], right["sector_hi"]))
    hits = left.join(right, cond).groupBy(*keys).agg(
        F.max_by(F.struct("rec", "b0", "b1", "b2"), F.col("rec")).alias("fit"))
    return periods.join(hits, keys, "left").select(
        *periods.columns, "fit.rec", "fit.b0", "fit.b1", "fit.b2")


def with_fallback(periods: DataFrame, sector_fits: DataFrame, single_fits: DataFrame, on, sector: str) -> DataFrame:
    """Sector coefficients, else the coefficients of the all-direction fit."""
    on, coef = list(on), ["b0", "b1", "b2"]
    s = sector_fits.select(*on, sector, *[F.col(c).alias(f"s_{c}") for c in coef])
    a = single_fits.select(*on, *[F.col(c).alias(f"a_{c}") for c in coef])
    out = periods.join(s, [*on, sector], "left").join(a, on, "left")
    use = F.col("s_b0").isNotNull()
    return out.select(*periods.columns, *[
        F.when(use, F.col(f"s_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in coef],
        use.cast("int").alias("from_sector"))


def compare_runs(a: DataFrame, b: DataFrame, keys, us: str, value: str, max_qc: int) -> DataFrame:
    """Inner join of two runs on the minute-rounded stamp, both sides within the quality limit."""
    minute = F.expr(f"floor(({us} + 30000000L) / 60000000L)").cast("long").alias("minute")
    side = lambda df, n: df.filter((F.col("qc") <= max_qc) & F.col(value).isNotNull()).select(
        *keys, minute, F.col(value).alias(n))
    return side(a, "a").join(side(b, "b"), [*keys, "minute"])


def diff_tables(before: DataFrame, after: DataFrame, keys, cols) -> DataFrame:
    """Rows that differ: one-sided keys, and values unequal with missing equal to missing."""
    keys = list(keys)
    l = before.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"{c}_before") for c in cols])
    r = after.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"{c}_after") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    status = (F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed")
              .when(~same, "changed"))
    return (l.join(r, keys, "full_outer").withColumn("status", status)
            .filter(F.col("status").isNotNull()).drop("_l", "_r"))


def pair_on_grid(a: DataFrame, b: DataFrame, keys, us: str, col_a: str, col_b: str, step_us: int,
                 min_count: int, chunk: int, max_gap_us: int | None = None) -> DataFrame:
    """Two streams of each series on one uniform grid over their overlap.

    Duplicate stamps are averaged, both streams interpolated linearly; series
    with fewer than *min_count* samples on either side are dropped.
    """
    keys = list(keys)
    mean = lambda df, c: (df.filter(F.col(c).isNotNull()).groupBy(*keys, us).agg(F.avg(c).alias(c)))
    a, b = mean(a, col_a), mean(b, col_b)
    span = lambda df, p: df.groupBy(*keys).agg(F.min(us).alias(p + "lo"), F.max(us).alias(p + "hi"),
                                               F.count(F.lit(1)).alias(p + "n"))
    spans = (span(a, "a").join(span(b, "b"), keys)
             .filter((F.col("an") >= min_count) & (F.col("bn") >= min_count))
             .select(*keys, F.greatest("alo", "blo").alias("lo"), F.least("ahi", "bhi").alias("hi"))
             .filter("hi >= lo"))
    grid = grid_stamps(spans, keys, "lo", "hi", step_us, us)
    ga = bracketed(grid, a, keys, us, [col_a], chunk).select(*keys, us, linear_value(col_a, us, max_gap_us).alias(col_a))
    gb = bracketed(grid, b, keys, us, [col_b], chunk).select(*keys, us, linear_value(col_b, us, max_gap_us).alias(col_b))
    return ga.join(gb, [*keys, us])
