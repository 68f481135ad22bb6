"""Gap filling, sessions, runs, cumulative sums and extrema on ordered series."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from . import scan
from .joins import linear_value
from .kernels import rolling_deviation_mask


def fill_linear(df: DataFrame, keys, us: str, cols, chunk: int, limit_us: int | None = None,
                hold_edges: bool = True) -> DataFrame:
    """Linear gap filling in time; ``<c>_filled`` and the flag ``<c>_was_missing``.

    With *limit_us* only samples at most that long after the last valid one
    are filled; after the last valid sample of the series its value is held.
    """
    out = scan.brackets(df, keys, us, cols, chunk)
    sel = []
    for c in cols:
        filled = linear_value(c, us, hold_edges=hold_edges)
        if limit_us is not None:
            filled = F.when(F.col(us) - F.col(f"before_{c}")["o"] <= limit_us,
                            F.coalesce(linear_value(c, us), F.col(f"before_{c}")["x"]))
        sel += [F.coalesce(F.col(c), filled).alias(f"{c}_filled"), F.col(c).isNull().cast("int").alias(f"{c}_was_missing")]
    return out.select(*df.columns, *sel)


def carry_from_previous_batch(df: DataFrame, keys, us: str, batch: str, cols) -> DataFrame:
    """Where the first row of a batch is missing a value, take the last row of the previous batch."""
    keys = list(keys)
    row = F.struct(us, *cols)
    edges = df.groupBy(*keys, batch).agg(F.max(row).alias("_last"), F.min(us).alias("_first_us"))
    w = W.partitionBy(*keys).orderBy(batch)
    edges = edges.select(*keys, batch, "_first_us", F.lag("_last").over(w).alias("_carry"))
    out = df.join(edges, [*keys, batch])
    first = F.col(us) == F.col("_first_us")
    return out.select(*keys, batch, us, *[
        F.when(first & F.col(c).isNull(), F.col(f"_carry.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def sessions(df: DataFrame, keys, us: str, gap_us: int, chunk: int, ties=()) -> DataFrame:
    """Add ``session``: number of the run of rows whose spacing stays within *gap_us*."""
    near = scan.neighbours(df, keys, us, [us], chunk, ties)
    cut = F.when(F.col(us) - F.col(f"prev_{us}") > gap_us, 1).otherwise(0).cast("long")
    out = scan.running(near, keys, us, {"session": ("sum", cut)}, chunk, ties)
    return out.drop(f"prev_{us}", f"next_{us}")


def session_bounds(df: DataFrame, keys, us: str, gap_us: int, chunk: int) -> DataFrame:
    """First and last stamp and row count of every session."""
    return sessions(df, keys, us, gap_us, chunk).groupBy(*keys, "session").agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, keys, order: str, value: Column, chunk: int, name: str = "run") -> DataFrame:
    """Add the number of the run of equal consecutive values."""
    marked = df.withColumn("_value", value)
    near = scan.neighbours(marked, keys, order, ["_value"], chunk)
    # a missing value before the first row only shifts the numbers by one
    change = F.when(F.col("_value").eqNullSafe(F.col("prev__value")), 0).otherwise(1).cast("long")
    out = scan.running(near, keys, order, {name: ("sum", change)}, chunk)
    return out.drop("_value", "prev__value", "next__value")


def hold_exit_jumps(df: DataFrame, keys, us: str, value: str, gap_us: int, min_records: int, chunk: int) -> DataFrame:
    """Hold duration and wrapped step on leaving each run of a held angle, inside sessions.

    Sessions with fewer than *min_records* + 1 records, or fewer than three
    value changes, give no row.
    """
    keys = list(keys)
    s = sessions(df.select(*keys, us, value), keys, us, gap_us, chunk)
    size = s.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("_n"))
    near = scan.neighbours(s, keys, us, [value, "session"], chunk)
    start = ~F.col(value).eqNullSafe(F.col(f"prev_{value}")) | ~F.col("session").eqNullSafe(F.col("prev_session"))
    starts = near.filter(start).select(*keys, "session", us, value)
    w_keys = [*keys, "session"]
    edge = scan.neighbours(starts, w_keys, us, [us, value], chunk)
    n_start = starts.groupBy(*w_keys).agg(F.count(F.lit(1)).alias("_s"))
    jump = F.pmod(F.col(value) - F.col(f"prev_{value}") + 180.0, F.lit(360.0)) - 180.0
    return (edge.join(size, w_keys).join(n_start, w_keys)
            .filter((F.col("_n") > min_records) & (F.col("_s") >= 3) & F.col(f"prev_{us}").isNotNull())
            .select(*keys, us, ((F.col(us) - F.col(f"prev_{us}")) / 1e6).alias("hold_s"), jump.alias("jump")))


def cumulative_trapezoid(df: DataFrame, keys, us: str, col: str, chunk: int, name: str = "integral") -> DataFrame:
    """Running trapezoid integral over seconds, zero at the first sample."""
    near = scan.neighbours(df, keys, us, [us, col], chunk)
    step = F.coalesce((F.col(col) + F.col(f"prev_{col}")) / 2.0 * (F.col(us) - F.col(f"prev_{us}")) / 1e6, F.lit(0.0))
    return scan.running(near, keys, us, {name: ("sum", step)}, chunk).drop(
        f"prev_{us}", f"next_{us}", f"prev_{col}", f"next_{col}")


def unwrap(df: DataFrame, keys, us: str, col: str, period: float, chunk: int, name: str = "unwrapped") -> DataFrame:
    """Remove jumps of an angle by multiples of *period*."""
    near = scan.neighbours(df, keys, us, [col], chunk)
    jump = F.col(col) - F.col(f"prev_{col}")
    half = period / 2.0
    wrapped = F.pmod(jump + half, F.lit(period)) - half
    wrapped = F.when((wrapped == -half) & (jump > 0), F.lit(half)).otherwise(wrapped)
    turn = F.coalesce(F.when(F.abs(jump) < half, 0.0).otherwise(wrapped - jump), F.lit(0.0))
    out = scan.running(near, keys, us, {"_turn": ("sum", turn)}, chunk)
    return out.withColumn(name, F.col(col) + F.col("_turn")).drop("_turn", f"prev_{col}", f"next_{col}")


def gradient(df: DataFrame, keys, us: str, col: str, chunk: int, name: str = "rate") -> DataFrame:
    """Central difference per sample, one-sided at the ends."""
    near = scan.neighbours(df, keys, us, [us, col], chunk)
    lo, hi = F.coalesce(f"prev_{col}", col), F.coalesce(f"next_{col}", col)
    steps = F.col(f"prev_{us}").isNotNull().cast("int") + F.col(f"next_{us}").isNotNull().cast("int")
    return near.withColumn(name, F.try_divide(hi - lo, steps)).drop(f"prev_{us}", f"next_{us}", f"prev_{col}", f"next_{col}")


def zero_crossings(df: DataFrame, keys, us: str, col: str, chunk: int, slope: str = "negative") -> DataFrame:
    """Samples before a sign change with the given slope; ``offset_s`` is the interpolated
    crossing time after the sample."""
    near = scan.neighbours(df, keys, us, [us, col], chunk)
    a, b = F.col(col), F.col(f"next_{col}")
    cond = {"negative": (a > 0) & (b < 0), "positive": (a < 0) & (b > 0), "both": a * b < 0}[slope]
    return near.filter(cond).select(*keys, us, (
        a / (a - b) * (F.col(f"next_{us}") - F.col(us)) / 1e6).alias("offset_s"))


def moving_mean(df: DataFrame, keys, order: str, col: str, half: int, name: str = "smooth") -> DataFrame:
    """Centred mean of 2*half+1 rows with zeros beyond the ends; *keys* delimit bounded windows."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(name, F.sum(col).over(w) / float(2 * half + 1))


def local_extrema(df: DataFrame, keys, us: str, col: str, chunk: int) -> DataFrame:
    """Rows that are a local minimum or maximum, ``kind`` -1 or 1; strict before, lax after."""
    near = scan.neighbours(df, keys, us, [col], chunk)
    x, p, n = F.col(col), F.col(f"prev_{col}"), F.col(f"next_{col}")
    kind = F.when((x < p) & (x <= n), -1).when((x > p) & (x >= n), 1)
    return near.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, us, col, "kind")


def wave_amplitudes(df: DataFrame, keys, us: str, col: str, chunk: int) -> DataFrame:
    """Amplitude from each local minimum to the next local maximum."""
    ext = local_extrema(df, keys, us, col, chunk).withColumn("_peak", F.when(F.col("kind") == 1, F.col(col)))
    out = scan.brackets(ext, keys, us, ["_peak"], chunk)
    return (out.filter((F.col("kind") == -1) & F.col("after__peak").isNotNull())
            .select(*keys, us, F.col(col).alias("trough"), (F.col("after__peak")["x"] - F.col(col)).alias("amplitude")))


def rolling_mad_mask(df: DataFrame, keys, order: str, col: str, window: int, n_mad: float) -> DataFrame:
    """Add ``spike``: further than *n_mad* scaled deviations from the rolling median.

    *keys* delimit a bounded series (one averaging period), which one task holds; the rolling frame holds *window* rows
    and needs ``window // 5`` valid ones. The frame is kept sorted while it moves, so long frames cost no more sorts.
    """
    schema = StructType(list(df.schema.fields)).add("spike", "boolean")

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by(order)
        mask = rolling_deviation_mask(piece[col].to_numpy().astype(float), window, n_mad)
        return piece.append_column("spike", pa.array(mask))

    return df.groupBy(*keys).applyInArrow(run, schema)
