"""Whole-series kernels in overlapping pieces of a regular series.

A series is cut into chunks; each chunk is handed to the kernel with a halo of neighbouring samples on both sides, and only
its own samples come out. A kernel whose influence dies away over less than the halo gives the same values for any chunk
length, and no task holds more than one chunk with its halo. At the ends of the series the halo simply ends.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .joins import complete_grid

_TYPES = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def on_grid(rows: DataFrame, keys, us: str, step_us: int, cols) -> DataFrame:
    """Means of every slot of *step_us*, slots without records as rows of missing values; *us* is the slot's start."""
    slotted = rows.withColumn(us, F.expr(f"{us} - pmod({us}, {step_us})"))
    return complete_grid(slotted.groupBy(*keys, us).agg(*[F.avg(c).alias(c) for c in cols]), keys, us, step_us)


def gap_fractions(grid: DataFrame, keys, cols) -> DataFrame:
    """Share of slots of each series in which a channel is missing: ``<c>_gap``, and the number of slots."""
    return grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("slots"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_gap") for c in cols])


def settling_samples(fs: float, order: int, low: float | None = None, high: float | None = None, left: float = 1e-12) -> int:
    """Samples after which a zero-phase Butterworth response has died to *left*, from its slowest pole."""
    edge = min(low, (high - low) / 2) if low and high else low or high
    return ceil(-log(left) / (2 * pi * edge * sin(pi / (2 * order))) * fs)


def map_chunks(rows: DataFrame, keys, us: str, step_us: int, cols, fn: Callable[..., dict], schema: str, chunk: int, halo: int) -> DataFrame:
    """*fn* takes the arrays of *cols* and returns equally long arrays named as in *schema*, ``"name type, ..."``.

    *rows* hold one row per slot of *step_us*; *chunk* and *halo* count slots. A sample goes to its own chunk and to those
    whose halo it lies in, 1 + 2 * halo / chunk of them on average. A missing value in a chunk makes its results missing.
    """
    keys, cols = list(keys), list(cols)
    types = {name: _TYPES[kind] for name, kind in (part.split() for part in schema.split(", "))}
    slot = f"({us} - pmod({us}, {step_us})) div {step_us}"
    reach = lambda by: F.floor((F.expr(slot) + by) / chunk).cast("long")
    parts = rows.select(*keys, us, *cols, F.explode(F.sequence(reach(-halo), reach(halo))).alias("_part"))
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, piece: pa.Table) -> pa.Table:
        piece = piece.sort_by(us)
        at = piece[us].to_numpy()
        own = (at // step_us) // chunk == key[-1].as_py()
        arrays = [piece[c].to_numpy().astype(float) for c in cols]
        missing = any(np.isnan(a).any() for a in arrays)
        found = fn(*arrays) if own.any() and not missing else {n: np.full(len(at), np.nan) for n in types}
        # what is not a number is missing
        values = [pa.array(found[n][own], from_pandas=True).cast(t) for n, t in types.items()]
        return pa.table([*[piece[k].filter(pa.array(own)) for k in keys], pa.array(at[own]), *values], names=[*keys, us, *types])

    return parts.groupBy(*keys, "_part").applyInArrow(run, f"{key_types}, {us} long, {schema}")
