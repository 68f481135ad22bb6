"""Motion correction of platform winds on regular series of any length.

Records are put on a grid, gaps of the attitude channels are filled and reported, and zero-phase filters run on chunks
with a halo as long as they take to settle (see `chunks`), so no row or task holds a file or a day. The per-sample
geometry is column algebra. *keys* name a series; angles are radians, rates rad/s, accelerations specific force in m/s2.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import attitude as at
from . import scan
from .chunks import gap_fractions, map_chunks, on_grid, settling_samples
from .kernels import butterworth_zero_phase
from .sequence import fill_linear, unwrap

WIND, ACCEL, GYRO, ANGLES = ["u", "v", "w"], ["ax", "ay", "az"], ["p", "q", "r"], ["roll", "pitch", "yaw"]
#: Samples of a chunk without its halo.
CHUNK = 36_000


def regular(rows: DataFrame, keys, us: str, step_us: int, filled: Sequence[str], kept: Sequence[str] = (), chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(samples, gaps): slot means of all columns with *filled* interpolated over gaps, and each channel's share of gaps.

    Ends are held. A channel without any value stays missing in the whole series.
    """
    grid = on_grid(rows, keys, us, step_us, [*filled, *kept])
    out = fill_linear(grid, keys, us, filled, chunk * step_us)
    return out.select(*keys, us, *[F.col(f"{c}_filled").alias(c) for c in filled], *kept), gap_fractions(grid, keys, filled)


def _filtered_integral(x: np.ndarray, fs: float, edge: float, order: int) -> np.ndarray:
    """High-passed trapezoid integral; where a chunk starts only shifts the integral, which the filter removes."""
    steps = np.r_[0.0, np.cumsum((x[1:] + x[:-1]) / (2 * fs))]
    return butterworth_zero_phase(steps, fs, order, low=edge)


def complementary_attitude(samples: DataFrame, keys, us: str, step_us: int, cutoff_s: float, order: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Low-passed accelerometer tilt plus high-passed integrated rates: (us, roll, pitch, yaw) of gap-free samples."""
    edge, fs = 1.0 / cutoff_s, 1e6 / step_us

    def kernel(ax, ay, az, p, q, r):
        roll = butterworth_zero_phase(np.arctan2(ay, az), fs, order, high=edge)
        pitch = butterworth_zero_phase(np.arctan2(-ax, np.hypot(ay, az)), fs, order, high=edge)
        s = q * np.sin(roll) + r * np.cos(roll)
        rates = (p + np.tan(pitch) * s, q * np.cos(roll) - r * np.sin(roll), s / np.cos(pitch))
        quick = [_filtered_integral(x, fs, edge, order) for x in rates]
        return {"roll": roll + quick[0], "pitch": pitch + quick[1], "yaw": quick[2]}

    return map_chunks(samples, keys, us, step_us, ACCEL + GYRO, kernel, "roll double, pitch double, yaw double", chunk,
                      2 * settling_samples(fs, order, edge))


def platform_velocity(samples: DataFrame, keys, us: str, step_us: int, cutoff_s: float, order: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Earth-frame velocity (us, vx, vy, vz): rotate, remove gravity, high-pass, integrate, high-pass."""
    edge, fs = 1.0 / cutoff_s, 1e6 / step_us
    m = at.rotation_matrix(*[F.col(c) for c in ANGLES])
    e = at.apply_matrix(m, [F.col(c) for c in ACCEL])
    earth = samples.select(*keys, us, e[0].alias("ex"), e[1].alias("ey"), (e[2] - at.GRAVITY).alias("ez"))

    def kernel(*axes):
        return {name: _filtered_integral(butterworth_zero_phase(a, fs, order, low=edge), fs, edge, order) for name, a in zip(("vx", "vy", "vz"), axes)}

    return map_chunks(earth, keys, us, step_us, ["ex", "ey", "ez"], kernel, "vx double, vy double, vz double", chunk,
                      2 * settling_samples(fs, order, edge))


def lever_arms(height: str, arms: Mapping[float, Sequence[float]], default: Sequence[float]) -> list[Column]:
    """The lever arm of each row's sonic level as three columns."""
    out = [F.lit(float(x)) for x in default]
    for level, arm in arms.items():
        out = [F.when(F.col(height) == level, F.lit(float(a))).otherwise(o) for a, o in zip(arm, out)]
    return out


def _heading(samples: DataFrame, keys, us: str, step_us: int, yaw: str, chunk: int) -> DataFrame:
    if yaw == "zero":
        return samples.withColumn("yaw", F.lit(0.0))
    smooth = unwrap(samples, keys, us, "yaw", 2 * np.pi, chunk * step_us, "_yaw").withColumn("yaw", F.col("_yaw")).drop("_yaw")
    if yaw == "full":
        return smooth
    mean = smooth.groupBy(*keys).agg(F.avg("yaw").alias("_mean"))
    return smooth.join(mean, keys).withColumn("yaw", F.col("yaw") - F.col("_mean")).drop("_mean")


def _rates_of_angles(samples: DataFrame, keys, us: str, step_us: int, chunk: int) -> DataFrame:
    """Body rates from central differences of the angles, one-sided at the ends; one pass for the three."""
    near = scan.neighbours(samples, keys, us, [us, *ANGLES], chunk * step_us)
    steps = F.col(f"prev_{us}").isNotNull().cast("int") + F.col(f"next_{us}").isNotNull().cast("int")
    per_s = [F.try_divide(F.coalesce(f"next_{c}", c) - F.coalesce(f"prev_{c}", c), steps) * (1e6 / step_us) for c in ANGLES]
    return near.withColumns(dict(zip(GYRO, at.body_rates(F.col("roll"), F.col("pitch"), *per_s)))).select(*samples.columns, *GYRO)


def correct_wind(rows: DataFrame, keys, us: str, step_us: int, lever, attitude: str = "fused", accel: bool = True, gyro: bool = True,
                 attitude_cutoff_s: float = 20.0, velocity_cutoff_s: float = 20.0, order: int = 4, yaw: str = "demean",
                 chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(samples, gaps): earth-frame winds T u + T (omega x r) + v per slot, and the gap shares of the attitude channels.

    *rows* hold u v w and, as given, ax ay az (*accel*), p q r (*gyro*), roll pitch yaw (*attitude* ``fused``, else
    ``complementary``, which needs the other six). Without accelerations the platform velocity is 0; without rates they are
    differentiated from the attitude. *lever* is three numbers or columns of *keys* (see `lever_arms`). *yaw* is ``demean``
    (of the unwrapped angle, per series), ``full`` or ``zero``. Missing winds stay missing; a series without any value in a
    channel that is needed has missing winds throughout.
    """
    keys = list(keys)
    if yaw not in ("demean", "full", "zero") or attitude not in ("fused", "complementary"):
        raise ValueError(f"no such handling: yaw {yaw!r}, attitude {attitude!r}")
    if attitude == "complementary" and not (accel and gyro):
        raise ValueError("the complementary attitude needs accelerations and rates")
    channels = ACCEL * accel + GYRO * gyro + ANGLES * (attitude == "fused")
    samples, gaps = regular(rows, keys, us, step_us, channels, WIND, chunk)
    if attitude == "complementary":
        samples = samples.join(complementary_attitude(samples, keys, us, step_us, attitude_cutoff_s, order, chunk), [*keys, us])
    samples = _heading(samples, keys, us, step_us, yaw, chunk)
    if not gyro:
        samples = _rates_of_angles(samples, keys, us, step_us, chunk)
    if accel:
        samples = samples.join(platform_velocity(samples, keys, us, step_us, velocity_cutoff_s, order, chunk), [*keys, us])
    else:
        samples = samples.withColumns({c: F.lit(0.0) for c in ("vx", "vy", "vz")})
    m = at.rotation_matrix(*[F.col(c) for c in ANGLES])
    wind = at.apply_matrix(m, [F.col(c) for c in WIND])
    spin = at.apply_matrix(m, at.cross([F.col(c) for c in GYRO], list(lever)))
    true = [(a + b + F.col(c)).alias(n) for a, b, c, n in zip(wind, spin, ("vx", "vy", "vz"), ("u_true", "v_true", "w_true"))]
    return samples.select(*keys, us, *true, *ANGLES, "vx", "vy", "vz"), gaps


def band_variance(rows: DataFrame, keys, us: str, step_us: int, x: str, lo: float, hi: float, order: int = 4, min_valid: int = 200,
                  chunk: int = CHUNK) -> DataFrame:
    """Variance inside a frequency band per series, gaps filled; missing with fewer than *min_valid* valid slots."""
    fs = 1e6 / step_us
    samples, gaps = regular(rows, keys, us, step_us, [x], (), chunk)
    bands = map_chunks(samples, keys, us, step_us, [x], lambda a: {"b": butterworth_zero_phase(a, fs, order, low=lo, high=hi)}, "b double",
                       chunk, settling_samples(fs, order, lo, hi))
    found = bands.groupBy(*keys).agg(F.var_pop("b").alias("_var"))
    valid = F.round(F.col("slots") * (1 - F.col(f"{x}_gap")))
    return gaps.join(found, list(keys), "left").select(*keys, F.when(valid >= min_valid, F.col("_var")).alias("band_var"), valid.cast("long").alias("valid"))


def heave_velocity(samples: DataFrame, keys, us: str, step_us: int, az: str, lo: float, hi: float, order: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Band-passed vertical velocity (us, heave) of the vertical specific force in g of gap-free samples."""
    fs = 1e6 / step_us

    def kernel(a):
        quick = butterworth_zero_phase((a - 1.0) * at.GRAVITY, fs, order, low=lo, high=hi)
        return {"heave": butterworth_zero_phase(np.cumsum(quick) / fs, fs, order, low=lo, high=hi)}

    return map_chunks(samples, keys, us, step_us, [az], kernel, "heave double", chunk, 2 * settling_samples(fs, order, lo, hi))
