"""Planar fits and rotation of all sonics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.wind import planar_fit_rotate, yaw_rotate

SUMS = ("n", "su", "sv", "sw", "suu", "svv", "suv", "suw", "svw")


def _sums(u: str, v: str, w: str) -> list[Column]:
    ok = F.col(u).isNotNull() & F.col(v).isNotNull() & F.col(w).isNotNull()
    cu, cv, cw = F.when(ok, F.col(u)), F.when(ok, F.col(v)), F.when(ok, F.col(w))
    return [F.count(F.when(ok, 1)).alias("n"), F.sum(cu).alias("su"), F.sum(cv).alias("sv"), F.sum(cw).alias("sw"),
            F.sum(cu * cu).alias("suu"), F.sum(cv * cv).alias("svv"), F.sum(cu * cv).alias("suv"),
            F.sum(cu * cw).alias("suw"), F.sum(cv * cw).alias("svw")]


def solve(df: DataFrame, keys, min_points: int = 4) -> DataFrame:
    """Coefficients and tilt angles from the nine sums; missing when too few points or singular."""
    n = F.col("n")
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / n
    d = df.filter(n >= min_points).withColumns({
        "_uu": c("suu", "su", "su"), "_vv": c("svv", "sv", "sv"), "_uv": c("suv", "su", "sv"),
        "_uw": c("suw", "su", "sw"), "_vw": c("svw", "sv", "sw")})
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    d = d.withColumn("_det", F.when(det > 1e-12 * F.col("_uu") * F.col("_vv"), det)).filter("_det is not null")
    b1 = (F.col("_uw") * F.col("_vv") - F.col("_vw") * F.col("_uv")) / F.col("_det")
    b2 = (F.col("_vw") * F.col("_uu") - F.col("_uw") * F.col("_uv")) / F.col("_det")
    d = d.withColumns({"b1": b1, "b2": b2})
    b0 = (F.col("sw") - F.col("b1") * F.col("su") - F.col("b2") * F.col("sv")) / n
    tilt = lambda x: F.degrees(F.asin(x / F.sqrt(1.0 + x * x)))
    return d.select(*keys, "n", b0.alias("b0"), "b1", "b2", tilt(-F.col("b1")).alias("pitch_deg"),
                    tilt(F.col("b2")).alias("roll_deg"))


def planar_fit(df: DataFrame, keys, u="u", v="v", w="w", min_points: int = 4) -> DataFrame:
    """Least-squares plane w = b0 + b1 u + b2 v per key."""
    return solve(df.groupBy(*keys).agg(*_sums(u, v, w)), keys, min_points)


def sector_fits(df: DataFrame, keys, direction: str, edges: list[float], min_points: int = 4) -> DataFrame:
    """One fit per ``(lo, hi]`` sector and one over all directions (both bounds zero)."""
    from ..functions.wind import in_sector

    spec = [(0.0, 0.0)] + [(a, edges[(i + 1) % len(edges)]) for i, a in enumerate(edges)]
    arr = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in spec])
    rows = df.withColumn("_s", F.explode(arr)).filter(
        F.coalesce(in_sector(F.col(direction), F.col("_s.lo"), F.col("_s.hi")), F.lit(False)))
    rows = rows.withColumns({"sector_lo": F.col("_s.lo"), "sector_hi": F.col("_s.hi")}).drop("_s")
    return planar_fit(rows, [*keys, "sector_lo", "sector_hi"], min_points=min_points)


def cumulative_fits(df: DataFrame, keys, day: str, min_points: int = 4) -> DataFrame:
    """The fit of each day (``kind`` day) and of all days so far (``kind`` so_far)."""
    keys = list(keys)
    daily = df.groupBy(*keys, day).agg(*_sums("u", "v", "w"))
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    so_far = daily.select(*keys, day, *[F.sum(s).over(w).alias(s) for s in SUMS])
    both = daily.withColumn("kind", F.lit("day")).unionByName(so_far.withColumn("kind", F.lit("so_far")))
    return solve(both, [*keys, day, "kind"], min_points)


def bootstrap_tilt(df: DataFrame, keys, order: str, n_boot: int, seed: int = 0, min_fits: int = 10) -> DataFrame:
    """Population sd of pitch and roll over resamples with replacement.

    Draw *j* of replicate *r* takes the point ``md5(seed, keys, r, j) mod n``;
    the draws are rows, so replicates run in parallel and a retry repeats the
    same sample. Keys draw independently of each other.
    *df* holds period means (one row per point).
    """
    keys = list(keys)
    pts = df.filter("u is not null and v is not null and w is not null")
    pts = pts.select(*keys, "u", "v", "w", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("long").alias("i"))
    size = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)).cast("array<bigint>"))
    name = F.concat_ws("|", F.lit(str(int(seed))), *[F.col(k).cast("string") for k in keys], F.col("r").cast("string"), F.col("j").cast("string"))
    mixed = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    draws = (pts.select(*keys, F.col("i").alias("j")).join(size, keys).withColumn("r", reps)
             .select(*keys, "r", F.pmod(mixed, F.col("n")).alias("i")))
    fits = planar_fit(draws.join(pts, [*keys, "i"]), [*keys, "r"])
    return (fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fits"), F.stddev_pop("pitch_deg").alias("sd_pitch"),
                                    F.stddev_pop("roll_deg").alias("sd_roll"))
            .filter(F.col("n_fits") >= min_fits))


def direction_gap_edges(df: DataFrame, keys, direction: str, bin_deg: float) -> DataFrame:
    """Sector edges at the centre of every circular run of empty direction bins."""
    keys, n_bins = list(keys), int(round(360.0 / bin_deg))
    hist = df.filter(F.col(direction).isNotNull()).groupBy(
        *keys, F.floor(F.pmod(F.col(direction), F.lit(360.0)) / bin_deg).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    # from each filled bin to the next one on the circle; the bins between are the gap
    w = W.partitionBy(*keys).orderBy("bin")
    first = F.min("bin").over(W.partitionBy(*keys))
    nxt = F.coalesce(F.lead("bin").over(w), first + n_bins)
    gap = F.col("next") - F.col("bin") - 1
    centre = F.pmod((F.col("bin") + 1) * bin_deg + gap * bin_deg / 2.0, F.lit(360.0))
    return hist.withColumn("next", nxt).filter(gap > 0).select(*keys, centre.alias("edge"), gap.alias("empty_bins"))


def apply_fit(df: DataFrame, fits: DataFrame, on, suffix: str = "_r") -> DataFrame:
    """Winds in the fitted plane; a row without coefficients keeps missing winds."""
    on = list(on)
    j = df.join(fits.select(*on, "b0", "b1", "b2"), on, "left")
    u, v, w = planar_fit_rotate(*[F.col(c) for c in ("u", "v", "w", "b0", "b1", "b2")])
    return j.select(*df.columns, u.alias("u" + suffix), v.alias("v" + suffix), w.alias("w" + suffix))


def apply_yaw(df: DataFrame, keys, u: str, v: str) -> DataFrame:
    """Rotate each period into its own mean wind; the mean is an aggregate joined back."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(u).alias("_mu"), F.avg(v).alias("_mv"))
    j = df.join(mean, keys)
    ur, vr = yaw_rotate(F.col(u), F.col(v), F.col("_mu"), F.col("_mv"))
    return j.withColumns({u: ur, v: vr}).drop("_mu", "_mv")


def friction_velocity_double_rotation(df: DataFrame, keys, min_rows: int = 100) -> DataFrame:
    """u* after streamwise double rotation; one aggregate, because the rotation is linear."""
    ok = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("w").isNotNull()
    g = df.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("w").alias("mw"),
        F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.var_pop("w").alias("ww"),
        F.covar_pop("u", "v").alias("uv"), F.covar_pop("u", "w").alias("uw"), F.covar_pop("v", "w").alias("vw"))
    g = g.filter(F.col("n") >= min_rows)
    th = F.atan2("mv", "mu")
    c, s = F.cos(th), F.sin(th)
    mean_u1 = F.col("mu") * c + F.col("mv") * s
    ph = F.atan2(F.col("mw"), mean_u1)
    cp, sp = F.cos(ph), F.sin(ph)
    # covariances after the first rotation
    u1u1 = c * c * F.col("uu") + 2 * c * s * F.col("uv") + s * s * F.col("vv")
    u1w, v1w = c * F.col("uw") + s * F.col("vw"), c * F.col("vw") - s * F.col("uw")
    u1v1 = c * s * (F.col("vv") - F.col("uu")) + (c * c - s * s) * F.col("uv")
    uw = cp * sp * (F.col("ww") - u1u1) + (cp * cp - sp * sp) * u1w
    vw = cp * v1w - sp * u1v1
    return g.select(*keys, "n", F.pow(uw * uw + vw * vw, F.lit(0.25)).alias("ustar_double"),
                    F.pow(F.col("uw") * F.col("uw") + F.col("vw") * F.col("vw"), F.lit(0.25)).alias("ustar_rotated"))


def local_rotation(df: DataFrame, file_keys, period_keys, good: Column) -> DataFrame:
    """Fit each file on its good period means, then planar fit and yaw of every sample."""
    means = df.filter(good).groupBy(*period_keys).agg(*[F.avg(c).alias(c) for c in ("u", "v", "w")])
    fits = planar_fit(means, file_keys)
    return apply_yaw(apply_fit(df, fits, file_keys), period_keys, "u_r", "v_r")


def global_fit_job(periods: DataFrame, keys, order: str, chunk: int, flags, edges: list[float], windows: DataFrame,
                   on, day: str, step: int = 1) -> DataFrame:
    """Global fit table from period means: admit, step down, split by date window, fit sectors."""
    from ..functions.wind import direction_speed
    from .periods import step_down
    from .qc import in_windows, planar_fit_admission

    admitted = planar_fit_admission(periods, flags, F.hypot("u", "v"))
    split = in_windows(admitted, windows, on, day)
    stepped = step_down(split, [*keys, "window"], order, ["u", "v", "w"], step, chunk)
    direction, _ = direction_speed(F.col("u"), F.col("v"), F.lit(0.0))
    return sector_fits(stepped.withColumn("direction", direction), [*keys, "window"], "direction", edges)
