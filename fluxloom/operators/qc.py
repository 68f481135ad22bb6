"""Quality control: limits, spikes, flags, blanking, validation and attitude screening."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from . import scan, sequence
from .joins import linear_value
from .quantiles import median_exceeds


def absolute_limits(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside the closed range of their class become missing."""
    return df.select(*[
        F.when(F.col(c).between(*limits[c]), F.col(c)).alias(c) if c in limits else F.col(c) for c in df.columns])


def kelvin_to_celsius(df: DataFrame, keys, col: str) -> DataFrame:
    """Series whose median exceeds 250 are read as Kelvin."""
    units = df.groupBy(*keys).agg(median_exceeds(F.col(col), 250.0).alias("_kelvin"))
    return df.join(units, list(keys)).withColumn(
        col, F.when(F.col("_kelvin"), F.col(col) - 273.15).otherwise(F.col(col))).drop("_kelvin")


def infer_unit(df: DataFrame, keys, temperature: str, pressure: str) -> DataFrame:
    """Temperature and pressure unit per series by the size of its median."""
    return df.groupBy(*keys).agg(
        F.when(median_exceeds(F.col(temperature), 200.0), "K").otherwise("degC").alias("temperature_unit"),
        F.when(median_exceeds(F.col(pressure), 50_000.0), "Pa")
        .when(median_exceeds(F.col(pressure), 200.0), "hPa").otherwise("kPa").alias("pressure_unit"))


#: Passes after which despiking ends even if a pass still flags something, as in the reference.
MOST_PASSES = 20


def sigma_spikes(df: DataFrame, keys, us: str, cols: dict[str, float], window_us: int, active: DataFrame | None = None,
                 cut: Callable[[DataFrame], DataFrame] = lambda stats: stats, sides: bool = False) -> DataFrame:
    """Add ``<c>_spike``: beyond k standard deviations in one of its two half-overlapping windows.

    One pass. Every row belongs to two windows of length *window_us*; the
    window statistics are aggregates joined back, not sorted windows. With *active* (keys, _win) only those windows
    are tested, and with *sides* ``<c>_spike_a`` and ``<c>_spike_b`` tell which of the two flagged the row.
    *cut* may write the statistics to a table.
    """
    keys = list(keys)
    half = window_us // 2
    slot = F.expr(f"{us} - pmod({us}, {half}L)")
    both = df.withColumn("_win", F.explode(F.array(slot, slot - half)))
    if active is not None:
        both = both.join(active, [*keys, "_win"], "left_semi")
    stats = both.groupBy(*keys, "_win").agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    stats, out = cut(stats), df
    for name, start in (("a", slot), ("b", slot - half)):
        side = stats.select(*keys, "_win", *[F.col(f"_m_{c}").alias(f"_m{name}_{c}") for c in cols],
                            *[F.col(f"_s_{c}").alias(f"_s{name}_{c}") for c in cols])
        out = out.withColumn("_win", start).join(side, [*keys, "_win"], "left").drop("_win")
    hit = lambda c, k, n: F.coalesce(F.abs(F.col(c) - F.col(f"_m{n}_{c}")) >= k * F.nullif(F.col(f"_s{n}_{c}"), F.lit(0.0)), F.lit(False))
    each = [hit(c, k, n).alias(f"{c}_spike_{n}") for c, k in cols.items() for n in "ab"] if sides else []
    return out.select(*df.columns, *[(hit(c, k, "a") | hit(c, k, "b")).alias(f"{c}_spike") for c, k in cols.items()], *each)


def unflag_long_runs(df: DataFrame, keys, us: str, flag: str, longest: int, chunk: int) -> DataFrame:
    """Flagged runs of more than *longest* rows are signal: their flag is cleared."""
    keys = list(keys)
    marked = sequence.runs(df, keys, us, F.col(flag), chunk, "_run")
    size = marked.filter(F.col(flag)).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    out = marked.join(size, [*keys, "_run"], "left")
    return out.withColumn(flag, F.col(flag) & F.coalesce(F.col("_n") <= longest, F.lit(False))).drop("_run", "_n")


def interpolate_spikes(df: DataFrame, keys, us: str, col: str, flag: str, chunk: int,
                       max_bad: float = 0.6) -> DataFrame:
    """Spikes take the line between good neighbours of the same window (*keys*).

    Edge spikes become missing; the whole column of a window becomes missing
    with fewer than two good samples or more than *max_bad* bad ones.
    """
    keys = list(keys)
    good = df.withColumn("_good", F.when(~F.col(flag), F.col(col)))
    stats = good.groupBy(*keys).agg(F.count("_good").alias("_k"), F.count(F.lit(1)).alias("_n"))
    b = scan.brackets(good, keys, us, ["_good"], chunk).join(stats, keys)
    usable = (F.col("_k") >= 2) & (F.col("_n") - F.col("_k") <= max_bad * F.col("_n"))
    repaired = F.when(F.col(flag), linear_value("_good", us)).otherwise(F.col(col))
    return b.select(*df.columns, F.when(usable, repaired).alias(f"{col}_clean"))


def _short_runs(flagged: DataFrame, keys, pos: str, longest: int, part: int = 1 << 16) -> DataFrame:
    """Rows of *flagged* whose run of consecutive positions has at most *longest* rows.

    Positions are dealt to parts with *longest* neighbours on both sides, which is as far as a run has to be seen.
    """
    keys = list(keys)
    reach = lambda by: F.expr(f"({pos} + {by}) div {part}")
    dealt = flagged.withColumn("_part", F.explode(F.sequence(reach(-longest), reach(longest))))
    order = W.partitionBy(*keys, "_part").orderBy(pos)
    dealt = dealt.withColumn("_run", F.col(pos) - F.row_number().over(order))
    sized = dealt.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy(*keys, "_part", "_run")))
    return sized.filter((F.col("_size") <= longest) & (F.col("_part") == F.expr(f"{pos} div {part}"))).select(flagged.columns)


def despike_passes(df: DataFrame, keys, us: str, cols: dict[str, float], window_us: int, longest: int,
                   passes: int, chunk: int, cut, repair_keys=None, max_bad: float = 0.6) -> DataFrame:
    """Scalable repeated despiking: flag, keep long runs, repair; *cut* writes each pass to a table.

    It ends when a pass flags nothing, or after *passes*. A window in which a pass flags nothing is clean and not tested
    again. Repairs use the good neighbours of the same *repair_keys* (default *keys*). All windows of a pass see the same input, so the result does not depend
    on the order of windows; the order-dependent form is :func:`despike_to_convergence`.

    Rows are numbered once per series, so runs are found among the flagged rows alone. Window statistics and flagged rows
    are written before they are joined back: their size is known, and as long as they are small no pass shuffles its rows
    for them.
    """
    keys, names = list(keys), df.columns
    repair, half = keys if repair_keys is None else list(repair_keys), window_us // 2
    small = lambda rows: cut_lineage(rows, "despike-part")
    slots = {"a": F.expr(f"{us} - pmod({us}, {half}L)"), "b": F.expr(f"{us} - pmod({us}, {half}L) - {half}L")}
    out = small(scan.row_index(df, keys, us, chunk, "_pos"))
    active = None
    for _ in range(passes):
        tested = sigma_spikes(out, keys, us, cols, window_us, active, small, sides=True)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), *[F.col(f"{c}_spike{x}").alias(f"f{x}") for x in ("", "_a", "_b")]) for c in cols])).alias("_at")
        flagged = tested.select(*keys, us, "_pos", each).select(*keys, us, "_pos", "_at.*").filter("f")
        short = _short_runs(flagged, [*keys, "c"], "_pos", longest)
        mine = lambda c, f: F.coalesce(F.bool_or(F.when(F.col("c") == c, F.col(f))), F.lit(False))
        windows = F.array_compact(F.array(*[F.when(F.bool_or(f"f_{n}"), at) for n, at in slots.items()]))
        spikes = small(short.groupBy(*keys, us, "_pos").agg(windows.alias("_hit"), *[mine(c, "f").alias(f"_spike_{c}") for c in cols]))
        active = spikes.select(*keys, F.explode("_hit").alias("_win")).distinct()
        marked = out.join(spikes.drop(us, "_hit"), [*keys, "_pos"], "left")
        good = marked.withColumns({f"_good_{c}": F.when(~F.coalesce(f"_spike_{c}", F.lit(False)), F.col(c)) for c in cols})
        counts = small(good.groupBy(*repair).agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"_good_{c}").alias(f"_k_{c}") for c in cols]))
        b = scan.brackets(good, repair, us, [f"_good_{c}" for c in cols], chunk).join(counts, repair)

        def clean(c: str) -> Column:
            usable = (F.col(f"_k_{c}") >= 2) & (F.col("_n") - F.col(f"_k_{c}") <= max_bad * F.col("_n"))
            return F.when(usable, F.when(F.col(f"_spike_{c}"), linear_value(f"_good_{c}", us)).otherwise(F.col(c)))

        out = cut(b.select(*[clean(c).alias(c) if c in cols else F.col(c) for c in names], "_pos"))
        if spikes.isEmpty():
            break
    return out.select(*names)


def _short_outliers(block: np.ndarray, limits: np.ndarray, longest: int) -> np.ndarray:
    """Where a column lies *limits* standard deviations or more from its mean, runs of more than *longest* rows excepted."""
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.abs(block - np.nanmean(block, axis=0)) / np.nanstd(block, axis=0)
        out = np.isfinite(score) & (score >= limits)
    for c in np.flatnonzero(out.any(axis=0)):
        run = np.cumsum(np.diff(out[:, c], prepend=out[0, c]))
        out[:, c] &= np.bincount(run)[run] <= longest
    return out


def _bridged(x: np.ndarray, spikes: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """A line over the spikes between good rows; nothing is left of a window with under two good rows or two fifths of them."""
    good = np.flatnonzero(~(spikes | missing))
    if len(good) < 2 or 5 * len(good) < 2 * len(x):
        return np.full(len(x), np.nan)
    at, out = np.flatnonzero(spikes), x.copy()
    out[at] = np.interp(at, good, x[good], left=np.nan, right=np.nan)
    return out


def _despike_table(values: np.ndarray, limits: np.ndarray, n_windows: int, longest: int, max_runs: int):
    """Repair one file-day: (values, spikes). Windows overlap by half and are visited in order, again until each is clean."""
    out, missing, spikes = values.copy(), np.isnan(values), np.zeros(values.shape, dtype=bool)
    edges = np.rint(np.linspace(0, len(values), n_windows + 2)).astype(int)
    todo = [slice(a, b) for a, b in zip(edges, edges[2:]) if b > a]

    def repaired(window: slice) -> bool:
        hit = _short_outliers(out[window], limits, longest)
        if hit.any():
            spikes[window] |= hit
            out[window] = np.stack([_bridged(*cols) for cols in zip(out[window].T, hit.T, missing[window].T)], axis=1)
        return bool(hit.any())

    for _ in range(max_runs):
        todo = [window for window in todo if repaired(window)]
        if not todo:
            break
    return out, spikes


def despike_to_convergence(df: DataFrame, keys, day: str, us: str, cols: dict[str, float], windows_per_day: int,
                           longest: int = 10, max_runs: int = 20) -> DataFrame:
    """Order-dependent despiking of one table and file-day per group (bounded by rate times one day)."""
    names, limits = list(cols), np.array(list(cols.values()))
    keys = list(keys)
    fields = ", ".join(f"{c} double, {c}_spike boolean" for c in names)
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, day))

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(us)
        out, spikes = _despike_table(pdf[names].to_numpy(float), limits, windows_per_day, longest, max_runs)
        for i, c in enumerate(names):
            pdf[c], pdf[f"{c}_spike"] = out[:, i], spikes[:, i]
        return pdf

    work = df.select(*keys, day, us, *names)
    out = work.groupBy(*keys, day).applyInPandas(repair, f"{key_types}, {us} bigint, {fields}")
    return out.select(*keys, day, us, *[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in names],
                      *[f"{c}_spike" for c in names])


def period_flags(df: DataFrame, keys, flags: dict[str, float]) -> DataFrame:
    """Flags whose share of a period reaches the threshold (a fraction)."""
    return df.groupBy(*keys).agg(*[
        (F.avg(F.col(f).cast("double")) >= share).alias(f) for f, share in flags.items()])


def diagnostic_flags(df: DataFrame, keys, sonic: str, signal: str, gas: str, sonic_limit: float,
                     signal_limit: float, gas_limit: float, reversed_polarity: bool = False) -> DataFrame:
    """Period-mean diagnostics against their limits.

    A missing sonic diagnostic counts as zero, a missing gas value as unflagged;
    *reversed_polarity* is the analyser whose good diagnostic is the high one.
    """
    gas_mean = F.avg(gas)
    return df.groupBy(*keys).agg(
        (F.coalesce(F.avg(sonic), F.lit(0.0)) >= sonic_limit).alias("sonic_flag"),
        F.coalesce(F.avg(signal) <= signal_limit, F.lit(False)).alias("signal_flag"),
        F.coalesce((gas_mean <= gas_limit) if reversed_polarity else (gas_mean >= gas_limit), F.lit(False)).alias("gas_flag"))


def frame_flags(u: Column, v: Column, w: Column, diagnostic: Column) -> dict[str, Column]:
    """Union of channel flags per coordinate frame."""
    return {"unrot": w | diagnostic, "rot": u | v | w | diagnostic}


# which flags void which output (fixed rules)
VOIDED_BY = {
    "w_sigma_raw": "unrot", "u_sigma_raw": "rot", "v_sigma_raw": "rot", "u_sigma_pf": "rot", "v_sigma_pf": "rot",
    "w_sigma_pf": "rot", "ts_sigma": "tsf", "t_fw_sigma": "fwf", "h2o_sigma": "rot tsf", "co2_sigma": "rot tsf",
    "Tau_raw": "rot", "Tau_pf": "rot", "u_var_pf": "rot", "v_var_pf": "rot", "w_var_pf": "rot",
    "u_v_cov_pf": "rot", "u_w_cov_pf": "rot", "v_w_cov_pf": "rot", "TKE": "rot", "TKE_transport_pf": "rot",
    "u_w_transport_pf": "rot", "w_theta_v_transport_pf": "rot", "ts_var_transport_pf": "rot tsf",
    "u_w_eta_pf": "rot tsf", "w_theta_v_eta_pf": "rot tsf", "w_h2o_eta_pf": "rot tsf", "w_co2_eta_pf": "rot tsf",
    "u_w_delta_flux_pf": "rot tsf", "w_theta_v_delta_flux_pf": "rot tsf",
    "u_w_delta_time_pf": "rot tsf", "w_theta_v_delta_time_pf": "rot tsf",
    "u_w__w_theta_v_corr_pf": "rot tsf", "w_u_corr_pf": "rot tsf", "w_theta_v_corr_pf": "rot tsf",
    "w_h2o_corr_pf": "rot tsf", "w_co2_corr_pf": "rot tsf",
    "w_ts_cov_raw": "unrot tsf", "w_theta_v_cov_pf": "rot tsf", "w_t_air_cov_raw": "unrot tsf h2of",
    "w_t_air_cov_pf": "rot tsf h2of", "w_t_fw_cov_raw": "unrot fwf", "w_t_fw_cov_pf": "rot fwf",
    "u_ts_cov_raw": "rot tsf", "v_ts_cov_raw": "rot tsf", "u_ts_cov_pf": "rot tsf", "v_ts_cov_pf": "rot tsf",
    "w_h2o_cov_raw": "unrot h2of", "w_h2o_cov_pf": "rot h2of", "LE_wpl_raw": "unrot h2of", "LE_wpl_pf": "unrot h2of",
    "w_co2_cov_raw": "unrot co2f", "w_co2_cov_pf": "rot co2f", "Fc_wpl_pf": "rot co2f", "L": "rot tsf",
    "theta_star": "rot tsf", "q_star": "rot h2of", "epsilon": "rot", "u_skew_pf": "rot", "v_skew_pf": "rot",
    "w_skew_pf": "rot", "theta_v_skew": "rot", "h2o_skew": "rot", "co2_skew": "rot",
    "u_theta_v_cov_pf": "rot", "u_h2o_cov_pf": "rot", "u_co2_cov_pf": "rot",
    **dict.fromkeys(("u_theta_v_cov_snsp", "v_theta_v_cov_snsp", "w_theta_v_cov_snsp", "w_theta_v_cov_vertical", "w_theta_s_cov_pf",
                     "u_theta_s_cov_raw", "v_theta_s_cov_raw", "u_theta_s_cov_pf", "v_theta_s_cov_pf", "co2_wpl_sigma"), "rot tsf"),
    "w_theta_s_cov_raw": "unrot tsf",
    **dict.fromkeys(("w_theta_fw_cov_raw", "w_theta_v_fw_cov_raw"), "unrot fwf"),
    **dict.fromkeys(("w_theta_fw_cov_pf", "w_theta_v_fw_cov_pf", "u_theta_fw_cov_raw", "v_theta_fw_cov_raw", "u_theta_fw_cov_pf",
                     "v_theta_fw_cov_pf"), "rot fwf"),
    **dict.fromkeys(("u_var_tilt", "v_var_tilt", "w_var_tilt", "u_v_cov_tilt", "u_w_cov_tilt", "v_w_cov_tilt", "h2o_wpl_skew", "co2_wpl_skew",
                     "u_h2o_wpl_cov_pf", "u_co2_wpl_cov_pf", "w_h2o_transport_pf", "w_h2o_wpl_transport_pf", "w_co2_transport_pf",
                     "w_co2_wpl_transport_pf"), "rot"),
    **dict.fromkeys(("w_h2o_wpl_cov_pf", "w_q_wpl_cov_pf"), "rot h2of"), "w_co2_wpl_cov_pf": "rot co2f",
    # every correlation, efficiency and quadrant asymmetry needs the rotated wind and the temperature
    **{f"{name}_corr_pf": "rot tsf" for name in (
        "w_h2o__w_theta_v", "u_w__w_h2o", "w_h2o_wpl", "w_co2_wpl", "u_w__w_co2", "w_co2__w_theta_v", "u_w__w_h2o_wpl",
        "w_h2o_wpl__w_theta_v", "u_w__w_co2_wpl", "w_co2_wpl__w_theta_v")},
    **{f"{name}_{kind}_pf": "rot tsf" for kind in ("eta", "delta_flux", "delta_time") for name in ("w_h2o", "w_h2o_wpl", "w_co2", "w_co2_wpl")},
}


def blank(df: DataFrame, flags: dict[str, str] | None = None) -> DataFrame:
    """Void the outputs whose flags are raised; *flags* maps output to flag columns."""
    rules = VOIDED_BY if flags is None else flags
    return df.selectExpr(*[
        f"case when not ({' or '.join(f'coalesce({f}, false)' for f in rules[c].split())}) then `{c}` end as `{c}`"
        if c in rules else f"`{c}`" for c in df.columns])


def planar_fit_admission(df: DataFrame, flags, speed: Column, lo: float = 0.5, hi: float = 20.0,
                         min_by_height: dict[float, float] | None = None) -> DataFrame:
    """Periods that may enter a planar fit: no raised flag and the speed within its range."""
    floor = F.lit(lo)
    for h, v in (min_by_height or {}).items():
        floor = F.when(F.abs(F.col("height") - h) <= 0.01, v).otherwise(floor)
    cond = speed.between(floor, F.lit(hi))
    for f in flags:
        cond = cond & ~F.coalesce(F.col(f), F.lit(False))
    return df.filter(cond)


def date_windows(barriers: DataFrame, on, lo: str, hi: str, day: str) -> DataFrame:
    """Windows between consecutive barrier days, first and last day included.

    A barrier day belongs to both neighbouring windows. *barriers* has one row
    per barrier, with the span columns *lo*, *hi* of its series.
    """
    from pyspark.sql import Window as W

    on = list(on)
    edges = (barriers.select(*on, F.col(day).alias("_d"))
             .unionByName(barriers.select(*on, F.col(lo).alias("_d")))
             .unionByName(barriers.select(*on, F.col(hi).alias("_d"))).distinct())
    w = W.partitionBy(*on).orderBy("_d")
    return edges.select(*on, F.row_number().over(w).alias("window"), F.col("_d").alias("day_lo"),
                        F.lead("_d").over(w).alias("day_hi")).filter(F.col("day_hi").isNotNull())


def in_windows(df: DataFrame, windows: DataFrame, on, day: str, accepted: DataFrame | None = None) -> DataFrame:
    """Rows in each date window, optionally only accepted days (one row per day)."""
    on = list(on)
    if accepted is not None:
        df = df.join(accepted, [*on, day], "left_semi")
    return df.join(windows, on).filter(F.col(day).between(F.col("day_lo"), F.col("day_hi"))).drop("day_lo", "day_hi")


def implausible_attitude(ax, ay, az, gx, gy, gz, roll, pitch, yaw, gravity: float = 1.0, accel_tol: float = 0.3,
                         gyro_max: float = 100.0, tilt_max: float = 45.0, yaw_max: float = 180.0) -> Column:
    """Records a moored platform cannot produce."""
    norm = F.sqrt(ax * ax + ay * ay + az * az)
    bad = F.abs(norm - gravity) > accel_tol
    for g in (gx, gy, gz):
        bad = bad | (F.abs(g) > gyro_max)
    return F.coalesce(bad | (F.abs(roll) > tilt_max) | (F.abs(pitch) > tilt_max) | (F.abs(yaw) > yaw_max), F.lit(False))


def clean_attitude(df: DataFrame, starts: DataFrame, on, us: str, cols, bad: Column, inclusive: bool,
                   average_duplicates: bool) -> DataFrame:
    """Records after the start of their card that pass the screen; equal stamps averaged or kept."""
    on = list(on)
    t0 = F.col("start_us")
    kept = df.join(starts, on).filter((F.col(us) >= t0) if inclusive else (F.col(us) > t0)).filter(~bad).drop("start_us")
    if not average_duplicates:
        return kept
    return kept.groupBy(*on, us).agg(*[F.avg(c).alias(c) for c in cols])


def frozen_attitude(df: DataFrame, keys, us: str, roll: str, pitch: str, min_hold_us: int, chunk: int) -> DataFrame:
    """Add ``frozen``: inside a run of identical roll and pitch of at least *min_hold_us*."""
    keys = list(keys)
    marked = sequence.runs(df, keys, us, F.struct(roll, pitch), chunk, "_run")
    hold = marked.groupBy(*keys, "_run").agg((F.max(us) - F.min(us)).alias("hold_us"))
    return marked.join(hold, [*keys, "_run"]).withColumn("frozen", F.col("hold_us") >= min_hold_us).drop("_run")


def substitute_accel_tilt(df: DataFrame) -> DataFrame:
    """Roll and pitch from the accelerometer where the attitude is frozen."""
    roll = F.degrees(F.atan2("ay", "az"))
    pitch = F.degrees(F.atan2(-F.col("ax"), F.hypot("ay", "az")))
    return (df.withColumn("roll", F.when(F.col("frozen"), roll).otherwise(F.col("roll")))
            .withColumn("pitch", F.when(F.col("frozen"), pitch).otherwise(F.col("pitch"))))


def validate_rate(df: DataFrame, keys, window: str, us: str, hz: float, span_us: int, chunk: int,
                  first: int = 200) -> DataFrame:
    """One report row per window: rows, sampling rate from its first intervals, coverage."""
    from .quantiles import exact_quantiles

    keys = [*keys, window]
    near = scan.neighbours(df.select(*keys, us), keys, us, [us], chunk)
    ranked = scan.row_index(near, keys, us, chunk)
    dt = ranked.filter((F.col("rn") <= first + 1) & F.col(f"prev_{us}").isNotNull()).select(
        *keys, ((F.col(us) - F.col(f"prev_{us}")) / 1e6).alias("dt"))
    med = exact_quantiles(dt, keys, "dt", {"median_dt": 0.5})
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    expected = hz * span_us / 1e6
    return n.join(med, keys, "left").select(
        *keys, "n", "median_dt", F.try_divide(F.lit(1.0), F.col("median_dt")).alias("rate_hz"),
        (F.col("n") / expected).alias("coverage"), (F.col("n") >= 0.1 * expected).cast("int").alias("accepted"))


def alignment_share(grid: DataFrame, source: DataFrame, keys, us: str, lag_us: int, group, warn_below: float = 0.9) -> DataFrame:
    """Share of grid stamps hit by a source after its clock lag."""
    hits = source.select(*keys, (F.col(us) + lag_us).alias(us)).distinct().withColumn("_hit", F.lit(1.0))
    j = grid.select(*keys, us).join(hits, [*keys, us], "left")
    return j.groupBy(*group).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("share")).withColumn(
        "warn", (F.col("share") < warn_below).cast("int"))


def accept_gaps(df: DataFrame, keys, col: str, max_frac: float) -> DataFrame:
    """Keep the windows whose missing share is at most *max_frac* (and not everything is missing)."""
    frac = df.groupBy(*keys).agg(F.avg(F.col(col).isNull().cast("double")).alias("missing_frac"))
    return df.join(frac.filter((F.col("missing_frac") <= max_frac) & (F.col("missing_frac") < 1)), list(keys))


def consistent_files(df: DataFrame, file: str, table: str) -> DataFrame:
    """Drop the files whose tables differ in row count."""
    n = df.groupBy(file, table).agg(F.count(F.lit(1)).alias("_n"))
    good = n.groupBy(file).agg(F.min("_n").alias("_a"), F.max("_n").alias("_b")).filter("_a = _b").select(file)
    return df.join(good, file, "left_semi")


def clip_gross(df: DataFrame, cols, limit: float = 2000.0) -> DataFrame:
    """Text columns to numbers; what does not parse or exceeds the limit becomes missing."""
    out = df
    for c in cols:
        x = F.col(c).try_cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) <= limit), x)
        out = out.withColumn(c, x)
    return out
