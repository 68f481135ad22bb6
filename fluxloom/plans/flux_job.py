"""The complete flux job: all product groups per (site, height, period).

Plan: one aggregate over the samples gives the period state (means, missing
shares); reference state, rotation and trend are period-sized. The state is
joined back to the samples once, and one mergeable aggregate over
(period, sub-period) yields every sum the products need; the rest are
expressions on period rows. Yaw and planar fit are linear, so the rotated
perturbations come from the period means without a rotated pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import flags as qf, stability, thermo
from ..functions.wind import planar_fit_rotate, slope_angles, wrap360, yaw_rotate
from ..operators.qc import blank, frame_flags
from ..operators.quantiles import median_exceeds
from ..operators.rotation import planar_fit
from ..session import cut_lineage

KEY = ["site", "height", "period_us"]
TREND = ("u", "v", "w", "ts_c", "h2o", "co2", "fw")


def _seconds() -> Column:
    return (F.col("us") - F.col("period_us")) / 1e6


@dataclass(frozen=True)
class FluxOptions:
    """Site facts and thresholds of one run."""

    period_us: int = 30 * 60 * 1_000_000
    n_sub: int = 6
    missing_share: float = 0.55
    diagnostic_limit: float = 50.0
    elevation: float = 0.0
    slope: float = 0.0
    aspect: float = 0.0
    bearing: float = 0.0
    canopy: float | None = None
    latitude: float | None = None
    displacement: float = 0.0
    stability_source: str = "hoegstroem1988"
    default_q: float = 0.012
    krypton: bool = False
    level_means: bool = False  # add mean temperatures of the level, which no flag voids
    detrend: str = "linear"  # or "constant"


def period_state(samples: DataFrame, opts: FluxOptions) -> DataFrame:
    """Means, missing shares and flags per period: one partial-aggregating pass."""
    ok = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("w").isNotNull()
    share = lambda c: (F.avg(F.col(c).isNull().cast("double")) >= opts.missing_share)
    # trends in seconds before the period's end, each over its own valid samples (x: the complete wind vector)
    linear = {"linear": True, "constant": False}[opts.detrend]
    slope = lambda y: F.coalesce(F.regr_slope(y, _seconds()), F.lit(0.0)) if linear else F.lit(0.0)
    g = samples.groupBy(*KEY).agg(
        *[slope(F.col(c)).alias(f"k_{c}") for c in TREND], *[slope(F.when(ok, F.col(c))).alias(f"kx_{c}") for c in ("u", "v", "w")],
        *[F.avg(F.when(F.col(c).isNotNull(), _seconds())).alias(f"t_{c}") for c in TREND], F.avg(F.when(ok, _seconds())).alias("t_x"),
        *[F.var_pop(F.when(F.col(c).isNotNull(), _seconds())).alias(f"vt_{c}") for c in TREND], F.var_pop(F.when(ok, _seconds())).alias("vt_x"),
        F.count(F.lit(1)).alias("n"), *[F.avg(F.when(ok, F.col(c))).alias(f"m_{c}") for c in ("u", "v", "w")],
        *[F.avg(c).alias(f"a_{c}") for c in ("u", "v", "w", "ts_c", "h2o", "co2", "fw", "p_kpa")],
        *[share(c).alias(f"f_{c}") for c in ("u", "v", "w", "ts_c", "h2o", "co2", "fw")],
        (F.coalesce(F.avg("diag"), F.lit(0.0)) >= opts.diagnostic_limit).alias("f_diag"))
    frames = frame_flags(F.col("f_u"), F.col("f_v"), F.col("f_w"), F.col("f_diag"))
    return g.select(
        *KEY, "n", *[f"m_{c}" for c in ("u", "v", "w")], *[f"a_{c}" for c in ("u", "v", "w", "ts_c", "h2o", "co2", "fw", "p_kpa")],
        *[f"{k}_{c}" for k in ("k", "t", "vt") for c in TREND], *[f"kx_{c}" for c in ("u", "v", "w")], "t_x", "vt_x",
        frames["unrot"].alias("unrot"), frames["rot"].alias("rot"), F.col("f_ts_c").alias("tsf"), F.col("f_fw").alias("fwf"),
        F.col("f_h2o").alias("h2of"), F.col("f_co2").alias("co2f"))


def global_fits(state: DataFrame) -> DataFrame:
    """All-direction fit per sonic from the unflagged period means of the run."""
    good = state.filter("not rot").select(*KEY, F.col("m_u").alias("u"), F.col("m_v").alias("v"), F.col("m_w").alias("w"))
    return planar_fit(good, ["site", "height"]).select("site", "height", "b0", "b1", "b2")


def reference_state(state: DataFrame, opts: FluxOptions, slow: DataFrame | None = None) -> DataFrame:
    """Reference pressure, temperature, humidity and densities per (site, period).

    The sensor is the one at the lowest sonic height. Pressure is the
    barometer where the run's median lies within 5 % of the standard
    atmosphere. Humidity comes from *slow* (columns t_k, rh), else from the
    analyser, else the default; a sonic temperature is reduced to air.
    """
    lowest = state.groupBy("site", "period_us").agg(
        F.min("height").alias("z_low"),
        F.min_by(F.struct("a_p_kpa", "a_ts_c", "a_h2o"), "height").alias("_r"))
    site = W.partitionBy("site")
    ref = lowest.select("site", "period_us", "_r", "z_low", F.min("z_low").over(site).alias("z_ref"))
    # a period without samples at the reference height has no reference sensor
    here = lambda c: F.when(F.col("z_low") == F.col("z_ref"), F.col("_r")[c])
    ref = ref.select("site", "period_us", "z_ref", here("a_p_kpa").alias("p_raw"), here("a_ts_c").alias("ts_mean"),
                     (here("a_h2o") / 1000.0).alias("rho_v_raw"),
                     thermo.standard_pressure(F.col("z_ref") + opts.elevation).alias("p_std"))
    usable = (median_exceeds(F.col("p_raw"), 0.95 * F.col("p_std"), site)
              & ~median_exceeds(F.col("p_raw"), 1.05 * F.col("p_std"), site))
    ref = ref.withColumn("P_kPa", F.when(usable, F.coalesce("p_raw", "p_std")).otherwise(F.col("p_std")))
    sonic_k = F.col("ts_mean") + 273.15
    if slow is None:
        t, q_slow, is_sonic = sonic_k, F.lit(None).cast("double"), F.lit(True)
    else:
        ref = ref.join(slow, ["site", "period_us"], "left")
        t, is_sonic = F.coalesce("t_k", sonic_k), F.col("t_k").isNull()
        q_slow = thermo.specific_humidity(F.col("rh"), F.col("P_kPa"), t)
    ref = ref.withColumn("_t", t).withColumn("_sonic", is_sonic).withColumn("q_ref", F.coalesce(
        q_slow, thermo.humidity_from_density(F.col("rho_v_raw"), F.col("P_kPa"), F.col("_t")), F.lit(opts.default_q)))
    ref = ref.withColumn("T_K", F.when(F.col("_sonic"), thermo.air_from_sonic(F.col("_t"), F.col("q_ref"))).otherwise(F.col("_t")))
    pv = F.col("q_ref") * F.col("P_kPa") / 0.622
    ref = ref.withColumn("rho_d", 1000.0 * (F.col("P_kPa") - pv) / (thermo.R_DRY * F.col("T_K"))).withColumn(
        "rho_v", 1000.0 * pv / (thermo.R_VAPOUR * F.col("T_K")))
    return ref.select("site", "period_us", "z_ref", "P_kPa", "T_K", "q_ref", "rho_d", "rho_v",
                      (F.col("rho_d") + F.col("rho_v")).alias("rho_air"), thermo.specific_heat(F.col("q_ref")).alias("cp_air"),
                      (F.col("T_K") * (1.0 + 0.61 * F.col("q_ref"))).alias("T_virt_K"))


def _with_humidity_ramp(ref: DataFrame) -> DataFrame:
    """Previous period's humidity and stamp, for the linear course inside a period."""
    w = W.partitionBy("site").orderBy("period_us")
    return ref.withColumns({"q_prev": F.lag("q_ref").over(w), "end_prev": F.lag("period_us").over(w)})


def level_humidity(humidity: DataFrame, pressure: DataFrame) -> DataFrame:
    """Period humidity, virtual potential temperature and densities of the hygrometers of each level.

    *humidity* carries site, height, period_us, t_k, rh in percent and may carry hmp_height, the sensor's own height; rows are
    samples or slow means. *pressure* carries the level's P_lev and z_ref per period. theta_v_slow, r (g/kg) and the densities
    are means over the complete rows, at the period's pressure; q_lev (kg/kg) is of the mean temperature and the mean humidity, each over its own valid
    rows. A period without rows is absent.
    """
    h = humidity.withColumn("hmp_height", F.lit(None).cast("double")) if "hmp_height" not in humidity.columns else humidity
    h = h.select(*KEY, "t_k", "rh", "hmp_height").join(pressure.select(*KEY, "P_lev", "z_ref"), KEY)
    air = thermo.moist_air(F.col("t_k"), F.col("rh"), F.col("P_lev"), F.coalesce("hmp_height", "height") - F.col("z_ref"))
    names = {"theta_v": "theta_v_slow", "r": "r", "rho_moist": "rho_air_moist", "rho_dry": "rho_air_dry", "rho_h2o": "rho_h2o"}
    means = h.groupBy(*KEY).agg(F.first("P_lev").alias("p"), F.avg("t_k").alias("t"), F.avg("rh").alias("rh"),
                                *[F.avg(air[k]).alias(n) for k, n in names.items()])
    return means.select(*KEY, thermo.specific_humidity(F.col("rh"), F.col("p"), F.col("t")).alias("q_lev"), *names.values())


def level_inputs(state: DataFrame, opts: FluxOptions, humidity: DataFrame | None = None) -> DataFrame:
    """The pressure and humidity course of each level beside the reference state.

    A level's own barometer counts where its median over the run lies within 5 % of the standard atmosphere, else the
    reference pressure (P_lev). A level with a hygrometer has its own humidity course between the periods that have a value,
    held at both ends; the others follow the reference. h_prev at h_start and h_next at h_end enclose a period's samples.
    """
    level = W.partitionBy("site", "height")
    standard = thermo.standard_pressure(F.col("z_ref") + opts.elevation)
    near = (median_exceeds(F.col("a_p_kpa"), 0.95 * F.col("p_std"), level) & ~median_exceeds(F.col("a_p_kpa"), 1.05 * F.col("p_std"), level)
            & (F.count("a_p_kpa").over(level) > 0))
    state = state.withColumn("p_std", standard).withColumn("P_lev", F.when(near, F.col("a_p_kpa")).otherwise(F.col("P_kPa"))).drop("p_std")
    names = ("q_lev", "theta_v_slow", "r", "rho_air_moist", "rho_air_dry", "rho_h2o")
    course = {"h_next": "q_ref", "h_end": "period_us", "h_prev": "q_prev", "h_start": "end_prev"}
    if humidity is None:
        return state.withColumns({**{n: F.lit(None).cast("double") for n in names}, "own_q": F.lit(False), **{k: F.col(c) for k, c in course.items()}})
    state = state.join(level_humidity(humidity, state), KEY, "left")
    order = level.orderBy("period_us")
    after, before = order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    at = F.when(F.col("q_lev").isNotNull(), F.col("period_us"))
    own = {"h_next": F.first("q_lev", ignorenulls=True).over(after), "h_end": F.first(at, ignorenulls=True).over(after),
           "h_prev": F.last("q_lev", ignorenulls=True).over(before), "h_start": F.last(at, ignorenulls=True).over(before)}
    state = state.withColumn("own_q", F.count("q_lev").over(level) > 0)
    return state.withColumns({k: F.when(F.col("own_q"), own[k]).otherwise(F.col(c)) for k, c in course.items()})


def _sample_humidity() -> Column:
    c = F.col
    rate = (c("us") - c("h_start")) / (c("h_end") - c("h_start")).cast("double")
    return F.when(c("h_prev").isNull(), c("h_next")).when(c("h_next").isNull(), c("h_prev")).otherwise(
        c("h_prev") + (c("h_next") - c("h_prev")) * rate)


def _fine_wire_virtual() -> Column:
    """Virtual potential temperature of the fine wire (deg C)."""
    return (F.col("fw") + thermo.LAPSE_DRY * (F.col("height") - F.col("z_ref"))) * (1.0 + 0.61 * _sample_humidity())


def full_state(samples: DataFrame, opts: FluxOptions, fits: DataFrame | None = None, slow: DataFrame | None = None,
               humidity: DataFrame | None = None) -> DataFrame:
    """Everything known per period before the sample pass, including the means that need the humidity course."""
    base = period_state(samples, opts)
    fits = global_fits(base) if fits is None else fits
    ref = _with_humidity_ramp(reference_state(base, opts, slow))
    state = base.join(ref, ["site", "period_us"], "left").join(fits, ["site", "height"], "left")
    mu, mv, _ = planar_fit_rotate(*[F.col(c) for c in ("m_u", "m_v", "m_w", "b0", "b1", "b2")])
    state = state.withColumns({"y_u": mu, "y_v": mv})
    state = level_inputs(state, opts, humidity)
    ramp = state.select(*KEY, "z_ref", "h_next", "h_end", "h_prev", "h_start")
    air = (thermo.air_from_sonic(F.col("ts_c") + 273.15, _sample_humidity()))
    wire = _fine_wire_virtual()
    slope = F.coalesce(F.regr_slope(wire, _seconds()), F.lit(0.0)) if opts.detrend == "linear" else F.lit(0.0)
    means = samples.select(*KEY, "us", "ts_c", "fw").join(ramp, KEY).groupBy(*KEY).agg(
        F.avg(air).alias("t_air_k"), F.avg(wire).alias("a_vfw"), slope.alias("k_vfw"), F.avg(F.when(wire.isNotNull(), _seconds())).alias("t_vfw"))
    return state.join(means, KEY, "left")


def primes(samples: DataFrame, state: DataFrame) -> DataFrame:
    """Perturbations of every series about its period mean or trend, in raw, tilt and mean-wind frames."""
    s = samples.drop("p_kpa").join(state, KEY)
    c = F.col
    zero = F.lit(0.0)
    about = lambda x: c(x) - c(f"a_{x}") - c(f"k_{x}") * (_seconds() - c(f"t_{x}"))
    wind = lambda x: c(x) - c(f"m_{x}") - c(f"kx_{x}") * (_seconds() - c("t_x"))
    ut, vt, wt = planar_fit_rotate(wind("u"), wind("v"), wind("w"), zero, c("b1"), c("b2"))
    s = s.withColumns({"up": about("u"), "vp": about("v"), "wp": about("w"), "ut": ut, "vt": vt, "wr": wt,
                       "tp": about("ts_c"), "fp": about("fw"), "hp": about("h2o"), "cp": about("co2") / 1e6})
    ur, vr = yaw_rotate(c("ut"), c("vt"), c("y_u"), c("y_v"))
    sigma = thermo.M_DRY / thermo.M_VAPOUR
    ratio = c("rho_v") / c("rho_d")
    ta = thermo.air_perturbation(c("tp"), c("hp") / 1000.0 / (c("rho_d") + c("rho_v")), c("t_air_k"))
    gp = _fine_wire_virtual() - c("a_vfw") - c("k_vfw") * (_seconds() - c("t_vfw"))
    s = s.withColumns({"ur": ur, "vr": vr, "ta": ta, "gp": gp})
    rho_c = c("a_co2") / 1e6
    ext_v = sigma * ratio * c("hp") / 1000.0 + c("rho_v") * (1.0 + sigma * ratio) * c("ta") / c("T_K")
    ext_c = sigma * rho_c / c("rho_d") * c("hp") / 1000.0 + rho_c * (1.0 + sigma * ratio) * c("ta") / c("T_K")
    return s.withColumns({"hw": c("hp") + 1000.0 * ext_v, "xc": ext_c, "cw": c("cp") + ext_c, "cs": (c("co2") - c("a_co2")) / 1e6 + ext_c,
                          "ppm": thermo.co2_mole_fraction_ppm(c("co2"), c("P_lev"), thermo.air_from_sonic(
                              c("ts_c") + 273.15, _sample_humidity()) - 273.15)})


# mean products, named by their factors
PRODUCTS = ("up*up vp*vp wp*wp up*wp vp*wp ur*ur vr*vr wr*wr ur*vr ur*wr vr*wr ut*ut vt*vt ut*vt ut*wr vt*wr tp*tp fp*fp "
            "hp*hp cp*cp cw*cw ut*tp vt*tp wr*tp wp*tp wp*ta wr*ta up*tp vp*tp ur*tp vr*tp wp*fp wr*fp wp*hp wr*hp wr*hw "
            "wp*cp wr*cp wr*xc ur*hp ur*hw ur*cp ur*cw wr*ur*ur wr*vr*vr wr*wr*wr wr*ur*wr wr*tp*wr wr*tp*tp wr*hp*wr "
            "wr*hw*wr wr*cp*wr wr*cw*wr cs cs*cs ppm up*fp vp*fp ur*fp vr*fp wp*gp wr*gp").split()
CORRELATED = {"u_w__w_theta_v": ("ur*wr", "tp*wr"), "u_w__w_h2o": ("ur*wr", "hp*wr"), "w_h2o__w_theta_v": ("hp*wr", "tp*wr"),
              "w_u": ("wr", "ur"), "w_theta_v": ("wr", "tp"), "w_h2o": ("wr", "hp"), "w_co2": ("wr", "cp"),
              "w_h2o_wpl": ("wr", "hw"), "w_co2_wpl": ("wr", "cw"), "u_w__w_co2": ("ur*wr", "cp*wr"),
              "w_co2__w_theta_v": ("cp*wr", "tp*wr"), "u_w__w_h2o_wpl": ("ur*wr", "hw*wr"),
              "w_h2o_wpl__w_theta_v": ("hw*wr", "tp*wr"), "u_w__w_co2_wpl": ("ur*wr", "cw*wr"),
              "w_co2_wpl__w_theta_v": ("cw*wr", "tp*wr")}
EFFICIENT = {"u_w": "ur", "w_theta_v": "tp", "w_h2o": "hp", "w_h2o_wpl": "hw", "w_co2": "cp", "w_co2_wpl": "cw"}
SKEWED = {"u_skew_pf": "ur", "v_skew_pf": "vr", "w_skew_pf": "wr", "theta_v_skew": "tp", "h2o_skew": "hp",
          "h2o_wpl_skew": "hw", "co2_skew": "cp", "co2_wpl_skew": "cw"}
STEADY = {"uw": ("ur", "wr"), "vw": ("vr", "wr"), "wt": ("wr", "tp"), "wh": ("wr", "hw"), "wc": ("wr", "cw")}


# series each factor needs; x is the complete wind vector
_NEEDS = {"up": "u", "vp": "v", "wp": "w", "ur": "x", "vr": "x", "wr": "x", "ut": "x", "vt": "x", "tp": "t", "fp": "f", "gp": "f",
          "hp": "h", "cp": "c", "ta": "th", "hw": "th", "xc": "th", "cw": "thc", "cs": "thc", "ppm": "tc"}
_PROBE = {"u": "up", "v": "vp", "w": "wp", "x": "ur", "t": "tp", "f": "fp", "h": "hp", "c": "cp"}


class Sums:
    """The distinct sums and counts the products need, each named by its factors and mask.

    A sum over samples where further series are present carries them as its
    mask, so equal sums of different statistics are computed once.
    """

    def __init__(self):
        self.exprs: dict[str, str] = {}

    def need(self, *products: str) -> str:
        return "".join(sorted({m for p in products for f in p.split("*") for m in _NEEDS[f]}))

    def count(self, mask: str) -> str:
        name = f"n_{mask}"
        test = " and ".join(f"{_PROBE[m]} is not null" for m in mask)
        self.exprs[name] = f"count(case when {test} then 1 end)"
        return name

    def total(self, product: str, mask: str = "") -> str:
        factors = sorted(product.split("*"))
        extra = "".join(m for m in mask if m not in self.need(product))
        name = f"s_{'_'.join(factors)}" + (f"__{extra}" if extra else "")
        value = " * ".join(factors)
        if extra:
            test = " and ".join(f"{_PROBE[m]} is not null" for m in extra)
            value = f"case when {test} then {value} end"
        self.exprs[name] = f"sum({value})"
        return name

    def mean(self, product: str, mask: str = "") -> str:
        mask = "".join(sorted(set(mask) | set(self.need(product))))
        return f"try_divide({self.total(product, mask)}, {self.count(mask)})"


def _mean_exprs(sums: Sums) -> dict[str, str]:
    return {"M_" + q.replace("*", "_"): sums.mean(q) for q in PRODUCTS}


def _correlation_exprs(sums: Sums) -> dict[str, str]:
    out = {}
    for name, (a, b) in CORRELATED.items():
        m = sums.need(a, b)
        n, sx, sy = sums.count(m), sums.total(a, m), sums.total(b, m)
        vx, vy = (f"({sums.total(f'{q}*{q}', m)} - try_divide({t} * {t}, {n}))" for q, t in ((a, sx), (b, sy)))
        cov = f"({sums.total(f'{a}*{b}', m)} - try_divide({sx} * {sy}, {n}))"
        out[f"{name}_corr_pf"] = f"case when {vx} > 0 and {vy} > 0 then {cov} / sqrt({vx} * {vy}) end"
    return out


def _skewness_exprs(sums: Sums) -> dict[str, str]:
    out = {}
    for name, c in SKEWED.items():
        n, mu = sums.count(sums.need(c)), sums.mean(c)
        m2 = f"({sums.mean(f'{c}*{c}')} - {mu} * {mu})"
        m3 = f"({sums.mean(f'{c}*{c}*{c}')} - 3 * {mu} * {sums.mean(f'{c}*{c}')} + 2 * {mu} * {mu} * {mu})"
        out[name] = (f"case when {n} >= 3 and {m2} > 0 then {m3} / ({m2} * sqrt({m2})) * sqrt({n} * ({n} - 1.0D)) / ({n} - 2.0D) end")
    return out


def _efficiency_sums(sums: Sums) -> None:
    for name, c in EFFICIENT.items():
        p = f"wr * {c}"
        sums.exprs[f"e_{name}_sum"], sums.exprs[f"e_{name}_n"] = f"sum({p})", f"count({p})"
        for sign, s in (("pos", ">"), ("neg", "<")):
            for side, w in (("up", ">"), ("dn", "<")):
                hit = f"case when {p} {s} 0 and wr {w} 0 then {p} end"
                sums.exprs[f"e_{name}_{sign}_{side}"], sums.exprs[f"e_{name}_k{sign}_{side}"] = f"sum({hit})", f"count({hit})"


def _block_cov(sums: Sums, a: str, b: str) -> str:
    """Covariance of a block about each series' own mean, from its sums."""
    m = sums.need(a, b)
    mx, my = sums.mean(a), sums.mean(b)
    return (f"({sums.mean(f'{a}*{b}')} - {mx} * {sums.mean(b, m)} - {my} * {sums.mean(a, m)} + {mx} * {my})")


def _all_sums() -> Sums:
    sums = Sums()
    for fn in (_mean_exprs, _correlation_exprs, _skewness_exprs, _efficiency_sums):
        fn(sums)
    for a, b in STEADY.values():
        _block_cov(sums, a, b)
    return sums


def sub_period_sums(p: DataFrame, opts: FluxOptions) -> DataFrame:
    """Mergeable sums per (period, sub-period): partial aggregation keeps the shuffle to period rows."""
    sub_us = opts.period_us // opts.n_sub
    sub = f"least((us - 1 - (period_us - {opts.period_us}L)) div {sub_us}L, {opts.n_sub - 1}L)"
    return p.groupBy(*KEY, F.expr(sub).alias("sub")).agg(*[F.expr(e).alias(n) for n, e in _all_sums().exprs.items()])


def period_sums(sub: DataFrame) -> DataFrame:
    """Period sums and the mean of the sub-period covariances."""
    sums = Sums()
    aggs = {n: f"sum({n})" for n in sub.columns if n not in (*KEY, "sub")}
    for name, (a, b) in STEADY.items():
        cov = _block_cov(sums, a, b)
        n = sums.count(sums.need(a, b))
        aggs[f"sub_{name}"] = f"avg(case when {n} >= 3 then {cov} end)"
        aggs[f"rawsub_{name}"] = f"avg({sums.mean(f'{a}*{b}')})"
    return sub.groupBy(*KEY).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])


def flux_job(samples: DataFrame, opts: FluxOptions, fits: DataFrame | None = None, slow: DataFrame | None = None,
             humidity: DataFrame | None = None) -> DataFrame:
    """All product groups; *samples* carry site, height, us, period_us and the channels, *humidity* the levels' hygrometers."""
    # the state is period-sized and read twice; a written table is computed once and survives lost executors
    state = cut_lineage(full_state(samples, opts, fits, slow, humidity), "flux-state", wide=True)
    # the one pass over the samples with its many sums, compiled as a whole
    sums = period_sums(cut_lineage(sub_period_sums(primes(samples, state), opts), "flux-sums", wide=True))
    return blank(products(sums.join(state, KEY), opts))


def products(df: DataFrame, opts: FluxOptions) -> DataFrame:
    """Product columns from the period sums and the period state; flags are not applied yet."""
    sums = Sums()
    add = lambda d, exprs: d.selectExpr("*", *[f"{e} as {n}" for n, e in exprs.items()])
    c = F.col
    df = add(df, _mean_exprs(sums))
    wrap = f"degrees(atan2(-a_v, a_u)) + {opts.bearing}D"
    df = add(df, {"direction": f"pmod({wrap}, 360D)", "n_samples": "n",
                  "wpl": f"1 + {thermo.M_DRY / thermo.M_VAPOUR!r}D * rho_v / rho_d",
                  "mu_c": f"{thermo.M_DRY / thermo.M_VAPOUR!r}D * (a_co2 / 1e6D) / rho_d"})
    a1, a2 = slope_angles(c("direction"), opts.slope, opts.aspect)
    df = df.withColumns({"_a1": F.sin(F.radians(a1)), "_a2": F.sin(F.radians(a2)), "Lv": thermo.vaporisation_heat_j_per_g(c("T_K"))})
    # standard deviations are of the series itself: a least-squares trend adds its own variance to that of the residuals
    root = lambda q, slope, var: f"sqrt(greatest(M_{q} + ({slope}) * ({slope}) * {var}, 0D))"
    kt = planar_fit_rotate(c("kx_u"), c("kx_v"), c("kx_w"), F.lit(0.0), c("b1"), c("b2"))
    ku, kv = yaw_rotate(kt[0], kt[1], c("y_u"), c("y_v"))
    df = df.withColumns({"_ku": ku, "_kv": kv, "_kw": kt[2]})
    df = add(df, {
        "u_sigma_raw": root("up_up", "k_u", "vt_u"), "v_sigma_raw": root("vp_vp", "k_v", "vt_v"), "w_sigma_raw": root("wp_wp", "k_w", "vt_w"),
        "u_sigma_pf": root("ur_ur", "_ku", "vt_x"), "v_sigma_pf": root("vr_vr", "_kv", "vt_x"), "w_sigma_pf": root("wr_wr", "_kw", "vt_x"),
        "ts_sigma": root("tp_tp", "k_ts_c", "vt_ts_c"), "theta_v_sigma": root("tp_tp", "k_ts_c", "vt_ts_c"),
        "t_fw_sigma": root("fp_fp", "k_fw", "vt_fw"), "h2o_sigma": root("hp_hp", "k_h2o", "vt_h2o"),
        "co2_sigma": root("cp_cp", "k_co2 / 1e6D", "vt_co2") + " * 1e6D",
        "co2_wpl_sigma": "sqrt(greatest(M_cs_cs - M_cs * M_cs, 0D)) * 1e6D",
        "Tau_raw": "hypot(M_up_wp, M_vp_wp)", "Tau_pf": "hypot(M_ur_wr, M_vr_wr)",
        "u_var_pf": "M_ur_ur", "v_var_pf": "M_vr_vr", "w_var_pf": "M_wr_wr", "u_v_cov_pf": "M_ur_vr", "u_w_cov_pf": "M_ur_wr",
        "v_w_cov_pf": "M_vr_wr", "u_var_tilt": "M_ut_ut", "v_var_tilt": "M_vt_vt", "w_var_tilt": "M_wr_wr",
        "u_v_cov_tilt": "M_ut_vt", "u_w_cov_tilt": "M_ut_wr", "v_w_cov_tilt": "M_vt_wr",
        "TKE": "0.5D * (M_up_up + M_vp_vp + M_wp_wp)", "TKE_transport_pf": "0.5D * (M_wr_ur_ur + M_wr_vr_vr + M_wr_wr_wr)",
        "u_w_transport_pf": "M_wr_ur_wr", "w_theta_v_transport_pf": "M_wr_tp_wr", "ts_var_transport_pf": "M_wr_tp_tp",
        "w_h2o_transport_pf": "M_wr_hp_wr", "w_h2o_wpl_transport_pf": "M_wr_hw_wr", "w_co2_transport_pf": "M_wr_cp_wr",
        "w_co2_wpl_transport_pf": "M_wr_cw_wr", "u_theta_v_cov_snsp": "M_ut_tp", "v_theta_v_cov_snsp": "M_vt_tp",
        "w_theta_v_cov_snsp": "M_wr_tp",
        "w_theta_v_cov_vertical": f"M_wr_tp * {math.cos(math.radians(opts.slope))!r}D - M_ut_tp * _a1 - M_vt_tp * _a2",
        "w_ts_cov_raw": "M_wp_tp", "w_theta_v_cov_pf": "M_wr_tp", "w_t_air_cov_raw": "M_wp_ta", "w_t_air_cov_pf": "M_wr_ta",
        "w_theta_s_cov_raw": "M_wp_tp", "w_theta_s_cov_pf": "M_wr_tp", "w_t_fw_cov_raw": "M_wp_fp", "w_t_fw_cov_pf": "M_wr_fp",
        "u_ts_cov_raw": "M_up_tp", "v_ts_cov_raw": "M_vp_tp", "u_ts_cov_pf": "M_ur_tp", "v_ts_cov_pf": "M_vr_tp",
        "u_theta_s_cov_raw": "M_up_tp", "v_theta_s_cov_raw": "M_vp_tp", "u_theta_s_cov_pf": "M_ur_tp", "v_theta_s_cov_pf": "M_vr_tp",
        "w_theta_fw_cov_raw": "M_wp_fp", "w_theta_fw_cov_pf": "M_wr_fp", "w_theta_v_fw_cov_raw": "M_wp_gp", "w_theta_v_fw_cov_pf": "M_wr_gp",
        "u_theta_fw_cov_raw": "M_up_fp", "v_theta_fw_cov_raw": "M_vp_fp", "u_theta_fw_cov_pf": "M_ur_fp", "v_theta_fw_cov_pf": "M_vr_fp",
        "theta_fw": f"a_fw + {thermo.LAPSE_DRY!r}D * (height - z_ref)", "theta_v": f"a_ts_c + {thermo.LAPSE_DRY!r}D * (height - z_ref)",
        "theta_v_fw": "a_vfw", "t_air": "t_air_k - 273.15D", "q": "q_lev * 1000D",
        "w_h2o_cov_raw": "M_wp_hp", "w_h2o_cov_pf": "M_wr_hp", "w_h2o_wpl_cov_pf": "M_wr_hw",
        "w_q_wpl_cov_pf": "wpl * (M_wr_hp / 1e3D + rho_v / T_K * M_wr_ta)",
        "w_co2_cov_raw": "M_wp_cp", "w_co2_cov_pf": "M_wr_cp", "w_co2_wpl_cov_pf": "M_wr_cp + M_wr_xc",
        "u_theta_v_cov_pf": "M_ur_tp", "u_h2o_cov_pf": "M_ur_hp", "u_h2o_wpl_cov_pf": "M_ur_hw", "u_co2_cov_pf": "M_ur_cp",
        "u_co2_wpl_cov_pf": "M_ur_cw", "co2_mole_fraction": "M_ppm",
        # the density terms use the flagged temperature flux, so a voided one voids them
        "_heat": "case when not (rot or tsf or h2of) then M_wr_ta end", "_tau": "case when not rot then hypot(M_ur_wr, M_vr_wr) end",
    })
    df = df.withColumns({
        "L": stability.obukhov_length(c("_tau"), F.when(c("own_q"), c("theta_v_slow")).otherwise(c("T_virt_K")), c("w_theta_v_cov_vertical")),
        "ustar_pf": stability.friction_velocity(c("_tau"))})
    le = lambda e: f"1000D * Lv * wpl * ({e} / 1000D + rho_v / T_K * _heat)"
    df = add(df, {"LE_wpl_raw": le("M_wp_hp"), "LE_wpl_pf": le("M_wr_hp"), "zeta": "height / case when not (rot or tsf) then L end"})
    oxygen = f"{0.23 * 0.0045 / 0.153!r}D * rho_d / T_K * _heat * 1000D"
    df = add(df, {
        "theta_star": "-M_wr_tp / ustar_pf", "q_star": "-(M_wr_hp / (rho_d + rho_v)) / ustar_pf",
        "Fc_wpl_pf": "M_wr_cp + mu_c * (case when not (unrot or h2of) then LE_wpl_pf end / Lv / 1000D) + wpl * (a_co2 / 1e6D) / T_K * _heat",
        "LE_o2_raw": f"Lv * (M_wp_hp + {oxygen})", "LE_o2_pf": f"Lv * (M_wr_hp + {oxygen})",
        "H_raw": "rho_air * cp_air * case when not (unrot or tsf or h2of) then M_wp_ta end", "H_pf": "rho_air * cp_air * _heat",
        "H_buoyancy_pf": "rho_air * cp_air * case when not (rot or tsf) then M_wr_tp end"})
    df = df.withColumns({"psi_m": stability.psi_m(c("zeta"), opts.stability_source), "psi_h": stability.psi_h(c("zeta"), opts.stability_source)})
    shape = {**_correlation_exprs(sums), **_skewness_exprs(sums)}
    for name in EFFICIENT:
        e = lambda part: f"coalesce(e_{name}_{part}, 0)"
        pick = lambda x, k="": (f"(case when e_{name}_sum > 0 then {e(f'{k}pos_{x}')} when e_{name}_sum < 0 then {e(f'{k}neg_{x}')} end)")
        shape[f"{name}_eta_pf"] = f"try_divide(e_{name}_sum, {pick('up')} + {pick('dn')})"
        shape[f"{name}_delta_flux_pf"] = f"try_divide({pick('up')} - {pick('dn')}, e_{name}_sum)"
        shape[f"{name}_delta_time_pf"] = f"try_divide({pick('up', 'k')} - {pick('dn', 'k')}, e_{name}_n)"
    quality = quality_classes(df, opts)
    extra = ["Lv", "L", "ustar_pf", "LE_wpl_raw", "LE_wpl_pf", "zeta", "theta_star", "q_star", "psi_m", "psi_h", "Fc_wpl_pf", "H_raw",
             "H_pf", "H_buoyancy_pf", *(["LE_o2_raw", "LE_o2_pf"] if opts.krypton else [])]
    base = ["direction", "n_samples", "P_kPa", "T_K", "q_ref", "rho_d", "rho_v", "rho_air", "cp_air", "T_virt_K", "z_ref",
            "unrot", "rot", "tsf", "fwf", "h2of", "co2f"]
    keep = [x for x in df.columns if x in PRODUCT_NAMES or (opts.level_means and x in LEVEL_MEANS)]
    return df.select(*KEY, *base, *keep, *extra, *[F.expr(e).alias(n) for n, e in shape.items()],
                     *[q.alias(n) for n, q in quality.items()])


PRODUCT_NAMES = set("""u_sigma_raw v_sigma_raw w_sigma_raw u_sigma_pf v_sigma_pf w_sigma_pf ts_sigma theta_v_sigma t_fw_sigma
 h2o_sigma co2_sigma co2_wpl_sigma Tau_raw Tau_pf u_var_pf v_var_pf w_var_pf u_v_cov_pf u_w_cov_pf v_w_cov_pf u_var_tilt
 v_var_tilt w_var_tilt u_v_cov_tilt u_w_cov_tilt v_w_cov_tilt TKE TKE_transport_pf u_w_transport_pf w_theta_v_transport_pf
 ts_var_transport_pf w_h2o_transport_pf w_h2o_wpl_transport_pf w_co2_transport_pf w_co2_wpl_transport_pf u_theta_v_cov_snsp
 v_theta_v_cov_snsp w_theta_v_cov_snsp w_theta_v_cov_vertical w_ts_cov_raw w_theta_v_cov_pf w_t_air_cov_raw w_t_air_cov_pf
 w_theta_s_cov_raw w_theta_s_cov_pf w_t_fw_cov_raw w_t_fw_cov_pf u_ts_cov_raw v_ts_cov_raw u_ts_cov_pf v_ts_cov_pf
 u_theta_s_cov_raw v_theta_s_cov_raw u_theta_s_cov_pf v_theta_s_cov_pf
 w_h2o_cov_raw w_h2o_cov_pf w_h2o_wpl_cov_pf w_q_wpl_cov_pf w_co2_cov_raw w_co2_cov_pf w_co2_wpl_cov_pf u_theta_v_cov_pf
 u_h2o_cov_pf u_h2o_wpl_cov_pf u_co2_cov_pf u_co2_wpl_cov_pf co2_mole_fraction
 w_theta_fw_cov_raw w_theta_fw_cov_pf w_theta_v_fw_cov_raw w_theta_v_fw_cov_pf u_theta_fw_cov_raw v_theta_fw_cov_raw u_theta_fw_cov_pf
 v_theta_fw_cov_pf q theta_v_slow r rho_air_moist rho_air_dry rho_h2o""".split())

LEVEL_MEANS = ("theta_fw", "theta_v", "theta_v_fw", "t_air")


def steady_state() -> dict[str, Column]:
    """Percent deviation of the mean sub-period covariance, each about its own means."""
    sums, out = Sums(), {}
    for name, (a, b) in STEADY.items():
        n = F.col(sums.count(sums.need(a, b)))
        out[name] = F.when(n >= 10, qf.deviation_percent(F.col(f"sub_{name}"), F.expr(_block_cov(sums, a, b))))
    return out


def quality_classes(df: DataFrame, opts: FluxOptions) -> dict[str, Column]:
    """Eight classes (steady state with and without the similarity test) and four of the second family."""
    c, sums = F.col, Sums()
    ss = steady_state()
    n = c("n_x")
    sigma_w = F.when(n > 1, F.sqrt(F.greatest(c("s_wr_wr"), F.lit(0.0)) / (n - 1.0)))
    zeta = F.greatest(c("height") - opts.displacement, F.lit(0.1)) / F.when(~(c("rot") | c("tsf")), c("L"))
    above = stability.sigma_w_reference(zeta, c("ustar_pf"), opts.latitude)
    model = above
    if opts.canopy is not None:
        model = F.when(c("height") <= opts.canopy, stability.sigma_w_canopy(c("height"), opts.canopy)).otherwise(above)
    itc = stability.itc_deviation(sigma_w, c("ustar_pf"), model)
    itc2 = stability.itc_deviation(sigma_w, c("ustar_pf"), qf.itc_cubic_root_model(zeta))
    simple = {}
    for name, (a, b) in STEADY.items():
        full = F.expr(sums.mean(f"{a}*{b}"))
        simple[name] = F.when(c(sums.count(sums.need(a, b))) >= 10, qf.deviation_percent(c(f"rawsub_{name}"), full))
    rows = {"Tau": (("uw", "vw"), ("rot",)), "H": (("wt",), ("rot", "tsf")), "LE": (("wh",), ("rot", "h2of")),
            "Fc": (("wc",), ("rot", "co2f"))}
    out = {}
    for name, (pairs, raised) in rows.items():
        worst = lambda src: F.greatest(*[src[p] for p in pairs]) if len(pairs) > 1 else src[pairs[0]]
        fl = [c(f) for f in raised]
        out[f"{name}_ssitc"] = qf.forced(qf.steady_state_class(worst(ss), itc), *fl)
        out[f"{name}_ss"] = qf.forced(qf.steady_state_class(worst(ss)), *fl)
        out[f"{name}_ssitc_simple"] = qf.forced(qf.steady_state_class(worst(simple), itc2), *fl)
    return out
