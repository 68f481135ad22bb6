"""Checks of periods, aggregations and detrending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecodes
from ..functions.wind import direction_speed
from ..operators import moments, periods
from .registry import check
from .standin import CHUNK_US, DAY_US, HOUR_US, PERIOD

P = "site height period_us"


@check("f01_period_assignment", "site height period_end period_start n", "",
       f"""WITH @tower SELECT site, height, period_end, period_start, COUNT(*) AS n FROM (
         SELECT site, height, us - us % {HOUR_US} AS period_start,
           CASE WHEN us % {HOUR_US} = 0 THEN us ELSE us - us % {HOUR_US} + {HOUR_US} END AS period_end FROM tower)
         GROUP BY ALL""")
def _(t):
    df = periods.assign_periods(t.tower(), "us", HOUR_US)
    return df.groupBy("site", "height", "period_end", "period_start").agg(F.count(F.lit(1)).alias("n"))


@check("f01_period_count", "site height n_periods", "",
       f"""WITH @tower SELECT site, height, CAST((hi + (CASE WHEN hi % {HOUR_US} = 0 THEN 0 ELSE
         {HOUR_US} - hi % {HOUR_US} END) - (lo - lo % {HOUR_US})) // {HOUR_US} AS BIGINT) AS n_periods
         FROM (SELECT site, height, MIN(us) AS lo, MAX(us) AS hi FROM tower GROUP BY 1, 2)""")
def _(t):
    return periods.period_counts(t.tower(), ["site", "height"], "us", HOUR_US)


@check("f02_monotone_blocks", "site height block_us n", "",
       f"""WITH @tower, j AS (SELECT site, height, event_id, us - (k % 5)::BIGINT * 600000000 AS us FROM tower),
         m AS (SELECT site, height, MAX(us) OVER (PARTITION BY site, height ORDER BY event_id
           ROWS UNBOUNDED PRECEDING) AS us_mono FROM j)
         SELECT site, height, us_mono - us_mono % {HOUR_US} AS block_us, COUNT(*) AS n FROM m GROUP BY ALL""")
def _(t):
    # record order is the event id; the stamps step backwards by whole minutes
    df = t.tower().withColumn("us", F.col("us") - F.pmod(F.col("k"), F.lit(5)).cast("long") * 600_000_000)
    # ids are dense in record order, so a chunk of ids bounds the rows of a task
    blocks = periods.monotone_blocks(df, ["site", "height"], "event_id", "us", HOUR_US, 100_000)
    return blocks.groupBy("site", "height", "block_us").agg(F.count(F.lit(1)).alias("n"))


@check("f03_block_means", P + " last_us n", "u_mean v_mean w_mean ts_c_mean h2o_mean co2_mean",
       """WITH @tower SELECT site, height, period_us, MAX(us) AS last_us, COUNT(*) AS n, AVG(u) AS u_mean,
         AVG(v) AS v_mean, AVG(w) AS w_mean, AVG(ts_c) AS ts_c_mean, AVG(h2o) AS h2o_mean, AVG(co2) AS co2_mean
         FROM tower GROUP BY 1, 2, 3""")
def _(t):
    return periods.block_means(t.tower(), PERIOD, ["u", "v", "w", "ts_c", "h2o", "co2"])


@check("f04_vector_mean_direction", P, "direction speed",
       """WITH @tower, d AS (SELECT *, degrees(atan2(-v, u)) + 45 AS d0, sqrt(u * u + v * v) AS spd FROM tower),
         e AS (SELECT *, d0 - 360 * floor(d0 / 360) AS dir FROM d)
         SELECT site, height, period_us, AVG(spd) AS speed,
           m - 360 * floor(m / 360) AS direction FROM (
           SELECT site, height, period_us, spd, degrees(atan2(AVG(spd * sin(radians(dir))) OVER g,
             AVG(spd * cos(radians(dir))) OVER g)) AS m FROM e
             WINDOW g AS (PARTITION BY site, height, period_us))
         GROUP BY site, height, period_us, m""")
def _(t):
    direction, speed = direction_speed(F.col("u"), F.col("v"), F.lit(45.0))
    df = t.tower().select("*", direction.alias("dir"), speed.alias("spd"))
    return df.groupBy(*PERIOD).agg(
        periods.vector_mean_direction(F.col("dir"), F.col("spd")).alias("direction"),
        F.avg("spd").alias("speed"))


@check("f05_step_down", "site height step", "u v w",
       """WITH @tower, r AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY site, height ORDER BY us) - 1) // 7 AS step
         FROM tower) SELECT site, height, step, AVG(u) AS u, AVG(v) AS v, AVG(w) AS w FROM r
         GROUP BY 1, 2, 3 HAVING COUNT(*) = 7""")
def _(t):
    return periods.step_down(t.tower(), ["site", "height"], "us", ["u", "v", "w"], 7, CHUNK_US)


@check("f06_sub_period_stats", "site height sub_us", "u_mean u_sd u_cover h2o_mean h2o_sd h2o_cover",
       f"""WITH @tower, g AS (SELECT site, height, us - us % {6 * HOUR_US} AS sub_us, AVG(u) AS um, STDDEV_POP(u) AS us_,
           COUNT(u) / 12.0::DOUBLE AS u_cover, AVG(h2o) AS hm, STDDEV_POP(h2o) AS hs, COUNT(h2o) / 12.0::DOUBLE AS h2o_cover
         FROM tower GROUP BY 1, 2, 3)
         SELECT site, height, sub_us, CASE WHEN u_cover >= 0.5 THEN um END AS u_mean,
           CASE WHEN u_cover >= 0.5 THEN us_ END AS u_sd, u_cover, CASE WHEN h2o_cover >= 0.75 THEN hm END AS h2o_mean,
           CASE WHEN h2o_cover >= 0.75 THEN hs END AS h2o_sd, h2o_cover FROM g""")
def _(t):
    return periods.sub_period_stats(t.tower(), ["site", "height"], "us", 6 * HOUR_US, ["u", "h2o"], 12.0,
                                    {"u": 0.5, "h2o": 0.75})


_SECOND = {"uw_cov": ("u", "w"), "vw_cov": ("v", "w"), "uv_cov": ("u", "v"), "w_ts_cov": ("w", "ts_c"),
           "w_h2o_cov": ("w", "h2o"), "w_co2_cov": ("w", "co2"), "u_var": ("u", "u"), "v_var": ("v", "v"),
           "w_var": ("w", "w")}
_PRODS = ", ".join(f"AVG({x}_p * {y}_p) AS {n}" for n, (x, y) in _SECOND.items())
_CONST = "WITH @tower, d AS (SELECT *, " + ", ".join(
    f"{c} - AVG({c}) OVER g AS {c}_p" for c in ("u", "v", "w", "ts_c", "h2o", "co2", "fw")) + \
    " FROM tower WINDOW g AS (PARTITION BY site, height, period_us))"
_TSEC = f"((us - period_us) / 1000000.0::DOUBLE)"
_LINEAR = f"WITH @tower, tt AS (SELECT *, {_TSEC} AS t FROM tower), d AS (SELECT *, " + ", ".join(
    f"{c} - (regr_intercept({c}, t) OVER g + regr_slope({c}, t) OVER g * t) AS {c}_p"
    for c in ("u", "v", "w", "ts_c", "h2o", "co2")) + \
    " FROM tt WINDOW g AS (PARTITION BY site, height, period_us))"


def _seconds(df):
    return df.withColumn("t", (F.col("us") - F.col("period_us")) / 1e6)


@check("f07_standard_deviations", P, "u_sigma v_sigma w_sigma ts_sigma h2o_sigma co2_sigma",
       """WITH @tower SELECT site, height, period_us, STDDEV_POP(u) AS u_sigma, STDDEV_POP(v) AS v_sigma,
         STDDEV_POP(w) AS w_sigma, STDDEV_POP(ts_c) AS ts_sigma, STDDEV_POP(h2o) AS h2o_sigma,
         STDDEV_POP(co2) AS co2_sigma FROM tower GROUP BY 1, 2, 3""")
def _(t):
    return t.tower().groupBy(*PERIOD).agg(
        *[F.stddev_pop(c).alias(n) for c, n in (("u", "u_sigma"), ("v", "v_sigma"), ("w", "w_sigma"),
                                               ("ts_c", "ts_sigma"), ("h2o", "h2o_sigma"), ("co2", "co2_sigma"))])


@check("f08_covariances", P, " ".join(_SECOND),
       f"{_CONST} SELECT site, height, period_us, {_PRODS} FROM d GROUP BY 1, 2, 3")
def _(t):
    return moments.detrended_covariances(t.tower(), PERIOD, _SECOND)


@check("f08_covariances_linear", P, " ".join(_SECOND),
       f"{_LINEAR} SELECT site, height, period_us, {_PRODS} FROM d GROUP BY 1, 2, 3")
def _(t):
    return moments.detrended_covariances(_seconds(t.tower()), PERIOD, _SECOND, "linear", "t")


@check("f09_momentum_flux", P, "tau ustar",
       f"""{_CONST} SELECT site, height, period_us, tau, sqrt(tau) AS ustar FROM (
         SELECT site, height, period_us, sqrt(AVG(u_p * w_p) ** 2 + AVG(v_p * w_p) ** 2) AS tau FROM d GROUP BY 1, 2, 3)""")
def _(t):
    from ..functions.stability import friction_velocity, momentum_flux

    g = moments.detrended_covariances(t.tower(), PERIOD, {"uw": ("u", "w"), "vw": ("v", "w")})
    tau = momentum_flux(F.col("uw"), F.col("vw"))
    return g.select(*PERIOD, tau.alias("tau"), friction_velocity(tau).alias("ustar"))


@check("f11_turbulent_kinetic_energy", P, "tke",
       """WITH @tower SELECT site, height, period_us, 0.5 * (VAR_POP(u) + VAR_POP(v) + VAR_POP(w)) AS tke
         FROM tower GROUP BY 1, 2, 3""")
def _(t):
    return t.tower().groupBy(*PERIOD).agg(
        (0.5 * (F.var_pop("u") + F.var_pop("v") + F.var_pop("w"))).alias("tke"))


@check("f12_third_order_transport", P, "tke_transport uw_transport w_ts_transport ts_var_transport",
       f"""{_CONST} SELECT site, height, period_us, AVG(w_p * 0.5 * (u_p * u_p + v_p * v_p + w_p * w_p)) AS tke_transport,
         AVG(w_p * u_p * w_p) AS uw_transport, AVG(w_p * ts_c_p * w_p) AS w_ts_transport,
         AVG(w_p * ts_c_p * ts_c_p) AS ts_var_transport FROM d GROUP BY 1, 2, 3""")
def _(t):
    d = moments.detrend(t.tower(), PERIOD, ["u", "v", "w", "ts_c"])
    u, v, w, s = (F.col(c) for c in ("u_p", "v_p", "w_p", "ts_c_p"))
    return d.groupBy(*PERIOD).agg(
        F.avg(w * 0.5 * (u * u + v * v + w * w)).alias("tke_transport"), F.avg(w * u * w).alias("uw_transport"),
        F.avg(w * s * w).alias("w_ts_transport"), F.avg(w * s * s).alias("ts_var_transport"))


@check("f13_correlations", P, "w_u_corr w_ts_corr uw__w_ts_corr w_h2o__w_ts_corr",
       f"""{_CONST} SELECT site, height, period_us, corr(w_p, u_p) AS w_u_corr, corr(w_p, ts_c_p) AS w_ts_corr,
         corr(u_p * w_p, ts_c_p * w_p) AS uw__w_ts_corr, corr(h2o_p * w_p, ts_c_p * w_p) AS w_h2o__w_ts_corr
         FROM d GROUP BY 1, 2, 3""")
def _(t):
    d = moments.detrend(t.tower(), PERIOD, ["u", "w", "ts_c", "h2o"])
    u, w, s, q = (F.col(c) for c in ("u_p", "w_p", "ts_c_p", "h2o_p"))
    return d.groupBy(*PERIOD).agg(
        F.corr(w, u).alias("w_u_corr"), F.corr(w, s).alias("w_ts_corr"),
        F.corr(u * w, s * w).alias("uw__w_ts_corr"), F.corr(q * w, s * w).alias("w_h2o__w_ts_corr"))


@check("f14_skewness", P, "u_skew w_skew ts_skew",
       """WITH @tower SELECT site, height, period_us, skewness(u) AS u_skew, skewness(w) AS w_skew,
         skewness(ts_c) AS ts_skew FROM tower GROUP BY 1, 2, 3""")
def _(t):
    return t.tower().groupBy(*PERIOD).agg(
        *[moments.corrected_skewness(F.col(c)).alias(n) for c, n in (("u", "u_skew"), ("w", "w_skew"),
                                                                     ("ts_c", "ts_skew"))])


_EFF = f"""{_CONST}, p AS (SELECT site, height, period_us, w_p AS w, w_p * ts_c_p AS p FROM d),
  q AS (SELECT *, SUM(p) OVER (PARTITION BY site, height, period_us) AS total FROM p),
  g AS (SELECT site, height, period_us, MAX(total) AS total, COUNT(p) AS n,
    SUM(p) FILTER (p * total > 0) AS down,
    COALESCE(SUM(p) FILTER (p * total > 0 AND w > 0), 0) AS ej, COALESCE(SUM(p) FILTER (p * total > 0 AND w < 0), 0) AS sw,
    COUNT(*) FILTER (p * total > 0 AND w > 0) AS kej, COUNT(*) FILTER (p * total > 0 AND w < 0) AS ksw FROM q GROUP BY 1, 2, 3)"""


def _efficiency(t):
    d = moments.detrend(t.tower(), PERIOD, ["w", "ts_c"])
    g = d.groupBy(*PERIOD).agg(*moments.transport_efficiency(F.col("w_p"), F.col("ts_c_p"), "e"))
    return g.select(*PERIOD, *[c.alias(n) for n, c in moments.efficiency_columns("e").items()])


@check("f15_transport_efficiency", P, "eta",
       f"{_EFF} SELECT site, height, period_us, total / down AS eta FROM g")
def _(t):
    return _efficiency(t)


@check("f16_ejection_sweep_asymmetry", P, "delta_flux delta_time",
       f"""{_EFF} SELECT site, height, period_us, CASE WHEN total <> 0 THEN ej / total - sw / total END AS delta_flux,
         CASE WHEN total <> 0 THEN kej / n::DOUBLE - ksw / n::DOUBLE END AS delta_time FROM g""")
def _(t):
    return _efficiency(t)


_LATERAL = {f"{a}_{n}_cov": (a, c) for a in ("u", "v") for c, n in (("ts_c", "ts"), ("fw", "fw"), ("h2o", "h2o"),
                                                                    ("co2", "co2"))}


@check("f17_lateral_fluxes", P, " ".join(_LATERAL),
       f"{_CONST} SELECT site, height, period_us, "
       + ", ".join(f"AVG({x}_p * {y}_p) AS {n}" for n, (x, y) in _LATERAL.items()) + " FROM d GROUP BY 1, 2, 3")
def _(t):
    return moments.detrended_covariances(t.tower(), PERIOD, _LATERAL)


@check("d22_equal_period_check", "site height n_periods n_min n_max equal", "",
       """WITH @tower, g AS (SELECT site, height, period_us, COUNT(*) AS n FROM tower GROUP BY 1, 2, 3)
         SELECT site, height, COUNT(*) AS n_periods, MIN(n) AS n_min, MAX(n) AS n_max,
         CAST(MIN(n) = MAX(n) AS INTEGER) AS equal FROM g GROUP BY 1, 2""")
def _(t):
    return periods.equal_period_check(t.tower(), ["site", "height"], "period_us")


@check("g01_detrend_constant", "event_id", "u_p ts_c_p", f"{_CONST} SELECT event_id, u_p, ts_c_p FROM d")
def _(t):
    return moments.detrend(t.tower(), PERIOD, ["u", "ts_c"])


@check("g01_detrend_linear", "event_id", "u_p ts_c_p", f"{_LINEAR} SELECT event_id, u_p, ts_c_p FROM d")
def _(t):
    return moments.detrend(_seconds(t.tower()), PERIOD, ["u", "ts_c"], "linear", "t")


@check("g01_detrend_piecewise", "event_id segment", "u_p",
       f"""WITH @tower, tt AS (SELECT *, {_TSEC} AS t FROM tower), s AS (SELECT *, CAST(t >= -57600 AS INTEGER)
         + CAST(t >= -28800 AS INTEGER) AS segment FROM tt)
         SELECT event_id, segment, u - (regr_intercept(u, t) OVER g + regr_slope(u, t) OVER g * t) AS u_p
         FROM s WINDOW g AS (PARTITION BY site, height, period_us, segment)""")
def _(t):
    return moments.detrend_piecewise(_seconds(t.tower()), PERIOD, ["u"], "t", [-57_600.0, -28_800.0])


@check("e13_period_values_on_samples", "event_id", "u_mean w_mean",
       """WITH @tower SELECT event_id, AVG(u) OVER g AS u_mean, AVG(w) OVER g AS w_mean FROM tower
         WINDOW g AS (PARTITION BY site, height, period_us)""")
def _(t):
    stats = t.tower().groupBy(*PERIOD).agg(F.avg("u").alias("u_mean"), F.avg("w").alias("w_mean"))
    return t.tower().join(stats, PERIOD)


@check("c01_date_vector", "event_id year doy hhmm us_back", "second",
       """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS doy,
         CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS hhmm, round((epoch_us(ts) % 60000000) / 1000000.0::DOUBLE, 2) AS second,
         epoch_us(ts) - epoch_us(ts) % 60000000 + CAST(round(round((epoch_us(ts) % 60000000) / 1000000.0::DOUBLE, 2) * 100) AS BIGINT) * 10000 AS us_back
         FROM events""")
def _(t):
    df = t.tower().select("event_id", *[c.alias(n) for n, c in timecodes.to_date_vector(F.col("us")).items()])
    return df.withColumn("us_back", timecodes.from_date_vector(
        F.col("year"), F.col("doy"), F.col("hhmm"), F.col("second")))


@check("c02_serial_day", "event_id us_back", "serial_day epoch_s",
       """SELECT event_id, 719529 + epoch_us(ts) / 86400000000.0::DOUBLE AS serial_day, epoch_us(ts) / 1000000.0::DOUBLE AS epoch_s,
         CAST(round((719529 + epoch_us(ts) / 86400000000.0::DOUBLE - 719529) * 86400000.0::DOUBLE) AS BIGINT) * 1000 AS us_back FROM events""",
       digits=5)
def _(t):
    us = F.col("us")
    day = timecodes.to_serial_day(us)
    return t.tower().select("event_id", timecodes.from_serial_day(day).alias("us_back"),
                            day.alias("serial_day"), timecodes.epoch_seconds(us).alias("epoch_s"))
