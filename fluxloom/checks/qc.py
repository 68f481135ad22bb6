"""Checks of limits, spikes, flags, screening and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wind
from ..operators import qc
from .registry import check
from .standin import CHUNK_US, DAY_US, HOUR_US, KEYS, PERIOD

_LIM = {"u": (4.2, 7.5), "w": (-1.2, 0.6), "ts_c": (15.0, 24.0)}


@check("d01_absolute_limits", "event_id", "u w ts_c",
       "WITH @tower SELECT event_id, " + ", ".join(
           f"CASE WHEN {c} BETWEEN {a} AND {b} THEN {c} END AS {c}" for c, (a, b) in _LIM.items()) + " FROM tower")
def _(t):
    return qc.absolute_limits(t.tower().select("event_id", "u", "w", "ts_c"), _LIM)


@check("d02_temperature_auto_unit", "event_id", "temp",
       """WITH @tower, x AS (SELECT event_id, site, height, CASE WHEN height > 5 THEN ts_c + 273.15 ELSE ts_c END AS temp FROM tower)
         SELECT event_id, temp - CASE WHEN MEDIAN(temp) OVER (PARTITION BY site, height) > 250 THEN 273.15 ELSE 0 END AS temp FROM x""")
def _(t):
    x = t.tower().withColumn("temp", F.when(F.col("height") > 5, F.col("ts_c") + 273.15).otherwise(F.col("ts_c")))
    return qc.kelvin_to_celsius(x, KEYS, "temp")


@check("c10_unit_inference", "site height temperature_unit pressure_unit", "",
       """WITH @tower, x AS (SELECT site, height, CASE WHEN height > 5 THEN ts_c + 273.15 ELSE ts_c END AS temp,
           p_kpa * CASE WHEN height > 15 THEN 1000 WHEN height > 3 THEN 10 ELSE 1 END AS p FROM tower),
         m AS (SELECT site, height, MEDIAN(temp) AS mt, MEDIAN(p) AS mp FROM x GROUP BY 1, 2)
         SELECT site, height, CASE WHEN mt > 200 THEN 'K' ELSE 'degC' END AS temperature_unit,
           CASE WHEN mp > 50000 THEN 'Pa' WHEN mp > 200 THEN 'hPa' ELSE 'kPa' END AS pressure_unit FROM m""")
def _(t):
    x = t.tower().select(
        "site", "height", F.when(F.col("height") > 5, F.col("ts_c") + 273.15).otherwise(F.col("ts_c")).alias("temp"),
        (F.col("p_kpa") * F.when(F.col("height") > 15, 1000).when(F.col("height") > 3, 10).otherwise(1)).alias("p"))
    return qc.infer_unit(x, KEYS, "temp", "p")


_SPK = f"""WITH @tower, b AS (SELECT *, us - us % {DAY_US // 2} AS s0 FROM tower),
 e AS (SELECT *, UNNEST([s0, s0 - {DAY_US // 2}]) AS win FROM b),
 g AS (SELECT site, height, win, AVG(u) AS mu, STDDEV_POP(u) AS su, AVG(w) AS mw, STDDEV_POP(w) AS sw FROM e GROUP BY 1, 2, 3),
 f AS (SELECT e.event_id, bool_or(coalesce(su > 0 AND abs(u - mu) >= 1.9 * su, FALSE)) AS u_spike,
   bool_or(coalesce(sw > 0 AND abs(w - mw) >= 1.7 * sw, FALSE)) AS w_spike
   FROM e JOIN g ON e.site = g.site AND e.height = g.height AND e.win = g.win GROUP BY 1),
 s AS (SELECT b.*, f.u_spike, f.w_spike FROM b JOIN f ON b.event_id = f.event_id)"""


def _spikes(t):
    return qc.sigma_spikes(t.tower(), KEYS, "us", {"u": 1.9, "w": 1.7}, DAY_US)


@check("d03_sigma_spike_test", "event_id u_spike w_spike", "",
       f"{_SPK} SELECT event_id, CAST(u_spike AS INTEGER) AS u_spike, CAST(w_spike AS INTEGER) AS w_spike FROM s")
def _(t):
    return _spikes(t).select("event_id", F.col("u_spike").cast("int"), F.col("w_spike").cast("int"))


_RUNS = f"""{_SPK}, l AS (SELECT *, CASE WHEN w_spike IS DISTINCT FROM LAG(w_spike) OVER (PARTITION BY site, height ORDER BY us) THEN 1 ELSE 0 END AS ch FROM s),
 i AS (SELECT *, SUM(ch) OVER (PARTITION BY site, height ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM l),
 n AS (SELECT * EXCLUDE (w_spike), w_spike AND COUNT(*) OVER (PARTITION BY site, height, run) <= 1 AS w_spike FROM i)"""


@check("d04_long_run_unflag", "event_id w_spike", "",
       f"{_RUNS} SELECT event_id, CAST(w_spike AS INTEGER) AS w_spike FROM n")
def _(t):
    out = qc.unflag_long_runs(_spikes(t), KEYS, "us", "w_spike", 1, CHUNK_US)
    return out.select("event_id", F.col("w_spike").cast("int"))


@check("d05_spike_interpolation", "event_id", "u_clean",
       f"""{_SPK}, x AS (SELECT *, CASE WHEN NOT u_spike THEN u END AS good FROM s),
         c AS (SELECT *, COUNT(good) OVER g AS kk, COUNT(*) OVER g AS nn,
           last_value(CASE WHEN good IS NOT NULL THEN us END IGNORE NULLS) OVER p AS bo, last_value(good IGNORE NULLS) OVER p AS bx,
           first_value(CASE WHEN good IS NOT NULL THEN us END IGNORE NULLS) OVER q AS ao, first_value(good IGNORE NULLS) OVER q AS ax FROM x
           WINDOW g AS (PARTITION BY site, height, period_us),
           p AS (PARTITION BY site, height, period_us ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           q AS (PARTITION BY site, height, period_us ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
         SELECT event_id, CASE WHEN kk >= 2 AND nn - kk <= 0.6 * nn THEN CASE WHEN u_spike THEN
           bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) ELSE u END END AS u_clean FROM c""")
def _(t):
    return qc.interpolate_spikes(_spikes(t), PERIOD, "us", "u", "u_spike", CHUNK_US)


@check("d06_iterative_despike", "site height day us u_spike", "u w")
def _(t):
    x = t.tower().withColumn("day", F.expr(f"(us div {DAY_US})"))
    out = qc.despike_to_convergence(x, KEYS, "day", "us", {"u": 1.9, "w": 1.7}, 3, 1)
    return out.withColumn("u_spike", F.col("u_spike").cast("int"))


@check("d06_iterative_despike_passes", "event_id", "u",
       None)
def _(t):
    from ..session import cut_lineage

    x = t.tower().select("event_id", *KEYS, "us", "period_us", "u", "w")
    return qc.despike_passes(x, KEYS, "us", {"u": 1.9}, DAY_US, 1, qc.MOST_PASSES, CHUNK_US,
                             lambda df: cut_lineage(df, "despike"))


@check("d07_period_flags", "site height period_us spike missing", "",
       f"""{_SPK} SELECT site, height, period_us, CAST(AVG(CAST(u_spike AS INTEGER)) >= 0.02 AS INTEGER) AS spike,
         CAST(AVG(CAST(u IS NULL AS INTEGER)) >= 0.05 AS INTEGER) AS missing FROM s GROUP BY 1, 2, 3""")
def _(t):
    x = _spikes(t).select(*PERIOD, F.col("u_spike").alias("spike"), F.col("u").isNull().alias("missing"))
    out = qc.period_flags(x, PERIOD, {"spike": 0.02, "missing": 0.05})
    return out.select(*PERIOD, F.col("spike").cast("int"), F.col("missing").cast("int"))


_DIAG = """d AS (SELECT site, height, period_us, coalesce(AVG(diag), 0) >= 0.05 AS sonic_flag, coalesce(AVG(signal) <= 0.72, FALSE) AS signal_flag,
  coalesce(AVG(h2o) <= 10.2, FALSE) AS gas_flag FROM tower GROUP BY 1, 2, 3)"""


def _diagnostics(t):
    return qc.diagnostic_flags(t.tower(), PERIOD, "diag", "signal", "h2o", 0.05, 0.72, 10.2, reversed_polarity=True)


@check("d08_diagnostic_flags", "site height period_us sonic_flag signal_flag gas_flag", "",
       f"WITH @tower, {_DIAG} SELECT site, height, period_us, " + ", ".join(
           f"CAST({c} AS INTEGER) AS {c}" for c in ("sonic_flag", "signal_flag", "gas_flag")) + " FROM d")
def _(t):
    return _diagnostics(t).select(*PERIOD, *[F.col(c).cast("int") for c in ("sonic_flag", "signal_flag", "gas_flag")])


_FRAME = f"""{_SPK}, {_DIAG}, ff AS (SELECT s.site, s.height, s.period_us, AVG(CAST(u_spike OR u IS NULL AS INTEGER)) >= 0.13 AS uf,
   AVG(CAST(v IS NULL AS INTEGER)) >= 0.05 AS vf, AVG(CAST(w_spike AS INTEGER)) >= 0.2 AS wf,
   AVG(CAST(ts_c IS NULL AS INTEGER)) >= 0.05 AS tsf, STDDEV_POP(w) AS w_sigma_raw, STDDEV_POP(u) AS u_sigma_raw, STDDEV_POP(ts_c) AS ts_sigma,
   sqrt(covar_pop(u, w) ** 2 + covar_pop(v, w) ** 2) AS "Tau_raw", covar_pop(w, ts_c) AS w_ts_cov_raw
   FROM s GROUP BY 1, 2, 3),
 r AS (SELECT ff.*, wf OR sonic_flag AS unrot, uf OR vf OR wf OR sonic_flag AS rot FROM ff JOIN d USING (site, height, period_us))"""


def _frames(t):
    s = _spikes(t)
    share = lambda c, x: (F.avg(c.cast("double")) >= x)
    f = s.groupBy(*PERIOD).agg(
        share(F.col("u_spike") | F.col("u").isNull(), 0.13).alias("uf"), share(F.col("v").isNull(), 0.05).alias("vf"),
        share(F.col("w_spike"), 0.2).alias("wf"), share(F.col("ts_c").isNull(), 0.05).alias("tsf"),
        F.stddev_pop("w").alias("w_sigma_raw"), F.stddev_pop("u").alias("u_sigma_raw"), F.stddev_pop("ts_c").alias("ts_sigma"),
        F.hypot(F.covar_pop("u", "w"), F.covar_pop("v", "w")).alias("Tau_raw"), F.covar_pop("w", "ts_c").alias("w_ts_cov_raw"))
    f = f.join(_diagnostics(t), PERIOD)
    flags = qc.frame_flags(F.col("uf"), F.col("vf"), F.col("wf"), F.col("sonic_flag"))
    return f.select("*", *[c.alias(n) for n, c in flags.items()])


@check("d09_frame_flag_union", "site height period_us unrot rot", "",
       f"{_FRAME} SELECT site, height, period_us, CAST(unrot AS INTEGER) AS unrot, CAST(rot AS INTEGER) AS rot FROM r")
def _(t):
    return _frames(t).select(*PERIOD, F.col("unrot").cast("int"), F.col("rot").cast("int"))


@check("d10_flag_driven_blanking", "site height period_us", "w_sigma_raw u_sigma_raw ts_sigma Tau_raw w_ts_cov_raw",
       f"""{_FRAME} SELECT site, height, period_us, CASE WHEN NOT unrot THEN w_sigma_raw END AS w_sigma_raw,
         CASE WHEN NOT rot THEN u_sigma_raw END AS u_sigma_raw, CASE WHEN NOT tsf THEN ts_sigma END AS ts_sigma,
         CASE WHEN NOT rot THEN "Tau_raw" END AS "Tau_raw", CASE WHEN NOT unrot AND NOT tsf THEN w_ts_cov_raw END AS w_ts_cov_raw FROM r""")
def _(t):
    return qc.blank(_frames(t))


_DIR = """WITH @tower, d AS (SELECT event_id, site, height, period_us, CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN
  degrees(atan2(-v, u)) + 45 - 360 * floor((degrees(atan2(-v, u)) + 45) / 360) END AS dir FROM tower)"""


def _directions(t):
    d, _ = wind.direction_speed(F.col("u"), F.col("v"), F.lit(45.0))
    return t.tower().select("event_id", *PERIOD, d.alias("dir"))


@check("d11_tower_shadow", "event_id shadow", "lo hi",
       f"""{_DIR}, s AS (SELECT *, (345.0 + height) - 360 * floor((345.0 + height) / 360) AS c FROM d),
         b AS (SELECT *, CASE WHEN c - 20 < 0 THEN c + 340 ELSE c - 20 END AS lo, CASE WHEN c + 20 > 360 THEN c - 340 ELSE c + 20 END AS hi FROM s)
         SELECT event_id, lo, hi, CAST(coalesce(CASE WHEN lo > hi THEN dir > lo OR dir < hi ELSE dir > lo AND dir < hi END, FALSE) AS INTEGER) AS shadow FROM b""")
def _(t):
    lo, hi = wind.shadow_sector(F.lit(345.0), F.col("height"), F.lit(20.0))
    d = _directions(t).select("*", lo.alias("lo"), hi.alias("hi"))
    return d.withColumn("shadow", wind.shadow_flag(F.col("dir"), F.col("lo"), F.col("hi")).cast("int"))


@check("d12_direction_window", "site height period_us", "share",
       f"""{_DIR}, a AS (SELECT *, abs((dir - 350 + 180) - 360 * floor((dir - 350 + 180) / 360) - 180) AS sep FROM d WHERE dir IS NOT NULL)
         SELECT site, height, period_us, AVG(CAST(sep <= 62 + 1e-9 AS INTEGER)) AS share FROM a GROUP BY 1, 2, 3""")
def _(t):
    d = _directions(t).filter(F.col("dir").isNotNull())
    return d.groupBy(*PERIOD).agg(F.avg(wind.in_direction_window(F.col("dir"), 350.0, 62.0).cast("double")).alias("share"))


@check("d13_direction_sector", "event_id sector", "",
       f"""{_DIR}, s(sector, lo, hi) AS (VALUES (1, 330.0, 35.0), (2, 35.0, 50.0), (3, 50.0, 330.0))
         SELECT event_id, s.sector FROM d JOIN s ON (hi > lo AND dir > lo AND dir <= hi) OR (hi < lo AND (dir > lo OR dir <= hi))""")
def _(t):
    sectors = F.array(*[F.struct(F.lit(i).alias("sector"), F.lit(a).alias("lo"), F.lit(b).alias("hi"))
                        for i, a, b in ((1, 330.0, 35.0), (2, 35.0, 50.0), (3, 50.0, 330.0))])
    d = _directions(t).filter(F.col("dir").isNotNull()).withColumn("s", F.explode(sectors))
    return d.filter(wind.in_sector(F.col("dir"), F.col("s.lo"), F.col("s.hi"))).select("event_id", "s.sector")


@check("d14_planar_fit_admission", "site height period_us", "u v w",
       f"""{_FRAME}, m AS (SELECT site, height, period_us, AVG(u) AS u, AVG(v) AS v, AVG(w) AS w FROM tower GROUP BY 1, 2, 3)
         SELECT m.* FROM m JOIN r USING (site, height, period_us) WHERE NOT rot AND NOT gas_shadow(site) AND
         sqrt(u * u + v * v) BETWEEN CASE WHEN abs(height - 10.85) <= 0.01 THEN 5.2 ELSE 0.5 END AND 20"""
       .replace(" AND NOT gas_shadow(site)", ""))
def _(t):
    m = t.tower().groupBy(*PERIOD).agg(*[F.avg(c).alias(c) for c in ("u", "v", "w")])
    f = m.join(_frames(t).select(*PERIOD, "rot"), PERIOD)
    return qc.planar_fit_admission(f, ["rot"], F.hypot("u", "v"), min_by_height={10.85: 5.2})


@check("d15_date_windows", "site height win n_days", "u",
       f"""WITH @tower, p AS (SELECT site, height, (period_us - 1) // {DAY_US} AS day, AVG(u) AS u, MAX(value) AS top FROM tower GROUP BY 1, 2, 3),
         span AS (SELECT site, height, MIN(day) AS lo, MAX(day) AS hi FROM p GROUP BY 1, 2),
         bar AS (SELECT site, height, day FROM p WHERE top > 300 UNION SELECT site, height, lo FROM span UNION SELECT site, height, hi FROM span),
         w AS (SELECT site, height, ROW_NUMBER() OVER g AS win, day AS d0, LEAD(day) OVER g AS d1 FROM bar
           WINDOW g AS (PARTITION BY site, height ORDER BY day))
         SELECT p.site, p.height, CAST(w.win AS INTEGER) AS win, COUNT(*) AS n_days, AVG(p.u) AS u FROM p JOIN w ON p.site = w.site AND p.height = w.height
           AND p.day BETWEEN d0 AND d1 WHERE p.top > 50 GROUP BY 1, 2, 3""")
def _(t):
    from pyspark.sql import Window as W

    p = t.tower().groupBy(*KEYS, F.expr(f"(period_us - 1) div {DAY_US}").alias("day")).agg(
        F.avg("u").alias("u"), F.max("value").alias("top"))
    span = p.groupBy(*KEYS).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    barriers = span.join(p.filter("top > 300").select(*KEYS, "day"), KEYS, "left").withColumn(
        "day", F.coalesce("day", "lo"))
    windows = qc.date_windows(barriers, KEYS, "lo", "hi", "day")
    accepted = p.filter("top > 50").select(*KEYS, "day")
    return qc.in_windows(p, windows, KEYS, "day", accepted).groupBy(*KEYS, F.col("window").alias("win")).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("u").alias("u"))


def _bad(gravity=1.0):
    cols = [F.col(c) for c in ("ax", "ay", "az", "gx", "gy", "gz", "roll", "pitch", "yaw")]
    return qc.implausible_attitude(*cols, accel_tol=0.2, gyro_max=60.0)


_BAD = """(abs(sqrt(ax * ax + ay * ay + az * az) - 1.0) > 0.2 OR abs(gx) > 60 OR abs(gy) > 60 OR abs(gz) > 60
  OR abs(roll) > 45 OR abs(pitch) > 45 OR abs(yaw) > 180)"""


@check("d16_attitude_plausibility", "event_id bad", "",
       f"WITH @imu SELECT event_id, CAST({_BAD} AS INTEGER) AS bad FROM imu")
def _(t):
    return t.platform().select("event_id", _bad().cast("int").alias("bad"))


@check("d17_attitude_cleaning", "site us", "ax roll yaw",
       f"""WITH @imu, i AS (SELECT * EXCLUDE (us), us - us % {HOUR_US} AS us FROM imu), s AS (SELECT site, MIN(us) AS t0 FROM i GROUP BY 1)
         SELECT i.site, i.us, AVG(ax) AS ax, AVG(roll) AS roll, AVG(yaw) AS yaw FROM i JOIN s ON i.site = s.site
         WHERE us > t0 + {DAY_US} AND NOT {_BAD} GROUP BY 1, 2""")
def _(t):
    imu = t.platform().withColumn("us", F.col("us") - F.pmod(F.col("us"), F.lit(HOUR_US)))
    starts = imu.groupBy("site").agg((F.min("us") + DAY_US).alias("start_us"))
    return qc.clean_attitude(imu, starts, ["site"], "us", ["ax", "roll", "yaw"], _bad(), False, True)


_FROZEN = """WITH @imu, l AS (SELECT *, CASE WHEN (roll, pitch) IS DISTINCT FROM LAG((roll, pitch)) OVER (PARTITION BY site ORDER BY us) THEN 1 ELSE 0 END AS ch FROM imu),
 r AS (SELECT *, SUM(ch) OVER (PARTITION BY site ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM l),
 z AS (SELECT *, MAX(us) OVER (PARTITION BY site, run) - MIN(us) OVER (PARTITION BY site, run) >= 300000000 AS frozen FROM r)"""


def _frozen(t):
    return qc.frozen_attitude(t.platform(), ["site"], "us", "roll", "pitch", 300_000_000, CHUNK_US)


@check("d24_frozen_attitude", "event_id frozen", "",
       f"{_FROZEN} SELECT event_id, CAST(frozen AS INTEGER) AS frozen FROM z")
def _(t):
    return _frozen(t).select("event_id", F.col("frozen").cast("int"))


@check("d25_accel_tilt_substitution", "event_id", "roll pitch",
       f"""{_FROZEN} SELECT event_id, CASE WHEN frozen THEN degrees(atan2(ay, az)) ELSE roll END AS roll,
         CASE WHEN frozen THEN degrees(atan2(-ax, sqrt(ay * ay + az * az))) ELSE pitch END AS pitch FROM z""")
def _(t):
    return qc.substitute_accel_tilt(_frozen(t))


@check("d19_rate_validation", "site height win n accepted", "median_dt rate_hz coverage",
       f"""WITH @tower, x AS (SELECT site, height, us // {2 * DAY_US} AS win, us FROM tower),
         l AS (SELECT *, (us - LAG(us) OVER g) / 1000000.0::DOUBLE AS dt, ROW_NUMBER() OVER g AS rn FROM x WINDOW g AS (PARTITION BY site, height, win ORDER BY us))
         SELECT site, height, win, COUNT(*) AS n, MEDIAN(dt) FILTER (rn <= 31) AS median_dt, 1 / MEDIAN(dt) FILTER (rn <= 31) AS rate_hz,
           COUNT(*) / 86.4::DOUBLE AS coverage, CAST(COUNT(*) >= 0.1 * 86.4 AS INTEGER) AS accepted FROM l GROUP BY 1, 2, 3""")
def _(t):
    x = t.tower().withColumn("win", F.expr(f"us div {2 * DAY_US}"))
    return qc.validate_rate(x, KEYS, "win", "us", 0.0005, 2 * DAY_US, CHUNK_US, first=30)


@check("d20_source_alignment", "site height warn", "share",
       f"""WITH @grid, h AS (SELECT DISTINCT site, height, us + {HOUR_US} AS us FROM slots)
         SELECT g.site, g.height, AVG(CAST(h.us IS NOT NULL AS INTEGER)) AS share, CAST(AVG(CAST(h.us IS NOT NULL AS INTEGER)) < 0.75 AS INTEGER) AS warn
         FROM grid g LEFT JOIN h ON g.site = h.site AND g.height = h.height AND g.us = h.us GROUP BY 1, 2""")
def _(t):
    return qc.alignment_share(t.grid(), t.slots(), KEYS, "us", HOUR_US, KEYS, 0.75)


@check("d21_gap_acceptance", "event_id", "missing_frac",
       """WITH @tower, f AS (SELECT event_id, AVG(CAST(u IS NULL AS INTEGER)) OVER (PARTITION BY site, height, period_us) AS missing_frac FROM tower)
         SELECT * FROM f WHERE missing_frac <= 0.03 AND missing_frac < 1""")
def _(t):
    return qc.accept_gaps(t.tower(), PERIOD, "u", 0.03)


@check("d23_row_count_consistency", "event_id", "",
       f"""WITH @tower, x AS (SELECT *, us // {HOUR_US} AS file FROM tower), n AS (SELECT file, site, COUNT(*) AS n FROM x GROUP BY 1, 2),
         g AS (SELECT file FROM n GROUP BY 1 HAVING MIN(n) = MAX(n)) SELECT event_id FROM x WHERE file IN (SELECT file FROM g)""")
def _(t):
    x = t.tower().withColumn("file", F.expr(f"us div {HOUR_US}"))
    return qc.consistent_files(x, "file", "site")


@check("d26_gross_value_clip", "rec", "flux",
       """WITH @prod SELECT rec, CASE WHEN rssi > 0.9 THEN NULL WHEN abs(flux_a * 8) <= 2000 THEN flux_a * 8 END AS flux FROM prod""")
def _(t):
    p = t.products().select("rec", F.when(F.col("rssi") > 0.9, "INF?").otherwise((F.col("flux_a") * 8).cast("string")).alias("flux"))
    return qc.clip_gross(p, ["flux"])
