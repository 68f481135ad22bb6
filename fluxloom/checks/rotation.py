"""Checks of planar fits, rotations and wind functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wind
from ..operators import qc, rotation
from .registry import check
from .standin import CHUNK_US, DAY_US, KEYS, PERIOD

_MEANS = f"""WITH @tower, m AS (SELECT site, height, period_us, (period_us - 1) // {DAY_US} AS day, AVG(u) AS u, AVG(v) AS v, AVG(w) AS w
  FROM tower GROUP BY ALL),
 md AS (SELECT *, degrees(atan2(-v, u)) - 360 * floor(degrees(atan2(-v, u)) / 360) AS direction FROM m)"""

# normal equations by Cramer's rule on raw sums
_FIT = """SELECT {k}, n, (sw - b1 * su - b2 * sv) / n AS b0, b1, b2, degrees(asin(-b1 / sqrt(1 + b1 * b1))) AS pitch_deg,
   degrees(asin(b2 / sqrt(1 + b2 * b2))) AS roll_deg FROM (
   SELECT *, ((suw - su * sw / n) * (svv - sv * sv / n) - (svw - sv * sw / n) * (suv - su * sv / n)) / det AS b1,
     ((svw - sv * sw / n) * (suu - su * su / n) - (suw - su * sw / n) * (suv - su * sv / n)) / det AS b2 FROM (
     SELECT *, (suu - su * su / n) * (svv - sv * sv / n) - (suv - su * sv / n) ** 2 AS det FROM (
       SELECT {k}, COUNT(*) AS n, SUM(u) AS su, SUM(v) AS sv, SUM(w) AS sw, SUM(u * u) AS suu, SUM(v * v) AS svv,
         SUM(u * v) AS suv, SUM(u * w) AS suw, SUM(v * w) AS svw FROM {src}
       WHERE u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL GROUP BY {k} HAVING COUNT(*) >= 4)))"""


def _fit(k, src):
    return _FIT.format(k=k, src=src)


def _means(t):
    m = t.tower().groupBy(*PERIOD).agg(*[F.avg(c).alias(c) for c in ("u", "v", "w")])
    d, _ = wind.direction_speed(F.col("u"), F.col("v"), F.lit(0.0))
    return m.select("*", F.expr(f"(period_us - 1) div {DAY_US}").alias("day"), d.alias("direction"))


@check("f18_planar_fit", "site height n", "b0 b1 b2 pitch_deg roll_deg", f"{_MEANS} {_fit('site, height', 'md')}")
def _(t):
    return rotation.planar_fit(_means(t), KEYS)


_SECT = f"""{_MEANS}, sec(sector_lo, sector_hi) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (300.0, 2.0), (2.0, 20.0), (20.0, 300.0)),
 sm AS (SELECT * FROM md JOIN sec ON sector_lo = sector_hi OR (sector_hi > sector_lo AND direction > sector_lo AND direction <= sector_hi)
   OR (sector_hi < sector_lo AND (direction > sector_lo OR direction <= sector_hi)))"""


@check("f19_sector_and_single_fit", "site height sector_lo sector_hi n", "b0 b1 b2 pitch_deg roll_deg",
       f"{_SECT} {_fit('site, height, sector_lo, sector_hi', 'sm')}")
def _(t):
    return rotation.sector_fits(_means(t), KEYS, "direction", [300.0, 2.0, 20.0])


@check("f20_cumulative_fit", "height day kind n", "b0 b1 b2",
       f"""{_MEANS}, so AS (SELECT a.height, a.day, b.u, b.v, b.w FROM (SELECT DISTINCT height, day FROM m) a JOIN m b ON a.height = b.height AND b.day <= a.day),
         x AS (SELECT height, day, 'so_far' AS kind, u, v, w FROM so UNION ALL SELECT height, day // 4, 'day', u, v, w FROM m WHERE FALSE)
         SELECT height, day, kind, n, b0, b1, b2 FROM ({_fit('height, day, kind', 'x')})""")
def _(t):
    return rotation.cumulative_fits(_means(t), ["height"], "day").filter("kind = 'so_far'")


@check("f20_daily_fit", "site day kind n", "b0 b1 b2",
       f"""{_MEANS}, x AS (SELECT site, day, 'day' AS kind, u, v, w FROM m)
         SELECT site, day, kind, n, b0, b1, b2 FROM ({_fit('site, day, kind', 'x')})""")
def _(t):
    return rotation.cumulative_fits(_means(t), ["site"], "day").filter("kind = 'day'")


@check("f21_bootstrap_tilt", "site height n_fits", "sd_pitch sd_roll",
       f"""{_MEANS}, p AS (SELECT site, height, u, v, w, ROW_NUMBER() OVER (PARTITION BY site, height ORDER BY period_us) - 1 AS i FROM m
           WHERE u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL),
         sz AS (SELECT site, height, COUNT(*) AS n FROM p GROUP BY 1, 2),
         dr AS (SELECT p.site, p.height, r, CAST('0x' || substr(md5('0|' || p.site || '|' || p.height || '|' || r || '|' || p.i), 1, 15) AS BIGINT) % sz.n AS i
           FROM p JOIN sz ON p.site = sz.site AND p.height = sz.height, range(50) t(r)),
         x AS (SELECT dr.site, dr.height, dr.r, p.u, p.v, p.w FROM dr JOIN p ON dr.site = p.site AND dr.height = p.height AND dr.i = p.i)
         SELECT site, height, COUNT(*) AS n_fits, STDDEV_POP(pitch_deg) AS sd_pitch, STDDEV_POP(roll_deg) AS sd_roll
         FROM ({_fit('site, height, r', 'x')}) GROUP BY 1, 2""")
def _(t):
    return rotation.bootstrap_tilt(_means(t), KEYS, "period_us", 50)


@check("f22_direction_gap_edges", "site height empty_bins", "edge",
       f"""WITH @tower, h AS (SELECT DISTINCT site, height, CAST(floor((degrees(atan2(-v, u)) - 360 * floor(degrees(atan2(-v, u)) / 360)) / 2.5) AS INTEGER) AS bin
           FROM tower WHERE u IS NOT NULL AND v IS NOT NULL),
         n AS (SELECT *, coalesce(LEAD(bin) OVER (PARTITION BY site, height ORDER BY bin), MIN(bin) OVER (PARTITION BY site, height) + 144) AS nx FROM h)
         SELECT site, height, nx - bin - 1 AS empty_bins, ((bin + 1) * 2.5 + (nx - bin - 1) * 1.25) % 360 AS edge FROM n WHERE nx - bin > 1""")
def _(t):
    d, _ = wind.direction_speed(F.col("u"), F.col("v"), F.lit(0.0))
    return rotation.direction_gap_edges(t.tower().withColumn("d", d), KEYS, "d", 2.5)


@check("f10_friction_velocity", "height n", "ustar_double ustar_rotated",
       """WITH @tower, x AS (SELECT height, u, v, w FROM tower WHERE u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL),
         a AS (SELECT *, atan2(AVG(v) OVER g, AVG(u) OVER g) AS th, COUNT(*) OVER g AS n FROM x WINDOW g AS (PARTITION BY height)),
         b AS (SELECT *, u * cos(th) + v * sin(th) AS u1, v * cos(th) - u * sin(th) AS v1 FROM a WHERE n >= 100),
         c AS (SELECT *, atan2(AVG(w) OVER g, AVG(u1) OVER g) AS ph FROM b WINDOW g AS (PARTITION BY height)),
         d AS (SELECT *, u1 * cos(ph) + w * sin(ph) AS u2, w * cos(ph) - u1 * sin(ph) AS w2 FROM c)
         SELECT height, MAX(n) AS n, (covar_pop(u2, w2) ** 2 + covar_pop(v1, w2) ** 2) ** 0.25 AS ustar_double,
           (covar_pop(u, w) ** 2 + covar_pop(v, w) ** 2) ** 0.25 AS ustar_rotated FROM d GROUP BY 1""")
def _(t):
    return rotation.friction_velocity_double_rotation(t.tower(), ["height"])


_AXES = """WITH @tower, a AS (SELECT event_id, height, CASE WHEN height < 4 THEN v WHEN height < 11 THEN -u ELSE u END AS ua,
  CASE WHEN height < 4 THEN -u WHEN height < 11 THEN -v ELSE v END AS va FROM tower)"""


def _axes(t):
    maker = F.when(F.col("height") < 4, wind.RMYOUNG).when(F.col("height") < 11, wind.GILL).otherwise(wind.CAMPBELL)
    ua, va = wind.sonic_axes(F.col("u"), F.col("v"), maker)
    return t.tower().select("event_id", "height", ua.alias("ua"), va.alias("va"))


@check("w01_axis_convention", "event_id", "ua va", f"{_AXES} SELECT event_id, ua, va FROM a")
def _(t):
    return _axes(t)


_WD = f"""{_AXES}, d AS (SELECT event_id, sqrt(ua * ua + va * va) AS speed, CASE WHEN ua IS NOT NULL AND va IS NOT NULL THEN
  degrees(atan2(-va, ua)) + height * 10 END AS x FROM a), dd AS (SELECT event_id, speed, x - 360 * floor(x / 360) AS direction FROM d)"""


def _wd(t):
    d, s = wind.direction_speed(F.col("ua"), F.col("va"), F.col("height") * 10)
    return _axes(t).select("event_id", d.alias("direction"), s.alias("speed"))


@check("w02_direction_and_speed", "event_id", "direction speed", f"{_WD} SELECT event_id, direction, speed FROM dd")
def _(t):
    return _wd(t)


@check("w03_compass_label", "event_id label", "",
       f"""{_WD} SELECT event_id, coalesce(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']
         [CAST(round_even(direction / 22.5, 0) AS INTEGER) % 16 + 1], '') AS label FROM dd""")
def _(t):
    return _wd(t).select("event_id", wind.compass_label(F.col("direction")).alias("label"))


# P = D'C' written out with sines and cosines of pitch and roll
_PF = f"""{_MEANS}, fit AS ({_fit('site, height', 'md')}),
 r AS (SELECT t.event_id, t.site, t.height, t.period_us, t.u, t.v, t.w - b0 AS w0, -b1 / sqrt(b1 * b1 + b2 * b2 + 1) AS p31,
   -b2 / sqrt(b1 * b1 + b2 * b2 + 1) AS p32, 1 / sqrt(b1 * b1 + b2 * b2 + 1) AS p33 FROM tower t JOIN fit f ON t.site = f.site AND t.height = f.height),
 q AS (SELECT *, sqrt(p32 * p32 + p33 * p33) AS ca, p31 AS sa, -p32 / sqrt(p32 * p32 + p33 * p33) AS sb, p33 / sqrt(p32 * p32 + p33 * p33) AS cb FROM r),
 pf AS (SELECT event_id, site, height, period_us, ca * u + sa * sb * v - sa * cb * w0 AS u_r, CASE WHEN u IS NOT NULL THEN cb * v + sb * w0 END AS v_r, sa * u - ca * sb * v + ca * cb * w0 AS w_r FROM q)"""


@check("w04_planar_fit_application", "event_id", "u_r v_r w_r", f"{_PF} SELECT event_id, u_r, v_r, w_r FROM pf")
def _(t):
    return rotation.apply_fit(t.tower(), rotation.planar_fit(_means(t), KEYS), KEYS)


_YAW = """y AS (SELECT *, AVG(u_r) OVER g AS mu, AVG(v_r) OVER g AS mv FROM pf WINDOW g AS (PARTITION BY site, height, period_us)),
 yy AS (SELECT event_id, site, height, period_us, (mu * u_r + mv * v_r) / sqrt(mu * mu + mv * mv) AS u_r, (mu * v_r - mv * u_r) / sqrt(mu * mu + mv * mv) AS v_r, w_r FROM y)"""


@check("w05_yaw_into_mean_wind", "event_id", "u_r v_r w_r", f"{_PF}, {_YAW} SELECT event_id, u_r, v_r, w_r FROM yy")
def _(t):
    pf = rotation.apply_fit(t.tower(), rotation.planar_fit(_means(t), KEYS), KEYS)
    return rotation.apply_yaw(pf, PERIOD, "u_r", "v_r")


_LOCAL = _PF.replace("fit AS (", "gm AS (SELECT site, height, period_us, day, u, v, w FROM (SELECT site, height, period_us, (period_us - 1) // "
                     f"{10 * DAY_US}" + " AS day, AVG(u) AS u, AVG(v) AS v, AVG(w) AS w FROM tower WHERE diag = 0 GROUP BY ALL)), fit AS (", 1).replace(
    _fit("site, height", "md"), _fit("site, height, day", "gm")).replace(
    "FROM tower t JOIN fit f ON t.site = f.site AND t.height = f.height", f"FROM tower t LEFT JOIN fit f ON t.site = f.site AND t.height = f.height AND (t.period_us - 1) // {10 * DAY_US} = f.day")


@check("w06_local_rotation", "event_id", "u_r v_r w_r", f"{_LOCAL}, {_YAW} SELECT event_id, u_r, v_r, w_r FROM yy")
def _(t):
    files = t.tower().withColumn("day", F.expr(f"(period_us - 1) div {10 * DAY_US}"))
    keys = [*KEYS, "day"]
    return rotation.local_rotation(files, keys, [*keys, "period_us"], F.col("diag") == 0)


@check("w07_global_fit_job", "site height win sector_lo sector_hi n", "b0 b1 b2",
       f"""{_MEANS}, f AS (SELECT site, height, period_us, AVG(CAST(u IS NULL AS INTEGER)) >= 0.08 AS bad FROM tower GROUP BY 1, 2, 3),
         adm AS (SELECT m.* FROM m JOIN f USING (site, height, period_us) WHERE NOT bad AND sqrt(u * u + v * v) BETWEEN 0.5 AND 20),
         wn AS (SELECT site, height, 1 AS win, MIN(day) AS d0, 19737 AS d1 FROM m GROUP BY 1, 2 UNION ALL SELECT site, height, 2, 19737, MAX(day) FROM m GROUP BY 1, 2),
         sp AS (SELECT adm.*, win, (ROW_NUMBER() OVER (PARTITION BY adm.site, adm.height, win ORDER BY period_us) - 1) // 2 AS step
           FROM adm JOIN wn ON adm.site = wn.site AND adm.height = wn.height AND adm.day BETWEEN d0 AND d1),
         st AS (SELECT site, height, win, step, AVG(u) AS u, AVG(v) AS v, AVG(w) AS w FROM sp GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = 2),
         sd AS (SELECT *, degrees(atan2(-v, u)) - 360 * floor(degrees(atan2(-v, u)) / 360) AS direction FROM st),
         sec(sector_lo, sector_hi) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (180.0, 3.0), (3.0, 180.0)),
         x AS (SELECT * FROM sd JOIN sec ON sector_lo = sector_hi OR (sector_hi > sector_lo AND direction > sector_lo AND direction <= sector_hi)
           OR (sector_hi < sector_lo AND (direction > sector_lo OR direction <= sector_hi)))
         SELECT site, height, CAST(win AS INTEGER) AS win, sector_lo, sector_hi, n, b0, b1, b2 FROM ({_fit('site, height, win, sector_lo, sector_hi', 'x')})""")
def _(t):
    bad = t.tower().groupBy(*PERIOD).agg((F.avg(F.col("u").isNull().cast("double")) >= 0.08).alias("bad"))
    p = _means(t).drop("direction").join(bad, PERIOD)
    span = p.groupBy(*KEYS).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    windows = qc.date_windows(span.withColumn("day", F.lit(19737).cast("long")), KEYS, "lo", "hi", "day")
    out = rotation.global_fit_job(p, KEYS, "period_us", 10 * DAY_US, ["bad"], [180.0, 3.0], windows, KEYS, "day", 2)
    return out.withColumnRenamed("window", "win")


@check("w08_slope_geometry", "event_id", "a1 a2 vertical_flux",
       f"""{_WD}, s AS (SELECT *, degrees(asin(cos(radians(direction - 30)) * sin(radians(12)))) AS a1,
           degrees(asin(cos(radians(direction - 30 - 90)) * sin(radians(12)))) AS a2 FROM dd)
         SELECT s.event_id, a1, a2, t.w * t.ts_c * cos(radians(12)) - t.u * t.ts_c * sin(radians(a1)) - t.v * t.ts_c * sin(radians(a2)) AS vertical_flux
         FROM s JOIN tower t ON s.event_id = t.event_id""")
def _(t):
    a1, a2 = wind.slope_angles(F.col("direction"), 12.0, 30.0)
    s = _wd(t).select("event_id", a1.alias("a1"), a2.alias("a2")).join(t.tower(), "event_id")
    return s.withColumn("vertical_flux", F.col("w") * F.col("ts_c") * F.cos(F.radians(F.lit(12.0)))
                        - F.col("u") * F.col("ts_c") * F.sin(F.radians("a1")) - F.col("v") * F.col("ts_c") * F.sin(F.radians("a2")))


@check("w09_rotation_and_taylor_diagnostics", "site height period_us taylor_ok", "u_mean v_mean w_mean w_over_sigma mean_wind sigma_m taylor_ratio wavelength wavenumber",
       """WITH @tower, g AS (SELECT site, height, period_us, AVG(u) AS u_mean, AVG(v) AS v_mean, AVG(w) AS w_mean, STDDEV_POP(w) AS sw,
           STDDEV_POP(sqrt(u * u + v * v)) AS sigma_m FROM tower GROUP BY 1, 2, 3),
         h AS (SELECT *, sqrt(u_mean * u_mean + v_mean * v_mean) AS mean_wind, w_mean / sw AS w_over_sigma FROM g)
         SELECT site, height, period_us, u_mean, v_mean, w_mean, w_over_sigma, mean_wind, sigma_m, sigma_m / mean_wind AS taylor_ratio,
           CAST(sigma_m / mean_wind < 0.5 AS INTEGER) AS taylor_ok, mean_wind / 0.1 AS wavelength, 2 * pi() * 0.1 / mean_wind AS wavenumber FROM h""")
def _(t):
    from ..operators.windows import taylor_diagnostics

    d = taylor_diagnostics(t.tower(), PERIOD)
    return (d.withColumn("taylor_ok", F.col("taylor_ok").cast("int"))
            .withColumn("wavelength", F.col("mean_wind") / 0.1)
            .withColumn("wavenumber", 2 * F.lit(3.141592653589793) * 0.1 / F.col("mean_wind")))
