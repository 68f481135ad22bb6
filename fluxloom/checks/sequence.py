"""Checks of gap filling, sessions, runs, integrals, extrema and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan, sequence
from .registry import check
from .standin import CHUNK_US, DAY_US, HOUR_US, KEYS, PERIOD

_FILL = """WITH @grid, v AS (SELECT site, height, us AS o, u AS x FROM grid WHERE u IS NOT NULL),
 b AS (SELECT g.site, g.height, g.us, g.u, v.o AS bo, v.x AS bx FROM grid g ASOF LEFT JOIN v
   ON g.site = v.site AND g.height = v.height AND g.us >= v.o),
 a AS (SELECT b.*, v.o AS ao, v.x AS ax FROM b ASOF LEFT JOIN v ON b.site = v.site AND b.height = v.height AND b.us <= v.o),
 f AS (SELECT *, CASE WHEN bo IS NULL THEN ax WHEN ao IS NULL OR ao = bo THEN bx
   ELSE bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) END AS lin FROM a)"""


@check("g02_linear_gap_fill", "site height us u_was_missing", "u_filled",
       f"""{_FILL} SELECT site, height, us, CAST(u IS NULL AS INTEGER) AS u_was_missing, lin AS u_filled FROM f""")
def _(t):
    return sequence.fill_linear(t.grid(), KEYS, "us", ["u"], CHUNK_US)


@check("g03_gap_fill_with_limit", "site height us u_was_missing", "u_filled",
       f"""{_FILL} SELECT site, height, us, CAST(u IS NULL AS INTEGER) AS u_was_missing,
         CASE WHEN bo IS NOT NULL AND us - bo <= {2 * HOUR_US} THEN lin END AS u_filled FROM f""")
def _(t):
    return sequence.fill_linear(t.grid(), KEYS, "us", ["u"], CHUNK_US, limit_us=2 * HOUR_US)


@check("g04_carry_first_row", "site height us", "u w",
       f"""WITH @grid, g AS (SELECT *, us // {DAY_US} AS batch FROM grid),
         r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site, height, batch ORDER BY us) AS rn,
           LAG(u) OVER (PARTITION BY site, height ORDER BY us) AS pu, LAG(w) OVER (PARTITION BY site, height ORDER BY us) AS pw FROM g)
         SELECT site, height, us, CASE WHEN rn = 1 AND u IS NULL THEN pu ELSE u END AS u,
           CASE WHEN rn = 1 AND w IS NULL THEN pw ELSE w END AS w FROM r""")
def _(t):
    g = t.grid().withColumn("batch", F.expr(f"us div {DAY_US}"))
    return sequence.carry_from_previous_batch(g, KEYS, "us", "batch", ["u", "w"])


@check("g05_gap_sessions", "site height session first_us last_us n", "",
       f"""WITH @tower, l AS (SELECT *, LAG(us) OVER (PARTITION BY site, height ORDER BY us) AS p FROM tower),
         s AS (SELECT *, CAST(SUM(CASE WHEN us - p > {2 * HOUR_US} THEN 1 ELSE 0 END) OVER (PARTITION BY site, height ORDER BY us
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l)
         SELECT site, height, session, MIN(us) AS first_us, MAX(us) AS last_us, COUNT(*) AS n FROM s GROUP BY 1, 2, 3""")
def _(t):
    return sequence.session_bounds(t.tower(), KEYS, "us", 2 * HOUR_US, CHUNK_US)


@check("g06_hold_exit_jumps", "site us", "hold_s jump",
       f"""WITH @imu, l AS (SELECT site, us, roll * 100 AS y, LAG(us) OVER w AS p, LAG(roll * 100) OVER w AS py FROM imu
           WINDOW w AS (PARTITION BY site ORDER BY us)),
         s AS (SELECT *, SUM(CASE WHEN us - p > {HOUR_US // 2} THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY us
           ROWS UNBOUNDED PRECEDING) AS session FROM l),
         z AS (SELECT *, COUNT(*) OVER (PARTITION BY site, session) AS n,
           CASE WHEN p IS NULL OR us - p > {HOUR_US // 2} OR y <> py THEN 1 ELSE 0 END AS start FROM s),
         st AS (SELECT *, COUNT(*) OVER (PARTITION BY site, session) AS k, LAG(us) OVER (PARTITION BY site, session ORDER BY us) AS pus,
           LAG(y) OVER (PARTITION BY site, session ORDER BY us) AS pyy FROM z WHERE start = 1)
         SELECT site, us, (us - pus) / 1000000.0::DOUBLE AS hold_s,
           (y - pyy + 180) - 360 * floor((y - pyy + 180) / 360) - 180 AS jump FROM st WHERE n > 10 AND k >= 3 AND pus IS NOT NULL""")
def _(t):
    imu = t.platform().select("site", "us", (F.col("roll") * 100).alias("yaw"))
    return sequence.hold_exit_jumps(imu, ["site"], "us", "yaw", HOUR_US // 2, 10, CHUNK_US)


@check("g09_cumulative_trapezoid", "event_id", "integral",
       """WITH @tower, l AS (SELECT *, LAG(us) OVER g AS pus, LAG(w) OVER g AS pw FROM tower WINDOW g AS (PARTITION BY site, height ORDER BY us))
         SELECT event_id, SUM(coalesce((w + pw) / 2.0 * (us - pus) / 1000000.0::DOUBLE, 0)) OVER (PARTITION BY site, height ORDER BY us
           ROWS UNBOUNDED PRECEDING) AS integral FROM l""", digits=4)
def _(t):
    return sequence.cumulative_trapezoid(t.tower(), KEYS, "us", "w", CHUNK_US)


@check("g09_cumulative_sum", "event_id", "path",
       """WITH @tower SELECT event_id, SUM(w) OVER (PARTITION BY site, height ORDER BY us ROWS UNBOUNDED PRECEDING) * 0.05 AS path FROM tower""")
def _(t):
    out = scan.running(t.tower(), KEYS, "us", {"path": ("sum", F.col("w"))}, CHUNK_US)
    return out.withColumn("path", F.col("path") * 0.05)


@check("g11_moving_mean", "event_id", "smooth",
       """WITH @tower SELECT event_id, SUM(w) OVER (PARTITION BY site, height, period_us ORDER BY us
         ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE AS smooth FROM tower""")
def _(t):
    return sequence.moving_mean(t.tower(), PERIOD, "us", "w", 2)


@check("g12_zero_crossings", "site height us", "offset_s",
       """WITH @tower, l AS (SELECT *, LEAD(us) OVER g AS nus, LEAD(w) OVER g AS nw FROM tower WINDOW g AS (PARTITION BY site, height ORDER BY us))
         SELECT site, height, us, w / (w - nw) * (nus - us) / 1000000.0::DOUBLE AS offset_s FROM l
         WHERE w > 0 AND nw < 0""", digits=4)
def _(t):
    return sequence.zero_crossings(t.tower(), KEYS, "us", "w", CHUNK_US)


@check("g13_extrema_and_wave_amplitude", "site height us", "trough amplitude",
       """WITH @tower, l AS (SELECT *, LAG(w) OVER g AS p, LEAD(w) OVER g AS n FROM tower WINDOW g AS (PARTITION BY site, height ORDER BY us)),
         e AS (SELECT site, height, us, w, CASE WHEN w < p AND w <= n THEN -1 WHEN w > p AND w >= n THEN 1 END AS kind FROM l),
         mx AS (SELECT site, height, us AS mus, w AS mw FROM e WHERE kind = 1)
         SELECT e.site, e.height, e.us, e.w AS trough, mx.mw - e.w AS amplitude FROM e ASOF JOIN mx
           ON e.site = mx.site AND e.height = mx.height AND e.us <= mx.mus WHERE e.kind = -1""")
def _(t):
    return sequence.wave_amplitudes(t.tower(), KEYS, "us", "w", CHUNK_US)


@check("g17_unwrap_and_gradient", "event_id", "unwrapped rate",
       """WITH @imu, r AS (SELECT event_id, site, us, radians(yaw) + roll / 97.0::DOUBLE AS y FROM imu),
         l AS (SELECT *, LAG(y) OVER (PARTITION BY site ORDER BY us) AS p FROM r),
         c AS (SELECT *, SUM(CASE WHEN p IS NULL THEN 0 WHEN y - p > pi() THEN -2 * pi() WHEN y - p < -pi() THEN 2 * pi() ELSE 0 END)
           OVER (PARTITION BY site ORDER BY us ROWS UNBOUNDED PRECEDING) + y AS unwrapped FROM l)
         SELECT event_id, unwrapped, (coalesce(LEAD(unwrapped) OVER g, unwrapped) - coalesce(LAG(unwrapped) OVER g, unwrapped))
           / (CASE WHEN LEAD(us) OVER g IS NULL OR LAG(us) OVER g IS NULL THEN 1 ELSE 2 END) AS rate
         FROM c WINDOW g AS (PARTITION BY site ORDER BY us)""")
def _(t):
    import math

    imu = t.platform().select("event_id", "site", "us", (F.radians("yaw") + F.col("roll") / 97.0).alias("y"))
    out = sequence.unwrap(imu, ["site"], "us", "y", 2 * math.pi, CHUNK_US)
    return sequence.gradient(out, ["site"], "us", "unwrapped", CHUNK_US)


@check("d18_rolling_median_mad", "event_id spike", "",
       """WITH @tower, m AS (SELECT *, CASE WHEN COUNT(u) OVER g >= 1 THEN MEDIAN(u) OVER g END AS med FROM tower
           WINDOW g AS (PARTITION BY site, height, period_us ORDER BY us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
         s AS (SELECT *, 1.4826 * MEDIAN(abs(u - med)) OVER g AS scale FROM m
           WINDOW g AS (PARTITION BY site, height, period_us ORDER BY us ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
         SELECT event_id, CAST(coalesce(scale > 0 AND abs(u - med) > 3.5 * scale, FALSE) AS INTEGER) AS spike FROM s""")
def _(t):
    out = sequence.rolling_mad_mask(t.tower(), PERIOD, "us", "u", 9, 3.5)
    return out.withColumn("spike", F.col("spike").cast("int"))
