"""Checks of platform attitude and motion correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attitude as at
from ..operators import motion
from .registry import check
from .standin import DAY_US

_R = """r AS (SELECT event_id, radians(roll) AS ro, radians(pitch) AS pi_, radians(yaw) AS ya, ax * 9.80665 AS ax, -ay * 9.80665 AS ay, az * 9.80665 AS az,
  radians(gx) AS p, -radians(gy) AS q, radians(gz) AS r_ FROM imu)"""


def _si(t, **kw):
    ch = {c: F.col(c) for c in ("ax", "ay", "az", "gx", "gy", "gz", "roll", "pitch", "yaw")}
    return t.platform().select("event_id", "site", "us", *[c.alias(n) for n, c in at.to_platform_frame(
        ch, accel_signs=(1, -1, 1), gyro_signs=(1, -1, 1), **kw).items()])


_MAT = """m AS (SELECT *, cos(ya) * cos(pi_) AS t00, cos(ya) * sin(pi_) * sin(ro) - sin(ya) * cos(ro) AS t01, cos(ya) * sin(pi_) * cos(ro) + sin(ya) * sin(ro) AS t02,
  sin(ya) * cos(pi_) AS t10, sin(ya) * sin(pi_) * sin(ro) + cos(ya) * cos(ro) AS t11, sin(ya) * sin(pi_) * cos(ro) - cos(ya) * sin(ro) AS t12,
  -sin(pi_) AS t20, cos(pi_) * sin(ro) AS t21, cos(pi_) * cos(ro) AS t22 FROM r)"""


@check("m01_platform_frame", "event_id", "ax ay az p q r roll pitch yaw",
       f"""WITH @imu, {_R}, {_MAT}, c AS (SELECT cos(radians(-2)) * cos(radians(3)) AS d00 , radians(4) AS a, radians(3) AS b, radians(-2) AS g),
         k AS (SELECT cos(g) * cos(b) AS k00, cos(g) * sin(b) * sin(a) - sin(g) * cos(a) AS k01, cos(g) * sin(b) * cos(a) + sin(g) * sin(a) AS k02,
           sin(g) * cos(b) AS k10, sin(g) * sin(b) * sin(a) + cos(g) * cos(a) AS k11, sin(g) * sin(b) * cos(a) - cos(g) * sin(a) AS k12,
           -sin(b) AS k20, cos(b) * sin(a) AS k21, cos(b) * cos(a) AS k22 FROM c),
         z AS (SELECT *, t20 * k00 + t21 * k01 + t22 * k02 AS n20, t20 * k10 + t21 * k11 + t22 * k12 AS n21, t20 * k20 + t21 * k21 + t22 * k22 AS n22,
           t10 * k00 + t11 * k01 + t12 * k02 AS n10, t00 * k00 + t01 * k01 + t02 * k02 AS n00 FROM m, k)
         SELECT event_id, k00 * ax + k01 * ay + k02 * az AS ax, k10 * ax + k11 * ay + k12 * az AS ay, k20 * ax + k21 * ay + k22 * az AS az,
           k00 * p + k01 * q + k02 * r_ AS p, k10 * p + k11 * q + k12 * r_ AS q, k20 * p + k21 * q + k22 * r_ AS r,
           atan2(n21, n22) AS roll, -asin(n20) AS pitch, atan2(n10, n00) AS yaw FROM z""")
def _(t):
    return _si(t, mount_deg=(4.0, 3.0, -2.0))


@check("m02_euler_matrix", "event_id", "e0 e1 e2 roll pitch yaw",
       f"""WITH @imu, {_R}, {_MAT} SELECT event_id, t00 * ax + t01 * ay + t02 * az AS e0, t10 * ax + t11 * ay + t12 * az AS e1, t20 * ax + t21 * ay + t22 * az AS e2,
         ro AS roll, pi_ AS pitch, CASE WHEN ya <= -pi() THEN ya ELSE ya END AS yaw FROM m""")
def _(t):
    s = _si(t)
    m = at.rotation_matrix(F.col("roll"), F.col("pitch"), F.col("yaw"))
    e = at.apply_matrix(m, [F.col("ax"), F.col("ay"), F.col("az")])
    r, p, y = at.euler_angles(m)
    return s.select("event_id", *[x.alias(f"e{i}") for i, x in enumerate(e)], r.alias("roll"), p.alias("pitch"), y.alias("yaw"))


@check("m03_accelerometer_tilt", "event_id", "roll pitch",
       f"WITH @imu, {_R} SELECT event_id, atan2(ay, az) AS roll, atan2(-ax, sqrt(ay * ay + az * az)) AS pitch FROM r")
def _(t):
    r, p = at.accel_tilt(F.col("ax"), F.col("ay"), F.col("az"))
    return _si(t).select("event_id", r.alias("roll"), p.alias("pitch"))


@check("m04_euler_and_body_rates", "event_id", "dr dp dy p q r",
       f"""WITH @imu, {_R} SELECT event_id, p + tan(pi_) * (q * sin(ro) + r_ * cos(ro)) AS dr, q * cos(ro) - r_ * sin(ro) AS dp, (q * sin(ro) + r_ * cos(ro)) / cos(pi_) AS dy,
         p, q, r_ AS r FROM r""")
def _(t):
    s = _si(t)
    rates = at.euler_rates(*[F.col(c) for c in ("roll", "pitch", "p", "q", "r")])
    s = s.select("event_id", "roll", "pitch", *[x.alias(n) for n, x in zip(("dr", "dp", "dy"), rates)])
    back = at.body_rates(*[F.col(c) for c in ("roll", "pitch", "dr", "dp", "dy")])
    return s.select("event_id", "dr", "dp", "dy", *[x.alias(n) for n, x in zip("pqr", back)])


STEP = 1_000_000
DAY = ["site", "day"]


def _series(t):
    """Records of a site and day with ten minutes told as a second, so that gaps and several records a slot both occur."""
    imu = _si(t).select("event_id", "site", F.expr(f"us div {DAY_US}").alias("day"), F.expr("us div 600").alias("us"),
                        "ax", "ay", "az", "p", "q", "r", "roll", "pitch", (F.col("yaw") * 0.97).alias("yaw"))
    return imu.join(t.tower().select("event_id", "u", "v", "w"), "event_id").drop("event_id")


@check("m05_complementary_attitude", "site day us", "roll pitch yaw")
def _(t):
    samples, _ = motion.regular(_series(t), DAY, "us", STEP, motion.ACCEL + motion.GYRO)
    return motion.complementary_attitude(samples, DAY, "us", STEP, 20.0, chunk=50)


@check("m06_platform_velocity", "site day us", "vx vy vz")
def _(t):
    samples, _ = motion.regular(_series(t), DAY, "us", STEP, motion.ACCEL + motion.ANGLES)
    return motion.platform_velocity(samples, DAY, "us", STEP, 20.0, chunk=50)


@check("m07_motion_corrected_wind", "site day us", "u_true v_true w_true vx vy vz")
def _(t):
    return motion.correct_wind(_series(t), DAY, "us", STEP, (0.3, -0.2, 2.5), attitude="complementary", chunk=50)[0]


_SLOTS = f"""slots AS (SELECT site, us // {DAY_US} AS day, (us // 600) // {STEP} AS s, @means FROM imu JOIN tower USING (event_id, site, us) GROUP BY ALL),
  ends AS (SELECT site, day, MIN(s) AS s0, MAX(s) AS s1 FROM slots GROUP BY 1, 2),
  grid AS (SELECT g.site, g.day, g.s, slots.* EXCLUDE (site, day, s) FROM (SELECT site, day, UNNEST(range(s0, s1 + 1)) AS s FROM ends) g
    LEFT JOIN slots ON slots.site = g.site AND slots.day = g.day AND slots.s = g.s)"""


def _fill(c: str) -> str:
    """Linear filling with held ends; windows b (back) and a (ahead) run over the slots of a day."""
    at_b, at_a = (f"{f}(CASE WHEN {c} IS NOT NULL THEN s END IGNORE NULLS) OVER {w}" for f, w in (("last_value", "b"), ("first_value", "a")))
    x_b, x_a = (f"{f}({c} IGNORE NULLS) OVER {w}" for f, w in (("last_value", "b"), ("first_value", "a")))
    return f"coalesce({c}, {x_b} + ({x_a} - {x_b}) * (s - {at_b})::DOUBLE / nullif({at_a} - {at_b}, 0), {x_b}, {x_a}) AS {c}"


_WINDOWS = "WINDOW b AS (PARTITION BY site, day ORDER BY s), a AS (PARTITION BY site, day ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_MEANS = "AVG(u) AS u, AVG(v) AS v, AVG(w) AS w, AVG(radians(roll)) AS roll, AVG(radians(pitch)) AS pitch, AVG(radians(yaw) * 0.97::DOUBLE) AS yaw"
_TILT = f"""WITH @imu, @tower, {_SLOTS.replace("@means", _MEANS)},
  f AS (SELECT site, day, s, u, v, w, {_fill("roll")}, {_fill("pitch")}, {_fill("yaw")} FROM grid {_WINDOWS}),
  j AS (SELECT *, yaw - LAG(yaw) OVER (PARTITION BY site, day ORDER BY s) AS jump FROM f),
  y AS (SELECT * EXCLUDE (yaw), yaw + SUM(CASE WHEN jump > pi() THEN -2 * pi() WHEN jump < -pi() THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY site, day ORDER BY s) AS yaw FROM j),
  c AS (SELECT * EXCLUDE (yaw), yaw - AVG(yaw) OVER (PARTITION BY site, day) AS yaw FROM y),
  d AS (SELECT *, @d FROM c WINDOW o AS (PARTITION BY site, day ORDER BY s)),
  q AS (SELECT *, droll - dyaw * sin(pitch) AS p_, dpitch * cos(roll) + dyaw * cos(pitch) * sin(roll) AS q_, -dpitch * sin(roll) + dyaw * cos(pitch) * cos(roll) AS r_ FROM d),
  z AS (SELECT *, u + q_ * 2.5 - r_ * -0.2 AS a, v + r_ * 0.3 - p_ * 2.5 AS b, w + p_ * -0.2 - q_ * 0.3 AS e FROM q)
  SELECT site, day, s * {STEP} AS us, cos(yaw) * cos(pitch) * a + (cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll)) * b + (cos(yaw) * sin(pitch) * cos(roll) + sin(yaw) * sin(roll)) * e AS u_true,
    sin(yaw) * cos(pitch) * a + (sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll)) * b + (sin(yaw) * sin(pitch) * cos(roll) - cos(yaw) * sin(roll)) * e AS v_true,
    -sin(pitch) * a + cos(pitch) * sin(roll) * b + cos(pitch) * cos(roll) * e AS w_true FROM z""".replace("@d", ", ".join(
        f"(coalesce(LEAD({c}) OVER o, {c}) - coalesce(LAG({c}) OVER o, {c})) / nullif((LEAD({c}) OVER o IS NOT NULL)::INT + (LAG({c}) OVER o IS NOT NULL)::INT, 0) AS d{c}"
        for c in motion.ANGLES))


@check("m07_tilt_and_lever_arm", "site day us", "u_true v_true w_true", _TILT)
def _(t):
    return motion.correct_wind(_series(t), DAY, "us", STEP, (0.3, -0.2, 2.5), accel=False, gyro=False, chunk=50)[0]


@check("m07_gap_fractions", "site day slots", "ax_gap p_gap yaw_gap",
       f"""WITH @imu, @tower, {_SLOTS.replace("@means", "COUNT(*) AS n")} SELECT site, day, COUNT(*) AS slots, AVG((n IS NULL)::INT) AS ax_gap, AVG((n IS NULL)::INT) AS p_gap,
         AVG((n IS NULL)::INT) AS yaw_gap FROM grid GROUP BY 1, 2""")
def _(t):
    return motion.correct_wind(_series(t), DAY, "us", STEP, (0.3, -0.2, 2.5))[1]


@check("m08_band_variance_and_heave", "site day valid", "band_var heave_sd")
def _(t):
    rows = _series(t).withColumn("az", F.col("az") / at.GRAVITY)
    samples, _ = motion.regular(rows, DAY, "us", STEP, ["az"])
    h = motion.heave_velocity(samples, DAY, "us", STEP, "az", 0.05, 0.3, chunk=50).groupBy(*DAY).agg(F.stddev_pop("heave").alias("heave_sd"))
    return motion.band_variance(rows, DAY, "us", STEP, "az", 0.05, 0.3, min_valid=20, chunk=50).join(h, DAY)


@check("f36_mount_tilt", "site", "mount_roll mount_pitch",
       "WITH @imu SELECT site, -MEDIAN(roll + ax) AS mount_roll, MEDIAN(pitch + ax) AS mount_pitch FROM imu GROUP BY 1")
def _(t):
    from ..operators.quantiles import exact_quantiles

    imu = t.platform().select("site", (F.col("roll") + F.col("ax")).alias("roll"), (F.col("pitch") + F.col("ax")).alias("pitch"))
    r = exact_quantiles(imu, ["site"], "roll", {"m": 0.5}).select("site", (-F.col("m")).alias("mount_roll"))
    p = exact_quantiles(imu, ["site"], "pitch", {"m": 0.5}).select("site", F.col("m").alias("mount_pitch"))
    return r.join(p, "site")
