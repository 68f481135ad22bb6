"""Checks of grid, as-of, height, interval and comparison joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.wind import direction_speed, wrap360
from ..operators import joins
from .registry import check
from .standin import CHUNK_US, DAY_US, HOUR_US, KEYS, PERIOD


@check("e01_complete_grid", "site height us", "u w", "WITH @grid SELECT site, height, us, u, w FROM grid")
def _(t):
    return t.grid()


@check("e02_multi_logger_join", "site height us", "met_ts_c gas_h2o imu_roll",
       f"""WITH @grid SELECT g.site, g.height, g.us, m.ts_c AS met_ts_c, q.h2o AS gas_h2o, NULL::DOUBLE AS imu_roll
         FROM grid g LEFT JOIN slots m ON m.site = g.site AND m.height = g.height AND m.us + {HOUR_US} = g.us
         LEFT JOIN slots q ON q.site = g.site AND q.height = g.height AND q.us - {2 * HOUR_US} = g.us""")
def _(t):
    slots = t.slots()
    return joins.join_sources(t.grid(), KEYS, "us", {
        "met": (slots, ["ts_c"], HOUR_US), "gas": (slots, ["h2o"], -2 * HOUR_US), "imu": (None, ["roll"], 0)})


_ASOF = """WITH @tower, l AS (SELECT event_id, height, us FROM tower WHERE site = 'north'),
 r AS (SELECT height, us AS o, u AS x FROM tower WHERE site = 'south' AND u IS NOT NULL),
 b AS (SELECT l.event_id, l.height, l.us, r.o AS bo, r.x AS bx FROM l ASOF LEFT JOIN r ON l.height = r.height AND l.us >= r.o),
 a AS (SELECT b.*, r.o AS ao, r.x AS ax FROM b ASOF LEFT JOIN r ON b.height = r.height AND b.us <= r.o)"""


def _sides(t):
    tower = t.tower()
    left = tower.filter(F.col("site") == "north").select("event_id", "height", "us")
    right = tower.filter(F.col("site") == "south").select("height", "us", "u")
    return joins.bracketed(left, right, ["height"], "us", ["u"], CHUNK_US)


@check("e03_nearest_asof", "event_id height", "u_near",
       f"""{_ASOF} SELECT event_id, height, CASE WHEN least(coalesce(us - bo, 9e18), coalesce(ao - us, 9e18)) <= {HOUR_US}
         THEN CASE WHEN ao IS NULL OR us - bo <= ao - us THEN bx ELSE ax END END AS u_near FROM a""")
def _(t):
    return _sides(t).withColumn("u_near", joins.nearest_value("u", "us", HOUR_US))


@check("e04_interpolation_max_gap", "event_id height", "u_lin",
       f"""{_ASOF} SELECT event_id, height, CASE WHEN bo = us THEN bx WHEN ao = us THEN ax WHEN ao - bo <= {3 * HOUR_US}
         THEN bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) END AS u_lin FROM a""")
def _(t):
    return _sides(t).withColumn("u_lin", joins.linear_value("u", "us", 3 * HOUR_US))


@check("e05_slow_to_fast_interpolation", "event_id", "u_held u_open",
       """WITH @tower, r AS (SELECT site, height, period_us AS o, AVG(u) AS x FROM tower GROUP BY 1, 2, 3),
         b AS (SELECT l.event_id, l.site, l.height, l.us, r.o AS bo, r.x AS bx FROM tower l ASOF LEFT JOIN r
           ON l.site = r.site AND l.height = r.height AND l.us >= r.o),
         a AS (SELECT b.*, r.o AS ao, r.x AS ax FROM b ASOF LEFT JOIN r
           ON b.site = r.site AND b.height = r.height AND b.us <= r.o)
         SELECT event_id, CASE WHEN bo IS NULL THEN ax WHEN ao IS NULL OR ao = bo THEN bx
           ELSE bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) END AS u_held,
           CASE WHEN bo IS NULL OR ao IS NULL THEN NULL WHEN ao = bo THEN bx
           ELSE bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) END AS u_open FROM a""")
def _(t):
    tower = t.tower()
    slow = tower.groupBy(*PERIOD).agg(F.avg("u").alias("slow_u")).select(
        "site", "height", F.col("period_us").alias("us"), "slow_u")
    out = joins.bracketed(tower.select("event_id", "site", "height", "us"), slow, KEYS, "us", ["slow_u"], CHUNK_US)
    return out.select("event_id", joins.linear_value("slow_u", "us", hold_edges=True).alias("u_held"),
                      joins.linear_value("slow_u", "us").alias("u_open"))


@check("e06_height_tolerant_join", "site height n_left n_right", "",
       """WITH @tower, s AS (SELECT site, height, COUNT(*) AS n FROM tower GROUP BY 1, 2)
         SELECT site, height, n AS n_left, n AS n_right FROM s""")
def _(t):
    s = t.tower().groupBy("site", "height").agg(F.count(F.lit(1)).alias("n"))
    left = s.withColumnRenamed("n", "n_left")
    # the same heights as another logger would declare them
    right = s.select("site", (F.col("height") + 0.003).alias("height"), F.col("n").alias("n_right"))
    return joins.join_by_height(left, right, ["site"])


@check("e07_nearest_height", "site height", "sensor_height",
       """WITH @tower, lv AS (SELECT DISTINCT site, height FROM tower),
         se AS (SELECT site, height * 0.97::DOUBLE + 0.4 AS sh FROM lv WHERE height > 4),
         p AS (SELECT lv.site, lv.height, sh, ROW_NUMBER() OVER (PARTITION BY lv.site, lv.height
           ORDER BY abs(sh - lv.height), sh) AS rn FROM lv JOIN se ON lv.site = se.site)
         SELECT site, height, CASE WHEN abs(sh - height) <= 0.5 THEN sh END AS sensor_height FROM p WHERE rn = 1""")
def _(t):
    levels = t.tower().select("site", "height").distinct()
    sensors = levels.filter("height > 4").select("site", (F.col("height") * 0.97 + 0.4).alias("height"))
    return joins.nearest_height(levels, sensors, ["site"], 0.5)


_PERIODS = f"""WITH @tower, g AS (SELECT site, height, period_us, AVG(u) AS u, AVG(v) AS v, AVG(w) AS w FROM tower GROUP BY 1, 2, 3),
 d AS (SELECT *, degrees(atan2(-v, u)) - 360 * floor(degrees(atan2(-v, u)) / 360) AS direction,
   (period_us - 1) // {DAY_US} AS day FROM g)"""


def _period_winds(t):
    g = t.tower().groupBy(*PERIOD).agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.avg("w").alias("w"))
    direction, _ = direction_speed(F.col("u"), F.col("v"), F.lit(0.0))
    return g.select("*", direction.alias("direction"),
                    F.expr(f"(period_us - 1) div {DAY_US}").alias("day"))


@check("e08_fit_record_interval_join", "site height period_us", "rec b0 b1 b2",
       f"""{_PERIODS}, fits AS (
         SELECT 1 AS rec, site, height, 19723 AS d0, 19733 AS d1, 0.0 AS lo, 0.0 AS hi, AVG(u) AS b0, AVG(v) AS b1, AVG(w) AS b2
           FROM d GROUP BY site, height
         UNION ALL SELECT 2, site, height, 19733, 19742, 300.0, 5.0, MIN(u), MIN(v), MIN(w) FROM d GROUP BY site, height
         UNION ALL SELECT 3, site, height, 19742, 19748, 5.0, 60.0, MAX(u), MAX(v), MAX(w) FROM d GROUP BY site, height),
         h AS (SELECT d.site, d.height, d.period_us, f.rec, f.b0, f.b1, f.b2, ROW_NUMBER() OVER (PARTITION BY d.site, d.height, d.period_us ORDER BY f.rec DESC) AS rn
           FROM d JOIN fits f ON d.site = f.site AND d.height = f.height AND d.day BETWEEN f.d0 AND f.d1 AND
             (f.lo = f.hi OR (f.hi > f.lo AND d.direction > f.lo AND d.direction <= f.hi)
              OR (f.hi < f.lo AND (d.direction > f.lo OR d.direction <= f.hi))))
         SELECT d.site, d.height, d.period_us, h.rec, h.b0, h.b1, h.b2 FROM d LEFT JOIN h
           ON d.site = h.site AND d.height = h.height AND d.period_us = h.period_us AND h.rn = 1""")
def _(t):
    p = _period_winds(t)
    def rec(i, d0, d1, lo, hi, agg):
        return p.groupBy("site", "height").agg(agg("u").alias("b0"), agg("v").alias("b1"), agg("w").alias("b2")).select(
            F.lit(i).alias("rec"), "site", "height", F.lit(d0).alias("day_lo"), F.lit(d1).alias("day_hi"),
            F.lit(lo).alias("sector_lo"), F.lit(hi).alias("sector_hi"), "b0", "b1", "b2")
    fits = (rec(1, 19723, 19733, 0.0, 0.0, F.avg).unionByName(rec(2, 19733, 19742, 300.0, 5.0, F.min))
            .unionByName(rec(3, 19742, 19748, 5.0, 60.0, F.max)))
    return joins.fit_for_period(p, PERIOD, fits, F.col("day"), F.col("direction"))


@check("e09_sector_fit_with_fallback", "site height period_us from_sector", "b0 b1 b2",
       f"""{_PERIODS}, e AS (SELECT *, CAST(floor(direction / 90) AS BIGINT) AS sector FROM d),
         s AS (SELECT height, sector, AVG(u) AS b0, AVG(v) AS b1, AVG(w) AS b2 FROM e GROUP BY 1, 2 HAVING COUNT(*) >= 20),
         a AS (SELECT height, AVG(u) AS b0, AVG(v) AS b1, AVG(w) AS b2 FROM e GROUP BY 1)
         SELECT e.site, e.height, e.period_us, CAST(s.b0 IS NOT NULL AS INTEGER) AS from_sector, coalesce(s.b0, a.b0) AS b0,
           coalesce(s.b1, a.b1) AS b1, coalesce(s.b2, a.b2) AS b2
         FROM e LEFT JOIN s ON e.height = s.height AND e.sector = s.sector LEFT JOIN a ON e.height = a.height""")
def _(t):
    p = _period_winds(t).withColumn("sector", F.floor(F.col("direction") / 90).cast("long"))
    aggs = [F.avg("u").alias("b0"), F.avg("v").alias("b1"), F.avg("w").alias("b2")]
    sector = p.groupBy("height", "sector").agg(F.count(F.lit(1)).alias("n"), *aggs).filter("n >= 20")
    return joins.with_fallback(p, sector, p.groupBy("height").agg(*aggs), ["height"], "sector")


@check("e10_run_comparison_join", "rec minute", "a b",
       """WITH @prod SELECT x.rec, (x.us + 30000000) // 60000000 AS minute, x.flux_a AS a, y.flux_b AS b
         FROM prod x JOIN prod y ON x.rec = y.rec AND (x.us + 30000000) // 60000000 = (y.us + 12000000 + 30000000) // 60000000
         WHERE x.qc <= 1 AND y.qc <= 1 AND y.flux_b IS NOT NULL""")
def _(t):
    p = t.products()
    a = p.select("rec", "us", "qc", F.col("flux_a").alias("flux"))
    b = p.select("rec", (F.col("us") + 12_000_000).alias("us"), "qc", F.col("flux_b").alias("flux"))
    return joins.compare_runs(a, b, ["rec"], "us", "flux", 1)


@check("e11_before_after_diff", "rec status", "flux_before flux_after",
       """WITH @prod, b AS (SELECT rec, flux_a AS flux FROM prod WHERE rssi <= 0.95),
         a AS (SELECT rec, CASE WHEN qc <> 2 THEN flux_a END AS flux FROM prod WHERE rssi >= 0.05),
         j AS (SELECT coalesce(b.rec, a.rec) AS rec, b.flux AS flux_before, a.flux AS flux_after,
           CASE WHEN b.rec IS NULL THEN 'added' WHEN a.rec IS NULL THEN 'removed'
             WHEN b.flux IS DISTINCT FROM a.flux THEN 'changed' END AS status FROM b FULL JOIN a ON b.rec = a.rec)
         SELECT * FROM j WHERE status IS NOT NULL""")
def _(t):
    p = t.products()
    # two versions of the product table: the signal limits moved and the worst class was blanked
    before = p.filter("rssi <= 0.95").select("rec", F.col("flux_a").alias("flux"))
    after = p.filter("rssi >= 0.05").select("rec", F.when(F.col("qc") != 2, F.col("flux_a")).alias("flux"))
    return joins.diff_tables(before, after, ["rec"], ["flux"])


@check("e12_pair_on_grid", "height us", "u az",
       f"""WITH @tower, @imu, a AS (SELECT height, us, AVG(u) AS x FROM (SELECT height, us - us % {HOUR_US} AS us, u FROM tower
            WHERE site = 'north') WHERE u IS NOT NULL GROUP BY 1, 2),
         b AS (SELECT height, us, AVG(ts_c) AS x FROM (SELECT height, us - us % {2 * HOUR_US} AS us, ts_c FROM tower
            WHERE site = 'south') WHERE ts_c IS NOT NULL GROUP BY 1, 2),
         sp AS (SELECT a.height, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM
           (SELECT height, MIN(us) AS lo, MAX(us) AS hi FROM a GROUP BY 1) a JOIN
           (SELECT height, MIN(us) AS lo, MAX(us) AS hi FROM b GROUP BY 1) b ON a.height = b.height),
         g AS (SELECT height, UNNEST(generate_series(lo, hi, {HOUR_US})) AS us FROM sp),
         g1 AS (SELECT g.*, a.us AS bo, a.x AS bx FROM g ASOF LEFT JOIN a ON g.height = a.height AND g.us >= a.us),
         g2 AS (SELECT g1.*, a.us AS ao, a.x AS ax FROM g1 ASOF LEFT JOIN a ON g1.height = a.height AND g1.us <= a.us),
         g3 AS (SELECT g2.*, b.us AS co, b.x AS cx FROM g2 ASOF LEFT JOIN b ON g2.height = b.height AND g2.us >= b.us),
         g4 AS (SELECT g3.*, b.us AS eo, b.x AS ex FROM g3 ASOF LEFT JOIN b ON g3.height = b.height AND g3.us <= b.us)
         SELECT height, us, CASE WHEN ao = bo THEN bx ELSE bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) END AS u,
           CASE WHEN eo = co THEN cx ELSE cx + (ex - cx) * ((us - co)::DOUBLE / (eo - co)) END AS az FROM g4""")
def _(t):
    tower = t.tower()
    floor = lambda n: (F.col("us") - F.pmod(F.col("us"), F.lit(n * HOUR_US))).alias("us")
    a = tower.filter("site = 'north'").select("height", floor(1), "u")
    b = tower.filter("site = 'south'").select("height", floor(2), F.col("ts_c").alias("az"))
    return joins.pair_on_grid(a, b, ["height"], "us", "u", "az", HOUR_US, 3, CHUNK_US)
