"""Checks of agreement, closure, coverage, de-duplication and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from .registry import check
from .standin import DAY_US, HOUR_US, KEYS, PERIOD

_E = "(flux_b - flux_a)"


@check("f31_agreement_statistics", "group_name n missing_mismatch status", "bias rmse mean_abs max_abs p95_abs p99_abs relative r2",
       f"""WITH @prod, g AS (SELECT group_name, COUNT({_E}) AS n, COUNT(*) FILTER ((flux_a IS NULL) <> (flux_b IS NULL)) AS missing_mismatch, AVG({_E}) AS bias, sqrt(AVG({_E} ** 2)) AS rmse,
           AVG(abs({_E})) AS mean_abs, MAX(abs({_E})) AS max_abs, quantile_cont(abs({_E}), 0.95) AS p95_abs, quantile_cont(abs({_E}), 0.99) AS p99_abs,
           AVG(abs({_E})) / AVG(abs(flux_a)) FILTER (flux_b IS NOT NULL) AS relative, 1 - AVG({_E} ** 2) / VAR_POP(flux_a) FILTER (flux_b IS NOT NULL) AS r2 FROM prod GROUP BY 1)
         SELECT *, CASE WHEN relative <= 0.01 THEN 'ok' WHEN relative <= 0.05 THEN 'close' ELSE 'differs' END AS status FROM g""")
def _(t):
    return compare.agreement(t.products(), ["group_name"], "flux_a", "flux_b")


@check("f32_regression_agreement", "group_name n", "slope intercept r2 bias rmse sign_agreement",
       f"""WITH @prod SELECT group_name, COUNT({_E}) AS n, regr_slope(flux_b, flux_a) AS slope, regr_intercept(flux_b, flux_a) AS intercept, regr_r2(flux_b, flux_a) AS r2,
         AVG({_E}) AS bias, sqrt(AVG({_E} ** 2)) AS rmse, AVG(CAST(sign(flux_a) = sign(flux_b) AS INTEGER)) AS sign_agreement FROM prod GROUP BY 1""")
def _(t):
    return compare.regression(t.products(), ["group_name"], "flux_a", "flux_b")


@check("f33_energy_balance_closure", "part definition n", "ratio slope intercept slope_origin residual",
       """WITH @prod, r AS (SELECT qc, flux_a + 450 AS rn, rssi * 40 AS g, 0.6 * flux_a + 200 AS h, coalesce(0.2 * flux_b, 10) AS le FROM prod),
         d AS (SELECT CASE WHEN qc > 0 THEN 'day' ELSE 'night' END AS half, 'h/rn' AS definition, h AS t, rn AS a FROM r UNION ALL
           SELECT CASE WHEN qc > 0 THEN 'day' ELSE 'night' END, 'h/rn-g', h, rn - g FROM r UNION ALL
           SELECT CASE WHEN qc > 0 THEN 'day' ELSE 'night' END, 'h+le/rn', h + le, rn FROM r UNION ALL
           SELECT CASE WHEN qc > 0 THEN 'day' ELSE 'night' END, 'h+le/rn-g', h + le, rn - g FROM r),
         e AS (SELECT half AS part, definition, t, a FROM d UNION ALL SELECT 'all', definition, t, a FROM d)
         SELECT part, definition, COUNT(*) AS n, SUM(t) / SUM(a) AS ratio, regr_slope(t, a) AS slope, regr_intercept(t, a) AS intercept, SUM(t * a) / SUM(a * a) AS slope_origin,
           AVG(a - t) AS residual FROM e GROUP BY 1, 2""")
def _(t):
    p = t.products()
    rn, g, h = F.col("flux_a") + 450, F.col("rssi") * 40, 0.6 * F.col("flux_a") + 200
    le = F.coalesce(0.2 * F.col("flux_b"), F.lit(10.0))
    return compare.energy_closure(p, [], {"rn": rn, "rn-g": rn - g}, {"h": h, "h+le": h + le}, F.col("qc") > 0)


@check("f34_diurnal_composite", "site hour", "u w",
       f"""WITH @grid SELECT site, (us % {DAY_US}) / 3.6e9::DOUBLE AS hour, AVG(u) AS u, AVG(w) AS w FROM grid GROUP BY 1, 2""")
def _(t):
    return compare.diurnal_composite(t.grid(), ["site"], "us", ["u", "w"])


@check("f35_coverage_report", "variable n_valid", "share",
       """WITH @tower SELECT 'u' AS variable, COUNT(u) AS n_valid, COUNT(u) / COUNT(*)::DOUBLE AS share FROM tower UNION ALL SELECT 'ts_c', COUNT(ts_c), COUNT(ts_c) / COUNT(*)::DOUBLE FROM tower
         UNION ALL SELECT 'w', COUNT(w), COUNT(w) / COUNT(*)::DOUBLE FROM tower""")
def _(t):
    return compare.coverage_report(t.tower(), ["u", "ts_c", "w"])


@check("f37_right_closed_resample", "site period_us", "u ts_c",
       f"""WITH @tower SELECT site, CASE WHEN us % {6 * HOUR_US} = 0 THEN us ELSE us - us % {6 * HOUR_US} + {6 * HOUR_US} END AS period_us, AVG(u) AS u, AVG(ts_c) AS ts_c FROM tower GROUP BY 1, 2""")
def _(t):
    return compare.resample(t.tower().drop("period_us"), ["site"], "us", 6 * HOUR_US, ["u", "ts_c"])


@check("s01_keep_first_by_stamp", "site us event_id", "u",
       f"""WITH @tower, x AS (SELECT site, us - us % {HOUR_US} AS us, event_id, u FROM tower)
         SELECT site, us, event_id, u FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY site, us ORDER BY event_id) AS rn FROM x) WHERE rn = 1""")
def _(t):
    x = t.tower().select("site", (F.col("us") - F.pmod(F.col("us"), F.lit(HOUR_US))).alias("us"), "event_id", "u")
    return compare.first_of_each(x, ["site", "us"], ["event_id"], ["event_id", "u"])


@check("s02_later_file_wins", "site us event_id", "u",
       f"""WITH @tower, x AS (SELECT site, us - us % {HOUR_US} AS us, event_id, u FROM tower)
         SELECT site, us, event_id, u FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY site, us ORDER BY event_id DESC) AS rn FROM x) WHERE rn = 1""")
def _(t):
    x = t.tower().select("site", (F.col("us") - F.pmod(F.col("us"), F.lit(HOUR_US))).alias("us"), "event_id", "u")
    return compare.last_of_each(x, ["site", "us"], ["event_id"], ["event_id", "u"])


@check("s03_duplicate_averaging", "site us", "u v",
       f"WITH @tower SELECT site, us - us % {HOUR_US} AS us, AVG(u) AS u, AVG(v) AS v FROM tower GROUP BY 1, 2")
def _(t):
    x = t.tower().withColumn("us", F.col("us") - F.pmod(F.col("us"), F.lit(HOUR_US)))
    return x.groupBy("site", "us").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


@check("s05_height_rank", "event_id v", "", "WITH @tower SELECT event_id, CAST(DENSE_RANK() OVER (PARTITION BY site ORDER BY height) AS INTEGER) AS v FROM tower")
def _(t):
    return compare.height_rank(t.tower().drop("v"), ["site"])


@check("s06_union_by_name", "event_id", "a b c",
       """WITH @tower SELECT event_id, u AS a, v AS b, NULL::DOUBLE AS c FROM tower UNION ALL SELECT event_id, NULL, v, w FROM tower UNION ALL SELECT event_id, u, NULL, w FROM tower""")
def _(t):
    x = t.tower()
    return compare.union_by_name([
        x.select("event_id", F.col("u").alias("a"), F.col("v").alias("b")), x.select("event_id", F.col("v").alias("b"), F.col("w").alias("c")),
        x.select("event_id", F.col("u").alias("a"), F.col("w").alias("c"))])


@check("s07_key_difference", "site height hour side", "",
       f"""WITH @tower, a AS (SELECT DISTINCT site, height, us // {HOUR_US} AS hour FROM tower WHERE u IS NOT NULL), b AS (SELECT DISTINCT site, height, us // {HOUR_US} AS hour FROM tower WHERE value < 60)
         SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(t):
    x = t.tower().withColumn("hour", F.expr(f"us div {HOUR_US}"))
    return compare.key_difference(x.filter("u is not null"), x.filter("value < 60"), [*KEYS, "hour"])


@check("s08_first_n_days", "day n", "",
       f"""WITH @tower, x AS (SELECT us // {DAY_US} AS day FROM tower) SELECT day, COUNT(*) AS n FROM x WHERE day IN (SELECT DISTINCT day FROM x ORDER BY day LIMIT 5) GROUP BY 1""")
def _(t):
    # selecting the first days of a run is the operator itself
    x = t.tower().withColumn("day", F.expr(f"us div {DAY_US}"))
    return compare.select_units(x, "day", first=5).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
