"""Stages per date: one bad date keeps the others, finished dates are not redone."""

from pyspark.sql import functions as F

from fluxloom.plans.stages import DAY_US, Stage, run_stages, site_stages, unit_problems
from fluxloom.plans.flux_job import FluxOptions
from fluxloom.operators import motion

KEYS = ["site", "day"]


def days(spark, units, n=4):
    rows = [("s", d, i, float(d * 10 + i), u) for d, u in units.items() for i in range(n)]
    return spark.createDataFrame(rows, "site string, day long, i int, p double, unit string")


def report(df):
    return {r.day: (r.stage, r.status, r.message, r.n_rows) for r in df.collect()}


def test_one_bad_date_keeps_the_others_and_a_rerun_does_only_what_is_left(spark, tmp_path):
    seen = []

    def halve(rows):
        seen.append(sorted(r.day for r in rows.select("day").distinct().collect()))
        return rows.withColumn("p", F.col("p") / 2)

    stages = [Stage("load", lambda r: r, unit_problems({"unit": ("pressure", "kpa")})), Stage("halve", halve),
              Stage("drop", lambda r: r.filter("day <> 3"))]
    store = str(tmp_path / "store")
    expected = spark.createDataFrame([("s", d) for d in (1, 2, 3, 9)], "site string, day long")
    first = report(run_stages(days(spark, {1: "hPa", 2: "ell", 3: None}), KEYS, stages, store, expected))
    assert first == {1: ("drop", "ok", None, 4), 2: ("load", "error", "pressure: unknown unit ell", 0), 3: ("drop", "empty", None, 0), 9: ("load", "missing", None, 0)}
    # date 2 is mended, date 9 arrives; date 1 is done and stays as it is though its input changed
    again = report(run_stages(days(spark, {1: "ell", 2: "hPa", 3: None, 9: ""}, n=5), KEYS, stages, store, expected))
    assert again == {1: ("drop", "ok", None, 4), 2: ("drop", "ok", None, 5), 3: ("drop", "empty", None, 0), 9: ("drop", "ok", None, 5)}
    assert seen == [[1, 3], [2, 9]]
    saved = spark.read.parquet(store + "/data/drop")
    assert saved.filter("day = 1").agg(F.sum("p")).first()[0] == sum(10 + i for i in range(4)) / 2


def test_site_stages_with_motion_and_one_date_without_attitude(spark, tmp_path):
    n, step = 1200, 1_000_000
    rows = [("buoy", d, 3.0, d * DAY_US + (i + 1) * step, d * DAY_US + 600_000_000 * (1 + i // 600), 5.0 + (i % 7) / 10, (i % 5) / 10, (i % 3) / 10, 20.0 + (i % 4) / 10, 8.0, 700.0,
             20.0, 1013.0, 0.0, None if d == 2 else 0.0, 0.0, 0.1) for d in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "site string, day long, height double, us long, period_us long, u double, v double, w double, ts_c double, h2o double, co2 double, "
                                     "fw double, p_kpa double, diag double, roll double, pitch double, yaw double").withColumn("p_unit", F.lit("hPa"))
    stages = site_stages(FluxOptions(period_us=600_000_000), {"u": (0.0, 30.0)}, {}, DAY_US, DAY_US, {"p_kpa": ("p_unit", "pressure", "kpa")},
                         platform={"step_us": step, "lever": (0.0, 0.0, 0.0), "accel": False, "gyro": False})
    store = str(tmp_path / "store")
    got = report(run_stages(df, KEYS, stages, store))
    assert got[1][:3] == ("save", "ok", None) and got[1][3] == 2
    assert got[2] == ("motion", "error", "no value of roll", 0)
    out = spark.read.parquet(store + "/data/motion")
    assert out.count() == n and abs(out.agg(F.max("p_kpa")).first()[0] - 101.3) < 1e-9
    # the heading is demeaned, so a steady one leaves the wind alone
    assert abs(out.agg(F.avg("u")).first()[0] - df.filter("day = 1").agg(F.avg("u")).first()[0]) < 1e-9
    assert set(motion.ANGLES) <= set(out.columns)
