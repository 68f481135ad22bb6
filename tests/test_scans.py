"""Ordered scans give the same result for every chunk length, also when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import joins, periods, quantiles, scan, sequence


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    n = 900
    us = np.sort(rng.choice(50_000, n, replace=False)).astype("int64")
    key = np.where(rng.random(n) < 0.8, "hot", "cold")
    x = np.where(rng.random(n) < 0.4, None, np.round(rng.normal(size=n), 6))
    pdf = pd.DataFrame({"key": key, "us": us, "x": x})
    pdf["x"] = pdf["x"].astype(float)
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    return pdf, df


def _sorted(df, *cols):
    return df.orderBy("key", "us").select("key", "us", *cols).toPandas()


@pytest.mark.parametrize("chunk", [37, 1_000, 10**9])
def test_fill_matches_pandas(series, chunk):
    pdf, df = series
    got = _sorted(sequence.fill_linear(df, ["key"], "us", ["x"], chunk), "x_filled")
    want = []
    for _, g in pdf.sort_values(["key", "us"]).groupby("key"):
        ok = g.x.notna()
        want += list(np.interp(g.us, g.us[ok], g.x[ok]))
    assert np.allclose(got.x_filled, want)


@pytest.mark.parametrize("chunk", [53, 10**9])
def test_running_and_neighbours(series, chunk):
    pdf, df = series
    out = scan.running(df, ["key"], "us", {"s": ("sum", F.col("x")), "m": ("max", F.col("us") % 97)}, chunk)
    out = scan.neighbours(out, ["key"], "us", ["x"], chunk)
    got = _sorted(out, "s", "m", "prev_x", "next_x")
    for k, g in pdf.sort_values("us").groupby("key"):
        p = got[got.key == k]
        assert np.allclose(p.s.fillna(0), g.x.fillna(0).cumsum())
        assert (p.m.to_numpy() == (g.us % 97).cummax().to_numpy()).all()
        assert np.allclose(p.prev_x, g.x.shift(1), equal_nan=True)
        assert np.allclose(p.next_x, g.x.shift(-1), equal_nan=True)


def test_nearest_asof_is_chunk_free(series, spark):
    pdf, df = series
    left = spark.range(0, 50_000, 531).select(F.lit("hot").alias("key"), F.col("id").alias("us"))
    outs = [joins.bracketed(left, df, ["key"], "us", ["x"], c).select("us", joins.nearest_value("x", "us", 60).alias("v"))
            .orderBy("us").toPandas() for c in (41, 10**9)]
    assert np.allclose(outs[0].v, outs[1].v, equal_nan=True)
    g = pdf[(pdf.key == "hot") & pdf.x.notna()].sort_values("us")
    want = pd.merge_asof(outs[0][["us"]], g[["us", "x"]], on="us", direction="nearest", tolerance=60)
    assert (outs[0].v.isna() == want.x.isna()).all()


def test_step_down_drops_the_remainder(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 3, 5, 7, 9])], "key string, us long, x double")
    got = periods.step_down(df, ["key"], "us", ["x"], 2, 2).orderBy("step").toPandas()
    assert got.x.tolist() == [2.0, 6.0]


def test_backward_clock_step_stays_in_its_block(spark):
    minute = 60_000_000
    us = [50 * minute, 60 * minute, 61 * minute, 61 * minute - 3_000_000, 62 * minute, 119 * minute]
    df = spark.createDataFrame([("a", i, u) for i, u in enumerate(us)], "key string, ord long, us long")
    got = periods.monotone_blocks(df, ["key"], "ord", "us", 30 * minute, 3).orderBy("ord").toPandas()
    assert (got.block_us // minute).tolist() == [30, 60, 60, 60, 60, 90]


def test_exact_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(size=4000), 2)
    key = np.where(rng.random(4000) < 0.9, "hot", "cold")
    df = spark.createDataFrame(pd.DataFrame({"key": key, "x": x}))
    got = quantiles.exact_quantiles(df, ["key"], "x", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, accuracy=20).toPandas().set_index("key")
    for k in ("hot", "cold"):
        assert np.allclose(got.loc[k], np.quantile(x[key == k], [0.5, 0.95, 0, 1]))
    assert quantiles.exact_quantiles(df, [], "x", {"a": 0.5}).first()["a"] == pytest.approx(np.median(x))


def test_median_exceeds(spark):
    for values, want in (([1.0, 2.0, 9.0], False), ([1.0, 6.0, 9.0], True), ([4.0, 6.0], False), ([4.0, 7.0], True)):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert df.agg(quantiles.median_exceeds(F.col("x"), 5.0)).first()[0] is want


def test_exact_quantiles_with_an_outlier(spark):
    from fluxloom.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(2)
    x = np.append(rng.normal(size=3000), 1e12)
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 5.0)] * 4, "k int, x double")
    got = {r.k: (r.lo, r.mid, r.hi) for r in exact_quantiles(df, ["k"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.99}).collect()}
    assert np.allclose(got[1], np.quantile(x, [0.1, 0.5, 0.99])) and got[2] == (5.0, 5.0, 5.0)


def test_equal_stamps_of_two_loggers_both_stay(spark, tmp_path):
    from fluxloom.sources.text_scans import load_logger_files

    for name in ("A", "B"):
        (tmp_path / f"{name}_1.dat").write_text('"TOA5","x"\n"TIMESTAMP","RECORD","u"\n"TS","RN","m/s"\n"","","Avg"\n"2024-06-01 00:00:00",1,1.5\n')
    paths = [f"{tmp_path}/A_1.dat", f"{tmp_path}/B_1.dat"]
    assert load_logger_files(spark, paths, ["u"]).count() == 1
    assert {r.source for r in load_logger_files(spark, paths, ["u"], source=r"/([AB])_1").collect()} == {"A", "B"}


def test_brackets_match_brute_force_with_equal_stamps(spark):
    rng = np.random.default_rng(8)
    us = rng.integers(0, 400, 600)
    x = [None if v < 0.5 else float(u) for u, v in zip(us, rng.random(600))]
    rows = [("a", int(u), i, v) for i, (u, v) in enumerate(zip(us, x))]
    df = spark.createDataFrame(rows, "key string, us long, i long, x double")
    valid = np.array(sorted({u for _, u, _, v in rows if v is not None}))
    for chunk in (37, 10**9):
        for r in scan.brackets(df, ["key"], "us", ["x"], chunk).collect():
            below, above = valid[valid <= r.us], valid[valid >= r.us]
            assert (r.before_x.o if r.before_x else None) == (below[-1] if len(below) else None)
            assert (r.after_x.o if r.after_x else None) == (above[0] if len(above) else None)


def test_no_scan_frame_runs_to_the_end_of_its_partition(spark):
    # such a frame costs the square of a chunk's rows
    df = spark.createDataFrame([("a", 1, 1.0)], "key string, us long, x double")
    plan = scan.brackets(df, ["key"], "us", ["x"], 10)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding$" in plan and "unboundedfollowing$" not in plan


def test_seconds_of_a_date_vector_round_as_hundredths(spark):
    from fluxloom.functions.timecodes import to_date_vector

    us = [145_000, 285_000, 1_005_000, 1_015_000, 59_994_999]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i int, us long").select("i", to_date_vector(F.col("us"))["second"].alias("s"))
    # each as np.floor(x * 100 + 0.5) / 100 in binary arithmetic, which SQL's ROUND(x, 2) is
    assert [r.s for r in got.orderBy("i").collect()] == [float(np.floor(u / 1e6 * 100 + 0.5) / 100) for u in us]


def test_samples_of_one_stamp_stay_by_record(spark, tmp_path):
    from fluxloom.sources.text_scans import load_logger_files

    (tmp_path / "A.dat").write_text('"2024-06-01 00:00:00",1,1.5\n"2024-06-01 00:00:00",2,2.5\n"2024-06-01 00:00:01",3,3.5\n')
    (tmp_path / "B.dat").write_text('"2024-06-01 00:00:00",2,2.5\n"2024-06-01 00:00:01",3,3.5\n')
    paths = [f"{tmp_path}/A.dat", f"{tmp_path}/B.dat"]
    got = load_logger_files(spark, paths, ["u"], by_record=True)
    assert sorted((r.record, r.u) for r in got.collect()) == [(1, 1.5), (2, 2.5), (3, 3.5)]
    assert load_logger_files(spark, paths, ["u"]).count() == 2
