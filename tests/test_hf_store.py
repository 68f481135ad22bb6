"""High-frequency store: manifest, pruning, height map, primes, replaced dates."""

import pytest
from pyspark.sql import functions as F

from fluxloom.sources import hf_store

DAY = 86_400_000_000
HALF = 1_800_000_000


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = []
    for site, heights in (("a", (2.0, 8.0)), ("b", (3.0,))):
        for h in heights:
            for day in (10, 11):
                for k in range(1, 4):
                    n = 3 if (site, h, day, k) == ("a", 2.0, 10, 2) else 5
                    rows += [(site, h, day * DAY + k * HALF - i, day * DAY + k * HALF, float(i + k), None if i == 0 else 1.5) for i in range(n)]
    samples = spark.createDataFrame(rows, "site string, height double, us long, period_us long, u double, w double")
    fw = samples.select("site", (F.col("height") + F.when(F.col("height") > 5, 0.9).otherwise(0.4)).alias("height"), "us", "period_us", (F.col("u") * 10).alias("fw"))
    periods = samples.select(*hf_store.WINDOW).distinct().withColumns({"ustar": F.col("height") / 10, "u_spike": F.lit(0), "w_spike": (F.col("height") > 5).cast("int")})
    flags = hf_store.window_flags(periods, {"spike_flag": ["u_spike", "w_spike"]})
    root = str(tmp_path_factory.mktemp("hf"))
    hf_store.write_hf(samples, root, ["u", "w"], 5, periods.select(*hf_store.WINDOW, "ustar").join(flags, hf_store.WINDOW), ["u"], {"fw": fw})
    return root, samples


def test_manifest_has_counts_shares_products_and_flags(spark, store):
    root, _ = store
    rows = {(r.site, r.height, r.period_us): r for r in hf_store.read_manifest(spark, root).collect()}
    short, good = rows["a", 2.0, 10 * DAY + 2 * HALF], rows["a", 8.0, 10 * DAY + HALF]
    assert len(rows) == 18 and (short.n, short.whole, good.n, good.whole) == (3, False, 5, True)
    assert good.w_missing == pytest.approx(0.2) and good.u_missing == 0 and good.ustar == 0.8 and (good.spike_flag, short.spike_flag) == (1, 0)
    assert good.last_us == 10 * DAY + HALF and good.first_us == good.last_us - 4


def test_whole_windows_with_scalars_of_the_nearest_sensor(spark, store):
    root, samples = store
    got = hf_store.read_windows(spark, root, ["u", "u_prime"], ["fw"], ["ustar"])
    assert got.count() == samples.count() - 3
    by = {r.height: r for r in got.filter(f"period_us = {11 * DAY + HALF} AND us = {11 * DAY + HALF - 1}").collect()}
    assert by[2.0].fw == by[2.0].u * 10 and by[2.0].fw_height == 2.4 and by[2.0].u_prime == -1.0
    assert by[8.0].fw is None and by[8.0].fw_height is None  # 0.9 m away and not the only one
    assert by[3.0].fw_height == 3.4 and by[3.0].ustar == pytest.approx(0.3)
    lone = samples.select("site", (F.col("height") + 50).alias("height")).filter("site = 'b'")
    assert hf_store.height_map(samples, lone).collect()[0].sensor_height == 53.0


def test_filters_reach_the_scan(spark, store):
    root, _ = store
    record = 11 * DAY + 2 * HALF
    got = hf_store.read_windows(spark, root, ["u"], sites=["a"], first_date="1970-01-12", last_date="1970-01-12", records=[record])
    assert {(r.site, r.period_us) for r in got.collect()} == {("a", record)} and got.count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/samples" in line)
    filters = scan.split("PartitionFilters")[1]
    assert "site" in filters and "date" in filters and "period_us" in filters.split("PushedFilters")[1] and "w:" not in scan.split("ReadSchema")[1]


def test_a_date_that_is_written_again_is_replaced(spark, store, tmp_path):
    _, samples = store
    root = str(tmp_path / "again")
    hf_store.write_hf(samples, root, ["u"], 5)
    hf_store.write_hf(samples.filter(f"site = 'a' AND period_us < {11 * DAY}").withColumn("u", F.lit(7.0)), root, ["u"], 5, double=False)
    got = spark.read.parquet(root + "/samples")
    assert got.count() == samples.count()
    assert got.filter("u <> 7 AND site = 'a' AND date = DATE'1970-01-11'").count() == 0 and got.filter("u <> 7 AND site = 'a'").count() > 0
