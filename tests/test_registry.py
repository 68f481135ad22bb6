"""A sample of the registered queries against their SQL twins, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect

SF = "/root/testdata/sf0.01"
SAMPLE = ["f01_period_assignment", "f08_covariances_linear", "f16_ejection_sweep_asymmetry", "e03_nearest_asof", "e08_fit_record_interval_join",
          "d03_sigma_spike_test", "d05_spike_interpolation", "g06_hold_exit_jumps", "f19_sector_and_single_fit", "w06_local_rotation",
          "p12_latent_heat", "f23_lagged_covariance", "x04_spectra_job", "x06_haar_multiresolution", "f28_quadrant_hole", "x11_ramp_events",
          "f31_agreement_statistics", "a01_logger_scan", "a08_tagged_log_records", "b02_hf_product"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(contract.oracle_sql()[name]).df()) == ""
    assert len(got)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def equal_stamps(spark, tmp_path_factory):
    """Events of which three of one site share a stamp."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("ties")
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").filter("user_id % 2 = 0").limit(40)
    first = rows.agg(F.min("ts")).first()[0]
    rows.withColumn("ts", F.when(F.col("event_id") < 8, F.lit(first)).otherwise(F.col("ts"))).coalesce(1).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["a04_multi_file_load", "a08_tagged_log_records", "a08_tagged_log_stats"])
def test_records_of_one_stamp_all_stay(spark, equal_stamps, name):
    import duckdb

    tied = duckdb.connect()
    tied.execute(f"CREATE VIEW events AS SELECT * FROM '{equal_stamps}/events.parquet/*.parquet'")
    want = tied.execute(contract.oracle_sql()[name]).df()
    assert compare(contract.queries()[name](spark, equal_stamps).toPandas(), want) == "" and len(want)
    assert tied.execute("SELECT COUNT(*) - COUNT(DISTINCT ts) FROM events").fetchone()[0] >= 2
