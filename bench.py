"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fluxloom.checks import load_checks
from fluxloom.session import build_session

HEADLINE = [
    "f03_block_means", "f08_covariances", "f08_covariances_linear", "f12_third_order_transport", "f15_transport_efficiency",
    "d03_sigma_spike_test", "d05_spike_interpolation", "e03_nearest_asof", "e08_fit_record_interval_join", "g02_linear_gap_fill",
    "g05_gap_sessions", "f19_sector_and_single_fit", "w05_yaw_into_mean_wind", "f23_lagged_covariance", "x04_spectra_job",
    "x06_haar_multiresolution", "f28_quadrant_hole", "x11_ramp_events", "f31_agreement_statistics", "p27_flux_job",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    checks = load_checks()
    # one small query first, so the session start is not charged to the first headline
    checks["f03_block_means"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        checks[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
