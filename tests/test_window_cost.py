"""Work per window and per query grows with the window and the table, no faster."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.checks.registry import Tables
from fluxloom.operators import coherent, lags, spectral, windows
from fluxloom.operators.kernels import _wavelet, wavelet_transform
from fluxloom.plans import coherent_job, flux_job as flux
from fluxloom.session import cut_lineage


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, u array<double>, w array<double>, c array<double>")


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *[rng.normal(size=64).cumsum().tolist() for _ in range(3)]) for i in range(6)]
    rows[4][3][7] = None
    rows.append((6, rows[0][1], None, rows[0][3]))
    return _frame(spark, rows)


def test_a_mean_is_not_computed_for_every_sample(packed):
    found = windows.demeaned(packed, ["u", "w", "c"])
    # an aggregate within the subtraction's lambda runs for every sample
    assert not re.search(r"lambda \w+#\d+ - \(?aggregate", _plan(found.select("u")))
    got = {r.vec_id: r for r in found.collect()}
    for r in packed.collect():
        for c in ("u", "w", "c"):
            if r[c] is None:
                assert got[r.vec_id][c] is None
                continue
            x = np.array(r[c], dtype=float)
            assert np.allclose(np.array(got[r.vec_id][c], dtype=float), x - np.nanmean(x), equal_nan=True)


def test_renewal_ramps_run_the_transforms_once(packed):
    sf = lags.structure_functions(packed, ["vec_id"], "u", (1, 2, 3, 4, 6))
    ramps = coherent.renewal_ramps(sf, ["vec_id"], 10.0, 64, 2.0)
    assert _plan(ramps).count("MapInPandas") == 1


def test_modulation_job_is_one_pass_and_equals_the_single_pairs(packed):
    fs, n, speed, delta = 10.0, 64, F.lit(4.2), 20.0
    job = coherent_job.modulation_job(packed, ["vec_id"], ["u", "w"], ["w", "c"], [("u", "w"), ("w", "c")], fs, n, speed, delta)
    # a spectrum for each modulator and one pass over all pairs
    assert _plan(job).count("MapInPandas") == 3
    got = {(r.vec_id, r.modulator, r.signal): r.am for r in job.collect()}
    targets = {"w": F.col("w"), "c": F.col("c"), "uw": F.zip_with("u", "w", lambda a, b: a * b), "wc": F.zip_with("w", "c", lambda a, b: a * b)}
    want = {}
    for m in ("u", "w"):
        bins = spectral.log_binned(spectral.spectra(packed, ["vec_id"], m, m, fs), ["vec_id"], ["sx"], spectral.log_bin_edges(n // 2))
        cut = spectral.cutoff(spectral.spectral_gap(bins, ["vec_id"], "sx"), speed, "spectral_gap", delta, F.lit(1.0), 1.0)
        for name, x in targets.items():
            one = packed.join(cut.select("vec_id", "f_cut"), "vec_id").withColumn("_x", x)
            want |= {(r.vec_id, m, name): r.am for r in spectral.amplitude_modulation(one, ["vec_id"], m, "_x", fs, "f_cut").collect()}
    assert got.keys() == want.keys()
    for k, am in want.items():
        assert got[k] == pytest.approx(am, abs=1e-12) if am is not None else got[k] is None, k


def test_spectral_gap_reads_its_bins_once(packed):
    bins = spectral.spectra_job(packed.select("vec_id", "u"), ["vec_id"], "u", "u", 10.0).filter("bin is not null")
    assert _plan(spectral.spectral_gap(bins, ["vec_id"], "sx")).count("MapInPandas") == 1


def test_windows_of_a_small_file_are_dealt_out(spark):
    plan = _plan(Tables(spark, "/root/testdata/sf0.001").windows())
    assert "RepartitionByExpression [vec_id" in plan


def test_wavelet_transform_is_the_direct_sum():
    x, fs, scales = np.random.default_rng(4).normal(size=50), 10.0, [0.3, 0.7, 1.5]
    i = np.arange(50)
    for name in ("mhat", "ramp", "haar"):
        want = [(x[:, None] * _wavelet(name, (i[:, None] - i[None]) / fs / a) * (np.abs(i[:, None] - i[None]) <= np.ceil({"mhat": 4.0}.get(name, 0.5) * a * fs))).sum(0) / (fs * a)
                for a in scales]
        for _ in range(2):
            assert np.allclose(wavelet_transform(x, scales, fs, name), want)


def test_the_wide_sums_of_the_flux_job_are_compiled(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(flux, "cut_lineage", lambda df, label, **how: calls.append((label, how)) or df)
    flux.flux_job(Tables(spark, "/root/testdata/sf0.001").tower(), flux.FluxOptions(period_us=86_400_000_000))
    assert calls == [("flux-state", {"wide": True}), ("flux-sums", {"wide": True})]
    before = spark.conf.get("spark.sql.codegen.maxFields")
    assert cut_lineage(spark.range(3), "wide", wide=True).count() == 3
    assert spark.conf.get("spark.sql.codegen.maxFields") == before
