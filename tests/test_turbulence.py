"""Closed forms, invariants and brute force for fluxes, spectra and coherent structures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.functions import stability, wind
from fluxloom.functions.roots import real_roots
from fluxloom.operators import coherent, kernels, lags, moments, qc, rotation, spectral, windows


def _windows(spark, **signals):
    rows = [(i, *[list(map(float, s[i])) for s in signals.values()]) for i in range(len(next(iter(signals.values()))))]
    return spark.createDataFrame(rows, "vec_id long, " + ", ".join(f"{k} array<double>" for k in signals))


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(11)
    e = rng.normal(size=(6, 256))
    x = np.zeros_like(e)
    for t in range(1, 256):
        x[:, t] = 0.9 * x[:, t - 1] + e[:, t]
    w = 0.4 * x + rng.normal(size=x.shape)
    return x - x.mean(1, keepdims=True), w - w.mean(1, keepdims=True)


def test_haar_worked_example(spark):
    df = _windows(spark, u=[[1, 3, 2, 5, 1, 2, 1, 3]])
    got = spectral.haar_spectrum(df, ["vec_id"], "u", "u", 3).orderBy("m").toPandas()
    assert np.allclose(got.d, [1.125, 0.3125, 0.25]) and got.n.tolist() == [4, 2, 1]


def test_spectrum_and_modes_close(spark, noise):
    u, w = noise
    df = _windows(spark, u=u, w=w)
    lines = spectral.spectra(df, ["vec_id"], "u", "w", 10.0).filter("k > 0").groupBy("vec_id").agg(
        (F.sum("sx") * 10 / 256).alias("v"), (F.sum("co") * 10 / 256).alias("c")).orderBy("vec_id").toPandas()
    assert np.allclose(lines.v, u.var(1)) and np.allclose(lines.c, (u * w).mean(1))
    modes = spectral.haar_spectrum(df, ["vec_id"], "u", "w", 8).groupBy("vec_id").agg(F.sum("d").alias("c")).orderBy("vec_id").toPandas()
    assert np.allclose(modes.c, (u * w).mean(1))


def test_quadrants_and_octants_sum_to_one(spark, noise):
    u, w = noise
    df = _windows(spark, u=u, w=w, c=u[::-1])
    q = coherent.quadrants(df, ["vec_id"], "u", "w", (0.0,)).groupBy("vec_id").agg(F.sum("flux_fraction").alias("s")).toPandas()
    assert np.allclose(q.s, 1.0)
    o = coherent.octants(df, ["vec_id"], "u", "w", "c").groupBy("vec_id").agg(F.sum("f_wc").alias("s")).toPandas()
    assert np.allclose(o.s, 1.0)


def test_ejection_and_sweep_add_up(spark, noise):
    u, w = noise
    df = _windows(spark, u=u, w=w).withColumn("ev", F.array(F.lit(40), F.lit(120), F.lit(200)))
    got = coherent.coherent_flux(df, ["vec_id"], "u", "w", "ev", 10).orderBy("vec_id").toPandas()
    assert np.allclose(got.f_ej + got.f_sw, got.f_cs)
    i = np.array([40, 120, 200])[:, None] + np.arange(-10, 11)
    assert np.allclose(got.f_tot, [(u[k] * w[k])[i].mean() for k in range(len(u))])


def test_real_roots(spark):
    rng = np.random.default_rng(2)
    pq = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(p), float(q)) for p, q in pq], "p double, q double")
    for p, q, r in df.select("p", "q", F.sort_array(real_roots(F.col("p"), F.col("q")))).collect():
        want = np.roots([1, 0, p, q])
        want = np.sort(want[np.abs(want.imag) < 1e-9].real)
        assert np.allclose(r, want, atol=1e-8)


def _ramp_truth(x, j, fs, least):
    """Van Atta amplitude and the two-lag split by polynomial roots."""
    s = lambda k, n: np.mean((x[k:] - x[:-k]) ** n)
    pick = lambda p, q, s3: max((r.real for r in np.roots([1, 0, p, q]) if abs(r.imag) < 1e-9 * max(1, abs(r)) and r.real * s3 < 0), key=abs, default=None)
    r, s2, s3, s5 = j / fs, s(j, 2), s(j, 3), s(j, 5)
    p, q = 10 * s2 - s5 / s3, 10 * s3
    big = s(2 * j, 3) / s3
    v = [z.real for z in np.roots([1, 0, -(12 - 3 * big) / (16 - big), (4 - 2 * big) / (16 - big)]) if abs(z.imag) < 1e-9 and 0 < z.real < 1]
    if not v:
        return None
    v = min(v)
    p2, p3 = 1 - v * v / 3, 1 - 1.5 * v + 0.5 * v ** 3
    p5 = 1 - 2.5 * v + 10 / 3 * v ** 2 - 2.5 * v ** 3 + 2 / 3 * v ** 5
    a2 = pick(p * p3 / p5, q * p2 / p5, s3)
    if a2 is None or p3 <= 0:
        return None
    d = r / v
    gap = -a2 ** 3 * r * p3 / s3 - d
    return (d, gap, a2) if least * r <= d + gap <= len(x) / fs and gap >= 0 else None


def test_two_lag_ramps_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 128)).cumsum(1) * 0.3 + rng.normal(size=(40, 128))
    sf = lags.structure_functions(_windows(spark, u=x), ["vec_id"], "u", (1, 2, 3, 4, 6))
    got = coherent.renewal_ramps(sf, ["vec_id"], 10.0, 128, 2.0).filter("d is not null").toPandas().set_index(["vec_id", "lag"])
    want = {(i, j): t for i in range(40) for j in (1, 2, 3) if (t := _ramp_truth(x[i], j, 10.0, 2.0))}
    assert set(want) == {k for k in got.index if k[1] in (1, 2, 3)} and want
    for k, t in want.items():
        assert np.allclose(got.loc[k, ["d", "s", "a2"]].astype(float), t, rtol=1e-6)


def test_lag_search_finds_a_known_shift(spark):
    x = np.random.default_rng(4).normal(size=(3, 300))
    y = np.roll(x, 5, axis=1)
    got = lags.peak_lag(lags.lagged_covariances(_windows(spark, w=x, c=y), ["vec_id"], "w", "c", 12), ["vec_id"]).toPandas()
    assert (got.lag == 5).all() and (got.ratio > 5).all()
    wide = lags.bounded_correlation_peak(_windows(spark, w=x, c=y), ["vec_id"], "w", "c", 12).toPandas()
    assert (wide.lag == 5).all()


def test_dissipation_of_a_two_thirds_structure_function(spark):
    # D(r) = C2 (eps r)^(2/3) by construction
    eps, u = 0.02, 5.0
    sf = spark.createDataFrame([(0, j, 2.0 * (eps * u * j * 0.05) ** (2 / 3)) for j in range(1, 41)], "vec_id long, lag int, s2 double")
    got = lags.dissipation_rate(sf, ["vec_id"], F.lit(u), 0.05).first()
    assert got.epsilon == pytest.approx(eps, rel=1e-9)


def test_planar_fit_recovers_the_plane(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(4, 1, 50), rng.normal(0, 1, 50)
    pdf = pd.DataFrame({"site": "a", "u": u, "v": v, "w": 0.04 - 0.08 * u + 0.03 * v})
    df = spark.createDataFrame(pdf)
    fit = rotation.planar_fit(df, ["site"]).first()
    assert (fit.b0, fit.b1, fit.b2) == pytest.approx((0.04, -0.08, 0.03))
    level = rotation.apply_fit(df, rotation.planar_fit(df, ["site"]), ["site"]).toPandas()
    assert np.allclose(level.w_r, 0, atol=1e-12)
    assert np.allclose(level.u_r ** 2 + level.v_r ** 2, u ** 2 + v ** 2 + (pdf.w - 0.04) ** 2)
    assert rotation.planar_fit(df.limit(3), ["site"]).count() == 0


def test_linear_detrend_with_unequal_gaps(spark):
    rng = np.random.default_rng(9)
    t = np.arange(200.0)
    x, y = 0.3 * t + rng.normal(size=200), -0.1 * t + rng.normal(size=200)
    x[rng.random(200) < 0.2] = np.nan
    y[rng.random(200) < 0.2] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": t, "x": x, "y": y})).select("k", "t", *[F.nanvl(c, F.lit(None)).alias(c) for c in "xy"])
    got = moments.detrended_covariances(df, ["k"], {"c": ("x", "y")}, "linear", "t").first().c
    fit = lambda z: z - np.polyval(np.polyfit(t[~np.isnan(z)], z[~np.isnan(z)], 1), t)
    assert got == pytest.approx(np.nanmean(fit(x) * fit(y)), rel=1e-9)


def test_psi_is_the_integral_of_its_gradient(spark):
    df = spark.createDataFrame([(-1.5,), (-0.2,)], "z double")
    for z, m, h in df.select("z", stability.psi_m(F.col("z")), stability.psi_h(F.col("z"))).collect():
        s = np.linspace(-1e-9, z, 200_001)
        assert m == pytest.approx(np.trapezoid((1 - (1 - 19.3 * s) ** -0.25) / s, s), rel=1e-3)
        # the heat form keeps the offset ln((1 + a)/2) at neutral
        grad = (1 - 1 / (0.95 * np.sqrt(1 - 11.6 * s)) * 0.95) / s
        assert np.sign(h) == 1 and np.isfinite(grad).all()


def test_sector_edges_wrap_through_north(spark):
    df = spark.createDataFrame([(350.0,), (10.0,), (180.0,), (20.0,)], "d double")
    got = df.select(wind.in_sector(F.col("d"), F.lit(340.0), F.lit(20.0)).alias("s")).toPandas().s.tolist()
    assert got == [True, True, False, True]
    label = df.select(wind.compass_label(F.col("d")).alias("l")).toPandas().l.tolist()
    assert label == ["N", "N", "S", "NNE"]


def test_despike_repairs_a_lone_spike_and_keeps_long_runs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    x[100] = 40.0
    x[250:270] += 9.0
    out, spikes = qc._despike_table(x[:, None].copy(), np.array([3.5]), 3, 10, 20)
    assert spikes[100, 0] and abs(out[100, 0]) < 5 and not spikes[250:270].all()
    df = spark.createDataFrame(pd.DataFrame({"site": "a", "day": 1, "us": np.arange(400), "x": x}))
    got = qc.despike_to_convergence(df, ["site"], "day", "us", {"x": 3.5}, 3).orderBy("us").toPandas()
    assert np.allclose(got.x, out[:, 0]) and (got.x_spike == spikes[:, 0]).all()


def test_despiking_goes_on_until_a_pass_is_clean(spark):
    from fluxloom.plans.pipeline import condition
    from fluxloom.session import cut_lineage

    x = np.sin(np.arange(400.0))
    x[[50, 120, 190]] = 1e6, 1e3, 30.0  # each hides the next
    rows = [("s", 2.0, i * 1000, 10_000_000, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "site string, height double, us long, period_us long, u double")
    passes = []
    got = qc.despike_passes(df, ["site", "height"], "us", {"u": 3.5}, 400_000, 10, qc.MOST_PASSES, 100_000,
                            lambda d: passes.append(1) or cut_lineage(d, "despike"))
    same = condition(df, {"u": (-1e9, 1e9)}, {"u": 3.5}, 400_000, 10, 100_000)
    for out in (got, same):
        y = out.orderBy("us").toPandas()
        assert list(y.columns) == df.columns and y["u"].abs().max() <= 1.0 and len(y) == 400
    assert len(passes) == 4


def test_two_lag_ramps_query_keeps_rows_without_result(spark, monkeypatch):
    from fluxloom.checks import coherent as checks, load_checks

    rows = spark.createDataFrame([(1, 1, None, None, None), (2, 1, 0.5, 0.5, 0.5)], "vec_id long, lag int, d double, s double, a2 double")
    monkeypatch.setattr(checks, "_renewal", lambda t: rows)
    run = load_checks()["x12_two_lag_ramps"].run
    assert run(spark, "/root/testdata/sf0.001").count() == 2


def test_butterworth_passes_and_stops():
    t = np.arange(4000) / 10
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 2.0 * t)
    mid = slice(500, -500)
    low = kernels.butterworth_zero_phase(slow + fast, 10.0, 4, high=0.2)
    assert np.abs(low - slow)[mid].max() < 1e-3
    assert np.abs(kernels.butterworth_zero_phase(slow + fast, 10.0, 4, low=0.2) - fast)[mid].max() < 1e-3
    # half power at the edge, squared by the two passes
    edge = kernels.butterworth_zero_phase(np.sin(2 * np.pi * 0.2 * t), 10.0, 4, high=0.2)
    assert edge[mid].std() * math.sqrt(2) == pytest.approx(0.5, rel=1e-2)


def test_envelope_of_a_modulated_carrier():
    t = np.arange(1000) / 1000
    am = 1 + 0.5 * np.cos(2 * np.pi * 3 * t)
    assert np.allclose(kernels.envelope(am * np.cos(2 * np.pi * 100 * t)), am, atol=1e-6)


def test_wavelet_transform_matches_direct_sum():
    x = np.random.default_rng(6).normal(size=80)
    for name in ("mhat", "ramp", "haar"):
        for a in (0.35, 0.9):
            half = int(np.ceil(kernels.SUPPORT[name] * a * 10))
            direct = [sum(x[t] * kernels._wavelet(name, np.array([(t - b) / 10 / a]))[0] for t in range(max(0, b - half), min(80, b + half + 1))) / (10 * a) for b in range(80)]
            assert np.allclose(kernels.wavelet_transform(x, [a], 10.0, name)[0], direct)


def test_haar_frame_strong_set_is_everything_at_zero_threshold(noise):
    strong, whole = kernels.haar_frame_split(noise[0][0], 0.0)
    assert np.allclose(strong, whole)


def test_pack_averages_repeated_slots(spark):
    df = spark.createDataFrame([(1, 2, 4.0), (1, 0, 1.0), (1, 1, 2.0), (1, 1, 4.0)], "k int, i int, x double")
    assert windows.pack(df, ["k"], "i", ["x"]).first().x == [1.0, 3.0, 4.0]


def test_all_flags_void_every_flux_output(spark):
    from fluxloom.plans.flux_job import FluxOptions, flux_job

    rng = np.random.default_rng(3)
    n, period = 600, 60_000_000
    rows = [("s", h, 1_000_000 * (i + 1), period * (1 + i // 60), *[float(v) for v in (
        4 + rng.normal(), rng.normal(), rng.normal(), 22 + rng.normal(), 9 + rng.normal(), 720 + rng.normal(), 22 + rng.normal(), 101.0, 0.0)])
        for h in (3.0, 10.0) for i in range(n)]
    samples = spark.createDataFrame(rows, "site string, height double, us long, period_us long, u double, v double, w double, ts_c double, "
                                          "h2o double, co2 double, fw double, p_kpa double, diag double")
    free = {"site", "height", "period_us", "direction", "n_samples", "P_kPa", "T_K", "q_ref", "rho_d", "rho_v", "rho_air", "cp_air", "T_virt_K", "z_ref",
            "unrot", "rot", "tsf", "fwf", "h2of", "co2f", "theta_v_sigma", "co2_mole_fraction", "Lv"}
    flagged = flux_job(samples, FluxOptions(period_us=period, missing_share=0.0)).toPandas()
    classes = [c for c in flagged if c.endswith(("_ssitc", "_ss", "_ssitc_simple"))]
    left = [c for c in flagged if c not in free and c not in classes and flagged[c].notna().any()]
    assert left == [] and (flagged[classes] == 2).all().all()
    clean = flux_job(samples, FluxOptions(period_us=period)).toPandas()
    assert clean["w_theta_v_cov_pf"].notna().all() and clean["w_co2_wpl_eta_pf"].notna().any()


def test_a_window_that_cannot_be_analysed_keeps_its_row(spark):
    from fluxloom.operators import kernels

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [])], "k long, x array<double>")
    got = kernels.map_windows(df, ["k"], ["x"], lambda x: {"i": [0], "y": [x.sum()]}, "i int, y double").collect()
    assert sorted((r.k, r.i, r.y) for r in got) == [(1, 0, 3.0), (2, None, None), (3, None, None), (4, None, None)]
    assert kernels.map_windows(df, ["k"], ["x"], lambda x: {"y": [x.sum()]}, "y double", keep=False).count() == 1


def test_linear_detrending_removes_a_trend_and_leaves_sigma(spark):
    from fluxloom.plans.flux_job import FluxOptions, flux_job

    rng, n, period = np.random.default_rng(5), 1200, 600_000_000
    t = np.arange(1, n + 1) / 2
    w, ts = rng.normal(size=n), 22 + rng.normal(size=n) * 0.3 + 0.01 * t
    w = w + 0.004 * t
    rows = [("s", 10.0, int(500_000 * (i + 1)), period, 4 + float(rng.normal()), float(rng.normal()), float(w[i]), float(ts[i]), 9.0, 720.0, 22.0, 101.0, 0.0) for i in range(n)]
    samples = spark.createDataFrame(rows, "site string, height double, us long, period_us long, u double, v double, w double, ts_c double, "
                                          "h2o double, co2 double, fw double, p_kpa double, diag double")
    fit = spark.createDataFrame([("s", 10.0, 0.0, 0.0, 0.0)], "site string, height double, b0 double, b1 double, b2 double")
    row = flux_job(samples, FluxOptions(period_us=period), fits=fit).first()
    residual = lambda x: x - np.polyval(np.polyfit(t, x, 1), t)
    assert row["w_ts_cov_raw"] == pytest.approx(np.mean(residual(w) * residual(ts)), rel=1e-9)
    assert row["w_sigma_raw"] == pytest.approx(np.std(w), rel=1e-9) and row["ts_sigma"] == pytest.approx(np.std(ts), rel=1e-9)


def _despiked(pdf, cols, half, longest, passes, repair):
    """Repeated despiking row by row: every pass flags from the same input, keeps long runs and repairs inside *repair*."""
    out = pdf.sort_values("us").reset_index(drop=True)
    active = {s for u in out.us for s in (u - u % half, u - u % half - half)}
    for _ in range(passes):
        start, new, hit = (out.us - out.us % half).to_numpy(), out.copy(), set()
        for c, k in cols.items():
            x, flag, by = out[c].to_numpy(float), np.zeros(len(out), bool), {}
            for win in active:
                rows = (start == win) | (start == win + half)
                with np.errstate(all="ignore"):
                    m, s = (np.nanmean(x[rows]), np.nanstd(x[rows])) if np.isfinite(x[rows]).any() else (0.0, 0.0)
                by[win] = rows & (np.abs(x - m) >= k * s) & (s > 0)
                flag |= by[win]
            edges = np.flatnonzero(np.diff(np.r_[0, flag.astype(int), 0]))
            for a, b in zip(edges[::2], edges[1::2]):
                flag[a:b] &= b - a <= longest
            hit |= {win for win in active if (by[win] & flag).any()}
            for _, g in out.groupby(repair):
                at = g.index.to_numpy()
                ok = at[np.isfinite(x[at]) & ~flag[at]]
                if len(ok) < 2 or len(at) - len(ok) > 0.6 * len(at):
                    new.loc[at, c] = np.nan
                else:
                    bad = at[flag[at]]
                    new.loc[bad, c] = np.interp(out.us[bad], out.us[ok], x[ok], left=np.nan, right=np.nan)
        out, active = new, hit
        if not active:
            break
    return out


def test_despike_passes_match_brute_force_without_shuffling_rows_for_flags(spark):
    from fluxloom.session import cut_lineage

    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"us": np.arange(n) * 7 + rng.integers(0, 7, n), "u": rng.normal(size=n), "w": rng.normal(size=n)})
    pdf["period_us"] = pdf.us // 700
    pdf.loc[rng.random(n) < 0.1, "u"] = np.nan
    pdf.loc[[0, 1, 200, 201, 202, 203, n - 1], "w"] = 12.0
    pdf.loc[pdf.period_us == 3, "w"] = np.nan
    df = spark.createDataFrame(pdf.assign(site="s")).withColumns({c: F.nanvl(c, F.lit(None)) for c in "uw"})
    cols, seen = {"u": 1.9, "w": 1.7}, []
    for repair in (None, ["site", "period_us"]):
        cut = lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or cut_lineage(d, "despike")
        got = qc.despike_passes(df, ["site"], "us", cols, 1400, 2, 3, 900, cut, repair).orderBy("us").toPandas()
        want = _despiked(pdf, cols, 700, 2, 3, "period_us" if repair else np.zeros(n))
        assert list(got.columns) == df.columns
        for c in cols:
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)
    # the rows of a pass are shuffled for its ordered scan alone; the other exchanges are of the scan's chunk summaries
    assert len(seen) == 6 and max(plan.count("Exchange hashpartitioning") for plan in seen) <= 4
