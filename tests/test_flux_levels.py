"""Levels with their own barometer and hygrometer, and the fine wire's potential temperatures."""

import math

import pytest

from fluxloom.plans.flux_job import FluxOptions, flux_job

PERIOD = 1_800_000_000
STEP = 60_000_000
KEEP = FluxOptions(period_us=PERIOD, missing_share=2.0, detrend="constant", level_means=True)


def tower(spark, p_upper=99.0):
    rows = []
    for height, p_kpa in ((3.0, 101.0), (8.0, p_upper)):
        for k in range(1, 121):
            us, s = k * STEP, math.sin(k * 1.7)
            rows.append(("s", height, us, -(-us // PERIOD) * PERIOD, 3.0 + s, math.cos(k * 2.3), 0.3 * math.sin(k * 0.9) - 0.2 * s,
                         20.0 + s, 10.0 + 0.2 * s, 700.0 + s, 21.0 + s, p_kpa, 0))
    return spark.createDataFrame(rows, "site string, height double, us long, period_us long, u double, v double, w double, ts_c double, "
                                       "h2o double, co2 double, fw double, p_kpa double, diag int")


def hygrometer(spark, periods=(1, 2, 4), rh=60.0, **more):
    rows = [("s", 8.0, n * PERIOD, 292.0 + n, rh) for n in periods for _ in range(3)]
    df = spark.createDataFrame(rows, "site string, height double, period_us long, t_k double, rh double")
    for name, value in more.items():
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit(value))
    return df


def by_key(df):
    return {(r.height, r.period_us // PERIOD): r for r in df.collect()}


def q_of(t, rh, p):
    e = rh / 100 * 0.6112 * math.exp(17.67 * (t - 273.16) / (t - 29.66))
    return 0.622 * e / (p - 0.378 * e), 621.97 * e / (p - e)


def test_a_level_uses_its_own_barometer_and_hygrometer(spark):
    plain, own = by_key(flux_job(tower(spark), KEEP)), by_key(flux_job(tower(spark), KEEP, humidity=hygrometer(spark)))
    for n in (1, 2, 4):
        q, r = q_of(292.0 + n, 60.0, 99.0)
        theta = (292.0 + n + 0.0098 * 5.0) * (1 + 0.61 * r / 1000)
        row = own[8.0, n]
        assert row.q == pytest.approx(1000 * q) and row.r == pytest.approx(r) and row.theta_v_slow == pytest.approx(theta)
        assert row.rho_air_moist == pytest.approx(row.rho_air_dry + row.rho_h2o)
        assert row.L == pytest.approx(plain[8.0, n].L * theta / plain[8.0, n].T_virt_K)
    # the period without a humidity has none of its own scales, its samples take the course between the neighbours
    gap = own[8.0, 3]
    assert gap.q is None and gap.theta_v_slow is None and gap.L is None
    q2, q4 = q_of(294.0, 60.0, 99.0)[0], q_of(296.0, 60.0, 99.0)[0]
    ts = [20.0 + math.sin(k * 1.7) + 273.15 for k in range(61, 91)]
    want = sum(t / (1 + 0.51 * (q2 + (q4 - q2) * (k - 60) / 60)) for t, k in zip(ts, range(61, 91))) / 30 - 273.15
    assert gap.t_air == pytest.approx(want, abs=1e-9)
    # the level without a hygrometer follows the reference
    for n in (1, 2, 3, 4):
        assert own[3.0, n].L == plain[3.0, n].L and own[3.0, n].q is None and own[3.0, n].t_air == plain[3.0, n].t_air


def test_the_sensors_own_height_moves_its_potential_temperature(spark):
    low, high = (by_key(flux_job(tower(spark), KEEP, humidity=hygrometer(spark, hmp_height=h)))[8.0, 1] for h in (8.0, 9.0))
    assert high.theta_v_slow - low.theta_v_slow == pytest.approx(0.0098 * (1 + 0.61 * low.r / 1000))


def test_a_barometer_off_the_standard_atmosphere_is_not_used(spark):
    good, off = by_key(flux_job(tower(spark), KEEP)), by_key(flux_job(tower(spark, p_upper=70.0), KEEP))
    assert good[8.0, 1].co2_mole_fraction == pytest.approx(off[8.0, 1].co2_mole_fraction * 101.0 / 99.0)
    assert good[3.0, 1].co2_mole_fraction == off[3.0, 1].co2_mole_fraction


def test_fine_wire_potential_temperatures(spark):
    for detrend in ("constant", "linear"):
        row = by_key(flux_job(tower(spark), FluxOptions(period_us=PERIOD, missing_share=2.0, detrend=detrend, level_means=True)))[8.0, 1]
        shift = 0.0098 * 5.0
        fw = [21.0 + math.sin(k * 1.7) for k in range(1, 31)]
        assert row.theta_fw == pytest.approx(sum(fw) / 30 + shift)
        assert row.theta_v == pytest.approx(sum(fw) / 30 - 1.0 + shift)
        # humidity is constant in the first period, so the virtual fine wire is a multiple of the fine wire
        assert row.theta_v_fw == pytest.approx(row.theta_fw * (1 + 0.61 * row.q_ref))
        assert row.w_theta_fw_cov_pf == pytest.approx(row.w_t_fw_cov_pf)
        assert row.w_theta_v_fw_cov_pf == pytest.approx(row.w_t_fw_cov_pf * (1 + 0.61 * row.q_ref))
