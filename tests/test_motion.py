"""Platform motion: closed forms, chunks against whole series, gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.functions.attitude import GRAVITY
from fluxloom.operators import motion
from fluxloom.operators.chunks import settling_samples
from fluxloom.operators.kernels import butterworth_zero_phase

FS, STEP, N = 5.0, 200_000, 3000
KEYS = ["site"]
T = np.arange(N) / FS


def matrices(roll, pitch, yaw):
    cr, sr, cp, sp, cy, sy = np.cos(roll), np.sin(roll), np.cos(pitch), np.sin(pitch), np.cos(yaw), np.sin(yaw)
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
                     [-sp, cp * sr, cp * cr]]).transpose(2, 0, 1)


@pytest.fixture(scope="module")
def cruise():
    """A platform that rolls, pitches, yaws and heaves with periods of 5 to 8 s under a steady wind."""
    lever, wind = np.array([0.4, -0.3, 6.0]), np.array([7.0, -2.0, 0.3])
    roll, pitch, yaw = 0.06 * np.sin(2 * np.pi * T / 7), 0.04 * np.sin(2 * np.pi * T / 5 + 1), 0.05 * np.sin(2 * np.pi * T / 6)
    d = [0.06 * 2 * np.pi / 7 * np.cos(2 * np.pi * T / 7), 0.04 * 2 * np.pi / 5 * np.cos(2 * np.pi * T / 5 + 1), 0.05 * 2 * np.pi / 6 * np.cos(2 * np.pi * T / 6)]
    rates = np.stack([d[0] - d[2] * np.sin(pitch), d[1] * np.cos(roll) + d[2] * np.cos(pitch) * np.sin(roll), -d[1] * np.sin(roll) + d[2] * np.cos(pitch) * np.cos(roll)], 1)
    k = 2 * np.pi / 8
    velocity = np.stack([0.5 * np.cos(k * T), 0.2 * np.sin(k * T), 0.8 * np.cos(k * T + 0.4)], 1)
    acceleration = np.stack([-0.5 * k * np.sin(k * T), 0.2 * k * np.cos(k * T), -0.8 * k * np.sin(k * T + 0.4) + GRAVITY], 1)
    m = matrices(roll, pitch, yaw)
    body = lambda v: np.einsum("nji,nj->ni", m, v)
    observed = body(wind - velocity) - np.cross(rates, lever)
    names = ["u", "v", "w", "ax", "ay", "az", "p", "q", "r", "roll", "pitch", "yaw"]
    values = np.column_stack([observed, body(acceleration), rates, roll, pitch, yaw])
    return lever.tolist(), wind, velocity, names, values


def frame(spark, names, values, site="buoy"):
    rows = [(site, i * STEP + 7, *[None if np.isnan(x) else float(x) for x in row]) for i, row in enumerate(values)]
    return spark.createDataFrame(rows, "site string, us long, " + ", ".join(f"{n} double" for n in names))


def solve(df, lever, **kw):
    return motion.correct_wind(df, KEYS, "us", STEP, lever, **kw)[0].orderBy("us").toPandas()


@pytest.mark.parametrize("attitude", ["fused", "complementary"])
def test_round_trip_gives_the_steady_wind(spark, cruise, attitude):
    lever, wind, velocity, names, values = cruise
    got = solve(frame(spark, names, values), lever, attitude=attitude, chunk=700)
    inner = slice(400, -400)  # filters have no neighbours beyond the ends
    tolerance = 0.02 if attitude == "fused" else 0.06
    assert np.abs(got[["u_true", "v_true", "w_true"]].to_numpy()[inner] - wind).max() < tolerance * 7
    assert np.abs(got[["vx", "vy", "vz"]].to_numpy()[inner] - velocity[inner]).max() < 0.03


def test_chunk_length_changes_nothing_and_equals_the_whole_series(spark, cruise):
    lever, _, _, names, values = cruise
    df = frame(spark, names, values + 0.01 * np.random.default_rng(1).normal(size=values.shape)).cache()
    whole = solve(df, lever, attitude="complementary", chunk=10 * N).drop(columns="site")
    assert np.abs(solve(df, lever, attitude="complementary", chunk=411).drop(columns="site") - whole).to_numpy().max() < 1e-8
    samples, _ = motion.regular(df, KEYS, "us", STEP, ["az"], chunk=250)
    az = np.array([r.az for r in samples.orderBy("us").collect()])
    direct = butterworth_zero_phase(np.cumsum(butterworth_zero_phase((az - 1) * GRAVITY, FS, 4, 0.05, 0.4)) / FS, FS, 4, 0.05, 0.4)
    got = motion.heave_velocity(samples, KEYS, "us", STEP, "az", 0.05, 0.4, chunk=300).orderBy("us").toPandas()
    assert np.allclose(got.heave, direct, atol=1e-8)
    band = motion.band_variance(df, KEYS, "us", STEP, "az", 0.05, 0.4, chunk=300).first()
    assert band.valid == N and abs(band.band_var - np.var(butterworth_zero_phase(az, FS, 4, 0.05, 0.4))) < 1e-8


def test_no_piece_is_longer_than_a_chunk_with_its_halo(spark, cruise):
    from fluxloom.operators.chunks import map_chunks

    *_, names, values = cruise
    sizes = map_chunks(frame(spark, names, values), KEYS, "us", STEP, ["u"], lambda a: {"n": np.full(len(a), len(a))}, "n long", 100, 40)
    assert sizes.agg(F.max("n").alias("n")).first().n == 180 and sizes.count() == N
    assert settling_samples(FS, 4, 0.05) < 1300


def test_gaps_are_filled_and_reported(spark, cruise):
    lever, wind, _, names, values = cruise
    holed = values.copy()
    holed[1000:1003, 3:6] = np.nan  # accelerations
    holed[2000:2002, 11] = np.nan  # yaw
    holed[1500, 0] = np.nan  # a wind stays missing
    df = frame(spark, names, holed).filter(f"us <> {2500 * STEP + 7}")  # a record that was never written
    rows, gaps = motion.correct_wind(df, KEYS, "us", STEP, lever, chunk=500)
    got, share = rows.orderBy("us").toPandas(), gaps.first()
    assert len(got) == N and got.u_true.isna().sum() == 2
    assert share.slots == N and share.ax_gap == pytest.approx(4 / N) and share.yaw_gap == pytest.approx(3 / N) and share.p_gap == pytest.approx(1 / N)
    assert np.nanmax(np.abs(got.w_true[400:-400] - wind[2])) < 0.2


def test_without_rates_they_come_from_the_attitude(spark, cruise):
    lever, wind, velocity, names, values = cruise
    still = values.copy()
    m = matrices(*values[:, 9:12].T)
    still[:, :3] += np.einsum("nji,nj->ni", m, velocity)  # no translation
    got = solve(frame(spark, names, still), lever, accel=False, gyro=False)
    assert np.abs(got[["u_true", "v_true", "w_true"]].to_numpy()[5:-5] - wind).max() < 0.02


def test_wrapped_heading_is_unwrapped_before_its_mean(spark, cruise):
    lever, _, _, names, values = cruise
    near_south = values.copy()
    near_south[:, 11] = (values[:, 11] + np.pi + np.pi) % (2 * np.pi) - np.pi
    a = solve(frame(spark, names, values), lever, accel=False)
    b = solve(frame(spark, names, near_south), lever, accel=False)
    assert np.allclose(a[["u_true", "v_true", "w_true"]], b[["u_true", "v_true", "w_true"]], atol=1e-9)


def test_each_level_has_its_lever_arm(spark, cruise):
    lever, _, _, names, values = cruise
    df = frame(spark, names, values)
    both = df.withColumn("height", F.lit(3.0)).unionByName(df.withColumn("height", F.lit(8.0)))
    keys = ["site", "height"]
    arms = motion.lever_arms("height", {3.0: lever}, (0.0, 0.0, 0.0))
    got = motion.correct_wind(both, keys, "us", STEP, arms, accel=False)[0]
    one = {h: got.filter(F.col("height") == h).orderBy("us").toPandas() for h in (3.0, 8.0)}
    spin = np.einsum("nij,nj->ni", matrices(*one[3.0][["roll", "pitch", "yaw"]].to_numpy().T), np.cross(values[:, 6:9], lever))
    assert np.allclose(one[3.0][["u_true", "v_true", "w_true"]] - one[8.0][["u_true", "v_true", "w_true"]], spin, atol=1e-9)


def test_an_empty_channel_and_wrong_settings(spark, cruise):
    lever, _, _, names, values = cruise
    dead = values[:200].copy()
    dead[:, 4] = np.nan
    rows, gaps = motion.correct_wind(frame(spark, names, dead), KEYS, "us", STEP, lever, chunk=60)
    assert rows.filter("u_true IS NOT NULL").count() == 0 and rows.count() == 200 and gaps.first().ay_gap == 1
    assert motion.band_variance(frame(spark, names, dead), KEYS, "us", STEP, "az", 0.05, 0.4, min_valid=201).first().band_var is None
    with pytest.raises(ValueError):
        motion.correct_wind(frame(spark, names, dead), KEYS, "us", STEP, lever, yaw="north")
    with pytest.raises(ValueError):
        motion.correct_wind(frame(spark, names, dead), KEYS, "us", STEP, lever, attitude="complementary", gyro=False)
