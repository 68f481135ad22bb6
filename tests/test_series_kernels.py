"""Kernels on whole windows against brute force."""

import numpy as np
import pandas as pd
import pytest

from fluxloom.operators import kernels, lags, sequence
from fluxloom.operators.quantiles import exact_quantiles
from fluxloom.sources.catalogue import files_for_windows

RNG = np.random.default_rng(3)


def holed(n, share=0.1):
    x = RNG.normal(3, 2, n)
    x[RNG.random(n) < share] = np.nan
    return x


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_block_covariances_equal_their_definition(blocks):
    w, c = holed(101), holed(101)
    got = kernels.lag_covariances_by_block(w, c, 12, blocks)
    bounds = np.linspace(0, 101, blocks + 1).astype(int)
    for block, lag, n, cov in zip(*got.values()):
        lo, hi = (0, 101) if block == 0 else bounds[block - 1:block + 1]
        pairs = [(w[i], c[i + lag]) for i in range(lo, hi) if 0 <= i + lag < 101 and np.isfinite(w[i]) and np.isfinite(c[i + lag])]
        assert n == len(pairs)
        if pairs:
            a, b = np.array(pairs).T
            assert cov == pytest.approx(np.mean(a * b) - a.mean() * b.mean(), abs=1e-10)
        else:
            assert np.isnan(cov)


def test_structure_functions_equal_their_definition():
    x = 1e4 + holed(150)  # a large mean would cancel without centring
    at = np.array([1, 2, 5, 40, 149, 400])
    got = kernels.structure_function(x, at, (2, 3, 5))
    for k, lag in enumerate(at):
        d = x[lag:] - x[:-lag] if lag < 150 else np.zeros(0)
        d = d[np.isfinite(d)]
        for n in (2, 3, 5):
            if len(d):
                assert got[f"s{n}"][k] == pytest.approx(np.mean(d ** n), rel=1e-7, abs=1e-6)
            else:
                assert np.isnan(got[f"s{n}"][k])


def test_an_empty_window_has_no_structure_function():
    assert np.isnan(kernels.structure_function(np.full(9, np.nan), np.array([1, 2]), (2,))["s2"]).all()


def test_covariance_error_equals_its_definition():
    w, c = RNG.normal(size=90), RNG.normal(size=90)
    c = 0.6 * w + 0.4 * c
    at = lambda a, b, k: sum(a[i] * b[i + k] for i in range(90) if 0 <= i + k < 90) / 90
    total = sum(at(w, w, k) * at(c, c, k) + at(w, c, k) * at(c, w, k) for k in range(-20, 21))
    assert kernels.covariance_error(w, c, 20) == pytest.approx(np.sqrt(total / 90))


@pytest.mark.parametrize("window", [1, 2, 5, 8, 61, 300])
def test_sliding_median_equals_rolling_median(window):
    x = np.round(holed(200, 0.3), 1)  # many ties
    want = pd.Series(x).rolling(window, center=True, min_periods=window // 5).median().to_numpy()
    assert np.allclose(kernels.sliding_median(x, window, window // 5), want, equal_nan=True)


def test_long_rolling_frames_take_no_sort_per_row(spark):
    n = 36_000
    x = np.cumsum(RNG.normal(size=n)) / 50
    x[::500] += 40
    df = spark.createDataFrame(pd.DataFrame({"site": "s", "us": np.arange(n), "x": x, "more": 1}))
    got = sequence.rolling_mad_mask(df, ["site"], "us", "x", 2000, 7.0)
    assert got.columns == ["site", "us", "x", "more", "spike"]
    assert {r.us for r in got.filter("spike").select("us").collect()} == set(range(0, n, 500))


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_recursive_filter_equals_the_loop(n):
    x, a = RNG.normal(size=n), np.exp(-1 / (10 * 0.7))
    y, want = x.mean(), []
    for v in x:
        y = a * y + (1 - a) * v
        want.append(y)
    assert np.allclose(kernels.recursive_lowpass(x, 10.0, 0.7), want, atol=1e-12)


def test_block_covariances_of_windows_without_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0], [2.0, None, 1.0]), (2, [None, None, None], [1.0, 2.0, 3.0]), (3, None, [1.0])],
                               "k int, x array<double>, y array<double>")
    rows = lags.block_covariances(df, ["k"], "x", "y", 1, 1).filter("block = 0 AND lag = 0").collect()
    assert {r.k: (r.n, r.cov) for r in rows} == {1: (2, pytest.approx(-0.75)), 2: (0, None)}


def test_exact_quantiles_of_small_and_tied_groups(spark):
    sizes = {1: 1, 2: 2, 3: 3, 4: 7, 5: 40, 6: 4000}
    rows = [(k, float(v)) for k, n in sizes.items() for v in np.round(RNG.normal(size=n), 1 if n < 4000 else 3)] + [(7, 5.0)] * 500 + [(8, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    for accuracy in (50, 10_000):
        got = {r.k: [r[p] for p in probs] for r in exact_quantiles(df, ["k"], "x", probs, accuracy).collect()}
        pdf = pd.DataFrame(rows, columns=["k", "x"]).dropna()
        assert set(got) == set(pdf.k)
        for k, x in pdf.groupby("k").x:
            assert got[k] == pytest.approx(list(np.quantile(x, list(probs.values()))))


def test_files_meet_windows_like_the_full_comparison(spark):
    day = 86_400_000_000
    starts = sorted(RNG.integers(0, 40 * day, 60).tolist() + [5 * day, 5 * day])
    spans = [("s", f"f{i}", a, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], None]))] + [("lone", "g", 3 * day, None)]
    windows = [("s", w, int(a), int(a + RNG.integers(0, 4 * day))) for w, a in enumerate(RNG.integers(-2 * day, 42 * day, 25))] + [("lone", 90, day, 2 * day), ("lone", 91, 3 * day, 9 * day), ("none", 92, 0, day)]
    want = {(s, w, f) for s, w, lo, hi in windows for t, f, a, b in spans if s == t and (lo <= a <= hi or (a < lo and (b is None or b >= lo)))}
    got = files_for_windows(spark.createDataFrame(spans, "site string, file string, first_us long, next_us long"),
                            spark.createDataFrame(windows, "site string, win int, lo long, hi long"), ["site"])
    rows = [(r.site, r.win, r.file) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
