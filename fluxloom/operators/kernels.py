"""Whole-window signal kernels (NumPy), applied row by row to packed windows.

Only what column expressions cannot express: Fourier transforms, wavelet
convolutions, zero-phase filters and recursive filters. Each takes the arrays
of one window and returns equal-length output columns.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _joined(parts: list):
    """The values of many windows after one another; a window gives an array or a list."""
    if all(isinstance(p, np.ndarray) and p.ndim == 1 for p in parts):
        return np.concatenate(parts)
    return [x for p in parts for x in p]


def map_windows(df: DataFrame, keys, cols, fn: Callable[..., dict], schema: str, carry=(), gaps: bool = False, keep: bool = True,
                batch_rows: int = 20_000) -> DataFrame:
    """Apply *fn(arrays..., carried values...)* to each packed window; its columns become long rows.

    The window is already one row, so the map runs where the row lives; results are handed on every *batch_rows* rows. A
    window with a missing array, or with a missing sample unless the kernel handles *gaps*, cannot be analysed: it gives
    one row of its key and missing results, or none where *keep* is off (for sums that are joined back to the windows
    later).
    """
    names = [part.split()[0] for part in schema.split(", ")]
    keys, cols, carry = list(keys), list(cols), list(carry)
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def frame(found: list[tuple[list, dict]]) -> pd.DataFrame:
        sizes = [len(out[names[0]]) for _, out in found]
        held = {k: pd.Series([x for (key, _), n in zip(found, sizes) for x in [key[i]] * n]) for i, k in enumerate(keys)}
        return pd.DataFrame({**held, **{n: _joined([out[n] for _, out in found]) for n in names}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, rows = [], 0
            for row in batch.itertuples(index=False, name=None):
                at = dict(zip(batch.columns, row))
                arrays = [None if at[c] is None else np.asarray(at[c], dtype=float) for c in cols]
                key = [at[k] for k in keys]
                if any(a is None or len(a) == 0 or (not gaps and np.isnan(a).any()) for a in arrays):
                    if keep:
                        yield pd.DataFrame({**{k: [x] for k, x in zip(keys, key)}, **{n: pd.Series([None], dtype=object) for n in names}})
                    continue
                out = fn(*arrays, *[at[c] for c in carry])
                if len(out[names[0]]):
                    found.append((key, out))
                    rows += len(out[names[0]])
                if rows >= batch_rows:
                    yield frame(found)
                    found, rows = [], 0
            if found:
                yield frame(found)

    return df.select(*dict.fromkeys([*keys, *cols, *carry])).mapInPandas(run, f"{key_types}, {schema}")


def periodogram(x: np.ndarray, y: np.ndarray, fs: float, taper: str = "boxcar", segment: int | None = None) -> dict:
    """One-sided densities of x and y and their co- and quadrature spectrum."""
    n = len(x)
    size = n if segment is None else min(segment, n)
    step = size if segment is None else size - size // 2
    window = np.ones(size) if taper == "boxcar" else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    scale = np.full(size // 2 + 1, 2.0 / (fs * np.sum(window ** 2)))
    scale[0] /= 2
    if size % 2 == 0:
        scale[-1] /= 2
    starts = range(0, n - size + 1, step)
    fx = np.stack([np.fft.rfft(x[s:s + size] * window) for s in starts])
    fy = np.stack([np.fft.rfft(y[s:s + size] * window) for s in starts])
    cross = np.mean(np.conj(fx) * fy, axis=0) * scale
    return {"k": np.arange(len(scale)), "f": np.arange(len(scale)) * fs / size,
            "sx": np.mean(np.abs(fx) ** 2, axis=0) * scale, "sy": np.mean(np.abs(fy) ** 2, axis=0) * scale,
            "co": cross.real, "qu": cross.imag}


def _wavelet(name: str, x: np.ndarray) -> np.ndarray:
    if name == "mhat":
        return (1 - x ** 2) * np.exp(-x ** 2 / 2)
    left, right = (x > -0.5) & (x <= 0), (x > 0) & (x <= 0.5)
    if name == "ramp":
        return np.where(left, 2 * x + 1, np.where(right, 2 * x - 1, 0.0))
    return np.where(left, 1.0, np.where(right, -1.0, 0.0))


SUPPORT = {"mhat": 4.0, "ramp": 0.5, "haar": 0.5}


@lru_cache(maxsize=64)
def _wavelet_spectrum(name: str, a: float, half: int, fs: float, size: int) -> np.ndarray:
    return np.conj(np.fft.rfft(_wavelet(name, np.arange(-half, half + 1) / fs / a), size))


def wavelet_transform(x: np.ndarray, scales, fs: float, name: str = "mhat") -> np.ndarray:
    """T(a, b) = (1/a) sum x(t) g((t-b)/a) dt, zero beyond the ends; one row per scale."""
    n, out, spectra = len(x), [], {}
    for a in np.atleast_1d(scales):
        half = int(np.ceil(SUPPORT[name] * a * fs))
        size = 1 << int(np.ceil(np.log2(n + 2 * half)))
        if size not in spectra:
            spectra[size] = np.fft.rfft(x, size)
        # correlation with the wavelet: conjugate of its transform, shifted by the half support
        full = np.fft.irfft(spectra[size] * _wavelet_spectrum(name, float(a), half, fs, size), size)
        out.append(np.roll(full, half)[:n] / (fs * a))
    return np.array(out)


def butterworth_zero_phase(x: np.ndarray, fs: float, order: int, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Forward-backward Butterworth response: |H|^2 of the bilinear design on an odd extension.

    *low* is the high-pass edge, *high* the low-pass edge; both give a band-pass.
    """
    n = len(x)
    pad = n - 1
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    f = np.fft.rfftfreq(len(ext), 1 / fs)
    warped = np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-12)) / fs)
    edge = lambda c: np.tan(np.pi * c / fs)
    if low and high:
        lo, hi = edge(low), edge(high)
        with np.errstate(divide="ignore"):
            ratio = np.abs(warped ** 2 - lo * hi) / np.where(warped > 0, warped * (hi - lo), np.nan)
        ratio = np.nan_to_num(ratio, nan=np.inf)
    elif low:
        with np.errstate(divide="ignore"):
            ratio = np.where(warped > 0, edge(low) / warped, np.inf)
    else:
        ratio = warped / edge(high)
    gain = 1 / (1 + ratio ** (2 * order))
    return np.fft.irfft(np.fft.rfft(ext) * gain, len(ext))[pad:pad + n]


def recursive_lowpass(x: np.ndarray, fs: float, tau: float) -> np.ndarray:
    """RC low-pass y_k = a y_(k-1) + (1 - a) x_k started at the mean.

    The step is the linear map y -> a y + b. Maps of neighbouring stretches are combined, each doubling of the stretch in
    one operation on the whole series, until every sample holds the map from the start to itself.
    """
    a, start = float(np.exp(-1 / (fs * tau))), float(np.mean(x))
    shift, factor, stretch = (1 - a) * np.asarray(x, float), a, 1
    while stretch < len(x):
        moved = shift.copy()
        moved[stretch:] += factor * shift[:-stretch]
        shift, factor, stretch = moved, factor * factor, 2 * stretch
    return shift + start * a ** np.arange(1, len(x) + 1)


def sharp_lowpass(x: np.ndarray, fs: float, fc: float) -> np.ndarray:
    """Fourier lines above *fc* zeroed."""
    spec = np.fft.rfft(x)
    spec[np.fft.rfftfreq(len(x), 1 / fs) > fc] = 0
    return np.fft.irfft(spec, len(x))


def envelope(x: np.ndarray) -> np.ndarray:
    """Modulus of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def haar_frame_split(x: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """(strong, whole) reconstruction of the redundant dyadic Haar frame, threshold k rms per scale.

    The frame as an undecimated filter bank: the analysis filter of a level is
    the step psi of its width, the synthesis filter the same step turned round,
    and 4^-level makes the pair of unit gain. Levels add up as spectra.
    """
    n, levels = len(x), int(np.log2(len(x)))
    size = 2 << int(np.ceil(np.log2(n)))
    signal, parts = np.fft.rfft(x, size), np.zeros((2, size // 2 + 1), dtype=complex)
    for level in range(1, levels + 1):
        width = 1 << level
        psi = np.fft.rfft(np.repeat([1.0, -1.0], width // 2), size)
        detail = np.fft.irfft(signal * psi.conj(), size)[:n - width + 1]
        kept = detail * (detail ** 2 > k * k * np.mean(detail ** 2))
        parts += np.fft.rfft(np.stack([kept, detail]), size) * psi / 4.0 ** level
    strong, whole = np.fft.irfft(parts, size)[:, :n]
    return strong, whole


def _correlations(size: int, lags: np.ndarray):
    """The cyclic cross-correlation at *lags* as a function of two spectra of *size* points."""
    return lambda fa, fb: np.fft.irfft(np.conj(fa) * fb, size)[lags % size]


def masked_lag_sums(x: np.ndarray, y: np.ndarray, max_lag: int) -> dict:
    """Pair counts and sums of x(i), y(i+k), x(i) y(i+k) for |k| <= max_lag."""
    size = 1 << int(np.ceil(np.log2(len(x) + max_lag + 1)))
    lags = np.arange(-max_lag, max_lag + 1)
    ox, oy = np.isfinite(x), np.isfinite(y)
    at, spec = _correlations(size, lags), lambda a: np.fft.rfft(a, size)
    fx, fy, fox, foy = spec(np.where(ox, x, 0.0)), spec(np.where(oy, y, 0.0)), spec(ox.astype(float)), spec(oy.astype(float))
    return {"lag": lags, "n": np.rint(at(fox, foy)), "sx": at(fx, foy), "sy": at(fox, fy), "sxy": at(fx, fy)}


def lag_covariances_by_block(x: np.ndarray, y: np.ndarray, max_lag: int, blocks: int) -> dict:
    """Covariance of x(i) and y(i+k) over the whole window (block 0) and over each of *blocks* equal parts, about their own means.

    A pair belongs to the part of its x sample. One transform of a part's x and of y in its reach serves all lags; both
    are centred first, as the covariance is a difference of large sums otherwise.
    """
    n, out = len(x), {"block": [], "lag": [], "n": [], "cov": []}
    x, y = x - np.nanmean(x) if np.isfinite(x).any() else x, y - np.nanmean(y) if np.isfinite(y).any() else y
    bounds = np.linspace(0, n, blocks + 1).astype(int)
    for block, (lo, hi) in enumerate([(0, n), *zip(bounds[:-1], bounds[1:])]):
        left, right = max(0, lo - max_lag), min(n, hi + max_lag)
        part = np.full(right - left, np.nan)
        part[lo - left:hi - left] = x[lo:hi]
        s = masked_lag_sums(part, y[left:right], max_lag)
        count = np.where(s["n"] > 0, s["n"], np.nan)
        out["block"].append(np.full(len(count), block))
        out["lag"].append(s["lag"])
        out["n"].append(s["n"])
        out["cov"].append(s["sxy"] / count - s["sx"] / count * (s["sy"] / count))
    return {k: np.concatenate(v) for k, v in out.items()}


def structure_function(x: np.ndarray, lags: np.ndarray, orders) -> dict:
    """Mean of (x(i+j) - x(i))^n over the pairs of valid samples, by binomial expansion into correlations of powers.

    The series is centred and scaled first: the terms of the expansion cancel to the small differences.
    """
    ok = np.isfinite(x)
    found = {"lag": lags, **{f"s{n}": np.full(len(lags), np.nan) for n in orders}}
    if not ok.any():
        return found
    scale = float(np.std(x[ok])) or 1.0
    z = np.where(ok, (x - np.mean(x[ok])) / scale, 0.0)
    size = 1 << int(np.ceil(np.log2(len(x) + int(lags.max()) + 1)))
    spectra = [np.fft.rfft(ok * z ** k, size) for k in range(max(orders) + 1)]
    at = _correlations(size, lags)
    pairs = np.rint(at(spectra[0], spectra[0]))
    for n in orders:
        total = sum(comb(n, k) * (-1) ** (n - k) * at(spectra[n - k], spectra[k]) for k in range(n + 1))
        found[f"s{n}"] = np.where((pairs > 0) & (lags < len(x)), total * scale ** n / np.maximum(pairs, 1), np.nan)
    return found


def covariance_error(w: np.ndarray, c: np.ndarray, max_lag: int) -> float:
    """Sampling error of mean(w c) from the biased auto- and cross-covariances out to *max_lag*; NaN unless the sum is positive."""
    n = len(w)
    size = 1 << int(np.ceil(np.log2(n + max_lag + 1)))
    fw, fc = np.fft.rfft(w, size), np.fft.rfft(c, size)
    at = _correlations(size, np.arange(-max_lag, max_lag + 1))
    cross = at(fw, fc) / n
    total = np.sum(at(fw, fw) * at(fc, fc)) / n ** 2 + np.sum(cross * cross[::-1])
    return float(np.sqrt(total / n)) if total > 0 else float("nan")


def sliding_median(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """Median of the valid values in a centred window, which is kept sorted as it moves; NaN with fewer than *least*.

    An even window has its centre at the upper of the two middle rows.
    """
    n, before, after = len(x), window // 2, (window - 1) // 2
    held, out, values = [], np.full(n, np.nan), x.tolist()
    for i in range(-after, n):
        if i + after < n and values[i + after] == values[i + after]:
            insort(held, values[i + after])
        gone = i - before - 1
        if gone >= 0 and values[gone] == values[gone]:
            del held[bisect_left(held, values[gone])]
        m = len(held)
        if i >= 0 and m and m >= least:
            out[i] = (held[(m - 1) // 2] + held[m // 2]) / 2
    return out


def rolling_deviation_mask(x: np.ndarray, window: int, n_mad: float) -> np.ndarray:
    """Whether a value lies further than *n_mad* scaled median deviations from the rolling median."""
    middle = sliding_median(x, window, window // 5)
    off = np.abs(x - middle)
    scale = 1.4826 * sliding_median(off, window, window // 5)
    with np.errstate(invalid="ignore"):
        return (scale > 0) & (off > n_mad * scale)
