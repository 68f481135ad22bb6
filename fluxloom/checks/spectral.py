"""Checks of spectra, multiresolution and scale separation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spectral, windows
from ..operators.kernels import butterworth_zero_phase, map_windows, recursive_lowpass
from .registry import check

V, FS, N = ["vec_id"], 10.0, 64

_DFT = """ft AS (SELECT p.vec_id, k, SUM(u * cos(2 * pi() * k * i / 64)) AS ur, -SUM(u * sin(2 * pi() * k * i / 64)) AS ui,
  SUM(w * cos(2 * pi() * k * i / 64)) AS wr, -SUM(w * sin(2 * pi() * k * i / 64)) AS wi FROM prime p, range(33) t(k) GROUP BY 1, 2),
 sp AS (SELECT vec_id, k, k * 10 / 64.0::DOUBLE AS f, sc * (ur * ur + ui * ui) AS sx, sc * (wr * wr + wi * wi) AS sy, sc * (ur * wr + ui * wi) AS co,
   sc * (ur * wi - ui * wr) AS qu FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 640.0::DOUBLE AS sc FROM ft))"""


def _primes(t):
    return windows.demeaned(t.windows(), ["u", "w", "c"])


def _lines(t):
    return spectral.spectra(_primes(t), V, "u", "w", FS)


@check("x02_periodogram", "vec_id k", "f sx sy co qu", f"WITH @prime, {_DFT} SELECT vec_id, CAST(k AS INTEGER) AS k, f, sx, sy, co, qu FROM sp", digits=9)
def _(t):
    return _lines(t)


@check("x02_welch_hann", "vec_id k", "f sx co",
       """WITH @prime, g AS (SELECT p.vec_id, s, k, SUM(h * u * cos(2 * pi() * k * j / 32)) AS ur, SUM(h * u * sin(2 * pi() * k * j / 32)) AS ui,
           SUM(h * w * cos(2 * pi() * k * j / 32)) AS wr, SUM(h * w * sin(2 * pi() * k * j / 32)) AS wi
           FROM (SELECT *, i - 16 * s AS j, 0.5 - 0.5 * cos(2 * pi() * (i - 16 * s) / 32) AS h FROM prime, range(3) q(s) WHERE i BETWEEN 16 * s AND 16 * s + 31) p,
           range(17) t(k) GROUP BY 1, 2, 3)
         SELECT vec_id, CAST(k AS INTEGER) AS k, k * 10 / 32.0::DOUBLE AS f, AVG(ur * ur + ui * ui) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / 120.0::DOUBLE AS sx,
           AVG(ur * wr + ui * wi) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / 120.0::DOUBLE AS co FROM g GROUP BY 1, 2, k""", digits=9)
def _(t):
    return spectral.spectra(_primes(t), V, "u", "w", FS, "hann", 32)


def _edges(n_lines, per_decade=10):
    # half lines nearest to log-spaced candidates
    n = max(math.ceil(math.log10(n_lines) * per_decade), 1)
    cand = [10 ** (math.log10(n_lines) * j / n) for j in range(n + 1)]
    return sorted({0, n_lines} | {min(max(round(c - 0.5), 0), n_lines) for c in cand})


_E = _edges(32)
_BINS = f"""ed(lo, hi, bin) AS (VALUES {', '.join(f'({a}, {b}, {i})' for i, (a, b) in enumerate(zip(_E[:-1], _E[1:])))}),
 og AS (SELECT vec_id, k, SUM(co) OVER (PARTITION BY vec_id ORDER BY k DESC) * 10 / 64.0::DOUBLE AS og FROM sp),
 bn AS (SELECT vec_id, bin, AVG(f) AS f, COUNT(*) AS n, AVG(sx) AS sx, AVG(sy) AS sy, AVG(co) AS co, AVG(qu) AS qu FROM sp JOIN ed ON k > lo AND k <= hi GROUP BY 1, 2)"""


@check("x03_log_bins", "vec_id bin n", "f sx co", f"WITH @prime, {_DFT}, {_BINS} SELECT vec_id, bin, n, f, sx, co FROM bn", digits=9)
def _(t):
    return spectral.log_binned(_lines(t), V, ["sx", "co"], spectral.log_bin_edges(N // 2))


@check("g19_ogive", "vec_id k", "og", f"WITH @prime, {_DFT}, {_BINS} SELECT vec_id, CAST(k AS INTEGER) AS k, og FROM og", digits=9)
def _(t):
    return spectral.ogive(_lines(t), V, "co", F.lit(FS / N))


@check("x04_spectra_job", "vec_id bin n", "f sx sy co qu og",
       f"""WITH @prime, {_DFT}, {_BINS} SELECT bn.vec_id, bin, n, f, sx, sy, co, qu, (a.og + b.og) / 2 AS og FROM bn
         JOIN og a ON a.vec_id = bn.vec_id AND a.k = floor(f * 6.4 + 1e-9) JOIN og b ON b.vec_id = bn.vec_id AND b.k = ceil(f * 6.4 - 1e-9)""", digits=9)
def _(t):
    return spectral.spectra_job(_primes(t), V, "u", "w", FS)


# a window length that is no power of two: two signals one after the other and half of a third
_LONG = """lw AS (SELECT vec_id, i, u AS x FROM win UNION ALL SELECT vec_id, i + 64, w FROM win UNION ALL SELECT vec_id, i + 128, c FROM win)"""


def _long(t):
    return t.windows().select("vec_id", F.concat("u", "w", "c").alias("x"))


@check("x05_dyadic_trim", "vec_id i", "x", f"WITH @win, {_LONG} SELECT vec_id, CAST(i AS INTEGER) AS i, x FROM lw WHERE i < 128")
def _(t):
    return windows.unpack(spectral.dyadic_grid(_long(t), ["x"]), V, ["x"])


@check("x05_dyadic_interpolation", "vec_id i", "x",
       f"""WITH @win, {_LONG}, g AS (SELECT vec_id, j, j * 191 / 127.0::DOUBLE AS pos FROM (SELECT DISTINCT vec_id FROM win), range(128) t(j))
         SELECT g.vec_id, CAST(j AS INTEGER) AS i, a.x + (b.x - a.x) * (pos - floor(pos)) AS x FROM g JOIN lw a ON a.vec_id = g.vec_id AND a.i = floor(pos)
         JOIN lw b ON b.vec_id = g.vec_id AND b.i = least(floor(pos) + 1, 191)""")
def _(t):
    return windows.unpack(spectral.dyadic_grid(_long(t), ["x"], "interp"), V, ["x"])


_MRD = "h AS (" + " UNION ALL ".join(
    f"""SELECT vec_id, {m} AS m, AVG(p) AS d, CASE WHEN COUNT(*) > 1 THEN STDDEV_SAMP(p) END AS sd, COUNT(*) AS n FROM (SELECT vec_id,
      (MAX(au) FILTER (b % 2 = 0) - MAX(au) FILTER (b % 2 = 1)) / 2 * (MAX(aw) FILTER (b % 2 = 0) - MAX(aw) FILTER (b % 2 = 1)) / 2 AS p FROM
      (SELECT vec_id, i // {2 ** (m - 1)} AS b, AVG(u) AS au, AVG(w) AS aw FROM win GROUP BY 1, 2) GROUP BY vec_id, b // 2) GROUP BY 1"""
    for m in range(1, 7)) + ")"


@check("x06_haar_multiresolution", "vec_id m n", "d sd", f"WITH @win, {_MRD} SELECT vec_id, m, n, d, sd FROM h", digits=9)
def _(t):
    return spectral.haar_spectrum(t.windows(), V, "u", "w", 6)


_GAP = """s0 AS (SELECT *, LAG(d) OVER g AS dp, LEAD(d) OVER g AS dn, SUM(d) OVER g AS c FROM h WINDOW g AS (PARTITION BY vec_id ORDER BY m)),
 s1 AS (SELECT *, coalesce(0.25 * dp + 0.5 * d + 0.25 * dn, d) AS ds FROM s0),
 s2 AS (SELECT *, abs(ds) AS s, abs(LEAD(ds) OVER g) AS sn, abs(LAG(ds) OVER g) AS spv, LAG(c) OVER g AS cp FROM s1 WINDOW g AS (PARTITION BY vec_id ORDER BY m)),
 s3 AS (SELECT *, MIN(CASE WHEN sn < s AND s > 0 THEN m END) OVER (PARTITION BY vec_id) AS pk FROM s2),
 gp AS (SELECT vec_id, MAX(pk) AS peak_m, MIN(CASE WHEN m > pk AND (s > spv OR (cp <> 0 AND abs(c - cp) <= 0.01 * abs(cp))) THEN m END) AS gap_m FROM s3 GROUP BY 1)"""


@check("g14_smoothing_121", "vec_id m", "d_smooth", f"WITH @win, {_MRD}, {_GAP} SELECT vec_id, m, ds AS d_smooth FROM s1", digits=9)
def _(t):
    return spectral.smooth_121(spectral.haar_spectrum(t.windows(), V, "u", "w", 6), V, "m", "d", "d_smooth")


@check("g15_gap_scale", "vec_id", "peak_m gap_m gap_s", f"WITH @win, {_MRD}, {_GAP} SELECT vec_id, peak_m, gap_m, pow(2, gap_m) / 10 AS gap_s FROM gp")
def _(t):
    return spectral.gap_scale(spectral.haar_spectrum(t.windows(), V, "u", "w", 6), V, FS)


@check("x07_multiresolution_job", "vec_id m n", "d d_smooth rel_error gap_s",
       f"""WITH @win, {_MRD}, {_GAP} SELECT s1.vec_id, s1.m, s1.n, s1.d, ds AS d_smooth, sd / d / sqrt(n) AS rel_error, pow(2, gap_m) / 10 AS gap_s FROM s1 JOIN gp USING (vec_id)""", digits=7)
def _(t):
    return spectral.multiresolution_job(t.windows(), V, "u", "w", 6, FS)


_SG = f"""b0 AS (SELECT vec_id, f, f * sx AS raw, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY bin) - 1 AS i FROM bn),
 b1 AS (SELECT *, (coalesce(LAG(raw) OVER g, 0) + raw + coalesce(LEAD(raw) OVER g, 0)) / 3 AS p FROM b0 WINDOW g AS (PARTITION BY vec_id ORDER BY i)),
 b2 AS (SELECT *, LAG(p) OVER g AS l, LEAD(p) OVER g AS r FROM b1 WINDOW g AS (PARTITION BY vec_id ORDER BY i)),
 mx AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rk FROM b2 WHERE p >= l AND p >= r AND (p > l OR p > r)),
 pa AS (SELECT vec_id, i AS ia, p AS pa FROM mx WHERE rk = 1),
 pb AS (SELECT mx.vec_id, arg_min(mx.i, rk) AS ib, arg_min(mx.p, rk) AS pb, MAX(ia) AS ia, MAX(pa) AS pa FROM mx JOIN pa USING (vec_id) WHERE abs(mx.i - ia) >= 5 GROUP BY 1),
 vl AS (SELECT b2.vec_id, arg_min(b2.i, (b2.p, b2.i)) AS iv, MIN(b2.p) AS pv, arg_min(b2.f, (b2.p, b2.i)) AS fv, MAX(ia) AS ia, MAX(ib) AS ib, MAX(least(pa, pb)) AS pe
   FROM b2 JOIN pb USING (vec_id) WHERE b2.i BETWEEN least(ia, ib) AND greatest(ia, ib) GROUP BY 1),
 gapf AS (SELECT d.vec_id, fv AS f_gap FROM (SELECT DISTINCT vec_id FROM b0) d LEFT JOIN vl ON vl.vec_id = d.vec_id AND iv > least(ia, ib) AND iv < greatest(ia, ib) AND pv <= 0.9 * pe)"""


def _gaps(t):
    return spectral.spectral_gap(spectral.log_binned(_lines(t), V, ["sx"], spectral.log_bin_edges(N // 2)), V, "sx")


@check("s04_top2_maxima_and_valley", "vec_id", "f_gap", f"WITH @prime, {_DFT}, {_BINS}, {_SG} SELECT vec_id, f_gap FROM gapf")
def _(t):
    return _gaps(t)


@check("x21_spectral_cutoff", "vec_id cut_source", "f_cut lambda_cut",
       f"""WITH @prime, {_DFT}, {_BINS}, {_SG} SELECT vec_id, CASE WHEN f_gap > 0 THEN 0 ELSE 1 END AS cut_source, coalesce(f_gap, 4.2 / 20) AS f_cut,
         4.2 / coalesce(f_gap, 4.2 / 20) AS lambda_cut FROM gapf""")
def _(t):
    return spectral.cutoff(_gaps(t), F.lit(4.2), "spectral_gap", 20.0, F.lit(10.0), 2.0)


@check("x23_scale_bands", "vec_id", "total small large very_large",
       f"""WITH @prime, {_DFT}, {_BINS}, {_SG}, c AS (SELECT vec_id, 4.2 / coalesce(f_gap, 4.2 / (pi() * 5)) AS l2 FROM gapf)
         SELECT vec_id, SUM(sx) AS total, coalesce(SUM(sx) FILTER (4.2 / f < l2 / 10), 0) / SUM(sx) AS small,
           coalesce(SUM(sx) FILTER (4.2 / f >= l2 / 10 AND 4.2 / f < l2), 0) / SUM(sx) AS large, coalesce(SUM(sx) FILTER (4.2 / f >= l2), 0) / SUM(sx) AS very_large
         FROM sp JOIN c USING (vec_id) WHERE k > 0 GROUP BY 1""", digits=8)
def _(t):
    import math as m

    cut = spectral.cutoff(_gaps(t), F.lit(4.2), "spectral_gap", m.pi * 5, F.lit(10.0), 2.0).select("vec_id", "lambda_cut")
    lines = _lines(t).join(cut, V)
    return spectral.band_fractions(lines, V, "sx", F.col("lambda_cut") / 10, F.col("lambda_cut"), F.lit(4.2))


def _modulation(cuts: str) -> str:
    """Direct Fourier sums for modulator u and signal w at the cutoffs of the table *cuts* (tag, fc)."""
    turn, half = "2 * pi() * k * i / 64", "CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END"
    return f"""{_DFT}, cuts(tag, fc) AS ({cuts}),
 an AS (SELECT vec_id, tag, fc, i, SUM({half} * (wr * cos({turn}) - wi * sin({turn}))) / 64 AS re, SUM({half} * (wr * sin({turn}) + wi * cos({turn}))) / 64 AS im
   FROM ft, cuts, range(64) r(i) WHERE k * 10 / 64.0::DOUBLE > fc GROUP BY 1, 2, 3, 4),
 le AS (SELECT vec_id, tag, fc, k, SUM(sqrt(re * re + im * im) * cos({turn})) AS er, -SUM(sqrt(re * re + im * im) * sin({turn})) AS ei
   FROM an, range(33) t(k) WHERE k * 10 / 64.0::DOUBLE <= fc GROUP BY 1, 2, 3, 4),
 both_low AS (SELECT vec_id, tag, i, SUM({half} * (er * cos({turn}) - ei * sin({turn}))) AS e, SUM({half} * (ur * cos({turn}) - ui * sin({turn}))) AS b
   FROM le JOIN ft USING (vec_id, k), range(64) r(i) GROUP BY 1, 2, 3),
 am AS (SELECT vec_id, tag, corr(b, e) AS am FROM both_low GROUP BY 1, 2)"""


@check("x20_amplitude_modulation", "vec_id", "am", f"WITH @prime, {_modulation('SELECT 1, 1.2::DOUBLE')} SELECT vec_id, am FROM am")
def _(t):
    return spectral.amplitude_modulation(_primes(t).withColumn("fc", F.lit(1.2)), V, "u", "w", FS, "fc")


@check("x22_amplitude_modulation_job", "vec_id modulator signal", "am")
def _(t):
    from ..plans.coherent_job import modulation_job

    return modulation_job(_primes(t), V, ["u", "w"], ["w", "c"], [("u", "w"), ("w", "c")], FS, N, F.lit(4.2), 20.0)


@check("x25_cutoff_sweep", "vec_id wavelength", "am",
       f"WITH @prime, {_modulation('SELECT l, 4.2::DOUBLE / l FROM (VALUES (1.0::DOUBLE), (2.0), (4.0), (8.0)) v(l)')} SELECT vec_id, tag AS wavelength, am FROM am")
def _(t):
    from ..plans.coherent_job import cutoff_sweep

    return cutoff_sweep(_primes(t), V, "u", "w", FS, 4.2, [1.0, 2.0, 4.0, 8.0])


@check("g07_recursive_filter", "vec_id i", "y",
       """WITH RECURSIVE @win, a AS (SELECT vec_id, i, u, AVG(u) OVER (PARTITION BY vec_id) AS mu FROM win),
         r AS (SELECT vec_id, i, exp(-1 / 20.0::DOUBLE) * mu + (1 - exp(-1 / 20.0::DOUBLE)) * u AS y FROM a WHERE i = 0
           UNION ALL SELECT a.vec_id, a.i, exp(-1 / 20.0::DOUBLE) * r.y + (1 - exp(-1 / 20.0::DOUBLE)) * a.u FROM a JOIN r ON a.vec_id = r.vec_id AND a.i = r.i + 1)
         SELECT vec_id, CAST(i AS INTEGER) AS i, y FROM r""", digits=9)
def _(t):
    def kernel(x):
        y = recursive_lowpass(x, FS, 2.0)
        return {"i": range(len(y)), "y": y}

    return map_windows(t.windows(), V, ["u"], kernel, "i int, y double")


# the odd extension has 190 samples; |H|^2 of the bilinear design multiplies each of its lines
_FILTER = """x AS (SELECT vec_id, i, u, MAX(u) FILTER (i = 0) OVER g AS a, MAX(u) FILTER (i = 63) OVER g AS z FROM win WINDOW g AS (PARTITION BY vec_id)),
 ext AS (SELECT vec_id, i + 63 AS j, u AS e FROM x UNION ALL SELECT vec_id, 63 - i, 2 * a - u FROM x WHERE i > 0 UNION ALL SELECT vec_id, 189 - i, 2 * z - u FROM x WHERE i < 63),
 fx AS (SELECT vec_id, k, SUM(e * cos(2 * pi() * k * j / 190)) AS re, -SUM(e * sin(2 * pi() * k * j / 190)) AS im FROM ext, range(96) t(k) GROUP BY 1, 2),
 gn AS (SELECT k, CASE WHEN k IN (0, 95) THEN 1 ELSE 2 END / 190.0::DOUBLE AS c, tan(pi() * least(k * 10 / 190.0::DOUBLE, 5 * (1 - 1e-12::DOUBLE)) / 10) AS t, tan(pi() / 10) AS t1, tan(pi() * 0.05::DOUBLE) AS t05, tan(pi() * 0.2::DOUBLE) AS t2 FROM range(96) r(k)),
 gain AS (SELECT k, c / (1 + pow(t / t1, 8)) AS low, CASE WHEN k = 0 THEN 0 ELSE c / (1 + pow(t1 / t, 8)) END AS high,
   CASE WHEN k = 0 THEN 0 ELSE c / (1 + pow(abs(t * t - t05 * t2) / (t * (t2 - t05)), 4)) END AS band FROM gn),
 y AS (SELECT vec_id, i, SUM(low * p) AS low, SUM(high * p) AS high, SUM(band * p) AS band
   FROM (SELECT vec_id, k, i, re * cos(2 * pi() * k * (i + 63) / 190) - im * sin(2 * pi() * k * (i + 63) / 190) AS p FROM fx, range(64) s(i)) JOIN gain USING (k) GROUP BY 1, 2)"""


@check("g08_zero_phase_butterworth", "vec_id i", "low high band", f"WITH @win, {_FILTER} SELECT vec_id, CAST(i AS INTEGER) AS i, low, high, band FROM y", digits=8)
def _(t):
    def kernel(x):
        return {"i": range(len(x)), "low": butterworth_zero_phase(x, FS, 4, high=1.0), "high": butterworth_zero_phase(x, FS, 4, low=1.0),
                "band": butterworth_zero_phase(x, FS, 2, low=0.5, high=2.0)}

    return map_windows(t.windows(), V, ["u"], kernel, "i int, low double, high double, band double")


@check("x01_window_preparation", "event_id", "u_p w_p",
       """WITH @tower, f AS (SELECT *, AVG(CAST(u IS NULL AS INTEGER)) OVER (PARTITION BY site, height, period_us) AS um FROM tower),
         v AS (SELECT site, height, period_us, us AS o, u AS x FROM tower WHERE u IS NOT NULL),
         b AS (SELECT f.*, v.o AS bo, v.x AS bx FROM f ASOF LEFT JOIN v ON f.site = v.site AND f.height = v.height AND f.period_us = v.period_us AND f.us >= v.o),
         a AS (SELECT b.*, v.o AS ao, v.x AS ax FROM b ASOF LEFT JOIN v ON b.site = v.site AND b.height = v.height AND b.period_us = v.period_us AND b.us <= v.o),
         g AS (SELECT *, CASE WHEN um <= 0.05 THEN CASE WHEN u IS NOT NULL THEN u WHEN bo IS NULL THEN ax WHEN ao IS NULL THEN bx
           ELSE bx + (ax - bx) * ((us - bo)::DOUBLE / (ao - bo)) END END AS uf FROM a)
         SELECT event_id, uf - AVG(uf) OVER (PARTITION BY site, height, period_us) AS u_p, w - AVG(w) OVER (PARTITION BY site, height, period_us) AS w_p FROM g""")
def _(t):
    from .standin import CHUNK_US, PERIOD

    return windows.prepare(t.tower(), PERIOD, "us", ["u", "w"], 0.05, CHUNK_US)
