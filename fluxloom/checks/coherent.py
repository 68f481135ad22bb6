"""Checks of quadrants, octants, wavelet events, surface renewal and coherent flux."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import coherent, lags, windows
from ..plans import coherent_job
from .registry import check
from .spectral import _BINS, _DFT, _MRD, FS, N, V, _primes

HOLES = (0.0, 0.5, 1.0, 2.0)
_HV = ", ".join(f"({h})" for h in HOLES)
_QUAD = f"""q0 AS (SELECT vec_id, u AS a, w AS b, AVG(u * w) OVER g AS total, STDDEV_POP(u) OVER g * STDDEV_POP(w) OVER g AS rms FROM prime WINDOW g AS (PARTITION BY vec_id)),
 cell AS (SELECT vec_id, quadrant, hole FROM (SELECT DISTINCT vec_id FROM q0), (VALUES (1), (2), (3), (4)) a(quadrant), (VALUES {_HV}) b(hole)),
 q1 AS (SELECT q0.*, h.hole, CASE WHEN a > 0 AND b > 0 THEN 1 WHEN a < 0 AND b > 0 THEN 2 WHEN a < 0 AND b < 0 THEN 3 WHEN a > 0 AND b < 0 THEN 4 END AS quadrant
   FROM q0, (VALUES {_HV}) h(hole) WHERE abs(a * b) >= h.hole * rms),
 q2 AS (SELECT vec_id, quadrant, hole, SUM(a * b) AS s, COUNT(*) AS k FROM q1 GROUP BY 1, 2, 3),
 tt AS (SELECT vec_id, COUNT(*) AS n, AVG(a * b) AS total FROM q0 GROUP BY 1),
 qd AS (SELECT cell.vec_id, cell.quadrant, CAST(cell.hole AS DOUBLE) AS hole, coalesce(k, 0) AS count, total, coalesce(s, 0) / (n * total) AS flux_fraction, coalesce(k, 0) / n::DOUBLE AS time_fraction
   FROM cell JOIN tt USING (vec_id) LEFT JOIN q2 ON q2.vec_id = cell.vec_id AND q2.quadrant = cell.quadrant AND q2.hole = cell.hole)"""


def _quads(t):
    return coherent.quadrants(_primes(t), V, "u", "w", HOLES)


@check("f28_quadrant_hole", "vec_id quadrant hole count", "total flux_fraction time_fraction",
       f"WITH @prime, {_QUAD} SELECT vec_id, quadrant, hole, count, total, flux_fraction, time_fraction FROM qd")
def _(t):
    return _quads(t)


@check("x17_quadrant_coherent_share", "vec_id hole", "f_ej f_sw f_coh",
       f"""WITH @prime, {_QUAD}, e AS (SELECT vec_id, hole, coalesce(SUM(flux_fraction) FILTER (quadrant = CASE WHEN total > 0 THEN 1 ELSE 2 END), 0) AS f_ej,
           coalesce(SUM(flux_fraction) FILTER (quadrant = CASE WHEN total > 0 THEN 3 ELSE 4 END), 0) AS f_sw FROM qd GROUP BY 1, 2)
         SELECT *, f_ej + f_sw AS f_coh FROM e""")
def _(t):
    return coherent.quadrant_coherent_fraction(_quads(t), V)


@check("f29_sign_aware_values", "vec_id", "delta_s delta_d eta exuberance",
       """WITH @prime, p AS (SELECT vec_id, w, u * w AS p, SUM(u * w) OVER (PARTITION BY vec_id) AS t FROM prime),
         g AS (SELECT vec_id, MAX(t) AS t, COUNT(*) AS n, SUM(p) FILTER (p * t > 0) AS d, coalesce(SUM(p) FILTER (p * t > 0 AND w > 0), 0) AS e,
           coalesce(SUM(p) FILTER (p * t > 0 AND w < 0), 0) AS s, COUNT(*) FILTER (p * t > 0 AND w > 0) AS ke, COUNT(*) FILTER (p * t > 0 AND w < 0) AS ks FROM p GROUP BY 1)
         SELECT vec_id, (e - s) / t AS delta_s, (ke - ks) / n::DOUBLE AS delta_d, t / d AS eta, t / d - 1 AS exuberance FROM g""")
def _(t):
    return coherent.sign_aware_values(_primes(t), V, "u", "w")


_OCT = """o AS (SELECT *, CASE WHEN u > 0 AND w > 0 AND c > 0 THEN 1 WHEN u < 0 AND w > 0 AND c > 0 THEN 2 WHEN u < 0 AND w > 0 AND c < 0 THEN 3 WHEN u > 0 AND w > 0 AND c < 0 THEN 4
  WHEN u > 0 AND w < 0 AND c > 0 THEN 5 WHEN u < 0 AND w < 0 AND c > 0 THEN 6 WHEN u < 0 AND w < 0 AND c < 0 THEN 7 WHEN u > 0 AND w < 0 AND c < 0 THEN 8 END AS octant FROM prime)"""


@check("f30_octants", "vec_id octant count", "time_fraction f_uw f_uc f_wc",
       f"""WITH @prime, {_OCT}, s AS (SELECT vec_id, SUM(u * w) AS uw, SUM(u * c) AS uc, SUM(w * c) AS wc FROM prime GROUP BY 1)
         SELECT o.vec_id, octant, COUNT(*) AS count, COUNT(*) / 64.0::DOUBLE AS time_fraction, SUM(u * w) / MAX(uw) AS f_uw, SUM(u * c) / MAX(uc) AS f_uc, SUM(w * c) / MAX(wc) AS f_wc
         FROM o JOIN s ON o.vec_id = s.vec_id WHERE octant IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return coherent.octants(_primes(t), V, "u", "w", "c")


@check("x08_quadrant_job", "vec_id pair quadrant hole count", "flux_fraction",
       f"""WITH @prime, {_QUAD}, {_QUAD.replace('q0', 'r0').replace('cell', 'cel2').replace('q1', 'r1').replace('q2', 'r2').replace('tt AS', 't2 AS').replace('JOIN tt', 'JOIN t2').replace('qd AS', 'qe AS').replace('SELECT vec_id, u AS a, w AS b, AVG(u * w) OVER g AS total, STDDEV_POP(u) OVER g', 'SELECT vec_id, w AS a, c AS b, AVG(w * c) OVER g AS total, STDDEV_POP(c) OVER g')}
         SELECT vec_id, 'uw' AS pair, quadrant, hole, count, flux_fraction FROM qd UNION ALL SELECT vec_id, 'wc', quadrant, hole, count, flux_fraction FROM qe""")
def _(t):
    return coherent_job.quadrant_job(_primes(t), V, {"uw": ("u", "w"), "wc": ("w", "c")}, HOLES)


SCALES = coherent.log_scales(0.15, 1.5, 8)
_SC = ", ".join(f"({j}, {a!r}::DOUBLE)" for j, a in enumerate(SCALES))
_CWT = f"""sc(j, a) AS (VALUES {_SC}),
 tr AS (SELECT p.vec_id, sc.j, sc.a, b.i, SUM(p.u * (1 - pow((p.i - b.i) / (10 * sc.a), 2)) * exp(-pow((p.i - b.i) / (10 * sc.a), 2) / 2)) / (10 * sc.a) AS t
   FROM prime p JOIN prime b ON p.vec_id = b.vec_id JOIN sc ON abs(p.i - b.i) <= ceil(4 * sc.a * 10) GROUP BY 1, 2, 3, 4),
 wv AS (SELECT vec_id, j, a, SUM(t * t) / 10 AS w FROM tr GROUP BY 1, 2, 3),
 pk AS (SELECT *, LAG(w) OVER g AS wp, LEAD(w) OVER g AS wn FROM wv WINDOW g AS (PARTITION BY vec_id ORDER BY j)),
 ds AS (SELECT d.vec_id, arg_min(a, j) AS a0 FROM (SELECT DISTINCT vec_id FROM wv) d LEFT JOIN (SELECT * FROM pk WHERE w > wp AND w >= wn) q ON q.vec_id = d.vec_id GROUP BY 1)"""


@check("x09_wavelet_transform", "vec_id j i", "t", f"WITH @prime, {_CWT} SELECT vec_id, j, CAST(i AS INTEGER) AS i, t FROM tr", digits=8)
def _(t):
    return coherent.wavelet_rows(_primes(t), V, "u", SCALES, FS)


@check("x09_ramp_and_haar_wavelets", "vec_id j i", "ramp haar",
       """WITH @prime, sc(j, a) AS (VALUES (0, 0.7::DOUBLE), (1, 1.3)), z AS (SELECT p.vec_id, j, a, b.i, p.u, (p.i - b.i) / 10.0::DOUBLE / a AS x FROM prime p JOIN prime b ON p.vec_id = b.vec_id
           JOIN sc ON abs(p.i - b.i) <= ceil(0.5 * a * 10))
         SELECT vec_id, j, CAST(i AS INTEGER) AS i, SUM(u * CASE WHEN x > -0.5 AND x <= 0 THEN 2 * x + 1 WHEN x > 0 AND x <= 0.5 THEN 2 * x - 1 ELSE 0 END) / (10 * a) AS ramp,
           SUM(u * CASE WHEN x > -0.5 AND x <= 0 THEN 1 WHEN x > 0 AND x <= 0.5 THEN -1 ELSE 0 END) / (10 * a) AS haar FROM z GROUP BY vec_id, j, i, a""", digits=8)
def _(t):
    p = _primes(t)
    r = coherent.wavelet_rows(p, V, "u", [0.7, 1.3], FS, "ramp").withColumnRenamed("t", "ramp")
    return r.join(coherent.wavelet_rows(p, V, "u", [0.7, 1.3], FS, "haar").withColumnRenamed("t", "haar"), [*V, "j", "i"])


@check("x10_wavelet_variance", "vec_id j", "a w", f"WITH @prime, {_CWT} SELECT vec_id, j, a, w FROM wv", digits=8)
def _(t):
    return coherent.wavelet_variance(_primes(t), V, "u", SCALES, FS)


@check("g16_interior_peak", "vec_id", "a0 duration", f"WITH @prime, {_CWT} SELECT vec_id, a0, a0 * pi() / sqrt(2) AS duration FROM ds")
def _(t):
    return coherent.duration_scale(coherent.wavelet_variance(_primes(t), V, "u", SCALES, FS), V)


_EV = f"""{_CWT}, tz AS (SELECT tr.vec_id, tr.i, t, ds.a0, LEAD(t) OVER (PARTITION BY tr.vec_id ORDER BY tr.i) AS nt FROM tr JOIN ds ON ds.vec_id = tr.vec_id AND ds.a0 = tr.a),
 ev AS (SELECT vec_id, a0, (i + t / (t - nt)) / 10 AS time_s FROM tz WHERE t > 0 AND nt < 0),
 evt AS (SELECT * FROM ev WHERE time_s >= a0 AND time_s <= 6.4 - a0)"""


def _events(t):
    return coherent.ramp_events(_primes(t), V, "u", SCALES, FS, edge_scales=1.0)


@check("x11_ramp_events", "vec_id", "a0 time_s", f"WITH @prime, {_EV} SELECT vec_id, a0, time_s FROM evt")
def _(t):
    return _events(t)


@check("x11_ramp_events_refined", "vec_id", "a0 time_s")
def _(t):
    p = _primes(t).withColumn("flux_sign", windows.array_mean(F.zip_with("w", "c", lambda a, b: a * b)))
    return coherent.ramp_events(p, V, "u", SCALES, FS, slope="auto", edge_scales=1.0, refine="ramp")


def _slots(t):
    ev = _events(t).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.bround(F.col("time_s") * FS).cast("int"))).alias("ev"))
    return _primes(t).join(ev, V)


_CA = f"""{_EV}, es AS (SELECT vec_id, CAST(round_even(time_s * 10, 0) AS BIGINT) AS e FROM evt),
 ca AS (SELECT es.vec_id, l AS lag, AVG(p.u) AS cx, AVG(p.w) AS cy, AVG(p.u * p.w) AS cxy FROM es, range(-6, 7) r(l) JOIN prime p ON TRUE WHERE p.vec_id = es.vec_id AND p.i = es.e + l GROUP BY 1, 2)"""


def _other(sql: str) -> str:
    """The event tables for the events of c instead of u, with names of their own."""
    one = sql.replace("SUM(p.u * (1 - pow", "SUM(p.c * (1 - pow")
    return re.sub(r"\b(sc|tr|wv|pk|ds|tz|ev|evt|es|ca)\b(?! *\()", r"\1_c", one).replace("sc(j, a)", "sc_c(j, a)")


@check("g18_conditional_average", "vec_id lag", "cx", f"WITH @prime, {_CA} SELECT vec_id, CAST(lag AS INTEGER) AS lag, cx FROM ca", digits=8)
def _(t):
    c = _slots(t).select("vec_id", F.posexplode(coherent.conditional_average(F.col("u"), F.col("ev"), 6)).alias("p", "cx"))
    return c.select("vec_id", (F.col("p") - 6).alias("lag"), "cx").filter("cx is not null")


@check("x16_triple_decomposition_flux", "vec_id n_events valid", "f_tot f_cs f_t f_ej f_sw ratio flux_error",
       f"""WITH @prime, {_CA}, k AS (SELECT vec_id, COUNT(*) AS n_events FROM es GROUP BY 1), cv AS (SELECT vec_id, AVG(u * w) AS cov, SUM(u) AS su, SUM(w) AS sw FROM prime GROUP BY 1),
         g AS (SELECT vec_id, AVG(cxy) AS f_tot, AVG(cx * cy) AS f_cs, AVG(cx) AS mx, AVG(cy) AS my, COUNT(*) AS nl,
           (coalesce(SUM(cx * cy) FILTER (lag < 0), 0) + 0.5 * SUM(cx * cy) FILTER (lag = 0)) / 13 AS f_ej, (coalesce(SUM(cx * cy) FILTER (lag > 0), 0) + 0.5 * SUM(cx * cy) FILTER (lag = 0)) / 13 AS f_sw FROM ca GROUP BY 1)
         SELECT vec_id, CAST(n_events AS INTEGER) AS n_events, CAST(coalesce(f_tot / cov BETWEEN 0.8 AND 1.2, FALSE) AS INTEGER) AS valid, f_tot, f_cs, f_tot - f_cs AS f_t, f_ej, f_sw, f_tot / cov AS ratio,
           (-su * my - sw * mx - 64 * mx * my) / 63 AS flux_error FROM g JOIN k USING (vec_id) JOIN cv USING (vec_id) WHERE nl = 13""", digits=7)
def _(t):
    out = coherent.coherent_flux(_slots(t), V, "u", "w", "ev", 6).filter("f_tot is not null")
    return out.withColumn("valid", F.col("valid").cast("int"))


_SRF = """sf AS (SELECT a.vec_id, b.i - a.i AS lag, AVG(pow(b.u - a.u, 2)) AS s2, AVG(pow(b.u - a.u, 3)) AS s3, AVG(pow(b.u - a.u, 5)) AS s5
  FROM prime a JOIN prime b ON a.vec_id = b.vec_id AND b.i - a.i IN (1, 2, 3, 4, 6) GROUP BY 1, 2),
 cq AS (SELECT *, 10 * s2 - s5 / s3 AS p, 10 * s3 AS q, (10 * s3) ** 2 / 4 + (10 * s2 - s5 / s3) ** 3 / 27 AS disc FROM sf),
 rt AS (SELECT vec_id, lag, s3, CASE WHEN disc > 0 THEN cbrt(-q / 2 + sqrt(disc)) + cbrt(-q / 2 - sqrt(disc))
   ELSE 2 * sqrt(-p / 3) * cos(acos(greatest(least(-q / 2 / sqrt(-p / 3) ** 3, 1), -1)) / 3 - 2 * pi() * k / 3) END AS x
   FROM cq, range(3) t(k) WHERE disc <= 0 OR k = 0),
 am AS (SELECT vec_id, lag, MAX(s3) AS s3, arg_max(x, abs(x)) AS a FROM rt WHERE x * s3 < 0 GROUP BY 1, 2),
 rp AS (SELECT sf.vec_id, sf.lag, sf.s3, am.a, -pow(am.a, 3) * (sf.lag / 10.0::DOUBLE) / sf.s3 AS period FROM sf LEFT JOIN am ON am.vec_id = sf.vec_id AND am.lag = sf.lag),
 rr AS (SELECT vec_id, lag, CASE WHEN period BETWEEN 2 * lag / 10.0 AND 6.4 THEN a END AS a, CASE WHEN period BETWEEN 2 * lag / 10.0 AND 6.4 THEN period END AS period, s3 / (lag / 10.0::DOUBLE) AS s3_rate FROM rp)"""


def _renewal(t):
    sf = lags.structure_functions(_primes(t), V, "u", (1, 2, 3, 4, 6))
    return coherent.renewal_ramps(sf, V, FS, N, 2.0)


@check("x12_surface_renewal_ramps", "vec_id lag", "a period s3_rate",
       f"WITH @prime, {_SRF} SELECT vec_id, CAST(lag AS INTEGER) AS lag, a, period, s3_rate FROM rr", digits=7)
def _(t):
    return _renewal(t)


@check("x12_two_lag_ramps", "vec_id lag", "d s a2")
def _(t):
    return _renewal(t)


@check("x13_renewal_alpha_fit", "vec_id lag", "alpha renewal_flux",
       f"""WITH @prime, {_SRF}, m AS (SELECT vec_id, covar_pop(w, u) AS y FROM prime GROUP BY 1), f AS (SELECT rr.*, a * 3.5 / period AS f0, y FROM rr JOIN m USING (vec_id)),
         al AS (SELECT lag, CASE WHEN COUNT(*) > 2 THEN SUM(f0 * y) / SUM(f0 * f0) END AS alpha FROM f WHERE f0 IS NOT NULL GROUP BY 1)
         SELECT vec_id, CAST(f.lag AS INTEGER) AS lag, alpha, alpha * f0 AS renewal_flux FROM f LEFT JOIN al ON al.lag = f.lag""", digits=8)
def _(t):
    flux = _primes(t).select("vec_id", windows.array_mean(F.zip_with("w", "u", lambda a, b: a * b)).alias("y"))
    return coherent.renewal_flux(_renewal(t).join(flux, V), F.lit(3.5), "fit", measured=F.col("y"))


def _tke(a: float) -> str:
    """Energy triggers at scale *a*: three-sample means with zeros beyond the ends, waves from a minimum to the next maximum."""
    return f"""en AS (SELECT vec_id, i, w, sqrt(u * u + c * c + w * w) AS q FROM prime),
 es3 AS (SELECT vec_id, i, (q + coalesce(LAG(q) OVER g, 0) + coalesce(LEAD(q) OVER g, 0)) / 3 AS x FROM en WINDOW g AS (PARTITION BY vec_id ORDER BY i)),
 ec AS (SELECT vec_id, i, x - AVG(x) OVER (PARTITION BY vec_id) AS x FROM es3),
 et AS (SELECT b.vec_id, b.i, SUM(p.x * (1 - pow((p.i - b.i) / (10 * {a!r}::DOUBLE), 2)) * exp(-pow((p.i - b.i) / (10 * {a!r}::DOUBLE), 2) / 2)) / (10 * {a!r}::DOUBLE) AS t
   FROM ec p JOIN ec b ON p.vec_id = b.vec_id AND abs(p.i - b.i) <= ceil(4 * {a!r}::DOUBLE * 10) GROUP BY 1, 2),
 ex AS (SELECT *, LAG(t) OVER g AS tp, LEAD(t) OVER g AS tn FROM et WINDOW g AS (PARTITION BY vec_id ORDER BY i)),
 pr AS (SELECT l.vec_id, l.i, l.t, MIN(h.i) AS h, arg_min(h.t, h.i) AS th FROM ex l JOIN ex h ON h.vec_id = l.vec_id AND h.i > l.i AND h.t > h.tp AND h.t >= h.tn
   WHERE l.t < l.tp AND l.t <= l.tn GROUP BY 1, 2, 3),
 sz AS (SELECT *, th - t AS size, AVG(th - t) OVER (PARTITION BY vec_id) AS mean_size FROM pr),
 tk AS (SELECT vec_id, i, size, row_number() OVER g AS event, LEAD(i, 1, 64) OVER g AS upto FROM sz WHERE size > 1.25 * mean_size AND i BETWEEN 10 * {a!r}::DOUBLE AND 64 - 10 * {a!r}::DOUBLE
   WINDOW g AS (PARTITION BY vec_id ORDER BY i))"""


@check("x14_tke_triggers", "vec_id event", "time_s amplitude sweep_share",
       f"""WITH @prime, {_tke(0.3)}, cw AS (SELECT tk.vec_id, event, SUM(p.w) OVER (PARTITION BY tk.vec_id, event ORDER BY p.i) AS s FROM tk JOIN prime p ON p.vec_id = tk.vec_id AND p.i >= tk.i AND p.i < tk.upto),
         sw AS (SELECT vec_id, event, AVG((s < 0)::INT) AS sweep_share FROM cw GROUP BY 1, 2)
         SELECT vec_id, event, i / 10.0::DOUBLE AS time_s, size AS amplitude, sweep_share FROM tk JOIN sw USING (vec_id, event)""")
def _(t):
    return coherent.tke_triggers(_primes(t), V, "u", "c", "w", FS, 0.3, 0.3, edge_scales=1.0)


_FRAME = """ss(m, h) AS (VALUES (1, 1), (2, 2), (3, 4), (4, 8), (5, 16), (6, 32)),
 cf AS (SELECT p.vec_id, m, h, b.i AS b, SUM(CASE WHEN p.i < b.i + h THEN p.u ELSE -p.u END) * pow(2, -m / 2.0::DOUBLE) AS wu, SUM(CASE WHEN p.i < b.i + h THEN p.w ELSE -p.w END) * pow(2, -m / 2.0::DOUBLE) AS ww
   FROM ss JOIN prime b ON b.i <= 64 - 2 * h JOIN prime p ON p.vec_id = b.vec_id AND p.i >= b.i AND p.i < b.i + 2 * h GROUP BY 1, 2, 3, 4),
 th AS (SELECT *, CASE WHEN abs(wu) > 1.5 * sqrt(AVG(wu * wu) OVER g) THEN wu ELSE 0 END AS su, CASE WHEN abs(ww) > 1.5 * sqrt(AVG(ww * ww) OVER g) THEN ww ELSE 0 END AS sw FROM cf WINDOW g AS (PARTITION BY vec_id, m)),
 rc AS (SELECT t.vec_id, t.i, SUM(sg * su) AS xs, SUM(sg * sw) AS ys, SUM(sg * wu) AS xr, SUM(sg * ww) AS yr FROM (SELECT th.*, p.i, pow(2, -1.5 * m) * CASE WHEN th.b > p.i - h THEN 1 ELSE -1 END AS sg
   FROM th JOIN prime p ON p.vec_id = th.vec_id AND th.b <= p.i AND th.b > p.i - 2 * h) t GROUP BY 1, 2)"""


@check("x18_strong_set", "vec_id", "f_strong frac ratio",
       f"""WITH @prime, {_FRAME}, cv AS (SELECT vec_id, AVG(u * w) AS cov FROM prime GROUP BY 1)
         SELECT vec_id, AVG(xs * ys) AS f_strong, AVG(xs * ys) / AVG(xr * yr) AS frac, AVG(xr * yr) / MAX(cov) AS ratio FROM rc JOIN cv USING (vec_id) GROUP BY 1""", digits=7)
def _(t):
    return coherent.strong_set(_primes(t), V, "u", "w", 1.5)


def _share_at(k: float) -> str:
    """The strong set's tables at another threshold, under names of their own."""
    frame = re.sub(r"\b(ss|cf|th|rc)\b", rf"\1_{int(k * 10)}", _FRAME.replace("> 1.5 * sqrt", f"> {k} * sqrt"))
    return f"SELECT vec_id, {k}::DOUBLE AS k_threshold, frac FROM (WITH {frame} SELECT vec_id, AVG(xs * ys) / AVG(xr * yr) AS frac FROM rc_{int(k * 10)} GROUP BY 1)"


@check("x25_strong_set_sweep", "vec_id k_threshold", "frac", "WITH @prime " + " UNION ALL ".join(map(_share_at, (1.0, 1.5, 2.0, 3.0, 4.0))), digits=7)
def _(t):
    return coherent_job.strong_set_sweep(_primes(t), V, "u", "w", [1.0, 1.5, 2.0, 3.0, 4.0])


def _flux_terms(signal: str, suffix: str, pair: str, x: str, y: str) -> str:
    """Triple decomposition of x'y' about the events of one signal; all terms need each of the 13 lags."""
    return f"""SELECT v.vec_id, '{signal}' AS event_signal, '{pair}' AS pair, CAST(coalesce(k.n, 0) AS INTEGER) AS n_events, f_tot, f_cs,
   ej AS f_ej, sw AS f_sw, f_tot / cov AS ratio
  FROM (SELECT vec_id, AVG({x} * {y}) AS cov FROM prime GROUP BY 1) v LEFT JOIN (SELECT vec_id, COUNT(*) AS n FROM es{suffix} GROUP BY 1) k USING (vec_id)
  LEFT JOIN (SELECT vec_id, CASE WHEN COUNT(*) = 13 THEN AVG(cxy) END AS f_tot, CASE WHEN COUNT(*) = 13 THEN AVG(cx * cy) END AS f_cs,
      CASE WHEN COUNT(*) = 13 THEN (SUM(cx * cy) FILTER (lag < 0) + 0.5 * SUM(cx * cy) FILTER (lag = 0)) / 13 END AS ej, CASE WHEN COUNT(*) = 13 THEN (SUM(cx * cy) FILTER (lag > 0) + 0.5 * SUM(cx * cy) FILTER (lag = 0)) / 13 END AS sw
    FROM (SELECT e.vec_id, l AS lag, AVG(p.{x}) AS cx, AVG(p.{y}) AS cy, AVG(p.{x} * p.{y}) AS cxy FROM es{suffix} e, range(-6, 7) r(l) JOIN prime p ON TRUE WHERE p.vec_id = e.vec_id AND p.i = e.e + l GROUP BY 1, 2)
    GROUP BY 1) g USING (vec_id)"""


@check("x19_coherent_flux_job", "vec_id event_signal pair n_events", "f_tot f_cs f_ej f_sw ratio",
       f"WITH @prime, {_CA}, {_other(_CA)} " + " UNION ALL ".join(_flux_terms(s, "" if s == "u" else "_c", p, *xy) for s in "uc" for p, xy in (("uw", "uw"), ("wc", "wc"))), digits=7)
def _(t):
    return coherent_job.coherent_flux_job(_primes(t), V, ["u", "c"], {"uw": ("u", "w"), "wc": ("w", "c")}, SCALES, FS, 6, 1.0)


_RECORD = """SELECT v.vec_id, '{s}' AS signal, d.a0, d.a0 * pi() / sqrt(2) AS duration, CAST(coalesce(n, 0) AS INTEGER) AS n_events, spacing AS mean_spacing
  FROM (SELECT DISTINCT vec_id FROM prime) v JOIN ds{x} d USING (vec_id) LEFT JOIN (SELECT vec_id, COUNT(*) AS n, CASE WHEN COUNT(*) > 1 THEN (MAX(time_s) - MIN(time_s)) / (COUNT(*) - 1) END AS spacing
    FROM evt{x} GROUP BY 1) e USING (vec_id)"""


_COUNTS = """SELECT v.vec_id, '{d}' AS detector, coalesce(n, 0) AS n_events, CASE WHEN n > 1 THEN (b - a) / (n - 1) END AS mean_spacing FROM (SELECT DISTINCT vec_id FROM prime) v
  LEFT JOIN (SELECT vec_id, COUNT(*) AS n, MIN({t}) AS a, MAX({t}) AS b FROM {f} GROUP BY 1) e USING (vec_id)"""


@check("x15_ramps_job", "vec_id detector", "n_events mean_spacing",
       f"""WITH @prime, {_EV}, {_other(_EV)}, {_tke(SCALES[len(SCALES) // 2])} {_COUNTS.format(d="u", t="time_s", f="evt")} UNION ALL {_COUNTS.format(d="c", t="time_s", f="evt_c")}
         UNION ALL {_COUNTS.format(d="tke", t="i / 10.0::DOUBLE", f="tk")}""")
def _(t):
    return coherent_job.ramps_job(_primes(t), V, ["u", "c"], ("u", "c", "w"), SCALES, FS, 1.0)


@check("x15_event_records", "vec_id signal n_events", "a0 duration mean_spacing",
       f"WITH @prime, {_EV}, {_other(_EV)} {_RECORD.format(s='u', x='')} UNION ALL {_RECORD.format(s='c', x='_c')}")
def _(t):
    return coherent_job.ramp_records(_primes(t), V, ["u", "c"], SCALES, FS, edge_scales=1.0)[0]


@check("x15_renewal_records", "vec_id lag", "a period alpha renewal_flux",
       f"""WITH @prime, {_SRF.replace("IN (1, 2, 3, 4, 6)", "IN (1, 2, 3)")}, m AS (SELECT vec_id, covar_pop(w, u) AS y FROM prime GROUP BY 1), f AS (SELECT rr.*, rr.a * 3.5 / rr.period AS f0, y FROM rr JOIN m USING (vec_id)),
         al AS (SELECT lag, CASE WHEN COUNT(*) > 2 THEN SUM(f0 * y) / SUM(f0 * f0) END AS alpha FROM f WHERE f0 IS NOT NULL GROUP BY 1)
         SELECT vec_id, CAST(f.lag AS INTEGER) AS lag, f.a, f.period, alpha, alpha * f0 AS renewal_flux FROM f LEFT JOIN al ON al.lag = f.lag""", digits=7)
def _(t):
    p = _primes(t)
    flux = windows.array_mean(F.zip_with("w", "u", lambda a, b: a * b))
    return coherent_job.ramp_records(p, V, ["u"], SCALES, FS, "u", (1, 2, 3), F.lit(3.5), flux, min_period_lags=2.0)[1]


_TRIPLE = """SELECT v.vec_id, '{s}' AS event_signal, 'uw' AS pair, CAST(coalesce(k.n, 0) AS INTEGER) AS n_events, f_tot, f_cs, f_tot / cov AS ratio, f_cs / f_tot AS share, a0 * pi() / sqrt(2) AS duration
  FROM (SELECT vec_id, AVG(u * w) AS cov FROM prime GROUP BY 1) v JOIN ds{x} USING (vec_id) LEFT JOIN (SELECT vec_id, COUNT(*) AS n FROM es{x} GROUP BY 1) k USING (vec_id)
  LEFT JOIN (SELECT vec_id, AVG(cxy) AS f_tot, AVG(cx * cy) AS f_cs FROM ca{x} GROUP BY 1 HAVING COUNT(*) = 13) g USING (vec_id)"""
_TRIPLES = f"WITH @prime, {_CA}, {_other(_CA)} {_TRIPLE.format(s='u', x='')} UNION ALL {_TRIPLE.format(s='c', x='_c')}"


@check("x19_coherent_estimates", "vec_id event_signal pair n_events", "f_tot f_cs ratio share duration", _TRIPLES, digits=7)
def _(t):
    return coherent_job.coherent_estimates(_primes(t), V, ["u", "c"], {"uw": ("u", "w")}, SCALES, FS, 6, strong=None, edge_scales=1.0)["wavelet"]


_PART = "SELECT vec_id, '{m}' AS module, CAST({n} AS BIGINT) AS n_rows, {v} AS value FROM {t} GROUP BY vec_id"


@check("x24_module_values", "vec_id module n_rows", "value",
       f"""WITH @prime, {_CA}, {_other(_CA)}, {_MRD}, {_QUAD}
         {_PART.format(m="multiresolution", n="COUNT(*)", v="SUM(d)", t="h")} UNION ALL {_PART.format(m="quadrant", n="COUNT(*)", v="SUM(flux_fraction)", t="(SELECT * FROM qd WHERE hole <> 0.5)")}
         UNION ALL {_PART.format(m="octant", n="COUNT(DISTINCT (u > 0)::INT * 4 + (w > 0)::INT * 2 + (c > 0)::INT)", v="COUNT(*)::DOUBLE", t="prime")}
         UNION ALL {_PART.format(m="ramps", n="COUNT(*)", v="SUM(n_events)::DOUBLE", t=f"({_RECORD.format(s='u', x='')} UNION ALL {_RECORD.format(s='c', x='_c')})")}
         UNION ALL {_PART.format(m="coherent_flux", n="COUNT(*)", v="SUM(f_cs)", t=f"({_TRIPLE.format(s='u', x='')} UNION ALL {_TRIPLE.format(s='c', x='_c')})")}""", digits=7)
def _(t):
    measure = {"multiresolution": "d", "quadrant": "flux_fraction", "octant": "count", "ramps": "n_events", "coherent_flux": "f_cs"}
    jobs = coherent_job.run_modules(_primes(t), V, list(measure), FS, N, 6, steps=SCALES, half=6, edge_scales=1.0)
    out = None
    for name, df in jobs.items():
        part = df.groupBy(*V).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(measure[name]).cast("double")).alias("value")).withColumn("module", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@check("x24_module_dispatch", "vec_id module", "n_rows",
       f"""WITH @prime, {_DFT}, {_BINS}, {_MRD}, {_QUAD} SELECT vec_id, 'spectra' AS module, COUNT(*) AS n_rows FROM bn GROUP BY 1 UNION ALL SELECT vec_id, 'multiresolution', COUNT(*) FROM h GROUP BY 1
         UNION ALL SELECT vec_id, 'quadrant', COUNT(*) FROM qd WHERE hole <> 0.5 GROUP BY 1 UNION ALL SELECT vec_id, 'scales', 1 FROM prime GROUP BY 1""")
def _(t):
    jobs = coherent_job.run_modules(_primes(t), V, ["spectra", "multiresolution", "quadrant", "scales"], FS, N, 6)
    out = None
    for name, df in jobs.items():
        part = df.groupBy(*V).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("module", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@check("f38_analysis_closure", "vec_id ok", "var_error og_error quad_error mrd_error",
       "WITH @prime, " + _DFT + ", " + _MRD + """, d AS (SELECT vec_id, VAR_POP(u) AS v, covar_pop(u, w) AS c FROM prime GROUP BY 1),
         s AS (SELECT vec_id, SUM(sx) * 10 / 64 AS v, SUM(co) * 10 / 64 AS c FROM sp WHERE k > 0 GROUP BY 1), m AS (SELECT vec_id, SUM(d) AS c FROM h GROUP BY 1),
         q AS (SELECT vec_id, SUM(u * w) FILTER (u * w > 0) / SUM(u * w) + SUM(u * w) FILTER (u * w < 0) / SUM(u * w) AS q FROM prime GROUP BY 1),
         e AS (SELECT vec_id, abs(s.v - d.v) AS var_error, abs(s.c - d.c) AS og_error, abs(q - 1) AS quad_error, abs(m.c - d.c) AS mrd_error
           FROM d JOIN s USING (vec_id) JOIN m USING (vec_id) JOIN q USING (vec_id))
         SELECT *, CAST(greatest(var_error, og_error, quad_error, mrd_error) < 1e-6 AS INTEGER) AS ok FROM e""", digits=7)
def _(t):
    return coherent_job.closure_checks(_primes(t), V, "u", "w", FS, N, 6)


@check("x26_cross_record_medians", "label bin", "median_sx n",
       """WITH @prime, l AS (SELECT DISTINCT vec_id, label FROM prime),
       """ + _DFT + ", " + _BINS + """,
         v AS (SELECT vec_id, VAR_POP(u) AS vu FROM prime GROUP BY 1)
         SELECT label, bin, MEDIAN(sx * f / vu) AS median_sx, COUNT(*) AS n FROM bn JOIN l USING (vec_id) JOIN v USING (vec_id) GROUP BY 1, 2""")
def _(t):
    return coherent_job.median_spectra(_primes(t), V, "label", "u", "w", FS, N)
