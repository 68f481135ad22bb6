"""Checks of lagged covariances, structure functions and signal-strength bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lags, windows
from .registry import check

V = ["vec_id"]
_COV = """lg AS (SELECT a.vec_id, b.i - a.i AS lag, covar_pop(a.w, b.c) AS cov, COUNT(*) AS n FROM win a JOIN win b ON a.vec_id = b.vec_id
  AND b.i - a.i BETWEEN -8 AND 8 GROUP BY 1, 2)"""


@check("f23_lagged_covariance", "vec_id lag n", "cov", f"WITH @win, {_COV} SELECT vec_id, CAST(lag AS INTEGER) AS lag, n, cov FROM lg", digits=8)
def _(t):
    return lags.lagged_covariances(t.windows(), V, "w", "c", 8)


@check("f23_lagged_covariance_wide", "vec_id lag n", "cov",
       f"WITH @win, {_COV.replace('-8 AND 8', '-60 AND 60')} SELECT vec_id, CAST(lag AS INTEGER) AS lag, n, cov FROM lg", digits=8)
def _(t):
    return lags.lagged_covariances_wide(t.windows(), V, "w", "c", 60)


_BLOCKS = _COV.replace("lg AS (SELECT a.vec_id, b.i", "@name AS (SELECT a.vec_id, @block AS block, b.i").replace("1, 2)", "1, 2, 3)")


@check("f23_block_covariances", "vec_id block lag n", "cov",
       f"""WITH @win, {_BLOCKS.replace("@name", "whole").replace("@block", "0")}, {_BLOCKS.replace("@name", "parts").replace("@block", "a.i // 16 + 1")}
         SELECT vec_id, CAST(block AS INTEGER) AS block, CAST(lag AS INTEGER) AS lag, n, cov FROM (FROM whole UNION ALL FROM parts)""", digits=8)
def _(t):
    return lags.block_covariances(t.windows(), V, "w", "c", 8, 4).filter("n > 0")


@check("f24_peak_lag", "vec_id lag", "ratio",
       f"""WITH @win, {_COV} SELECT vec_id, CAST(arg_max(lag, abs(cov)) AS INTEGER) AS lag, MAX(abs(cov)) / sqrt(AVG(cov * cov) FILTER (abs(lag) > 16 / 3.0)) AS ratio FROM lg GROUP BY 1""")
def _(t):
    return lags.peak_lag(lags.lagged_covariances(t.windows(), V, "w", "c", 8), V)


_SF = """sf AS (SELECT a.vec_id, b.i - a.i AS lag, AVG((b.u - a.u) ** 2) AS s2, AVG((b.u - a.u) ** 3) AS s3, AVG((b.u - a.u) ** 5) AS s5
  FROM win a JOIN win b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 1 AND 20 GROUP BY 1, 2)"""


@check("g10_structure_function", "vec_id lag", "s2 s3 s5", f"WITH @win, {_SF} SELECT vec_id, CAST(lag AS INTEGER) AS lag, s2, s3, s5 FROM sf", digits=9)
def _(t):
    return lags.structure_functions(t.windows(), V, "u", range(1, 21))


@check("p22_dissipation_rate", "vec_id", "epsilon",
       f"""WITH @win, {_SF}, m AS (SELECT vec_id, 4 + AVG(u) AS um FROM win GROUP BY 1)
         SELECT vec_id, pow(AVG(s2 / (2 * pow(um * lag * 0.1, 2 / 3.0::DOUBLE))), 1.5) AS epsilon FROM sf JOIN m USING (vec_id)
         WHERE lag * 0.1 BETWEEN 0.25 AND 1.55 GROUP BY 1""", digits=9)
def _(t):
    w = t.windows().select("vec_id", (4 + windows.array_mean(F.col("u"))).alias("um"), "u")
    sf = lags.structure_functions(w, ["vec_id", "um"], "u", range(1, 21), (2,))
    return lags.dissipation_rate(sf, V, F.col("um"), 0.1, 0.25, 1.55)


@check("p23_random_error_of_covariance", "vec_id", "error",
       """WITH @prime, g AS (SELECT a.vec_id, b.i - a.i AS p, SUM(a.w * b.w) / 64 AS ww, SUM(a.c * b.c) / 64 AS cc, SUM(a.w * b.c) / 64 AS wc, SUM(a.c * b.w) / 64 AS cw
           FROM prime a JOIN prime b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN -12 AND 12 GROUP BY 1, 2)
         SELECT vec_id, CASE WHEN SUM(ww * cc + wc * cw) > 0 THEN sqrt(SUM(ww * cc + wc * cw) / 64) END AS error FROM g GROUP BY 1""", digits=9)
def _(t):
    p = windows.demeaned(t.windows(), ["w", "c"])
    return lags.covariance_random_error(p, V, "w", "c", 12, min_samples=64)


@check("p24_noise_variance", "vec_id", "noise_var total_var",
       """WITH @prime, g AS (SELECT a.vec_id, b.i - a.i AS p, SUM(a.u * b.u) / 64 AS r FROM prime a JOIN prime b ON a.vec_id = b.vec_id
           AND b.i - a.i BETWEEN 0 AND 9 GROUP BY 1, 2)
         SELECT vec_id, greatest(MAX(r) FILTER (p = 0) - regr_intercept(r, pow(p / 10.0::DOUBLE, 2 / 3.0::DOUBLE)) FILTER (p BETWEEN 2 AND 9), 0) AS noise_var,
           MAX(r) FILTER (p = 0) AS total_var FROM g GROUP BY 1""", digits=9)
def _(t):
    return lags.noise_variance(t.windows(), V, "u", 10.0, 2, 9, min_samples=64)


@check("m09_bounded_correlation_peak", "vec_id lag", "r",
       """WITH @prime, z AS (SELECT vec_id, i, u / STDDEV_POP(u) OVER g AS x, w / STDDEV_POP(w) OVER g AS y FROM prime WINDOW g AS (PARTITION BY vec_id)),
         r AS (SELECT a.vec_id, b.i - a.i AS lag, SUM(a.x * b.y) / 64 AS r FROM z a JOIN z b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN -15 AND 15 GROUP BY 1, 2)
         SELECT vec_id, CAST(arg_max(lag, r) AS INTEGER) AS lag, MAX(r) AS r FROM r GROUP BY 1""")
def _(t):
    return lags.bounded_correlation_peak(t.windows(), V, "u", "w", 15)


_BIN = """WITH @prod, s AS (SELECT group_name, MIN(rssi) AS lo, MAX(rssi) AS hi FROM prod GROUP BY 1),
 c AS (SELECT group_name, b AS bin, lo + b * 0.07 AS centre FROM s, range(30) t(b) WHERE b <= ceil((hi - lo) / 0.07)),
 m AS (SELECT c.group_name, c.bin, MAX(c.centre) AS centre, COUNT(*) AS n, CASE WHEN COUNT(*) >= 30 THEN MEDIAN(p.flux_a) END AS median FROM c JOIN prod p
   ON p.group_name = c.group_name AND p.rssi BETWEEN centre - 0.083 AND centre + 0.083 GROUP BY 1, 2)"""


def _bins(t):
    return lags.sliding_bin_median(t.products(), ["group_name"], "rssi", "flux_a", 0.166, 0.07, 30)


@check("f26_sliding_signal_bins", "group_name bin n", "centre median", f"{_BIN} SELECT group_name, bin, n, centre, median FROM m")
def _(t):
    return _bins(t)


@check("f27_highest_failing_bin", "group_name", "threshold",
       f"{_BIN} SELECT group_name, MAX(centre) FILTER (median < 100 AND n >= 30) AS threshold FROM m GROUP BY 1")
def _(t):
    return lags.highest_failing_bin(_bins(t), ["group_name"], 100.0, 30)
