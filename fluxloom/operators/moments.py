"""Moments of detrended series.

Second-order statistics need no second pass over the samples: the covariance
of two detrended series follows from built-in aggregates that combine before
the shuffle. Third-order and sign-conditional statistics need the primes, so
their period statistics are joined back to the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _both(x: Column, *others: Column) -> Column:
    ok = x.isNotNull()
    for o in others:
        ok = ok & o.isNotNull()
    return ok


def detrended_covariances(df: DataFrame, keys, pairs: dict[str, tuple[str, str]],
                          order: str = "constant", t: str | None = None) -> DataFrame:
    """Mean product of detrended series per key, one partial-aggregating pass.

    Each series is detrended over its own valid samples and the product is
    averaged over samples valid in both. *order* is ``constant`` or
    ``linear``; linear needs the regressor column *t*.
    """
    names = sorted({c for p in pairs.values() for c in p})
    aggs = []
    for c in names:
        if order == "linear":
            aggs += [F.regr_slope(F.col(c), F.col(t)).alias(f"_b_{c}"),
                     F.regr_intercept(F.col(c), F.col(t)).alias(f"_a_{c}")]
        aggs.append(F.avg(c).alias(f"_m_{c}"))
    for name, (x, y) in pairs.items():
        cx, cy = F.col(x), F.col(y)
        ok = _both(cx, cy)
        aggs += [F.covar_pop(cx, cy).alias(f"_c_{name}"), F.avg(F.when(ok, cx)).alias(f"_x_{name}"),
                 F.avg(F.when(ok, cy)).alias(f"_y_{name}")]
        if order == "linear":
            ct = F.when(ok, F.col(t))
            aggs += [F.covar_pop(cx, ct).alias(f"_xt_{name}"), F.covar_pop(cy, ct).alias(f"_yt_{name}"),
                     F.var_pop(ct).alias(f"_tt_{name}"), F.avg(ct).alias(f"_t_{name}")]
    g = df.groupBy(*keys).agg(*aggs)
    out = []
    for name, (x, y) in pairs.items():
        c = F.col
        if order == "linear":
            bx, by = c(f"_b_{x}"), c(f"_b_{y}")
            core = (c(f"_c_{name}") - by * c(f"_xt_{name}") - bx * c(f"_yt_{name}")
                    + bx * by * c(f"_tt_{name}"))
            dx = c(f"_x_{name}") - c(f"_a_{x}") - bx * c(f"_t_{name}")
            dy = c(f"_y_{name}") - c(f"_a_{y}") - by * c(f"_t_{name}")
        else:
            core = c(f"_c_{name}")
            dx, dy = c(f"_x_{name}") - c(f"_m_{x}"), c(f"_y_{name}") - c(f"_m_{y}")
        out.append((core + dx * dy).alias(name))
    return g.select(*keys, *out)


def trend(df: DataFrame, keys, cols, order: str = "constant", t: str | None = None) -> DataFrame:
    """Per-key trend of each column: ``a_<c>`` (and ``b_<c>`` for linear); NULL above 90 % missing."""
    aggs = []
    for c in cols:
        enough = F.count(c) >= 0.1 * F.count(F.lit(1))
        if order == "linear":
            aggs += [F.when(enough, F.regr_intercept(F.col(c), F.col(t))).alias(f"a_{c}"),
                     F.when(enough, F.regr_slope(F.col(c), F.col(t))).alias(f"b_{c}")]
        else:
            aggs.append(F.when(enough, F.avg(c)).alias(f"a_{c}"))
    return df.groupBy(*keys).agg(*aggs)


def detrend(df: DataFrame, keys, cols, order: str = "constant", t: str | None = None,
            suffix: str = "_p") -> DataFrame:
    """Add the detrended series ``<c>_p`` of each column.

    The trend table is an aggregate joined back on the keys, not a window, so
    a hot key is split by the skew join instead of landing in one task.
    """
    stats = trend(df, keys, cols, order, t)
    joined = df.join(stats, list(keys))
    for c in cols:
        fit = F.col(f"a_{c}")
        if order == "linear":
            fit = fit + F.col(f"b_{c}") * F.col(t)
        joined = joined.withColumn(c + suffix, F.col(c) - fit)
    drop = [f"a_{c}" for c in cols] + ([f"b_{c}" for c in cols] if order == "linear" else [])
    return joined.drop(*drop)


def detrend_piecewise(df: DataFrame, keys, cols, t: str, breaks: list[float]) -> DataFrame:
    """Linear detrend by segments of *t* delimited by *breaks*, each segment fitted on its own."""
    seg = F.lit(0)
    for b in breaks:
        seg = seg + (F.col(t) >= b).cast("int")
    return detrend(df.withColumn("segment", seg), [*keys, "segment"], cols, "linear", t)


def corrected_skewness(x: Column) -> Column:
    """Bias-corrected skewness; NULL below three samples or at zero variance."""
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_pop(x) > 0),
                  F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def transport_efficiency(w: Column, c: Column, prefix: str) -> list[Column]:
    """Aggregates that :func:`efficiency_columns` turns into efficiency, flux and time asymmetry."""
    p = w * c
    out = [F.sum(p).alias(f"{prefix}_sum"), F.count(p).alias(f"{prefix}_n")]
    for sign, cond in (("pos", p > 0), ("neg", p < 0)):
        for side, wc in (("up", w > 0), ("dn", w < 0)):
            out += [F.sum(F.when(cond & wc, p)).alias(f"{prefix}_{sign}_{side}"),
                    F.count(F.when(cond & wc, p)).alias(f"{prefix}_k{sign}_{side}")]
    return out


def efficiency_columns(prefix: str) -> dict[str, Column]:
    """eta, delta_flux and delta_time from the aggregates of :func:`transport_efficiency`."""
    c = lambda s: F.coalesce(F.col(f"{prefix}_{s}"), F.lit(0.0))
    total, n = F.col(f"{prefix}_sum"), F.col(f"{prefix}_n")
    pick = lambda a, b: F.when(total > 0, a).when(total < 0, b)
    up, dn = pick(c("pos_up"), c("neg_up")), pick(c("pos_dn"), c("neg_dn"))
    kup, kdn = pick(c("kpos_up"), c("kneg_up")), pick(c("kpos_dn"), c("kneg_dn"))
    return {
        "eta": F.when(up + dn != 0, total / (up + dn)),
        "delta_flux": up / total - dn / total,
        "delta_time": kup / n - kdn / n,
    }
