"""Lagged covariances, structure functions and what follows from them, on packed windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .kernels import covariance_error, lag_covariances_by_block, map_windows, masked_lag_sums, structure_function
from .windows import array_mean


def lag_pairs(x: Column, y: Column, lag: int) -> Column:
    """Array of structs (a, b) of x(i) and y(i+lag)."""
    if lag >= 0:
        a, b = F.slice(x, F.lit(1), F.greatest(F.size(x) - lag, F.lit(0))), F.slice(y, F.lit(1 + lag), F.greatest(F.size(y) - lag, F.lit(0)))
    else:
        a, b = F.slice(x, F.lit(1 - lag), F.greatest(F.size(x) + lag, F.lit(0))), F.slice(y, F.lit(1), F.greatest(F.size(y) + lag, F.lit(0)))
    return F.zip_with(a, b, lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def lagged_covariances(df: DataFrame, keys, x: str, y: str, max_lag: int) -> DataFrame:
    """Covariance of x(i) with y(i+k) about the means of the valid pairs, |k| <= max_lag.

    Narrow lag ranges: the pairs of every lag are exploded as rows and reduced
    map-side. Missing samples drop their pairs.
    """
    lags = [F.struct(F.lit(k).alias("lag"), lag_pairs(F.col(x), F.col(y), k).alias("pairs")) for k in range(-max_lag, max_lag + 1)]
    rows = df.select(*keys, F.explode(F.array(*lags)).alias("_l")).select(
        *keys, F.col("_l.lag").alias("lag"), F.explode("_l.pairs").alias("_p"))
    a, b = F.col("_p.a"), F.col("_p.b")
    return rows.groupBy(*keys, "lag").agg(F.covar_pop(a, b).alias("cov"), F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"))


def lagged_covariances_wide(df: DataFrame, keys, x: str, y: str, max_lag: int) -> DataFrame:
    """The same for wide lag ranges: one Fourier pass per window instead of one row per pair."""
    sums = map_windows(df, keys, [x, y], lambda a, b: masked_lag_sums(a, b, max_lag),
                       "lag int, n double, sx double, sy double, sxy double", gaps=True, keep=False)
    n = F.col("n")
    return sums.filter(n > 0).select(*keys, "lag", (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n).alias("cov"), n.cast("long").alias("n"))


def peak_lag(cov: DataFrame, keys) -> DataFrame:
    """Lag of the largest |cov| (the earliest on a tie) and its ratio to the rms of the outer third."""
    keys = list(keys)
    widest = F.max(F.abs("lag")).over(W.partitionBy(*keys))
    tagged = cov.withColumn("_outer", F.abs("lag") > 2.0 / 3.0 * widest)
    g = tagged.groupBy(*keys).agg(
        F.max_by(F.struct("lag", "cov"), F.struct(F.abs("cov"), -F.col("lag"))).alias("_p"),
        F.sqrt(F.avg(F.when(F.col("_outer"), F.col("cov") * F.col("cov")))).alias("_bg"))
    return g.select(*keys, F.col("_p.lag").alias("lag"), F.try_divide(F.abs("_p.cov"), F.col("_bg")).alias("ratio"))


def block_covariances(df: DataFrame, keys, x: str, y: str, max_lag: int, blocks: int) -> DataFrame:
    """Covariance by lag of the whole window (block 0) and of its *blocks* equal parts (from 1), each about its own means.

    The parts serve steady-state tests at the lag of the peak. A pair belongs to the part of its x sample; lags without a
    valid pair have no covariance. One transform per part, whatever the number of lags.
    """
    rows = map_windows(df, keys, [x, y], lambda a, b: lag_covariances_by_block(a, b, max_lag, blocks), "block int, lag int, n double, cov double",
                       gaps=True, keep=False)
    return rows.select(*keys, "block", "lag", F.col("n").cast("long").alias("n"), "cov")


def structure_functions(df: DataFrame, keys, x: str, lags, orders=(2, 3, 5)) -> DataFrame:
    """Mean of (x(i) - x(i-j))^n per lag; pairs with a missing sample are skipped.

    Sums over lags come from transforms of the powers of the window, not from rows per pair. Lags beyond the window have
    no value.
    """
    at, orders = np.array(list(lags), dtype=int), tuple(orders)
    schema = "lag int, " + ", ".join(f"s{n} double" for n in orders)
    return map_windows(df, keys, [x], lambda a: structure_function(a, at, orders), schema, gaps=True, keep=False)


def dissipation_rate(sf: DataFrame, keys, mean_speed: Column, dt: float, lo: float = 0.1, hi: float = 2.0, c2: float = 2.0) -> DataFrame:
    """(mean compensated structure function)^1.5 over the lags in the window, at least three."""
    tau = F.col("lag") * dt
    comp = F.try_divide(F.col("s2"), c2 * F.pow(mean_speed * tau, F.lit(2.0 / 3.0)))
    use = tau.between(lo, hi) & (mean_speed > 0) & (comp > 0)
    g = sf.withColumn("_c", F.when(use, comp)).groupBy(*keys).agg(F.avg("_c").alias("_m"), F.count("_c").alias("_k"))
    return g.select(*keys, F.when(F.col("_k") >= 3, F.pow("_m", F.lit(1.5))).alias("epsilon"))


def covariance_random_error(df: DataFrame, keys, w: str, c: str, max_lag: int, min_samples: int = 1000) -> DataFrame:
    """Sampling error of a covariance from the biased auto- and cross-covariances out to *max_lag*.

    *w* and *c* are anomalies with zeros in place of missing samples. A window
    that is too short keeps its row without an error.
    """
    def kernel(a, b):
        long_enough = len(a) >= min_samples and len(a) // 2 - 1 >= max_lag
        return {"error": np.array([covariance_error(a, b, max_lag) if long_enough else np.nan])}

    return map_windows(df, keys, [w, c], kernel, "error double")


def lagged_covariances_sums(df: DataFrame, keys, x: str, y: str, max_lag: int) -> DataFrame:
    return map_windows(df, keys, [x, y], lambda a, b: masked_lag_sums(a, b, max_lag), "lag int, n double, sx double, sy double, sxy double", keep=False)


def noise_variance(df: DataFrame, keys, x: str, fs: float, lo: int, hi: int, min_samples: int = 1000, exponent: float = 2.0 / 3.0) -> DataFrame:
    """White-noise variance: lag-zero autocovariance minus the line in tau^(2/3) extrapolated to zero.

    A window with too few samples keeps its row with missing values.
    """
    valid = F.size(F.filter(x, lambda a: a.isNotNull()))
    z = df.filter((valid >= min_samples) & (F.floor(F.size(x) / 2) > hi)).withColumn("_m", array_mean(F.col(x))).select(
        *keys, valid.alias("_k"), F.transform(x, lambda a: F.coalesce(a - F.col("_m"), F.lit(0.0))).alias("_z"))
    acov = lagged_covariances_sums(z, [*keys, "_k"], "_z", "_z", hi).filter("lag >= 0").withColumn("_c", F.col("sxy") / F.col("_k"))
    fit = F.col("lag").between(lo, hi)
    tau = F.when(fit, F.pow(F.col("lag") / fs, F.lit(exponent)))
    g = acov.groupBy(*keys).agg(F.max(F.when(F.col("lag") == 0, F.col("_c"))).alias("total_var"),
                                F.regr_intercept(F.when(fit, F.col("_c")), tau).alias("_signal"))
    found = g.select(*keys, F.when(F.col("_signal").isNotNull(), F.greatest(F.col("total_var") - F.col("_signal"), F.lit(0.0))).alias("noise_var"), "total_var")
    return df.select(*keys).join(found, list(keys), "left")


def bounded_correlation_peak(df: DataFrame, keys, x: str, y: str, max_lag: int) -> DataFrame:
    """Largest normalized correlation of x(i) with y(i+k) within the bound; the earliest lag on a tie."""
    std = lambda c, m: F.sqrt(array_mean(F.transform(c, lambda a: (a - m) * (a - m))))
    z = df.withColumns({"_mx": array_mean(F.col(x)), "_my": array_mean(F.col(y))})
    z = z.withColumns({"_sx": std(x, F.col("_mx")), "_sy": std(y, F.col("_my"))})
    z = z.select(*keys, F.size(x).alias("_n"), F.transform(x, lambda a: (a - F.col("_mx")) / F.col("_sx")).alias("_zx"),
                 F.transform(y, lambda a: (a - F.col("_my")) / F.col("_sy")).alias("_zy"))
    r = lagged_covariances_sums(z, [*keys, "_n"], "_zx", "_zy", max_lag).withColumn("_r", F.col("sxy") / F.col("_n"))
    g = r.groupBy(*keys).agg(F.max_by(F.struct("lag", "_r"), F.struct("_r", -F.col("lag"))).alias("_p"))
    return g.select(*keys, F.col("_p.lag").alias("lag"), F.col("_p._r").alias("r"))


def sliding_bin_median(df: DataFrame, keys, x: str, y: str, width: float, step: float, min_n: int) -> DataFrame:
    """Median and count of *y* in overlapping closed bins of *x*, centres from min to max in steps.

    Each row is sent only to the bins that hold it, at most width/step + 1.
    """
    from .quantiles import exact_quantiles

    keys = list(keys)
    if not keys:
        return sliding_bin_median(df.withColumn("_all", F.lit(1)), ["_all"], x, y, width, step, min_n).drop("_all")
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = ok.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n)
    j = ok.join(span, keys)
    pos = (F.col(x) - F.col("_lo")) / step
    reach = width / 2 / step
    first, last = F.greatest(F.ceil(pos - reach - 1e-9), F.lit(0)), F.least(F.floor(pos + reach + 1e-9), F.ceil((F.col("_hi") - F.col("_lo")) / step))
    rows = j.filter(last >= first).withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("centre", F.col("_lo") + F.col("bin") * step)
    rows = rows.filter((F.col(x) >= F.col("centre") - width / 2) & (F.col(x) <= F.col("centre") + width / 2))
    n = rows.groupBy(*keys, "bin").agg(F.max("centre").alias("centre"), F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(rows, [*keys, "bin"], y, {"median": 0.5})
    return n.join(med, [*keys, "bin"]).select(*keys, "bin", "centre", "n",
                                             F.when(F.col("n") >= min_n, F.col("median")).alias("median"))


def highest_failing_bin(bins: DataFrame, keys, limit: float, min_n: int) -> DataFrame:
    """Largest centre of a populated bin whose statistic lies below the limit; missing when none fails."""
    return bins.groupBy(*keys).agg(F.max(F.when((F.col("median") < limit) & (F.col("n") >= min_n), F.col("centre"))).alias("threshold"))
