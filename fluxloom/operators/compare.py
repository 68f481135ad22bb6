"""Agreement, closure, coverage and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timecodes import period_end
from .quantiles import exact_quantiles


def agreement(df: DataFrame, keys, a: str, b: str, ok_rel: float = 0.01, warn_rel: float = 0.05) -> DataFrame:
    """Counts, missing mismatches, bias, RMSE, absolute errors with quantiles, R2 and a status class of b against a."""
    keys = list(keys)
    if not keys:
        return agreement(df.withColumn("_all", F.lit(1)), ["_all"], a, b, ok_rel, warn_rel).drop("_all")
    x, y = F.col(a), F.col(b)
    err = F.when(x.isNotNull() & y.isNotNull(), y - x)
    d = df.withColumn("_e", err).withColumn("_ae", F.abs("_e"))
    base = F.when(F.col("_e").isNotNull(), x)
    g = d.groupBy(*keys).agg(
        F.count("_e").alias("n"), F.count(F.when(x.isNull() != y.isNull(), 1)).alias("missing_mismatch"), F.avg("_e").alias("bias"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_ae").alias("mean_abs"), F.max("_ae").alias("max_abs"),
        F.avg(F.abs(base)).alias("_scale"), F.var_pop(base).alias("_var"), F.avg(F.col("_e") * F.col("_e")).alias("_mse"))
    q = exact_quantiles(d, keys, "_ae", {"p95_abs": 0.95, "p99_abs": 0.99})
    rel = F.try_divide("mean_abs", "_scale")
    status = F.when(rel <= ok_rel, "ok").when(rel <= warn_rel, "close").otherwise("differs")
    return g.join(q, keys, "left").select(*keys, "n", "missing_mismatch", "bias", "rmse", "mean_abs", "max_abs", "p95_abs", "p99_abs", rel.alias("relative"),
                      (1.0 - F.try_divide("_mse", "_var")).alias("r2"), status.alias("status"))


def regression(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Slope, intercept, r2, bias, RMSE and the share of equal signs of y on x."""
    e = F.col(y) - F.col(x)
    return df.groupBy(*keys).agg(
        F.count(e).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement"))


def energy_closure(df: DataFrame, keys, available: dict[str, Column], turbulent: dict[str, Column], day: Column) -> DataFrame:
    """Sum ratio, regression, slope through the origin and mean residual per definition, for all, day and night."""
    defs = F.array(*[F.struct(F.lit(f"{t}/{a}").alias("definition"), tc.alias("t"), ac.alias("a"))
                     for t, tc in turbulent.items() for a, ac in available.items()])
    rows = df.select(*keys, F.when(day, "day").otherwise("night").alias("_half"), F.explode(defs).alias("_d"))
    rows = rows.select(*keys, F.explode(F.array(F.lit("all"), F.col("_half"))).alias("part"), "_d.definition", "_d.t", "_d.a")
    rows = rows.filter(F.col("t").isNotNull() & F.col("a").isNotNull())
    return rows.groupBy(*keys, "part", "definition").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("t"), F.sum("a")).alias("ratio"), F.regr_slope("t", "a").alias("slope"),
        F.regr_intercept("t", "a").alias("intercept"), F.try_divide(F.sum(F.col("t") * F.col("a")), F.sum(F.col("a") * F.col("a"))).alias("slope_origin"),
        F.avg(F.col("a") - F.col("t")).alias("residual"))


def diurnal_composite(df: DataFrame, keys, us: str, cols) -> DataFrame:
    """Mean by hour of day (fractional hours of the period stamps)."""
    hour = F.pmod(F.col(us), F.lit(86_400_000_000)) / 3.6e9
    return df.groupBy(*keys, hour.alias("hour")).agg(*[F.avg(c).alias(c) for c in cols])


def coverage_report(df: DataFrame, cols) -> DataFrame:
    """Share of non-missing values per variable."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in cols])
    return counts.select("_n", F.explode(cells).alias("_c")).select(
        "_c.variable", F.col("_c.n").alias("n_valid"), F.try_divide("_c.n", "_n").alias("share"))


def resample(df: DataFrame, keys, us: str, period_us: int, cols) -> DataFrame:
    """Mean per right-closed, right-labelled period."""
    return df.groupBy(*keys, period_end(F.col(us), period_us).alias("period_us")).agg(*[F.avg(c).alias(c) for c in cols])


def first_of_each(df: DataFrame, keys, order, payload) -> DataFrame:
    """Keep first by *order* among equal keys: an aggregate, so a heavily repeated key combines early."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def last_of_each(df: DataFrame, keys, order, payload) -> DataFrame:
    """Keep last by *order* among equal keys: the later file wins."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def height_rank(df: DataFrame, site, height: str = "height") -> DataFrame:
    """Add ``v``: rank of the height at its site, 1 lowest; the ranks come from the small height dimension."""
    site = list(site)
    dim = df.select(*site, height).distinct()
    dim = dim.withColumn("v", F.dense_rank().over(W.partitionBy(*site).orderBy(height)))
    return df.join(dim, [*site, height])


def union_by_name(frames: list[DataFrame], types: dict[str, str] | None = None) -> DataFrame:
    """Union of columns with missing ones NULL; a column of clashing types is rejected."""
    seen: dict[str, str] = {}
    for df in frames:
        for f in df.schema.fields:
            have = seen.setdefault(f.name, f.dataType.simpleString())
            if have != f.dataType.simpleString():
                raise ValueError(f"column {f.name!r} is {have} and {f.dataType.simpleString()}")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def key_difference(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys present on one side only."""
    l, r = a.select(*keys).distinct(), b.select(*keys).distinct()
    return l.exceptAll(r).withColumn("side", F.lit("before")).unionByName(r.exceptAll(l).withColumn("side", F.lit("after")))


def select_units(df: DataFrame, unit: str, first: int | None = None, listed=None) -> DataFrame:
    """The feature selection of files, days or records: the first *n* units in order, or a listed set (1-based)."""
    units = df.select(unit).distinct()
    if listed is not None:
        return df.filter(F.col(unit).isin(*listed))
    # top-n of the distinct units: a bounded sort, then a semi join on the chosen ones
    return df.join(units.orderBy(unit).limit(first), unit, "left_semi")
