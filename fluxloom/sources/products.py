"""Run products: partitioned tables, high-frequency product, CSV and network exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import thermo
from ..operators import joins
from ..operators.compare import height_rank

DAY_US = 86_400_000_000


def write_run(groups: dict[str, DataFrame], root: str, period: str = "period_us") -> None:
    """One table per product group, partitioned by site and date; only the written partitions are replaced."""
    for name, df in groups.items():
        date = F.to_date(F.timestamp_micros(F.col(period) - 1))
        (df.withColumn("date", date).repartition("site", "date").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("site", "date").parquet(f"{root}/{name}"))


def read_run(spark: SparkSession, root: str, group: str, sites=None, first_date=None, last_date=None) -> DataFrame:
    """A product group; site and date prune partitions."""
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/{group}")
    if sites is not None:
        df = df.filter(F.col("site").isin(*sites))
    if first_date is not None:
        df = df.filter(F.col("date") >= F.lit(first_date).cast("date"))
    if last_date is not None:
        df = df.filter(F.col("date") <= F.lit(last_date).cast("date"))
    return df


def write_products(df: DataFrame, root: str, avg_min: int, fit: str, detrend: str) -> None:
    """Products of one configuration under its qualifier partitions."""
    out = df.withColumns({"avg_min": F.lit(avg_min), "fit": F.lit(fit), "detrend": F.lit(detrend)})
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("avg_min", "fit", "detrend").parquet(root))


def read_products(spark: SparkSession, root: str, avg_min: int, fit: str | None = None, detrend: str | None = None) -> DataFrame:
    """Products by averaging period and qualifier; columns of all files are united by name."""
    df = spark.read.option("mergeSchema", True).parquet(root).filter(F.col("avg_min") == avg_min)
    if fit is not None:
        df = df.filter(F.col("fit") == fit)
    if detrend is not None:
        df = df.filter(F.col("detrend") == detrend)
    return df


def hf_product(samples: DataFrame, periods: DataFrame, pressure: DataFrame, keys, us: str, chunk: int, cols) -> DataFrame:
    """Samples in single precision with interpolated pressure and the values of their period."""
    keys = list(keys)
    p = joins.bracketed(samples, pressure, keys, us, ["p_kpa"], chunk)
    p = p.withColumn("pressure", joins.linear_value("p_kpa", us)).drop("before_p_kpa", "after_p_kpa")
    single = [F.col(c).cast("float").alias(c) for c in cols]
    rest = [c for c in periods.columns if c not in (*keys, "period_us")]
    return p.join(periods, [*keys, "period_us"], "left").select(*keys, us, "period_us", *single, F.col("pressure").cast("float").alias("pressure"), *rest)


def hf_windows(hf: DataFrame, keys, period: str, variables, expected: int, records=None) -> DataFrame:
    """The chosen variables and records of whole windows; a window short of samples is skipped."""
    keys = list(keys)
    df = hf.select(*keys, period, "us", *variables)
    if records is not None:
        df = df.join(records, period, "left_semi")
    whole = df.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= expected).drop("_n")
    return df.join(whole, [*keys, period], "left_semi")


def wide_columns(levels: DataFrame, keys, heights: list[float], fields: list[str]) -> DataFrame:
    from .catalogue import to_wide

    return to_wide(levels, keys, heights, fields)


def non_empty_columns(df: DataFrame, keys) -> list[str]:
    """Columns that hold at least one value: one row of counts reaches the driver."""
    cols = [c for c in df.columns if c not in keys]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c] > 0]


def write_wide_csv(levels: DataFrame, keys, heights, fields, path: str) -> None:
    """Wide CSV of one group, ``<name>_<height>`` columns, empty ones dropped."""
    wide = wide_columns(levels, keys, heights, fields)
    wide.select(*keys, *[F.col(f"`{c}`") for c in non_empty_columns(wide, keys)]).write.mode("overwrite").option("header", True).csv(path)


def _stamp(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyyMMddHHmm")


def network_table(products: DataFrame, period_us: int) -> DataFrame:
    """Half-hourly network rows per site and height rank: regular grid, unit conversions, fallbacks.

    Long form (one row per site, period and rank); missing periods are rows of
    missing values. *products* holds the flux-job columns.
    """
    c = F.col
    keyed = height_rank(products.withColumnRenamed("period_us", "us"), ["site"])
    spans = keyed.groupBy("site").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = joins.grid_stamps(spans, ["site"], "lo", "hi", period_us)
    ranks = keyed.select("site", "v", "height").distinct()
    full = grid.join(ranks, "site").join(keyed, ["site", "us", "v", "height"], "left")
    # a fallback serves products that lack the column, not periods where it is missing
    has = lambda name, other: c(name) if name in products.columns else other
    heat = has("H_pf", c("rho_air") * c("cp_air") * c("w_t_air_cov_pf"))
    latent = has("LE_wpl_pf", c("Lv") * 1000.0 * c("w_q_wpl_cov_pf"))
    ustar = has("ustar_pf", F.sqrt(F.abs("Tau_pf")) * F.signum("Tau_pf"))
    return full.select(
        "site", "v", _stamp(c("us") - period_us).alias("TIMESTAMP_START"), _stamp(c("us")).alias("TIMESTAMP_END"),
        heat.alias("H"), latent.alias("LE"), (c("Fc_wpl_pf") / (thermo.M_CO2 / 1000.0) * 1e6).alias("FC"), ustar.alias("USTAR"),
        (c("rho_air") * c("Tau_pf")).alias("TAU"), c("direction").alias("WD"), c("L").alias("MO_LENGTH"),
        F.try_divide("height", "L").alias("ZL"), c("TKE"), c("u_sigma_pf").alias("U_SIGMA"), c("v_sigma_pf").alias("V_SIGMA"),
        c("w_sigma_pf").alias("W_SIGMA"), c("ts_sigma").alias("T_SONIC_SIGMA"), (c("w_q_wpl_cov_pf") * 1e6 / thermo.M_VAPOUR).alias("FH2O"),
        c("co2_mole_fraction").alias("CO2"), *[c(f"{k}_ssitc").alias(f"{n}_SSITC_TEST") for k, n in (("Tau", "TAU"), ("H", "H"), ("LE", "LE"), ("Fc", "FC"))])


def network_columns(rows: DataFrame, variables, ranks: list[int]) -> DataFrame:
    """Wide network table ``<VAR>_1_<V>_1`` with -9999 for missing and six decimals."""
    cells = [F.round(F.coalesce(F.max(F.when(F.col("v") == v, F.col(x).cast("double"))), F.lit(-9999.0)), 6).alias(f"{x}_1_{v}_1")
             for v in ranks for x in variables]
    return rows.groupBy("site", "TIMESTAMP_START", "TIMESTAMP_END").agg(*cells)


def hf_export_rows(samples: DataFrame, cols, period_us: int, expected: int) -> DataFrame:
    """Rows of the per-period export: centisecond stamp text, -9999 for missing, short blocks dropped."""
    block = F.col("us") - F.pmod(F.col("us") - 1, F.lit(period_us)) - 1
    text = F.concat(F.date_format(F.timestamp_micros("us"), "yyyyMMddHHmmss"), F.lit("."),
                    F.lpad(F.floor(F.pmod("us", F.lit(1_000_000)) / 10_000).cast("string"), 2, "0"))
    rows = samples.withColumns({"block": _stamp(block), "TIMESTAMP": text})
    n = rows.groupBy("site", "height", "block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= expected).drop("_n")
    return rows.join(n, ["site", "height", "block"], "left_semi").select(
        "site", "height", "block", "TIMESTAMP", *[F.coalesce(F.round(F.col(c).cast("double"), 6), F.lit(-9999.0)).alias(c) for c in cols])


def write_hf_export(rows: DataFrame, path: str) -> None:
    rows.repartition("site", "block").write.mode("overwrite").option("header", True).partitionBy("site", "block").csv(path)


def grid_table(samples: DataFrame, keys, us: str, step_us: int, window_us: int) -> DataFrame:
    """Gap-exposing grid of each series split into fixed windows, with date-vector columns."""
    from ..functions.timecodes import to_date_vector

    full = joins.complete_grid(samples, keys, us, step_us)
    dv = to_date_vector(F.col(us))
    return full.select("*", F.expr(f"{us} div {window_us}L").alias("span"), *[x.alias(n) for n, x in dv.items()])


def write_grid_table(grid: DataFrame, path: str) -> None:
    grid.repartition("site", "span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "span").parquet(path)


FIT_SCHEMA = ("site string, height double, date_start date, date_end date, sector_lo double, sector_hi double, b0 double, b1 double, b2 double")


def save_fits(fits: DataFrame, path: str) -> None:
    """Fit records as JSON lines."""
    fits.write.mode("overwrite").json(path)


def load_fits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIT_SCHEMA).json(path)


def fits_or_compute(spark: SparkSession, path: str, compute, recalculate: bool) -> DataFrame:
    """Stored records, unless there are none or they are to be recalculated."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if recalculate or not exists:
        save_fits(compute(), path)
    return load_fits(spark, path)
