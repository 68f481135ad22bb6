"""High-frequency store: samples by site and date, a manifest row per window, scalars at heights of their own.

The manifest tells how many samples a window holds, so whole windows are chosen from it without a count over the samples,
and it carries the period's products and flags. Site, date and record filters reach the scan of the samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS, WINDOW = ["site", "height"], ["site", "height", "period_us"]
#: A scalar sensor this far from a sonic still belongs to it, in m.
TOLERANCE = 0.5


def _date(period: Column) -> Column:
    return F.to_date(F.timestamp_micros(period - 1))


def _replace(df: DataFrame, path: str) -> None:
    """Write by site and date; only the dates written are replaced."""
    dated = df.withColumn("date", _date(F.col("period_us")))
    dated.hint("rebalance", "site", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "date").parquet(path)


def with_primes(samples: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_prime``: the deviation from the window's mean."""
    means = samples.groupBy(*WINDOW).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = samples.join(means, WINDOW)
    return out.withColumns({f"{c}_prime": F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def window_flags(flags: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per window one flag per name: any of its columns set; NULL where none of them is known."""
    any_of = lambda cols: F.greatest(*[F.col(c).cast("int") for c in cols]) if len(cols) > 1 else F.col(cols[0]).cast("int")
    return flags.groupBy(*WINDOW).agg(*[F.max(any_of(list(cols))).alias(name) for name, cols in names.items()])


def write_hf(samples: DataFrame, root: str, cols: Sequence[str], expected: int, periods: DataFrame | None = None, primes: Sequence[str] = (),
             scalars: Mapping[str, DataFrame] | None = None, double: bool = False) -> None:
    """Samples of (site, height, us, period_us, *cols*) in single precision (*double*: in double), and their manifest.

    *periods* holds products and flags by window for the manifest. *primes* names columns whose deviations are stored too.
    *scalars* maps a name to rows (site, height, us, period_us, name) at the sensor's own heights. A window is whole with
    *expected* samples or more. Dates that are written again are replaced, others stay.
    """
    kind = "double" if double else "float"
    rows = with_primes(samples, primes) if primes else samples
    stored = [*cols, *[f"{c}_prime" for c in primes]]
    _replace(rows.select(*WINDOW, "us", *[F.col(c).cast(kind).alias(c) for c in stored]), f"{root}/samples")
    manifest = samples.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                                            *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in cols])
    manifest = manifest.withColumn("whole", F.col("n") >= expected)
    _replace(manifest.join(periods, WINDOW, "left") if periods is not None else manifest, f"{root}/manifest")
    for name, rows in (scalars or {}).items():
        _replace(rows.select(*WINDOW, "us", F.col(name).cast(kind).alias(name)), f"{root}/scalars/{name}")


def _chosen(df: DataFrame, sites, first_date, last_date, records) -> DataFrame:
    """Filters on stored columns, which the scan takes."""
    if sites is not None:
        df = df.filter(F.col("site").isin(*sites))
    if first_date is not None:
        df = df.filter(F.col("date") >= F.lit(first_date).cast("date"))
    if last_date is not None:
        df = df.filter(F.col("date") <= F.lit(last_date).cast("date"))
    return df if records is None else df.filter(F.col("period_us").isin(*records))


def height_map(sonics: DataFrame, sensors: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(site, height, sensor_height): the sensor nearest to each sonic, the lower of two equally near ones.

    One beyond *tolerance* does not count, unless it is the site's only sensor. Both sides are tables of levels.
    """
    near = sensors.select("site", F.col("height").alias("_z")).distinct()
    alone = near.groupBy("site").agg(F.count(F.lit(1)).alias("_sensors"))
    off = F.abs(F.col("_z") - F.col("height"))
    best = sonics.select("site", "height").distinct().join(near, "site").groupBy("site", "height").agg(F.min(F.struct(off.alias("off"), "_z")).alias("_b"))
    return best.join(alone, "site").filter((F.col("_b.off") <= tolerance) | (F.col("_sensors") == 1)).select("site", "height", F.col("_b._z").alias("sensor_height"))


def read_manifest(spark: SparkSession, root: str, sites=None, first_date=None, last_date=None, records=None) -> DataFrame:
    """Windows with their sample counts, missing shares, products and flags."""
    return _chosen(spark.read.option("mergeSchema", True).parquet(f"{root}/manifest"), sites, first_date, last_date, records)


def read_windows(spark: SparkSession, root: str, variables: Sequence[str], scalars: Sequence[str] = (), ancillaries: Sequence[str] = (), sites=None,
                 first_date=None, last_date=None, records=None, tolerance: float = TOLERANCE) -> DataFrame:
    """Samples of whole windows: *variables*, *scalars* of the sensor that belongs to the sonic (with ``<name>_height``), *ancillaries*.

    Which windows are whole is read from the manifest. A sonic without a sensor in reach has a missing scalar.
    """
    manifest = read_manifest(spark, root, sites, first_date, last_date, records)
    whole = manifest.filter("whole").select(*WINDOW, "date", *ancillaries)
    rows = _chosen(spark.read.option("mergeSchema", True).parquet(f"{root}/samples"), sites, first_date, last_date, records)
    out = rows.select(*WINDOW, "date", "us", *variables).join(whole, [*WINDOW, "date"])
    for name in scalars:
        sensor = _chosen(spark.read.option("mergeSchema", True).parquet(f"{root}/scalars/{name}"), sites, first_date, last_date, records)
        levels = height_map(manifest, sensor, tolerance).withColumnRenamed("sensor_height", f"{name}_height")
        values = sensor.select("site", F.col("height").alias(f"{name}_height"), "us", name)
        out = out.join(levels, KEYS, "left").join(values, ["site", f"{name}_height", "us"], "left")
    return out.select(*WINDOW, "us", *variables, *[c for name in scalars for c in (name, f"{name}_height")], *ancillaries)
