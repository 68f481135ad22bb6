"""Stages with a commit per unit (a site and date): bad input becomes a status with a message, finished units are not redone.

All units of a stage run in one job. A stage's checks name units with a problem before its work begins; those stop there
and the others go on. Each stage writes a table partitioned by unit and then a status row per unit. A run that ends early
is simply started again: units whose stage is committed are read from its table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators import motion
from ..sources import catalogue
from .flux_job import FluxOptions, flux_job
from .pipeline import condition

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Stage:
    """*work* maps the rows of many units to rows with the same key columns; *problems* gives (keys, message) of bad units."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    problems: Callable[[DataFrame], DataFrame] | None = None


def _status(spark, store: str, stage: str, schema: StructType) -> DataFrame:
    """Status rows of earlier runs; none before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/status/{stage}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{store}/status/{stage}") if there else spark.createDataFrame([], schema)


def run_stages(source: DataFrame, keys: Sequence[str], stages: Sequence[Stage], store: str, expected: DataFrame | None = None) -> DataFrame:
    """Latest status per unit: (keys, stage, status, message, n_rows), status ``ok``, ``empty``, ``error`` or ``missing``.

    *expected* lists units that should occur; one without rows is missing. A unit stops at the first stage at which it is
    not ok; a later run takes it up there again. Keys are never NULL.
    """
    spark, keys, rows = source.sparkSession, list(keys), source
    key_types = StructType([source.schema[k] for k in keys])
    schema = StructType(list(key_types.fields)).add("stage", "string").add("status", "string").add("message", "string").add("n_rows", "long").add("run", "long")
    run, reports = None, []
    for k, stage in enumerate(stages):
        past = _status(spark, store, stage.name, schema)
        if run is None:
            run = (past.agg(F.max("run")).first()[0] or 0) + 1
        done = past.filter("status = 'ok'").select(*keys).distinct()
        todo = rows.join(done, keys, "left_anti")
        units = todo.select(*keys).distinct()
        if k == 0 and expected is not None:
            units = units.union(expected.select(*keys).join(done, keys, "left_anti")).distinct()
        bad = stage.problems(todo).groupBy(*keys).agg(F.min("message").alias("message")) if stage.problems else spark.createDataFrame([], StructType(list(key_types.fields)).add("message", "string"))
        out = stage.work(todo.join(bad, keys, "left_anti"))
        data = f"{store}/data/{stage.name}"
        out.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(data)
        kept = spark.read.schema(out.schema).parquet(data)
        there = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        seen = todo.select(*keys).distinct().withColumn("_seen", F.lit(True))
        report = units.join(bad, keys, "left").join(there, keys, "left").join(seen, keys, "left")
        status = F.when(F.col("_seen").isNull(), "missing").when(F.col("message").isNotNull(), "error").when(F.col("n_rows").isNull(), "empty").otherwise("ok")
        report.select(*keys, F.lit(stage.name).alias("stage"), status.alias("status"), "message", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                      F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{store}/status/{stage.name}")
        now = _status(spark, store, stage.name, schema)
        reports.append(now.withColumn("_at", F.struct("run", F.lit(k))))
        latest = now.groupBy(*keys).agg(F.max_by("status", "run").alias("_s")).filter("_s = 'ok'")
        rows = kept.join(latest, keys, "left_semi")
    every = reports[0]
    for more in reports[1:]:
        every = every.unionByName(more)
    # within a unit a later stage counts more than an earlier one, and of one stage the later run
    last = every.groupBy(*keys).agg(F.max_by(F.struct("stage", "status", "message", "n_rows"), F.struct("_at.col2", "run")).alias("_last"))
    return last.select(*keys, "_last.*")


def unit_problems(units: dict[str, tuple[str, str]]) -> Callable[[DataFrame], DataFrame]:
    """Check of declared units: *units* maps a unit column to (quantity, target). Keys are site and day."""
    def check(rows: DataFrame) -> DataFrame:
        found = [catalogue.unit_problem(F.col(column), quantity, target) for column, (quantity, target) in units.items()]
        per = rows.select("site", "day", F.explode(F.array_compact(F.array(*found))).alias("message"))
        return per.distinct()

    return check


def empty_channels(cols: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Check that each of *cols* has a value on the day."""
    def check(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("site", "day").agg(*[F.count(c).alias(c) for c in cols])
        named = F.concat_ws(", ", *[F.when(F.col(c) == 0, F.lit(c)) for c in cols])
        return n.select("site", "day", named.alias("_names")).filter("_names <> ''").select("site", "day", F.concat(F.lit("no value of "), "_names").alias("message"))

    return check


def _both(*checks: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def check(rows: DataFrame) -> DataFrame:
        found = [c(rows) for c in checks]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    return check


def site_stages(opts: FluxOptions, limits: dict, spikes: dict, window_us: int, chunk: int, units: dict[str, tuple[str, str, str]] | None = None,
                platform: dict | None = None, fits: DataFrame | None = None, longest: int = 10) -> list[Stage]:
    """load, condition, motion (with *platform*), flux and save of samples keyed by site and day.

    *units* maps a column to (its unit column, quantity, target unit); undeclared units fall back to the size of the
    values. *platform* holds the arguments of `motion.correct_wind` besides rows and keys (step_us, lever, …).
    """
    def load(rows: DataFrame) -> DataFrame:
        for column, (unit, quantity, target) in (units or {}).items():
            rows = catalogue.convert_series(rows, ["site", "day"], column, unit, quantity, target).drop(unit)
        return rows

    def clean(rows: DataFrame) -> DataFrame:
        return condition(rows, limits, spikes, window_us, longest, chunk)

    def level(rows: DataFrame) -> DataFrame:
        keys = ["site", "day", "height"]
        step = platform["step_us"]
        true, _ = motion.correct_wind(rows, keys, "us", **platform)
        true = true.select(*keys, F.col("us").alias("_slot"), F.col("u_true").alias("u"), F.col("v_true").alias("v"), F.col("w_true").alias("w"))
        slot = F.expr(f"us - pmod(us, {step})")
        return rows.drop("u", "v", "w").withColumn("_slot", slot).join(true, [*keys, "_slot"], "left").drop("_slot").select(rows.columns)

    def flux(rows: DataFrame) -> DataFrame:
        return flux_job(rows, opts, fits).withColumn("day", F.expr(f"(period_us - 1) div {DAY_US}"))

    def save(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"period_min": F.lit(opts.period_us // 60_000_000), "detrend": F.lit(opts.detrend)})

    needs = _both(unit_problems({unit: (q, target) for unit, q, target in units.values()}), empty_channels(["u", "v", "w"])) if units else empty_channels(["u", "v", "w"])
    stages = [Stage("load", load, needs), Stage("condition", clean)]
    stages += [Stage("motion", level, empty_channels(motion.ANGLES))] if platform else []
    return [*stages, Stage("flux", flux), Stage("save", save)]
