"""Registry of the checked queries: a Spark function and, where it exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import complete_grid
from . import standin


class Tables:
    """The driver tables and the tower layouts derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tower(self) -> DataFrame:
        return standin.tower(self.read("events"))

    def slots(self) -> DataFrame:
        """Hourly means of the tower samples; an hour without samples has no row."""
        us = F.col("us") - F.pmod(F.col("us"), F.lit(standin.HOUR_US))
        return self.tower().withColumn("us", us).groupBy("site", "height", "us").agg(
            *[F.avg(c).alias(c) for c in ("u", "w", "ts_c", "h2o")])

    def grid(self) -> DataFrame:
        """The hourly means on their complete grid."""
        return complete_grid(self.slots(), standin.KEYS, "us", standin.HOUR_US)

    def windows(self) -> DataFrame:
        # a small file is one split, and kernels work where a window lives: deal the raw vectors out once
        return standin.windows(self.read("embeddings").repartition("vec_id"))

    def platform(self) -> DataFrame:
        return standin.platform(self.read("events"))

    def products(self) -> DataFrame:
        return standin.products(self.read("orders"))


@dataclass(frozen=True)
class Check:
    name: str
    fn: Callable[[Tables], DataFrame]
    keys: tuple[str, ...]
    vals: tuple[str, ...]
    digits: int
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(Tables(spark, sf_dir))
        return df.select(*self.keys, *[
            F.round(F.col(v).cast("double"), self.digits).alias(v) for v in self.vals])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql
        for token, text in standin.SQL.items():
            body = body.replace(f"@{token}", text)
        cols = list(self.keys) + [
            f"CASE WHEN ROUND(CAST({v} AS DOUBLE), {self.digits}) = 0 THEN 0.0::DOUBLE "
            f"ELSE ROUND(CAST({v} AS DOUBLE), {self.digits}) END AS {v}" for v in self.vals]
        return f"SELECT {', '.join(cols)} FROM ({body}) AS result"


REGISTRY: dict[str, Check] = {}


def check(name: str, keys: str = "", vals: str = "", sql: str | None = None, digits: int = 6):
    """Register a query under *name*; *keys* pass unchanged, *vals* are rounded doubles."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Check(name, fn, tuple(keys.split()), tuple(vals.split()), digits, sql)
        return fn

    return add
