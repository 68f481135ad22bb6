"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "fluxloom", **conf) -> SparkSession:
    """A session with the settings the operators assume; *conf* overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`.

    A local session without one uses a temporary folder of this process; on a
    cluster that would split tables over machines, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="fluxloom-scratch-"))
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


_LOCAL: dict[str, str] = {}


def release_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application has cut; call it when no result based on them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, compression: str = "snappy", wide: bool = False) -> DataFrame:
    """Write *df* to the shared scratch folder and read it back.

    The written table survives the loss of any executor, and every consumer
    reads the same rows. *wide* compiles stages of up to 1,000 columns, which
    Spark leaves uncompiled beyond 100: for aggregates of hundreds of sums.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    settings = {CLEANUP: "true"}  # the table replaces the shuffle files, which go when it is written
    if wide:
        settings["spark.sql.codegen.maxFields"] = "1000"
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)

