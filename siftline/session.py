"""A Spark session with the settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as what was made of them is written, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "siftline", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow transfer; anything else by keyword with dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where that is unset, as in tests."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftline-"))
    return sc.getCheckpointDir().rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline/{uuid.uuid4().hex}/{name}"
    with cleaned(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._siftline_path = path
    return read


def dropped(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = table.sparkSession, getattr(table, "_siftline_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
