"""Small DataFrame helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cleaned, dropped, shared_dir, staged

__all__ = ["ascii_lower", "cleaned", "dropped", "join_counted", "row_key", "shared_dir", "staged", "table"]


def join_counted(rows: DataFrame, counted: DataFrame, key: str, times: str, parts: int = 1000) -> DataFrame:
    """rows joined with counted, a staged table that has one row a key and how many rows bear it.

    Keys of more than one row in `parts` are broadcast, so that none of them lands in one task; there are `parts` of them
    at most. The others meet by a shuffle, in which no key has a larger share.
    """
    total = counted.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n")).first().n
    often = F.col(times) * parts > total
    hot = F.broadcast(counted.where(often))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(counted.where(~often), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text") -> list:
    """Identity of a document row: doc_id and a hash of its text, so repeated ids with other texts stay apart."""
    return [F.col("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
