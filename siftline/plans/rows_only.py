"""Queries whose operators have no SQL form: order-dependent selection, names in prose, whole task contexts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import facets, hybrid, indexes, select, task


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of files, three to a file."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/unit_"), F.floor(F.col("doc_id") / 3).cast("string"), F.when(F.expr("doc_id % 11 = 3"), ".test.ts").when(F.expr("doc_id % 13 = 5"), ".md").otherwise(".ts"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", path.alias("file_path"))


#: The clock of these queries, so that they give the same rows on every run.
NOW = "2024-01-08T00:00:00Z"


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.hybrid_search(_files(spark, sf_dir), _benchmark(spark, sf_dir), 10, now=F.to_timestamp(F.lit(NOW)))


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine signals, floors and reasons of the candidates of every item."""
    found = hybrid.candidates(_files(spark, sf_dir), _benchmark(spark, sf_dir), 20, now=F.to_timestamp(F.lit(NOW)))
    return found.select("query_id", "id", "source", *[c for c in found.columns if c.startswith("s_")], "exact_floor", "total", "reason")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they are, and in twos and threes as requests of several parts."""
    items = _benchmark(spark, sf_dir).select("query_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    first = items.select("query_id", F.expr("substring_index(text, '.', 1)").alias("text"))
    several = first.groupBy(F.expr("query_id DIV 3").alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "text"))), lambda x: x.text), ", and `getUser` of src/unit_4.ts; ").alias("text"))
    return items.select(F.concat(F.lit("item "), F.col("query_id").cast("string")).alias("query_id"), "text").unionByName(several.select(F.concat(F.lit("group "), F.col("g").cast("string")).alias("query_id"), "text"))


def facet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.plan(_tasks(spark, sf_dir))


def _context(spark: SparkSession, sf_dir: str) -> task.Context:
    none = lambda t: F.lit(None).cast(t)
    rows = _files(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "file_path", F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("unit"), F.col("doc_id").cast("string"))).alias("symbol_name"), none("string").alias("parent_symbol"), F.lit("function").alias("symbol_type"),
        F.expr("CAST(doc_id % 3 * 100 + 1 AS INT)").alias("start_line"), F.expr("CAST(doc_id % 3 * 100 + 90 AS INT)").alias("end_line"), F.col("text").alias("content"), F.lit(NOW).alias("last_indexed_at"), F.array(F.lit("./unit_1")).alias("imports"), none("array<string>").alias("literals"),
    )
    return task.task_context(rows, _tasks(spark, sf_dir).where("query_id LIKE 'group%'"), now=F.to_timestamp(F.lit(NOW)))


def task_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every request of several parts selects, how well its parts are covered, how sure the reply is, and what to call next."""
    found = _context(spark, sf_dir)
    row = lambda df, kind, place, name, value: df.select("query_id", F.lit(kind).alias("kind"), place.cast("string").alias("place"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    parts = [
        row(found.selected, "selected", F.col("position"), F.col("id"), F.col("total")), row(found.coverage, "part", F.col("facet_id"), F.col("status"), F.col("strength")),
        row(found.confidence, "confidence", F.col("route"), F.col("complete"), F.col("score")), row(found.next_calls, "next", F.col("nth"), F.col("tool"), F.col("args")),
    ]
    return reduce(DataFrame.unionByName, parts)


def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all by the inverted file."""
    from ..session import shared_dir

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    built = indexes.Cells(f"{shared_dir(spark)}/siftline/{uuid.uuid4().hex}/ann").build(vectors)
    return built.top_k(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.expr("doc_id % 50 * 10")
    return docs.select(
        F.expr("doc_id % 20").alias("query_id"), F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), F.expr("doc_id % 3").cast("string")).alias("file"), F.lit(None).cast("string").alias("symbol"),
        line.alias("start_line"), (line + 15).alias("end_line"), F.col("text").alias("content"), (F.expr("doc_id * 37 % 1000") / 1000).alias("total"), token_estimate(F.col("text")).alias("tokens"), F.lit(False).alias("expansion"),
    )


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.greedy_pack(_pool(spark, sf_dir), select.Limits(chunks=8, tokens=8000, per_file=2, per_symbol=2, min_score=0.1))


def coverage_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("long")
    pool = _pool(spark, sf_dir).withColumn("relevance", F.array((n % 7) / 6, (n % 5) / 4, (n % 3) / 2))
    return select.coverage_greedy(pool, [0.5, 0.3, 0.2], select.Limits(chunks=12, tokens=8000, per_file=2, per_symbol=2))


def intent_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import intent

    return intent.analyse(_benchmark(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (hybrid_search, scored_candidates, greedy_pack, coverage_greedy, intent_facets, facet_plan, task_context, ann_search)}
