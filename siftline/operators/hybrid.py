"""Hybrid search: keyword and vector candidates of a batch of queries, scored by nine signals, merged and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp01
from ..session import staged
from .embed import Hash
from .search import bm25, merge_candidates, rows_of, top_k, vector_top_k
from .signals import scored, specific_words


def channels(docs: DataFrame, queries: DataFrame, k: int, provider: Hash | None = None) -> DataFrame:
    """(query_id, id, semantic, keyword, source, arrival): k candidates of each channel, cosines clamped and BM25 divided by the
    query's best."""
    provider = provider or Hash()
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    word = bm25(docs, queries, k).select("query_id", F.col("doc_id").alias("id"), F.lit(0.0).alias("semantic"), clamp01(F.col("score") / top).alias("keyword"), F.lit("keyword").alias("source"), F.lit(1).alias("arrival"))
    asked = queries.select("query_id", provider.embed(F.col("text")).alias("q"))
    own = docs.select(F.col("doc_id").alias("vec_id"), provider.embed(F.col("text")).alias("embedding"))
    near = vector_top_k(asked, own, k).select("query_id", F.col("vec_id").alias("id"), clamp01(F.col("score")).alias("semantic"), F.lit(0.0).alias("keyword"), F.lit("vector").alias("source"), F.lit(0).alias("arrival"))
    return near.unionByName(word)


#: What chunks may have beside doc_id and text, and what stands for it where they don't.
OPTIONAL = {"file_path": "string", "symbol_name": "string", "parent_symbol": "string", "symbol_type": "string", "last_indexed_at": "string"}


def candidates(docs: DataFrame, queries: DataFrame, k: int, provider: Hash | None = None, now=None) -> DataFrame:
    """The columns of signals.scored() for the candidates of both channels; docs are chunks(doc_id, text and any of OPTIONAL).
    Only the candidates, at most 2 * k a query, meet their rows again."""
    have = [F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), *have)
    found = staged(channels(docs.select("doc_id", "text"), queries.select("query_id", "text"), k, provider), "channels")
    own = rows_of(rows.withColumn("file_path", F.coalesce("file_path", F.lit(""))), found, "id")
    met = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(own, "id")
    if "file_path" in docs.columns:
        met = met.join(specific_words(docs.select("file_path")).withColumnRenamed("words", "specific"), "file_path", "left")
    else:
        met = met.withColumn("specific", F.lit(None).cast("array<string>"))
    null = F.lit(None).cast("double")
    full = met.withColumns({"dependency": null, "reference": null, "path_hint": null, "exact_identifier": F.lit(False)})
    return scored(full, now)


def hybrid_search(docs: DataFrame, queries: DataFrame, limit: int, provider: Hash | None = None, now=None) -> DataFrame:
    """docs(doc_id, text, …), queries(query_id, text) -> query_id, id, total, best_source, sources, rank.

    Each channel gives max(4 * limit, 20) candidates, each scored on its own; a document keeps its best total.
    """
    found = candidates(docs, queries, max(4 * limit, 20), provider, now)
    return top_k(merge_candidates(found), ["query_id"], [F.desc("total"), "id"], limit)
