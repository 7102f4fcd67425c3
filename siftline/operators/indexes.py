"""Indexes kept beside a chunk table: postings by term for keyword search, centroids and cells for vector search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import round_at, tokens
from .search import BROADCAST_ROWS, postings, top_k

#: Rows from which vectors are indexed, growth after which the index is trained anew, cells that a query visits,
#: and how many times the wanted rows are compared exactly.
LEAST, RETRAIN, PROBES, REFINE = 10_000, 2, 32, 10


@dataclass(frozen=True)
class Postings:
    """postings(term, doc_id, tf, dl) in files by bucket of the term, df(term, df) likewise, and totals(n, avgdl)."""

    folder: str
    buckets: int = 64

    def build(self, docs: DataFrame) -> Postings:
        """Write the index of docs(doc_id, text) anew. Terms are dealt to buckets, so a search reads only those of its terms."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        rows = postings(docs).withColumn("bucket", bucket)
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings")
        spark = docs.sparkSession
        spark.read.parquet(f"{self.folder}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/df")
        docs.select(F.size(tokens("text")).alias("dl")).where("dl >= 0").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals")
        return self

    def exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def top_k(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, doc_id, score and rank as search.bm25() has them, from the buckets of the queries' terms alone."""
        spark = queries.sparkSession
        terms = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        wanted = [r.bucket for r in terms.select("bucket").distinct().collect()]
        totals = spark.read.parquet(f"{self.folder}/totals").first()
        small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        side = lambda df: F.broadcast(df) if small else df
        df = spark.read.parquet(f"{self.folder}/df").where(F.col("bucket").isin(wanted))
        known = side(terms).join(df, ["bucket", "term"])
        idf = F.log((totals.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("dl") / totals.avgdl))
        met = spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(wanted)).join(side(known), ["bucket", "term"])
        scored = met.groupBy("query_id", "doc_id").agg(round_at(F.sum(idf * tf), 4).alias("score"))
        return top_k(scored, ["query_id"], [F.desc("score"), "doc_id"], k)


def wants_index(rows: int, trained_on: int | None) -> str:
    """none below LEAST rows, train where there is no index or the rows have doubled since, else keep."""
    if rows < LEAST:
        return "none"
    return "train" if trained_on is None or rows >= RETRAIN * trained_on else "keep"


@dataclass(frozen=True)
class Cells:
    """An inverted file: unit vectors by the centroid nearest to them, in files by cell."""

    folder: str

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = 100_000, rounds: int = 10, seed: int = 7) -> Cells:
        """Train centroids on at most `sample` of vectors(vec_id, embedding), drawn by a hash of the id, and deal every vector."""
        spark = vectors.sparkSession
        drawn = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
        x = np.array(drawn.tolist(), np.float64)
        n = cells or max(1, round(len(x) ** 0.5))
        centroids = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
        for _ in range(rounds):
            own = np.argmax(x @ centroids.T - (centroids**2).sum(1) / 2, axis=1)
            for c in range(n):
                if (own == c).any():
                    centroids[c] = x[own == c].mean(0)

        def deal(batches):
            for batch in batches:
                y = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
                cell = np.argmax(y @ centroids.T - (centroids**2).sum(1) / 2, axis=1) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], ["vec_id", "embedding", "cell"])

        kind = vectors.schema["vec_id"].dataType.simpleString()
        item = vectors.schema["embedding"].dataType.simpleString()
        rows = vectors.select("vec_id", "embedding").where(F.size("embedding") == x.shape[1]).mapInArrow(deal, f"vec_id {kind}, embedding {item}, cell int")
        rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/cells")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")
        return self

    def top_k(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """query_id, vec_id, score and rank of the k best by dot product in the `probes` cells nearest to each of
        queries(query_id, q); the vectors are compared exactly, in blocks of a cell."""
        spark = queries.sparkSession
        centres = spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").toPandas()
        c = np.array(centres["centre"].tolist())

        def near(batches):
            for batch in batches:
                q = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
                far = q @ c.T - (c**2).sum(1) / 2
                best = np.argsort(-far, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(batch)), best.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(best.ravel().astype(np.int32))], ["query_id", "q", "cell"])

        kind = queries.schema["query_id"].dataType.simpleString()
        rows = spark.read.parquet(f"{self.folder}/cells")
        vec = rows.schema["vec_id"].dataType.simpleString()
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL").mapInArrow(near, f"query_id {kind}, q array<double>, cell int")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if len(left) and len(right):
                q = np.asarray(left["q"].combine_chunks().flatten()).reshape(len(left), -1)
                ids, y = np.asarray(right["vec_id"]), np.asarray(right["embedding"].combine_chunks().flatten(), np.float64).reshape(len(right), -1)
                for name, own in zip(left["query_id"].to_pylist(), q, strict=True):
                    score = (y * own).sum(axis=1)
                    best = np.lexsort((ids, -score))[:k]
                    out[0] += [name] * len(best)
                    out[1] += ids[best].tolist()
                    out[2] += score[best].tolist()
            return pa.table({"query_id": pa.array(out[0], left.schema.field("query_id").type), "vec_id": pa.array(out[1], right.schema.field("vec_id").type), "score": pa.array(out[2], pa.float64())})

        found = asked.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(meet, f"query_id {kind}, vec_id {vec}, score double")
        return top_k(found, ["query_id"], [F.desc("score"), "vec_id"], k)
