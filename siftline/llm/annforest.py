"""Approximate nearest neighbours: forests of sorted hash strings with longest-prefix descent and synchronous ascent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Forest:
    trees: int = 48
    bits: int = 64  # length of a hash string: one sign of a random direction each
    seek: int = 3000  # distinct candidates to gather for a query in one shard of the index
    shard: int = 8192  # vectors of a shard, which one task holds
    block: int = 1024  # queries that meet a shard at a time


def hash_strings(x: np.ndarray, centre: np.ndarray, trees: int, bits: int, seed: int = 11) -> np.ndarray:
    """(trees, n) strings of `bits` <= 64 signs as unsigned integers, so prefixes are compared by value."""
    planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], trees * bits))
    out = np.empty((trees, len(x)), np.uint64)
    for at in range(0, len(x), 4096):
        signs = ((x[at : at + 4096] - centre) @ planes > 0).reshape(-1, trees, bits)
        pad = np.concatenate([signs, np.zeros((*signs.shape[:2], 64 - bits), bool)], 2) if bits < 64 else signs
        out[:, at : at + 4096] = np.packbits(pad, axis=2).view(">u8")[..., 0].T.astype(np.uint64)
    return out


def search(points: np.ndarray, queries: np.ndarray, forest: Forest) -> list[np.ndarray]:
    """Candidates (indices of points) of each query: every tree is descended to its longest prefix match, then all trees
    ascend together, one bit at a time, until forest.seek distinct candidates (or all points) are found."""
    n, seek = len(points), min(forest.seek, len(points))
    centre = np.median(points, axis=0)
    own, asked = hash_strings(points, centre, forest.trees, forest.bits), hash_strings(queries, centre, forest.trees, forest.bits)
    order = np.argsort(own, axis=1, kind="stable")
    strings = np.take_along_axis(own, order, 1)
    drop = np.arange(forest.bits + 1, dtype=np.uint64)[::-1] + np.uint64(64 - forest.bits)  # by depth; 64 at the root
    free = np.array([(1 << int(x)) - 1 for x in drop], np.uint64)
    first = np.empty((forest.trees, len(queries), forest.bits + 1), np.int64)
    last = np.empty_like(first)
    for t in range(forest.trees):
        low = asked[t][:, None] & ~free[None, :]
        first[t] = np.searchsorted(strings[t], low)
        last[t] = np.searchsorted(strings[t], low | free[None, :], side="right")
    size = (last - first).sum(axis=0)  # never grows with depth; a tree without a match of that length adds nothing
    out = []
    for q in range(len(queries)):
        found = np.zeros(n, bool)
        for depth in range(int(np.flatnonzero(size[q] >= seek)[-1]), -1, -1):
            for t in range(forest.trees):
                found[order[t, first[t, q, depth] : last[t, q, depth]]] = True
            if np.count_nonzero(found) >= seek:
                break
        out.append(np.flatnonzero(found))
    return out


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, forest: Forest = Forest()) -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    The score is the Euclidean distance in double precision; the query's own row is no candidate; ties go to the smaller
    vec_id. Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
    nor do null ids. Rows that repeat vec_id and vector are one row. Rows that share a vec_id but not the vector are one
    candidate and one query, whose distance is the smallest of theirs; they are no candidates of one another. Equal
    vectors are indexed once with their k + 1 smallest ids, which are all that any answer can need. Every distinct vector
    is indexed, in shards that a task can hold; blocks of queries meet every shard. Other columns are not read; an empty
    table gives an empty result.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    fit = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).where("vec_id IS NOT NULL").where(fit).distinct()
    shape = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("v") == shape.d)
    shards, blocks = -(-shape.n // forest.shard), max(1, -(-shape.n // (every * forest.block)))
    few = clean.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = points.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = clean.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def meet(queries: pa.Table, index: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            x = np.asarray(index["v"].combine_chunks().flatten()).reshape(len(index), -1)
            y = np.asarray(queries["v"].combine_chunks().flatten()).reshape(len(queries), -1)
            ids, names = index["ids"].to_pylist(), queries["vec_id"].to_pylist()
            for q, found in enumerate(search(x, y, forest)):
                far = np.sqrt(((x[found] - y[q]) ** 2).sum(axis=1))
                want, near = k, {}
                while True:  # until there are k ids besides the query's own, and all that tie with the last
                    keep = np.flatnonzero(far <= np.partition(far, want)[want]) if len(far) > want else np.arange(len(far))
                    near = {v for i in found[keep].tolist() for v in ids[i]} - {names[q]}
                    if len(near) >= k or len(keep) == len(far):
                        break
                    want *= 2
                for i, s in zip(found[keep].tolist(), far[keep].tolist(), strict=True):
                    for v in ids[i]:
                        if v != names[q]:
                            cols["query_id"].append(names[q]), cols["vec_id"].append(v), cols["score"].append(s)
        return pa.table({"query_id": pa.array(cols["query_id"], pa.int64()), "vec_id": pa.array(cols["vec_id"], pa.int64()), "score": pa.array(cols["score"], pa.float64())})

    found = asked.groupBy("shard", "block").cogroup(points.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
