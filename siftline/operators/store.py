"""The chunk table's write path as joins: diff, reuse, upsert, delete, rename."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the one latest in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the batch merged in by key: the batch's last row of each key replaces or joins."""
    new = last_wins(batch, keys, order).select(*base.columns)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_where_in(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def rename(base: DataFrame, moves: DataFrame, path: str = "file_path") -> DataFrame:
    """moves(old, new): paths change, ids stay."""
    joined = base.join(moves.withColumnsRenamed({"old": "_old", "new": "_new"}), F.col(path) == F.col("_old"), "left")
    return joined.withColumn(path, F.coalesce("_new", path)).drop("_old", "_new")


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status) from path and hash on both sides: unchanged, changed, new, removed or renamed.

    A new path is a rename if a removed path has its hash; each hash pairs its first new path with its last removed one.
    """
    o, n = old.select("file_path", F.col("file_hash").alias("old_hash")), new.select("file_path", F.col("file_hash").alias("new_hash"))
    both = o.join(n, "file_path", "full_outer")
    added, removed = both.where("old_hash IS NULL"), both.where("new_hash IS NULL")
    firsts = added.groupBy("new_hash").agg(F.min("file_path").alias("file_path")).join(removed.groupBy("old_hash").agg(F.max("file_path").alias("from_path")), F.col("new_hash") == F.col("old_hash")).select("file_path", "from_path")
    marks = firsts.select("file_path", F.lit("renamed").alias("mark")).unionByName(firsts.select(F.col("from_path").alias("file_path"), F.lit("moved away").alias("mark")))
    status = F.coalesce("mark", F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed"))
    return both.join(marks, "file_path", "left").select("file_path", status.alias("status"))


def embedding_reuse(new: DataFrame, old: DataFrame) -> DataFrame:
    """new(id, file_path, content_hash) with how it gets its vector: by id, by content within the file, or embedded anew."""
    by_id = old.select("id", F.col("content_hash").alias("_same"))
    by_text = old.select("file_path", "content_hash", F.lit(True).alias("_there")).distinct()
    joined = new.join(by_id, "id", "left").join(by_text, ["file_path", "content_hash"], "left")
    return joined.select("id", F.when(F.col("_same") == F.col("content_hash"), "id").when(F.col("_there"), "content").otherwise("embed").alias("source"))


def evenly_spaced(rows: DataFrame, key: str, k: int = 32, cuts: int = 256) -> DataFrame:
    """The keys at floor(i * n / k) in sorted order, all where n <= k.

    Bounds drawn from the keys by a hash cut them into ranges; counts by range tell which ranges hold a wanted place, and
    only those are numbered, each on its own. Repeated keys are as many places.
    """
    own = rows.select(key).where(F.col(key).isNotNull())
    drawn = [r[0] for r in own.distinct().orderBy(F.xxhash64(key), key).limit(cuts).collect()]
    bounds = F.array(*[F.lit(x) for x in sorted(drawn)]) if drawn else None
    at = F.size(F.filter(bounds, lambda b: b <= F.col(key))) if drawn else F.lit(0)
    ranged = own.withColumn("_at", at)
    counts = {r["_at"]: r["n"] for r in ranged.groupBy("_at").agg(F.count("*").alias("n")).collect()}
    n, before, wanted = sum(counts.values()), 0, []
    places = sorted({i * n // k for i in range(k)}) if n > k else range(n)
    for r in sorted(counts):
        wanted += [(r, p - before + 1) for p in places if before <= p < before + counts[r]]
        before += counts[r]
    nth = F.row_number().over(Window.partitionBy("_at").orderBy(key))
    numbered = ranged.where(F.col("_at").isin([r for r, _ in wanted])).withColumn("_n", nth)
    asked = rows.sparkSession.createDataFrame(wanted, "_at int, _n int")
    return numbered.join(F.broadcast(asked), ["_at", "_n"]).select(key)


def update_lines(base: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(id, start_line, end_line): chunks get new line ranges, everything else stays."""
    joined = base.join(moves.select(F.col("id").alias("_id"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b")), F.col("id") == F.col("_id"), "left")
    return joined.withColumns({"start_line": F.coalesce("_a", "start_line"), "end_line": F.coalesce("_b", "end_line")}).drop("_id", "_a", "_b")
