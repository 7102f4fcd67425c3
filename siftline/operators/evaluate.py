"""Evaluation and usage operators: ranking metrics, session cost, savings, token budgets, seen runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import round_at


def ir_metrics(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked(query_id, id, rank) and labels(query_id, id, level) -> precision at 5 of what was returned, recall at 10,
    reciprocal rank and NDCG at 10 per query of ranked."""
    joined = ranked.join(labels, ["query_id", "id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    gain = F.when(F.col("rank") <= 10, F.col("level") / F.log2(F.col("rank") + 1)).otherwise(0.0)
    hit = F.col("level") > 0
    per = joined.groupBy("query_id").agg(
        (F.count(F.when(hit & (F.col("rank") <= 5), 1)) / F.count(F.when(F.col("rank") <= 5, 1))).alias("p"),
        F.count(F.when(hit & (F.col("rank") <= 10), 1)).alias("found"), F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(gain).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("level"), "id"))
    ideal = labels.where("level > 0").withColumn("place", place)
    best = ideal.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("place") <= 10, F.col("level") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("idcg"))
    out = per.join(best, "query_id", "left")
    return out.select(
        "query_id", round_at(F.col("p"), 4).alias("precision_5"), round_at(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 4).alias("recall_10"),
        round_at(F.col("rr"), 4).alias("mrr"), round_at(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 4).alias("ndcg_10"),
    )


def session_cost(calls: DataFrame, base: int = 6000, out: int = 150, answer: int = 700, per_turn: int = 3) -> DataFrame:
    """calls(session_id, seq, result_tokens) -> calls, input, output and cached cost of a session.

    Every call reads the resident context again: base, all earlier results and outputs. What was resident a call
    before costs a tenth, new context a quarter more, output five times; a last call gives the answer.
    """
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = calls.withColumn("turn", F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1) / per_turn))
    turns = turned.groupBy("session_id", "turn").agg(F.sum("result_tokens").alias("tokens")).withColumnRenamed("turn", "seq")
    grown = turns.withColumn("after", F.lit(base) + F.sum(F.col("tokens") + out).over(w)).withColumn("resident", F.col("after") - F.col("tokens") - out)
    per = grown.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum("resident").alias("reads"), F.max("after").alias("last"))
    cached = 0.1 * F.col("reads") + 1.25 * F.col("last") + 5 * (F.col("turns") * out + answer)
    return per.select("session_id", (F.col("turns") + 1).alias("calls"), (F.col("reads") + F.col("last")).alias("input"), (F.col("turns") * out + answer).alias("output"), round_at(cached, 2).alias("cached_cost"))


def within_budget(rows: DataFrame, by: str, order: str, tokens: str, budget: int) -> DataFrame:
    """The first rows of every group whose running sum stays within the budget; the first one always."""
    w = Window.partitionBy(by).orderBy(order)
    summed = rows.withColumn("_sum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(w))
    return summed.where((F.col("_sum") <= budget) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def runs_of(rows: DataFrame, by: str, order: str, flag: str, least: int) -> DataFrame:
    """(by, lo, hi, flag) of maximal runs of equal flags; true runs shorter than `least` count as false and are merged."""
    w = Window.partitionBy(by).orderBy(order)

    def islands(df: DataFrame) -> DataFrame:
        changed = F.coalesce((F.lag(flag).over(w) != F.col(flag)).cast("int"), F.lit(1))
        return df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w)).drop("_c")

    sized = islands(rows.select(by, order, flag)).withColumn("_n", F.count("*").over(Window.partitionBy(by, "_run")))
    folded = sized.select(by, order, (F.col(flag) & (F.col("_n") >= least)).alias(flag))
    return islands(folded).groupBy(by, "_run", flag).agg(F.min(order).alias("lo"), F.max(order).alias("hi")).select(by, "lo", "hi", flag)
