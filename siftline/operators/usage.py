"""What retrieval saves: the usage log, baselines, savings, and benchmarks of retrieval against scanning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import round_at, token_estimate

EVENT = "ts string, kind string, tool string, repo string, resultTokens long, baselineTokens long, latencyMs double"
#: Dollars a million tokens, turns of a chat, files an agent reads, files of a repository nobody counted.
RATE, TURNS, READ, UNKNOWN = 3.0, 15, 12, 120
#: Most tokens, tokens at least and tokens a file of a search, of file reads and of a listing.
COSTS = ((15_000, 400, 12), (70_000, 2_000, 80), (8_000, 200, 8))


def append(events: DataFrame, folder: str) -> None:
    """Add events to the log, one JSON object a line."""
    events.write.mode("append").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The events of the log; lines that are no JSON are left out, a log that is not there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(folder)


def heuristic(files) -> Column:
    """Tokens of a listing, a search and some file reads in a repository of so many files."""
    return sum((F.least(F.lit(most), F.lit(base) + F.lit(per) * files) for most, base, per in COSTS), F.lit(0)).cast("long")


def baseline(repos: DataFrame, measured: DataFrame) -> DataFrame:
    """(repo, baseline) of repos(repo, files, null if unknown): the mean of what was measured(repo, naive_tokens) there, else
    of all that was measured, else by the heuristic."""
    own = measured.groupBy("repo").agg(F.floor(F.avg("naive_tokens") + 0.5).cast("long").alias("own"))
    whole = measured.agg(F.floor(F.avg("naive_tokens") + 0.5).cast("long").alias("whole"))
    met = repos.join(own, "repo", "left").join(F.broadcast(whole), F.lit(True))
    return met.select("repo", F.coalesce("own", "whole", heuristic(F.coalesce("files", F.lit(UNKNOWN)))).alias("baseline"))


def summary(events: DataFrame, by: list[str], rate: float = RATE, turns: int = TURNS) -> DataFrame:
    """Retrievals, blocked scans, tokens sent and spared, over a chat of so many turns, and what that is in dollars."""
    search = F.col("kind") == "mcp_retrieval"
    total = lambda c: F.coalesce(F.sum(F.when(search, F.col(c))), F.lit(0))
    per = events.groupBy(*by).agg(F.count(F.when(search, 1)).alias("retrievals"), F.count(F.when(F.col("kind") == "denied_scan", 1)).alias("denied"), total("resultTokens").alias("result_tokens"), total("baselineTokens").alias("baseline_tokens"))
    saved = F.greatest(F.lit(0), F.col("baseline_tokens") - F.col("result_tokens"))
    out = per.withColumn("saved", saved).withColumn("saved_over_turns", saved * turns)
    return out.withColumn("usd", round_at(F.col("saved") / 1e6 * rate, 6)).withColumn("usd_over_turns", round_at(F.col("saved_over_turns") / 1e6 * rate, 6))


def scan_cost(files: DataFrame, keywords: DataFrame, most: int = READ) -> DataFrame:
    """(query_id, files_listed, matching_files, list_tokens, dump_tokens, read_tokens, naive_tokens) of keywords(query_id,
    keyword): what an agent pays that lists files(file_path, content), greps for the keyword and reads the first `most`
    files by path that have it. A match is shown with two lines before and after it, 200 matches a file at most."""
    from .lookup import containing

    listed = files.agg(F.count("*").alias("files_listed"), F.ceil(F.sum(F.length("file_path") + 1) / 4).cast("long").alias("list_tokens"))
    hits = containing(files, keywords.select(F.col("keyword").alias("needle")), "file_path").select("file_path", F.col("needle").alias("keyword"))
    lines = F.split("content", "\n", -1)
    met = hits.join(files, "file_path").select("keyword", "file_path", token_estimate(F.col("content")).alias("tokens"), lines.alias("lines"))
    at = F.slice(F.filter(F.transform("lines", lambda x, i: F.when(x.contains(F.col("keyword")), i)), lambda i: i.isNotNull()), 1, 200)
    near = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - 2, F.lit(0)), F.least(i + 2, F.size("lines") - 1)))))
    shown = F.aggregate(F.transform(near, lambda i: F.length(F.get("lines", i)) + F.length("file_path") + F.length((i + 1).cast("string")) + 3), F.lit(0), lambda a, x: a + x)
    nth = F.row_number().over(Window.partitionBy("keyword").orderBy("file_path"))
    own = met.select("keyword", "file_path", "tokens", shown.alias("shown")).withColumn("n", nth)
    per = own.groupBy("keyword").agg(F.count("*").alias("matching_files"), F.ceil(F.sum("shown") / 4).cast("long").alias("dump_tokens"), F.sum(F.when(F.col("n") <= most, F.col("tokens")).otherwise(0)).alias("read_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = keywords.join(per, "keyword", "left").join(F.broadcast(listed), F.lit(True)).select("query_id", "files_listed", zero("matching_files"), "list_tokens", zero("dump_tokens"), zero("read_tokens"))
    return out.withColumn("naive_tokens", F.col("list_tokens") + F.col("dump_tokens") + F.col("read_tokens"))


def savings(scanned: DataFrame, answered: DataFrame) -> DataFrame:
    """(query_id, naive_tokens, search_tokens, saved, pct_saved) from scan_cost() and answered(query_id, search_tokens)."""
    met = scanned.join(answered, "query_id").withColumn("saved", F.greatest(F.lit(0), F.col("naive_tokens") - F.col("search_tokens")))
    share = F.when(F.col("naive_tokens") > 0, F.floor(1000 * F.col("saved") / F.col("naive_tokens") + 0.5) / 10).otherwise(0.0)
    return met.select("query_id", "naive_tokens", "search_tokens", "saved", share.alias("pct_saved"))


def nearest_rank(values, p: float) -> Column:
    """The value at ceil(p * n) of the sorted values; 0 without any."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = F.greatest(F.ceil(F.lit(p) * F.size(kept)) - 1, F.lit(0)).cast("int")
    return F.coalesce(F.get(kept, at), F.lit(0.0))


def benchmark(tasks: DataFrame, means: list[str], ratios: list[str], latencies: list[str], by: list[str]) -> DataFrame:
    """Means of the metrics (nulls left out), medians of the cost ratios and the 50th, 95th and 99th nearest-rank percentile of
    the latencies, by suite. Percentiles are exact; the rows of a suite are tasks, of which there are few."""
    per = [F.count("*").alias("tasks"), *[round_at(F.avg(c), 4).alias(f"mean_{c}") for c in means], *[round_at(F.expr(f"percentile({c}, 0.5)"), 4).alias(f"median_{c}") for c in ratios]]
    per += [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {c})").alias(f"p{p}_{c}") for c in latencies for p in (50, 95, 99)]
    return tasks.groupBy(*by).agg(*per)


def reduction(base, own) -> Column:
    """Percent of the base that is spared; 0 without a base."""
    return F.when(base > 0, (base - own) / base * 100).otherwise(0.0)
