"""Context for tasks: candidates of the whole and of every part, expansion, selection within a budget, coverage, what to read next."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..session import staged
from . import expand, facets, hybrid, intent, lookup, search, select, signals

#: Candidates of each channel for a facet and for a whole task, symbols taken a task, keyword signal of what names bring.
FACET_HITS, WHOLE_HITS, SYMBOLS, NAMED = 16, 40, 8, 0.8


#: How a task begins that looks a definition up, and words of one that wants its uses.
LOOKS_UP = "where\\b|which (file|module|function|class)\\b|locate\\b|find (the )?(definition|implementation)\\b"
USES = "tests?|specs?|usages?|used|references?|callers?|called|calls"


@dataclass(frozen=True)
class Context:
    """What a batch of tasks leads to; every table is keyed by query_id."""

    plan: DataFrame
    candidates: DataFrame
    selected: DataFrame
    coverage: DataFrame
    confidence: DataFrame
    follow_ups: DataFrame
    next_calls: DataFrame
    relationships: DataFrame


def organic_floor(ranked: DataFrame, queries: DataFrame, gap: float = 0.15) -> DataFrame:
    """(query_id, floor) under which candidates without an exact floor go: the score above the first gap among them from the
    third on; infinite where a definition is looked up and an exact symbol is there; 0 otherwise."""
    text = F.lower("text")
    looks = text.rlike(rf"^\s*({LOOKS_UP})") & ~text.rlike(rf"\b({USES})\b")
    exact = ranked.groupBy("query_id").agg(F.max("exact_floor").alias("top"))
    cut = search.gap_cut(ranked.where("exact_floor = 0").select("query_id", "id", "total"), "query_id", gap)
    met = queries.select("query_id", looks.alias("looks")).join(exact, "query_id", "left").join(cut, "query_id", "left")
    return met.select("query_id", F.when(F.col("looks") & (F.coalesce("top", F.lit(0.0)) >= signals.SYMBOL_FLOOR), float("inf")).otherwise(F.coalesce("floor", F.lit(0.0))).alias("floor"))


def _named(queries: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, keyword, path_hint, exact_identifier) of what a task names: symbols, files, and terms that few files have."""
    symbols = asked.select("query_id", F.explode("symbols").alias("symbol_name")).join(chunks.where("symbol_name IS NOT NULL").select("id", "symbol_name"), "symbol_name")
    symbols = search.top_k(symbols, ["query_id", "symbol_name"], ["id"], SYMBOLS).select("query_id", "id", F.lit(NAMED).alias("keyword"), F.lit(None).cast("double").alias("path_hint"), F.lit(False).alias("exact_identifier"))
    names = asked.select("query_id", F.explode("files").alias("name"))
    files = names.join(lookup.files_named(chunks, names), "name").join(chunks.select("id", "file_path"), "file_path").select("query_id", "id", F.lit(NAMED).alias("keyword"), F.lit(1.0).alias("path_hint"), F.lit(False).alias("exact_identifier"))
    terms = asked.select("query_id", F.explode("exact_terms").alias("term"))
    exact = lookup.occurrences(chunks.select("id", "file_path", "content"), terms).where("exact").select("term", "file_path")
    rows = terms.join(exact, "term").join(chunks.select("id", "file_path", "content"), "file_path").where(F.col("content").contains(F.col("term")))
    rows = search.top_k(rows.select("query_id", "id").distinct(), ["query_id"], ["id"], FACET_HITS).select("query_id", "id", F.lit(NAMED).alias("keyword"), F.lit(None).cast("double").alias("path_hint"), F.lit(True).alias("exact_identifier"))
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("term"))
    hits = signals.path_hits(chunks, words).join(chunks.select("id", "file_path"), "file_path")
    hits = search.top_k(hits, ["query_id"], [F.desc("specificity"), "id"], FACET_HITS).select("query_id", "id", (0.3 + 0.3 * F.col("specificity")).alias("keyword"), (0.9 * F.col("specificity")).alias("path_hint"), F.lit(False).alias("exact_identifier"))
    return symbols.unionByName(files).unionByName(rows).unionByName(hits)


def task_context(chunks: DataFrame, queries: DataFrame, provider=None, aliases: list = (), hops: int = 2, threshold: float = 0.15, now=None) -> Context:
    """chunks(id, file_path, symbol_name, parent_symbol, symbol_type, start_line, end_line, content, last_indexed_at, imports,
    literals), queries(query_id string, text) -> Context.

    Every stage is bounded a query: channels, named things and expansion give a few hundred candidates, which one task selects
    from; the chunk table itself is only scanned, or joined by path, symbol or id.
    """
    asked, plan = staged(intent.analyse(queries), "asked"), staged(facets.plan(queries), "plan")
    docs = chunks.select(F.col("id").alias("doc_id"), F.col("content").alias("text"), *[c for c in hybrid.OPTIONAL if c in chunks.columns])
    parts = plan.select("query_id", "facet_id", F.concat_ws("\x01", "query_id", "facet_id").alias("key"), "embed_text")
    found = hybrid.channels(docs.select("doc_id", "text"), parts.select(F.col("key").alias("query_id"), F.col("embed_text").alias("text")), FACET_HITS, provider)
    own = staged(found.withColumn("signal", F.greatest("semantic", "keyword")).groupBy(F.col("query_id").alias("key"), "id").agg(F.max("signal").alias("signal"), F.max("semantic").alias("semantic"), F.max("keyword").alias("keyword")).join(parts.select("key", "query_id", "facet_id"), "key"), "parts")
    ranks = own.where("signal > 0").select("query_id", "facet_id", "id", (F.row_number().over(Window.partitionBy("query_id", "facet_id").orderBy(F.desc("signal"), "id")) - 1).alias("rank"))
    whole = staged(hybrid.channels(docs.select("doc_id", "text"), queries, WHOLE_HITS, provider).select("query_id", "id", "semantic", "keyword"), "whole")
    null = lambda t: F.lit(None).cast(t)
    pool = whole.unionByName(own.select("query_id", "id", "semantic", "keyword")).withColumns({"path_hint": null("double"), "exact_identifier": F.lit(False), "dependency": F.lit(0.0), "reference": F.lit(0.0), "expansion": F.lit(False)})
    named = _named(queries, asked, chunks).withColumns({"semantic": F.lit(0.0), "dependency": F.lit(0.0), "reference": F.lit(0.0), "expansion": F.lit(False)})
    seeds = search.top_k(whole.groupBy("query_id", "id").agg(F.max(F.greatest("semantic", "keyword")).alias("s")), ["query_id"], [F.desc("s"), "id"], 8).select("query_id", "id")
    reached = staged(expand.expanded(asked, staged(seeds, "seeds"), chunks.select("id", "file_path", "symbol_name", "imports", "content"), aliases, hops), "reached")
    more = reached.select("query_id", "id", "keyword", "dependency", "reference").withColumns({"semantic": F.lit(0.0), "path_hint": null("double"), "exact_identifier": F.lit(False), "expansion": F.lit(True)})
    every = staged(pool.unionByName(named).unionByName(more), "pool")
    rows = search.rows_of(chunks, every, "id")
    rows = rows.join(signals.specific_words(chunks.select("file_path")).withColumnRenamed("words", "specific"), "file_path", "left")
    full = signals.scored(every.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(rows, "id"), now)
    best = Window.partitionBy("query_id", "id").orderBy(F.desc("total"), "expansion", F.desc("keyword"), F.desc("semantic"))
    candidates = staged(full.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n"), "candidates")
    wants = queries.select("query_id", P.is_doc_task(F.col("text")).alias("wants_docs"), F.lower("text").rlike(rf"\b({signals.TEST_WORDS})\b").alias("wants_tests"))
    judged = candidates.join(wants, "query_id").select("query_id", "id", F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol"), "content", "literals", P.is_test(F.col("file_path")).alias("is_test"), "wants_docs", "wants_tests")
    relevance = staged(facets.relevance(judged, plan, ranks), "relevance")
    selected = staged(_chosen_rows(_chosen(candidates, queries, asked, plan, relevance), candidates), "selected")
    report = staged(facets.report(selected.select("query_id", "id", F.col("file_path").alias("file"), "start_line", "end_line", "position"), plan, relevance), "report")
    parts_done = facets.completeness(report)
    pool_rows = candidates.select("query_id", "id", F.col("file_path").alias("file"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "total", "tokens")
    sent = selected.select("query_id", "id", F.col("file_path").alias("file"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    reads = staged(facets.follow_ups(pool_rows, sent, report, relevance), "reads")
    top = selected.where("position = 1").select("query_id", F.col("total").alias("top"), F.col("file_path").alias("top_path"))
    route = plan.select("query_id", "route").distinct()
    sure = queries.select("query_id", "text").join(route, "query_id").join(top, "query_id", "left").join(parts_done.select("query_id", "complete", F.col("score").alias("covered"), "reason"), "query_id", "left")
    focused = F.col("route") == "focused"
    confidence = sure.select("query_id", "route", "complete", F.when(focused, facets.confidence(F.col("top"), F.col("top_path"), F.col("text"), threshold)).otherwise(F.col("covered")).alias("score"), F.when(focused, F.when(F.col("top") >= threshold, "Top results exceeded the confidence threshold.").otherwise("Low-confidence retrieval.")).otherwise(F.col("reason")).alias("reason"))
    calls = facets.next_calls(report.join(route.where("route <> 'focused'"), "query_id", "left_semi"), parts_done, reads)
    return Context(plan, candidates, selected, report, confidence, reads, calls, expand.relationships(reached.join(selected.select("query_id", "id"), ["query_id", "id"], "left_semi")))


def _chosen(candidates: DataFrame, queries: DataFrame, asked: DataFrame, plan: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, id, position): focused tasks are packed in order of total, the others by the coverage of their facets."""
    relevance = found.join(plan.select("query_id", "facet_id", "nth", "weight"), ["query_id", "facet_id"])
    vectors = relevance.groupBy("query_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "relevance", "weight"))), lambda x: F.struct(x.relevance.alias("r"), x.weight.alias("w"))).alias("v"))
    limits = asked.join(plan.select("query_id", "route").distinct(), "query_id").select("query_id", "route", facets.limits(F.col("mode"), F.col("route")).alias("l")).select("query_id", "route", "l.chunks", F.col("l.tokens").alias("budget"), "l.per_file", "l.per_symbol")
    floors = organic_floor(candidates, queries)
    pool = candidates.join(vectors, ["query_id", "id"]).join(limits, "query_id").join(floors, "query_id").select(
        "query_id", F.col("id").cast("string").alias("id"), F.col("file_path").alias("file"), F.when(F.col("parent_symbol").isNotNull() & F.col("symbol_name").isNotNull(), F.concat("parent_symbol", F.lit("."), "symbol_name")).otherwise(F.col("symbol_name")).alias("symbol"),
        F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content", "total", F.col("tokens").alias("tokens"), "expansion", F.transform("v", lambda x: x.r).alias("relevance"), F.transform("v", lambda x: x.w).alias("weights"),
        F.when(F.col("exact_floor") > 0, 0.0).otherwise(F.col("floor")).alias("least"), "route", "chunks", "budget", "per_file", "per_symbol",
    )
    return _select(pool)


def _select(pool: DataFrame) -> DataFrame:
    kind = pool.schema["query_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        limits = select.Limits(chunks=int(first.chunks), tokens=int(first.budget), per_file=int(first.per_file), per_symbol=int(first.per_symbol), expansion_files=3)
        rows = rows[rows.total >= rows.least]
        if not len(rows):
            return pd.DataFrame({"query_id": [], "id": [], "position": []})
        if first.route == "focused":
            out = select.pack(rows, limits)
            return out[out.selected][["query_id", "id", "position"]].astype({"position": "int64"})
        return select.cover(rows, list(first.weights), limits)[["query_id", "id", "position"]]

    return pool.groupBy("query_id").applyInPandas(run, f"query_id {kind}, id string, position long")


def _chosen_rows(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("_id", F.col("id").cast("string")).join(chosen.withColumnRenamed("id", "_id"), ["query_id", "_id"]).drop("_id")


def rendered(context: Context, name: str) -> DataFrame:
    """(query_id, text): a reply of a header, the state of every part, what to call next, and the chosen code by place."""
    code = context.selected
    head = F.concat(F.lit("### ["), "position", F.lit("] "), "file_path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.when(F.col("symbol_name").isNotNull(), F.concat(F.lit(" "), "symbol_name")).otherwise(""))
    block = F.concat(head, F.lit("\n"), F.regexp_replace("content", r"(?m)[ \t]+$", ""))
    blocks = code.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))), lambda x: x.b), "\n\n").alias("blocks"), F.sum("tokens").alias("tokens"))
    line = F.concat(F.rpad("status", 8, " "), F.when(F.length("label") > 70, F.concat(F.substring("label", 1, 69), F.lit("…"))).otherwise(F.col("label")))
    lines = context.coverage.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("facet_id", line.alias("l")))), lambda x: x.l), "\n").alias("lines"))
    calls = context.next_calls.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat("tool", F.lit(" "), "args").alias("c")))), lambda x: x.c), "\n").alias("calls"))
    met = context.confidence.join(blocks, "query_id", "left").join(lines, "query_id", "left").join(calls, "query_id", "left")
    top = F.concat(F.lit(f"{name} · "), "reason", F.lit(" · ~"), F.coalesce("tokens", F.lit(0)).cast("string"), F.lit(" tokens"))
    told = F.when(F.col("route") == "focused", F.lit("")).otherwise(F.concat(F.lit("\n"), F.coalesce("lines", F.lit(""))))
    then = F.when(F.col("calls").isNotNull(), F.concat(F.lit("\nNext, then answer:\n"), "calls")).otherwise("")
    return met.select("query_id", F.concat(top, told, then, F.lit("\n\n"), F.coalesce("blocks", F.lit(""))).alias("text"))
