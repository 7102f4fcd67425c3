"""Lookups in the chunk and file tables: symbols, references, occurrences of terms, files by name, line ranges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions.words import registers, short_singular, strip_comments
from ..session import staged
from .search import rows_of, top_k

#: Characters of the strings that one automaton seeks; more of them take several passes.
NEEDLES = 2_000_000


def containing(rows: DataFrame, needles: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, needle, times): which of needles(needle) occur in the text of every row, and how often (overlaps count).

    One Aho-Corasick automaton a pass goes over every text once, whatever the number of strings; the strings are cut by
    hash into passes of about NEEDLES characters, so what goes out to the tasks is bounded. Empty strings occur nowhere.
    """
    wanted = needles.select("needle").where("needle <> ''").distinct()
    total = wanted.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-total // NEEDLES))
    kind = rows.schema[key].dataType.simpleString()

    def one(part: list[str]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for needle in part:
                machine.add_word(needle, needle)
            machine.make_automaton()
            for batch in batches:
                keys, found, times = [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    own: dict[str, int] = {}
                    for _, needle in machine.iter(value or ""):
                        own[needle] = own.get(needle, 0) + 1
                    keys += [i] * len(own)
                    found += own
                    times += own.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.string()), pa.array(times, pa.int64())], [key, "needle", "times"])

        return rows.select(key, F.col(text).alias("_text")).mapInArrow(work, f"{key} {kind}, needle string, times long")

    parts = [[r.needle for r in wanted.where(F.pmod(F.xxhash64("needle"), F.lit(passes)) == n).collect()] for n in range(passes)]
    return reduce(DataFrame.unionByName, [one(p) for p in parts if p] or [rows.select(key).where("false").select(key, F.lit("").alias("needle"), F.lit(0).cast("long").alias("times"))])


def symbol_search(symbols: DataFrame, names: DataFrame, key: str, symbol: str, limit: int = 20) -> DataFrame:
    """(name, key, exact): of every names(name) the first `limit` rows by key whose symbol it is, or, where there is none,
    whose symbol contains it. An empty name is contained in every symbol."""
    rows, asked = symbols.select(key, symbol).where(F.col(symbol).isNotNull()), names.select("name").distinct()
    exact = rows.join(asked, F.col(symbol) == F.col("name")).select("name", key, F.lit(True).alias("exact"))
    open_ = asked.join(exact.select("name").distinct(), "name", "left_anti")
    distinct = rows.select(symbol).distinct()
    held = containing(distinct, open_.select(F.col("name").alias("needle")), symbol, symbol).select(F.col("needle").alias("name"), symbol)
    held = held.unionByName(open_.where("name = ''").join(distinct, F.lit(True)).select("name", symbol))
    fuzzy = rows.join(held, symbol).select("name", key, F.lit(False).alias("exact"))
    return top_k(exact.unionByName(fuzzy), ["name"], [key], limit).select("name", key, "exact")


def find_references(chunks: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    """(symbol, id, file_path, times, is_definition) of symbols(symbol): the first `limit` chunks by id that contain it."""
    hits = containing(chunks, symbols.select(F.col("symbol").alias("needle")), "id").withColumnRenamed("needle", "symbol")
    named = chunks.select("id", "file_path", F.col("symbol_name").alias("_own"))
    met = top_k(hits, ["symbol"], ["id"], limit).drop("rank").join(named, "id")
    return met.select("symbol", "id", "file_path", "times", F.coalesce(F.col("_own") == F.col("symbol"), F.lit(False)).alias("is_definition"))


def occurrences(chunks: DataFrame, terms: DataFrame, rare: int = 4, per_term: int = 2) -> DataFrame:
    """(term, file_path, chunks, registered, rare, exact) of terms(term): files whose code has the term outside comments, in
    how many chunks, whether it is registered there, and whether the file is exact evidence.

    A term of at most `rare` files points somewhere; otherwise only files that register it do. At most `per_term` files are
    exact: those that register it first, then those with more chunks, then by path. Documents are left out.
    """
    code = chunks.where(~P.is_doc(F.col("file_path"))).select("id", "file_path", strip_comments(F.col("content")).alias("code"), "content")
    hits = staged(containing(code, terms.select(F.col("term").alias("needle")), "id", "code").select("id", F.col("needle").alias("term")), "hits")
    own = hits.join(rows_of(code.select("id", "file_path", "content"), hits, "id"), "id").withColumn("reg", registers(F.col("content"), F.col("term")))
    files = own.groupBy("term", "file_path").agg(F.count("*").alias("chunks"), F.max("reg").alias("registered"))
    few = F.count("*").over(Window.partitionBy("term")) <= rare
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.col("rare") | F.col("registered")), F.desc("registered"), F.desc("chunks"), "file_path"))
    ranked = files.withColumn("rare", few).withColumn("_n", nth)
    return ranked.select("term", "file_path", "chunks", "registered", "rare", ((F.col("rare") | F.col("registered")) & (F.col("_n") <= per_term)).alias("exact"))


def files_named(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file_path) of names(name): files whose path it is or ends with, from a folder on; they meet by base name."""
    asked = names.select("name").distinct().withColumn("_base", P.basename(F.col("name")))
    own = files.select("file_path").distinct().withColumn("_base", P.basename(F.col("file_path")))
    same = (F.col("file_path") == F.col("name")) | F.col("file_path").endswith(F.concat(F.lit("/"), "name"))
    return own.join(asked, "_base").where(same).select("name", "file_path")


def files_with_stem(files: DataFrame, stems: DataFrame, limit: int | None = None) -> DataFrame:
    """(stem, file_path) of stems(stem): files so called up to the last point, in singular or plural, the first `limit` by path."""
    one = lambda c: F.when(F.length(c) > 1, F.regexp_replace(c, "s$", "")).otherwise(c)
    asked = stems.select("stem").distinct().withColumn("_one", one(F.lower("stem")))
    own = files.select("file_path").distinct().withColumn("_one", one(P.stem_of(F.col("file_path"))))
    met = own.join(asked, "_one").select("stem", "file_path")
    return met if limit is None else top_k(met, ["stem"], ["file_path"], limit).drop("rank")


def files_exact(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of files whose file_path is among paths(file_path)."""
    return files.join(paths.select("file_path").distinct(), "file_path", "left_semi")


def tests_of_stem(files: DataFrame, stems: DataFrame, limit: int = 4) -> DataFrame:
    """(stem, file_path) of stems(stem): files called stem.test.* or stem.spec.*, the first `limit` by path."""
    own = files.select("file_path").distinct().withColumn("_stem", P.test_stem(F.col("file_path"))).where("_stem IS NOT NULL")
    met = own.join(stems.select("stem").distinct(), F.col("_stem") == F.lower("stem")).select("stem", "file_path")
    return top_k(met, ["stem"], ["file_path"], limit).drop("rank")


def without_prefixes(rows: DataFrame, prefixes: list[str], path: str = "file_path") -> DataFrame:
    """rows whose path begins with none of the prefixes."""
    return reduce(lambda df, p: df.where(~F.col(path).startswith(p)), prefixes, rows)


def file_manifest(chunks: DataFrame, order: str) -> DataFrame:
    """(file_path, file_hash): the hash of the last row of every path in that order, of equal ones the greatest."""
    return chunks.groupBy("file_path").agg(F.max_by("file_hash", F.struct(order, "file_hash")).alias("file_hash"))


def distinct_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct().orderBy("file_path")


def line_range(files: DataFrame, start=None, end=None, sensitive: bool = False) -> DataFrame:
    """file_path, start_line, end_line, total_lines, content and error of files(file_path, content): the lines from start to
    end, clamped to the file. Paths that leave the root or may hold secrets are refused."""
    path, lines = F.col("file_path"), F.split("content", "\n", -1)
    outside = path.rlike(r"(^/)|(^|/)\.\.(/|$)")
    error = F.when(outside, "file path escapes the repository root").when(P.is_secret(path) & ~F.lit(sensitive), "refusing to read a file that may contain secrets")
    first = F.greatest(F.lit(1), F.coalesce(start if start is not None else F.lit(None).cast("int"), F.lit(1)))
    last = F.least(F.size(lines), F.coalesce(end if end is not None else F.lit(None).cast("int"), F.size(lines)))
    body = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return files.select("file_path", first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), F.size(lines).alias("total_lines"), F.when(error.isNull(), body).alias("content"), error.alias("error"))


RANGES = "call_id long, nth int, file_path string, start_line long, end_line long, total_lines long, omitted_lines long, error string"


def plan_ranges(requests: DataFrame, per_range: int = 400, per_call: int = 1200) -> DataFrame:
    """What every range of a call gets of its budget: requests(call_id, nth, file_path, start_line, end_line, total_lines,
    null for a missing file) -> RANGES. Ranges are served in order of nth; a range past the end of its file costs nothing."""

    def serve(calls: pd.DataFrame) -> pd.DataFrame:
        left, out = per_call, []
        for r in calls.sort_values("nth").itertuples(index=False):
            if pd.isna(r.total_lines):
                out.append((r.call_id, r.nth, r.file_path, 1, 0, 0, 0, "no such file"))
                continue
            total = int(r.total_lines)
            start, wanted = (1 if pd.isna(r.start_line) else int(r.start_line)), (total if pd.isna(r.end_line) else int(r.end_line))
            if start > total:
                out.append((r.call_id, r.nth, r.file_path, start, max(start, wanted), 0, 0, f"line {start} is past the end of the file ({total} lines)"))
                continue
            start, wanted = max(1, start), min(total, wanted)
            end = min(wanted, start + max(0, min(per_range, left)) - 1)
            left -= max(0, end - start + 1)
            out.append((r.call_id, r.nth, r.file_path, start, end, total, max(0, wanted - max(end, start - 1)), None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RANGES.split(", ")])

    return requests.groupBy("call_id").applyInPandas(serve, RANGES)


def read_ranges(files: DataFrame, requests: DataFrame, per_range: int = 400, per_call: int = 1200) -> DataFrame:
    """RANGES and the content of every requested range of requests(call_id, nth, file_path, start_line, end_line) over
    files(file_path, content). Only line counts go through the budget; the lines are cut out after it."""
    sizes = files.select("file_path", F.size(F.split("content", "\n", -1)).cast("long").alias("total_lines"))
    planned = plan_ranges(requests.join(sizes, "file_path", "left"), per_range, per_call)
    lines = F.split("content", "\n", -1)
    n = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int")
    body = F.array_join(F.slice(lines, F.col("start_line").cast("int"), n), "\n")
    return planned.join(files.select("file_path", "content"), "file_path", "left").select(*planned.columns, F.when(F.col("error").isNull() & (n > 0), body).otherwise("").alias("content"))


def render_ranges(ranges: DataFrame) -> DataFrame:
    """(call_id, text): the blocks of a reply, in order, with pointers to what the budget left out."""
    at = lambda a, b: F.concat("file_path", F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))
    start, end, more = F.col("start_line"), F.col("end_line"), F.col("omitted_lines")
    failed = F.concat(F.lit("### "), "file_path", F.lit("\nerror: "), "error")
    unsent = F.concat(F.lit("### "), at(start, start + more - 1), F.lit(" not sent (this call's line budget is used up; read it separately)"))
    tail = F.when(more > 0, F.concat(F.lit("\n("), more.cast("string"), F.lit(" more lines below: "), at(end + 1, end + more), F.lit(")"))).otherwise("")
    sent = F.concat(F.lit("### "), at(start, end), F.lit(" (of "), F.col("total_lines").cast("string"), F.lit(" lines)\n"), F.regexp_replace("content", r"(?m)[ \t]+$", ""), tail)
    block = F.when(F.col("error").isNotNull(), failed).when(end < start, unsent).otherwise(sent)
    return ranges.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", block.alias("b")))), lambda x: x.b), "\n\n").alias("text"))


def stem_matches(paths: DataFrame, term) -> DataFrame:
    """paths with the column stem_term: the term in singular, for joins on file names."""
    return paths.withColumn("stem_term", short_singular(F.lower(term)))
