"""Benchmark decontamination: documents scanned for the word windows of a test set (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: At most so many distinct windows (about 200 bytes each) are scanned for at a time; a larger set takes several passes.
BROADCAST_WINDOWS = 50_000


def words_of(text):
    """Words of letters and digits, A-Z lower-cased; none for null."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), f"{SEPARATOR}+"), "")


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Distinct windows of the items: (w_words, w_items, w_len, w_hash). An item of fewer words, but not none, is one
    window; w_hash is the hash of the hashes of its words."""
    n = F.size("words")
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
        .where(n > 0)
        .select("item", "words", F.least(n, F.lit(width)).alias("w_len"))
        .select("item", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("w_len") + 1), lambda i: F.slice("words", i, F.col("w_len")))).alias("w_words"))
        .groupBy("w_words")
        .agg(F.array_sort(F.collect_set("item")).alias("w_items"))
        .withColumn("h", F.transform("w_words", lambda w: F.xxhash64(w)))
        .select("w_words", "w_items", F.size("w_words").alias("w_len"), F.when(F.size("h") == width, _window_hash(F.lit(0), width)).otherwise(_shorter(width)).alias("w_hash"))
    )


def _window_hash(at, length: int):
    """Hash of the word hashes h[at : at + length]; words are looked up one by one, as a slice would copy the whole array."""
    return F.xxhash64(*[F.get(F.col("h"), at + k) for k in range(length)])


def _shorter(width: int):
    return F.coalesce(*[F.when(F.size("h") == n, _window_hash(F.lit(0), n)) for n in range(1, width)], F.lit(0).cast("long"))


def _hits(length: int, hashes: list[int]):
    """(at, hash, len) of the windows of h of that length whose hash is in the set."""
    starts = F.slice(F.sequence(F.lit(0), F.size("h")), F.lit(1), F.greatest(F.size("h") - (length - 1), F.lit(0)))
    scanned = F.transform(starts, lambda i: F.struct(i.alias("at"), _window_hash(i, length).alias("hash"), F.lit(length).alias("len")))
    return F.filter(scanned, lambda x: x.hash.isin(hashes))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit, n_items, items, spans (word positions), contaminated.

    Every window of words of a text is hashed and looked up in the set of the benchmark's window hashes, inside the row;
    only hits leave it, with their words, and are verified word by word against the broadcast windows. A set of more than
    BROADCAST_WINDOWS windows is cut by hash into parts of that size, each scanned for in a pass of its own: what goes out
    to the tasks never grows beyond the bound.
    Null and empty texts have no words. Rows that repeat doc_id and text give equal rows, as many as there are; rows that
    share a doc_id but not the text are judged apart; a null doc_id is a value like any other. An empty benchmark hits
    nothing. Items with a null item_id hit words but are not counted as items. Other columns are not read.
    """
    windows = staged(benchmark_windows(benchmark, width), "windows")
    passes = max(1, -(-windows.count() // BROADCAST_WINDOWS))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).select("doc_id", "text_hash", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    kept = None
    for k in range(passes):
        part = windows.where(F.pmod("w_hash", F.lit(passes)) == k) if passes > 1 else windows
        known: dict[int, list[int]] = {}
        for r in part.select("w_len", "w_hash").collect():
            known.setdefault(r.w_len, []).append(r.w_hash)
        hits = [_hits(length, hashes) for length, hashes in sorted(known.items())]
        none = F.array().cast("array<struct<at:int,hash:bigint,len:int>>")
        found = base.select("doc_id", "text_hash", "words", F.size("words").cast("long").alias("n_words"), (F.concat(*hits) if hits else none).alias("hits"))
        with_words = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x.hash.alias("hash"), F.slice("words", x["at"] + 1, x.len).alias("words")))
        row = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("array<string>").alias("words")))  # stands for the row itself
        hit = found.select("doc_id", "text_hash", "n_words", F.explode(F.concat(row, with_words) if k == 0 else with_words).alias("x"))
        same = (F.col("x.hash") == F.col("w.w_hash")) & (F.col("x.words") == F.col("w.w_words"))
        met = hit.alias("s").join(F.broadcast(part).alias("w"), same, "left").where(F.col("x.at").isNull() | F.col("w.w_hash").isNotNull())
        span = F.when(F.col("w.w_hash").isNotNull(), F.struct(F.col("x.at").alias("at"), (F.col("x.at") + F.col("w.w_len")).alias("end")))
        rows = met.select("s.doc_id", "s.text_hash", "s.n_words", F.col("x.at").isNull().alias("own"), span.alias("span"), "w.w_items")
        kept = rows if kept is None else kept.unionByName(rows)
    per_doc = kept.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(F.when(F.col("own"), 1)).cast("int").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items")
    )
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a.hit + F.greatest(s.end - F.greatest(s["at"], a.end), F.lit(0))).cast("long").alias("hit"), F.greatest(a.end, s.end).alias("end"))).hit
    out = per_doc.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"))
    return out.drop("_copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", width: int = 10) -> DataFrame:
    """docs without contaminated rows (mode "document"), or with the hit words cut out of text (mode "span").

    Every column of docs is kept as it is; in span mode text alone changes, and a document all of whose words are hit
    keeps its row with what separated them. Repeated rows share their document's fate.
    """
    hits = contamination(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("spans").alias("_hit_spans")).dropDuplicates(["_hit_id", "_hit_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_hash"))
    if mode == "document":
        return docs.join(hits, same, "left_anti")
    if mode != "span":
        raise ValueError(f"mode is document or span, not {mode!r}")
    gone = F.flatten(F.transform("_hit_spans", lambda s: F.sequence(s["at"], s.end - 1)))
    parts = F.regexp_extract_all("text", F.lit(f"{SEPARATOR}*[^{SEPARATOR[1:]}+"), F.lit(0))
    tail = F.regexp_extract("text", f"{SEPARATOR}*$", 0)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    rest = F.concat(F.array_join(F.transform(left, lambda i: F.get(parts, i)), ""), tail)
    out = docs.join(hits, same, "left")
    return out.withColumn("text", F.when(F.col("_hit_id").isNull() & F.col("_hit_hash").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
