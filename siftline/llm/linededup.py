"""Line dedup: winnowed line fingerprints find repeated runs of lines, whose later copies are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_counted, staged

#: A run of at least so many consecutive non-blank lines counts as repeated.
RUN = 3
#: So do fewer lines that have so many words or, as in scripts without spaces, characters.
WORDS = 50
CHARS = 300


def _solid() -> Column:
    """The non-blank lines of a text: raw numbers and trimmed lines."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    return F.filter(F.transform(split, lambda x, i: F.struct(i.alias("no"), F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " ")).alias("line"))), lambda x: x.line != "")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the non-blank lines as arrays: raw line numbers and hashes of the trimmed lines."""
    hashed = F.transform(_solid(), lambda x: F.struct(x.no.alias("no"), F.xxhash64(x.line).alias("hash")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), hashed.alias("lines"))


def _place() -> Column:
    return F.struct("doc_id", "text_hash", F.col("w.start").alias("start")).alias("place")


def _run(hashes) -> Column:
    return F.struct(F.xxhash64(hashes).alias("x"), F.xxhash64(F.lit(7), hashes).alias("y")).alias("run")


def _long_windows(docs: DataFrame, run: int, words: int, chars: int) -> DataFrame:
    """(run, place, nos) of every 1 to run - 1 consecutive non-blank lines that have the words or characters; these are few."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _solid().alias("solid"))
    sized = F.transform("solid", lambda x: F.struct(x.no.alias("no"), F.xxhash64(x.line).alias("hash"), F.regexp_count(x.line, F.lit(r"\S+")).alias("words"), F.length(x.line).alias("chars")))
    sized = lines.select("doc_id", "text_hash", sized.alias("lines"))

    def windows(n: int):
        part = lambda s: F.slice("lines", s + 1, F.lit(n))
        total = lambda s, what: F.aggregate(part(s), F.lit(0), lambda a, x: a + x[what])
        starts = F.slice(F.sequence(F.lit(0), F.size("lines")), F.lit(1), F.greatest(F.size("lines") - (n - 1), F.lit(0)))
        enough = F.filter(starts, lambda s: (total(s, "words") >= words) | (total(s, "chars") >= chars))
        return F.transform(enough, lambda s: F.struct(s.alias("start"), part(s).alias("lines")))

    found = sized.select("doc_id", "text_hash", F.explode(F.concat(*[windows(n) for n in range(1, run)])).alias("w"))
    return found.select(_run(F.transform("w.lines", lambda x: x.hash)), _place(), F.transform("w.lines", lambda x: x.no).alias("nos"))


def repeated_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """(doc_id, text_hash, gone): raw numbers of the lines inside a run of `run` lines that occurs earlier, or of fewer
    lines if they have at least `words` words or `chars` characters together.

    Earlier means in a smaller (doc_id, text_hash), null ids first, or higher up in the same text. Of every `run` consecutive
    line hashes the minimum (the last of equal ones) is a fingerprint, so any two copies of a run share one; only
    fingerprints that occur again are extended, to the runs around them on both sides. The first place of every run is
    a minimum of partial aggregates: places are never paired with each other, however often a run occurs.
    """
    base = _lines(docs).where(F.size("lines") >= run)
    hashes = F.transform("lines", lambda x: x.hash)
    starts = F.sequence(F.lit(0), F.size("lines") - run)
    lowest = F.transform(starts, lambda s: s - F.array_min(F.transform(F.slice("hashes", s + 1, F.lit(run)), lambda h, j: F.struct(h.alias("hash"), (-j).alias("back")))).back)
    marks = F.transform(F.array_distinct("lowest"), lambda p: F.struct(
        p.alias("at"), F.get(F.col("hashes"), p).alias("mark"), F.greatest(p - (run - 1), F.lit(0)).alias("first"),
        F.slice("lines", F.greatest(p - (run - 1), F.lit(0)) + 1, F.lit(run - 1) + F.least(p, F.lit(run - 1)) + 1).alias("near"),
    ))
    picked = base.select("doc_id", "text_hash", "lines", hashes.alias("hashes")).select("doc_id", "text_hash", "lines", "hashes", lowest.alias("lowest"))
    prints = staged(picked.select("doc_id", "text_hash", F.explode(marks).alias("m")).select("doc_id", "text_hash", "m.*"), "fingerprints")
    again = staged(prints.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1"), "marks")
    around = join_counted(prints, again, "mark", "times").select(
        "doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("near") - run), lambda s: F.struct((s + F.col("first")).alias("start"), F.slice("near", s + 1, F.lit(run)).alias("lines")))).alias("w")
    )
    run_hashes = F.transform("w.lines", lambda x: x.hash)
    windows = around.select(_run(run_hashes), _place(), F.transform("w.lines", lambda x: x.no).alias("nos"))
    if run > 1:
        windows = windows.unionByName(_long_windows(docs, run, words, chars))
    windows = staged(windows.distinct(), "runs")
    dropped(prints), dropped(again)
    first = staged(windows.groupBy("run").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1"), "firsts")
    later = join_counted(windows, first, "run", "times").where("place > first")
    return later.select("place.doc_id", "place.text_hash", F.explode("nos").alias("no")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """docs with the columns n_lines and n_removed_lines added and text without repeated runs.

    Blank lines take no part in a run and stay. A run must be `run` non-blank lines long, or have `words` words or
    `chars` characters; lines are compared without white space at their ends. Null texts stay null; empty texts have one
    blank line. Rows that repeat doc_id and text are one document: none of them is an earlier copy of the other, and all
    lose the same lines. A null doc_id comes before all others. Other columns, whatever they are called, are kept; an
    input column n_lines or n_removed_lines gives way to the new one. An empty table gives an empty result.
    """
    gone = repeated_lines(docs, run, words, chars)
    # positions instead of names, so that no column of docs can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    c = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumn("hash", F.xxhash64(c["text"]))
    gone = gone.toDF("gone_id", "gone_hash", "gone")
    out = rows.join(gone, F.col(c["doc_id"]).cast("long").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left")
    split = F.split(c["text"], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col(c["text"])).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    counts = [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines")]
    return out.select(*[(text if name == "text" else F.col(c[name])).alias(name) for name in docs.columns if name not in ("n_lines", "n_removed_lines")], *counts)
