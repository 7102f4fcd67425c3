"""Retrieval operators over batches of queries: vector and keyword candidates, scores, merging, selection."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import clamp01, round_at, tokens
from ..session import dropped, staged

#: Weights of the nine signals.
WEIGHTS = {"semantic": 0.70, "keyword": 0.20, "symbol": 0.10, "path": 0.05, "structural": 0.05, "dependency": 0.08, "reference": 0.08, "test": 0.03, "recency": 0.02}
#: A side of at most so many rows is broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 100_000
#: Numbers of a matrix of queries that goes out to the tasks; more queries take several passes.
CELLS = 1 << 23
#: Queries whose terms the driver holds at a time.
QUERIES = 4096
#: Words that fewer sets than one in so many have are told apart by their hashes only, not by how frequent they are.
RARE = 5000
#: Words of pairs whose sets a task compares at a time, about.
WEIGHT = 1 << 22


def dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def top_k(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of every group; the limit reaches the map side."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col(rank) <= k)


def rows_of(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among those of wanted, which should be written down, as it is read twice. Up to BROADCAST_ROWS keys
    go to the rows, so that these are only scanned; more meet them by a shuffle."""
    keys = wanted.select(key).distinct()
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, key, "left_semi")


def _dealt(queries: DataFrame, most: int) -> list[DataFrame]:
    """Queries in parts of about `most` at most, dealt by a hash of their id; the driver holds one part at a time."""
    k = max(1, -(-queries.count() // max(1, most)))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(k)) == i) if k > 1 else queries for i in range(k)]


def _blocks(rows: list, width: int) -> list[list]:
    """Queries in parts whose matrix of that width has at most CELLS numbers."""
    size = max(1, CELLS // max(1, width))
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries(query_id, q) against vectors(vec_id, embedding): query_id, vec_id, score and rank of the k best by dot product
    in double precision, ties to the smaller id.

    The stated query set meets all vectors in blocks of CELLS numbers: one matrix product a batch, of which a task keeps k
    rows a query, so hardly anything is shuffled. The driver holds one block; the results of several are written down one
    after the other. Vectors of another length than the query's are left out.
    """
    width = queries.agg(F.max(F.size("q")).alias("w")).first().w or 1
    parts = _dealt(queries, CELLS // max(1, width))
    if len(parts) == 1:
        return _nearest(parts[0], vectors, k)
    return reduce(DataFrame.unionByName, [staged(_nearest(part, vectors, k), "nearest") for part in parts])


def _nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    asked = [(r.query_id, r.q) for r in queries.select("query_id", "q").where("q IS NOT NULL AND query_id IS NOT NULL").collect()]
    named = to_arrow_type(queries.schema["query_id"].dataType)
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    parts = []
    for width in sorted({len(q) for _, q in asked}):
        for block in _blocks([x for x in asked if len(x[1]) == width], width):
            names, matrix = [n for n, _ in block], np.array([q for _, q in block], np.float64)

            def work(batches, names=names, matrix=matrix, width=width):
                for batch in batches:
                    rows = pc.list_value_length(batch.column(1))
                    batch = batch.filter(pc.and_(pc.equal(rows, width).fill_null(False), pc.is_valid(batch.column(0))))
                    if not len(batch):
                        continue
                    x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), width)
                    ids = np.asarray(batch.column(0))
                    near = matrix @ x.T
                    out: list[list] = [[], [], []]
                    for i in range(len(names)):
                        own = np.flatnonzero(near[i] >= (np.partition(near[i], -k)[-k] if len(ids) > k else -np.inf) - 1e-9)
                        exact = (x[own] * matrix[i]).sum(axis=1)  # the same sum for the same vector wherever it stands
                        best = own[(order := np.lexsort((ids[own], -exact))[:k])]
                        out[0] += [names[i]] * len(best)
                        out[1] += ids[best].tolist()
                        out[2] += exact[order].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], named), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

            parts.append(vectors.select("vec_id", "embedding").mapInArrow(work, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), ["query_id"], [F.desc("score"), "vec_id"], k)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl): the inverted index of a table."""
    words = docs.select("doc_id", tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "dl")


_WORD = re.compile(r"[a-z0-9_]{3,}")


def _terms_of(queries: DataFrame) -> dict:
    return {r.query_id: list(r.terms) for r in queries.where("query_id IS NOT NULL").select("query_id", F.array_distinct(tokens("text")).alias("terms")).collect()}


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries(query_id, text) -> query_id, doc_id, score (four digits) and rank of the k best of docs(doc_id, text), ties to
    the smaller id.

    Only the queries' own terms are looked at. One pass counts in how many texts each occurs, a second scores every text
    against a block of queries by a matrix product, of which a task keeps k rows a query. Neither shuffles the texts. The
    driver holds QUERIES queries at a time; the results of more are written down one part after the other.
    """
    parts = _dealt(queries, QUERIES)
    if len(parts) == 1:
        return _matched(parts[0], docs, k, k1, b)
    return reduce(DataFrame.unionByName, [staged(_matched(part, docs, k, k1, b), "matches") for part in parts])


def _matched(queries: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    asked = {q: t for q, t in _terms_of(queries).items() if t}
    named = to_arrow_type(queries.schema["query_id"].dataType)
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    if not asked:
        return docs.sparkSession.createDataFrame([], f"{schema}, rank int")
    wanted = {t: i for i, t in enumerate(sorted({t for ts in asked.values() for t in ts}))}

    def count(batches):
        total = np.zeros(len(wanted) + 2, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if text is not None:
                    found = _WORD.findall(text.lower())
                    total[[wanted[w] for w in set(found) if w in wanted]] += 1
                    total[-2:] += 1, len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "n"])

    rows = docs.select("doc_id", "text")
    stats = np.zeros(len(wanted) + 2)
    for r in rows.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        stats[r["at"]] = r.n
    df, n, mean = stats[:-2], stats[-2], stats[-1] / max(1.0, stats[-2])
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    parts = []
    for block in _blocks(list(asked.items()), len(wanted)):
        terms = sorted({t for _, ts in block for t in ts})
        column, names = {t: i for i, t in enumerate(terms)}, [q for q, _ in block]
        matrix = np.zeros((len(terms), len(block)))
        for j, (_, ts) in enumerate(block):
            matrix[[column[t] for t in ts], j] = idf[[wanted[t] for t in ts]]

        def score(batches, column=column, names=names, matrix=matrix):
            for batch in batches:
                batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
                out: list[list] = [[], [], []]
                step = max(1, min(512, CELLS // len(column)))
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    weight = np.zeros((len(part), len(column)))
                    for i, text in enumerate(part.column(1).to_pylist()):
                        found = _WORD.findall(text.lower())
                        for w, tf in Counter(w for w in found if w in column).items():
                            weight[i, column[w]] = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * len(found) / mean))
                    scores, ids = np.floor(weight @ matrix * 10_000 + 0.5) / 10_000, np.asarray(part.column(0))
                    hit = weight.astype(bool).astype(np.float64) @ matrix.astype(bool)
                    for j, name in enumerate(names):
                        own = np.flatnonzero(hit[:, j])
                        best = own[np.lexsort((ids[own], -scores[own, j]))[:k]]
                        out[0] += [name] * len(best)
                        out[1] += ids[best].tolist()
                        out[2] += scores[best, j].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], named), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], ["query_id", "doc_id", "score"])

        parts.append(rows.mapInArrow(score, schema))
    return top_k(reduce(DataFrame.unionByName, parts), ["query_id"], [F.desc("score"), "doc_id"], k)


def idf_share(pool: DataFrame, facets: DataFrame) -> DataFrame:
    """(facet, doc_id, share) of pool(facet, doc_id, text): the part of a facet's words (facets(facet, text)) that a text of its
    pool has, each weighted by ln(1 + pool / (texts of the pool with it + 1)). Pools are bounded by what found them."""
    wanted = facets.select("facet", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    hits = pool.select("facet", "doc_id", F.explode(F.array_distinct(tokens("text"))).alias("term")).join(wanted, ["facet", "term"])
    df = hits.groupBy("facet", "term").agg(F.count("*").alias("df"))
    size = pool.groupBy("facet").agg(F.count("*").cast("double").alias("pool"))
    idf = wanted.join(size, "facet").join(df, ["facet", "term"], "left").withColumn("idf", F.log(1 + F.col("pool") / (F.coalesce("df", F.lit(0)) + 1)))
    idf = idf.withColumn("total", F.sum("idf").over(Window.partitionBy("facet"))).select("facet", "term", "idf", "total")
    return hits.join(idf, ["facet", "term"]).groupBy("facet", "doc_id").agg(round_at(F.sum("idf") / F.max("total"), 4).alias("share"))


def combined(signals: dict[str, Column], factor: Column | None = None, floor: Column | None = None) -> Column:
    """The weighted score, clamped, times a factor, rounded to thousandths, and not below a floor."""
    total = clamp01(sum((F.coalesce(signals[s], F.lit(0.0)) * w for s, w in WEIGHTS.items() if s in signals), F.lit(0.0)))
    total = round_at(total * factor if factor is not None else total, 3)
    return F.greatest(total, round_at(F.coalesce(floor, F.lit(0.0)), 3)) if floor is not None else total


def merge_candidates(rows: DataFrame) -> DataFrame:
    """(query_id, id, total, source, arrival) -> one row of each id: the highest total (ties: the earliest), all sources."""
    best = F.max_by(F.struct("total", "source"), F.struct(F.col("total"), -F.col("arrival")))
    merged = rows.groupBy("query_id", "id").agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return merged.select("query_id", "id", F.col("b.total").alias("total"), F.col("b.source").alias("best_source"), "sources")


def gap_cut(rows: DataFrame, by: str, gap: float = 0.15) -> DataFrame:
    """(by, floor): the score above the first gap of that size among the ranked totals from the third on; 0 without one."""
    w = Window.partitionBy(by).orderBy(F.desc("total"), "id")
    stepped = rows.select(by, "total", (F.row_number().over(w) - 1).alias("i"), F.lag("total").over(w).alias("before"))
    cut = F.min_by("before", F.when((F.col("i") >= 2) & (F.col("before") - F.col("total") >= gap), F.col("i")))
    return stepped.groupBy(by).agg(F.coalesce(cut, F.lit(0.0)).alias("floor"))


def _word_sets(docs: DataFrame, by: str, least: int) -> DataFrame:
    """doc_id, by, the sorted distinct words and their hash of every row with at least so many."""
    sets = docs.select("doc_id", by, F.array_sort(F.array_distinct(tokens("text"))).alias("w")).where(F.size("w") >= least)
    return sets.withColumn("_k", F.sha2(F.array_join("w", " "), 256))


def near_duplicate_classes(docs: DataFrame, by: str, least: int = 12) -> DataFrame:
    """(by, doc_id, class_id): rows of one group with the same distinct words, at least so many, are a class; its id is its
    smallest doc_id."""
    keyed = _word_sets(docs, by, least).drop("w")
    low = keyed.groupBy(by, "_k").agg(F.min("doc_id").alias("class_id"))
    return keyed.join(low, [by, "_k"]).select(by, "doc_id", "class_id")


def _prefixes(sets: DataFrame, by: str, percent: int) -> DataFrame:
    """(key, before, doc_id, n, i, sketch) of the first words of every set (doc_id, by, w) in the order rarest first: a set without
    any of them has no partner of that similarity. key: group and word, before: that of the place before, null at place 0, n: words
    of the set, i: place of the word, from 0.

    The order is the same for all sets: by how many sets have the word, 0 where it is less than one in RARE, then by hash. So
    only the counts of the more frequent words go to the tasks, at most RARE times the mean size of a set, and no word meets its
    count by a shuffle. sketch, at place 0 only: the parity of the words that fall on each of about n bits.
    """
    hashed = sets.select("doc_id", F.xxhash64(by).alias("g"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    counts = hashed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > F.lit(max(1, sets.count() // RARE))).orderBy("h").toArrow()
    frequent = sets.sparkSession.sparkContext.broadcast((counts["h"].to_numpy(), counts["n"].to_numpy()))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        h, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        at = (at - at[0]).astype(np.int64)
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        known, times = frequent.value
        rank = np.zeros(len(h), np.int64)
        if len(known):
            where = np.minimum(np.searchsorted(known, h), len(known) - 1)
            rank = np.where(known[where] == h, times[where], 0)
        order, i = np.lexsort((h, rank, owner)), np.arange(len(h)) - at[owner]
        keep = i <= (n + (-n * percent) // 100)[owner]
        bits = np.int64(1) << np.ceil(np.log2(np.maximum(n, 256))).astype(np.int64)
        start = np.concatenate(([0], np.cumsum(bits)))
        odd = np.bincount(start[owner] + (h & (bits - 1)[owner]), minlength=start[-1]) & 1
        sketches = pa.ListArray.from_arrays(pa.array(start // 64, pa.int32()), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))
        own, i = owner[keep], i[keep]
        key = h[order[keep]] ^ np.asarray(batch.column(1))[own]
        before = pa.array(np.roll(key, 1), mask=i == 0)
        return pa.RecordBatch.from_arrays([pa.array(key), before, batch.column(0).take(pa.array(own)), pa.array(n[own], pa.int64()), pa.array(i, pa.int64()), sketches.take(pa.array(own, mask=i > 0))], ["key", "before", "doc_id", "n", "i", "sketch"])

    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                yield part(batch.slice(at, 1024))

    return hashed.mapInArrow(work, f"key long, before long, doc_id {sets.schema['doc_id'].dataType.simpleString()}, n long, i long, sketch array<long>")


def _parted(x: str, y: str) -> str:
    """SQL: bits in which two sketches differ, the longer one folded to the length of the shorter. Sets differ in so many words at least."""
    size = f"least(size({x}), size({y}))"
    folded = lambda s: f"IF(size({s}) = {size}, {s}, transform(sequence(1, {size}), j -> aggregate(sequence(j, size({s}), {size}), 0L, (t, m) -> t ^ element_at({s}, m))))"
    return f"aggregate(zip_with({folded(x)}, {folded(y)}, (u, v) -> bit_count(u ^ v)), 0, (t, c) -> t + c)"


def _compared(percent: int):
    """Function of the pairs (a, b) of a cell and its sets (doc_id, by, w: words with blanks between): a, b and shared of pairs of one group with
    that similarity."""

    def work(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        pairs, sets = pairs.combine_chunks(), sets.combine_chunks()
        ids = [np.asarray(pairs["a"]), np.asarray(pairs["b"]), np.asarray(sets["doc_id"])]
        at = np.unique(np.concatenate(ids), return_inverse=True)[1]
        a, b, own = np.split(at, [len(pairs), 2 * len(pairs)])
        rows = np.argsort(own, kind="stable")
        low, high = ([np.searchsorted(own[rows], x, side) for x in (a, b)] for side in ("left", "right"))
        times = [h - l for l, h in zip(low, high)]  # an id can stand for several sets
        of = np.repeat(np.arange(len(pairs)), times[0] * times[1])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times[0] * times[1]) - times[0] * times[1], times[0] * times[1])
        x, y = rows[low[0][of] + nth // times[1][of]], rows[low[1][of] + nth % times[1][of]]
        order = np.argsort(x, kind="stable")
        x, y, of = x[order], y[order], of[order]
        lists = pc.split_pattern(pa.concat_arrays(sets["w"].chunks), " ")
        words, start = lists.flatten().dictionary_encode(), np.asarray(lists.offsets).astype(np.int64)
        codes, n = np.asarray(words.indices), np.diff(start)
        has, shared = np.zeros(len(words.dictionary), np.int64), np.zeros(len(x), np.int64)
        ends = np.cumsum(n[y])
        cuts = np.flatnonzero(np.diff(x, prepend=-1) | np.diff(ends // (1 << 20), prepend=0))  # of one x, at most so many words or one set
        for lo, hi in zip(cuts, [*cuts[1:], len(x)]):
            mine, other = codes[start[x[lo]] : start[x[lo] + 1]], y[lo:hi]
            has[mine] = 1
            first = np.cumsum(n[other]) - n[other]
            shared[lo:hi] = np.add.reduceat(has[codes[np.repeat(start[other] - first, n[other]) + np.arange(n[other].sum())]], first)
            has[mine] = 0
        one = pc.equal(sets["by"].take(pa.array(x)), sets["by"].take(pa.array(y))).fill_null(False)
        good = np.flatnonzero(np.asarray(one) & (100 * shared >= percent * (n[x] + n[y] - shared)))
        rows = pa.array(of[good])
        return pa.table([pairs["a"].take(rows), pairs["b"].take(rows), pa.array(shared[good])], ["a", "b", "shared"])

    return work


def near_duplicate_pairs(docs: DataFrame, by: str | None = None, percent: int = 80, least: int = 1, copies: bool = False) -> DataFrame:
    """(a, b, shared) of classes of one group (see near_duplicate_classes()) whose distinct words have that similarity; without by,
    all rows are one group. With copies, every further row of a class too, as b of its class id. A row without words is like none.

    Texts are cut into words once, and equal sets stand in the search once, so copies are never paired. A pair of that
    similarity shares a word among the rarest of each, and from the first such word on both have words enough: only those
    prefixes are joined, and a pair whose words before are the same too has been met there. Pairs whose sketches differ in more
    bits than such sets do in words are dropped; whole word sets are compared for what is left. None of this loses a pair.

    A set goes to the cells of its pairs, not to every pair: a cell has the pairs of one or more leads, the smallest partner of
    a. What a lead has beyond WEIGHT words is dealt to a square of cells by a and b, so a large group is no single task's.
    """
    grouped = docs.select("doc_id", (F.col(by) if by else F.lit(0)).alias("by"), "text").where("by IS NOT NULL")
    every = staged(_word_sets(grouped, "by", least), "word sets")
    low = every.groupBy("by", "_k").agg(F.min("doc_id").alias("class_id"))
    whole = F.when(F.col("doc_id") == F.col("class_id"), F.col("w")).alias("w")
    classed = staged(every.join(low, ["by", "_k"]).select("doc_id", "by", "class_id", F.size("w").cast("long").alias("n"), whole), "first of equals")
    dropped(every)
    sets, further = classed.where("doc_id = class_id").select("doc_id", "by", "w"), classed.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("shared"))
    further = staged(further, "copies") if copies else None
    prefix = staged(_prefixes(sets, "by", percent), "prefixes")
    left, right = ([F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "i", "before")]] for x in "ab")
    met = prefix.select("key", *left).join(prefix.select("key", *right), "key").where("a < b AND coalesce(beforea <> beforeb, true)")
    met = met.where((100 + percent) * F.least(F.expr("na - ia"), F.expr("nb - ib")) >= percent * F.expr("na + nb")).select("a", "b").repartition("a").distinct()
    for x in "ab":
        met = met.join(prefix.where("i = 0").select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
    close = met.where((100 + percent) * F.expr(_parted("sa", "sb")) <= (100 - percent) * F.expr("na + nb"))
    pairs = staged(close.groupBy("a", "b").agg(F.max(F.expr("na + nb")).alias("n")), "pairs")
    dropped(prefix)
    lead = pairs.select("a", F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.min("a").alias("lead"))
    led = staged(pairs.join(lead.withColumnRenamed("x", "a"), "a"), "led pairs")
    total = led.agg(F.sum("n").alias("n")).first().n or 0
    large = led.groupBy("lead").agg(F.ceil(F.sqrt(F.sum("n") / WEIGHT)).alias("k")).where("k > 1")  # total / WEIGHT rows at most
    side = lambda x: F.pmod(F.xxhash64(x), F.coalesce("k", F.lit(1)))
    cell = F.pmod(F.xxhash64("lead", side("a"), side("b")), F.lit(total // WEIGHT + 1))
    dealt = staged(led.join(F.broadcast(large), "lead", "left").select("a", "b", cell.alias("cell")), "dealt pairs")
    dropped(led)
    needed = dealt.select(F.col("cell").alias("to"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = staged(rows_of(sets, needed, "doc_id").withColumn("w", F.array_join("w", " ")), "sets of pairs")
    dropped(classed)
    kind = held.schema["doc_id"].dataType.simpleString()
    found = dealt.groupBy("cell").cogroup(needed.join(held, "doc_id").groupBy("to")).applyInArrow(_compared(percent), f"a {kind}, b {kind}, shared long")
    return found.unionByName(further) if copies else found


def interval_overlaps(rows: DataFrame, by: str, share: float = 0.5) -> DataFrame:
    """(a, b) of intervals (id, lo, hi) of one group that share at least that part of the shorter one; b starts at or after a.

    Intervals are sorted into tiers by the power of two of their length, and dealt within a tier to the buckets of that
    width that they touch, three at most. An interval meets those of its own and of every longer tier in the buckets of that
    tier, so a few very long ones are not dealt to many buckets, and no group is one key.
    """
    size = F.col("hi") - F.col("lo")
    tier = F.ceil(F.log2(size.cast("double"))).cast("int")
    wide = rows.where("hi > lo").select(by, "id", "lo", "hi", tier.alias("tier"))
    tiers = sorted(r.tier for r in wide.select("tier").distinct().collect())
    known = F.array(*[F.lit(t) for t in tiers]) if tiers else F.array().cast("array<int>")
    buckets = lambda t: F.sequence(F.floor(F.col("lo") / F.pow(F.lit(2.0), t)), F.floor(F.col("hi") / F.pow(F.lit(2.0), t)))
    own = wide.select(by, "id", "lo", "hi", "tier", F.explode(buckets(F.col("tier"))).alias("bucket"))
    seen = wide.select(by, "id", "lo", "hi", F.col("tier").alias("own"), F.explode(F.filter(known, lambda t: t >= F.col("tier"))).alias("tier")).select(by, "id", "lo", "hi", "own", "tier", F.explode(buckets(F.col("tier"))).alias("bucket"))
    x = seen.select(by, "tier", "bucket", *[F.col(c).alias(f"x_{c}") for c in ("id", "lo", "hi", "own")])
    y = own.select(by, "tier", "bucket", *[F.col(c).alias(f"y_{c}") for c in ("id", "lo", "hi")])
    first = (F.col("x_lo") < F.col("y_lo")) | ((F.col("x_lo") == F.col("y_lo")) & (F.col("x_id") < F.col("y_id")))
    shared = F.least("x_hi", "y_hi") - F.greatest("x_lo", "y_lo")
    enough = shared >= share * F.least(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    met = x.join(y, [by, "tier", "bucket"]).where((F.col("x_id") != F.col("y_id")) & ((F.col("x_own") < F.col("tier")) | first) & enough)
    return met.select(by, F.when(first, F.col("x_id")).otherwise(F.col("y_id")).alias("a"), F.when(first, F.col("y_id")).otherwise(F.col("x_id")).alias("b")).distinct()


def expand(frontier: DataFrame, edges: DataFrame, fan_out: int, hops: int) -> DataFrame:
    """(id, hop) reached from frontier(id) over edges(src, dst), at most fan_out smallest targets from each node a hop."""
    seen = frontier.select("id").distinct().withColumn("hop", F.lit(0))
    now = seen.select("id")
    for hop in range(1, hops + 1):
        step = top_k(now.join(edges, F.col("id") == F.col("src")).select("src", "dst").distinct(), ["src"], ["dst"], fan_out)
        now = step.select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(now.withColumn("hop", F.lit(hop)))
    return seen
