"""Near-duplicate documents: a chosen-path similarity join over word shingles, verified on whole sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, join_counted, staged
from .components import connected
from .kernels import buffers, shingles, word_hashes

BITS = 256
ROWS, PART = 512, 1 << 12  # texts and shingles that a worker holds the hashes of at a time
#: Bits in which a set may differ from a node's head to be of its core (similarity about 0.6), or a member (about 0.2).
CORE, MEMBER = 52, 100
SKETCH = [f"s{i}" for i in range(BITS // 64)]
PARITY = [f"p{i}" for i in range(8)]
#: Shingles whose counts go to the tasks, at most: those that are more than one in so many of all.
RANKED = 1 << 18


@dataclass(frozen=True)
class Paths:
    """Shape of the forest. A pair at the threshold is missed by one tree with probability under 0.1, by all under 1e-5."""

    trees: int = 5
    levels: int = 4
    branch: int = 2  # minwise tokens that a document follows at every node
    leaf: int = 16  # nodes of at most so many sets are compared exhaustively
    block: int = 256  # side of the blocks in which larger groups (of a star, or with one shingle) are compared


@lru_cache
def _functions(paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(0, 1 << 32, size=(2, BITS + paths.trees * paths.levels), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def sketch(found: np.ndarray, paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """A 256-bit sketch (one bit of each minhash) and the minwise tokens by tree, level and branch."""
    a, b = _functions(paths)
    bits, heads, tails = None, [], []
    for at in range(0, len(found), PART):
        x = (found[at : at + PART] >> np.uint64(32)).astype(np.uint32)
        h = x[None, :] * a[:, None] + b[:, None]
        low = h[:BITS].min(axis=1)
        bits = low if bits is None else np.minimum(bits, low)
        own = h[BITS:]
        if own.shape[1] > paths.branch:
            pick = np.argpartition(own, paths.branch - 1, axis=1)[:, : paths.branch]
        else:
            pick = np.minimum(np.arange(paths.branch)[None, :], own.shape[1] - 1).repeat(len(own), 0)
        heads.append(np.take_along_axis(own, pick, 1))
        tails.append(x[pick])
    head, tail = np.concatenate(heads, 1), np.concatenate(tails, 1)
    order = np.argsort(head, axis=1, kind="stable")[:, : paths.branch]
    tokens = np.take_along_axis(tail, order, 1)
    packed = np.packbits(((bits * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)).view(np.int64)
    return packed, tokens.view(np.int32).ravel()


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The shingle sets of a batch's texts, of which ROWS are cut into words at a time."""
    column = batch.column(batch.schema.get_field_index("text"))
    for first in range(0, len(batch), ROWS):
        hashes, at = word_hashes(*buffers(column.slice(first, ROWS)))
        for i in range(len(at) - 1):
            yield shingles(hashes[at[i] : at[i + 1]], k)


def signatures(docs: DataFrame, k: int, paths: Paths) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null without words), bits, tokens of every row."""

    def work(batches):
        for batch in batches:
            n, keys, bits, tokens = [], [], [], []
            for found in _sets(batch, k):
                n.append(len(found))
                x, t = sketch(found, paths) if len(found) else (np.zeros(BITS // 64, np.int64), np.zeros(0, np.int32))
                keys.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                bits.append(x), tokens.append(t)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tokens]))), pa.int32()), pa.array(np.concatenate([*tokens, np.zeros(0, np.int32)]), pa.int32()))
            wide = np.array(bits, np.int64).reshape(-1, BITS // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *[pa.array(c) for c in np.ascontiguousarray(wide.T)], flat], ["doc_id", "text_hash", "n_shingles", "set_key", *SKETCH, "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, f"doc_id long, text_hash long, n_shingles long, set_key binary, {', '.join(f'{c} long' for c in SKETCH)}, tokens array<int>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """set_key and the whole shingle set of every row with words."""

    def work(batches):
        for batch in batches:
            found = [x for x in _sets(batch, k) if len(x)]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in part]))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x.tobytes()).digest() for x in part], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part).view(np.int64)))], ["set_key", "shingles"])

    return docs.select("text").mapInArrow(work, "set_key binary, shingles array<long>")


def _apart(left: str, right: str, bits: list[str] = SKETCH) -> str:
    return " + ".join(f"bit_count({left}.{c} ^ {right}.{c})" for c in bits)


def _close(left: str, right: str, bound: int) -> str:
    """Sizes that allow the similarity, and sketches no farther apart than such a pair is, plus six standard deviations."""
    p = (1 - bound / 100) / 2
    far = round(BITS * p + 6 * (BITS * p * (1 - p)) ** 0.5)
    return f"100 * least({left}.n, {right}.n) >= {bound} * greatest({left}.n, {right}.n) AND {_apart(left, right)} <= {far}"


def candidates(sets: DataFrame, bound: int, paths: Paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of set keys worth verifying; stars (head, key, core); and what the deepest nodes still hold.

    A node of at most paths.leaf sets is compared exhaustively. In a larger one every set is compared with the node's
    first set, its head. Sets like the head are its core and leave the recursion, since no choice of tokens would part
    them: they are to be compared with all members, the sets that are at all like the head. All sets but the core
    follow their next minwise tokens to the level below. What follows is written down, as it is read three times there: a
    set stands in at most paths.trees * paths.branch ** level rows of a level, however large its nodes are.
    """
    me = F.struct(F.col("set_key").alias("key"), F.col("n_shingles").alias("n"), *SKETCH).alias("me")
    per = paths.levels * paths.branch
    rows = sets.select(me, F.explode(F.expr(f"transform(sequence(0, {paths.trees - 1}), t -> struct(t AS tree, slice(tokens, t * {per} + 1, {per}) AS path))")).alias("p"))
    rows = rows.select("me", F.expr("p.path").alias("path"), F.explode(F.array_distinct(F.expr(f"slice(p.path, 1, {paths.branch})"))).alias("token"), F.expr("p.tree").alias("tree"))
    rows = rows.select(F.xxhash64("tree", "token").alias("node"), "me", F.slice("path", paths.branch + 1, per).alias("path"))
    pairs, stars = [], []
    for level in range(1, paths.levels + 1):
        counted = staged(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("me").alias("head")).where("size > 1"), f"nodes{level}")
        met = staged(join_counted(rows, counted, "node", "size").withColumn("apart", F.expr(_apart("head", "me"))), f"level{level}")
        dropped(counted), dropped(rows)
        leaf = met.where(F.col("size") <= paths.leaf).groupBy("node").agg(F.array_sort(F.collect_list("me")).alias("all"))
        inside = F.expr(f"flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, {paths.leaf}), y -> {_close('x', 'y', bound)}), y -> struct(x.key AS a, y.key AS b))))")
        pairs.append(leaf.select(F.explode(inside).alias("p")).select("p.a", "p.b"))
        large = met.where(F.col("size") > paths.leaf)
        near = large.where((F.col("apart") <= MEMBER) & (F.col("me.key") != F.col("head.key")))
        pairs.append(near.where(_close("head", "me", bound)).select(F.col("head.key").alias("a"), F.col("me.key").alias("b")))
        stars.append(near.select(F.col("head.key").alias("head"), F.col("me.key").alias("key"), (F.col("apart") <= CORE).alias("core")))
        rest = large.where((F.col("apart") > CORE) & (F.col("me.key") != F.col("head.key")))
        if level < paths.levels:
            rows = rest.select("node", "me", "path", F.explode(F.array_distinct(F.slice("path", 1, paths.branch))).alias("token"))
            rows = staged(rows.select(F.xxhash64("node", "token").alias("node"), "me", F.slice("path", paths.branch + 1, per).alias("path")), f"rows{level + 1}")
    every, around = reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, stars)
    return every.distinct(), around.groupBy("head", "key").agg(F.max("core").alias("core")), rest.select("node", "me", "size")


def _sets_of(keys: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """set_key and shingles of the keys(set_key), computed again from one text of each."""
    rows = sets.join(keys, "set_key", "left_semi").select("rep").distinct()
    whole = whole_sets(docs.select("doc_id", "text").join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["rep"]), "left_semi"), k).dropDuplicates(["set_key"])
    return staged(whole.join(keys, "set_key", "left_semi"), "sets")


def within_stars(stars: DataFrame, links: DataFrame, whole: DataFrame, bound: int, paths: Paths) -> DataFrame:
    """Links (a, b) that connect, within each star, what the links of its head don't connect yet.

    Core sets meet all members of their star in blocks of paths.block a side, whole sets in hand. Sets linked to the
    head are connected already and are not compared with each other. A block returns a spanning forest of its links.
    """
    tied = links.select(F.col("a").alias("head"), F.col("b").alias("key"), F.lit(True).alias("tied"))
    known = staged(stars.join(tied, ["head", "key"], "left").select("head", "key", "core", F.coalesce("tied", F.lit(False)).alias("tied")), "stars")
    open_ = known.groupBy("head").agg(
        F.count("*").alias("size"), F.count(F.when(F.col("core") & ~F.col("tied"), 1)).alias("loose"), F.count(F.when(F.col("core"), 1)).alias("cores"), F.count(F.when(~F.col("core") & ~F.col("tied"), 1)).alias("fringe")
    ).where("size > 1 AND (loose > 0 OR (cores > 0 AND fringe > 0))").select("head", F.ceil(F.col("size") / paths.block).cast("int").alias("blocks"), "fringe")
    rows = known.join(open_, "head").join(whole.withColumnRenamed("set_key", "key"), "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where("core AND (NOT tied OR fringe > 0)").select("head", F.col("block").alias("i"), spread.alias("j"), "key", "tied", "shingles")
    right = rows.select(F.col("head").alias("y_head"), spread.alias("y_i"), F.col("block").alias("y_j"), F.col("key").alias("y_key"), F.col("tied").alias("y_tied"), F.col("core").alias("y_core"), F.col("shingles").alias("y_shingles"))

    def meet(xs: pa.Table, ys: pa.Table) -> pa.Table:
        a: list = []
        b: list = []
        if len(xs) and len(ys):
            keys, y_tied, y_core = ys["y_key"].to_pylist(), np.asarray(ys["y_tied"]), np.asarray(ys["y_core"])
            flat = ys["y_shingles"].combine_chunks()
            sizes = np.diff(np.asarray(flat.offsets))
            owner = np.repeat(np.arange(len(keys)), sizes)
            values, place = np.unique(np.asarray(flat.flatten()), return_inverse=True)
            parent = {key: ("tied" if t else key) for key, t in zip(keys, y_tied, strict=True)}

            def root(x):
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            x_flat = xs["shingles"].combine_chunks()
            at, x_values = np.asarray(x_flat.offsets), np.asarray(x_flat.flatten())
            at = at - at[0]
            for n, (key, tied_) in enumerate(zip(xs["key"].to_pylist(), xs["tied"].to_pylist(), strict=True)):
                own = x_values[at[n] : at[n + 1]]
                if tied_:
                    parent[key] = "tied"
                    wanted = ~y_tied & ~y_core
                    if not wanted.any():
                        continue
                else:
                    wanted = None
                hit = np.zeros(len(values), bool)
                where = np.searchsorted(values, own)
                where[where == len(values)] = 0
                hit[where[values[where] == own]] = True
                both = np.bincount(owner, hit[place], len(keys))
                like = 100 * both >= bound * (sizes + len(own) - both)
                for m in np.flatnonzero(like if wanted is None else like & wanted).tolist():
                    if (x := root(key)) != (y := root(keys[m])):
                        parent[y if x == "tied" else x] = x if x == "tied" else y
                        a.append(key), b.append(keys[m])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    met = left.groupBy("head", "i", "j").cogroup(right.groupBy("y_head", "y_i", "y_j")).applyInArrow(meet, "a binary, b binary")
    return staged(met.where("a <> b"), "starlinks")


def verified(pairs: DataFrame, whole: DataFrame, bound: int) -> DataFrame:
    """The pairs whose whole shingle sets satisfy 100 * intersection >= bound * union."""
    met = pairs.join(whole.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), "a").join(whole.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(met.where(100 * both >= bound * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, paths: Paths = Paths()) -> DataFrame:  # noqa: B008
    """Per row of docs: doc_id, text_hash, n_shingles, root, component_id, kept.

    A document's set holds its distinct k-word shingles (fewer words: the whole sequence as one). Rows with equal sets
    are one class and stand in the search once, however many they are; classes whose sets have a Jaccard similarity of
    percent / 100 or more are linked; component_id is the smallest doc_id of the connected classes (root names them),
    and kept tells whether the row bears it.
    Null, empty and blank texts have no set: n_shingles 0, linked with nothing, kept. A null doc_id takes part like
    any other row and is kept only where its whole component has null ids. Rows that repeat a doc_id are judged by
    their own texts. An empty table gives an empty result; other columns are not read.
    """
    own = staged(signatures(docs, k, paths), "signatures")
    sets = staged(own.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", *SKETCH, "tokens")]), "classes")
    found, stars, deep = candidates(sets, percent, paths)
    found, stars = staged(found, "pairs"), staged(stars, "stars")
    whole = _sets_of(_ends(found).unionByName(stars.select(F.col("key").alias("set_key"))).distinct(), docs, sets, k)
    links = verified(found, whole, percent)
    links = links.unionByName(within_stars(stars, links, whole, percent, paths))
    roots = connected(links)
    deep = deep.join(roots.select(F.col("node").alias("key"), "root"), F.col("me.key") == F.col("key"), "left").select("node", "me", "size", F.coalesce("root", "me.key").alias("root"))
    mixed = deep.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("node")
    rest = staged(deep.join(mixed, "node", "left_semi").select("me", "root").distinct(), "rest")
    if not rest.isEmpty():
        whole = _sets_of(rest.select(F.col("me.key").alias("set_key")), docs, sets, k)
        more = _prefix_pairs(rest, whole, percent, paths)
        if not more.isEmpty():
            links = links.unionByName(verified(more, whole, percent))
            roots = connected(links)
    sized = sets.select("set_key", "rep").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    low = staged(sized.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "roots")
    classes = staged(join_counted(sized, low, "root", "size").select("set_key", "root", "component_id"), "components")
    dropped(low)
    named = own.select("doc_id", "text_hash", "n_shingles", "set_key")
    filled = named.where("set_key IS NOT NULL").join(classes, "set_key").select("doc_id", "text_hash", "n_shingles", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    blank = named.where("set_key IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("set_key").alias("root"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return filled.unionByName(blank)


def _frequent(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are more than one in RANKED of all those of whole, sorted, and how many sets have each."""

    def work(batches):
        for batch in batches:
            h, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    total = whole.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first().n
    counts = whole.select("shingles").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, total // RANKED)).toArrow()
    h, n = counts["h"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(rest: DataFrame, whole: DataFrame, bound: int) -> DataFrame:
    """(token, place, key, root, n, SKETCH, PARITY) of the first shingles of every set of rest, in the order rarest first.

    The order is the same for all sets: by the counts of _frequent(), 0 for rarer ones, then by hash. A set whose first
    n - ceil(n * bound / 100) + 1 shingles are met by no other has no partner. PARITY: whether an odd number of the set's
    shingles falls on each bit, so that two sets differ in as many shingles as they do in bits, at least.
    """
    frequent, wide = whole.sparkSession.sparkContext.broadcast(_frequent(whole)), 64 * len(PARITY)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(len(SKETCH) + 2)
        h, at = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)
        at = at - at[0]
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        known, times = frequent.value
        rank = np.zeros(len(h), np.int64)
        if len(known):
            where = np.minimum(np.searchsorted(known, h), len(known) - 1)
            rank = np.where(known[where] == h, times[where], 0)
        order, place = np.lexsort((h, rank, owner)), np.arange(len(h)) - at[owner]
        odd = np.bincount(owner * wide + (h & (wide - 1)), minlength=len(n) * wide) & 1
        parity = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, len(PARITY))
        keep = place <= (n + (-n * bound) // 100)[owner]
        own = owner[keep]
        row = [batch.column(i).take(pa.array(own)) for i in range(len(SKETCH) + 2)]
        return pa.RecordBatch.from_arrays([pa.array(h[order[keep]]), pa.array(place[keep]), pa.array(n[own]), *row, *[pa.array(x) for x in np.ascontiguousarray(parity[own].T)]], ["token", "place", "n", "key", "root", *SKETCH, *PARITY])

    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield part(batch.slice(at, 256))

    rows = rest.select(F.col("me.key").alias("set_key"), "root", *[f"me.{c}" for c in SKETCH]).join(whole, "set_key").select("set_key", "root", *SKETCH, "shingles")
    return rows.mapInArrow(work, f"token long, place long, n long, key binary, root binary, {', '.join(f'{c} long' for c in SKETCH + PARITY)}")


def _prefix_pairs(rest: DataFrame, whole: DataFrame, bound: int, paths: Paths) -> DataFrame:
    """The pairs across components of all sets of rest(me, root) that no bound rules out; none of them is drawn or capped.

    Sets meet where they share one of the shingles that come first in both (see _prefixes()), in blocks of about paths.block
    sets a side where many have it. From the first such shingle on both must have shingles enough, and their parities may
    not differ in more bits than linked sets do in shingles. Neither loses a pair.
    """
    prefix = staged(_prefixes(rest, whole, bound), "prefixes")
    counted = staged(prefix.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "tokens")
    blocks = F.ceil(F.col("size") / paths.block)
    me = F.struct("key", "place", "n", *SKETCH, *PARITY).alias("me")
    cut = join_counted(prefix, counted, "token", "size").select("token", me, "root", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).alias("block"))
    left = cut.select("token", "me", "root", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    right = cut.select("token", F.col("me").alias("you"), F.col("root").alias("your_root"), F.col("block").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("block"))
    met = left.join(right, ["token", "block", "other"]).where("root <> your_root AND (block <> other OR me.key < you.key)").where(_close("me", "you", bound))
    met = met.where(f"{100 + bound} * least(me.n - me.place, you.n - you.place) >= {bound} * (me.n + you.n)").where(f"{100 + bound} * ({_apart('me', 'you', PARITY)}) <= {100 - bound} * (me.n + you.n)")
    more = staged(met.select(F.least("me.key", "you.key").alias("a"), F.greatest("me.key", "you.key").alias("b")).distinct(), "more")
    dropped(prefix), dropped(counted)
    return more


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest doc_id; all columns stay as they are.

    Rows without words are kept. Where that doc_id stands on several texts of its group, the one whose hash is smallest
    stays; rows that repeat doc_id and text are one document, of which one row stays.
    """
    kept = near_duplicates(docs, k, percent).where("kept")
    full = kept.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("_k")).select("_k")
    blank = kept.where("root IS NULL").select(F.struct("doc_id", "text_hash").alias("_k"))
    keys = staged(full.unionByName(blank).select(F.col("_k.doc_id").alias("_keep_id"), F.col("_k.text_hash").alias("_keep_hash")), "keep")
    rows = docs.withColumn("_keep_hash", F.xxhash64("text")).withColumn("_keep_id", F.col("doc_id").cast("long"))
    same = rows["_keep_id"].eqNullSafe(keys["_keep_id"]) & (rows["_keep_hash"] == keys["_keep_hash"])
    return rows.join(keys, same, "left_semi").dropDuplicates(["_keep_id", "_keep_hash"]).select(*[F.col(f"`{c}`") for c in docs.columns])
