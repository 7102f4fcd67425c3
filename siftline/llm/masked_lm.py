"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, dropped, staged
from .kernels import buffers, runs, word_hashes

PIECE = 1 << 12  # parameters of a row that is summed
TOKENS = 1 << 13  # tokens that are scored at a time
KNOWN = 1 << 16  # words whose counts go out to the tasks, 16 bytes each; those of rarer words are joined
CHUNK = 1 << 11  # tokens whose group probabilities are held at a time


@dataclass(frozen=True)
class Shape:
    """Slots are words of the corpus by rank, each its own, and after them buckets that share all other words by hash.

    A slot is predicted in two steps: its group of `fan` neighbours in rank, then its place in the group.
    """

    words: int = 2048
    buckets: int = 256
    fan: int = 48
    width: int = 12
    sides: tuple[int, ...] = (-2, -1, 1, 2)
    rate: float = 0.1
    batch: int = 16384  # tokens of a training step
    rounds: int = 4  # parts of the corpus, after each of which the replicas are averaged
    shard: int = 1 << 27  # bytes of text that train a replica in order
    least: int = 24  # shards of a small corpus
    vocabulary: int = 400_000  # distinct words these slots are meant for; see grown()

    @property
    def slots(self) -> int:
        return self.words + self.buckets

    @property
    def classes(self) -> int:
        return self.slots + 1  # the last stands beyond both ends of a text

    @property
    def groups(self) -> int:
        return -(-self.slots // self.fan)

    @property
    def sizes(self) -> tuple[int, ...]:
        """Numbers of the five parameter blocks; see views()."""
        return len(self.sides) * self.classes * self.width, self.width * self.groups, self.groups, self.groups * self.width * self.fan, self.groups * self.fan

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def grown(self, distinct: int) -> Shape:
        """Words and buckets for a corpus of so many distinct words: more by the cube root of what exceeds vocabulary."""
        factor = max(1.0, distinct / self.vocabulary) ** (1 / 3)
        return replace(self, words=round(self.words * factor), buckets=round(self.buckets * factor))


@dataclass(frozen=True)
class Language:
    """Corpus counts (frequent word hashes, sorted, with their slots; tokens of other words by bucket; the KNOWN most frequent
    words, sorted, with the logarithms of their counts; n of every word as a table) and the network."""

    shape: Shape
    hashes: np.ndarray
    ranks: np.ndarray
    totals: np.ndarray
    known: np.ndarray
    logs: np.ndarray
    params: np.ndarray
    counts: DataFrame | None = None  # not sent to tasks


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) over every word of every text, summed in each batch and then by a shuffle."""

    def count(batches):
        for batch in batches:
            words, _ = word_hashes(*buffers(batch.column(0)))
            found, n = np.unique(words.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def slots_of(words: np.ndarray, language: Language) -> np.ndarray:
    s = language.shape
    bucket = (s.words + (words % np.uint64(s.buckets)).astype(np.int64)).astype(np.int32)
    if not len(language.hashes):
        return bucket
    at = np.minimum(np.searchsorted(language.hashes, words), len(language.hashes) - 1)
    return np.where(language.hashes[at] == words, language.ranks[at], bucket).astype(np.int32)


def views(params: np.ndarray, s: Shape) -> tuple[np.ndarray, ...]:
    """Inputs by side and slot; group weights and biases; weights and biases of the places, by group."""
    a, b, c, d, e = np.split(params, np.cumsum(s.sizes)[:-1])
    return a.reshape(len(s.sides), s.classes, s.width), b.reshape(s.width, s.groups), c, d.reshape(s.groups, s.width, s.fan), e.reshape(s.groups, s.fan)


def start(s: Shape) -> np.ndarray:
    p = np.random.default_rng(3).normal(0, 0.1, s.size).astype(np.float32)
    for block in (2, 4):
        views(p, s)[block][...] = 0
    views(p, s)[4].reshape(-1)[s.slots :] = -30  # places beyond the last slot
    return p


def context_of(slots: np.ndarray, at: np.ndarray, s: Shape, first: int = 0, last: int | None = None) -> np.ndarray:
    """(sides, last - first) slots beside the tokens first:last; beyond a text's ends the one that stands for that."""
    i = np.arange(first, len(slots) if last is None else last)
    doc = np.searchsorted(at, i, side="right") - 1
    out = np.empty((len(s.sides), len(i)), np.int32)
    for k, d in enumerate(s.sides):
        j = i + d
        out[k] = np.where((j >= at[doc]) & (j < at[doc + 1]), slots[np.clip(j, 0, max(len(slots) - 1, 0))], s.slots)
    return out


def _safe(z: np.ndarray) -> np.ndarray:
    """Scores whose exponentials neither overflow nor change the probabilities."""
    if z.size and z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    return z


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order, the distinct values in it and where each begins; numbers below 2 ** 16 are sorted by radix."""
    order = np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")
    own = values[order]
    cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
    return order, own[cut], cut


def _by_group(target: np.ndarray, s: Shape):
    """An order of the tokens by the group of their slot, and (group, first, stop) within it."""
    order, groups, cut = _sorted(target // s.fan)
    return order, list(zip(groups.tolist(), cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True))


def _hidden(sides: np.ndarray, context: np.ndarray) -> np.ndarray:
    out = sides[0][context[0]]
    for k in range(1, len(sides)):
        out += sides[k][context[k]]
    return np.tanh(out, out=out)


def _log_chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of one score of every row; z is used up."""
    own = _safe(z)[np.arange(len(at)), at]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def log_probabilities(params: np.ndarray, s: Shape, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every target slot, given the slots on both its sides."""
    sides, head, bias, place, place_bias = views(params, s)
    order, parts = _by_group(target, s)
    hidden, group, within = _hidden(sides, context[:, order]), target[order] // s.fan, target[order] % s.fan
    own = np.empty(len(target), hidden.dtype)
    for i in range(0, len(target), CHUNK):
        own[i : i + CHUNK] = _log_chosen(hidden[i : i + CHUNK] @ head + bias, group[i : i + CHUNK])
    for g, a, b in parts:
        own[a:b] += _log_chosen(hidden[a:b] @ place[g] + place_bias[g], within[a:b])
    out = np.empty_like(own)
    out[order] = own
    return out


def _slopes(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Softmax of every row, less one at its target, over n; z is used up."""
    np.exp(_safe(z), out=z)
    z *= (1 / (n * z.sum(axis=1)))[:, None]
    z[np.arange(len(at)), at] -= 1 / n
    return z


def gradient(params: np.ndarray, s: Shape, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability of the targets."""
    order, parts = _by_group(target, s)
    context, target = context[:, order], target[order]
    group, within, n = target // s.fan, target % s.fan, len(target)
    sides, head, bias, place, place_bias = views(params, s)
    hidden = _hidden(sides, context)
    out = np.zeros_like(params)
    g_sides, g_head, g_bias, g_place, g_place_bias = views(out, s)
    back = np.empty_like(hidden)
    for i in range(0, n, CHUNK):
        h = hidden[i : i + CHUNK]
        z = _slopes(h @ head + bias, group[i : i + CHUNK], n)
        g_head += h.T @ z
        g_bias += z.sum(axis=0)
        back[i : i + CHUNK] = z @ head.T
    for g, a, b in parts:
        h = hidden[a:b]
        z = _slopes(h @ place[g] + place_bias[g], within[a:b], n)
        g_place[g] = h.T @ z
        g_place_bias[g] = z.sum(axis=0)
        back[a:b] += z @ place[g].T
    back *= 1 - hidden * hidden
    for k in range(len(s.sides)):
        own, slots, cut = _sorted(context[k])
        g_sides[k][slots] = np.add.reduceat(back[own], cut, axis=0)
    return out


def train(params: np.ndarray, s: Shape, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """params after Adagrad steps on every token of the texts at[i]:at[i + 1] of slots, in their order."""
    params, sums = params.copy(), np.zeros(s.size, np.float32)
    for first in range(0, len(slots), s.batch):
        last = min(len(slots), first + s.batch)
        g = gradient(params, s, context_of(slots, at, s, first, last), slots[first:last])
        sums += g * g
        params -= s.rate * g / (np.sqrt(sums) + 1e-6)
    return params


def _vocabulary(docs: DataFrame, shape: Shape) -> Language:
    counts = staged(word_counts(docs), "words")
    shape = shape.grown(counts.count())
    known = counts.orderBy(F.desc("n"), "word").limit(max(KNOWN, shape.words)).toArrow()
    words, times = np.asarray(known["word"]).astype(np.int64).view(np.uint64), np.asarray(known["n"]).astype(np.float64)
    hashes, order, every = words[: shape.words], np.argsort(words[: shape.words]), np.argsort(words)
    bucket = F.expr(f"CAST(pmod(CAST(word AS DECIMAL(20,0)) + IF(word < 0, CAST('18446744073709551616' AS DECIMAL(20,0)), 0), {shape.buckets}) AS INT)")
    totals = np.zeros(shape.buckets)
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    np.subtract.at(totals, (hashes % np.uint64(shape.buckets)).astype(np.int64), times[: shape.words])
    return Language(shape, hashes[order], order.astype(np.int32), totals, words[every], np.log(times[every]), start(shape), counts)


def learn(docs: DataFrame, shape: Shape = Shape()) -> Language:  # noqa: B008
    """Corpus counts of all words, then the network, trained once on every token of every text.

    Texts are dealt by a hash of doc_id and text to shards of shape.shard bytes, and in a shard ordered by it, so the model
    does not depend on how the input was partitioned. The shards are dealt to shape.rounds rounds; in a round each of its
    shards trains a replica of the model so far, and the replicas are averaged, weighted by their tokens, in a shuffle by
    pieces of the parameters. Slots grow with the vocabulary. The driver gets KNOWN words, one count for each bucket and
    one network a round; the counts of all words stay a table, which score() joins.
    """
    language = _vocabulary(docs, shape)
    shape, known = language.shape, replace(language, counts=None, params=np.zeros(0), known=np.zeros(0), logs=np.zeros(0))
    shards = max(shape.least, (docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // shape.shard))

    def encode(batches):
        for batch in batches:
            words, at = word_hashes(*buffers(batch.column(1)))
            slots = slots_of(words, known)
            rows = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([slots[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], ["order", "slots"])

    coded = docs.select(F.xxhash64("doc_id", "text", F.lit("order")).alias("order"), "text").mapInArrow(encode, "order long, slots binary")
    table = staged(coded.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")), "slots")
    params = language.params
    for part in range(shape.rounds):
        replicas = table.where(F.pmod("shard", F.lit(shape.rounds)) == part).groupBy("shard").applyInArrow(_replica(params, shape), "at int, x binary, n double")
        params = params.copy()
        with cleaned(docs.sparkSession):
            for r in replicas.groupBy("at").applyInArrow(_mean, "at int, x binary").collect():
                x = np.frombuffer(r.x, np.float64)
                params[r.at : r.at + len(x)] += x.astype(np.float32)
    dropped(table)
    return replace(language, params=params)


def _replica(params: np.ndarray, shape: Shape):
    """How far the texts of a shard move the parameters, in pieces, times their tokens."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("slots", "ascending")])
        texts = group["slots"].to_pylist()
        slots, at = np.frombuffer(b"".join(texts), np.int32), np.concatenate(([0], np.cumsum([len(t) // 4 for t in texts])))
        moved = (train(params, shape, slots, at).astype(np.float64) - params) * len(slots)
        cut = range(0, shape.size, PIECE)
        return pa.table({"at": pa.array(list(cut), pa.int32()), "x": pa.array([moved[i : i + PIECE].tobytes() for i in cut], pa.binary()), "n": pa.array([float(len(slots))] * len(cut))})

    return run


def _mean(group: pa.Table) -> pa.Table:
    rows = sorted(zip(group["x"].to_pylist(), group["n"].to_pylist(), strict=True))
    x = sum(np.frombuffer(x, np.float64) for x, _ in rows) / sum(n for _, n in rows)
    return pa.table({"at": group["at"][:1], "x": pa.array([x.tobytes()], pa.binary())})


def score(docs: DataFrame, language: Language) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed over all tokens, each given both its sides) and score (per token).

    A word outside the frequent ones gets its bucket's probability times its own share of the bucket's tokens in the
    corpus, n / (all + 1); the 1 left over is for words the corpus lacks. The counts of KNOWN words go out to the tasks; the
    shares depend only on how often a row has a word, so rows' rarer distinct words are joined with the counts. Null and blank texts have no tokens: 0 and a null score.
    Rows are scored one by one, so repeated rows get equal scores; texts of any length are scored whole, a few thousand
    tokens at a time; other columns are not read; an empty table gives an empty result.
    """
    s, counts = language.shape, language.counts
    language = replace(language, counts=None)
    names = ["row", "doc_id", "n_tokens", "known", "word", "times"]

    def work(batches):
        share = np.concatenate([np.zeros(s.words), -np.log(language.totals + 1)])
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words, at = word_hashes(*buffers(batch.column(2)))
            slots = slots_of(words, language)
            each = np.empty(len(words))
            for i in range(0, len(words), TOKENS):
                own = slots[i : i + TOKENS]
                each[i : i + TOKENS] = log_probabilities(language.params, s, context_of(slots, at, s, i, i + len(own)), own) + share[own]
            rare = slots >= s.words
            if len(language.known):
                own = np.flatnonzero(rare)
                place = np.minimum(np.searchsorted(language.known, words[own]), len(language.known) - 1)
                found = language.known[place] == words[own]
                each[own[found]] += language.logs[place[found]]
                rare[own[found]] = False
            sums = np.concatenate(([0.0], np.cumsum(each)))
            total, n = sums[at[1:]] - sums[at[:-1]], np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total), batch.column(0), pa.array(np.zeros(len(n), np.int64))], names)
            for first, last in runs(at, 1 << 18):
                rest = np.flatnonzero(rare[at[first] : at[last]]) + at[first]
                doc = np.searchsorted(at, rest, side="right") - 1
                order = np.argsort(words[rest])
                order = order[_sorted(doc[order])[0]]
                doc, own = doc[order], words[rest][order]
                edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))[: len(own)])
                none = pa.nulls(len(edge), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[edge]]), none, none, none.cast(pa.float64()), pa.array(own[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(own))))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(work, "row long, doc_id long, n_tokens long, known double, word long, times long").join(counts, "word", "left")
    own = F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(1)).cast("double")))
    summed = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("known") + own).alias("log_likelihood"))
    return summed.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("score"))
