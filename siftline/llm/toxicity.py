"""Toxicity scores by non-negative positive-unlabelled learning of a linear model over hashed words and word beginnings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, dropped, staged
from .kernels import _LOWER, buffers, mix, pieces, powers, runs

BITS = 18
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


#: Bits of the filter that spares most texts the join with the confirmed examples; 8 bytes go out for 64 of them.
FILTER = 1 << 23
#: Texts whose features a task holds while the model is fitted.
ROWS = 50_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2 ** BITS
    bias: float


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, 1 + len(BEGINNINGS)) feature numbers: the word itself and what it begins with; -1 where it is shorter."""
    up, down = powers(len(raw) + 1)
    out = np.full((len(starts), 1 + len(BEGINNINGS)), -1, np.int32)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        for k, size in enumerate((0, *BEGINNINGS)):
            stop = ends if not size else np.minimum(starts + size, ends)
            h = (mix((total[stop] - total[starts]) * down[starts] + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int32)
            out[:, k] = h if not size else np.where(ends - starts >= size, h, -1)
    return out


def text_features(raw: np.ndarray, offsets: np.ndarray):
    """For each text its distinct feature numbers and their values: 1, as what counts is that a word occurs."""
    for first, last in runs(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        if last - first == 1:
            counts = np.zeros(1 << BITS, np.int64)
            for a, b in pieces(raw[lo:hi], _BREAK):
                part = _LOWER[raw[lo + a : lo + b]]
                edge = np.flatnonzero(np.diff(np.concatenate(([True], _BREAK[part], [True])).astype(np.int8)))
                h = _hashed(part, edge[0::2], edge[1::2])
                counts += np.bincount(h[h >= 0], minlength=1 << BITS)
            at = np.flatnonzero(counts)
            yield at.astype(np.int32), np.ones(len(at), np.float32)
            continue
        spaced = np.empty(hi - lo + last - first, np.uint8)  # a break after each text, so no word crosses
        cut = offsets[first : last + 1] - lo + np.arange(last - first + 1)
        keep = np.ones(len(spaced), bool)
        keep[cut[1:] - 1] = False
        spaced[keep], spaced[~keep] = _LOWER[raw[lo:hi]], 32
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _BREAK[spaced], [True])).astype(np.int8)))
        starts = edge[0::2]
        h = _hashed(spaced, starts, edge[1::2])
        at = np.searchsorted(starts, cut)
        for i in range(last - first):
            own = h[at[i] : at[i + 1]]
            found = np.unique(own[own >= 0])
            yield found, np.ones(len(found), np.float32)


def telling(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, least: int = 3, lift: float = 2.0) -> np.ndarray:
    """Which features are worth weights: in at least `least` of n_p positives, and `lift` times as often as elsewhere."""
    return (p >= least) & (p * n_u >= lift * (u + 1) * n_p)


def _sums(w: np.ndarray, bias: float, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(w[ids])))
    return sums[at[1:]] - sums[at[:-1]] + bias


def as_negative(w: np.ndarray, bias: float, ids: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Summed over texts (each `times` times), if they were negative: the slopes by feature, that of the bias, the
    logistic loss and the number of texts."""
    z = _sums(w, bias, ids, at)
    slope = times / (1 + np.exp(-np.clip(z, -40, 40)))
    return np.concatenate((np.bincount(ids, np.repeat(slope, np.diff(at)), len(w)), [slope.sum(), (times * np.logaddexp(0, z)).sum(), times.sum()]))


def fit(risks, present: np.ndarray, n_p: int, prior: float, rounds: int = 48, rate: float = 0.25, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on prior * R_p+ + max(0, R_u- - prior * R_p-) with the logistic loss over the presence of
    features; where the corrected negative part falls below zero its gradient is followed the other way, as the
    non-negative estimator asks. risks(w, bias) is as_negative() summed over all confirmed examples and over all
    unlabelled texts; present says in how many of the n_p examples each feature occurs."""
    prior, size = min(max(prior, 1e-4), 0.5), len(present)
    w, m, v = np.concatenate((np.zeros(size), [np.log(prior / (1 - prior))])), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p, u = (x / x[-1] for x in risks(w[:-1], w[-1]))
        corrected = u[:-2] - prior * p[:-2]
        as_positive = p[:-2] - np.append(present / n_p, 1.0)  # the slope of the loss of examples as what they are
        g = prior * as_positive + corrected if u[-2] >= prior * p[-2] else -corrected
        g[:-1] += decay * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _counts(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the rows each feature occurs, and how many there are; summed in the tasks, so the driver gets
    2 ** BITS + 1 numbers at most."""

    def work(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            n += len(batch)
            for ids, _ in text_features(*buffers(batch.column(0))):
                total[ids] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["id", "n"])

    got = rows.select("text").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[np.asarray(got["id"])] = np.asarray(got["n"])
    return out[:-1], int(out[-1])


def _features(rows: DataFrame, keep: np.ndarray, confirmed: bool) -> DataFrame:
    """(confirmed, ids, times): the kept features of every row, numbered among themselves; rows of a batch with the same
    ones are one row."""
    number = np.full(1 << BITS, -1, np.int32)
    number[keep] = np.arange(np.count_nonzero(keep))

    def work(batches):
        for batch in batches:
            found: dict[bytes, int] = {}
            for ids, _ in text_features(*buffers(batch.column(0))):
                own = number[ids]
                own = own[own >= 0].tobytes()
                found[own] = found.get(own, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([confirmed] * len(found)), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["confirmed", "ids", "times"])

    return rows.select("text").mapInArrow(work, "confirmed boolean, ids binary, times long")


def _risks(table: DataFrame, size: int):
    """as_negative() of the confirmed and of the unlabelled rows of a table of _features(): one job a call, summed in the
    tasks and then by place, so the driver gets 2 * (size + 3) numbers."""

    def run(w: np.ndarray, bias: float) -> np.ndarray:
        def work(batches):
            total = np.zeros((2, size + 3))
            for batch in batches:
                raw, at = buffers(batch.column(1))
                ids, at, times, confirmed = np.frombuffer(raw.tobytes(), np.int32), at // 4, np.asarray(batch.column(2)).astype(float), np.asarray(batch.column(0))
                for k in (0, 1):
                    own = times * (confirmed != k)
                    if own.any():
                        total[k] += as_negative(w, bias, ids, at, own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

        got = table.mapInArrow(work, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(2 * (size + 3))
        out[np.asarray(got["at"])] = np.asarray(got["x"])
        return out.reshape(2, -1)

    return run


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the ids. A filter of FILTER bits at most, one hash an id, is broadcast first, and what
    it lets through is staged, so that hardly any other text is shuffled while there are far fewer ids than bits; with more
    of them it lets more through."""
    bit = f"pmod(xxhash64(doc_id), {FILTER}L)"
    words = ids.select(F.expr(f"{bit} DIV 64").alias("_word"), F.expr(f"shiftleft(1L, CAST({bit} % 64 AS INT))").alias("bits")).groupBy("_word").agg(F.bit_or("bits").alias("_bits"))
    met = rows.join(F.broadcast(words), F.expr(f"{bit} DIV 64") == F.col("_word")).where(F.expr(f"shiftrightunsigned(_bits, CAST({bit} % 64 AS INT)) & 1 = 1"))
    near = staged(met.select(*rows.columns), "near")  # staged, or the planner would put the join below the filter
    out = staged(near.join(ids, "doc_id", "left_semi"), "confirmed")
    dropped(near)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labels(doc_id, toxic) of docs(doc_id, text): toxic = 1 rows are the confirmed examples, all docs
    are unlabelled text, and the share of 1 among the labels is the class prior. Null labels, ids and texts are left out.
    Without either kind of example every score is near 0.

    Counts over all rows choose the features. The risks and their gradients run over all confirmed examples and all
    unlabelled texts in every step, by the few features that tell anything: nothing is sampled, and the model does not
    depend on how the rows are dealt over tasks.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    prior = known.agg(F.avg(F.col("toxic").cast("double")).alias("prior")).first().prior or 0.0
    every = _with_ids(rows, known.where("toxic = 1").select("doc_id"))
    (p, n_p), (u, n_u) = _counts(every), _counts(rows)
    if not n_p or not n_u:
        return Model(np.zeros(1 << BITS, np.float32), -8.0)
    keep = telling(p, u, n_p, n_u)
    table = staged(_features(every, keep, True).unionByName(_features(rows, keep, False)).repartition(1 + n_u // ROWS), "features")
    with cleaned(docs.sparkSession):
        w, bias = fit(_risks(table, int(np.count_nonzero(keep))), p[keep], n_p, prior)
    dropped(every), dropped(table)
    weights = np.zeros(1 << BITS, np.float32)
    weights[keep] = w
    return Model(weights, bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash and score (0 to 1, higher is likelier toxic) of every row.

    Null and empty texts have no features and get the score of the bias alone. Rows are scored one by one, so repeated
    rows and null ids are as good as any; other columns are not read; an empty table gives an empty result.
    """

    def work(batches):
        for batch in batches:
            z = [float(model.weights[ids].sum(dtype=np.float64)) + model.bias for ids, _ in text_features(*buffers(batch.column(2)))]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["doc_id", "text_hash", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score the threshold or more; the score is computed beside the row, so nothing is joined."""
    names = [f.name for f in docs.schema.fields]
    at = names.index("text")

    def work(batches):
        for batch in batches:
            z = np.array([float(model.weights[ids].sum(dtype=np.float64)) + model.bias for ids, _ in text_features(*buffers(batch.column(at)))], float)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))) < threshold))

    return docs.mapInArrow(work, docs.schema)
