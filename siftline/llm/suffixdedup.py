"""Repeated byte strings found by difference-cover suffix sorting of the places that can hold them, and their removal."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged
from .kernels import MULTIPLIER, buffers, mix, powers, runs

GRAM = 24  # bytes of a fingerprint
RUN = 1 << 22  # bytes of text that send their entries together
BLOCK = (1 << 20) - 256  # bytes that are hashed at a time
SPLIT = 4096  # distinct segments of one fingerprint above which they are dealt window by window
LOWEST = -(1 << 63)
SORT = 1 << 20  # symbols of one local sort


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on."""
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mix((total[GRAM:] - total[:-GRAM]) * down[: max(0, len(raw) - GRAM + 1)])


def windows_of(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, stop, place, mark): runs first <= i < stop of windows of `length` bytes with the same least fingerprint
    (the last of equal ones), where it stands and its hash. Windows lie within the texts at[i]:at[i + 1] of raw; a very
    long text is taken in blocks, so a run may come in two parts."""
    for lo in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = raw[lo : lo + BLOCK + length - 1]
        n, hashes = len(part) - length + 1, gram_hashes(part)
        key = (hashes & ~np.uint64((1 << 32) - 1)) | (np.uint64((1 << 32) - 1) - np.arange(len(hashes), dtype=np.uint64))
        span, low, have = length - GRAM + 1, key, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[:n], low[span - have : span - have + n])
        place = (np.uint64((1 << 32) - 1) - (low & np.uint64((1 << 32) - 1))).astype(np.int64)
        edge = np.clip(np.concatenate((at[1:] - length + 1, at[:-1])) - lo, 0, n)
        inside = np.zeros(n + 1, np.int32)  # windows that start in a text and end in it
        np.add.at(inside, edge[len(at) - 1 :], 1)
        np.add.at(inside, np.maximum(edge[: len(at) - 1], edge[len(at) - 1 :]), -1)
        place[np.cumsum(inside[:-1]) <= 0] = -1
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        stop = np.append(first[1:], n)
        keep = place[first] >= 0
        first, stop = first[keep], stop[keep]
        yield first + lo, stop + lo, place[first] + lo, hashes[place[first]]


def _all_windows(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = list(windows_of(raw, at, length)) or [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _edges(*sorted_: np.ndarray) -> np.ndarray:
    """Where a run of equal entries of the sorted arrays begins."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_]))))


def _cuts(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, stop) of the runs of a sorted array."""
    edge = _edges(keys)
    yield from zip(keys[edge].tolist(), edge.tolist(), np.append(edge[1:], len(keys)).tolist(), strict=True) if len(edge) else ()


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def difference_cover_sort(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (values 1 to 2**20 - 1): triples at positions 1 and 2 modulo 3 are sorted and named, unless
    the names are unique the string of names is sorted the same way, and the other suffixes are merged in by the ranks."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, np.zeros(3, s.dtype))).astype(np.uint64)
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    triple = (t[sample] << np.uint64(42)) | (t[sample + 1] << np.uint64(21)) | t[sample + 2]
    order = np.argsort(triple)
    fresh = np.concatenate(([1], triple[order][1:] != triple[order][:-1])).cumsum()
    if fresh[-1] < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = fresh
        order = difference_cover_sort(names)
    first = sample[order]
    rank = np.zeros(n + 3, np.uint64)
    rank[first] = np.arange(1, len(first) + 1, dtype=np.uint64)
    first = first[first < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((t[zero] << np.uint64(32)) | rank[zero + 1])]
    one, two = first[first % 3 == 1], first[first % 3 == 2]
    below = np.searchsorted((t[one] << np.uint64(32)) | rank[one + 1], (t[zero] << np.uint64(32)) | rank[zero + 1])
    key = lambda i: (t[i] << np.uint64(43)) | (t[i + 1] << np.uint64(22)) | rank[i + 2]
    below = below + np.searchsorted(key(two), key(zero))
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + below
    out[place] = zero
    free = np.ones(n, bool)
    free[place] = False
    out[free] = first
    return out


def repeated_places(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(k, places): by document the fingerprints that occur in another document too, packed as 32-bit integers.

    A run of texts tells at once which of its fingerprints two of its documents share; of those it sends one on, of the
    others all, packed by hash bucket. So one fingerprint of many documents sends one entry a run, not one a document.
    """

    def pick(batches):
        for batch in batches:
            raw_all, at_all = buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            for a, b in runs(at_all, RUN):
                at = at_all[a : b + 1] - at_all[a]
                _, _, place, h = _all_windows(raw_all[at_all[a] : at_all[b]], at, length)
                if not len(h):
                    continue
                doc = np.searchsorted(at, place, side="right") - 1
                order = np.lexsort((place, h))
                h, place, doc = h[order], place[order], doc[order]
                once = _edges(h, place)  # a run of windows may have come in two parts
                h, d, p = h[once], ids[a + doc[once]], place[once] - at[doc[once]]
                edge = _edges(h)
                size = np.diff(np.append(edge, len(h)))
                shared = np.repeat(np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge), size)
                send = ~shared
                send[edge] = True
                bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                for part, known in ((np.flatnonzero(shared), 1), (np.flatnonzero(send), 0)):
                    key = d[part] if known else bucket[part]
                    order = np.argsort(key, kind="stable")
                    part, key = part[order], key[order]
                    yield _rows([
                        (known, k, b"" if known else h[part[x:y]].astype(np.uint32).tobytes(), b"" if known else d[part[x:y]].tobytes(), p[part[x:y]].astype(np.uint32).tobytes(), b"" if known else np.packbits(shared[part[x:y]]).tobytes())
                        for k, x, y in _cuts(key)
                    ], sent)

    def meet(group: pa.Table) -> pa.Table:
        known = np.asarray(group["known"]) == 1
        done = group.filter(pa.array(known)).select(["k", "p"])
        group = group.filter(pa.array(~known))
        if not len(group):
            return done
        h, d, p = _joined(group["h"], np.uint32), _joined(group["d"], np.int64), _joined(group["p"], np.uint32)
        shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(y) // 4] for x, y in zip(group["shared"].to_pylist(), group["h"].to_pylist(), strict=True)]).astype(bool)
        order = np.argsort(h, kind="stable")
        h, d, p, shared = h[order], d[order], p[order], shared[order]
        edge = _edges(h)
        low, high = np.minimum.reduceat(d, edge), np.maximum.reduceat(d, edge)
        again = np.repeat((low != high) | np.maximum.reduceat(shared, edge), np.diff(np.append(edge, len(h)))) & ~shared
        d, p = d[again], p[again]
        order = np.argsort(d, kind="stable")
        d, p = d[order], p[order]
        own = _rows([(k, p[x:y].tobytes()) for k, x, y in _cuts(d)], pa.schema([("k", pa.int64()), ("p", pa.binary())]))
        return pa.concat_tables([done, pa.Table.from_batches([own])])

    sent = pa.schema([("known", pa.int32()), ("k", pa.int64()), ("h", pa.binary()), ("d", pa.binary()), ("p", pa.binary()), ("shared", pa.binary())])
    packed = docs.select("k", "text").mapInArrow(pick, "known int, k long, h binary, d binary, p binary, shared binary")
    dealt = packed.withColumn("bucket", F.when(F.col("known") == 1, F.pmod(F.xxhash64("k"), F.lit(buckets))).otherwise(F.col("k")).cast("long"))
    return staged(dealt.groupBy("bucket").applyInArrow(meet, "k long, p binary").groupBy("k").agg(F.collect_list("p").alias("places")), "places")


ENTRIES = "kind int, bucket long, run binary, base int, mark binary, seg binary, low binary, high binary, size binary, body binary, marks binary"
_ENTRIES = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("run", pa.binary()), ("base", pa.int32()), *[(c, pa.binary()) for c in ("mark", "seg", "low", "high", "size", "body", "marks")]])
SPANS = "kind int, k long, text_hash long, mark binary, a binary, b binary"
_SPANS = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("text_hash", pa.int64()), ("mark", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _entries(run: bytes, bucket: np.ndarray, columns: dict[str, np.ndarray], bodies: Callable[[int, int], bytes] | None = None) -> list[tuple]:
    """Rows of kind 0, one for each bucket of the entries, which stand in the order of their buckets."""
    return [(0, k, run, x, *[columns[c][x:y].tobytes() for c in ("mark", "seg", "low", "high", "size")], bodies(x, y) if bodies else b"", b"") for k, x, y in _cuts(bucket)]


def _places(run: bytes, entry: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, k: np.ndarray, text_hash: np.ndarray, marks: bytes = b"") -> tuple:
    """The row of kind 1 that keeps in a run which places in which documents its entries stand for; no bucket needs it."""
    return (1, 0, run, len(k), entry.astype(np.uint32).tobytes(), doc.astype(np.uint32).tobytes(), k.tobytes(), text_hash.tobytes(), first.astype(np.uint32).tobytes(), size.astype(np.uint8).tobytes(), marks)


def segments(docs: DataFrame, places: DataFrame, length: int, buckets: int) -> DataFrame:
    """Entries (kind 0) and places (kind 1) of the segments around repeated fingerprints: the bytes of all consecutive
    windows that one is least in. A segment is known by the hashes of its fingerprint and of its bytes, 128 bits
    together; a run sends each of its segments once, with its lowest and highest document."""

    def cut(batches):
        for batch in batches:
            raw_all, at_all = buffers(batch.column(2))
            k_all, th_all, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            for x, y in runs(at_all, RUN):
                at, raw = at_all[x : y + 1] - at_all[x], raw_all[at_all[x] : at_all[y]]
                first, stop, place, mark = _all_windows(raw, at, length)
                doc = np.searchsorted(at, first, side="right") - 1
                wanted = np.zeros(len(raw) + 1, bool)
                for i in range(x, y):
                    for packed in lists[i].as_py():
                        wanted[np.minimum(at[i - x] + np.frombuffer(packed, np.uint32).astype(np.int64), len(raw))] = True
                keep = wanted[place]
                first, size, mark, doc = first[keep], (stop - first)[keep] + length - 1, mark[keep], doc[keep]
                if not len(first):
                    continue
                seg = np.empty(len(first), np.uint64)
                for lo in range(0, len(raw), BLOCK):
                    part, own = raw[lo : lo + BLOCK + 2 * length], np.flatnonzero((first >= lo) & (first < lo + BLOCK))
                    up, down = powers(len(part) + 1)
                    with np.errstate(over="ignore"):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(257)) * up[: len(part)])))
                        seg[own] = mix((total[first[own] + size[own] - lo] - total[first[own] - lo]) * down[first[own] - lo] + size[own].astype(np.uint64))
                k, bucket = k_all[x:y], ((mark >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((k[doc], seg, mark, bucket))
                first, size, mark, doc, seg, bucket = (c[order] for c in (first, size, mark, doc, seg, bucket))
                edge = _edges(bucket, mark, seg)
                last = np.append(edge[1:], len(seg)) - 1
                entry = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(seg))))
                run = uuid.uuid4().bytes
                own = {"mark": mark[edge], "seg": seg[edge], "low": k[doc[edge]], "high": k[doc[last]], "size": np.zeros(len(edge), np.uint8)}
                yield _rows([*_entries(run, bucket[edge], own), _places(run, entry, doc, first - at[doc], size, k, th_all[x:y], own["mark"].tobytes())], _ENTRIES)

    return docs.join(places, "k").select("k", "text_hash", "text", "places").mapInArrow(cut, ENTRIES)


def lowest_of(entries: DataFrame) -> DataFrame:
    """(run, at, low, open): for entries of a run the lowest document of their segment in all runs, where that matters.

    open is 1 where other segments have the same fingerprint, so that single windows of the lowest document can occur
    before it; it is 2 where more than SPLIT do. A segment has one entry a run, however many documents hold it.
    """

    def meet(group: pa.Table) -> pa.Table:
        n = np.array([len(x) // 8 for x in group["mark"].to_pylist()])
        mark, seg, low, high = _joined(group["mark"], np.uint64), _joined(group["seg"], np.uint64), _joined(group["low"], np.int64), _joined(group["high"], np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.asarray(group["base"]), n)
        order = np.lexsort((seg, mark))
        edge, marks = _edges(mark[order], seg[order]), _edges(mark[order])
        size = np.diff(np.append(edge, len(order)))
        lows = np.repeat(np.minimum.reduceat(low[order], edge), size)
        kinds = np.diff(np.append(np.searchsorted(edge, marks), len(edge)))  # segments of a mark
        kinds = np.repeat(kinds, np.diff(np.append(marks, len(order))))
        low, high, row, at = low[order], high[order], row[order], at[order]
        open_ = np.where((kinds > 1) & (low == lows), np.where(kinds > SPLIT, 2, 1), 0).astype(np.uint8)
        keep = (high > lows) | (open_ > 0)
        row, at, lows, open_ = row[keep], at[keep], lows[keep], open_[keep]
        order = np.argsort(row, kind="stable")
        names = group["run"]
        return pa.Table.from_batches([_rows([(names[r].as_py(), *(c[order[x:y]].tobytes() for c in (at.astype(np.uint32), lows, open_))) for r, x, y in _cuts(row[order])], replies)])

    replies = pa.schema([("run", pa.binary()), ("at", pa.binary()), ("low", pa.binary()), ("open", pa.binary())])
    found = entries.select("bucket", "run", "base", "mark", "seg", "low", "high").groupBy("bucket").applyInArrow(meet, "run binary, at binary, low binary, open binary")
    return found.groupBy("run").agg(F.collect_list(F.struct("at", "low", "open")).alias("answers"))


def spans_of(places: DataFrame, answers: DataFrame) -> DataFrame:
    """Spans a:b that go (kind 0) by document, and segments whose windows are still to be compared (kind 1; 2 where they
    are to be dealt window by window)."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                entry, doc, first, size = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("mark", np.uint32), ("seg", np.uint32), ("size", np.uint32), ("body", np.uint8)))
                k, text_hash = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
                low, open_ = np.full(int(entry[-1]) + 1, (1 << 63) - 1), np.zeros(int(entry[-1]) + 1, np.uint8)
                for x in row["answers"]:
                    at = np.frombuffer(x["at"], np.uint32)
                    low[at], open_[at] = np.frombuffer(x["low"], np.int64), np.frombuffer(x["open"], np.uint8)
                kind = np.where(k[doc] > low[entry], 0, np.where((open_[entry] > 0) & (k[doc] == low[entry]), open_[entry], 9))
                mark = np.frombuffer(row["marks"], np.uint64)
                out = []
                for which in (0, 1, 2):
                    part = np.flatnonzero(kind == which)
                    part = part[np.argsort(doc[part], kind="stable")]
                    for d, x, y in _cuts(doc[part]):
                        own = part[x:y]
                        out.append((which, int(k[d]), int(text_hash[d]), mark[entry[own]].tobytes() if which else b"", first[own].astype(np.uint32).tobytes(), (first[own] + size[own]).astype(np.uint32).tobytes()))
                yield _rows(out, _SPANS)

    return places.join(answers, "run").mapInArrow(work, SPANS)


def bodies_of(docs: DataFrame, spans: DataFrame, length: int, buckets: int) -> DataFrame:
    """Entries (kind 0, with their bytes) and places (kind 1) of the segments still to be compared, dealt by fingerprint;
    those of a fingerprint with more than SPLIT segments are cut into windows, dealt by their content."""

    def cut(batches):
        for batch in batches:
            raw_all, at_all = buffers(batch.column(2))
            k_all, th_all, parts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            for x, y in runs(at_all, RUN):
                doc, mark, first, size, split = [], [], [], [], []
                for i in range(x, y):
                    for p in parts[i].as_py():
                        a, b, m = np.frombuffer(p["a"], np.uint32).astype(np.int64), np.frombuffer(p["b"], np.uint32).astype(np.int64), np.frombuffer(p["mark"], np.uint64)
                        if p["kind"] == 2:
                            n = b - a - length + 1
                            a, m = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(m, n)
                            b = a + length
                        doc.append(np.full(len(a), i - x)), mark.append(m), first.append(a), size.append(b - a), split.append(np.full(len(a), p["kind"] == 2))
                doc, mark, first, size, split = (np.concatenate(c) for c in (doc, mark, first, size, split))
                start = at_all[x + doc] + first
                if split.any():
                    own = np.flatnonzero(split)
                    with np.errstate(over="ignore"):
                        h = mark[own]
                        for j in range(length):
                            h = mix(h * MULTIPLIER + raw_all[start[own] + j])
                    mark[own] = h
                k, bucket = k_all[x:y], ((mark >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((k[doc], size, mark, bucket))
                doc, mark, first, size, split, start, bucket = (c[order] for c in (doc, mark, first, size, split, start, bucket))
                fresh = np.ones(len(doc), bool)  # of equal windows one entry, with the lowest and the highest document
                fresh[1:] = ~(split[1:] & split[:-1] & (mark[1:] == mark[:-1]))
                edge = np.flatnonzero(fresh)
                last = np.append(edge[1:], len(doc)) - 1
                ends = np.cumsum(size[edge])

                def bytes_of(p: int, q: int, at=start[edge], n=size[edge], ends=ends) -> bytes:
                    return raw_all[np.repeat(at[p:q] - (ends[p:q] - n[p:q]), n[p:q]) + np.arange(ends[p] - n[p], ends[q - 1])].tobytes()

                run = uuid.uuid4().bytes
                own = {"mark": mark[edge], "seg": np.zeros(len(edge), np.uint8), "low": k[doc[edge]], "high": k[doc[last]], "size": size[edge].astype(np.uint8)}
                yield _rows([*_entries(run, bucket[edge], own, bytes_of), _places(run, np.cumsum(fresh) - 1, doc, first, size, k, th_all[x:y])], _ENTRIES)

    parts = spans.groupBy("k", "text_hash", "kind").agg(F.first(F.struct("kind", "mark", "a", "b")).alias("part")).groupBy("k", "text_hash").agg(F.collect_list("part").alias("parts"))
    return docs.select("k", "text_hash", "text").join(parts, ["k", "text_hash"]).mapInArrow(cut, ENTRIES)


def earlier_windows(entries: DataFrame, length: int) -> DataFrame:
    """(run, answers): the windows of every entry that occur in a lower document, by offset, with that document.

    The segments of a bucket are laid end to end and their suffixes sorted by difference cover; neighbours whose next
    `length` bytes agree are one string, whose lowest document is the lowest of their entries'.
    """

    def sort(group: pa.Table) -> pa.Table:
        n = np.array([len(x) // 8 for x in group["mark"].to_pylist()])
        mark, low, high, size = _joined(group["mark"], np.uint64), _joined(group["low"], np.int64), _joined(group["high"], np.int64), _joined(group["size"], np.uint8).astype(np.int64)
        text = _joined(group["body"], np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.asarray(group["base"]), n)
        begin = np.cumsum(size) - size
        order = np.argsort(mark, kind="stable")
        ends = np.cumsum(size[order] + 1)
        marks = np.append(_edges(mark[order]), len(order))  # equal marks stay together
        found, done = [], 0
        while done < len(marks) - 1:
            base = ends[marks[done]] - size[order[marks[done]]] - 1
            to = max(done + 1, int(np.searchsorted(ends[marks[1:] - 1], base + SORT, side="right")))
            own = order[marks[done] : marks[to]]
            done = to
            sizes = size[own]
            starts = np.cumsum(sizes + 1) - sizes - 1
            owner = np.repeat(np.arange(len(own)), sizes + 1)
            offset = np.arange(len(owner)) - starts[owner]
            body = offset < sizes[owner]
            data = np.zeros(len(owner) + length + 8, np.uint8)
            data[: len(owner)][body] = text[(begin[own][owner] + offset)[body]]
            suffixes = difference_cover_sort(np.where(body, data[: len(owner)].astype(np.int64) + 2, 1))
            suffixes = suffixes[offset[suffixes] <= sizes[owner[suffixes]] - length]
            eight = np.ndarray((len(owner) + length,), "<u8", data, strides=(1,))  # the eight bytes from every place on
            same = np.ones(max(len(suffixes) - 1, 0), bool)
            for j in sorted({*range(0, length - 7, 8), length - 8}):
                same &= eight[suffixes[1:] + j] == eight[suffixes[:-1] + j]
            edge = np.flatnonzero(np.concatenate(([True], ~same)))
            which = own[owner[suffixes]]
            lowest = np.repeat(np.minimum.reduceat(low[which], edge), np.diff(np.append(edge, len(suffixes))))
            hit = lowest < high[which]
            found.append((row[which[hit]], at[which[hit]], offset[suffixes[hit]], lowest[hit]))
        rows, places, offsets, lowest = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(rows, kind="stable")
        names = group["run"]
        return pa.Table.from_batches([_rows([(names[r].as_py(), *(c[order[x:y]].tobytes() for c in (places.astype(np.uint32), offsets.astype(np.uint8), lowest))) for r, x, y in _cuts(rows[order])], replies)])

    replies = pa.schema([("run", pa.binary()), ("at", pa.binary()), ("offset", pa.binary()), ("low", pa.binary())])
    found = entries.select("bucket", "run", "base", "mark", "low", "high", "size", "body").groupBy("bucket").applyInArrow(sort, "run binary, at binary, offset binary, low binary")
    return found.groupBy("run").agg(F.collect_list(F.struct("at", "offset", "low")).alias("answers"))


def windows_gone(places: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """Spans (kind 0) of the windows that occur in a lower document than theirs."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                entry, doc, first = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("mark", "seg", "size"))
                k, text_hash = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
                at, offset, low = (np.concatenate([np.frombuffer(x[c], t) for x in row["answers"]]) for c, t in (("at", np.uint32), ("offset", np.uint8), ("low", np.int64)))
                edge = np.searchsorted(entry, np.arange(int(entry[-1]) + 2))
                n = edge[at.astype(np.int64) + 1] - edge[at]  # places of the entry
                answer = np.repeat(np.arange(len(at)), n)
                place = edge[at][answer] + np.arange(len(answer)) - np.repeat(np.cumsum(n) - n, n)
                hit = k[doc[place]] > low[answer]
                place, answer = place[hit], answer[hit]
                own, a = doc[place], first[place] + offset[answer]
                order = np.lexsort((a, own))
                own, a = own[order], a[order]
                head = np.concatenate(([True], (own[1:] != own[:-1]) | (a[1:] > a[:-1] + length)))[: len(a)]  # overlapping windows are one span
                edge = np.flatnonzero(head)
                b = a[np.append(edge[1:], len(a)) - 1] + length if len(a) else a
                own, a = own[edge], a[edge]
                yield _rows([(0, int(k[d]), int(text_hash[d]), b"", a[x:y].astype(np.uint32).tobytes(), b[x:y].astype(np.uint32).tobytes()) for d, x, y in _cuts(own)], _SPANS)

    return places.join(answers, "run").mapInArrow(work, SPANS)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    A byte goes if a string of `length` bytes (24 to 100) that covers it also starts in a document with a smaller doc_id;
    strings are judged on the input and never cross documents. A null text is empty. Rows that share a doc_id are never
    earlier than one another, whatever their texts; a null id comes before all others. Any bytes may occur, zero bytes
    too. Other columns are not read; an empty table gives an empty result.

    Winnowed fingerprints tell which places can repeat. The segment around such a place is compared as a whole first:
    every document but the lowest that holds it loses it. Where a fingerprint has several segments, the lowest
    document's are suffix-sorted by difference cover, and neighbours in that order tell which windows repeat.
    """
    if not GRAM <= length <= 100:
        raise ValueError(f"length is {GRAM} to 100, not {length}")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("text_hash"), F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = max(32, total >> 23)
    long = base.where(F.octet_length("text") >= length)
    places = repeated_places(long, length, buckets)
    cut = staged(segments(long, places, length, buckets), "segments", by="kind")
    dropped(places)
    spans = staged(spans_of(cut.where("kind = 1"), lowest_of(cut.where("kind = 0"))), "spans", by="kind")
    dropped(cut)
    bodies = staged(bodies_of(long, spans.where("kind > 0"), length, buckets), "bodies", by="kind")
    gone = spans.where("kind = 0").unionByName(windows_gone(bodies.where("kind = 1"), earlier_windows(bodies.where("kind = 0"), length), length))
    gone = staged(gone.groupBy(F.col("k").alias("_k"), F.col("text_hash").alias("_th")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "gone")
    dropped(spans), dropped(bodies)

    def strip(batches):
        for batch in batches:
            raw, at = buffers(batch.column(1))
            n, removed, spans, kept = [], [], [], []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = raw[at[i] : at[i + 1]]
                n.append(len(own))
                if a:
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, np.frombuffer(b"".join(a), np.uint32), 1)
                    np.add.at(edge, np.frombuffer(b"".join(b), np.uint32), -1)
                    drop = np.cumsum(edge[:-1]) > 0
                    removed.append(int(drop.sum())), spans.append(int(np.count_nonzero(np.diff(drop.astype(np.int8), prepend=0) > 0)))
                    kept.append(own[~drop].tobytes())
                else:
                    removed.append(0), spans.append(0), kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    met = base.join(gone.hint("shuffle_hash"), (F.col("k") == F.col("_k")) & (F.col("text_hash") == F.col("_th")), "left")
    return met.select("doc_id", "text", "a", "b").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
