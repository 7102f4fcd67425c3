"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search."""

from __future__ import annotations

import struct
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import buffers, runs, span_hashes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LONG = 48  # bytes of a unit above which it is searched alone
RUN = 900_000  # bytes of text that are encoded at a time: no more than the powers that kernels.py keeps


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; bytes stay bytes, fixed32 becomes a float."""
    at = 0

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif key & 7 == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[bytes, ...]  # white space marks as spaces; a byte piece is its byte
    scores: tuple[float, ...]  # log-probabilities
    kinds: tuple[int, ...]
    unknown: int
    byte_ids: tuple[int, ...]  # empty without byte pieces


def parse(model: bytes) -> Vocabulary:
    """The vocabulary of a model file. A model of merges has ranks for scores; by Zipf's law a piece of rank r gets -log(r + 1)."""
    pieces, scores, kinds, merges = [], [], [], False
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode()), scores.append(piece.get(2, 0.0)), kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
    if merges:
        scores = [-float(np.log1p(max(0.0, -s))) for s in scores]
    raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace("▁", " ").encode() for p, kind in zip(pieces, kinds, strict=True)]
    byte_of = {p: i for i, (p, kind) in enumerate(zip(raw, kinds, strict=True)) if kind == BYTE}
    unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
    return Vocabulary(tuple(raw), tuple(scores), tuple(kinds), unknown, tuple(byte_of[bytes([b])] for b in range(256)) if len(byte_of) == 256 else ())


class Automaton:
    """States of the trie as a complete byte automaton; ends[s] is the longest piece that ends in s, link[s] the state of the next."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        usable = [i for i, (p, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if kind in (NORMAL, USER) and p]
        used = sorted({b for i in usable for b in vocabulary.pieces[i]})
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for i in usable:
            s = 0
            for b in vocabulary.pieces[i]:
                s = children[s].setdefault(int(self.symbol[b]), len(children))
                if s == len(children):
                    children.append({}), own.append(-1)
            if own[s] < 0 or vocabulary.scores[i] > vocabulary.scores[own[s]]:
                own[s] = i
        n = len(children)
        self.step = np.zeros((n, len(used) + 1), np.int32)
        fail, first, link = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            if s:
                self.step[s] = self.step[fail[s]]
                link[s] = first[fail[s]]
                first[s] = s if own[s] >= 0 else link[s]
            for c, t in children[s].items():
                fail[t] = self.step[s, c] if s else 0
                self.step[s, c] = t
                queue.append(t)
        self.first, self.link, self.piece = first, link, np.array(own, np.int32)
        self.size = np.array([len(vocabulary.pieces[i]) if i >= 0 else 0 for i in own], np.int32)
        self.score = np.array([vocabulary.scores[i] if i >= 0 else 0.0 for i in own])
        self.unknown_score = min([vocabulary.scores[i] for i in usable], default=0.0) - 10.0
        #: A space after another character is never inside a piece, so a text falls apart into units that begin with spaces.
        self.splits = all(b" " not in p.lstrip(b" ") for p in (vocabulary.pieces[i] for i in usable))
        byte_of = np.zeros(256, np.int64)
        byte_of[:] = vocabulary.byte_ids or vocabulary.unknown
        self.byte_ids = byte_of

    def best(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For byte strings of one length (n, length): token ids, tokens per string, and the scores of the best paths. Of equal
        paths to a place the one with the longer last piece is kept."""
        n, length = rows.shape
        total = np.full((length + 1, n), -np.inf)
        total[0] = 0
        by, back = np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
        lead = (rows & 0xC0) != 0x80
        state, begun = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for j in range(length):
            state = self.step[state, self.symbol[rows[:, j]]]
            begun = np.where(lead[:, j], j, begun)
            closed = lead[:, j + 1] if j + 1 < length else np.ones(n, bool)
            alone = closed.copy()
            at, who = self.first[state], np.arange(n)
            while len(who := who[at > 0]):
                at = at[at > 0]
                size = self.size[at]
                value = total[j + 1 - size, who] + self.score[at]
                better = value > total[j + 1, who]
                total[j + 1, who[better]], by[j + 1, who[better]], back[j + 1, who[better]] = value[better], self.piece[at[better]], size[better]
                alone[who[j + 1 - size == begun[who]]] = False
                at = self.link[at]
            who = np.flatnonzero(alone)
            if len(who):
                value = total[begun[who], who] + self.unknown_score
                better = value > total[j + 1, who]
                w = who[better]
                total[j + 1, w], by[j + 1, w], back[j + 1, w] = value[better], -1, j + 1 - begun[w]
        spell = bool(self.vocabulary.byte_ids)
        at, who, found = np.full(n, length), np.arange(n), []
        while len(who := who[at > 0]):
            at = at[at > 0]
            ids, size = by[at, who].astype(np.int64), back[at, who]
            if (odd := ids < 0).any():
                if spell:  # an unknown character is spelled in bytes, last byte first
                    size = np.where(odd, 1, size)
                    ids = np.where(odd, self.byte_ids[rows[who, at - 1]], ids)
                    inner = odd & (back[at, who] > 1)
                    by[at[inner] - 1, who[inner]], back[at[inner] - 1, who[inner]] = -1, back[at[inner], who[inner]] - 1
                else:
                    ids = np.where(odd, self.vocabulary.unknown, ids)
            found.append((who, ids))
            at = at - size
        if not found:
            return np.zeros(0, np.int64), np.zeros(n, np.int64), total[length]
        owner, ids = np.concatenate([w for w, _ in found][::-1]), np.concatenate([i for _, i in found][::-1])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n), total[length]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts, their offsets by text, and the texts' scores. Every non-empty text is given a space in front."""
        sizes = np.diff(offsets)
        front = (sizes > 0).astype(np.int64)
        cut = np.concatenate(([0], np.cumsum(sizes + front)))
        data = np.full(cut[-1], 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[cut[:-1][front > 0]] = False
        data[keep] = raw
        starts = np.zeros(len(data), bool)
        if self.splits:
            starts[1:] = (data[1:] == 32) & (data[:-1] != 32)
        starts[cut[:-1][front > 0]] = True
        s = np.flatnonzero(starts)
        e = np.append(s[1:], len(data))[: len(s)]
        _, where, code = np.unique(span_hashes(data, s, e), return_index=True, return_inverse=True)
        us, ue = s[where], e[where]
        order = np.argsort(ue - us, kind="stable")
        ids, counts, scores = [], np.zeros(len(us), np.int64), np.zeros(len(us))
        lengths = (ue - us)[order]
        for lo in np.flatnonzero(np.diff(lengths, prepend=-1)):
            length = int(lengths[lo])
            group = order[lo : np.searchsorted(lengths, length, side="right")]
            for part in np.array_split(group, max(1, len(group) * length // (1 << 21))):
                i, c, x = self.best(data[us[part][:, None] + np.arange(length)]) if length <= LONG or len(part) > 8 else self._alone(data, us[part], length)
                ids.append(i)
                counts[part], scores[part] = c, x
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
        begin = np.empty(len(us), np.int64)
        begin[order] = np.concatenate(([0], np.cumsum(counts[order])[:-1])) if len(us) else 0
        n = counts[code]
        ends = np.cumsum(n)
        out = flat[np.repeat(begin[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        unit_cut = np.searchsorted(s, cut)
        sums = np.concatenate(([0.0], np.cumsum(scores[code])))
        return out, np.concatenate(([0], ends))[unit_cut], np.diff(sums[unit_cut])

    def _alone(self, data: np.ndarray, starts: np.ndarray, length: int):
        """best() for a few long units: the same relaxation, character by character."""
        ids, counts, scores = [], [], []
        step, symbol = self.step, self.symbol
        for a in starts.tolist():
            unit = data[a : a + length].tobytes()
            total, by, back = [0.0] + [-np.inf] * length, [-1] * (length + 1), [0] * (length + 1)
            state = begun = 0
            for j, b in enumerate(unit):
                if b & 0xC0 != 0x80:
                    begun = j
                state = int(step[state, symbol[b]])
                alone = j + 1 == length or unit[j + 1] & 0xC0 != 0x80
                at = int(self.first[state])
                while at:
                    size = int(self.size[at])
                    if (value := total[j + 1 - size] + float(self.score[at])) > total[j + 1]:
                        total[j + 1], by[j + 1], back[j + 1] = value, int(self.piece[at]), size
                    alone = alone and j + 1 - size != begun
                    at = int(self.link[at])
                if alone and (value := total[begun] + self.unknown_score) > total[j + 1]:
                    total[j + 1], by[j + 1], back[j + 1] = value, -1, j + 1 - begun
            path, at = [], length
            while at:
                if by[at] < 0:
                    path += [int(self.byte_ids[b]) for b in reversed(unit[at - back[at] : at])] if self.vocabulary.byte_ids else [self.vocabulary.unknown]
                else:
                    path.append(by[at])
                at -= back[at]
            ids += path[::-1]
            counts.append(len(path)), scores.append(total[length])
        return np.array(ids, np.int64), np.array(counts, np.int64), np.array(scores)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets; the space in front is taken off again."""
        flat, cut = _piece_bytes(self.vocabulary)
        sizes = np.diff(cut)[ids]
        ends = np.cumsum(sizes)
        data = flat[np.repeat(cut[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate(([0], ends))[offsets]
        drop = at[:-1][(np.diff(at) > 0)]
        drop = drop[data[drop] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], np.concatenate(([0], np.cumsum(keep)))[at]


@lru_cache(maxsize=4)
def _piece_bytes(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    shown = [b"" if kind == CONTROL else p for p, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
    return np.frombuffer(b"".join(shown), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in shown])))


@lru_cache(maxsize=2)
def automaton(model: bytes) -> Automaton:
    return Automaton(parse(model))


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read once by the driver and sent with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text_hash, ids, n_tokens, score (log-probability of the best path) and round_trip of every row.

    Pieces are searched in the whole text; a character in no piece is spelled in byte pieces where the model has them,
    and is the unknown piece otherwise. round_trip tells whether decoding gives the very bytes back. A null text has
    null ids, an empty one none. Rows are encoded one by one, so repeated rows and null ids are as good as any.
    """

    def work(batches):
        machine = automaton(model)
        for batch in batches:
            raw, at = buffers(batch.column(2))
            gone = np.asarray(batch.column(2).is_null())
            for first, last in runs(at, RUN):
                part, cut = raw[at[first] : at[last]], at[first : last + 1] - at[first]
                ids, offsets, score = machine.encode(part, cut)
                back, back_cut = machine.decode(ids, offsets)
                if len(back) == len(part) and (back_cut == cut).all():
                    differs = np.concatenate(([0], np.cumsum(back != part)))[cut]
                    same = np.diff(differs) == 0
                else:
                    same = np.array([back[back_cut[i] : back_cut[i + 1]].tobytes() == part[cut[i] : cut[i + 1]].tobytes() for i in range(last - first)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=pa.array(gone[first:last]))
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists, pa.array(np.diff(offsets)), pa.array(score), pa.array(same)], ["doc_id", "text_hash", "ids", "n_tokens", "score", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, ids array<int>, n_tokens long, score double, round_trip boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""

    def work(batches):
        machine = automaton(model)
        for batch in batches:
            lists = batch.column(1)
            ids, at = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0))))
            data, cut = machine.decode(ids, at)
            gone = lists.is_null().to_pylist()
            texts = [None if gone[i] else data[cut[i] : cut[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
