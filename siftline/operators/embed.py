"""Embedding providers; the hash provider is deterministic and needs no service."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[A-Za-z0-9_$-]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_OFFSET, _PRIME = np.uint32(0x811C9DC5), np.uint32(0x01000193)


@lru_cache(maxsize=1 << 16)
def _forms(token: str) -> tuple[str, ...]:
    """A token in lower case and, if it has several, its parts of two characters or more."""
    parts = [p.lower() for p in _PART.findall(token)]
    return (token.lower(), *(p for p in parts if len(p) >= 2)) if len(parts) > 1 else (token.lower(),)


def _fold(state: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a carried on from every state over codes[first : first + size], one character of all at a time."""
    state = state.copy()
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        state[live] = (state[live] ^ codes[first[live] + i]) * _PRIME
    return state


def hash_vectors(texts: list[str | None], dimensions: int = 384) -> np.ndarray:
    """One row a text: signed counts of words, their parts and pairs of neighbours, scaled to unit length; e1 where there are
    none. Words are hashed once a call, a pair goes on from the hash of its first word."""
    known: dict[str, int] = {}
    rows = [np.array([known.setdefault(w, len(known)) for token in _TOKEN.findall(t or "") for w in _forms(token)], np.int64) for t in texts]
    words = [" " + w for w in known]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    single = _fold(np.full(len(words), _OFFSET), codes, first + 1, size - 1)
    ids = np.concatenate([*rows, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    near = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, which = np.unique(ids[near] * max(1, len(words)) + ids[near + 1], return_inverse=True)
    double = _fold(single[pairs // max(1, len(words))], codes, first[pairs % max(1, len(words))], size[pairs % max(1, len(words))]) if len(pairs) else np.zeros(0, np.uint32)
    hashes, place = np.concatenate((single[ids], double[which])), np.concatenate((owner, owner[near]))
    cell = place * dimensions + (hashes % np.uint32(dimensions)).astype(np.int64)
    out = np.bincount(cell, np.where(hashes >= 1 << 31, -1.0, 1.0), len(rows) * dimensions).reshape(len(rows), dimensions)
    norm = np.linalg.norm(out, axis=1)
    out[norm == 0, 0] = 1.0
    return out / np.where(norm == 0, 1.0, norm)[:, None]


def hash_vector(text: str | None, dimensions: int = 384) -> np.ndarray:
    return hash_vectors([text], dimensions)[0]


def feature_counts(docs: DataFrame, key: str, pattern: str = r"[a-z0-9_]{3,}", dimensions: int = 384) -> DataFrame:
    """(key, bucket, weight): signed counts of the words of every text by hash bucket. Every text is counted where it lies, each
    distinct word of a batch is hashed once, and nothing is shuffled; null texts have no words."""
    word = re.compile(pattern)

    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                known: dict[str, int] = {}
                rows = [np.array([known.setdefault(w, len(known)) for w in word.findall((t or "").lower())], np.int64) for t in part.column(1).to_pylist()]
                codes = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
                size = np.array([len(w) for w in known], np.int64)
                hashes = _fold(np.full(len(known), _OFFSET), codes, np.cumsum(size) - size, size)
                own = hashes[np.concatenate([*rows, np.zeros(0, np.int64)])]
                cell, which = np.unique(np.repeat(np.arange(len(rows)), [len(r) for r in rows]) * dimensions + (own % np.uint32(dimensions)).astype(np.int64), return_inverse=True)
                weight = np.bincount(which, np.where(own >= 1 << 31, -1.0, 1.0), len(cell)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cell // dimensions)), pa.array((cell % dimensions).astype(np.int32)), pa.array(weight)], [key, "bucket", "weight"])

    return docs.select(key, "text").mapInArrow(work, f"{key} {docs.schema[key].dataType.simpleString()}, bucket int, weight long")


class Hash:
    """The offline provider: embed(column) is a column of unit vectors, embed_batch(texts) their matrix."""

    model_name = "hash"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str | None]) -> np.ndarray:
        return hash_vectors(texts, self.dimensions)

    def embed(self, text: Column) -> Column:
        """A batch of texts at a time; whatever a provider loads is loaded once a worker."""
        batch = self.embed_batch

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield pd.Series(list(np.concatenate([batch(texts[i : i + 1024].tolist()) for i in range(0, len(texts), 1024)]))) if len(texts) else pd.Series([], dtype=object)

        return run(text)


class Remembered:
    """A provider that keeps the vectors of the last `size` queries it was asked for on the driver."""

    def __init__(self, provider, size: int = 64):
        self.provider, self.size, self.model_name, self.dimensions = provider, size, provider.model_name, provider.dimensions
        self._kept: OrderedDict[str, np.ndarray] = OrderedDict()

    def embed(self, text: Column) -> Column:
        return self.provider.embed(text)

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(texts) if t not in self._kept]
        found = {t: self._kept[t] for t in texts if t in self._kept} | (dict(zip(new, self.provider.embed_batch(new), strict=True)) if new else {})
        for t in new:
            self._kept[t] = found[t]
            while len(self._kept) > self.size:
                self._kept.popitem(last=False)
        return np.array([found[t] for t in texts])


PROVIDERS = {"hash": Hash}


def provider(name: str = "hash", **options):
    """A provider by name; services are left to whoever registers one in PROVIDERS."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider called {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)
