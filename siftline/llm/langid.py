"""Language ID by hyperdimensional profiles: trigram vectors bound from permuted letter vectors, bundled, compared by cosine."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 8192  # signs of a vector
PART = 1024  # of which so many are worked on at a time
BLOCK = 8192  # trigrams whose vectors are held at a time
CELLS = 1 << 24  # texts compared at a time, by the trigrams of all of them
CHARS = 1 << 19  # characters of a text that are read at a time
POINT = np.uint64(21)  # bits of a code point


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: unit rows, one for each learned language."""

    langs: tuple[str, ...]
    prototypes: np.ndarray


@lru_cache
def _symbol_table() -> np.ndarray:
    """The letter that each code point stands for, lower-cased, as a code point of its own; 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x32400):
        if (c := chr(point)).isalpha():
            table[point] = ord(unicodedata.normalize("NFC", c.lower())[0])
    return table


@lru_cache(maxsize=1 << 14)
def letter_vector(letter: int) -> np.ndarray:
    """WIDTH random signs drawn for the letter alone, so every letter of every script has a vector of its own."""
    bits = np.random.default_rng((1729, letter)).bytes(WIDTH // 8)
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, first: int = 0, last: int = WIDTH) -> np.ndarray:
    """(grams, last - first) signs: the letters' vectors, permuted by their place in the trigram and multiplied."""
    mask = (np.uint64(1) << POINT) - np.uint64(1)
    out = None
    for place in range(3):
        letters, which = np.unique((grams >> (POINT * np.uint64(2 - place))) & mask, return_inverse=True)
        own = np.stack([np.roll(letter_vector(int(x)), 2 - place)[first:last] for x in letters]) if len(letters) else np.zeros((0, last - first), np.int8)
        out = own[which] if out is None else out * own[which]
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a whole text and how often they stand in it. All that is no letter is a gap, gaps in a row are
    one, and there is one before and after the text. Long texts are read in pieces that share two symbols."""
    held, grams, times = np.zeros(1, np.uint64), [], []
    for at in range(0, len(text or ""), CHARS):
        points = np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "replace"), np.uint32)
        s = np.concatenate((held, _symbol_table()[points].astype(np.uint64)))
        if at + CHARS >= len(text):
            s = np.append(s, np.uint64(0))
        s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]
        held = s[-2:]
        if len(s) > 2:
            found, n = np.unique((s[:-2] << (POINT * np.uint64(2))) | (s[1:-1] << POINT) | s[2:], return_counts=True)
            grams.append(found), times.append(n)
    if len(grams) < 2:
        return (grams[0], times[0]) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found, which = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(which, np.concatenate(times)).astype(np.int64)


def learn(docs: DataFrame) -> Profiles:
    """Profiles from the rows of docs(text, lang) with a text and a lang; each language bundles all grams of its texts.

    Gram counts are summed inside each batch, then by a shuffle; the tasks that hold them bundle them, so the driver gets
    WIDTH numbers a language, however many grams the languages have. Other columns are not read; without rows nothing
    is learned.
    """

    def count(batches):
        for batch in batches:
            kept: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = gram_counts(text)
                if len(found[0]):
                    kept.setdefault(lang, []).append(found)
            for lang, parts in kept.items():
                grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            grams, n = np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)).astype(np.float64)
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(np.asarray(langs.indices) == i)
                total = sums.setdefault(lang, np.zeros(WIDTH + 1))
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    total[:-1] += n[part].astype(np.float64) @ gram_vectors(grams[part]).astype(np.float32)
                total[-1] += n[own].sum()
        for lang, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["lang", "at", "x"])

    counts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.mapInArrow(bundle, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    langs = tuple(sorted(rows["lang"].unique()))
    sums = np.zeros((len(langs), WIDTH + 1))
    sums[rows["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(int), rows["at"].to_numpy()] = rows["x"].to_numpy()
    prototypes = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
    if len(langs) > 1:
        prototypes -= prototypes.mean(axis=0)  # what all languages share tells nothing
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Profiles(langs, (prototypes / np.where(norm > 0, norm, 1)).astype(np.float32))


def cosines(found: list[tuple[np.ndarray, np.ndarray]], prototypes: np.ndarray) -> np.ndarray:
    """(texts, languages) cosines of texts' bundled trigram vectors with the prototypes, from their gram_counts(); NaN
    without letters."""
    grams, which = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
    counts = np.zeros((len(found), len(grams)), np.float32)
    counts[owner, which] = np.concatenate([n for _, n in found])
    dot, square = np.zeros((len(found), len(prototypes))), np.zeros(len(found))
    for at in range(0, WIDTH, PART):
        vectors = np.zeros((len(found), PART))
        for first in range(0, len(grams), BLOCK):
            vectors += counts[:, first : first + BLOCK] @ gram_vectors(grams[first : first + BLOCK], at, at + PART).astype(np.float32)
        dot += vectors @ prototypes[:, at : at + PART].T
        square += (vectors * vectors).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = dot / np.sqrt(square)[:, None]
    out[np.array([len(g) == 0 for g, _ in found], bool)] = np.nan
    return out


def _grouped(texts: pa.Array):
    """gram_counts() of the texts, as many at a time as CELLS allows, one at least."""
    found, total = [], 0
    for text in texts:
        own = gram_counts(text.as_py())
        if found and (len(found) + 1) * (total + len(own[0])) > CELLS:
            yield found
            found, total = [], 0
        found.append(own)
        total += len(own[0])
    if found:
        yield found


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    A document vector is the sum of its trigram vectors, over the whole text however long; the language of the nearest
    prototype by cosine wins, ties by name. The score maps that cosine from -1..1 to 0..1. A text that is null or has no
    letters gets und and 0; so does every text if no language was learned. Rows are judged one by one, so repeated rows
    and null ids do not matter; other columns are not read; an empty table gives an empty result.
    """
    langs, prototypes = profiles.langs, profiles.prototypes

    def work(batches):
        for batch in batches:
            names, scores = [], []
            for found in _grouped(batch.column(1)):
                cos = cosines(found, prototypes) if len(langs) else np.full((len(found), 1), np.nan)
                none = np.isnan(cos[:, 0])
                best = np.where(none, 0, np.argmax(np.nan_to_num(cos, nan=-2.0), axis=1))
                names += ["und" if x else langs[i] for x, i in zip(none.tolist(), best.tolist(), strict=True)]
                scores += np.where(none, 0.0, np.clip((1 + cos[np.arange(len(cos)), best]) / 2, 0, 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
