"""Order-dependent selection of a bounded candidate pool per query."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    chunks: int = 8
    tokens: int = 8000
    per_file: int = 2
    per_symbol: int = 2
    min_score: float = 0.0
    expansion_files: int | None = None
    expansion_top: int = 5


@dataclass
class _Taken:
    """What has been chosen so far for one query."""

    files: Counter = field(default_factory=Counter)
    symbols: Counter = field(default_factory=Counter)
    ranges: dict = field(default_factory=dict)
    tokens: int = 0
    n: int = 0

    def objection(self, row, limits: Limits) -> str | None:
        lo, hi = int(row.start_line), int(row.end_line)
        if any(min(hi, b) - max(lo, a) + 1 >= 0.5 * (min(hi - lo, b - a) + 1) for a, b in self.ranges.get(row.file, ())):
            return "overlap"
        if self.files[row.file] >= limits.per_file:
            return "per_file_cap"
        return "per_symbol_cap" if self.symbols[_symbol(row)] >= limits.per_symbol else None

    def too_long(self, row, limits: Limits) -> bool:
        return bool(limits.tokens) and self.n > 0 and self.tokens + row.tokens > limits.tokens

    def take(self, row) -> None:
        self.files[row.file] += 1
        self.symbols[_symbol(row)] += 1
        self.ranges.setdefault(row.file, []).append((int(row.start_line), int(row.end_line)))
        self.tokens += int(row.tokens)
        self.n += 1


def _symbol(row) -> str:
    return (row.symbol if isinstance(row.symbol, str) else f"{row.file}:{row.start_line}").lower()


def _ordered(pool: pd.DataFrame) -> pd.DataFrame:
    return pool.sort_values(["total", "file", "start_line", "id"], ascending=[False, True, True, True])


def pack(pool: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """Each candidate in total order is chosen unless something speaks against it; the first such reason is recorded."""
    taken, words, side_files, rows = _Taken(), [], set(), []
    for row in _ordered(pool).itertuples(index=False):
        own = frozenset(re.findall(r"[a-z0-9_]{3,}", row.content.lower()))
        aside = bool(row.expansion) and taken.n < limits.expansion_top and limits.expansion_files is not None and row.file not in side_files and len(side_files) >= limits.expansion_files
        reason = "limit" if taken.n >= limits.chunks else "min_score" if row.total < limits.min_score else taken.objection(row, limits)
        reason = reason or ("expansion_top_k_cap" if aside else "token_budget" if taken.too_long(row, limits) else None)
        if reason is None and len(own) >= 12 and any(len(w) >= 12 and len(own & w) / len(own | w) >= 0.8 for w in words):
            reason = "duplicate"
        if reason is None:
            taken.take(row)
            words.append(own)
            if row.expansion:
                side_files.add(row.file)
        rows.append((row.query_id, row.id, reason is None, reason or "selected", taken.n if reason is None else None))
    return pd.DataFrame(rows, columns=["query_id", "id", "selected", "reason", "position"]).astype({"position": "Int64"})


def cover(pool: pd.DataFrame, weights: list[float], limits: Limits) -> pd.DataFrame:
    """Repeatedly the candidate with the greatest gain for its cost; best and second evidence per facet decide the gain."""
    left = list(_ordered(pool).itertuples(index=False))
    taken, evidence, rows = _Taken(), [(0.0, 0.0)] * len(weights), []

    def gain(row) -> float:
        g = sum(w * (max(0.0, v - best) + 0.3 * max(0.0, min(v, best) - second)) for w, v, (best, second) in zip(weights, row.relevance, evidence, strict=True))
        return g + 0.15 * row.total if g > 0 else 0.0

    while left and taken.n < limits.chunks:
        fit = [(gain(r) / math.sqrt(max(1.0, r.tokens / 200)), -i) for i, r in enumerate(left) if not taken.objection(r, limits) and not taken.too_long(r, limits)]
        value, at = max(fit, default=(0.0, 0))
        if value <= 0 or gain(left[-at]) < 0.02:
            break
        row = left.pop(-at)
        evidence = [tuple(sorted((*pair, v))[:0:-1]) for pair, v in zip(evidence, row.relevance, strict=True)]
        taken.take(row)
        rows.append((row.query_id, row.id, taken.n, float(sum(w * b for w, (b, _) in zip(weights, evidence, strict=True)))))
    return pd.DataFrame(rows, columns=["query_id", "id", "position", "coverage"])


def greedy_pack(pool: DataFrame, limits: Limits) -> DataFrame:
    """query_id, id, selected, reason, position of every candidate; a query's pool is bounded by its producers."""
    kind = pool.schema["query_id"].dataType.simpleString()
    return pool.groupBy("query_id").applyInPandas(lambda p: pack(p, limits), f"query_id {kind}, id string, selected boolean, reason string, position long")


def coverage_greedy(pool: DataFrame, weights: list[float], limits: Limits) -> DataFrame:
    """query_id, id, position, coverage of the chosen; pool has relevance, one number for each facet."""
    kind = pool.schema["query_id"].dataType.simpleString()
    return pool.groupBy("query_id").applyInPandas(lambda p: cover(p, weights, limits), f"query_id {kind}, id string, position long, coverage double")
