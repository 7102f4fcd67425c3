"""Chunkers: greedy line windows of any text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def windows_of(text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start line, end line, content): as many whole lines as fit, starting `overlap` lines before the last end where
    that is progress; a longer line stands alone, in slices."""
    if not text:
        return
    lines, start = text.split("\n"), 0
    while start < len(lines):
        if len(lines[start]) > max_chars:
            for at in range(0, len(lines[start]), max_chars):
                yield start + 1, start + 1, lines[start][at : at + max_chars]
            start += 1
            continue
        end, used = start, 0
        while end < len(lines) and (end == start or used + len(lines[end]) + 1 <= max_chars):
            used += len(lines[end]) + 1
            end += 1
        yield start + 1, end, "\n".join(lines[start:end])
        if end >= len(lines):
            return
        start = end - overlap if end - overlap > start else end


def text_windows(docs: DataFrame, key: str, max_chars: int = 3200, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, start_line, end_line, content) of every row with a text."""

    def work(batches):
        for batch in batches:
            rows = [(k, i, a, b, c) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (a, b, c) in enumerate(windows_of(text or "", max_chars, overlap))]
            columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())], [key, "chunk_index", "start_line", "end_line", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(work, f"{key} {kind}, chunk_index int, start_line long, end_line long, content string")
