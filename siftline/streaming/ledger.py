"""What each context has been sent already: line hashes by file as keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Life of a context after its last use, contexts kept, lines that a stub must stand for.
TTL_MS, CONTEXTS, STUB = 45 * 60 * 1000, 64, 8


def stubs(seen: np.ndarray, least: int = STUB) -> np.ndarray:
    """Which lines of a range are named instead of sent: those in runs of seen lines of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], seen.astype(np.int8), [0]))))
    out = np.zeros(len(seen), bool)
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        out[a:b] = b - a >= least
    return out


class Ledger(StatefulProcessor):
    """State of a context: a map from file to its known lines and their hashes; only the files of a batch are read and written."""

    def __init__(self, expire: bool = True):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "lines array<long>, hashes array<long>", TTL_MS if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["call_seq", "path", "line_no"], kind="stable")
        out = []
        for path, own in batch.groupby("path", sort=False):
            held = self.files.getValue((path,)) if self.files.containsKey((path,)) else None
            known = dict(zip(held[0], held[1], strict=True)) if held else {}
            for _, call in own.groupby("call_seq", sort=True):
                seen = np.array([known.get(n) == h for n, h in zip(call["line_no"], call["hash"], strict=True)], bool)
                known.update(zip(call["line_no"].tolist(), call["hash"].tolist(), strict=True))
                out.append(call.assign(ctx=key[0], seen=seen, stub=stubs(seen)))
            self.files.updateValue((path,), (list(known), list(known.values())))
        yield pd.concat(out)[["ctx", "call_seq", "path", "line_no", "seen", "stub"]]

    def close(self) -> None:
        pass


def seen_lines(lines: DataFrame, expire: bool = True) -> DataFrame:
    """A stream of (ctx, call_seq, path, line_no, hash) -> whether the context has that line of that file as it is now, and
    whether it is named by a stub instead of sent again. A call's lines of a file are one range, in order.

    With expire a file is forgotten TTL_MS after its last use. The state store must be RocksDB
    (spark.sql.streaming.stateStore.providerClass), which this sets for the session.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "ctx string, call_seq long, path string, line_no long, seen boolean, stub boolean"
    return lines.groupBy("ctx").transformWithStateInPandas(Ledger(expire), schema, "append", "ProcessingTime" if expire else "None")


def live_contexts(calls: DataFrame, most: int = CONTEXTS, ttl_ms: int = TTL_MS) -> DataFrame:
    """(ctx, last_used) of calls(ctx, used timestamp): the contexts used within ttl_ms before the latest call, the `most` latest
    of them. Every range of hours is ranked on its own; only those that survive meet in one small ranking."""
    last = calls.groupBy("ctx").agg(F.max("used").alias("last_used"))
    latest = last.agg(F.max("last_used").alias("_latest"))
    fresh = last.join(F.broadcast(latest), F.lit(True)).where(F.unix_millis("_latest") - F.unix_millis("last_used") <= ttl_ms).drop("_latest")
    return fresh.orderBy(F.desc("last_used"), "ctx").limit(most)


def classified(lines: DataFrame, known: DataFrame, least: int = STUB) -> DataFrame:
    """(ctx, path, lo, hi, seen) of a batch lines(ctx, path, line_no, hash) against known(ctx, path, line_no, hash): maximal runs,
    seen ones of fewer than `least` lines folded into what is new around them."""
    held = known.select("ctx", "path", "line_no", F.col("hash").alias("_h"))
    marked = lines.join(held, ["ctx", "path", "line_no"], "left").withColumn("seen", F.coalesce(F.col("hash") == F.col("_h"), F.lit(False)))
    w = Window.partitionBy("ctx", "path").orderBy("line_no")

    def runs(df: DataFrame) -> DataFrame:
        changed = F.coalesce((F.lag("seen").over(w) != F.col("seen")).cast("int"), F.lit(1))
        return df.withColumn("_c", changed).withColumn("_r", F.sum("_c").over(w))

    sized = runs(marked).withColumn("_n", F.count("*").over(Window.partitionBy("ctx", "path", "_r")))
    folded = sized.select("ctx", "path", "line_no", (F.col("seen") & (F.col("_n") >= least)).alias("seen"))
    return runs(folded).groupBy("ctx", "path", "_r", "seen").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).select("ctx", "path", "lo", "hi", "seen")
