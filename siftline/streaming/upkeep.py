"""Keeping an index fresh: retries with growing pauses, folders turned into files, and how stale a repository is."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .watch import FULL_ABOVE

#: Fixed values, in milliseconds: first and longest pause, age at which a change counts as missed, life of a measurement,
#: longest wait for a first one; and the queue above which everything is indexed anew.
PAUSE, LONGEST, GRACE, TTL, WAIT = 2_000, 300_000, 5_000, 60_000, 150
QUEUE = 1_000


@dataclass(frozen=True)
class Upkeep:
    """What a watcher knows: events not yet indexed, whether all must be, since when, and how the last attempt went."""

    queue: tuple = ()
    full: bool = True
    pending_since: int | None = None
    pause: int = 0
    failing: bool = False
    caught_up: bool = False

    def heard(self, events: tuple, now: int) -> Upkeep:
        return replace(self, queue=self.queue + events, pending_since=now if self.pending_since is None else self.pending_since) if events else self

    def succeeded(self) -> Upkeep:
        return Upkeep(full=False, caught_up=True)

    def failed(self, taken: tuple, took_full: bool, since: int) -> Upkeep:
        """After a failed attempt: what it took stands at the front again; a long queue collapses to a full index."""
        queue = taken + self.queue
        long = len(queue) > QUEUE
        return replace(self, queue=() if long else queue, full=took_full or long or self.full, pending_since=min(since, self.pending_since or since), pause=PAUSE if not self.pause else min(2 * self.pause, LONGEST), failing=True)

    def stale(self, now: int) -> bool | None:
        """None until the first success; then whether it fails, or a change waits for longer than GRACE."""
        if not self.caught_up:
            return None
        return self.failing or (self.pending_since is not None and now - self.pending_since > GRACE)


def attempt(state: Upkeep, index: Callable[[tuple, bool], None], now: int) -> Upkeep:
    """One run of the indexer over the whole queue."""
    taken, full = state.queue, state.full
    try:
        index(taken, full)
    except Exception:  # whatever the indexer raises is tried again
        return replace(state, queue=(), full=False).failed(taken, full, state.pending_since if state.pending_since is not None else now)
    return state.succeeded()


def applied(stream: DataFrame, checkpoint: str, index: Callable[[DataFrame, bool], None]):
    """Start a query over change events that indexes every micro-batch, with pauses and retries as Upkeep has them. A batch
    that fails LONGEST times over fails the query, whose checkpoint then repeats it."""
    from .watch import compact, plan

    def run(batch: DataFrame, _: int) -> None:
        actions = compact(batch).persist()
        try:
            full, pause = plan(batch).where("mode = 'full'").limit(1).count() > 0, 0
            while True:
                try:
                    index(actions, full)
                    return
                except Exception:
                    pause = PAUSE if not pause else 2 * pause
                    if pause > LONGEST:
                        raise
                    time.sleep(pause / 1000)
        finally:
            actions.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()


def with_folders(actions: DataFrame, folders: DataFrame, files: DataFrame, indexed: DataFrame) -> DataFrame:
    """actions(repo_id, path, action) with those of folders(repo_id, path, action) added: a new folder upserts the files(repo_id,
    path) beneath it, a deleted one deletes what is indexed(repo_id, path) beneath it. Files meet folders by their own prefixes.
    What is asked for a path itself wins over its folder."""
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))

    def beneath(rows: DataFrame, action: str) -> DataFrame:
        each = rows.where(F.col("path").contains("/")).select("repo_id", "path", F.explode(prefixes).alias("_folder"))
        own = folders.where(F.col("action") == action).select("repo_id", F.regexp_replace("path", "/+$", "").alias("_folder")).distinct()
        return each.join(own, ["repo_id", "_folder"], "left_semi").select("repo_id", "path", F.lit(action).alias("action")).distinct()

    ranked = actions.select("repo_id", "path", "action", F.lit(0).alias("n")).unionByName(beneath(files, "upsert").withColumn("n", F.lit(1))).unionByName(beneath(indexed, "delete").withColumn("n", F.lit(2)))
    return ranked.groupBy("repo_id", "path").agg(F.min_by("action", "n").alias("action"))


def mode_of(actions: DataFrame) -> DataFrame:
    """(repo_id, mode): full above FULL_ABOVE actions."""
    return actions.groupBy("repo_id").agg(F.when(F.count("*") > FULL_ABOVE, "full").otherwise("partial").alias("mode"))


def admitted_paths(events: DataFrame, hidden: Callable[[str], bool]) -> DataFrame:
    """Events whose path the ignore rules and the secret rules let in; hidden(path) tells."""
    from ..functions.paths import is_secret

    @F.udf("boolean")
    def shown(path):
        return path is not None and not hidden(path)

    return events.where(~is_secret(F.col("path"))).where(shown("path"))


def watched_staleness(caught_up, failing, pending_since_ms, now_ms) -> Column:
    """Null until a watcher has caught up; then whether it fails or a change waits for longer than GRACE."""
    return F.when(caught_up, failing | F.coalesce(now_ms - pending_since_ms > GRACE, F.lit(False)))


def staleness(measured: DataFrame, states: DataFrame) -> DataFrame:
    """(repo_id, stale) of measured(repo_id, files, fingerprint) against states(repo_id, files, fingerprint) at the last index:
    another number of files, or another fingerprint of the sample where the state has one. A repository without files
    is stale if its state had some; one without a state is unknown."""
    now, then = measured.alias("m"), states.alias("s")
    met = then.join(now, "repo_id", "full_outer")
    differs = (F.coalesce("m.files", F.lit(0)) != F.col("s.files")) | (F.col("s.fingerprint").isNotNull() & ~F.col("m.fingerprint").eqNullSafe(F.col("s.fingerprint")))
    return met.select("repo_id", F.when(F.col("s.files").isNotNull(), differs).alias("stale"))


@dataclass
class FreshnessCache:
    """Staleness by repository: a watcher's word, else a measurement that is served for TTL and renewed in the background.
    A reply waits for a first measurement no longer than WAIT; until it is there the answer is None."""

    measure: Callable[[str], bool | None]
    clock: Callable[[], int] = lambda: int(time.time() * 1000)
    ttl: int = TTL
    wait: int = WAIT
    watchers: dict[str, Callable[[], Upkeep]] = field(default_factory=dict)
    _known: dict[str, tuple[bool | None, int]] = field(default_factory=dict)
    _running: dict[str, Future] = field(default_factory=dict)
    _pool: ThreadPoolExecutor = field(default_factory=lambda: ThreadPoolExecutor(2))

    def _renew(self, repo: str) -> Future:
        if repo not in self._running:

            def run() -> None:
                try:
                    value = self.measure(repo)
                except Exception:
                    value = None
                self._known[repo] = (value, self.clock())
                self._running.pop(repo, None)

            self._running[repo] = self._pool.submit(run)
        return self._running[repo]

    def peek(self, repo: str) -> bool | None:
        now = self.clock()
        if repo in self.watchers and (told := self.watchers[repo]().stale(now)) is not None:
            return told
        if repo not in self._known:
            try:
                self._renew(repo).result(timeout=self.wait / 1000)
            except (TimeoutError, KeyError):
                return None
        elif now - self._known[repo][1] > self.ttl:
            self._renew(repo)
        return self._known.get(repo, (None, 0))[0]


@dataclass
class Watchers:
    """Queries by repository, started and stopped as the registry says."""

    start: Callable[[str], object]
    running: dict[str, object] = field(default_factory=dict)

    def follow(self, repos: list[str]) -> tuple[list[str], list[str]]:
        """Start what is new and stop what is gone; what could not start is tried again next time."""
        gone = [r for r in self.running if r not in repos]
        for repo in gone:
            self.running.pop(repo).stop()
        fresh = []
        for repo in repos:
            if repo not in self.running:
                try:
                    self.running[repo] = self.start(repo)
                    fresh.append(repo)
                except Exception:
                    continue
        return fresh, gone
