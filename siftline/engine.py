"""The engine behind one interface: index repositories, keep them fresh, and answer what agents ask."""

from __future__ import annotations

import os
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .functions import text as T
from .operators import embed, expand, facets, hybrid, indexes, lookup, registry, search, store, structure, task, usage
from .sources.repo import RepositorySource
from .sources.snapshots import SnapshotTable
from .streaming import upkeep

CHUNKS = (
    "id string, repo_id string, file_path string, language string, symbol_name string, symbol_type string, parent_symbol string, start_line int, end_line int, content string, "
    "content_hash string, file_hash string, embedding array<double>, last_indexed_at string, imports array<string>, literals array<string>, signature string, calls array<string>, defines array<string>, exports array<string>"
)


class EngineError(Exception):
    """What went wrong and what to do about it."""

    def __init__(self, message: str, recovery: str):
        super().__init__(message)
        self.recovery = recovery

    def reply(self) -> dict:
        return {"ok": False, "message": str(self), "recovery": self.recovery}


class Engine:
    """Indexes below a folder that all executors see, one chunk table a repository."""

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or settings.load()
        self.provider = embed.provider(self.config["embedding"]["provider"], dimensions=int(self.config["embedding"]["dimensions"]))
        self.documents = registry.Documents(spark, self.folder)
        spark.dataSource.register(RepositorySource)

    # -- repositories

    def _id(self, path: str) -> str:
        return self.spark.range(1).select(registry.repo_id(F.lit(path)).alias("x")).first().x

    def list_indexed_repos(self) -> DataFrame:
        states = self.documents.read("states", {})
        rows = [tuple(s.get(c) for c in registry.FIELDS) for s in states.values()]
        return registry.listing(self.documents.entries(), self.spark.createDataFrame(rows, registry.ENTRY))

    def resolve(self, repo: str | None) -> str:
        """The id of the repository that a reference means; the only one there is, without a reference."""
        known = self.list_indexed_repos()
        if repo is None:
            ids = [r.id for r in known.select("id").limit(2).collect()]
            if len(ids) == 1:
                return ids[0]
            raise EngineError("no repository given" if ids else "nothing is indexed yet", "name one of list_indexed_repos" if ids else "index a repository first")
        found = registry.resolved(known, self.spark.createDataFrame([(repo,)], "ref string"), os.getcwd()).first()
        if not found:
            raise EngineError(f"no indexed repository is called {repo!r}", "see list_indexed_repos, or index it first")
        return found.id

    def table(self, repo_id: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.folder}/repos/{repo_id}/chunks")

    def chunks(self, repo: str | None = None) -> DataFrame:
        table = self.table(self.resolve(repo))
        if table.current() is None:
            raise EngineError("the repository is registered, but has no index", "index it first")
        return table.read()

    # -- writing

    def files_of(self, path: str) -> DataFrame:
        found = self.spark.read.format("siftline_repo").load(path)
        return found.where("skipped IS NULL").select("file_path", "content", F.sha2("content", 256).alias("file_hash"))

    def chunks_of(self, files: DataFrame, repo_id: str, now: str) -> DataFrame:
        """CHUNKS rows without vectors of files(file_path, content, file_hash)."""
        from pyspark.sql.window import Window

        from .functions.paths import language

        most, overlap = 4 * int(self.config["indexing"]["max_chunk_tokens"]), int(self.config["indexing"]["chunk_overlap"])
        rows = structure.structural_chunks(files, most, overlap).join(files.select("file_path", "file_hash"), "file_path")
        kind = F.coalesce("symbol_type", F.lit("text"))
        own = F.concat_ws(":", F.coalesce("parent_symbol", F.lit("")), kind, T.chunk_name(kind, F.col("symbol_name"), F.col("content"), F.col("chunk_index")))
        nth = F.row_number().over(Window.partitionBy("file_path", "_own").orderBy("chunk_index")) - 1
        named = rows.withColumn("_own", own).withColumn("_n", nth)
        name = F.when(F.col("_n") > 0, F.concat("_own", F.lit(":@"), F.col("_n").cast("string"))).otherwise(F.col("_own"))
        full = named.select(F.sha2(F.concat_ws(":", F.lit(repo_id), "file_path", name), 256).alias("id"), F.lit(repo_id).alias("repo_id"), "*", language(F.col("file_path")).alias("language"), T.content_hash(F.col("content")).alias("content_hash"), F.lit(now).alias("last_indexed_at"))
        return full.select(*[c.split()[0] for c in CHUNKS.split(", ") if not c.startswith("embedding ")])

    def index(self, path: str, full: bool = False) -> dict:
        """Bring the index of a repository up to date: changed files are chunked anew, chunks whose text is known keep their
        vectors, renamed files keep their chunks, what is gone goes."""
        root = os.path.realpath(path)
        repo_id, now = self._id(root), datetime.now(timezone.utc).isoformat()
        table, files = self.table(repo_id), self.files_of(root).persist()
        self.documents.write(f"progress-{repo_id}", {"started": now})
        try:
            old = table.read() if table.current() and not full else self.spark.createDataFrame([], CHUNKS)
            manifest = lookup.file_manifest(old, "last_indexed_at")
            diff = store.hash_diff(manifest, files.select("file_path", "file_hash")).persist()
            counts = {r.status: r.n for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
            moved = diff.where("status = 'renamed'").join(files.select("file_path", "file_hash"), "file_path").select(F.col("file_path").alias("new"), "file_hash")
            from_ = diff.where("status = 'moved away'").join(manifest, "file_path").select(F.col("file_path").alias("old"), "file_hash")
            kept = old.join(diff.where("status IN ('unchanged', 'moved away')").select("file_path"), "file_path", "left_semi")
            kept = store.rename(kept, from_.join(moved, "file_hash").select("old", "new")).select(*old.columns)
            dirty = files.join(diff.where("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
            fresh = self.chunks_of(dirty, repo_id, now)
            known = old.select("content_hash", "embedding").groupBy("content_hash").agg(F.first("embedding").alias("_e"))
            met = fresh.join(known, "content_hash", "left")
            have = met.where("_e IS NOT NULL").withColumn("embedding", F.col("_e"))
            need = met.where("_e IS NULL").withColumn("embedding", self.provider.embed(F.col("content")))
            columns = [c.split()[0] for c in CHUNKS.split(", ")]
            table.commit(kept.select(*columns).unionByName(have.select(*columns)).unionByName(need.select(*columns)))
            rows = table.read()
            size = rows.agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("f")).first()
            entry = {"id": repo_id, "path": root, "name": os.path.basename(root), "last_indexed_at": now, "files_indexed": size.f, "chunks_indexed": size.n, "embedding_model": self.provider.model_name}
            self.documents.register(entry)
            states = self.documents.read("states", {})
            states[repo_id] = entry
            self.documents.write("states", states)
            return {"repo_id": repo_id, **{k: counts.get(k, 0) for k in ("new", "changed", "removed", "renamed", "unchanged")}, "chunks": size.n}
        finally:
            files.unpersist()
            self.documents.remove(f"progress-{repo_id}")

    def build_indexes(self, repo: str | None = None) -> str:
        """Write the postings, and the vector index where there are rows enough for one."""
        repo_id, rows = self.resolve(repo), self.chunks(repo)
        indexes.Postings(f"{self.folder}/repos/{repo_id}/fts").build(rows.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
        n, state = rows.count(), self.documents.read(f"ann-{repo_id}", {})
        todo = indexes.wants_index(n, state.get("rows"))
        if todo == "train":
            indexes.Cells(f"{self.folder}/repos/{repo_id}/ann").build(rows.select(F.col("id").alias("vec_id"), "embedding"))
            self.documents.write(f"ann-{repo_id}", {"rows": n})
        elif todo == "none":
            self.documents.remove(f"ann-{repo_id}")
        return todo

    def forget(self, repo: str) -> None:
        """Take a repository out of the registry and delete its tables."""
        repo_id = self.resolve(repo)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/repos/{repo_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.documents.unregister(repo_id)
        states = self.documents.read("states", {})
        states.pop(repo_id, None)
        self.documents.write("states", states)

    # -- reading

    def index_status(self, repo: str | None = None) -> dict:
        """The repository's entry, whether it is being indexed, and whether its files have changed since."""
        repo_id = self.resolve(repo)
        entry = self.list_indexed_repos().where(F.col("id") == repo_id).first().asDict()
        measure = lambda rows: rows.agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("file_path", F.lit(":"), "file_hash"))), ","), 256).alias("fingerprint")).withColumn("repo_id", F.lit(repo_id))
        manifest, files = lookup.file_manifest(self.chunks(repo), "last_indexed_at"), self.files_of(entry["path"]).select("file_path", "file_hash")
        sample = store.evenly_spaced(manifest, "file_path")
        then, now = measure(manifest.join(sample, "file_path", "left_semi")), measure(files.join(F.broadcast(sample), "file_path", "left_semi"))
        n_then, n_now = manifest.count(), self.files_of(entry["path"]).where("content <> ''").count()
        stale = n_then != n_now or upkeep.staleness(now, then).first().stale
        return {**entry, "indexing": self.documents.read(f"progress-{repo_id}") is not None, "stale": bool(stale)}

    def search_codebase(self, query: str, limit: int | None = None, min_score: float = 0.0, repo: str | None = None) -> DataFrame:
        """rank, id, file_path, start_line, end_line, symbol_name, total, sources and content of the best chunks."""
        limit = min(int(limit or self.config["search"]["limit"]), 50)
        rows = self.chunks(repo)
        docs = rows.select(F.col("id").alias("doc_id"), F.col("content").alias("text"), *hybrid.OPTIONAL)
        asked = self.spark.createDataFrame([("q", query)], "query_id string, text string")
        found = hybrid.hybrid_search(docs, asked, limit, self.provider).where(F.col("total") >= min_score)
        return found.join(rows.select("id", "file_path", "start_line", "end_line", "symbol_name", "content"), "id").select("rank", "id", "file_path", "start_line", "end_line", "symbol_name", "total", "sources", "content").orderBy("rank")

    def search_symbol(self, name: str, limit: int = 20, repo: str | None = None) -> DataFrame:
        rows = self.chunks(repo)
        found = lookup.symbol_search(rows, self.spark.createDataFrame([(name,)], "name string"), "id", "symbol_name", min(limit, 100))
        return found.join(rows.select("id", "file_path", "start_line", "end_line", "symbol_name", "symbol_type", "parent_symbol"), "id").orderBy("file_path", "start_line")

    def find_references(self, symbol: str, limit: int = 50, repo: str | None = None) -> DataFrame:
        rows = self.chunks(repo)
        found = lookup.find_references(rows, self.spark.createDataFrame([(symbol,)], "symbol string"), min(limit, 200))
        return found.join(rows.select("id", "start_line", "end_line"), "id").orderBy("file_path", "start_line")

    def get_file_context(self, ranges: Iterable[str], repo: str | None = None) -> str:
        """The blocks of at most twelve ranges ("file", "file:line", "file:first-last"), read from the working tree."""
        from .functions.words import range_ref

        repo_id = self.resolve(repo)
        root = self.list_indexed_repos().where(F.col("id") == repo_id).first().path
        asked = self.spark.createDataFrame([(i, r) for i, r in enumerate(list(ranges)[:12])], "nth int, ref string").select(F.lit(0).cast("long").alias("call_id"), "nth", range_ref(F.col("ref")).alias("r"))
        wanted = asked.select("call_id", "nth", F.col("r.file").alias("file_path"), "r.start_line", "r.end_line")
        files = self.files_of(root).join(F.broadcast(wanted.select("file_path").distinct()), "file_path", "left_semi")
        return lookup.render_ranges(lookup.read_ranges(files, wanted)).first().text

    def get_repo_context(self, repo: str | None = None) -> dict:
        """Languages by share, the ten largest folders, files and chunks."""
        rows = self.chunks(repo)
        files = rows.groupBy("file_path").agg(F.max("language").alias("language"))
        n = files.count()
        langs = [(r.language, round(1000 * r["n"] / n) / 10) for r in files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").collect()]
        folder = F.when(F.col("file_path").contains("/"), F.split("file_path", "/")[0]).otherwise(".")
        dirs = [(r.d, r["n"]) for r in files.groupBy(folder.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(10).collect()]
        return {"files": n, "chunks": rows.count(), "languages": langs, "directories": dirs}

    def aliases(self, repo: str | None = None) -> list:
        repo_id = self.resolve(repo)
        root = self.list_indexed_repos().where(F.col("id") == repo_id).first().path
        rows = {r.file_path: r.content for r in self.files_of(root).where(F.col("file_path").isin("tsconfig.json", "jsconfig.json")).select("file_path", "content").collect()}
        return next((found for name in ("tsconfig.json", "jsconfig.json") if (found := expand.read_aliases(rows.get(name)))), [])

    def task_context(self, tasks: dict[str, str], repo: str | None = None) -> task.Context:
        asked = self.spark.createDataFrame(list(tasks.items()), "query_id string, text string")
        return task.task_context(self.chunks(repo), asked, self.provider, self.aliases(repo), int(self.config["retrieval"]["hops"]), float(self.config["retrieval"]["threshold"]))

    def get_task_context(self, request: str, repo: str | None = None) -> str:
        """The reply to one task, as text; low confidence opens the file system for a while."""
        found = self.task_context({"t": request}, repo)
        sure = found.confidence.first()
        if sure and (sure.score or 0.0) < float(self.config["retrieval"]["threshold"]):
            self.documents.grant(sure.reason, int(datetime.now(timezone.utc).timestamp() * 1000), self.resolve(repo))
        entry = self.list_indexed_repos().where(F.col("id") == self.resolve(repo)).first()
        reply = task.rendered(found, entry.name).first()
        text = reply.text if reply else f"{entry.name} · nothing found"
        self.record("get_task_context", text, entry)
        return text

    # -- usage

    def record(self, tool: str, reply: str, entry) -> None:
        """Add a retrieval to the usage log; a log that cannot be written never breaks an answer."""
        try:
            now = datetime.now(timezone.utc).isoformat()
            baseline = self.spark.range(1).select(usage.heuristic(F.lit(int(entry.files_indexed or 0))).alias("b")).first().b
            usage.append(self.spark.createDataFrame([(now, "mcp_retrieval", tool, entry.path, -(-len(reply) // 4), baseline, None)], usage.EVENT).coalesce(1), f"{self.folder}/usage")
        except Exception:
            return

    def savings(self, rate: float = usage.RATE, turns: int = usage.TURNS) -> DataFrame:
        return usage.summary(usage.read(self.spark, f"{self.folder}/usage"), ["repo"], rate, turns)

    def bench(self, tasks: DataFrame, repo: str | None = None) -> DataFrame:
        """Ranking metrics of tasks(query_id, text, labels array<struct<file_path string, level int>>) by chunk search, beside what
        a scan of the tree would cost."""
        rows = self.chunks(repo)
        docs = rows.select(F.col("id").alias("doc_id"), F.col("content").alias("text"), *hybrid.OPTIONAL)
        found = hybrid.hybrid_search(docs, tasks.select("query_id", "text"), 20, self.provider).join(rows.select("id", "file_path", T.token_estimate(F.col("content")).alias("tokens")), "id")
        files = search.top_k(found.groupBy("query_id", "file_path").agg(F.min("rank").alias("_r"), F.sum("tokens").alias("tokens")), ["query_id"], ["_r"], 20)
        from .operators.evaluate import ir_metrics

        labels = tasks.select("query_id", F.explode("labels").alias("l")).select("query_id", F.col("l.file_path").alias("id"), F.col("l.level").alias("level"))
        metrics = ir_metrics(files.select("query_id", F.col("file_path").alias("id"), "rank"), labels)
        keyword = tasks.select("query_id", F.element_at(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)), -1).alias("keyword")).where("keyword IS NOT NULL")
        whole = rows.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "content"))), lambda x: x.content), "\n").alias("content"))
        scanned = usage.scan_cost(whole, keyword)
        sent = files.groupBy("query_id").agg(F.sum("tokens").alias("search_tokens"))
        return metrics.join(usage.savings(scanned, sent), "query_id", "left")

    def watch(self, stream: DataFrame, checkpoint: str, path: str):
        """Keep a repository's index in step with a stream of change events(seq, repo_id, type, path)."""
        return upkeep.applied(stream, checkpoint, lambda actions, full: self.index(path, False))

    def plan(self, request: str) -> dict:
        return facets.plan_one(request)
