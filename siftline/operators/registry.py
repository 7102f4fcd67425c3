"""Which repositories are indexed, and which of them a name, a path or an open folder means."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import repo_id
from .expand import one_path

ENTRY = "id string, path string, name string, last_indexed_at string, files_indexed long, chunks_indexed long, embedding_model string"
FIELDS = [c.split()[0] for c in ENTRY.split(", ")]


def listing(registered: DataFrame, states: DataFrame) -> DataFrame:
    """ENTRY rows of the registry and the repositories' own states (ENTRY too), which win where both know one; entries
    without a path are left out, the rest are sorted by name."""
    own, other = states.alias("s"), registered.alias("r")
    met = own.join(other, F.col("s.id") == F.col("r.id"), "full_outer")
    known = F.col("s.id").isNotNull()
    pick = {
        "id": F.coalesce("s.id", "r.id"), "path": F.coalesce("s.path", "r.path", F.lit("")), "name": F.coalesce("s.name", "r.name", F.col("s.id")),
        **{c: F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"r.{c}")) for c in FIELDS[3:]},
    }
    return met.select(*[e.alias(c) for c, e in pick.items()]).where("path <> ''").orderBy(F.lower("name"), "name", "id")


def resolved(repos: DataFrame, refs: DataFrame, root: str = "/") -> DataFrame:
    """(ref, id, how) of refs(ref): by id, else by a name that only one repository has, else by path, else by the id that the
    path has, else by the end of a path (the first by name). Relative paths start at root; unknown references are left out."""
    asked = refs.select("ref", F.trim("ref").alias("t")).distinct().where("t <> ''")
    absolute = F.regexp_replace(F.when(F.col("t").startswith("/"), F.col("t")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("t", r"^\./", ""))), "(?<=.)/+$", "")
    asked = asked.withColumn("p", absolute).withColumn("pid", repo_id(absolute)).withColumn("tail", F.element_at(F.split("t", "/"), -1))
    own = repos.select("id", "path", "name", F.element_at(F.split("path", "/"), -1).alias("tail"))
    alone = own.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1")
    ways = [
        (1, "id", asked.join(own, asked.t == own.id).select("ref", own.id, F.lit("").alias("name"))),
        (2, "name", asked.join(alone, F.lower("t") == F.col("low")).select("ref", "id", F.lit("").alias("name"))),
        (3, "path", asked.join(own, asked.p == own.path).select("ref", own.id, own.name)),
        (4, "computed id", asked.join(own, asked.pid == own.id).select("ref", own.id, own.name)),
        (5, "suffix", asked.join(own, "tail").where(F.col("path").endswith(F.concat(F.lit("/"), "t"))).select("ref", "id", "name")),
    ]
    every = None
    for n, how, df in ways:
        df = df.select("ref", "id", "name", F.lit(n).alias("way"), F.lit(how).alias("how"))
        every = df if every is None else every.unionByName(df)
    return one_path(every, ["ref"], ["way", "name", "id"]).select("ref", "id", "how")


def containing_repo(repos: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, repo) of paths(path): the deepest of repos(path) that is the path or holds it. Paths meet repositories by each of
    their own prefixes, of which there are few."""
    clean = F.regexp_replace("path", "(?<=.)/+$", "")
    asked = paths.select("path", clean.alias("_p")).distinct()
    steps = F.filter(F.split("_p", "/"), lambda x: x != "")
    prefix = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")))
    each = asked.select("path", F.explode(prefix).alias("_own"))
    own = repos.select(F.col("path").alias("repo"), F.regexp_replace("path", "(?<=.)/+$", "").alias("_own")).where("_own <> ''")
    return one_path(each.join(own, "_own"), ["path"], [F.desc(F.length("_own")), "repo"]).select("path", "repo")


def children(repos: DataFrame, parent: str) -> DataFrame:
    """Repositories at or below a folder."""
    root = parent.rstrip("/") or "/"
    return repos.where((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/"))


def git_roots(folder: str) -> list[str]:
    """The repository that holds a folder, else the repositories below it in order of name, else the folder itself."""
    at = os.path.realpath(folder)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return [at]
        if (up := os.path.dirname(at)) == at:
            break
        at = up
    found = []
    for here, folders, _ in os.walk(os.path.realpath(folder)):
        if ".git" in folders or os.path.exists(os.path.join(here, ".git")):
            found.append(here)
            folders[:] = []
        else:
            folders[:] = [f for f in folders if f != "node_modules" and not f.startswith(".")]
    return sorted(found) or [os.path.realpath(folder)]


class Documents:
    """Small JSON documents (registry, state, progress, watch status, grants) in a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str, default=None):
        """The document; the default where it is missing or no JSON."""
        path, files = self._at(name)
        try:
            if not files.exists(path):
                return default
            stream = files.open(path)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
            finally:
                stream.close()
        except ValueError:
            return default

    def write(self, name: str, value) -> None:
        """Replace the document: written beside it and renamed, so nobody reads half of it."""
        path, files = self._at(name)
        fresh, _ = self._at(f"{name}.new")
        stream = files.create(fresh, True)
        stream.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode("utf-8")))
        stream.close()
        files.delete(path, False)
        files.rename(fresh, path)

    def remove(self, name: str) -> None:
        path, files = self._at(name)
        files.delete(path, False)

    def entries(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e.get(c) for c in FIELDS) for e in (self.read("registry") or {"repos": []})["repos"]], ENTRY)

    def register(self, entry: dict) -> None:
        """Add an entry to the registry, in place of one with its id."""
        repos = (self.read("registry") or {"repos": []})["repos"]
        self.write("registry", {"repos": [*(e for e in repos if e["id"] != entry["id"]), entry]})

    def unregister(self, repo: str) -> None:
        repos = (self.read("registry") or {"repos": []})["repos"]
        self.write("registry", {"repos": [e for e in repos if e["id"] != repo]})

    def grant(self, reason: str, now_ms: int, repo: str | None = None, window_ms: int = 600_000) -> None:
        """Allow searches of the file system for ten minutes."""
        self.write("fallback", {"allowed_until_ms": now_ms + window_ms, "reason": reason, "repo": repo})

    def granted(self, now_ms: int) -> bool:
        record = self.read("fallback")
        return isinstance(record, dict) and isinstance(record.get("allowed_until_ms"), int) and record["allowed_until_ms"] > now_ms
