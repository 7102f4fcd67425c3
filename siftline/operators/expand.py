"""Expansion of a selection along imports, references, tests and configuration, and the edges it follows."""

from __future__ import annotations

import json
import posixpath
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..session import staged
from .lookup import containing, tests_of_stem
from .search import top_k

#: Extensions and index files that an import without an extension may mean, in the order they are tried.
SOURCE_EXTENSIONS = ".ts .tsx .js .jsx .mts .cts .mjs .cjs".split()
INDEX_FILES = "index.ts index.tsx index.js".split()
#: Imports followed a chunk, rows taken an import, references looked at, files and chunks a reference, tests, configuration files.
IMPORTS, PER_IMPORT, REFERENCES, REFERENCE_FILES, PER_FILE, TESTS, CONFIGS = 8, 8, 12, 8, 4, 4, 8

Alias = tuple[str, list[str]]


def read_aliases(text: str | None) -> list[Alias]:
    """(prefix, targets) of compilerOptions.paths in a tsconfig or jsconfig file, the longest prefix first; none where the
    text is no JSON once comments are gone."""
    bare = re.sub(r"(?m)^\s*//.*$", "", re.sub(r"(?s)/\*.*?\*/", "", text or ""))
    try:
        options = json.loads(bare).get("compilerOptions") or {}
        found = dict(options.get("paths") or {})
    except (ValueError, AttributeError, TypeError):
        return []
    base = str(options.get("baseUrl") or ".").replace("\\", "/").removesuffix("/")
    clean = lambda p: p.removesuffix("*").replace("\\", "/")
    out = [(clean(pattern), [posixpath.normpath(posixpath.join("" if base == "." else base, clean(t))) for t in targets]) for pattern, targets in found.items()]
    return sorted(out, key=lambda a: -len(a[0]))


def _inside(path: str) -> bool:
    return bool(path) and path != ".." and not path.startswith(("../", "/"))


def _sources(path: str) -> list[str]:
    """What an import of a path without a sure extension may be: the path, its stem, each extension, each index file."""
    stem = re.sub(r"\.[cm]?[jt]sx?$", "", path, flags=re.I)
    tried = [path, stem, *(stem + e for e in SOURCE_EXTENSIONS), *(posixpath.join(stem, i) for i in INDEX_FILES)]
    return [p for p in dict.fromkeys(tried) if _inside(p)]


def _modules(path: str) -> list[str]:
    return [f"{path}.py", f"{path}/__init__.py"] if _inside(path.lstrip("/")) else []


def import_paths(importer: str, spec: str, aliases: list[Alias] = ()) -> list[str]:
    """Files of the repository that an import may mean: relative ones, aliases, dotted modules of Python. What leaves the
    root, and packages from elsewhere, mean none."""
    spec, folder, python = re.sub(r"['\"]", "", spec.strip()), posixpath.dirname(importer.replace("\\", "/")), importer.endswith(".py")
    if spec.startswith("."):
        if not python:
            target = posixpath.normpath(posixpath.join(folder, spec))
            return _sources(target) if _inside(target) else []
        name = spec.lstrip(".")
        for _ in range(len(spec) - len(name) - 1):
            folder = posixpath.dirname(folder)
        target = posixpath.normpath(posixpath.join(folder, name.replace(".", "/")))
        return _modules(target) if target != "." else []
    for prefix, targets in aliases if spec else ():
        if spec.startswith(prefix):
            found = [p for t in targets for p in _sources(posixpath.normpath(posixpath.join(t, spec[len(prefix) :])))]
            if found:
                return found
    return _modules(spec.replace(".", "/")) if python and "." in spec else []


def import_targets(chunks: DataFrame, aliases: list[Alias] = ()) -> DataFrame:
    """(id, file_path, nth, spec, target) of chunks(id, file_path, imports): every path that one of the first IMPORTS imports
    of a chunk may mean; addresses of the web are no imports."""

    @F.pandas_udf("array<string>")
    def resolve(paths: pd.Series, specs: pd.Series) -> pd.Series:
        return pd.Series([import_paths(p, s, aliases) for p, s in zip(paths, specs, strict=True)])

    local = F.slice(F.filter("imports", lambda s: ~s.startswith("http")), 1, IMPORTS)
    each = chunks.where("file_path IS NOT NULL").select("id", "file_path", F.posexplode(local).alias("nth", "spec"))
    return each.select("id", "file_path", "nth", "spec", F.explode(resolve("file_path", "spec")).alias("target"))


def along_imports(seeds: DataFrame, chunks: DataFrame, aliases: list[Alias] = ()) -> DataFrame:
    """(query_id, src_file, id, dst_file, reason): at most PER_IMPORT chunks by id that each import of the seeds(query_id, id)
    may mean."""
    own = chunks.join(seeds.select("id").distinct(), "id", "left_semi").select("id", "file_path", "imports")
    targets = import_targets(own, aliases).select(F.col("id").alias("_seed"), F.col("file_path").alias("src_file"), "nth", "spec", "target").distinct()
    met = targets.join(chunks.select("id", F.col("file_path").alias("target")), "target")
    few = top_k(met, ["_seed", "nth"], ["id"], PER_IMPORT)
    return seeds.select("query_id", F.col("id").alias("_seed")).join(few, "_seed").select("query_id", "src_file", "id", F.col("target").alias("dst_file"), F.concat(F.lit("import of "), "spec").alias("reason"))


def along_references(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of files that mention a seed's symbol: REFERENCES mentions a symbol, of them REFERENCE_FILES files, PER_FILE chunks each."""
    own = chunks.join(seeds.select("id").distinct(), "id", "left_semi").where("symbol_name IS NOT NULL").select("id", F.col("file_path").alias("src_file"), "symbol_name")
    hits = containing(chunks, own.select(F.col("symbol_name").alias("needle")), "id")
    first = top_k(hits, ["needle"], ["id"], REFERENCES).drop("rank").join(chunks.select("id", "file_path"), "id")
    files = top_k(first.groupBy("needle", "file_path").agg(F.min("id").alias("_first")), ["needle"], ["_first"], REFERENCE_FILES).select("needle", "file_path")
    rows = top_k(chunks.select("id", "file_path"), ["file_path"], ["id"], PER_FILE).drop("rank").join(files, "file_path")
    met = seeds.select("query_id", "id").join(own, "id").select("query_id", "src_file", F.col("symbol_name").alias("needle")).join(rows, "needle")
    return met.select("query_id", "src_file", "id", F.col("file_path").alias("dst_file"), F.concat(F.lit("reference to "), "needle").alias("reason"))


def along_tests(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of files that test a seed's file: TESTS of them by id."""
    own = chunks.join(seeds.select("id").distinct(), "id", "left_semi").select("id", F.col("file_path").alias("src_file"), P.stem_of(F.col("file_path")).alias("stem"))
    files = tests_of_stem(chunks, own.select("stem"), 1 << 30)
    rows = top_k(chunks.select("id", "file_path").join(files, "file_path"), ["stem"], ["id"], TESTS).drop("rank")
    met = seeds.select("query_id", "id").join(own, "id").drop("id").join(rows, "stem")
    return met.select("query_id", "src_file", "id", F.col("file_path").alias("dst_file"), F.concat(F.lit("tests for "), "stem").alias("reason"))


def configurations(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first CONFIGS chunks of configuration files by id, for every query(query_id)."""
    rows = chunks.where(P.is_config(F.col("file_path"))).select("id", "file_path").orderBy("id").limit(CONFIGS)
    met = queries.select("query_id").distinct().join(F.broadcast(rows), F.lit(True))
    return met.select("query_id", F.lit(None).cast("string").alias("src_file"), "id", F.col("file_path").alias("dst_file"), F.lit("configuration file").alias("reason"))


#: Keyword signal of what an expansion brings, and its other signal.
BRINGS = {"imports": (0.2, "dependency"), "references": (0.2, "reference"), "tests": (0.3, None), "config": (0.4, None)}


def expanded(queries: DataFrame, seeds: DataFrame, chunks: DataFrame, aliases: list[Alias] = (), hops: int = 2, frontier: int = 8) -> DataFrame:
    """(query_id, hop, type, src_file, id, dst_file, reason, keyword, dependency, reference) reached from seeds(query_id, id)
    in at most `hops` steps over chunks(id, file_path, symbol_name, imports, content).

    Imports are always followed; references, tests and configuration files if the operations of queries(query_id,
    operations) ask for them, the last only in the first step. The first `frontier` new chunks of a query are followed on.
    """
    wants = lambda op: queries.where(F.array_contains("operations", op)).select("query_id")
    now, known, out = seeds.select("query_id", "id").distinct(), seeds.select("query_id", "id").distinct(), []
    for hop in range(1, hops + 1):
        steps = {"imports": along_imports(now, chunks, aliases), "references": along_references(now.join(wants("find_references"), "query_id", "left_semi"), chunks), "tests": along_tests(now.join(wants("find_tests"), "query_id", "left_semi"), chunks)}
        if hop == 1:
            steps["config"] = configurations(wants("find_config"), chunks)
        found = [df.withColumn("hop", F.lit(hop)).withColumn("type", F.lit(kind)) for kind, df in steps.items()]
        own = staged(reduce(DataFrame.unionByName, found), f"hop{hop}")
        out.append(own)
        fresh = own.where("type <> 'config'").select("query_id", "id").distinct().join(known, ["query_id", "id"], "left_anti")
        known = known.unionByName(fresh)
        now = staged(top_k(fresh, ["query_id"], ["id"], frontier).drop("rank"), f"frontier{hop}")
    every = reduce(DataFrame.unionByName, out).groupBy("query_id", "type", "src_file", "id", "dst_file").agg(F.min("hop").alias("hop"), F.min("reason").alias("reason"))
    part = lambda i: F.create_map(*[x for k, v in BRINGS.items() for x in (F.lit(k), F.lit(v[0]) if i == "keyword" else F.lit(1.0 if v[1] == i else 0.0))])[F.col("type")]
    return every.select("query_id", "hop", "type", "src_file", "id", "dst_file", "reason", part("keyword").alias("keyword"), part("dependency").alias("dependency"), part("reference").alias("reference"))


def relationships(reached: DataFrame) -> DataFrame:
    """(query_id, src_file, dst_file, type): the edges of an expansion, each once, without edges of a file to itself."""
    return reached.where("src_file IS NOT NULL AND src_file <> dst_file").select("query_id", "src_file", "dst_file", "type").distinct()


def one_path(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of every group in that order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
