"""Scoring, facets, lookups, expansion, selection and the engine as a whole, against literal expectations and plain twins."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import config
from siftline.functions import words as W
from siftline.operators import embed, expand, facets, hybrid, indexes, intent, lookup, policy, registry, search, signals, structure, task, usage
from siftline.streaming import ledger, upkeep

WORDS = ["computeChunkId", "IDs", "HTTPServer", "queries", "gas", "was", "ties", "classes", "boxes", "running", "the", "files", "userX2Y", "APIs", "a1b", "reuse", "bus", "Handled", "re-used_thing"]


def column(spark, values, kind, expr):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()]


def test_words_as_columns_and_plain(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(9))) for _ in range(80)] + [None, "", "How does the watcher handle versus copes"]
    assert column(spark, texts, "string", W.words_of) == [W.plain_words(t) for t in texts]
    assert [sorted(x) for x in column(spark, texts, "string", W.content_words)] == [sorted(W.plain_content_words(t)) for t in texts]
    assert W.plain_content_words(texts[-1]) == ["watcher"]
    assert {"comput", "chunk", "id", "computechunkid"} <= set(W.plain_words("computeChunkId"))
    assert [W.plain_singular(w) for w in ("gas", "was", "ties", "ids", "bus", "queries", "glasses", "boxes", "status", "cats")] == ["gas", "was", "tie", "id", "bus", "query", "glass", "box", "status", "cat"]


def test_text_helpers(spark):
    assert column(spark, ["a /* x */ b", "u = 'http://x' // y", "# no\n#!/bin/sh\ncode # yes"], "string", W.strip_comments) == ["a  b", "u = 'http://x' ", "\n#!/bin/sh\ncode # yes"]
    refs = column(spark, ["src/a.ts:120-168", "src/a.ts:9", " src/a.ts ", "a:7-3"], "string", W.range_ref)
    assert [(r.file, r.start_line, r.end_line) for r in refs] == [("src/a.ts", 120, 168), ("src/a.ts", 9, 9), ("src/a.ts", None, None), ("a", 7, 7)]
    assert column(spark, [0, 1023, 1024, 1536, 5 << 20, 3 << 40], "long", W.bytes_text) == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 TB"]
    assert column(spark, [12.345, 0.5, 0.00123], "double", W.dollars) == ["$12.35", "$0.500", "$0.0012"] or column(spark, [12.0, 0.5, 0.00123], "double", W.dollars) == ["$12.00", "$0.500", "$0.0012"]
    code = spark.createDataFrame([("program.command('go-now [x]')", "go-now"), ("call( \"a.b\" )", "a.b"), ("x('axb')", "a.b"), ("y('other')", "go")], "c string, t string")
    assert [r.y for r in code.select(W.registers(F.col("c"), F.col("t")).alias("y")).collect()] == [True, True, False, False]


def test_what_a_query_names():
    ask = signals.Asked
    named = lambda path, q, only=(): signals.file_named(path, ask(q), frozenset(only))
    assert named("src/retrieval/hybrid.ts", "refactor src/retrieval/hybrid.ts") == 1 and named("src/taskContext.ts", "rate limit get_task_context") == 1
    assert named("src/discover.ts", "discoverable") == named("cli/index.ts", "index") == named("types.ts", "the types") == named("a/server.ts", "the server") == 0
    assert named("vscode/install.ts", "vscode install") == 0.8 and named("src/jsonc.ts", "parse jsonc", ["jsonc"]) == 0.8 and named("x/jsonc.json", "parse jsonc", ["jsonc"]) == 0
    assert named("a/instructionSkills.ts", "skill for instructions") == 0.8
    score = lambda name, q, kind="function", path="src/a.ts", parent=None: signals.symbol_score(name, parent, kind, path, ask(q))
    assert score("run", "running the indexer") == 0 and score("run", "where is run defined") == 1 and score("User", "user versus workspace installation") == 0.5
    assert score("getTaskContext", "rate limit get_task_context") == 1 and score("TaskContext", "the task context", "class") == 1 and score("taskContext", "the task context", "const") == 0.5
    assert score("vscode-install", "run vscode-install now", "command") == 1 and score("savings", "the savings report", "command") == 0.5 and score("savings", "npx savings", "command") == 1
    assert score("it works", "it works", "test") == 0 and score(None, "use Auth here", parent="Auth") == 0.5 and score("getTaskContext", "get_task_context", path="a.test.ts") == 0.5
    assert signals.path_score("src/retrieval/score.ts", ask("retrieval weights of chunks")) == pytest.approx(1 / 3)


def _scored(spark, **over):
    row = {"query_id": "q", "query": "x", "id": "1", "file_path": "src/a.ts", "symbol_name": None, "parent_symbol": None, "symbol_type": None, "content": "abcd", "last_indexed_at": None, "specific": None, "semantic": 0.0, "keyword": 0.0, "dependency": None, "reference": None, "path_hint": None, "exact_identifier": False} | over
    kinds = {"specific": "array<string>", "exact_identifier": "boolean", **dict.fromkeys(("semantic", "keyword", "dependency", "reference", "path_hint"), "double")}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))
    return signals.scored(df, F.to_timestamp(F.lit("2024-01-08T00:00:00Z"))).first()


def test_signals_floors_and_factors(spark):
    assert _scored(spark, semantic=1.0).total == 0.7 and _scored(spark, keyword=1.0).total == 0.2
    assert _scored(spark, query="where is run defined", symbol_name="run").total == 0.95
    assert _scored(spark, keyword=0.5, exact_identifier=True).total == 0.885 and _scored(spark, query="open src/a.ts").total == 0.9
    got = _scored(spark, semantic=1.0, file_path="docs/guide.md", query="fix the bug")
    assert got.total == 0.49 and _scored(spark, semantic=1.0, file_path="docs/guide.md", query="update the documentation").total == 0.7
    assert _scored(spark, semantic=1.0, file_path="src/x.test.ts").total == 0.595 and _scored(spark, semantic=1.0, file_path="src/x.test.ts", query="write tests").total == 0.73
    assert _scored(spark, last_indexed_at="2024-01-08T00:00:00Z").s_recency == 1 and _scored(spark, last_indexed_at="2023-12-01T00:00:00Z").s_recency == 0 and _scored(spark, last_indexed_at="nonsense").s_recency == 0


def test_intent_of_tasks():
    i = intent.analyse_one("Fix `refreshToken` in src/auth.ts and update tests for MAX_RETRY_COUNT --dry-run, multi-root; see LanceVectorStore, OpenAI and get_task_context, run `npx build-all`")
    assert i["files"] == ["src/auth.ts"] and i["languages"] == ["typescript"] and i["operations"] == ["find_implementation", "find_tests"]
    assert {"refreshToken", "MAX_RETRY_COUNT", "LanceVectorStore", "get_task_context"} <= set(i["symbols"]) and not {"OpenAI", "multi", "root"} & set(i["symbols"])
    assert {"--dry-run", "MAX_RETRY_COUNT", "get_task_context", "build-all", "refreshToken"} <= set(i["exact_terms"]) and "LanceVectorStore" not in i["exact_terms"]
    shapes = {"MAX_X": "env", "snake_case": "snake", "lowerCamel": "camel", "HTTPServerPool": "pascal", "OpenAI": None, "MCP": None, "plain": None, "Word": None, "x_": None}
    assert {w: intent.shape(w) for w in shapes} == shapes
    assert intent.analyse_one(None)["symbols"] == [] and intent.analyse_one("explain the deep architecture")["mode"] == "deep"
    assert intent.analyse_one("add a thing, fix it and then write tests or docs")["clauses"] == 3


def test_facet_plan():
    short = facets.plan_one("where is the watcher")
    assert short["route"] == "focused" and len(short["facets"]) == 1 and short["facets"][0]["weight"] == 1
    long = facets.plan_one("Index new files on save, embed changed chunks with `embedBatch`, and remove deleted files from the store; report progress in --json output")
    assert long["route"] == "broad" and [f["facet_id"] for f in long["facets"]] == ["f0", "f1", "f2", "f3", "task"]
    assert sum(f["weight"] for f in long["facets"]) == pytest.approx(1) and long["facets"][-1]["auxiliary"]
    by = {f["facet_id"]: f for f in long["facets"]}
    assert by["f1"]["anchors"] == ["embedBatch"] and by["f1"]["kind"] == "symbol" and by["f3"]["kind"] == "flag" and by["f1"]["weight"] > by["f0"]["weight"]
    merged = facets.plan_one("retry failed uploads, retry the failed uploads, cache parsed results, or so")
    assert [f["label"] for f in merged["facets"]][:1] == ["retry failed uploads; retry the failed uploads"]
    assert len([f for f in facets.plan_one(", ".join(f"handle widget{i} errors in module{i}" for i in range(20)))["facets"] if not f["auxiliary"]]) == 10


def test_relevance_report_and_calls(spark):
    chunks = [("q", "a", "src/alpha.ts", "openStore", "open the store and read rows", [], False), ("q", "b", "src/beta.ts", None, "close everything", ["--flag"], False), ("q", "c", "docs/x.md", None, "open the store and read rows", [], False), ("q", "d", "src/d.test.ts", None, "close everything", [], True)]
    cand = spark.createDataFrame([(*r, False, False) for r in chunks], "query_id string, id string, file string, symbol string, content string, literals array<string>, is_test boolean, wants_docs boolean, wants_tests boolean")
    plan = spark.createDataFrame([("q", "f0", ["open", "stor"], [], 0.5, "open", "concept", False), ("q", "f1", ["clos"], ["--flag"], 0.3, "close", "flag", False), ("q", "f2", ["absent"], [], 0.2, "gone", "concept", False)], "query_id string, facet_id string, terms array<string>, anchors array<string>, weight double, label string, kind string, auxiliary boolean")
    ranks = spark.createDataFrame([("q", "f0", "b", 0), ("q", "f0", "a", 3)], "query_id string, facet_id string, id string, rank int")
    got = {(r.id, r.facet_id): r.relevance for r in facets.relevance(cand, plan, ranks).collect()}
    idf = {"open": math.log(1 + 4 / 3), "stor": math.log(1 + 4 / 3)}
    assert got[("a", "f0")] == pytest.approx(0.5 * sum(idf.values()) / sum(idf.values()) + 0.5 / 2) and got[("b", "f0")] == pytest.approx(0.5)
    assert got[("c", "f0")] == pytest.approx(0.55 * 0.5) and got[("b", "f1")] == 1 and got[("d", "f1")] == pytest.approx(0.55 * 0.5) and got[("a", "f2")] == 0
    rel = facets.relevance(cand, plan, ranks)
    chosen = spark.createDataFrame([("q", "a", "src/alpha.ts", 1, 9, 1)], "query_id string, id string, file string, start_line long, end_line long, position long")
    rep = facets.report(chosen, plan, rel)
    assert {r.facet_id: (r.status, r.strength, r.evidence) for r in rep.collect()} == {"f0": ("covered", 0.75, ["src/alpha.ts:1-9"]), "f1": ("missing", 0.0, []), "f2": ("missing", 0.0, [])}
    done = facets.completeness(rep).first()
    assert not done.complete and done.score == 0.38 and done.reason == "Covers 1 of 3 parts. missing: close; gone."
    pool = cand.select("query_id", "id", "file", F.lit(1).cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line"), F.lit(0.5).alias("total"), F.lit(100).cast("long").alias("tokens"))
    reads = facets.follow_ups(pool, chosen, rep, rel)
    assert [(r.facet_id, r.id) for r in reads.collect()] == [("f1", "b")]
    calls = [(r.nth, r.tool, json.loads(r.args), r.tokens) for r in facets.next_calls(rep, facets.completeness(rep), reads).orderBy("nth").collect()]
    assert calls == [(1, "get_file_context", {"ranges": ["src/beta.ts:1-9"]}, 120), (2, "search_codebase", {"query": "gone", "limit": 3}, 600)]
    asked = spark.createDataFrame([(0.5, "src/a.ts", "fix it"), (0.5, "README.md", "fix it"), (None, None, "x"), (0.1, "a.ts", "y")], "t double, p string, q string")
    assert [r.y for r in asked.select(facets.confidence(F.col("t"), F.col("p"), F.col("q")).alias("y")).collect()] == [0.5, pytest.approx(0.14), 0.0, 0.1]


def test_containing_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookup, "NEEDLES", 5)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.randrange(30)))) for i in range(60)] + [(90, None), (91, "")]
    needles = ["a", "ab", "aa", "é ", "bab", "", "zz", "ab"]
    got = {(r.id, r.needle): r.times for r in lookup.containing(spark.createDataFrame(rows, "id int, content string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "id").collect()}
    want = {(i, n): len(re.findall(f"(?={re.escape(n)})", t)) for i, t in rows if t for n in set(needles) if n and n in t}
    assert got == want
    assert lookup.containing(spark.createDataFrame(rows, "id int, content string"), spark.createDataFrame([], "needle string"), "id").count() == 0


def test_ranges_and_lookups(spark):
    files = spark.createDataFrame([("a.ts", "\n".join(f"l{i}" for i in range(1, 501))), ("b.ts", "x  \ny"), (".env", "k")], "file_path string, content string")
    asked = spark.createDataFrame([(0, 1, "a.ts", 1, 500), (0, 2, "a.ts", 450, None), (0, 3, "b.ts", 9, 9), (0, 4, "nope", None, None), (0, 5, "a.ts", None, None), (0, 6, "b.ts", None, None), (0, 7, "a.ts", 490, 495)], "call_id long, nth int, file_path string, start_line long, end_line long")
    got = {r.nth: (r.start_line, r.end_line, r.omitted_lines, r.error, len(r.content.split("\n")) if r.content else 0) for r in lookup.read_ranges(files, asked, 400, 460).collect()}
    assert got[1] == (1, 400, 100, None, 400) and got[2] == (450, 500, 0, None, 51) and got[3][3].startswith("line 9 is past") and got[4][3] == "no such file" and got[5] == (1, 9, 491, None, 9)
    assert got[6] == (1, 0, 2, None, 0) and got[7] == (490, 489, 6, None, 0)
    text = lookup.render_ranges(lookup.read_ranges(files, asked, 400, 460)).first().text
    assert "### a.ts:1-400 (of 500 lines)\nl1\n" in text and "(100 more lines below: a.ts:401-500)" in text and "### b.ts:1-2 not sent" in text
    clipped = {r.file_path: (r.start_line, r.end_line, r.error) for r in lookup.line_range(files.unionByName(spark.createDataFrame([("../x", "y")], files.schema)), F.lit(0), F.lit(900)).collect()}
    assert clipped["a.ts"] == (1, 500, None) and "secrets" in clipped[".env"][2] and "escapes" in clipped["../x"][2]
    chunks = spark.createDataFrame([("1", "src/a.ts", "function x() { use('go-now'); }"), ("2", "src/b.ts", "program.command('go-now')"), ("3", "src/c.ts", "// go-now in a comment"), ("4", "docs/d.md", "go-now"), ("5", "src/e.ts", "'go-now'"), *[(f"m{i}", f"src/m{i}.ts", "common") for i in range(6)]], "id string, file_path string, content string")
    found = {(r.term, r.file_path): (r.registered, r.rare, r.exact) for r in lookup.occurrences(chunks, spark.createDataFrame([("go-now",), ("common",)], "term string")).collect()}
    assert found[("go-now", "src/b.ts")] == (True, True, True) and found[("go-now", "src/a.ts")] == (True, True, True) and found[("go-now", "src/e.ts")] == (False, True, False)
    assert ("go-now", "src/c.ts") not in found and ("go-now", "docs/d.md") not in found and not any(x for (t, _), (_, _, x) in found.items() if t == "common")


def test_import_paths():
    assert expand.import_paths("src/a/x.ts", "./y")[:3] == ["src/a/y", "src/a/y.ts", "src/a/y.tsx"] and "src/a/y/index.ts" in expand.import_paths("src/a/x.ts", "./y")
    assert "src/b.ts" in expand.import_paths("src/a/x.ts", "../b.js") and expand.import_paths("x.ts", "../../b") == [] and expand.import_paths("x.ts", "react") == []
    assert expand.import_paths("pkg/a.py", ".util") == ["pkg/util.py", "pkg/util/__init__.py"] and expand.import_paths("pkg/sub/a.py", "..util") == ["pkg/util.py", "pkg/util/__init__.py"]
    assert expand.import_paths("a.py", "pkg.mod") == ["pkg/mod.py", "pkg/mod/__init__.py"] and expand.import_paths("a.py", "os") == []
    aliases = expand.read_aliases('{ // c\n /* x */ "compilerOptions": {"baseUrl": "./web", "paths": {"@/*": ["src/*"], "@lib/*": ["lib/*"]}}}'.replace("{ // c", "{\n// c"))
    assert [a for a, _ in aliases] == ["@lib/", "@/"] and "web/src/a.ts" in expand.import_paths("x.ts", "@/a", aliases) and "web/lib/b.ts" in expand.import_paths("x.ts", "@lib/b", aliases)
    assert expand.read_aliases("not json") == expand.read_aliases(None) == []


def test_expansion(spark):
    rows = [("1", "src/a.ts", "alpha", ["./b", "https://x"], "x"), ("2", "src/b.ts", "beta", ["./c"], "alpha()"), ("3", "src/c.ts", None, [], "z"), ("4", "src/a.test.ts", None, [], "t"), ("5", "vite.config.ts", None, [], "c"), ("6", "src/u.ts", None, [], "call alpha here")]
    chunks = spark.createDataFrame(rows, "id string, file_path string, symbol_name string, imports array<string>, content string")
    queries = spark.createDataFrame([("q", ["find_implementation", "find_tests", "find_references", "find_config"]), ("p", ["find_implementation"])], "query_id string, operations array<string>")
    seeds = spark.createDataFrame([("q", "1"), ("p", "1")], "query_id string, id string")
    got = {(r.query_id, r.type, r.dst_file): (r.hop, r.keyword, r.dependency, r.reference) for r in expand.expanded(queries, seeds, chunks).collect()}
    assert got[("q", "imports", "src/b.ts")] == (1, 0.2, 1.0, 0.0) and got[("p", "imports", "src/c.ts")][0] == 2 and got[("q", "tests", "src/a.test.ts")] == (1, 0.3, 0.0, 0.0)
    assert got[("q", "references", "src/u.ts")] == (1, 0.2, 0.0, 1.0) and got[("q", "config", "vite.config.ts")] == (1, 0.4, 0.0, 0.0)
    assert {k[1] for k in got if k[0] == "p"} == {"imports"}
    assert ("q", "src/a.ts", "src/b.ts", "imports") in {tuple(r) for r in expand.relationships(expand.expanded(queries, seeds, chunks)).collect()}


def test_vectors_and_words_match_brute_force(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).round(1)
    x[10:60] = x[5]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 50)], "query_id int, q array<double>")
    monkeypatch.setattr(search, "CELLS", 20)
    monkeypatch.setattr(search, "QUERIES", 2)
    got = {}
    for r in search.vector_top_k(asked, vectors.repartition(5), 12).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q, own in got.items():
        far = (x * x[q]).sum(axis=1)
        assert [own[k] for k in range(1, 13)] == np.lexsort((np.arange(300), -far))[:12].tolist()
    texts = [" ".join(random.Random(i).choice(["red", "green", "blue", "mint", "teal", "a"]) for _ in range(i % 13)) for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red mint"), (2, "teal none"), (3, "nothing here"), (4, "")], "query_id long, text string")
    words = [re.findall("[a-z0-9_]{3,}", t) for t in texts]
    mean, n = np.mean([len(w) for w in words]), len(words)
    want = {}
    for q, ts in ((1, ["red", "mint"]), (2, ["teal", "none"])):
        score = []
        for i, w in enumerate(words):
            s = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ts if (tf := w.count(t)) and (df := sum(t in v for v in words)))
            if s:
                score.append((-math.floor(s * 10000 + 0.5) / 10000, i))
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(sorted(score)[:9], 1)}
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.bm25(docs.repartition(3), queries, 9).collect()}
    assert found == want
    index = indexes.Postings(str(tmp_path / "fts"), buckets=4).build(docs)
    assert index.exists(spark) and {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in index.top_k(queries, 9).collect()} == want


def test_inverted_file_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = indexes.Cells(str(tmp_path / "ann")).build(vectors, sample=1000).top_k(vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10, probes=12).collect()
    hits = sum(r.vec_id in set(np.argsort(-(x @ x[r.query_id]), kind="stable")[:10]) for r in found)
    assert len(found) == 400 and hits / 400 >= 0.95
    assert [indexes.wants_index(*a) for a in ((9999, None), (10000, None), (15000, 10000), (20000, 10000))] == ["none", "train", "keep", "train"]


def plain_features(text, dimensions=384):
    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    words = []
    for token in re.findall(r"[A-Za-z0-9_$-]+", text or ""):
        parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", token)]
        words += [token.lower(), *(p for p in parts if len(parts) > 1 and len(p) >= 2)]
    v = np.zeros(dimensions)
    for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        v[fnv(f) % dimensions] += -1 if fnv(f) >> 31 else 1
    if not v.any():
        v[0] = 1
    return v / np.linalg.norm(v)


def test_hash_vectors_match_plain(spark):
    texts = [None, "", "computeChunkId of the chunk", "--", "a", "x_y Z9 $k", " ".join(WORDS), "é"]
    assert np.allclose(embed.hash_vectors(texts), [plain_features(t) for t in texts])
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", embed.Hash().embed(F.col("t")).alias("v")).collect()
    assert all(np.allclose(r.v, plain_features(texts[r.i])) for r in got)
    kept = embed.Remembered(embed.Hash(), 2)
    assert np.allclose(kept.embed_batch(["a", "b", "a"]), embed.hash_vectors(["a", "b", "a"])) and list(kept._kept) == ["a", "b"] and kept.embed_batch(["c"]).shape == (1, 384) and list(kept._kept) == ["b", "c"]
    with pytest.raises(ValueError):
        embed.provider("nowhere")


def test_structure_covers_every_line():
    for path, text in structure.FIXTURES.items():
        rows = list(structure.chunk_rows(path, text))
        covered = {n for r in rows for n in range(r[3], r[4] + 1)}
        assert {i for i, line in enumerate(text.split("\n"), 1) if line.strip()} <= covered
        assert sum(r[4] - r[3] + 1 for r in rows) == len(covered)
    named = {r[0]: r for p in ("src/cli.ts", "bin/run.sh", "pkg/main.go", "src/cli.test.ts") for r in structure.chunk_rows(p, structure.FIXTURES[p])}
    assert named["code-scan"][1] == "command" and "--dry-run" in named["code-scan"][8] and named["/a"][1] == "command" and named["wide"][3:5] == (17, 20) and named["build"][1] == "function" and named["Open"][1:3] == ("method", "Store") and named["the scanner"][1] == "test"
    assert list(structure.chunk_rows("src/cli.ts", structure.FIXTURES["src/cli.ts"]))[0][10] == ["commander"]
    cls = "export class Counter {\n  private n = 0;\n\n  /** adds */\n  @log()\n  add(x) {\n    this.n += x;\n  }\n\n  get(): number {\n    return this.n;\n  }\n  tail = 1;\n}\n"
    rows = {r[0]: r for r in structure.chunk_rows("c.ts", cls)}
    assert [d.split(":L")[0] for d in rows["Counter"][9]] == ["add", "get"] and rows["Counter"][9][1] == "get:L10-12"
    assert rows["add"][2] == "Counter" and rows["add"][3] <= 6 and rows[None][3:5] == (13, 14)
    body = "function big() {\n" + "".join(f"  step{i}(a, b, c);\n" for i in range(60)) + "  app.get('/route', handler);\n  done();\n}\n"
    parts = list(structure.chunk_rows("b.ts", body, max_chars=400))
    assert ("/route", "command", "big") in [p[:3] for p in parts] and all(len(p[5]) <= 400 for p in parts) and {n for p in parts for n in range(p[3], p[4] + 1)} >= set(range(1, 64))
    py = "import os\n\nX = 1\n\n\nclass A:\n    kind = 'a'\n\n    @property\n    def f(self):\n        return 1\n\n    other = 2\n\n    @staticmethod\n    def g():\n        pass\n\n\nprint(A())\n"
    rows = list(structure.chunk_rows("a.py", py))
    assert {n for r in rows for n in range(r[3], r[4] + 1)} >= {i for i, x in enumerate(py.split("\n"), 1) if x.strip()} and {r[0] for r in rows} >= {"A", "f", "g"}


def test_upkeep():
    s = upkeep.Upkeep().heard(("a",), 100)
    assert s.stale(0) is None

    def broken(taken, full):
        raise OSError

    s = upkeep.attempt(s, broken, 200)
    assert s.failing and s.full and s.queue == ("a",) and s.pause == 2000 and s.pending_since == 100
    for want in (4000, 8000):
        s = upkeep.attempt(s.heard(("b",), 300), broken, 300)
        assert s.pause == want
    assert s.queue == ("a", "b", "b") and upkeep.attempt(s.heard(tuple("x" * 1001), 1), broken, 1).queue == ()
    seen = []
    s = upkeep.attempt(s, lambda taken, full: seen.append((taken, full)), 400)
    assert seen == [(("a", "b", "b"), True)] and not s.failing and s.stale(0) is False and s.heard(("c",), 1000).stale(6001) is True and s.heard(("c",), 1000).stale(6000) is False
    calls, now = [], [0]
    cache = upkeep.FreshnessCache(lambda repo: calls.append(repo) or True, clock=lambda: now[0], wait=5000)
    assert cache.peek("r") is True and cache.peek("r") is True and calls == ["r"]
    cache.watchers["w"] = lambda: upkeep.Upkeep(full=False, caught_up=True)
    assert cache.peek("w") is False

    class Query:
        stopped = False

        def stop(self):
            Query.stopped = True

    watch = upkeep.Watchers(lambda repo: Query())
    assert watch.follow(["a", "b"]) == (["a", "b"], []) and watch.follow(["b"]) == ([], ["a"]) and Query.stopped


def test_stubs_and_runs(spark):
    assert ledger.stubs(np.array([1, 1, 0, 1, 1, 1], bool), 3).tolist() == [False, False, False, True, True, True]
    known = spark.createDataFrame([("c", "a", n, n * 7) for n in range(10, 41)] + [("c", "a", 50, 350)], "ctx string, path string, line_no long, hash long")
    lines = spark.createDataFrame([("c", "a", n, n * 7) for n in range(1, 61)], known.schema)
    assert sorted((r.lo, r.hi, r.seen) for r in ledger.classified(lines, known).collect()) == [(1, 9, False), (10, 40, True), (41, 60, False)]


def test_usage(spark, tmp_path):
    events = spark.createDataFrame([("t", "mcp_retrieval", "x", "r", 1200, 40_000, 1.0), ("t", "denied_scan", "x", "r", 0, 9000, None)], usage.EVENT)
    assert usage.read(spark, str(tmp_path / "none")).count() == 0
    usage.append(events, str(tmp_path / "log"))
    (tmp_path / "log" / "more.json").write_text("broken {\n")
    got = usage.summary(usage.read(spark, str(tmp_path / "log")), ["repo"]).first()
    assert (got.retrievals, got.denied, got.saved, got.saved_over_turns) == (1, 1, 38_800, 582_000) and got.usd == pytest.approx(0.1164)
    rows = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],), ([None],)], "v array<double>")
    assert [r.y for r in rows.select(usage.nearest_rank(F.col("v"), 0.5).alias("y")).collect()] == [20.0, 0.0]
    assert spark.range(1).select(usage.reduction(F.lit(100), F.lit(40)).alias("y")).first().y == 60


def test_policy(spark):
    base = dict.fromkeys([c.split()[0] for c in policy.REQUEST.split(", ")])
    cases = [({"tool": "Grep", "roots": ["/w"]}, True), ({"tool": "Grep", "path": "/w/a.ts", "roots": ["/w"]}, False), ({"tool": "Grep", "path": "/w/src", "roots": ["/w"]}, False), ({"tool": "Glob", "pattern": "**/*.ts", "directory": "/w/", "roots": ["/w"]}, True), ({"tool": "Glob", "pattern": "*.md", "roots": ["/w"]}, False), ({"event": "subagentStart", "subagent": "explore"}, True), ({"tool": "Task", "prompt": "Search the codebase"}, True), ({"tool": "Read"}, False)]
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], policy.REQUEST)
    assert [r.denied for r in policy.denied(rows).collect()] == [want for _, want in cases]
    assert [r.denied for r in policy.denied(rows, F.lit(True)).collect()] == [False, False, False, False, False, True, True, False]


def test_configuration(tmp_path):
    (tmp_path / ".siftline.yaml").write_text("search:\n  vectorWeight: 0.5\nignore: [gen/]\nunknown: 1\n")
    got = config.load(str(tmp_path), {"SIFTLINE_SEARCH_LIMIT": "7", "SIFTLINE_IGNORE": "a, b", "SIFTLINE_RETRIEVAL_HOPS": "x", "SIFTLINE_SECURITY_ALLOW_SENSITIVE_FILES": "yes"}, {"search": {"per_file": 1}}, home=str(tmp_path / "none.yaml"))
    assert got["search"]["limit"] == 7 and got["search"]["per_file"] == 1 and got["retrieval"]["hops"] == 2 and got["security"]["allow_sensitive_files"] is True and got["ignore"][-2:] == ["a", "b"]
    assert config.weights(config.DEFAULTS) == search.WEIGHTS and config.DEFAULTS["ignore"] == []
    if config.read_file(str(tmp_path / ".siftline.yaml")):
        assert got["search"]["vector_weight"] == 0.5 and got["ignore"][0] == "gen/"


def test_registry_documents(spark, tmp_path):
    docs = registry.Documents(spark, str(tmp_path / "db"))
    assert docs.read("registry") is None and docs.entries().count() == 0
    docs.register({"id": "1", "path": "/a", "name": "a"})
    docs.register({"id": "1", "path": "/b", "name": "b"})
    docs.register({"id": "2", "path": "/c", "name": "c"})
    docs.unregister("2")
    assert [(r.id, r.path) for r in docs.entries().collect()] == [("1", "/b")]
    assert not docs.granted(0) and docs.grant("low", 1000) is None and docs.granted(600_000) and not docs.granted(601_000)
    (tmp_path / "g" / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "g" / "sub" / "deep").mkdir()
    root = str((tmp_path / "g").resolve())
    assert registry.git_roots(root) == [f"{root}/sub"] and registry.git_roots(f"{root}/sub/deep") == [f"{root}/sub"]


def test_engine_end_to_end(spark, tmp_path):
    from siftline import cli, engine

    repo = tmp_path / "repo"
    for path, text in {**structure.FIXTURES, "package.json": '{"name": "x"}', ".gitignore": "skip/\n", "skip/no.ts": "export const no = 1;", "secret/.env": "K=1"}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    own = engine.Engine(spark, str(tmp_path / "db"))
    with pytest.raises(engine.EngineError):
        own.chunks()
    first = own.index(str(repo))
    assert first["new"] == len(structure.FIXTURES) + 2 and own.index_status()["stale"] is False
    (repo / "src/store.ts").rename(repo / "src/shop.ts")
    (repo / "src/auth.py").write_text(structure.FIXTURES["src/auth.py"].replace("logout", "signOut"))
    (repo / "docs/notes.txt").unlink()
    assert own.index_status()["stale"] is True
    again = own.index(str(repo))
    assert (again["renamed"], again["changed"], again["removed"], again["new"]) == (1, 1, 1, 0)
    paths = {r.file_path for r in own.chunks().select("file_path").distinct().collect()}
    assert "src/shop.ts" in paths and not {"src/store.ts", "docs/notes.txt", "skip/no.ts", "secret/.env"} & paths
    assert [(r.file_path, r.exact) for r in own.search_symbol("signOut").collect()] == [("src/auth.py", True)]
    assert {r.file_path for r in own.find_references("Store").collect()} >= {"src/shop.ts", "pkg/main.go"}
    assert own.search_codebase("where is signOut defined", 3).first().symbol_name == "signOut"
    assert "### src/auth.py:1-2 (of 16 lines)\nimport os" in own.get_file_context(["src/auth.py:1-2"])
    assert own.get_repo_context()["directories"][0][0] == "src" and own.build_indexes() == "none"
    text = own.get_task_context("where is signOut defined")
    assert "signOut" in text and text.startswith("repo · ") and own.savings().first().retrievals == 1
    tasks = spark.createDataFrame([("t", "where is signOut defined", [("src/auth.py", 1)])], "query_id string, text string, labels array<struct<file_path:string,level:int>>")
    assert own.bench(tasks).first().recall_10 == 1.0
    shown = cli.run(cli.parser().parse_args(["symbol", "signOut"]), own)
    assert shown[0]["file_path"] == "src/auth.py" and {a for a in cli.COMMANDS} >= {"index", "search", "context", "savings"}
    own.forget("repo")
    assert own.list_indexed_repos().count() == 0


def test_task_context_covers_parts(spark):
    rows = [("1", "src/store.ts", "openStore", "function", "export function openStore() { read rows from disk }", ["./disk"]), ("2", "src/disk.ts", "readRows", "function", "export function readRows() { bytes }", []), ("3", "src/net.ts", "fetchPage", "function", "export function fetchPage() { retry network request }", []), ("4", "src/other.ts", None, "block", "unrelated things about colours", []), ("5", "src/store.test.ts", None, "test", "test openStore", [])]
    chunks = spark.createDataFrame([(i, p, s, None, k, 1, 9, c, None, im, []) for i, p, s, k, c, im in rows], "id string, file_path string, symbol_name string, parent_symbol string, symbol_type string, start_line int, end_line int, content string, last_indexed_at string, imports array<string>, literals array<string>")
    queries = spark.createDataFrame([("m", "make `openStore` read rows from disk, and retry the network request in `fetchPage`; then paint the zebra"), ("s", "where is openStore defined")], "query_id string, text string")
    got = task.task_context(chunks, queries, embed.Hash(64))
    chosen = {}
    for r in got.selected.orderBy("position").collect():
        chosen.setdefault(r.query_id, []).append(r.file_path)
    assert chosen["s"] == ["src/store.ts"] and {"src/store.ts", "src/net.ts"} <= set(chosen["m"])
    status = {r.facet_id: r.status for r in got.coverage.where("query_id = 'm'").collect()}
    assert status["f0"] == status["f1"] == "covered" != status["f2"]
    sure = {r.query_id: r for r in got.confidence.collect()}
    assert sure["s"].route == "focused" and sure["s"].score == 0.95 and sure["m"].complete is False
    assert {r.tool for r in got.next_calls.where("query_id = 'm'").collect()} <= {"search_codebase", "get_file_context"}
    text = {r.query_id: r.text for r in task.rendered(got, "demo").collect()}
    assert text["m"].startswith("demo · Covers 2 of 3 parts") and "covered make `openStore`" in text["m"] and "### [1] src/" in text["s"]


def test_hybrid_prefers_what_is_named(spark):
    docs = spark.createDataFrame([(1, "plain words about things", "src/alpha.ts"), (2, "plain words about stuff", "src/betaGamma.ts"), (3, "none of it", "src/c.ts")], "doc_id long, text string, file_path string")
    asked = spark.createDataFrame([(7, "plain words of beta gamma")], "query_id long, text string")
    got = [(r["rank"], r.id) for r in hybrid.hybrid_search(docs, asked, 2, embed.Hash(64), F.to_timestamp(F.lit("2024-01-01"))).collect()]
    assert sorted(got) == [(1, 2), (2, 1)]


def test_line_updates_and_compaction(spark, tmp_path):
    from siftline.operators import store
    from siftline.sources import snapshots

    rows = spark.createDataFrame([("1", "b.ts", 1, 5), ("2", "a.ts", 6, 9)], "id string, file_path string, start_line int, end_line int")
    moved = store.update_lines(rows, spark.createDataFrame([("2", 7, 10), ("9", 1, 1)], "id string, start_line int, end_line int"))
    assert sorted(map(tuple, moved.collect())) == [("1", "b.ts", 1, 5), ("2", "a.ts", 7, 10)]
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    for _ in range(3):
        table.commit(moved)
    first = table.current()
    assert table.compact(1) != first and [r.file_path for r in table.read().collect()] == ["a.ts", "b.ts"]
    assert len(list((tmp_path / "t").glob("s-*"))) == 2 and not (tmp_path / "t" / "LOCK").exists()
    (tmp_path / "t" / "LOCK").write_text('{"host": "%s", "pid": 999999999}' % __import__("socket").gethostname())
    table.commit(moved)  # the lock of a dead process is taken over


def test_evenly_spaced_matches_plain(spark):
    from siftline.operators import store

    rng = random.Random(4)
    for n in (0, 1, 31, 32, 33, 500):
        keys = [f"src/{rng.randrange(10**6)}.ts" for _ in range(n)]
        got = sorted(r.k for r in store.evenly_spaced(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 32, cuts=7).collect())
        want = sorted(keys) if n <= 32 else [sorted(keys)[i * n // 32] for i in range(32)]
        assert got == want


def test_near_duplicate_pairs_compare_whole_sets_of_close_pairs_only(spark, monkeypatch):
    draw, staged, written = random.Random(5), search.staged, {}
    monkeypatch.setattr(search, "staged", lambda df, name: written.setdefault(name, staged(df, name)))
    rows = []
    for at in range(160):
        base = draw.sample(range(900 if at % 2 else 90), draw.choice((12, 30, 60, 700)) if at % 2 else 40)
        for n in range(draw.choice((1, 1, 2, 3))):
            own = [*base[n * len(base) // 12 :], *range(1000 + at, 1000 + at + n)]
            rows.append((draw.randrange(400), draw.choice(("x", "y", None)) if at % 8 == 0 else "x", " ".join(f"w{w:04}" for w in own)))
    rows += [rows[0], (rows[1][0], "x", " ".join(f"w{w:04}" for w in range(30)))]
    got = search.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id long, source string, text string"), "source").collect()
    sets = [(i, s, frozenset(t.split())) for i, s, t in rows if s and len(set(t.split())) >= 12]
    first = {}
    for i, s, w in sets:
        first[s, w] = min(i, first.get((s, w), i))
    sets = [x for x in sets if x[0] == first[x[1:]]]
    want = [(a, b, len(v & w)) for a, s, v in sets for b, t, w in sets if s == t and a < b and 100 * len(v & w) >= 80 * len(v | w)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    assert written["pairs"].count() <= 3 * len(want)


def test_near_duplicates_of_all_documents(spark, monkeypatch):
    from siftline.plans import catalogue

    monkeypatch.setattr(search, "WEIGHT", 900, raising=False)
    draw, rows = random.Random(8), []
    for at in range(60):
        base = draw.sample(range(600), draw.choice((1, 3, 6, 11, 25, 60)))
        for n in range(draw.choice((1, 2, 4, 40))):
            own = [w for w in base if draw.random() > 0.04] + ([600 + n] if n % 3 == 0 else [])
            rows.append((len(rows), draw.choice(("x", "y", None)), " ".join(f"w{w:04}" for w in own)))
    rows += [(len(rows), "x", "a b"), (len(rows) + 1, "y", ""), (len(rows) + 2, "y", None), (3, "y", rows[9][2])]
    got = catalogue.near_duplicates(lambda name: spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    sets = [(i, frozenset(re.findall("[a-z0-9_]{3,}", t or ""))) for i, _, t in rows]
    sets, low = [(i, w) for i, w in sets if w], {}
    for i, w in sets:
        low[w] = min(i, low.get(w, i))
    heads = [(i, w) for i, w in sets if low[w] == i]
    want = [(a, b, len(v & w)) for a, v in heads for b, w in heads if a < b and 100 * len(v & w) >= 80 * len(v | w)]
    copies = [(low[w], i, len(w)) for i, w in sets if low[w] != i]
    assert sorted(map(tuple, got)) == sorted(want + copies) and len(want) > 200 and len(copies) > 20
