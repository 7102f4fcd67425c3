"""Operators of the retrieval engine against literal expectations and plain twins."""

import os
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftline.functions import paths as P
from siftline.functions import text as T
from siftline.operators import chunks, embed, evaluate, intent, search, select, store, structure
from siftline.plans import catalogue, lookups
from siftline.sources import repo, snapshots
from siftline.streaming import ledger, watch

DATA = "/root/testdata/sf0.001"


def column(spark, values, kind, expr):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()]


def test_text_functions(spark):
    assert column(spark, [None, "", "abcd", "abcde"], "string", T.token_estimate) == [0, 0, 1, 2]
    assert column(spark, ["  a \r\nb\t\n\n"], "string", T.normalised) == ["a\nb"]
    assert column(spark, ["hello", ""], "string", T.fnv1a) == [1335831723, 2166136261]
    assert column(spark, [0.5005, 0.0004], "double", lambda x: T.round_at(x, 3)) == [0.5, 0.0]
    assert column(spark, ["queries", "classes", "boxes", "bus", "cats", "ids"], "string", T.singular) == ["query", "class", "box", "bus", "cat", "id"]
    assert column(spark, ["walking", "linked", "compute", "red"], "string", T.stem) == ["walk", "link", "comput", "red"]
    assert column(spark, ["const a1 = foo_b(abc, abc)"], "string", T.identifiers) == [["foo_b", "abc"]]


def test_paths(spark):
    assert column(spark, ["a.TS", "b.kts", "c", "d/e.zsh"], "string", P.language) == ["typescript", "kotlin", "text", "bash"]
    assert column(spark, ["a/tests/b.py", "tests/b.py", "x_test.go", "x.spec.ts", "x/test/y"], "string", P.is_test) == [True, False, True, True, True]
    assert column(spark, [".env", ".env.local", "a/id_rsa", "k.PEM", "env"], "string", P.is_secret) == [True, True, True, True, False]
    assert column(spark, ["README", "a/b.md", "a.py", ".x/a.py", "p.json"], "string", P.is_code) == [False, False, True, False, False]


def test_store(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert sorted(store.upsert(base, batch, ["id"], "seq").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "file_path string, file_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("m", "3"), ("n", "5")], "file_path string, file_hash string")
    assert dict(store.hash_diff(old, new).collect()) == {"a": "unchanged", "b": "changed", "c": "moved away", "d": "removed", "m": "renamed", "n": "new"}
    assert [r.id for r in store.evenly_spaced(spark.range(64), "id", 4).collect()] == [0, 16, 32, 48]


def test_search(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, q array<float>")
    assert [(r.vec_id, r.score) for r in search.vector_top_k(asked, vectors, 2).collect()] == [(1, 1.0), (3, 1.0)]
    rows = spark.createDataFrame([(1, "x", 0.5, "a", 0), (1, "x", 0.5, "b", 1), (1, "y", 0.1, "a", 0), (1, "y", 0.3, "b", 1)], "query_id int, id string, total double, source string, arrival int")
    assert sorted(search.merge_candidates(rows).collect()) == [(1, "x", 0.5, "a", "a+b"), (1, "y", 0.3, "b", "a+b")]
    for totals, floor in (([0.76, 0.70, 0.52, 0.50], 0.7), ([0.69, 0.50, 0.49], 0.0), ([0.5, 0.45, 0.4], 0.0)):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(totals)], "q int, id int, total double")
        assert search.gap_cut(df, "q").first().floor == floor


def test_interval_overlaps_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), lo := rng.randrange(1000), lo + rng.randrange(0, 300)) for i in range(150)]
    got = {(r.a, r.b) for r in search.interval_overlaps(spark.createDataFrame(rows, "id int, u int, lo long, hi long"), "u").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and a[3] > a[2] and b[3] > b[2] and min(a[3], b[3]) - max(a[2], b[2]) >= 0.5 * min(a[3] - a[2], b[3] - b[2])}
    assert got == want


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcd")], "query_id int, id string, rank int")
    labels = spark.createDataFrame([(1, "b", 1), (1, "z", 1)], "query_id int, id string, level int")
    m = evaluate.ir_metrics(ranked, labels).first()
    assert (m.precision_5, m.recall_10, m.mrr) == (0.25, 0.5, 0.5)
    cost = evaluate.session_cost(spark.createDataFrame([("s", 1, 2000)], "session_id string, seq int, result_tokens long"), 1000, 100, 500).first()
    assert (cost.calls, cost.input, cost.output) == (2, 4100, 600)
    flags = spark.createDataFrame([(1, i, 10 <= i <= 40) for i in range(1, 61)], "c int, line int, seen boolean")
    assert sorted((r.lo, r.hi, r.seen) for r in evaluate.runs_of(flags, "c", "line", "seen", 8).collect()) == [(1, 9, False), (10, 40, True), (41, 60, False)]


def candidate(i, total, **more):
    return {"query_id": 1, "id": f"c{i:02d}", "file": "f", "symbol": None, "start_line": i * 20, "end_line": i * 20 + 9, "content": "x" * 40, "total": total, "tokens": 10, "expansion": False} | more


def test_greedy_pack():
    caps = select.pack(pd.DataFrame([candidate(i, 0.9) for i in range(6)]), select.Limits(chunks=20, per_file=4))
    assert caps.selected.sum() == 4 and set(caps.reason) == {"selected", "per_file_cap"}
    ranges = [candidate(0, 0.9, start_line=10, end_line=80), candidate(1, 0.8, start_line=30, end_line=40), candidate(2, 0.7, file="g"), candidate(3, 0.6, start_line=78, end_line=120)]
    assert select.pack(pd.DataFrame(ranges), select.Limits()).query("selected").id.tolist() == ["c00", "c02", "c03"]
    big = select.pack(pd.DataFrame([candidate(0, 0.9, tokens=999), candidate(1, 0.8, tokens=5, file="g")]), select.Limits(tokens=10))
    assert big.reason.tolist() == ["selected", "token_budget"]
    pool = pd.DataFrame([candidate(0, 0.9, relevance=[0.9, 0.0], tokens=100), candidate(1, 0.85, relevance=[0.85, 0.0], tokens=100), candidate(2, 0.4, relevance=[0.0, 0.8], tokens=100), candidate(3, 0.95, relevance=[0.0, 0.0], tokens=100)])
    chosen = select.cover(pool, [0.5, 0.5], select.Limits(chunks=2, per_file=4)).id.tolist()
    assert chosen == ["c00", "c02"]


def test_windows_cover_every_line():
    rng = random.Random(2)
    for _ in range(50):
        text = "\n".join("y" * rng.randrange(60) for _ in range(rng.randrange(1, 40)))
        out = list(chunks.windows_of(text, 100, 2))
        assert text == "" or {n for a, b, _ in out for n in range(a, b + 1)} == set(range(1, text.count("\n") + 2))
        assert all(len(c) <= 101 for _, _, c in out)
    assert list(chunks.windows_of("", 10, 1)) == [] and len(list(chunks.windows_of("z" * 30, 10, 1))) == 3


def test_structure(spark):
    rows = structure.structural_chunks(spark.createDataFrame([*structure.FIXTURES.items(), ("bad.py", "def ("), ("e.py", "")], "file_path string, content string")).collect()
    found = {(r.file_path, r.symbol_name): (r.symbol_type, r.parent_symbol, r.start_line, r.end_line) for r in rows}
    assert found[("src/auth.py", "login")] == ("method", "Auth", 8, 10)
    assert found[("src/store.ts", "open")] == ("function", None, 9, 12) and found[("src/store.ts", "Store")][0] == "class"
    assert ("bad.py", None) in found and ("docs/notes.txt", None) in found


def test_intent():
    i = intent.analyse_one("Fix `refreshToken` in src/auth.ts and update tests for MAX_RETRY_COUNT --dry-run, multi-root")
    assert i["files"] == ["src/auth.ts"] and {"refreshToken", "MAX_RETRY_COUNT"} <= set(i["symbols"]) and "--dry-run" in i["exact_terms"]
    assert "find_tests" in i["operations"] and "multi" not in i["symbols"]


def test_hash_embedding():
    v = embed.hash_vector("computeChunkId of the chunk")
    assert len(v) == 384 and abs((v * v).sum() - 1) < 1e-9 and embed.hash_vector("")[0] == 1.0


def test_repository_source(spark, tmp_path):
    for name, data in {"pkg/__init__.py": "x = 1\n", ".eslintrc.js": "a", "_priv/y.py": "b", "node_modules/z.js": "c", ".env": "d", "k/a.log": "e", "bin.dat": "a\0b", ".gitignore": "*.tmp\n!keep.tmp\n/only\n", "a.tmp": "f", "keep.tmp": "g", "only": "h", "sub/only": "i", "nested/.git/x": "", "nested/f.py": "j"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    spark.dataSource.register(repo.RepositorySource)
    rows = {r.file_path: r.skipped for r in spark.read.format("siftline_repo").load(str(tmp_path)).collect()}
    assert rows == {"pkg/__init__.py": None, ".eslintrc.js": None, "_priv/y.py": None, "bin.dat": "binary", ".gitignore": None, "keep.tmp": None, "sub/only": None}


def test_snapshots(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(spark.range(3))
    table.commit(store.upsert(table.read().withColumn("v", F.lit(0)), spark.createDataFrame([(1, 5, 1)], "id long, v int, seq int"), ["id"], "seq"))
    assert sorted(table.read().collect()) == [(0, 0), (1, 5), (2, 0)]
    (tmp_path / "t" / "LOCK").touch()
    with pytest.raises(FileExistsError):
        table.commit(spark.range(1))


def test_watch_stream_equals_batch(spark, tmp_path):
    rows = [(i, "r", ["create", "update", "delete"][i % 3], f"p{i % 7}") for i in range(50)]
    events = spark.createDataFrame(rows, "seq long, repo_id string, type string, path string")
    events.write.parquet(str(tmp_path / "in"))
    got = []
    q = watch.apply_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, n: got.extend(df.collect()))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == sorted(watch.compact(events).collect())
    assert watch.plan(events).first().mode == "partial"
    many = spark.range(41).select(F.col("id").alias("seq"), F.lit("r").alias("repo_id"), F.lit("create").alias("type"), F.col("id").cast("string").alias("path"))
    assert watch.plan(many).first().mode == "full" and watch.plan(many.limit(40)).first().mode == "partial"


def test_ledger_stream(spark, tmp_path):
    rows = [("c", 1, "a", n, n * 7) for n in range(10, 41)]
    more = [("c", 2, "a", n, n * 7) for n in range(1, 61)]
    schema, got = "ctx string, call_seq long, path string, line_no long, hash long", []
    for part in (rows, more):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flags = ledger.seen_lines(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), expire=False)
        q = flags.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, n: got.extend(df.collect())).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    assert {r.line_no: r.seen for r in got if r.call_seq == 2} == {n: 10 <= n <= 40 for n in range(1, 61)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_every_query_has_a_stable_schema(spark):
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and entry.entry(spark).columns
    for name in ("scan_project", "bm25_topk", "hash_diff", "near_duplicates", "greedy_pack"):
        assert known[name](spark, DATA).count() >= 0


def brute_features(rows):
    out = {}
    for i, text in rows:
        for w in re.findall("[a-z0-9_]{3,}", text.lower()):
            h = 2166136261
            for c in w.encode():
                h = (h ^ c) * 16777619 % (1 << 32)
            out[i, h % 384] = out.get((i, h % 384), 0) + (-1 if h >= 1 << 31 else 1)
    return out


def test_hash_features_of_every_document(spark):
    rows = [(i, f"Alpha beta_{i} gamma alpha x") for i in range(12)] + [(13, ""), (23, "one ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.bucket): r.weight for r in catalogue.hash_features(lambda name: docs).collect()}
    assert got == brute_features(rows)


def test_searches_ask_every_item_and_name(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, f"word{i} word{i + 1} common") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"word{i} word{i + 1} common") for i in range(12)], "item_id long, text string")
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(301)], "vec_id long, embedding array<float>")
    t = {"documents": docs, "benchmark": items, "embeddings": vectors}.get
    for f, c in ((catalogue.bm25_topk, "query_id"), (catalogue.bm25_normalised, "query_id"), (catalogue.facet_idf_relevance, "facet"), (catalogue.coverage_report, "facet")):
        assert {r[c] for r in f(t).collect()} == set(range(12))
    for f, k in ((catalogue.vector_topk, 20), (catalogue.vector_topk_batch, 10)):
        assert sorted(r.query_id for r in f(t).collect()) == sorted([0, 100, 200, 300] * k)


def test_symbol_lookup_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(("ab", "c", "red ", "part ")) for _ in range(rng.randrange(8)))) for i in range(120)] + [(500, "x"), (501, "yz"), (502, None)]
    names = [x for _, x in rows if x is not None]
    want = set()
    for name in {*names, *(x[:-1] for x in names), *(x[1:4] for x in names)}:
        hits = sorted(i for i, x in rows if x == name)
        exact = bool(hits)
        hits = hits or sorted(i for i, x in rows if x is not None and name in x)
        want |= {(name, i, exact) for i in hits[:20]}
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string")
    assert {tuple(r) for r in lookups.symbol_lookup(lambda name: parts).collect()} == want


def test_admission_keeps_texts_up_to_two_mebibytes(spark):
    sizes = {1: 20_001, 2: 2 << 20, 3: (2 << 20) + 1}
    rows = [(i, "a" * n, n) for i, n in sizes.items()] + [(4, "é" * (1 << 20), 1 << 20), (5, "é" * (1 << 20) + "a", (1 << 20) + 1), (6, "a\0b", 3), (7, "token = 'abcdefgh1'", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in catalogue.admission_filter(lambda name: docs).collect()) == [1, 2, 4]
