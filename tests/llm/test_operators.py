"""Small fixtures with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import annforest, common, decontaminate, kernels, langid, licenses, linededup, masked_lm, neardup, pieces, suffixdedup, toxicity

DOC = "doc_id long, text string, text_hash string, words string, k int, n_lines int"
EXTRA = ("extra", "extra", 7, 9)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOC)


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [(1, base), (2, base + " tail"), (3, None), (4, ""), (5, "  \n\t "), (6, "one"), (7, "One"), (8, "two words"), (8, "two words"), (None, base), (9, prose(rng, 3000)), (10, "é ñ ß 中文 ▁x\0y")]
    words = base.split()
    for i in range(11, 60):
        w = list(words)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    return rows + [(i, prose(rng, 40)) for i in range(60, 90)]


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def components(rows, k, percent):
    sets, parent = shingle_sets(rows, k), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


@pytest.mark.parametrize("leaf", [16, 4])
def test_near_duplicates_match_brute_force(spark, odd, leaf):
    rows = [r for r in odd if r[0] is not None and r[0] != 8]
    roots, sets = components(rows, 2, 80)
    low = {}
    for (i, _), r, s in zip(rows, roots, sets, strict=True):
        low[r] = min(low.get(r, 1 << 40), i)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows), k=2, paths=neardup.Paths(leaf=leaf, block=8)).collect()}
    for (i, _), r, s in zip(rows, roots, sets, strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low[r] if s else i, not s or low[r] == i)


def test_near_duplicates_make_the_rows_of_a_level_once(spark, monkeypatch):
    rng, staged, made = random.Random(3), neardup.staged, {}
    base = [f"b{n}" for n in range(60)]
    rows = [(i, " ".join(rng.choice((w, w, f"x{rng.randrange(9)}")) for w in base)) for i in range(120)]

    def seen(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        table = staged(df, name)
        made[name] = plan.count("Generate explode"), table.count()
        return table

    monkeypatch.setattr(neardup, "staged", seen)
    paths = neardup.Paths(leaf=4)
    sets = neardup.signatures(frame(spark, rows), 2, paths).withColumnRenamed("doc_id", "rep")
    neardup.candidates(sets, 80, paths)
    for level in range(2, paths.levels + 1):
        assert made[f"nodes{level}"][0] == made[f"level{level}"][0] == 0
        assert 0 < made[f"rows{level}"][1] <= len(rows) * paths.trees * paths.branch**level


def test_near_duplicates_of_texts_alike_but_not_linked(spark, monkeypatch):
    rng, staged, made = random.Random(5), neardup.staged, {}
    base = [f"b{n}" for n in range(80)]
    rows = [(i, " ".join(f"x{rng.randrange(9999)}" if rng.random() < 0.12 else w for w in base)) for i in range(240)]
    for i in range(0, 240, 8):  # some are linked all the same, 90 words of which one differs or two
        text = f"{rows[i][1]} " + " ".join(f"y{i}y{n}" for n in range(10))
        rows += [(1000 + i, text), (2000 + i, text.replace(f"y{i}y4", "z")), (3000 + i, text.replace(f"y{i}y4", "z").replace(f"y{i}y8", "z"))]

    def seen(df, name):
        made[name] = table = staged(df, name)
        made[name, "rows"] = table.count()
        return table

    monkeypatch.setattr(neardup, "staged", seen)
    roots, sets = components(rows, 2, 80)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        low[r] = min(low.get(r, 1 << 40), i)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), k=2, paths=neardup.Paths(levels=1, block=8)).collect()}
    assert got == {i: low[r] for (i, _), r in zip(rows, roots, strict=True)}
    assert made["rest", "rows"] >= 200  # compared in the blocks of their nodes, they came to 1,525 pairs
    assert made["more", "rows"] <= 2 * len(rows)


def test_near_duplicates_rest_is_compared_by_prefixes_without_loss(spark):
    rng = random.Random(7)
    base = [f"b{n}" for n in range(60)]
    rows = [(i, " ".join(rng.choice((w, w, w, w, w, w, w, w, w, f"x{rng.randrange(3)}")) for w in base)) for i in range(150)]
    signed = neardup.signatures(frame(spark, rows), 2, neardup.Paths()).where("set_key IS NOT NULL").dropDuplicates(["set_key"])
    rest = signed.select(F.struct(F.col("set_key").alias("key"), F.col("n_shingles").alias("n"), *neardup.SKETCH).alias("me"), F.col("set_key").alias("root"))
    whole = neardup.whole_sets(frame(spark, rows), 2).dropDuplicates(["set_key"])
    name = {r.set_key: r.doc_id for r in signed.collect()}
    sets = dict(zip([i for i, _ in rows], shingle_sets(rows, 2), strict=True))
    alike = {(a, b) for a in name.values() for b in name.values() if a < b and 100 * len(sets[a] & sets[b]) >= 65 * len(sets[a] | sets[b])}
    got = neardup.verified(neardup._prefix_pairs(rest, whole, 65, neardup.Paths(block=8)), whole, 65).collect()
    assert len(got) == len(alike) > 200 and {tuple(sorted((name[r.a], name[r.b]))) for r in got} == alike


def test_near_duplicates_edges(spark, odd):
    assert len(neardup.near_duplicates(frame(spark, odd)).collect()) == len(odd)
    kept = neardup.keep_one(frame(spark, odd))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(8) == 1 and {3, 4, 5} <= set(ids) and 1 in ids and 2 not in ids
    assert neardup.keep_one(frame(spark, []).limit(0)).count() == 0


def contaminated(rows, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(width, len(v))
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_contamination_matches_brute_force(spark, odd, monkeypatch):
    rows = odd + [(100, "x " + odd[0][1].upper() + " y"), (101, "ONE-one_one"), (102, "a" * 100_000)]
    items = [(1, odd[0][1]), (2, "one"), (3, None), (4, ""), (5, " ".join(odd[10][1].split()[100:130])), (6, "two words"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (50_000, 7):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contamination(frame(spark, rows), bench).collect())
        assert got == sorted((str(a), b, c, ",".join(d)) for a, b, c, d in contaminated(rows, items))  # repeated rows as often
    left = {r.doc_id for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    assert left == {a for a, _, c, _ in contaminated(rows, items) if not c}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, [(1, "a one, b"), (2, "c")]), bench, mode="span").collect()}
    assert spans == {1: "a, b", 2: "c"}
    assert decontaminate.contamination(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def brute_lines(rows, run):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    result = {}
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        solid = [(n, x.strip(" \t\r\x0b\f")) for n, x in enumerate(lines) if x.strip(" \t\r\x0b\f")]
        gone = set()
        for s in range(len(solid) - run + 1):
            key = tuple(x for _, x in solid[s : s + run])
            if key in seen:
                gone |= {n for n, _ in solid[s : s + run]}
            seen.add(key)
        result[i] = None if rows[i][1] is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return [result[i] for i in range(len(rows))]


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup_matches_brute_force(spark, run):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice(["a", "b ", " c", "", "d", "e", "f\t"]) for _ in range(rng.randrange(12)))) for i in range(40)] + [(50, None), (51, ""), (52, "\n\n")]
    got = {r.doc_id: (r.text, r.k) for r in linededup.dedup_lines(frame(spark, rows), run).collect()}
    assert got == {i: (t, 7) for (i, _), t in zip(rows, brute_lines(rows, run), strict=True)}


def brute_long_lines(rows, run, words, chars):
    seen, out = set(), {}
    for i, t in rows:
        lines = t.split("\n")
        solid = [(n, x.strip()) for n, x in enumerate(lines) if x.strip()]
        gone = set()
        for s in range(len(solid)):
            for size in range(1, run + 1):
                part = solid[s : s + size]
                key = tuple(x for _, x in part)
                if len(part) == size and (size == run or len(" ".join(key).split()) >= words or sum(map(len, key)) >= chars):
                    gone |= {n for n, _ in part} if key in seen else set()
                    seen.add(key)
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_line_dedup_takes_few_long_lines(spark):
    long, half, short = prose(random.Random(1), 60), prose(random.Random(2), 30), prose(random.Random(3), 20)
    texts = [long, f"a\n{long} \nb", f"c\n{half}\n\n{half}x\nd", f"e\n{half}\n{half}x", f"f\n{short}", f"g\n{short}\nh", "字" * 300, "i\n" + "字" * 300, f"{long}\n{long}\nk"]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in (1, 3, 5, 7, 8)] == ["a\nb", "e", texts[5], "i", "k"]
    rng = random.Random(4)
    lines = [prose(rng, n) for n in (4, 9, 9, 15, 26, 27, 60)] + ["", "x"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    for run, words in ((3, 50), (4, 12)):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows), run, words=words).collect()}
        assert got == brute_long_lines(rows, run, words, 300)


def test_line_dedup_empty(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_odd_rows_and_clashing_columns(spark):
    run = "one\ntwo\nthree"
    rows = [(None, f"x\n{run}"), (1, f"{run}\ny"), (2, f"{run}\ny"), (2, f"{run}\ny"), (2, "other text"), (3, None), (4, ""), (5, " \n\n"), (6, "\n".join(f"line {i}" for i in range(30_000)))]
    names = ["gone", "hash", "c0", "gone_id", "n_lines", "n_removed_lines", "lines", "w", "mark"]
    docs = spark.createDataFrame([(i, t, *[j] * len(names)) for j, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", *[n for n in names if not n.startswith("n_")], "n_lines", "n_removed_lines"]
    got = {r.gone: (r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in out.collect()}
    assert got == {0: (None, rows[0][1], 4, 0), 1: (1, "y", 4, 3), 2: (2, "", 4, 4), 3: (2, "", 4, 4), 4: (2, "other text", 1, 0), 5: (3, None, 0, 0), 6: (4, "", 1, 0), 7: (5, " \n\n", 3, 0), 8: (6, rows[8][1], 30_000, 0)}


def test_join_counted_splits_frequent_keys(spark):
    rows = spark.createDataFrame([("a" if i % 3 else f"k{i % 40}", i) for i in range(600)], "key string, i int")
    counted = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").cache()
    for parts in (1, 3, 1000):
        got = common.join_counted(rows, counted, "key", "n", parts)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(counted, "key").collect()))


def test_forest_recall_and_exact_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(3001, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] * 16), (None, [1.0] * 16), (3400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = annforest.neighbours(df, forest=annforest.Forest(shard=1000, seek=400, block=16)).toPandas()
    y, hits = x.astype(float), []
    for q in range(0, 3000, 100):
        far = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        best = [(f, i) for f, i in sorted(zip(far, range(3000), strict=True)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        hits.append(len({i for _, i in best} & set(own.vec_id)) / 10)
    assert np.mean(hits) >= 0.9 and set(got.query_id) == set(range(0, 3000, 100))
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(500, 510))
    assert annforest.neighbours(df.limit(0)).count() == 0


def brute_neighbours(rows, every, k):
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v and any(v)}
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        near = {}
        for i, v in kept:
            for j, w in kept:
                if j == q and i != q:
                    far = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                    near[i] = min(near.get(i, far), far)
        out += [(q, r, i, s) for r, (s, i) in enumerate(sorted((s, i) for i, s in near.items())[:k], 1)]
    return out


def test_forest_repeated_ids_ties_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(-50, 50)] + [(5, [1.0, 2.0, 3.0])] * 12 + [(0, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0]), (100, [3.0, 3.0, 3.0]), (100, [0.0, 1.0, 0.0]), (7, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(8, [1.0, 2.0, 3.0 + n / 1000]) for n in range(40)]  # many vectors of one id around a query
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, shard int, score int, query_id int")
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    for forest in (annforest.Forest(), annforest.Forest(shard=20, block=1), annforest.Forest(bits=8, trees=3, seek=10**6)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in annforest.neighbours(df, every=50, k=10, forest=forest).collect())
        want = brute_neighbours(rows, 50, 10)
        assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_forest_recall_over_many_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x)) * 50), "embedding": flat})).repartition(8)
    got = annforest.neighbours(df, every=25_000, k=10).toPandas()
    y, hits = x.astype(float), 0
    for q, own in got.groupby("query_id"):
        far = ((y - y[q // 50]) ** 2).sum(axis=1)
        far[q // 50] = np.inf
        hits += len(set(np.argsort(far, kind="stable")[:10] * 50) & set(own.vec_id))
    assert got.query_id.nunique() == 100 and hits / 1000 >= 0.9


def test_language_profiles(spark):
    rng = random.Random(1)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(40))
    syllables = {"aa": ["the", "ing", "on", "er"], "bb": ["que", "eau", "les", "ré"]}
    rows = [(i, make(syllables[lang]), lang) for i in range(40) for lang in syllables] + [(200, None, "aa"), (201, "", None), (202, "1 2 3", "bb"), (203, make(syllables["aa"]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs.where("doc_id % 3 <> 1"))
    got = langid.predict(docs, learned).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202)} == {"und"}
    assert all(r.lang_pred == "aa" for r in got if r.doc_id == 203)
    assert np.mean([sorted(r.lang_pred for r in got if r.doc_id == i) == ["aa", "bb"] for i in range(40)]) > 0.9
    assert langid.predict(docs, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def brute_grams(text):
    out, word = {}, [0]
    for c in text:
        x = ord(unicodedata.normalize("NFC", c.lower())[0]) if c.isalpha() else 0
        if x or word[-1]:
            word.append(x)
    word += [0] * (word[-1] > 0)
    for g in zip(word, word[1:], word[2:], strict=False):
        out[g] = out.get(g, 0) + 1
    return out


def test_language_grams_of_whole_texts(monkeypatch):
    texts = ["", " ", "a", "Ab, cd!", "été 中文字 Ёлка ΩΜ", "  x  yz  ", "a1b22c", "Ab " * 50, "\0é\0"]
    for size in (1 << 19, 1, 2, 3, 7):
        monkeypatch.setattr(langid, "CHARS", size)
        for t in texts:
            g, n = langid.gram_counts(t)
            got = {(int(x >> np.uint64(42)), int(x >> np.uint64(21)) & 0x1FFFFF, int(x) & 0x1FFFFF): int(k) for x, k in zip(g, n, strict=True)}
            assert got == brute_grams(t)
    assert len({langid.letter_vector(ord(c)).tobytes() for c in "abcéßñжщλω中文字かなहिעב"}) == len("abcéßñжщλω中文字かなहिעב")


def test_language_scores_match_plain_hypervectors(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 100)
    monkeypatch.setattr(langid, "BLOCK", 7)
    rows = [(1, "the thing there", "en"), (2, "les eaux là", "fr"), (3, "это там и тут", "ru"), (4, "the other thing", "en"), (None, "les autres", None), (5, "x" * 30, None), (5, "x" * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))

    def vector(text):
        total = np.zeros(langid.WIDTH)
        for g, n in brute_grams(text).items():
            a, b, c = (langid.letter_vector(x).astype(float) for x in g)
            total += n * np.roll(a, 2) * np.roll(b, 1) * c
        return total, sum(brute_grams(text).values())

    bundles = {}
    for _, text, lang in rows:
        if lang:
            v, n = vector(text)
            a, b = bundles.get(lang, (0, 0))
            bundles[lang] = (a + v, b + n)
    names = sorted(bundles)
    prototypes = np.array([bundles[x][0] / bundles[x][1] for x in names])
    prototypes -= prototypes.mean(axis=0)
    want = []
    for i, text, _ in rows:
        v, _ = vector(text)
        cos = prototypes @ v / np.linalg.norm(v) / np.linalg.norm(prototypes, axis=1)
        want.append((i, names[int(cos.argmax())], round((1 + cos.max()) / 2, 5)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 5)) for r in langid.predict(docs, langid.learn(docs)).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert langid.predict(docs.limit(0), langid.learn(docs)).collect() == []


def brute_removal(rows, length):
    first, rank = {}, lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < rank(i):
                gone[s : s + length] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) > 0))
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("split", "run"), [(4096, 1 << 22), (3, 1 << 22), (2, 700)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, split, run):
    monkeypatch.setattr(suffixdedup, "SPLIT", split)
    monkeypatch.setattr(suffixdedup, "RUN", run)
    monkeypatch.setattr(suffixdedup, "BLOCK", run)
    rng = random.Random(5)
    shared = [prose(rng, 30) for _ in range(3)] + ["é" * 40, "a" * 200, "x" * 49, "y" * 50]
    rows = [(i, prose(rng, rng.randrange(30)) + rng.choice(shared)[rng.randrange(20) :] + prose(rng, rng.randrange(20))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "y" * 50), (53, "y" * 50), (54, rows[3][1]), (55, "a\0" * 60), (56, "a\0" * 60), (57, prose(rng, 400)), (57, rows[4][1] + rows[5][1]), (None, rows[6][1]), (None, None), (-3, shared[0] + shared[1])]
    rows += [(58, rows[7][1]), (58, rows[7][1]), (59, rows[-5][1][300:900] + "é" + rows[-5][1][100:700])]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.remove_repeats(frame(spark, rows)).collect()]
    order = lambda x: (x[0] is not None, x)
    assert sorted(got, key=order) == sorted(brute_removal(rows, 50), key=order)


def test_suffix_dedup_many_contexts_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SPLIT", 4)
    rng = random.Random(8)
    rows = [(i, prose(rng, 5) + "the same passage of more than fifty characters in all of them" + prose(rng, 5)) for i in range(60)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_removal(rows, 50))
    assert suffixdedup.remove_repeats(frame(spark, [])).collect() == []


def test_windows_in_blocks_equal_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 10, 10, 700, 749, 800, 4000, 5000])

    def flat(found):
        return {i: (int(p), int(h)) for a, b, p, h in zip(*(x.tolist() for x in found), strict=True) for i in range(a, b)}

    whole = flat(suffixdedup._all_windows(raw, at, 50))
    monkeypatch.setattr(suffixdedup, "BLOCK", 333)
    assert flat(suffixdedup._all_windows(raw, at, 50)) == whole
    assert sorted(whole) == [i for a, b in zip(at, at[1:], strict=False) for i in range(a, b - 49)]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 7, 50, 333):
        s = rng.integers(1, 4, n)
        assert suffixdedup.difference_cover_sort(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_toxicity_learns(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 30, 500) + (" vile scum " if i % 5 == 0 else "")) for i in range(600)] + [(900, None), (901, ""), (None, "vile scum")]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)] + [(900, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(1, 600, 2)) and got[901] < 0.3
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, s in got.items() if s < 0.3}
    assert toxicity.scores(docs.limit(0), toxicity.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_toxicity_features_are_chosen_over_all_rows(spark, monkeypatch):
    rows = [(i, f"common w{i % 7} " + ("vile" if i % 5 == 0 else "fine")) for i in range(400)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    chosen, telling = [], toxicity.telling
    monkeypatch.setattr(toxicity, "telling", lambda p, u, n_p, n_u: chosen.append((p.max(), u.max(), n_p, n_u)) or telling(p, u, n_p, n_u))
    toxicity.learn(docs, labels)
    assert chosen == [(80, 400, 80, 400)]


def brute_viterbi(machine, text):
    v = machine.vocabulary
    table = {}
    for i, (p, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)):
        if kind in (pieces.NORMAL, pieces.USER) and p:
            table[p] = max(table.get(p, -1e9), v.scores[i])
    b = b" " + text.encode()
    best = [0.0] + [-1e18] * len(b)
    longest = max(map(len, table))
    starts = [i for i in range(len(b) + 1) if i == len(b) or b[i] & 0xC0 != 0x80]
    nxt = dict(zip(starts, starts[1:], strict=False))
    for i in starts[:-1]:
        for j in range(i + 1, min(len(b), i + longest) + 1):
            if (s := table.get(b[i:j])) is not None:
                best[j] = max(best[j], best[i] + s)
        if b[i : nxt[i]] not in table:
            best[nxt[i]] = max(best[nxt[i]], best[i] + machine.unknown_score)
    return best[-1]


def test_pieces_best_path_and_round_trip(spark, odd):
    model = pieces.read_model()
    texts = [t for _, t in odd if t and len(t) < 2000] + ["▁▁ a ▁", "  lead", "trail  ", "中文字 混ぜる", "x" * 500, "\0\x01", "🙂🙂 ok", "a\nb\tc"]
    rows = list(enumerate(texts)) + [(900, None), (901, "")]
    got = {r.doc_id: r for r in pieces.encode(frame(spark, rows), model).collect()}
    machine = pieces.automaton(model)
    assert all(r.round_trip for r in got.values()) and got[900].ids is None and got[901].ids == []
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(brute_viterbi(machine, t), abs=1e-6)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(spark, rows), model), model).collect()}
    assert back == dict(rows)


def test_license_scan(spark):
    mit = licenses.TEMPLATES[4][1]
    rows = [(1, "hello\nReleased under the MIT license!\nbye"), (2, mit), (3, "words before.\n\n" + mit.replace(", ", ",\n") + "\n\nwords after"), (4, None), (5, ""), (6, "nothing of the kind here"), (7, "x" * 300_000), (8, "licensed under"), (9, "CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (10, "license")]
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1] == ("MIT", 2) and got[2][0] == got[3][0] == "MIT" and got[9][0] == "CC-BY-NC-4.0"
    assert all(got[i] == (None, 0) for i in (4, 5, 6, 7, 8, 10))


def test_license_notices_anywhere_in_a_text(spark):
    two, three = (dict(licenses.FULL)[n].replace(" 1. R", "\n\n1. R").replace(" 2. R", "\n\n2. R").replace(" 3. N", "\n\n3. N").replace(" THIS SOFT", "\n\nTHIS SOFT") for n in ("BSD-2-Clause", "BSD-3-Clause"))
    gpl = next(x for n, x in licenses.FULL if n == "GPL-3.0" and len(x) > 20000)
    around = prose(random.Random(1), 300)
    rows = [(1, "The parser is small. Released under the MIT License. See the notes for more."), (2, f"Copyright X\n\n{two}"), (3, f"{around} {three} {around}"), (4, f"{around}\n{gpl}"), (5, around), (6, f"{around} GNU Lesser General Public License {around}"), (7, "released under the"), (8, "MIT License.")]
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1] == ("MIT", 1) and [got[i][0] for i in range(2, 9)] == ["BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", None, None, None, None]


def test_license_windows_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        template = rng.integers(0, 9, rng.integers(2, 9)).tolist()
        text = rng.integers(0, 9, 40).tolist()
        s, n, best = set(zip(template, template[1:], strict=False)), len(template), 0.0
        for a in range(len(text) - 1):
            for b in range(a + 1, min(len(text), a + int((n - 1) * 1.2 / 0.8 + 1e-9) + 1)):
                g = set(zip(text[a:b], text[a + 1 : b + 1], strict=True))
                best = max(best, 2 * len(g & s) / (len(g) + len(s)))
        grams = np.array([10 * x + y for x, y in zip(text, text[1:], strict=False)], np.uint64)
        own = np.flatnonzero([(x, y) in s for x, y in zip(text, text[1:], strict=False)])
        got = licenses._windows(grams, own, np.zeros(len(text), np.int64), len(s), n, 0.8)
        assert got.get(0, (0.0,))[0] == (pytest.approx(best) if best >= 0.8 else 0.0)


def test_masked_lm_prefers_what_it_knows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["a b c d e f"] * 30)) for i in range(40)] + [(100, None), (101, " "), (102, " ".join(rng.sample("abcdef", 1)[0] for _ in range(100))), (103, "a b c d e f " * 5), (None, "a b")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in masked_lm.score(docs, masked_lm.learn(docs)).collect()}
    assert got[100].n_tokens == got[101].n_tokens == 0 and got[100].score is None
    assert got[103].score > got[102].score and got[103].log_likelihood == pytest.approx(30 * got[103].score)
    assert masked_lm.score(docs.limit(0), masked_lm.learn(docs.limit(0))).count() == 0


def test_masked_lm_scores_words_by_their_own_counts(spark):
    rows = [(i, "a b a b " * 20 + ("x " * 6 + "y y ") * 2) for i in range(10)]
    docs, asked = frame(spark, rows), frame(spark, [(1, "x"), (2, "y"), (3, "unseen"), (4, "x y x"), (5, "y x x"), (None, "x"), (1, "x")])
    learned = masked_lm.learn(docs, masked_lm.Shape(words=2, buckets=1, width=4))
    got = [(r.doc_id, r.score, r.n_tokens) for r in masked_lm.score(asked, learned).collect()]
    one = {i: x for i, x, _ in got}
    assert len(got) == 7 and one[1] - one[2] == pytest.approx(np.log(120 / 40)) and one[2] - one[3] == pytest.approx(np.log(40))
    assert [x for i, x, _ in got if i in (1, None)] == pytest.approx([one[1]] * 3) and one[4] == pytest.approx(one[5])


def test_masked_lm_classes_grow_with_the_vocabulary(spark):
    shape = masked_lm.Shape(words=4, buckets=2, width=4, vocabulary=10)
    sizes = [masked_lm.learn(frame(spark, [(1, " ".join(f"w{i}" for i in range(n)))]), shape).shape.classes for n in (10, 80, 640)]
    assert sizes == [7, 13, 25]


def test_masked_lm_trains_on_every_token(spark):
    learned = masked_lm.learn(frame(spark, [(1, " ".join(f"w{i}" for i in range(40)))]), masked_lm.Shape(fan=64))
    bias = masked_lm.views(learned.params, learned.shape)[4][0]
    assert (bias[:40] > 0).all() and (bias[40:] < 0).all()


def plain_log_probability(p, s, context, target):
    """Of one token, by the full softmax over all slots."""
    sides, head, bias, place, place_bias = (x.astype(np.float64) for x in masked_lm.views(p, s))
    hidden = np.tanh(sum(sides[k][c] for k, c in enumerate(context)))
    group = np.exp(hidden @ head + bias)
    within = np.exp(np.einsum("w,gwf->gf", hidden, place) + place_bias)
    whole = (group / group.sum())[:, None] * within / within.sum(axis=1, keepdims=True)
    assert whole.sum() == pytest.approx(1)
    return np.log(whole.reshape(-1)[target])


def test_masked_lm_gradient():
    s = masked_lm.Shape(words=5, buckets=2, fan=3, width=4)
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, s.classes, (4, 9)), rng.integers(0, s.slots, 9)
    p = masked_lm.start(s).astype(np.float64) + rng.normal(0, 0.3, s.size)

    def loss(p):
        return float(-np.mean([plain_log_probability(p, s, context[:, i], target[i]) for i in range(9)]))

    assert -masked_lm.log_probabilities(p, s, context, target).mean() == pytest.approx(loss(p))
    grad = masked_lm.gradient(p, s, context, target)
    for i in rng.integers(0, s.size, 60):
        e = np.zeros(s.size)
        e[i] = 1e-5
        assert (loss(p + e) - loss(p - e)) / 2e-5 == pytest.approx(grad[i], abs=1e-7)


def test_masked_lm_matches_plain_sums_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "TOKENS", 7)
    monkeypatch.setattr(masked_lm, "KNOWN", 25)
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 60), 30)) for i in range(120)] + [(500, None), (501, ""), (None, "w1x w2x"), (7, "w1x w2x"), (7, "w1x w2x"), (600, prose(rng, 5000, 40))]
    shape = masked_lm.Shape(words=20, buckets=3, fan=6, width=5, batch=64, least=8)
    docs = frame(spark, rows).withColumn("n", F.lit(1)).withColumn("row", F.lit(2)).withColumn("word", F.lit(3)).withColumn("score", F.lit(4))
    learned = masked_lm.learn(docs.repartition(1), shape)
    again = masked_lm.learn(docs.repartition(8), shape)
    assert (learned.params == again.params).all() and np.abs(learned.params - masked_lm.start(shape)).max() > 0.01
    got = sorted((str(r.doc_id), r.n_tokens, round(r.log_likelihood, 3)) for r in masked_lm.score(docs, learned).collect())
    assert got == sorted((str(r.doc_id), r.n_tokens, round(r.log_likelihood, 3)) for r in masked_lm.score(docs.repartition(8), again).collect())
    counts = {}
    for _, t in rows:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    words = sorted(counts)
    hashes = dict(zip(words, kernels.word_hashes(*kernels.buffers(pa.array(words)))[0], strict=True))
    slot = {w: int(masked_lm.slots_of(np.array([hashes[w]], np.uint64), learned)[0]) for w in words}
    want = []
    for i, t in rows:
        own, total = [slot[w] for w in (t or "").split()], 0.0
        for j, w in enumerate((t or "").split()):
            context = [own[j + d] if 0 <= j + d < len(own) else shape.slots for d in shape.sides]
            total += plain_log_probability(learned.params, shape, context, own[j])
            if own[j] >= shape.words:
                total += np.log(counts[w] / (1 + sum(n for v, n in counts.items() if slot[v] == own[j])))
        want.append((str(i), len(own), total))
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=0.02, rel=1e-4)


def test_word_hashes_follow_bytes(monkeypatch):
    texts = [None, "", "a b  C", " x", "Éa b\tc\n", "abc", "a" * 50, "b c " * 20]
    want = [(t or "").encode().lower().split() for t in texts]
    for size in (1 << 20, 7):
        monkeypatch.setattr(kernels, "PIECE", size)
        h, at = kernels.word_hashes(*kernels.buffers(pa.array(texts)))
        seen = {}
        assert np.diff(at).tolist() == [len(w) for w in want]
        for i, ws in enumerate(want):
            for w, x in zip(ws, h[at[i] : at[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
