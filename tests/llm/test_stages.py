"""The pipeline's stages, the queries' digests, and twins of operators that SQL cannot express."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import licenses, pieces, registry, toxicity

from test_operators import brute_long_lines, components, contaminated, frame, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Odd rows of every kind, with a column beside the five and a table without rows."""
    rng = random.Random(21)
    shared = prose(rng, 60)
    exam = prose(rng, 14)
    rows = [(i, prose(rng, rng.randrange(20, 60)) + (" vile scum" if i % 6 == 0 else "")) for i in range(120)]
    rows += [(200, f"first\n{shared}\nlast words here"), (201, f"other\n{shared}\nmore words there"), (202, shared), (203, f"x {exam} y"), (204, exam.upper()), (205, None), (206, ""), (207, "  \n "), (None, "no id " + prose(rng, 20)), (None, "no id " + prose(rng, 20)), (None, None)]
    near = prose(rng, 80).split()
    rows += [(210 + k, " ".join(["z%d" % k if n == 7 * k else w for n, w in enumerate(near)])) for k in range(5)]
    rows += [(220, "same id " + prose(rng, 25)), (220, "same id again " + prose(rng, 25)), (221, rows[3][1]), (222, rows[4][1]), (222, rows[4][1]), (230, prose(rng, 20_000, 3000))]
    path = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, gone int, hits int"
    spark.createDataFrame([(i, t, "en", "web", len(t or ""), "clash", 1, 2) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)] + [(999, 0, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, exam), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


def test_every_stage_against_its_twin(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    out = stages["toxicity"](spark, docs, path)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    left = pairs(out)
    model = toxicity.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {(r.doc_id, r.text_hash): r.score for r in toxicity.scores(docs, model).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    assert left == ordered(r for r in rows if scores[(r[0], hashes[r])] < 0.3)
    assert not [i for i, t in left if t and "vile" in t] and {i for i, t in rows if t is None or "vile" not in t} == {i for i, _ in left}
    lines = stages["line dedup"](spark, out, path)
    brute, keyed = {}, [r for r in left if r[1] is not None]
    texts = brute_long_lines([(n, t) for n, (_, t) in enumerate(keyed)], 3, 50, 300)
    for n, (i, t) in enumerate(keyed):
        brute.setdefault((i, t), texts[n])  # repeated rows lose the same lines
    want = [(i, None if t is None else brute[(i, t)]) for i, t in left]
    want = ordered((i, t) for (i, old), (_, t) in zip(left, want, strict=True) if t == old or (t or "").strip())
    assert pairs(lines) == want and "\n".join(x for x in (201, "other", "more words there")[1:]) == dict(want)[201]
    assert all(r.n_chars == len(r.text or "") for r in lines.collect())
    near = stages["MinHash near-dedup"](spark, lines, path)
    roots, sets = components(want, 5, 80)
    best = {}
    for (i, t), root, own in zip(want, roots, sets, strict=True):
        key = ("set", root) if own else ("blank", i, t)
        rank = (i is None, i if i is not None else 0, hashes.get((i, t), 0))
        if key not in best or rank < best[key][0]:
            best[key] = rank, (i, t)
    got = pairs(near)
    assert [i for i, _ in got] == [i for i, _ in ordered(x for _, x in best.values())] and {210} == {i for i, _ in got} & set(range(210, 215))
    clean = stages["benchmark decontamination"](spark, near, path)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    dirty = {n for n, (_, _, hit, _) in enumerate(contaminated(got, items)) if hit}
    assert pairs(clean) == [r for n, r in enumerate(got) if n not in dirty] and not {203, 204} & {i for i, _ in pairs(clean)}
    coded = stages["SentencePiece encoding and decoding"](spark, clean, path)
    assert coded.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and all(r.round_trip for r in coded.collect()) and coded.count() == len(got) - len(dirty)
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, coded.collect()))


def test_stages_of_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_toxicity_risk_matches_plain_sums(monkeypatch):
    rng = np.random.default_rng(3)
    size = 6
    positive, unlabelled = ([np.flatnonzero(rng.random(size) < 0.5) for _ in range(n)] for n in (5, 9))
    times = {0: np.ones(5), 1: rng.integers(1, 4, 9).astype(float)}

    def flat(rows):
        return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def risks(w, bias):
        return np.array([toxicity.as_negative(w, bias, *flat(rows), times[k]) for k, rows in enumerate((positive, unlabelled))])

    def loss(z, y):
        return np.log1p(np.exp(-z if y else z))

    def objective(v, prior):
        z = [[v[:-1][r].sum() + v[-1] for r in rows] for rows in (positive, unlabelled)]
        plus = np.mean([loss(x, 1) for x in z[0]])
        minus = np.average([loss(x, 0) for x in z[1]], weights=times[1]) - prior * np.mean([loss(x, 0) for x in z[0]])
        return prior * plus + minus, minus

    w = rng.normal(size=size)
    p, u = risks(w, 0.3)
    assert p[-2] == pytest.approx(sum(loss(w[r].sum() + 0.3, 0) for r in positive)) and u[-1] == times[1].sum()
    present = sum(np.isin(np.arange(size), r) for r in positive)
    for prior in (0.1, 0.4):
        start = np.concatenate((np.zeros(size), [np.log(prior / (1 - prior))]))
        assert objective(start, prior)[1] >= 0
        grad = np.array([(objective(start + e, prior)[0] - objective(start - e, prior)[0]) / 2e-5 for e in 1e-5 * np.eye(size + 1)])
        w, bias = toxicity.fit(risks, present, len(positive), prior, rounds=1, decay=0.0)
        moved = np.append(w, bias) - start
        sure = np.abs(grad) > 1e-6
        assert (np.sign(moved[sure]) == -np.sign(grad[sure])).all()
    # below zero the corrected negative part is pushed back up
    monkeypatch.setitem(times, 1, np.ones(9))
    negative = lambda w, bias: np.array([np.append(np.full(size + 1, 0.5), [9.0, 1.0]), np.append(np.full(size + 1, 0.1), [0.1, 1.0])])
    w, bias = toxicity.fit(negative, np.full(size, 0.5), 1, 0.5, rounds=1, decay=0.0)
    assert (w < 0).all()


def test_toxicity_filter_spares_most_texts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(5000,)], "doc_id long")
    for size in (1 << 23, 64, 128):
        monkeypatch.setattr(toxicity, "FILTER", size)
        got = toxicity._with_ids(rows, ids)
        assert sorted(r.doc_id for r in got.collect()) == list(range(0, 300, 7)) and got.columns == ["doc_id", "text"]


def brute_licenses(text, templates, threshold):
    """(name, dice, units) by trying every unit and every window."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: set(zip(w, w[1:], strict=False))
    lines = (text or "").split("\n")
    parts, own = [], []
    for line in lines:
        if words(line):
            own.append(line)
        elif own:
            parts.append(own)
            own = []
    units = [words(x) for x in lines] + [words("\n".join(p)) for p in [*parts, own]] + [words(text)]
    every, best, seen = words(text), {}, set()
    sets = [(name, grams(words(t)), len(words(t))) for name, t in templates]
    for k, (_, s, n) in enumerate(sets):
        for u in units:
            g = grams(u)
            if g and (d := 2 * len(g & s) / (len(g) + len(s))) >= threshold:
                best[k] = max(best.get(k, 0), d)
                seen.add(tuple(u))
    only_windows = not seen
    for k, (_, s, n) in enumerate(sets):
        longest = int((n - 1) * (2 - threshold) / threshold + 1e-9)
        for a in range(len(every)):
            for b in range(a + 2, min(len(every), a + longest + 1) + 1):
                g = grams(every[a:b])
                if (d := 2 * len(g & s) / (len(g) + len(s))) >= threshold:
                    best[k] = max(best.get(k, 0), d)
    part_of = lambda k: [j for j, (o, b, _) in enumerate(sets) if o != sets[k][0] and sets[k][1] < b]
    found = [(-d, sets[k][0]) for k, d in best.items() if not any(j in best for j in part_of(k))]
    if not found:
        return None, None, 0
    d, name = min(found)
    return name, -d, 1 if only_windows else len(seen)


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(9)] + ["É", "x-y", "A1"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    templates = (("one", sentence(6)), ("two", sentence(9)), ("three", sentence(14)), ("two", sentence(5)))
    templates += (("four", templates[1][1] + " " + sentence(6)),)
    rows = []
    for i in range(150):
        words = [sentence(rng.randrange(6)), rng.choice(templates)[1], sentence(rng.randrange(6)), rng.choice(["", rng.choice(templates)[1]])]
        if rng.random() < 0.5:
            w = words[1].split()
            w[rng.randrange(len(w))] = "zz"
            words[1] = " ".join(w)
        rows.append((i, rng.choice(["\n", "\n\n", " ", ". "]).join(words)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, templates[0][1]), (5, rows[5][1])]
    got = sorted((str(r.doc_id), r.license, None if r.dice is None else round(r.dice, 9), r.n_units) for r in licenses.scan(frame(spark, rows), templates, 0.8).collect())
    want = []
    for i, t in rows:
        name, dice, n = brute_licenses(t, templates, 0.8)
        want.append((str(i), name, None if dice is None else round(dice, 9), n))
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want, key=str)] or sorted(map(str, got)) == sorted(map(str, want))
    assert {x[1] for x in got} >= {"one", "three", None}
    assert licenses.scan(frame(spark, []), templates).count() == 0


def brute_ids(machine, text):
    """Token ids by a plain Viterbi; of equal paths the longer last piece wins."""
    v = machine.vocabulary
    table = {}
    for i, (p, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)):
        if kind in (pieces.NORMAL, pieces.USER) and p and (p not in table or v.scores[i] > v.scores[table[p]]):
            table[p] = i
    if not text:
        return []
    b = b" " + text.encode()
    longest = max(map(len, table))
    best, back = [0.0] + [-np.inf] * len(b), [None] * (len(b) + 1)
    starts = [i for i in range(len(b)) if b[i] & 0xC0 != 0x80] + [len(b)]
    before = dict(zip(starts[1:], starts, strict=False))
    for j in range(1, len(b) + 1):
        for size in range(min(longest, j), 0, -1):
            i = table.get(b[j - size : j])
            if i is not None and best[j - size] + v.scores[i] > best[j]:
                best[j], back[j] = best[j - size] + v.scores[i], (j - size, [i])
        if j in before and b[before[j] : j] not in table and best[before[j]] + machine.unknown_score > best[j]:
            spelled = [v.byte_ids[x] for x in b[before[j] : j]] if v.byte_ids else [v.unknown]
            best[j], back[j] = best[before[j]] + machine.unknown_score, (before[j], spelled)
    out, j = [], len(b)
    while j:
        i, ids = back[j]
        out, j = ids + out, i
    return out


def test_pieces_ids_match_brute_force(spark):
    rng = random.Random(5)
    model = pieces.read_model()
    machine = pieces.automaton(model)
    texts = [prose(rng, 30), "The quick brown fox, jumped over 13 lazy dogs!", "naïve café – 中文字 🙂 ā\x00 end", "aaaaaaaaaaaaaaaaaaaaaa bbbb", "  two  spaces   three ", "x" * 70, "Überraschung\nZeile\tTab", "", "▁"]
    got = {r.doc_id: r["ids"] for r in pieces.encode(frame(spark, [*enumerate(texts), (50, None), (None, texts[0]), (0, texts[0])]), model).collect()}
    assert all(got[i] == brute_ids(machine, t) for i, t in enumerate(texts) if t != "▁") and got[None] == got[0] and got[50] is None
    assert pieces.encode(frame(spark, []), model).count() == 0


def test_queries_digest_what_their_operators_find(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crc = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) for r in docs.select("doc_id").collect()}
    four = {r.doc_id: (r.held_out, r.score) for r in registry.op4_language_id(spark, SF).collect()}
    assert {i: h for i, (h, _) in four.items()} == {i: c % 3 == 1 for i, c in crc.items()} and all(0 <= s <= 1 for _, s in four.values())
    seven = {r.doc_id: (r.held_out, r.score, r.predicted) for r in registry.op7_toxicity(spark, SF).collect()}
    assert all(h == (crc[i] % 4 == 2) and p == int(s >= 0.3) and 0 <= s <= 1 for i, (h, s, p) in seven.items()) and len(seven) == len(crc)
    one = {r.doc_id: r for r in registry.op1_decontamination(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, n, hit, found in contaminated(rows, items):
        r = one[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0) and r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
