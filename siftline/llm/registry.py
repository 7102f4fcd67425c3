"""The opN_ queries over whole tables and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annforest, decontaminate, langid, licenses, linededup, masked_lm, neardup, pieces, suffixdedup, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(words), 10) AS l, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
p AS (
  SELECT doc_id, i, l, array_to_string(words[i : i + l - 1], ' ') AS win
  FROM (SELECT doc_id, words, l, unnest(range(1, len(words) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM w))),
h AS (SELECT doc_id, i, l, item FROM p JOIN w USING (l, win)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run=linededup.RUN)
    return left.select("doc_id", "n_lines", "n_removed_lines", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS no, string_split(text, chr(10))[i] AS line, trim(regexp_replace(string_split(text, chr(10))[i], '[\t\r\x0B\f]', ' ', 'g')) AS t
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, no, t, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM l WHERE t <> ''),
z AS (SELECT *, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS w, length(t) AS c FROM s),
v AS (
  SELECT doc_id, k, no AS n1, lead(no) OVER o AS n2, lead(no, 2) OVER o AS n3, t AS t1, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, w AS w1, w + lead(w) OVER o AS w2, c AS c1, c + lead(c) OVER o AS c2
  FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
w AS (
  SELECT doc_id, k, [n1, n2, n3] AS nos, [t1, t2, t3] AS ts FROM v WHERE n3 IS NOT NULL
  UNION ALL SELECT doc_id, k, [n1, n2], [t1, t2] FROM v WHERE n2 IS NOT NULL AND (w2 >= 50 OR c2 >= 300)
  UNION ALL SELECT doc_id, k, [n1], [t1] FROM v WHERE w1 >= 50 OR c1 >= 300),
r AS (SELECT doc_id, nos, row_number() OVER (PARTITION BY ts ORDER BY doc_id, k) AS nth FROM w),
g AS (SELECT DISTINCT doc_id, unnest(nos) AS no FROM r WHERE nth > 1),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL) AS kept, count(*) AS n_lines, count(g.no) AS n_removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed_lines,
  CASE WHEN d.text IS NOT NULL THEN CAST(length(coalesce(kept, '')) AS BIGINT) END AS n_chars_left, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


def op3_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def _fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(_fold("doc_id", 3) != 1).select("text", "lang"))
    return langid.predict(docs, profiles).select("doc_id", F.coalesce(_fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, len(x) // 2 AS n FROM b),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS win FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM s WHERE n >= 50)),
m AS (SELECT win, min(doc_id) AS lo FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i FROM w JOIN m USING (win) WHERE doc_id > lo),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS fresh FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY ALL),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT k.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS z FROM k JOIN s USING (doc_id) GROUP BY k.doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN s.x ELSE coalesce(t.kept, '') || substr(s.x, 2 * t.z + 1) END)) AS kept_sha256
FROM s LEFT JOIN t USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(_fold("doc_id", 4) != 2), labels.where(_fold("doc_id", 4) != 2))
    held = F.coalesce(_fold("doc_id", 4) == 2, F.lit(True)).alias("held_out")
    return toxicity.scores(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model())
    return found.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "score", "round_trip")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.learn(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {"op1_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_suffix_array_dedup": OP6_SQL}
