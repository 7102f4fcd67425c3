"""The query catalogue of the retrieval engine: every operator over the driver's tables, with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as T
from ..operators import embed, evaluate, lookup, search, store, usage
from ..session import staged
from ..sources.repo import MAX_BYTES, SECRET_TEXT, SNIFF

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))


_P = "source || '/' || lang || '/d' || CAST(doc_id AS VARCHAR) || '.txt'"
_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]{3,}')"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_P} AS file_path, 'txt' AS ext, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def scan_project(t) -> DataFrame:
    return t("documents").select("doc_id", _path().alias("file_path"), P.extension(_path()).alias("ext"), T.token_estimate(F.col("text")).alias("tokens"))


@query(rf"""SELECT doc_id, n_chars FROM documents WHERE strlen(text) <= {MAX_BYTES} AND (instr(text, chr(0)) = 0 OR strlen(substr(text, 1, instr(text, chr(0)))) > {SNIFF}) AND NOT regexp_matches(text, '{SECRET_TEXT.pattern.replace(chr(39), chr(39) * 2)}')""")
def admission_filter(t) -> DataFrame:
    text = F.col("text")
    binary = F.contains(F.substring(F.encode(text, "UTF-8"), 1, SNIFF), F.lit(b"\0"))
    return t("documents").where((F.octet_length(text) <= MAX_BYTES) & ~binary & ~text.rlike(SECRET_TEXT.pattern)).select("doc_id", "n_chars")


@query("""SELECT 'eq' AS pred, count(*) AS n FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT 'in', count(*) FROM part WHERE p_size IN (1, 2, 3) UNION ALL
SELECT 'like', count(*) FROM part WHERE p_name LIKE '%1%' UNION ALL SELECT 'escape', count(*) FROM part WHERE p_name LIKE '%\\_%' ESCAPE '\\' UNION ALL
SELECT 'or', count(*) FROM part WHERE p_size = 7 OR p_type LIKE 'S%'""".replace("\\\\", "\\"))
def predicate_grammar(t) -> DataFrame:
    p = t("part")
    preds = {"eq": F.col("p_brand") == "Brand#12", "in": F.col("p_size").isin(1, 2, 3), "like": F.col("p_name").contains("1"), "escape": F.expr(r"p_name LIKE '%\\_%'"), "or": (F.col("p_size") == 7) | F.col("p_type").startswith("S")}
    one = p.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in preds.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pred"), F.col(f"`{k}`").alias("n")) for k in preds])).alias("x")).select("x.*")


@query(f"SELECT sha256({_NORM}) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash(t) -> DataFrame:
    return t("documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"SELECT doc_id, sha256('repo:' || {_P} || '::block:h:' || substr(sha256({_NORM}), 1, 16)) AS chunk_id FROM documents")
def chunk_identity(t) -> DataFrame:
    name = T.chunk_name(F.lit("block"), F.lit(None).cast("string"), F.col("text"), F.lit(0))
    return t("documents").select("doc_id", T.chunk_id(F.lit("repo"), _path(), F.lit(None).cast("string"), F.lit("block"), name).alias("chunk_id"))


@query("SELECT doc_id, source || ':' || lang || CASE WHEN row_number() OVER w > 1 THEN ':@' || CAST(row_number() OVER w - 1 AS VARCHAR) ELSE '' END AS identity FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)")
def repeat_suffix(t) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")) - 1
    return t("documents").select("doc_id", "source", "lang", nth.alias("n")).select("doc_id", F.concat("source", F.lit(":"), "lang", F.when(F.col("n") > 0, F.concat(F.lit(":@"), F.col("n").cast("string"))).otherwise("")).alias("identity"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS i, len(string_split(text, chr(10))[i]) AS len, len(string_split(text, chr(10))) AS n FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text <> '')),
c AS (SELECT *, sum(len + 1) OVER (PARTITION BY doc_id ORDER BY i) AS cs FROM l),
f AS (SELECT a.doc_id, a.i, a.len, a.n, max(b.i) AS fit FROM c a JOIN c b ON a.doc_id = b.doc_id AND (b.i = a.i OR b.i > a.i AND b.cs - a.cs + a.len + 1 <= 800) GROUP BY ALL),
x AS (SELECT *, CASE WHEN len > 800 THEN i + 1 WHEN fit + 1 >= n THEN n WHEN fit + 1 - 2 > i THEN fit + 1 - 2 ELSE fit + 1 END AS nxt FROM f),
w AS (SELECT doc_id, i, len, fit, nxt, n FROM x WHERE i = 0 UNION ALL SELECT x.doc_id, x.i, x.len, x.fit, x.nxt, x.n FROM w JOIN x ON x.doc_id = w.doc_id AND x.i = w.nxt WHERE w.nxt < w.n)
SELECT w.doc_id, CAST(i + 1 AS BIGINT) AS start_line, CAST(CASE WHEN len > 800 THEN i + 1 ELSE fit + 1 END AS BIGINT) AS end_line, sha256(CASE WHEN len > 800 THEN substr(lines[i + 1], p * 800 + 1, 800) ELSE array_to_string(lines[i + 1 : fit + 1], chr(10)) END) AS content
FROM (SELECT *, unnest(range(0, CASE WHEN len > 800 THEN CAST(ceil(len / 800.0) AS INT) ELSE 1 END)) AS p FROM w) w JOIN (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) t ON t.doc_id = w.doc_id""")
def text_windows(t) -> DataFrame:
    from ..operators.chunks import text_windows as windows

    return windows(t("documents"), "doc_id", 800, 2).select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("content"))


_OLD = "SELECT CAST(doc_id AS VARCHAR) AS file_path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0"
_NEW = "SELECT CASE WHEN doc_id % 13 = 5 THEN 'moved/' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS file_path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), b AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, o.h AS oh, n.h AS nh FROM o FULL JOIN n ON o.file_path = n.file_path),
r AS (SELECT a.file_path, m.file_path AS away FROM (SELECT nh, min(file_path) AS file_path FROM b WHERE oh IS NULL GROUP BY nh) a JOIN (SELECT oh, max(file_path) AS file_path FROM b WHERE nh IS NULL GROUP BY oh) m ON a.nh = m.oh)
SELECT b.file_path, CASE WHEN r.file_path IS NOT NULL THEN 'renamed' WHEN s.away IS NOT NULL THEN 'moved away' WHEN oh IS NULL THEN 'new' WHEN nh IS NULL THEN 'removed' WHEN oh = nh THEN 'unchanged' ELSE 'changed' END AS status
FROM b LEFT JOIN r ON r.file_path = b.file_path LEFT JOIN r s ON s.away = b.file_path""")
def hash_diff(t) -> DataFrame:
    d, name = t("documents"), F.col("doc_id").cast("string")
    old = d.where("doc_id % 10 <> 0").select(name.alias("file_path"), F.sha2("text", 256).alias("file_hash"))
    new = d.where("doc_id % 10 <> 1").select(F.when(F.expr("doc_id % 13 = 5"), F.concat(F.lit("moved/"), name)).otherwise(name).alias("file_path"), F.sha2(F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("file_hash"))
    return store.hash_diff(old, new)


@query("""WITH o AS (SELECT doc_id AS id, source AS file_path, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS id, source AS file_path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'y' ELSE text END) AS h FROM documents)
SELECT n.id, CASE WHEN o.h = n.h THEN 'id' WHEN EXISTS (SELECT 1 FROM o p WHERE p.file_path = n.file_path AND p.h = n.h) THEN 'content' ELSE 'embed' END AS source FROM n LEFT JOIN o ON o.id = n.id""")
def embedding_reuse(t) -> DataFrame:
    d = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), "text")
    old = d.where("id % 3 <> 0").select("id", "file_path", F.sha2("text", 256).alias("content_hash"))
    new = d.select("id", "file_path", F.sha2(F.when(F.expr("id % 5 = 0"), F.concat("text", F.lit("y"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return store.embedding_reuse(new, old)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def stale_ids(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("id")).join(t("lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, 1 AS seq FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'Y', 2 FROM orders WHERE o_orderkey % 8 = 0 UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'N', 3 FROM orders WHERE o_orderkey % 100 = 0),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM n""")
def upsert_last_wins(t) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = lambda rows, status, seq: rows.withColumn("o_orderstatus", F.lit(status)).withColumn("seq", F.lit(seq))
    batch = changed(o.where("o_orderkey % 4 = 0"), "X", 1).unionByName(changed(o.where("o_orderkey % 8 = 0"), "Y", 2)).unionByName(changed(o.where("o_orderkey % 100 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000), "N", 3))
    return store.upsert(o, batch, ["o_orderkey"], "seq")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed/' || s_name ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_nationkey <> 7 AND s_suppkey % 5 <> 0""")
def delete_rename_update(t) -> DataFrame:
    s = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    left = store.delete_where_in(s.where("s_nationkey <> 7"), s.where("s_suppkey % 5 = 0"), ["s_suppkey"])
    moved = store.rename(left, left.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("old"), F.concat(F.lit("renamed/"), "s_name").alias("new")), "s_name")
    return moved.withColumn("s_nationkey", F.when(F.expr("s_suppkey % 4 = 0"), 0).otherwise(F.col("s_nationkey")))


def _asked_vectors(t):
    """The stated query set of a search: vec_ids divisible by 100."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _vector_sql(k):
    return f"""SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS INTEGER) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= {k}"""


@query(_vector_sql(20))
def vector_topk(t) -> DataFrame:
    return search.vector_top_k(_asked_vectors(t), t("embeddings"), 20).select("query_id", "vec_id", "rank")


@query(_vector_sql(10))
def vector_topk_batch(t) -> DataFrame:
    return search.vector_top_k(_asked_vectors(t), t("embeddings"), 10).select("query_id", "vec_id", "rank")


def _bm25_sql(k):
    return f"""b_w AS (SELECT doc_id, {_TOK} AS w FROM documents), b_p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM b_w), b_tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM b_p GROUP BY ALL),
b_n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM b_w), b_df AS (SELECT term, count(*) AS df FROM b_tf GROUP BY term),
b_q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 10000 + 0.5) / 10000 AS score FROM b_tf JOIN b_q USING (term) JOIN b_df USING (term), b_n GROUP BY ALL),
bk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= {k})"""


def _items(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_bm25_sql(10)} SELECT query_id, doc_id, score, rank FROM bk")
def bm25_topk(t) -> DataFrame:
    return search.bm25(t("documents"), _items(t), 10)


@query(f"WITH {_bm25_sql(20)} SELECT query_id, doc_id, floor(score / greatest(max(score) OVER (PARTITION BY query_id), 1e-9) * 1000 + 0.5) / 1000 AS keyword FROM bk")
def bm25_normalised(t) -> DataFrame:
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    return search.bm25(t("documents"), _items(t), 20).select("query_id", "doc_id", T.round_at(T.clamp01(F.col("score") / top), 3).alias("keyword"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 WHEN lang = 'fr' THEN 0.7 WHEN lang = 'de' THEN 0.4 ELSE 0.0 END AS structural, CAST(doc_id % 7 = 0 AS INTEGER) * 1.0 AS test,
floor(greatest(0, least(1, 1 - (doc_id % 240) / 168.0)) * 10000 + 0.5) / 10000 AS recency FROM documents""")
def signal_columns(t) -> DataFrame:
    structural = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 0.7).when(F.col("lang") == "de", 0.4).otherwise(0.0)
    test = P.is_test(F.concat(F.when(F.expr("doc_id % 7 = 0"), F.lit("src/tests/")).otherwise("src/"), F.col("doc_id").cast("string"))).cast("double")
    recency = T.round_at(T.clamp01(1 - F.expr("doc_id % 240") / 168.0), 4)
    return t("documents").select("doc_id", structural.alias("structural"), test.alias("test"), recency.alias("recency"))


@query("""SELECT doc_id, greatest(floor(greatest(0e0, least(1e0, (doc_id % 11) / 10e0 * 7e-1 + (doc_id % 5) / 4e0 * 2e-1 + (doc_id % 2) / 1e0 * 1e-1 + (doc_id % 3) / 2e0 * 5e-2)) * CASE WHEN doc_id % 4 = 0 THEN 85e-2 ELSE 1e0 END * 1000 + 5e-1) / 1000,
floor(CASE WHEN doc_id % 17 = 0 THEN 95e-2 WHEN doc_id % 19 = 0 THEN (doc_id % 5) / 4e0 * 13e-2 + 82e-2 ELSE 0e0 END * 1000 + 5e-1) / 1000) AS total FROM documents""")
def combined_score(t) -> DataFrame:
    part = lambda m, n: F.expr(f"doc_id % {m}") / n
    floor = F.when(F.expr("doc_id % 17 = 0"), 0.95).when(F.expr("doc_id % 19 = 0"), part(5, 4.0) * 0.13 + 0.82).otherwise(0.0)
    factor = F.when(F.expr("doc_id % 4 = 0"), 0.85).otherwise(1.0)
    return t("documents").select("doc_id", search.combined({"semantic": part(11, 10.0), "keyword": part(5, 4.0), "symbol": part(2, 1.0), "path": part(3, 2.0)}, factor, floor).alias("total"))


def _two_channels(t) -> DataFrame:
    a = t("documents").where("doc_id % 3 <> 0").select(F.expr("doc_id % 5").alias("query_id"), F.col("doc_id").alias("id"), (F.expr("doc_id % 100") / 100).alias("total"), F.lit("vector").alias("source"), F.lit(0).alias("arrival"))
    b = t("documents").where("doc_id % 2 = 0").select(F.expr("doc_id % 5").alias("query_id"), F.col("doc_id").alias("id"), (F.expr("doc_id * 7 % 100") / 100).alias("total"), F.lit("keyword").alias("source"), F.lit(1).alias("arrival"))
    return search.merge_candidates(a.unionByName(b))


_MERGE = """m AS (SELECT query_id, id, max(total) AS total, arg_max(source, total * 10 - arrival) AS best_source, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM (
SELECT doc_id % 5 AS query_id, doc_id AS id, (doc_id % 100) / 100 AS total, 'vector' AS source, 0 AS arrival FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id % 5, doc_id, (doc_id * 7 % 100) / 100, 'keyword', 0.01 FROM documents WHERE doc_id % 2 = 0) GROUP BY 1, 2)"""


@query(f"WITH {_MERGE} SELECT query_id, id, total, best_source, sources FROM m")
def merge_max(t) -> DataFrame:
    return _two_channels(t)


@query(f"WITH {_MERGE} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id % 4, id) AS INTEGER) AS rank FROM m")
def total_order(t) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("total"), F.expr("id % 4"), "id")
    return _two_channels(t).select("query_id", "id", F.row_number().over(w).cast("int").alias("rank"))


@query(f"WITH {_MERGE}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, id % 3 ORDER BY total DESC, id) AS nth FROM m) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS INTEGER) AS rank FROM c WHERE nth <= 4 QUALIFY rank <= 10")
def diversity_caps(t) -> DataFrame:
    capped = search.top_k(_two_channels(t).withColumn("file", F.expr("id % 3")), ["query_id", "file"], [F.desc("total"), "id"], 4, "nth")
    return search.top_k(capped, ["query_id"], [F.desc("total"), "id"], 10).select("query_id", "id", "rank")


_CLASSES = f"""s AS (SELECT doc_id, source, list_sort(list_distinct({_TOK})) AS w FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY source, w) AS class_id FROM s WHERE len(w) >= 12)"""


@query(f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS w FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS class_id FROM s WHERE len(w) > 0), r AS (SELECT * FROM k WHERE doc_id = class_id)
SELECT a, b, shared FROM (SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS shared, len(a.w) + len(b.w) AS n FROM r a JOIN r b ON a.doc_id < b.doc_id AND 80 * len(a.w) <= 100 * len(b.w) AND 80 * len(b.w) <= 100 * len(a.w)) WHERE 100 * shared >= 80 * (n - shared)
UNION ALL SELECT class_id, doc_id, CAST(len(w) AS BIGINT) FROM k WHERE doc_id <> class_id""")
def near_duplicates(t) -> DataFrame:
    return search.near_duplicate_pairs(t("documents"), copies=True)


@query(f"WITH {_CLASSES} SELECT source, doc_id, class_id FROM k")
def near_duplicate_classes(t) -> DataFrame:
    return search.near_duplicate_classes(t("documents"), "source")


@query("""WITH i AS (SELECT event_id, user_id, epoch_us(ts) AS lo, epoch_us(ts) + CAST(floor(value * 600) AS BIGINT) * 1000000 AS hi FROM events WHERE value IS NOT NULL), k AS (SELECT * FROM i WHERE hi > lo)
SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM k a JOIN k b ON a.user_id = b.user_id AND (a.lo < b.lo OR a.lo = b.lo AND a.event_id < b.event_id) WHERE least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.5 * least(a.hi - a.lo, b.hi - b.lo)""")
def interval_overlap(t) -> DataFrame:
    lo = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t("events").where("value IS NOT NULL").select(F.col("event_id").alias("id"), "user_id", lo.alias("lo"), (lo + F.floor(F.col("value") * 600) * 1000000).alias("hi"))
    return search.interval_overlaps(rows, "user_id")


@query("""WITH r AS (SELECT source, doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 0.9 WHEN doc_id % 9 < 4 THEN 0.7 ELSE 0.3 + (doc_id % 9) / 100 END AS total FROM documents),
s AS (SELECT *, row_number() OVER w - 1 AS i, lag(total) OVER w AS before FROM r WINDOW w AS (PARTITION BY source ORDER BY total DESC, id))
SELECT source, coalesce(arg_min(before, i) FILTER (i >= 2 AND before - total >= 0.15), 0.0) AS floor FROM s GROUP BY source""")
def score_gap_cut(t) -> DataFrame:
    m = F.expr("doc_id % 9")
    rows = t("documents").select("source", F.col("doc_id").alias("id"), F.when(m == 0, 0.9).when(m < 4, 0.7).otherwise(0.3 + m / 100).alias("total"))
    return search.gap_cut(rows, "source")


@query(f"""WITH q AS (SELECT item_id, {_TOK}[1] AS term FROM benchmark), p AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL), m AS (SELECT item_id, term, doc_id, n FROM q JOIN p USING (term))
SELECT item_id, term, count(*) AS files, CAST(sum(n) AS BIGINT) AS occurrences, count(*) <= 4 AS rare FROM m GROUP BY ALL""")
def references(t) -> DataFrame:
    asked = t("benchmark").select("item_id", F.get(T.tokens(F.col("text")), 0).alias("term")).where("term IS NOT NULL")
    return search.postings(t("documents")).join(asked, "term").groupBy("item_id", "term").agg(F.count("*").alias("files"), F.sum("tf").alias("occurrences"), (F.count("*") <= 4).alias("rare"))


@query("""SELECT 'language' AS kind, lang AS name, count(*) AS n, round(count(*) * 1000.0 / sum(count(*)) OVER ()) / 10 AS percent FROM documents GROUP BY lang
UNION ALL SELECT * FROM (SELECT 'directory', source, count(*) AS n, CAST(NULL AS DOUBLE) FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10)""")
def repo_rollup(t) -> DataFrame:
    files = t("documents").select("lang", F.split(_path(), "/").getItem(0).alias("dir"))
    langs = files.groupBy(F.lit("language").alias("kind"), F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    langs = langs.withColumn("percent", F.round(F.col("n") * 1000.0 / F.sum("n").over(Window.partitionBy("kind"))) / 10)
    dirs = files.groupBy(F.col("dir").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return langs.unionByName(dirs.select(F.lit("directory").alias("kind"), "name", "n", F.lit(None).cast("double").alias("percent")))


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_type), ' '))) AS word FROM part), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), h AS (SELECT p_partkey, word, n FROM w JOIN c USING (word) WHERE n <= greatest(3, (SELECT count(*) FROM part) // 5))
SELECT p_partkey, max(1.0 / n) AS specificity, arg_max(word, (1.0 / n, word)) AS word FROM h GROUP BY p_partkey""")
def path_terms(t) -> DataFrame:
    words = t("part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(t("part").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 5)).alias("most"))), F.col("n") <= F.col("most"))
    return words.join(counts, "word").groupBy("p_partkey").agg(F.max(F.lit(1.0) / F.col("n")).alias("specificity"), F.max_by("word", F.struct(F.lit(1.0) / F.col("n"), F.col("word"))).alias("word"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), f AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 500 = 0),
h1 AS (SELECT DISTINCT p AS id FROM (SELECT o, p, row_number() OVER (PARTITION BY o ORDER BY p) AS n FROM e WHERE o IN (SELECT id FROM f)) WHERE n <= 8),
h2 AS (SELECT DISTINCT o AS id FROM (SELECT o, p, row_number() OVER (PARTITION BY p ORDER BY o) AS n FROM e WHERE p IN (SELECT id FROM h1)) WHERE n <= 8)
SELECT 'o' || CAST(id AS VARCHAR) AS id, 0 AS hop FROM f UNION ALL SELECT 'p' || CAST(id AS VARCHAR), 1 FROM h1 UNION ALL SELECT 'o' || CAST(id AS VARCHAR), 2 FROM h2 WHERE id NOT IN (SELECT id FROM f)""")
def graph_expand_2hop(t) -> DataFrame:
    line = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    name = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    edges = line.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).unionByName(line.select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst")))
    found = search.expand(t("orders").where("o_orderkey % 500 = 0").select(name("o", "o_orderkey").alias("id")), edges, 8, 2)
    return found.select(F.concat("id.kind", F.col("id.key").cast("string")).alias("id"), "hop")


_FACET = f"""{_bm25_sql(20)}, f AS (SELECT item_id AS facet, unnest(list_distinct({_TOK})) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents), p AS (SELECT query_id AS facet, count(*) AS pool FROM bk GROUP BY 1),
h AS (SELECT query_id AS facet, doc_id, term FROM bk JOIN d USING (doc_id)), i AS (SELECT f.facet, f.term, ln(1 + max(pool) / (count(h.doc_id) + 1)) AS idf FROM f JOIN p USING (facet) LEFT JOIN h ON h.facet = f.facet AND h.term = f.term GROUP BY ALL), s AS (SELECT facet, sum(idf) AS total FROM i GROUP BY facet),
r AS (SELECT i.facet, doc_id, floor(sum(idf) / max(total) * 10000 + 0.5) / 10000 AS share FROM i JOIN h ON h.facet = i.facet AND h.term = i.term JOIN s ON s.facet = i.facet GROUP BY ALL)"""


def _facet_share(t) -> DataFrame:
    found = staged(search.bm25(t("documents"), _items(t), 20).select(F.col("query_id").alias("facet"), "doc_id"), "pool")
    texts = search.rows_of(t("documents").select("doc_id", "text"), found, "doc_id")
    return search.idf_share(found.join(texts, "doc_id"), _items(t).withColumnRenamed("query_id", "facet"))


@query(f"WITH {_FACET} SELECT facet, doc_id, share FROM r")
def facet_idf_relevance(t) -> DataFrame:
    return _facet_share(t)


@query(f"WITH {_FACET}, b AS (SELECT facet, max(share) AS best, count(*) FILTER (share >= 0.35) AS evidence FROM r GROUP BY facet) SELECT facet, best, evidence, CASE WHEN best >= 0.6 THEN 'covered' WHEN best >= 0.35 THEN 'weak' ELSE 'missing' END AS status FROM b")
def coverage_report(t) -> DataFrame:
    best = _facet_share(t).groupBy("facet").agg(F.max("share").alias("best"), F.count(F.when(F.col("share") >= 0.35, 1)).alias("evidence"))
    return best.select("facet", "best", "evidence", F.when(F.col("best") >= 0.6, "covered").when(F.col("best") >= 0.35, "weak").otherwise("missing").alias("status"))


@query("""WITH k AS (SELECT source AS query_id, d.doc_id AS id, coalesce(quality + 1 - toxic, 0) AS level, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT query_id, count(*) FILTER (level > 0 AND rank <= 5) / count(*) FILTER (rank <= 5) AS p, count(*) FILTER (level > 0 AND rank <= 10) AS found, coalesce(1.0 / min(rank) FILTER (level > 0), 0) AS rr, sum(CASE WHEN rank <= 10 THEN level / log2(rank + 1) ELSE 0 END) AS dcg FROM k WHERE rank <= 20 GROUP BY query_id),
i AS (SELECT query_id, level, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, id) AS place FROM k WHERE level > 0), g AS (SELECT query_id, count(*) AS n, sum(CASE WHEN place <= 10 THEN level / log2(place + 1) ELSE 0 END) AS idcg FROM i GROUP BY query_id)
SELECT p.query_id, floor(p * 10000 + 0.5) / 10000 AS precision_5, floor(coalesce(found / n, 0) * 10000 + 0.5) / 10000 AS recall_10, floor(rr * 10000 + 0.5) / 10000 AS mrr, floor(coalesce(dcg / idcg, 0) * 10000 + 0.5) / 10000 AS ndcg_10 FROM p LEFT JOIN g USING (query_id)""")
def ir_metrics(t) -> DataFrame:
    ranked = search.top_k(t("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars"), ["query_id"], [F.desc("n_chars"), "id"], 20)
    labels = t("documents").select(F.col("source").alias("query_id"), "doc_id").join(t("labels"), "doc_id").select("query_id", F.col("doc_id").alias("id"), (F.col("quality") + 1 - F.col("toxic")).alias("level"))
    return evaluate.ir_metrics(ranked.drop("n_chars"), labels)


@query("""WITH c AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS seq, CAST(ceil(length(text) / 4.0) AS BIGINT) AS k FROM conversations), t AS (SELECT conv_id, seq, sum(k) AS k FROM c GROUP BY ALL),
g AS (SELECT conv_id, seq, k, 6000 + sum(k + 150) OVER (PARTITION BY conv_id ORDER BY seq) AS after FROM t), p AS (SELECT conv_id, count(*) AS turns, sum(after - k - 150) AS reads, max(after) AS last FROM g GROUP BY conv_id)
SELECT conv_id AS session_id, turns + 1 AS calls, CAST(reads + last AS BIGINT) AS input, turns * 150 + 700 AS output, floor((0.1 * reads + 1.25 * last + 5 * (turns * 150 + 700)) * 100 + 0.5) / 100 AS cached_cost FROM p""")
def session_cost(t) -> DataFrame:
    return evaluate.session_cost(t("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), T.token_estimate(F.col("text")).alias("result_tokens")))


@query("SELECT source AS repo, count(*) AS files, least(15000, 400 + 12 * count(*)) + least(70000, 2000 + 80 * count(*)) + least(8000, 200 + 8 * count(*)) AS baseline FROM documents GROUP BY source")
def baseline_heuristic(t) -> DataFrame:
    return t("documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("files")).withColumn("baseline", usage.heuristic(F.col("files")))


@query("""WITH r AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), s AS (SELECT * FROM r WHERE i IN (SELECT (k * n) // 32 FROM range(32) t(k)))
SELECT count(*) AS files, min(doc_id) AS lo, max(doc_id) AS hi, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || h, ',' ORDER BY doc_id)) AS fingerprint FROM s""")
def freshness_sample(t) -> DataFrame:
    d = t("documents")
    picked = d.join(F.broadcast(store.evenly_spaced(d, "doc_id")), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: F.concat(x.doc_id.cast("string"), F.lit(":"), x.h)), ",")
    return picked.agg(F.count("*").alias("files"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sha2(joined, 256).alias("fingerprint"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def event_compaction(t) -> DataFrame:
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS events FROM g GROUP BY user_id, g""")
def debounce_sessions(t) -> DataFrame:
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.unix_micros(F.min("ts")).alias("first_us"), F.count("*").alias("events")).select("user_id", "first_us", "events")


@query("""WITH c AS (SELECT conv_id, turn, length(text) % 3 = 0 AS seen FROM conversations), a AS (SELECT *, CASE WHEN lag(seen) OVER w IS NOT DISTINCT FROM seen THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM a),
d AS (SELECT conv_id, turn, seen AND count(*) OVER (PARTITION BY conv_id, g) >= 2 AS seen FROM b), e AS (SELECT *, CASE WHEN lag(seen) OVER w IS NOT DISTINCT FROM seen THEN 0 ELSE 1 END AS s FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM e)
SELECT conv_id, min(turn) AS lo, max(turn) AS hi, seen FROM f GROUP BY conv_id, g, seen""")
def seen_runs(t) -> DataFrame:
    return evaluate.runs_of(t("conversations").withColumn("seen", F.length("text") % 3 == 0), "conv_id", "turn", "seen", 2)


@query(f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS w FROM documents), v AS (SELECT DISTINCT w FROM w), h AS (SELECT w, list_reduce(list_prepend(2166136261::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(w, '')]), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT) AS h FROM v),
b AS (SELECT doc_id, CAST(h % 384 AS INTEGER) AS bucket, CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END AS sign FROM w JOIN h USING (w)) SELECT doc_id, bucket, CAST(sum(sign) AS BIGINT) AS weight FROM b GROUP BY ALL""")
def hash_features(t) -> DataFrame:
    return embed.feature_counts(t("documents"), "doc_id")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def file_ranges(t) -> DataFrame:
    lines = F.split("text", "\n")
    return t("documents").where(F.size(lines) >= 2).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_join(F.slice(lines, 2, 3), "\n").alias("lines"))


@query("""WITH r AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations), s AS (SELECT *, sum(tokens) OVER w AS c, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, tokens FROM s WHERE c <= 200 OR n = 1""")
def token_budget(t) -> DataFrame:
    return evaluate.within_budget(t("conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens")), "conv_id", "turn", "tokens", 200)


_KEY = "[" + ", ".join(f"'{k}'" for k in T.KEYWORDS) + "]"


@query(rf"""WITH r AS (SELECT page_id, list_filter(regexp_extract_all(html, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_]..')) AS ids FROM pages), u AS (SELECT page_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM r), f AS (SELECT page_id, id, min(i) AS i FROM u WHERE NOT list_contains({_KEY}, id) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f) SELECT page_id, string_agg(id, ' ' ORDER BY n) AS identifiers FROM n WHERE n <= 40 GROUP BY page_id""")
def identifier_extract(t) -> DataFrame:
    return t("pages").select("page_id", F.array_join(T.identifiers(F.col("html")), " ").alias("identifiers")).where("identifiers <> ''")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, substr(b.text, 1, 60)) WHERE length(b.text) >= 30")
def contamination(t) -> DataFrame:
    """Texts that quote an item's first 60 characters."""
    needles = t("benchmark").where(F.length("text") >= 30).select("item_id", F.substring("text", 1, 60).alias("needle"))
    return lookup.containing(t("documents"), needles, "doc_id", "text").join(needles, "needle").select("doc_id", "item_id").distinct()


def queries() -> dict:
    from . import lookups, reports, rows_only  # noqa: F401 - they add to Q and SQL

    return {**Q, **rows_only.queries()}


def oracle_sql() -> dict:
    from . import lookups, reports  # noqa: F401

    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword and hashed-vector candidates of all benchmark items, scored, merged and ranked."""
    from ..operators.hybrid import hybrid_search

    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return hybrid_search(t("documents"), _items(t), 10)
