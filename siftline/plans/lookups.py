"""Queries of words, files, lookups and expansion, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import words as W
from ..operators import expand, lookup, signals
from .catalogue import _P, _path, query

#: Files that stand in for a source tree: one for every part, in code, test, document, configuration and hidden folders.
FILE = (
    "CASE p_partkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/tests/' WHEN 2 THEN '' WHEN 3 THEN 'docs/' WHEN 4 THEN '.github/' ELSE 'pkg/__tests__/' END || lower(p_type) || '/' || "
    "replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '' END) || CASE p_partkey % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.config.js' WHEN 4 THEN '_test.go' WHEN 5 THEN '.PY' ELSE '.json' END"
)
#: And one for every customer, of which up to three share the number in their names.
UNIT = "'src/' || lower(c_mktsegment) || '/unit_' || CAST(1000 + floor(c_custkey / 3) AS INT) || CASE WHEN c_custkey % 5 = 0 THEN '.json' ELSE '.ts' END"


def files(t) -> DataFrame:
    return t("part").select("p_partkey", F.expr(FILE).alias("file_path"))


def units(t) -> DataFrame:
    return t("customer").select("c_custkey", F.expr(UNIT).alias("file_path"))


@query(f"""SELECT p_partkey, regexp_matches(lower(path), '\\.test\\.|\\.spec\\.|_test\\.|/__tests__/|/tests/|/test/[^/]*$') AS is_test,
list_contains({P.CONFIG_NAMES!r}, lower(regexp_extract(path, '[^/]*$'))) OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.config\\.(ts|js|mjs)$|^\\..*rc(\\.json)?$') AS is_config,
regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.(md|mdc|mdx|markdown|rst|adoc|txt)$|^(readme|changelog|contributing|license|notice|authors)(\\..*)?$') AS is_doc,
regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{P.SECRET_NAME}') AS is_secret,
NOT regexp_matches(lower(path), '\\.(md|mdc|mdx|markdown|rst|adoc|txt|json|jsonc|ya?ml|toml|ini|xml|csv|lock|env)$') AND NOT regexp_matches(path, '(^|/)\\.') AS is_code FROM (SELECT p_partkey, {FILE} AS path FROM part)""")
def path_classes(t) -> DataFrame:
    p = F.col("file_path")
    return files(t).select("p_partkey", P.is_test(p).alias("is_test"), P.is_config(p).alias("is_config"), P.is_doc(p).alias("is_doc"), P.is_secret(p).alias("is_secret"), P.is_code(p).alias("is_code"))


@query(f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"('{e}', '{n}')" for n, es in P.LANGUAGES.items() for e in es.split())}) v(ext, lang)), f AS (SELECT p_partkey, {FILE} AS path FROM part)
SELECT p_partkey, coalesce(lang, 'text') AS language FROM f LEFT JOIN m ON ext = lower(regexp_extract(path, '[^/]+\\.([^./]+)$', 1))""")
def language_detect(t) -> DataFrame:
    return files(t).select("p_partkey", P.language(F.col("file_path")).alias("language"))


_SPLIT = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_SHORT = "list_transform({}, lambda x: CASE WHEN length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END)"
_STEMS = "list_sort(list_distinct(" + _SHORT.format(_SPLIT.format(r"regexp_replace(regexp_extract({0}, '[^/]*$'), '\.[^.]+$', '')")) + "))"
_DIRS = "list_sort(list_distinct(" + _SHORT.format(_SPLIT.format("CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END")) + "))"


@query(f"SELECT p_partkey, array_to_string({_STEMS.format('path')}, ' ') AS stem, array_to_string({_DIRS.format('path')}, ' ') AS dirs FROM (SELECT p_partkey, {FILE} AS path FROM part)")
def path_words(t) -> DataFrame:
    p = F.col("file_path")
    return files(t).select("p_partkey", F.array_join(F.array_sort(W.stem_words(p)), " ").alias("stem"), F.array_join(F.array_sort(W.dir_words(p)), " ").alias("dirs"))


def _terms(t) -> DataFrame:
    s = t("supplier")
    return s.select(F.col("s_suppkey").alias("query_id"), F.explode(F.array(F.expr("CAST(1000 + s_suppkey AS STRING)"), F.expr("CAST(1000 + s_suppkey * 2 AS STRING)"), F.lit("units"), F.lit("building"))).alias("term"))


@query(f"""WITH f AS (SELECT DISTINCT {UNIT} AS file_path, CAST(1000 + floor(c_custkey / 3) AS INT) AS num, lower(c_mktsegment) AS dir FROM customer WHERE c_custkey % 5 <> 0),
q AS (SELECT DISTINCT s_suppkey AS query_id, unnest([CAST(1000 + s_suppkey AS VARCHAR), CAST(1000 + s_suppkey * 2 AS VARCHAR), 'building']) AS term FROM supplier),
w AS (SELECT file_path, CAST(num AS VARCHAR) AS word, 0 AS dir FROM f UNION ALL SELECT file_path, dir, 1 FROM f), n AS (SELECT word, dir, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT query_id, file_path, term, 1.0 / n AS specificity FROM q JOIN w ON term = word JOIN n USING (word, dir) WHERE n <= CASE dir WHEN 0 THEN 3 ELSE 2 END)
SELECT query_id, file_path, arg_min(term, (-specificity, term)) AS term, CAST(max(specificity) AS DOUBLE) AS specificity FROM h GROUP BY ALL""")
def path_term_hits(t) -> DataFrame:
    return signals.path_hits(units(t), _terms(t))


@query(f"""WITH f AS (SELECT DISTINCT {UNIT} AS file_path, CAST(CAST(1000 + floor(c_custkey / 3) AS INT) AS VARCHAR) AS word FROM customer WHERE c_custkey % 5 <> 0) SELECT min(file_path) AS file_path, word AS words FROM f GROUP BY word HAVING count(*) = 1""")
def specific_stems(t) -> DataFrame:
    return signals.specific_words(units(t)).select("file_path", F.array_join("words", " ").alias("words"))


_HUMPS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), ' '), lambda x: x <> '')"
_SINGULAR = "CASE WHEN length(w) < 3 OR NOT ends_with(w, 's') THEN w WHEN length(w) = 3 THEN CASE WHEN regexp_matches(w, '(ss|us|is|os|as)$') THEN w ELSE left(w, -1) END WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|xes|ches|shes)$') THEN left(w, -2) WHEN regexp_matches(w, '(ss|us|is|os)$') THEN w ELSE left(w, -1) END"
_STEM = "CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, -3) WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, -2) WHEN length(w) > 4 AND ends_with(w, 'e') THEN left(w, -1) ELSE w END"
_WORDS = f"""r AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')) AS raw FROM s), p AS (SELECT id, raw, {_HUMPS} AS parts, regexp_matches(raw, '^[A-Z]{{2,}}s$') AS acro FROM r),
a AS (SELECT id, lower(left(raw, -1)) AS word FROM p WHERE acro UNION ALL SELECT id, lower(raw) FROM p WHERE NOT acro AND len(parts) > 1 UNION ALL SELECT id, {_STEM} FROM (SELECT id, {_SINGULAR} AS w FROM (SELECT id, unnest(parts) AS w FROM p WHERE NOT acro)))"""


@query(f"WITH s AS (SELECT page_id AS id, html AS text FROM pages), {_WORDS} SELECT id AS page_id, word, count(*) AS n FROM a GROUP BY ALL")
def words_of(t) -> DataFrame:
    return t("pages").select("page_id", F.explode(W.words_of(F.col("html"))).alias("word")).groupBy("page_id", "word").agg(F.count("*").alias("n"))


_STOPPED = ", ".join(f"('{w}', '{W.plain_stem(W.plain_singular(w))}')" for w in W.PROSE_STOP)


@query(f"""WITH s AS (SELECT item_id AS id, text FROM benchmark), {_WORDS}, v AS (SELECT * FROM (VALUES {_STOPPED}) v(stop, own)), x AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS stop FROM s),
g AS (SELECT id, own AS word FROM x JOIN v USING (stop) UNION SELECT id, stop FROM s, v) SELECT DISTINCT id AS item_id, word FROM a WHERE length(word) >= 2 AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = a.id AND g.word = a.word)""")
def content_words(t) -> DataFrame:
    return t("benchmark").select("item_id", F.explode(W.content_words(F.col("text"))).alias("word"))


@query(r"""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'src/e' || event_id || '.ts' WHEN 1 THEN 'src/e.ts:' || user_id WHEN 2 THEN ' a:b.ts:' || event_id || '-' || user_id || ' ' ELSE 'x:y' END AS ref, event_id * 977 * (user_id + 1) AS n, value / 50 AS v, event_type || ' of user ' || user_id || repeat(' and more', CAST(event_id % 12 AS INT)) AS label FROM events),
m AS (SELECT *, trim(ref) AS t, regexp_matches(trim(ref), '^.*?:\d+(-\d+)?$') AS has FROM s), q AS (SELECT *, CASE WHEN has THEN regexp_extract(t, '^(.*?):(\d+)(?:-(\d+))?$', 1) ELSE t END AS file, CASE WHEN has THEN CAST(regexp_extract(t, '^(.*?):(\d+)(?:-(\d+))?$', 2) AS BIGINT) END AS start_line, CASE WHEN has THEN TRY_CAST(regexp_extract(t, '^(.*?):(\d+)(?:-(\d+))?$', 3) AS BIGINT) END AS last FROM m)
SELECT event_id, file, start_line, CASE WHEN has THEN greatest(start_line, coalesce(last, start_line)) END AS end_line,
CASE WHEN n >= 1099511627776 THEN format('{:.1f} TB', n / 1099511627776e0) WHEN n >= 1073741824 THEN format('{:.1f} GB', n / 1073741824e0) WHEN n >= 1048576 THEN format('{:.1f} MB', n / 1048576e0) WHEN n >= 1024 THEN format('{:.1f} KB', n / 1024e0) ELSE n || ' B' END AS size,
CASE WHEN length(label) > 70 THEN rtrim(left(label, 69)) || '…' ELSE label END AS label, left(sha256('/repos/r' || event_id), 16) AS repo_id, replace(replace(replace(label, '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM q""")
def text_helpers(t) -> DataFrame:
    e = t("events")
    ref = F.expr("CASE event_id % 4 WHEN 0 THEN 'src/e' || event_id || '.ts' WHEN 1 THEN 'src/e.ts:' || user_id WHEN 2 THEN ' a:b.ts:' || event_id || '-' || user_id || ' ' ELSE 'x:y' END")
    label = F.expr("event_type || ' of user ' || user_id || repeat(' and more', CAST(event_id % 12 AS INT))")
    rows = e.select("event_id", W.range_ref(ref).alias("r"), F.expr("event_id * 977 * (user_id + 1)").alias("n"), label.alias("label"), F.concat(F.lit("/repos/r"), F.col("event_id").cast("string"), F.lit("/")).alias("path"))
    return rows.select("event_id", "r.file", "r.start_line", "r.end_line", W.bytes_text(F.col("n")).alias("size"), W.truncated(F.col("label")).alias("label"), W.repo_id(F.col("path")).alias("repo_id"), W.like_literal(F.col("label")).alias("pattern"))


@query("""WITH q AS (SELECT p_name AS name FROM part UNION SELECT substr(p_name, 1, length(p_name) - 1) FROM part UNION SELECT substr(p_name, 2, 3) FROM part),
e AS (SELECT DISTINCT q.name, p_partkey, TRUE AS exact FROM q JOIN part ON p_name = q.name), f AS (SELECT DISTINCT q.name, p_partkey, FALSE AS exact FROM q JOIN part ON contains(p_name, q.name) WHERE q.name NOT IN (SELECT name FROM e)),
u AS (SELECT * FROM e UNION ALL SELECT * FROM f) SELECT name, p_partkey, exact FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_partkey) <= 20""")
def symbol_lookup(t) -> DataFrame:
    p = t("part").select("p_partkey", "p_name")
    asked = p.select(F.explode(F.array("p_name", F.expr("substr(p_name, 1, length(p_name) - 1)"), F.expr("substr(p_name, 2, 3)"))).alias("name"))
    return lookup.symbol_search(p, asked, "p_partkey", "p_name", 20)


_SYMBOLS = "SELECT DISTINCT regexp_extract(text, '[a-z]{4,}') AS symbol FROM benchmark WHERE regexp_matches(text, '[a-z]{4,}')"


def _chunks(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), _path().alias("file_path"), F.col("lang").alias("symbol_name"), F.col("text").alias("content"))


def _symbols(t, name: str) -> DataFrame:
    return t("benchmark").select(F.regexp_extract("text", "[a-z]{4,}", 0).alias(name)).where(f"{name} <> ''").distinct()


@query(f"""WITH q AS ({_SYMBOLS}), h AS (SELECT symbol, doc_id AS id, {_P} AS file_path FROM documents JOIN q ON contains(text, symbol)) SELECT symbol, id, file_path FROM h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY id) <= 50""")
def find_references(t) -> DataFrame:
    return lookup.find_references(_chunks(t), _symbols(t, "symbol"), 50).select("symbol", "id", "file_path")


_CODE = r"""regexp_replace(regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', '', 'g'), '(?m)(^|[^:''"`\\])//.*$', '\1', 'g'), '(?m)^[ \t]*#([^!\n].*)?$', '', 'g')"""
_PAGES = "SELECT page_id AS id, 'src/' || (page_id % 40) || '.html.ts' AS file_path, html AS content FROM pages"


@query(f"""WITH q AS (SELECT DISTINCT regexp_extract(html, 'track[(][0-9]+[)]') AS term FROM pages UNION SELECT DISTINCT regexp_extract(html, 'charset="[a-z]+') FROM pages UNION SELECT '</p>'), c AS (SELECT id, file_path, content, {_CODE} AS code FROM ({_PAGES})),
h AS (SELECT term, file_path, count(*) AS chunks, max(regexp_matches(content, '\\(\\s*[''"`]' || regexp_escape(term) || '(?:\\s[^''"`]*)?[''"`]')) AS registered FROM c JOIN q ON term <> '' AND contains(code, term) GROUP BY ALL), r AS (SELECT *, count(*) OVER (PARTITION BY term) <= 4 AS rare FROM h)
SELECT term, file_path, chunks, registered, rare, (rare OR registered) AND row_number() OVER (PARTITION BY term ORDER BY rare OR registered DESC, registered DESC, chunks DESC, file_path) <= 2 AS exact FROM r""")
def identifier_occurrences(t) -> DataFrame:
    p = t("pages")
    chunks = p.select(F.col("page_id").alias("id"), F.expr("'src/' || (page_id % 40) || '.html.ts'").alias("file_path"), F.col("html").alias("content"))
    terms = p.select(F.explode(F.array(F.regexp_extract("html", "track[(][0-9]+[)]", 0), F.regexp_extract("html", 'charset="[a-z]+', 0), F.lit("</p>"))).alias("term"))
    return lookup.occurrences(chunks, terms)


@query(f"""WITH f AS (SELECT DISTINCT {FILE} AS p FROM part), n AS (SELECT DISTINCT regexp_extract(p, '[^/]*$') AS name FROM f UNION SELECT DISTINCT regexp_extract(p, '[^/]+/[^/]*$') FROM f WHERE contains(p, '/')),
s AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '')) || 's' AS stem FROM f), z AS (SELECT DISTINCT split_part(regexp_extract(p, '[^/]*$'), '.', 1) AS stem FROM f), o AS (SELECT p, CASE WHEN length(lower(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', ''))) > 1 THEN regexp_replace(lower(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '')), 's$', '') ELSE lower(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '')) END AS one FROM f)
SELECT 'named' AS kind, name AS asked, p AS file_path FROM n JOIN f ON p = name OR ends_with(p, '/' || name)
UNION ALL SELECT 'stem', stem, p FROM s JOIN o ON one = CASE WHEN length(stem) > 1 THEN regexp_replace(stem, 's$', '') ELSE stem END
UNION ALL SELECT 'exact', p, p FROM f WHERE starts_with(p, 'src/') AND NOT starts_with(p, 'src/small')
UNION ALL SELECT * FROM (SELECT 'test', stem, p FROM z JOIN f ON lower(regexp_extract(regexp_extract(p, '[^/]*$'), '(?i)^(.+)\\.(?:test|spec)\\.[^.]+$', 1)) = lower(stem) AND stem <> '' QUALIFY row_number() OVER (PARTITION BY stem ORDER BY p) <= 4)""")
def file_lookups(t) -> DataFrame:
    own = files(t).select("file_path").distinct()
    base, path = P.basename(F.col("file_path")), F.col("file_path")
    names = own.select(base.alias("name")).unionByName(own.where(path.contains("/")).select(F.regexp_extract(path, "[^/]+/[^/]*$", 0).alias("name")))
    stems = own.select(F.concat(P.stem_of(path), F.lit("s")).alias("stem"))
    wanted = own.where(path.startswith("src/")).unionByName(files(t).select("file_path").where(path.startswith("src/")))
    row = lambda df, kind, asked: df.select(F.lit(kind).alias("kind"), F.col(asked).alias("asked"), "file_path")
    exact = lookup.without_prefixes(lookup.files_exact(own, wanted), ["src/small"])
    tests = lookup.tests_of_stem(own, own.select(F.substring_index(base, ".", 1).alias("stem")))
    return row(lookup.files_named(own, names), "named", "name").unionByName(row(lookup.files_with_stem(own, stems), "stem", "stem")).unionByName(row(exact, "exact", "file_path")).unionByName(row(tests, "test", "stem"))


@query("""WITH l AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) || '.ts' AS file_path, sha256(CAST(l_partkey AS VARCHAR)) AS file_hash, l_orderkey AS seq FROM lineitem) SELECT file_path, arg_max(file_hash, (seq, file_hash)) AS file_hash, count(*) AS chunks FROM l GROUP BY file_path""")
def file_manifest(t) -> DataFrame:
    rows = t("lineitem").select(F.concat((F.col("l_orderkey") % 50).cast("string"), F.lit(".ts")).alias("file_path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("file_hash"), F.col("l_orderkey").alias("seq"))
    return lookup.file_manifest(rows, "seq").join(rows.groupBy("file_path").agg(F.count("*").alias("chunks")), "file_path")


@query(f"SELECT DISTINCT {FILE} AS file_path FROM part")
def distinct_paths(t) -> DataFrame:
    return lookup.distinct_paths(files(t))


_DOCS = f"SELECT {_P} AS file_path, text AS content FROM documents"
_REQUESTS = "SELECT conv_id AS call_id, turn AS nth, (conv_id * 31 + turn * 7) % (SELECT count(*) FROM documents) AS doc, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 2 END AS start_line, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn * 5 + 40 END AS end_line FROM conversations"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_P} AS file_path, string_split(text, chr(10)) AS lines FROM documents), q AS (SELECT call_id, nth, coalesce(file_path, 'gone.ts') AS file_path, start_line AS s, end_line AS e, len(lines) AS total, lines, row_number() OVER (PARTITION BY call_id ORDER BY nth) AS i FROM ({_REQUESTS}) r LEFT JOIN d ON d.doc_id = r.doc AND r.nth % 5 <> 4),
w AS (SELECT *, coalesce(s, 1) <= total AS fine, greatest(1, coalesce(s, 1)) AS a, least(total, coalesce(e, total)) AS b FROM q),
x AS (SELECT call_id, 0 AS i, CAST(60 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z FROM (SELECT DISTINCT call_id FROM q) UNION ALL
SELECT w.call_id, w.i, CASE WHEN fine THEN x.rest - greatest(0, least(w.b, w.a + least(25, x.rest) - 1) - w.a + 1) ELSE x.rest END, w.a, CASE WHEN fine THEN least(w.b, w.a + least(25, x.rest) - 1) ELSE 0 END FROM x JOIN w ON w.call_id = x.call_id AND w.i = x.i + 1)
SELECT w.call_id, w.nth, w.file_path, CASE WHEN fine THEN w.a WHEN total IS NULL THEN 1 ELSE s END AS start_line, CASE WHEN fine THEN x.z WHEN total IS NULL THEN 0 ELSE greatest(s, coalesce(e, total)) END AS end_line, CASE WHEN fine THEN CAST(total AS BIGINT) ELSE 0 END AS total_lines,
CASE WHEN fine THEN greatest(0, w.b - greatest(x.z, w.a - 1)) ELSE 0 END AS omitted_lines, CASE WHEN fine AND x.z >= w.a THEN array_to_string(w.lines[w.a : x.z], chr(10)) ELSE '' END AS content FROM w JOIN x USING (call_id, i)""")
def batched_ranges(t) -> DataFrame:
    docs = t("documents").select(_path().alias("file_path"), F.col("text").alias("content"), "doc_id")
    n = t("documents").agg(F.count("*").alias("n"))
    asked = t("conversations").join(F.broadcast(n), F.lit(True)).select(F.col("conv_id").alias("call_id"), F.col("turn").alias("nth"), F.expr("(conv_id * 31 + turn * 7) % n").alias("doc_id"), F.expr("CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 2 END").alias("start_line"), F.expr("CASE WHEN turn % 4 = 0 THEN NULL ELSE turn * 5 + 40 END").alias("end_line"))
    named = asked.join(docs.select("doc_id", "file_path").where("doc_id IS NOT NULL"), "doc_id", "left").withColumn("file_path", F.when(F.expr("nth % 5 <> 4"), F.coalesce("file_path", F.lit("gone.ts"))).otherwise("gone.ts"))
    return lookup.read_ranges(docs.drop("doc_id"), named.select("call_id", "nth", "file_path", "start_line", "end_line"), 25, 60).drop("error")


@query(f"""WITH f AS (SELECT DISTINCT ON (file_path) {UNIT} AS file_path, c_custkey AS id, CAST(1000 + floor(c_custkey / 3) AS INT) AS num, lower(c_mktsegment) AS dir FROM customer ORDER BY file_path, c_custkey), i AS (SELECT file_path AS src_file, id, num, dir, spec FROM f, (VALUES ('sib'), ('js'), ('up'), ('far'), ('web')) v(spec) WHERE ends_with(file_path, '.ts')),
t AS (SELECT src_file, spec, CASE spec WHEN 'sib' THEN ['src/' || dir || '/unit_' || (num + 1) || '.ts'] WHEN 'js' THEN ['src/' || dir || '/unit_' || (num + 2) || '.ts'] WHEN 'up' THEN ['src/building/unit_' || num || '.ts', 'src/building/unit_' || num || '.json'] ELSE [] END AS targets, id FROM i)
SELECT t.id AS seed, src_file, f.file_path AS dst_file FROM (SELECT id, src_file, unnest(targets) AS target FROM t) t JOIN f ON f.file_path = target GROUP BY ALL""")
def import_expand(t) -> DataFrame:
    own = units(t).groupBy("file_path").agg(F.min("c_custkey").alias("id"))
    num, folder = F.regexp_extract("file_path", r"unit_(\d+)", 1).cast("int"), F.regexp_extract("file_path", "src/([^/]+)/", 1)
    name = lambda k, e: F.concat(F.lit("./unit_"), (num + k).cast("string"), F.lit(e))
    up = F.array(F.concat(F.lit("../building/unit_"), num.cast("string")), F.concat(F.lit("../building/unit_"), num.cast("string"), F.lit(".json")))
    specs = F.when(F.col("file_path").endswith(".ts"), F.concat(F.array(name(1, ""), name(2, ".js")), up, F.array(F.lit("../../../out"), F.lit("https://x.y/z")))).otherwise(F.array().cast("array<string>"))
    chunks = own.select("id", "file_path", specs.alias("imports"), folder.alias("_d")).drop("_d")
    reached = expand.along_imports(chunks.select(F.col("id").alias("query_id"), "id"), chunks)
    return reached.select(F.col("query_id").alias("seed"), "src_file", "dst_file").distinct()


@query(f"""WITH f AS (SELECT DISTINCT p_partkey AS id, {FILE} AS file_path FROM part), e AS (SELECT id, file_path, lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')) AS stem FROM f), x AS (SELECT id, file_path, lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '(?i)^(.+)\\.(?:test|spec)\\.[^.]+$', 1)) AS stem FROM f),
h AS (SELECT stem, id, file_path FROM x WHERE stem <> '' QUALIFY row_number() OVER (PARTITION BY stem ORDER BY id) <= 4) SELECT e.id AS query_id, e.file_path AS src_file, h.id, h.file_path AS dst_file FROM e JOIN h USING (stem) WHERE e.id % 10 = 0""")
def test_expand(t) -> DataFrame:
    chunks = files(t).select(F.col("p_partkey").alias("id"), "file_path")
    return expand.along_tests(chunks.where("id % 10 = 0").select(F.col("id").alias("query_id"), "id"), chunks).select("query_id", "src_file", "id", "dst_file")


@query(f"""WITH f AS (SELECT p_partkey AS id, {FILE} AS file_path FROM part), c AS (SELECT * FROM f WHERE regexp_matches(lower(regexp_extract(file_path, '[^/]*$')), '\\.config\\.(ts|js|mjs)$|^\\..*rc(\\.json)?$') ORDER BY id LIMIT 8) SELECT item_id AS query_id, id, file_path AS dst_file FROM benchmark, c""")
def config_expand(t) -> DataFrame:
    return expand.configurations(t("benchmark").select(F.col("item_id").alias("query_id")), files(t).select(F.col("p_partkey").alias("id"), "file_path")).select("query_id", "id", "dst_file")


@query("""WITH o AS (SELECT DISTINCT 'd' || doc_id % 700 || '/' || source AS p FROM documents), n AS (SELECT DISTINCT 'd' || doc_id % 900 || '/' || source AS p FROM documents WHERE doc_id % 4 <> 1)
SELECT p, 'gone' AS side FROM (SELECT p FROM o EXCEPT SELECT p FROM n) UNION ALL SELECT p, 'new' FROM (SELECT p FROM n EXCEPT SELECT p FROM o) UNION ALL SELECT p, 'both' FROM (SELECT p FROM o INTERSECT SELECT p FROM n)""")
def path_sets(t) -> DataFrame:
    d = t("documents")
    old, new = d.select(F.expr("'d' || doc_id % 700 || '/' || source").alias("p")).distinct(), d.where("doc_id % 4 <> 1").select(F.expr("'d' || doc_id % 900 || '/' || source").alias("p")).distinct()
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(old.exceptAll(new), "gone").unionByName(side(new.exceptAll(old), "new")).unionByName(side(old.intersect(new), "both"))


@query(f"""WITH r AS (SELECT item_id, text, list_sort(list_distinct({_SPLIT.format("text")})) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS shared FROM r a JOIN r b ON a.item_id < b.item_id AND 10 * len(list_intersect(a.w, b.w)) >= 2 * len(list_distinct(a.w || b.w)) AND len(list_intersect(a.w, b.w)) > 0""")
def word_overlap(t) -> DataFrame:
    """Pairs of items that share a fifth of their words: pairs are counted by their shared words, never paired as such."""
    own = t("benchmark").select("item_id", F.array_distinct(W.split_words(F.col("text"))).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = own.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "word"), own.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "word")
    met = a.join(b, "word").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return met.where(10 * F.col("shared") >= 2 * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b", "shared")


@query("""WITH r AS (SELECT source AS query_id, doc_id AS id, floor(doc_id % 9) / 10 AS total, doc_id % 2 AS chan FROM documents) SELECT query_id, id, CAST(1.0 / (1 + row_number() OVER (PARTITION BY query_id, chan ORDER BY total DESC, id) - 1) AS DOUBLE) AS channel, CAST(1.0 / (1 + (row_number() OVER (PARTITION BY query_id, chan ORDER BY total DESC, id) - 1) / 3.0) AS DOUBLE) AS facet FROM r""")
def rank_decay(t) -> DataFrame:
    rows = t("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), (F.floor(F.expr("doc_id % 9")) / 10).alias("total"), F.expr("doc_id % 2").alias("chan"))
    n = F.row_number().over(Window.partitionBy("query_id", "chan").orderBy(F.desc("total"), "id")) - 1
    return rows.select("query_id", "id", (F.lit(1.0) / (1 + n)).alias("channel"), (F.lit(1.0) / (1 + n / 3)).alias("facet"))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), f AS (SELECT DISTINCT 'src/c' || conv_id || '.ts' AS file_path, conv_id, n FROM c)
SELECT file_path, 'C' || conv_id AS symbol_name, 'class' AS symbol_type, CAST(NULL AS VARCHAR) AS parent_symbol, 1 AS start_line, 1 AS end_line FROM f
UNION ALL SELECT 'src/c' || conv_id || '.ts', 't' || turn, 'method', 'C' || conv_id, CAST(i * 3 - 1 AS INT), CAST(i * 3 + 1 AS INT) FROM c UNION ALL SELECT file_path, NULL, 'block', 'C' || conv_id, CAST(n * 3 + 2 AS INT), CAST(n * 3 + 2 AS INT) FROM f
UNION ALL SELECT file_path, 'run' || conv_id, 'function', NULL, CAST(n * 3 + 4 AS INT), CAST(n * 3 + 7 AS INT) FROM f UNION ALL SELECT file_path, 'go-' || conv_id, 'command', NULL, CAST(n * 3 + 9 AS INT), CAST(n * 3 + 9 AS INT) FROM f""")
def structural_chunks(t) -> DataFrame:
    """Conversations written out as classes with a method a turn, a function and a registration."""
    from ..operators.structure import structural_chunks as chunked

    method = F.concat(F.lit("  t"), F.col("turn").cast("string"), F.lit("(x) {\n    use"), F.col("turn").cast("string"), F.lit("(x, '}');\n  }"))
    rows = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", method.alias("m")))), lambda x: x.m), "\n").alias("m"))
    name = F.col("conv_id").cast("string")
    body = F.concat(F.lit("export class C"), name, F.lit(" {\n"), "m", F.lit("\n}\n\n/** runs {it} */\nexport function run"), name, F.lit("(a) {\n  return new C"), name, F.lit("();\n}\n\nprogram.command('go-"), name, F.lit("', run);\n"))
    files_ = rows.select(F.concat(F.lit("src/c"), name, F.lit(".ts")).alias("file_path"), body.alias("content"))
    return chunked(files_).select("file_path", "symbol_name", "symbol_type", "parent_symbol", "start_line", "end_line")
