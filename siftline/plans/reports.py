"""Queries of usage, savings, registry, upkeep and policy, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_at
from ..operators import policy, registry, usage
from ..streaming import ledger, upkeep
from .catalogue import query

_LOG = "SELECT user_id % 10 AS repo, CASE event_type WHEN 'click' THEN 'mcp_retrieval' WHEN 'error' THEN 'denied_scan' ELSE event_type END AS kind, CAST(floor(value * 10) AS BIGINT) AS resultTokens, CAST(40 * (user_id % 30) AS BIGINT) AS baselineTokens FROM events"


def _log(t) -> DataFrame:
    return t("events").select(F.expr("user_id % 10").alias("repo"), F.expr("CASE event_type WHEN 'click' THEN 'mcp_retrieval' WHEN 'error' THEN 'denied_scan' ELSE event_type END").alias("kind"), F.floor(F.col("value") * 10).cast("long").alias("resultTokens"), F.expr("CAST(40 * (user_id % 30) AS BIGINT)").alias("baselineTokens"))


@query(f"""WITH e AS ({_LOG}), p AS (SELECT repo, count(*) FILTER (kind = 'mcp_retrieval') AS retrievals, count(*) FILTER (kind = 'denied_scan') AS denied, CAST(coalesce(sum(resultTokens) FILTER (kind = 'mcp_retrieval'), 0) AS BIGINT) AS result_tokens, CAST(coalesce(sum(baselineTokens) FILTER (kind = 'mcp_retrieval'), 0) AS BIGINT) AS baseline_tokens FROM e GROUP BY repo),
s AS (SELECT *, greatest(0, baseline_tokens - result_tokens) AS saved FROM p) SELECT *, saved * 15 AS saved_over_turns, floor(saved / 1e6 * 3e0 * 1000000 + 5e-1) / 1000000 AS usd, floor(saved * 15 / 1e6 * 3e0 * 1000000 + 5e-1) / 1000000 AS usd_over_turns FROM s""")
def usage_summary(t) -> DataFrame:
    return usage.summary(_log(t), ["repo"])


@query("""WITH r AS (SELECT c_nationkey % 40 AS repo, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE count(*) END AS files FROM customer GROUP BY 1, c_nationkey), m AS (SELECT s_nationkey AS repo, s_suppkey * 100 AS naive FROM supplier WHERE s_nationkey % 2 = 0),
o AS (SELECT repo, CAST(floor(avg(naive) + 5e-1) AS BIGINT) AS own FROM m GROUP BY repo) SELECT r.repo, coalesce(own, (SELECT CAST(floor(avg(naive) + 5e-1) AS BIGINT) FROM m)) AS measured, CAST(least(15000, 400 + 12 * coalesce(files, 120)) + least(70000, 2000 + 80 * coalesce(files, 120)) + least(8000, 200 + 8 * coalesce(files, 120)) AS BIGINT) AS guessed FROM r LEFT JOIN o USING (repo)""")
def baseline_cascade(t) -> DataFrame:
    repos = t("customer").groupBy(F.expr("c_nationkey % 40").alias("repo"), "c_nationkey").agg(F.count("*").alias("n")).select("repo", F.when(F.expr("c_nationkey % 3 <> 0"), F.col("n")).alias("files"))
    measured = t("supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("repo"), (F.col("s_suppkey") * 100).alias("naive_tokens"))
    guessed = usage.baseline(repos, measured.limit(0)).withColumnRenamed("baseline", "guessed")
    return usage.baseline(repos, measured).withColumnRenamed("baseline", "measured").join(guessed, "repo")


_MARK = "regexp_extract(text, '[a-z]{5,}')"


@query(rf"""WITH f AS (SELECT 'd' || doc_id || '.txt' AS p, text FROM documents), l AS (SELECT count(*) AS files_listed, CAST(ceil(sum(length(p) + 1) / 4.0) AS BIGINT) AS list_tokens FROM f), k AS (SELECT item_id AS query_id, {_MARK} AS keyword FROM benchmark WHERE {_MARK} <> ''),
m AS (SELECT keyword, p, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, string_split(text, chr(10)) AS lines FROM f JOIN (SELECT DISTINCT keyword FROM k) ON contains(text, keyword)), h AS (SELECT keyword, p, i FROM (SELECT keyword, p, lines, unnest(range(1, len(lines) + 1)) AS i FROM m) WHERE contains(lines[i], keyword) QUALIFY row_number() OVER (PARTITION BY keyword, p ORDER BY i) <= 200),
n AS (SELECT DISTINCT keyword, p, unnest(range(i - 2, i + 3)) AS i FROM h), d AS (SELECT keyword, sum(length(lines[i]) + length(p) + length(CAST(i AS VARCHAR)) + 3) AS chars FROM n JOIN m USING (keyword, p) WHERE i BETWEEN 1 AND len(lines) GROUP BY keyword),
r AS (SELECT keyword, count(*) AS matching_files, CAST(sum(CASE WHEN nth <= 12 THEN tokens ELSE 0 END) AS BIGINT) AS read_tokens FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY p) AS nth FROM m) GROUP BY keyword)
SELECT query_id, files_listed, coalesce(matching_files, 0) AS matching_files, list_tokens, CAST(coalesce(ceil(chars / 4.0), 0) AS BIGINT) AS dump_tokens, coalesce(read_tokens, 0) AS read_tokens FROM k LEFT JOIN r USING (keyword) LEFT JOIN d USING (keyword), l""")
def scan_cost(t) -> DataFrame:
    files = t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract("text", "[a-z]{5,}", 0).alias("keyword")).where("keyword <> ''")
    return usage.scan_cost(files, asked).drop("naive_tokens")


@query("""WITH s AS (SELECT o_orderkey AS q, CAST(floor(o_totalprice) AS BIGINT) AS naive, o_custkey * 17 AS own FROM orders) SELECT q AS query_id, naive AS naive_tokens, own AS search_tokens, greatest(0, naive - own) AS saved, CASE WHEN naive > 0 THEN floor(1000 * greatest(0, naive - own) / naive + 5e-1) / 10 ELSE 0e0 END AS pct_saved FROM s""")
def savings_ab(t) -> DataFrame:
    o = t("orders")
    scanned = o.select(F.col("o_orderkey").alias("query_id"), F.floor("o_totalprice").cast("long").alias("naive_tokens"))
    return usage.savings(scanned, o.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") * 17).alias("search_tokens")))


@query("""SELECT o_orderstatus AS suite, count(*) AS tasks, floor(avg(o_totalprice) * 10000 + 5e-1) / 10000 AS mean_cost, floor(avg(CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 7) / 7e0 END) * 10000 + 5e-1) / 10000 AS mean_facets, floor(quantile_cont(o_totalprice / 1e3, 0.5) * 10000 + 5e-1) / 10000 AS median_ratio,
CAST(quantile_disc(o_custkey, 0.5) AS DOUBLE) AS p50_latency, CAST(quantile_disc(o_custkey, 0.95) AS DOUBLE) AS p95_latency, CAST(quantile_disc(o_custkey, 0.99) AS DOUBLE) AS p99_latency FROM orders GROUP BY 1""")
def benchmark_rollup(t) -> DataFrame:
    rows = t("orders").select(F.col("o_orderstatus").alias("suite"), F.col("o_totalprice").alias("cost"), F.when(F.expr("o_custkey % 3 > 0"), F.expr("o_custkey % 7") / 7).alias("facets"), (F.col("o_totalprice") / 1e3).alias("ratio"), F.col("o_custkey").alias("latency"))
    return usage.benchmark(rows, ["cost", "facets"], ["ratio"], ["latency"], ["suite"])


_REPO = "SELECT 'r' || c_custkey AS id, '/work/' || lower(c_mktsegment) || '/' || (c_custkey % 40) || CASE WHEN c_custkey % 4 = 0 THEN '/sub' || c_custkey ELSE '' END AS path, 'n' || c_custkey % 300 AS name, c_custkey AS files FROM customer"


def _entries(t, where: str, name: str, files: str) -> DataFrame:
    c = t("customer").where(where)
    path = F.expr("'/work/' || lower(c_mktsegment) || '/' || (c_custkey % 40) || CASE WHEN c_custkey % 4 = 0 THEN '/sub' || c_custkey ELSE '' END")
    null = F.lit(None).cast("string")
    return c.select(F.expr("'r' || c_custkey").alias("id"), path.alias("path"), F.expr(name).alias("name"), null.alias("last_indexed_at"), F.expr(f"CAST({files} AS BIGINT)").alias("files_indexed"), F.lit(1).cast("long").alias("chunks_indexed"), null.alias("embedding_model"))


@query("""WITH r AS (SELECT 'r' || c_custkey AS id, '/work/' || lower(c_mktsegment) || '/' || (c_custkey % 40) || CASE WHEN c_custkey % 4 = 0 THEN '/sub' || c_custkey ELSE '' END AS path, c_custkey AS k FROM customer), a AS (SELECT id, path, 'n' || k % 300 AS name, k AS files FROM r WHERE k % 3 <> 0), s AS (SELECT id, CASE WHEN k % 7 = 0 THEN NULL ELSE path END AS path, 'm' || k % 300 AS name, k * 2 AS files FROM r WHERE k % 2 = 0)
SELECT id, coalesce(s.path, a.path) AS path, coalesce(s.name, a.name, id) AS name, CAST(CASE WHEN s.files IS NOT NULL THEN s.files ELSE a.files END AS BIGINT) AS files_indexed FROM s FULL JOIN a USING (id) WHERE coalesce(s.path, a.path, '') <> ''""")
def registry_listing(t) -> DataFrame:
    known = _entries(t, "c_custkey % 3 <> 0", "'n' || c_custkey % 300", "c_custkey")
    states = _entries(t, "c_custkey % 2 = 0", "'m' || c_custkey % 300", "c_custkey * 2")
    states = states.withColumn("path", F.when(F.expr("CAST(substr(id, 2) AS INT) % 7 <> 0"), F.col("path")))
    return registry.listing(known, states).select("id", "path", "name", "files_indexed")


@query(f"""WITH r AS ({_REPO}), q AS (SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'r' || s_suppkey WHEN 1 THEN 'N' || s_suppkey * 3 WHEN 2 THEN '/work/building/' || s_suppkey % 40 || '/' WHEN 3 THEN 'building/' || s_suppkey % 50 ELSE 'sub' || s_suppkey * 2 END AS ref FROM supplier),
w AS (SELECT ref, id, '' AS name, 1 AS way FROM q JOIN r ON ref = id UNION ALL SELECT ref, min(id), '', 2 FROM q JOIN r ON lower(ref) = lower(name) GROUP BY ref HAVING count(*) = 1
UNION ALL SELECT ref, id, name, 3 FROM q JOIN r ON path = regexp_replace(CASE WHEN starts_with(ref, '/') THEN ref ELSE '/work/' || ref END, '/+$', '') UNION ALL SELECT ref, id, name, 5 FROM q JOIN r ON ends_with(path, '/' || ref))
SELECT ref, arg_min(id, (way, name, id)) AS id FROM w GROUP BY ref""")
def repo_resolution(t) -> DataFrame:
    refs = t("supplier").select(F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'r' || s_suppkey WHEN 1 THEN 'N' || s_suppkey * 3 WHEN 2 THEN '/work/building/' || s_suppkey % 40 || '/' WHEN 3 THEN 'building/' || s_suppkey % 50 ELSE 'sub' || s_suppkey * 2 END").alias("ref"))
    return registry.resolved(_entries(t, "true", "'n' || c_custkey % 300", "c_custkey"), refs, "/work").select("ref", "id")


@query(f"""WITH r AS (SELECT DISTINCT path AS repo FROM ({_REPO})), q AS (SELECT DISTINCT '/work/' || lower(c_mktsegment) || '/' || (c_custkey % 50) || '/sub' || (c_custkey % 90) || '/x' AS path FROM customer)
SELECT path, arg_max(repo, length(repo)) AS repo FROM q JOIN r ON path = repo OR starts_with(path, repo || '/') GROUP BY path""")
def containing_repo(t) -> DataFrame:
    repos = _entries(t, "true", "'n'", "1").select("path").distinct()
    paths = t("customer").select(F.expr("'/work/' || lower(c_mktsegment) || '/' || (c_custkey % 50) || '/sub' || (c_custkey % 90) || '/x'").alias("path"))
    return registry.containing_repo(repos, paths)


@query("""WITH f AS (SELECT DISTINCT user_id % 5 AS repo_id, 'a' || event_id % 7 || '/b' || event_id % 31 || '/f' || event_id AS path FROM events), a AS (SELECT user_id % 5 AS repo_id, 'a' || event_id % 7 || '/b' || event_id % 31 || '/f' || event_id AS path, CASE WHEN event_id % 2 = 0 THEN 'upsert' ELSE 'delete' END AS action FROM events WHERE event_id % 11 = 0),
d AS (SELECT 1 AS repo_id, 'a1' AS folder, 'upsert' AS action UNION ALL SELECT 2, 'a2/b3', 'delete' UNION ALL SELECT 3, 'a4/', 'delete'), u AS (SELECT *, 0 AS n FROM a UNION ALL SELECT f.repo_id, path, d.action, CASE d.action WHEN 'upsert' THEN 1 ELSE 2 END FROM f JOIN d ON d.repo_id = f.repo_id AND starts_with(path, rtrim(folder, '/') || '/'))
SELECT repo_id, path, arg_min(action, n) AS action FROM u GROUP BY ALL""")
def folder_events(t) -> DataFrame:
    e = t("events")
    every = e.select(F.expr("user_id % 5").alias("repo_id"), F.expr("'a' || event_id % 7 || '/b' || event_id % 31 || '/f' || event_id").alias("path"), "event_id")
    actions = every.where("event_id % 11 = 0").select("repo_id", "path", F.expr("CASE WHEN event_id % 2 = 0 THEN 'upsert' ELSE 'delete' END").alias("action"))
    folders = e.sparkSession.createDataFrame([(1, "a1", "upsert"), (2, "a2/b3", "delete"), (3, "a4/", "delete")], "repo_id long, path string, action string")
    return upkeep.with_folders(actions, folders, every.select("repo_id", "path"), every.select("repo_id", "path"))


def _state(stale):
    return F.when(stale.isNull(), "unknown").when(stale, "stale").otherwise("fresh")


@query("""WITH m AS (SELECT user_id % 60 AS repo_id, count(*) AS files, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS fp FROM events WHERE user_id % 60 <> 7 GROUP BY 1), s AS (SELECT user_id % 60 AS repo_id, count(*) + CASE WHEN user_id % 60 % 4 = 0 THEN 1 ELSE 0 END AS files, CASE WHEN user_id % 60 % 5 = 0 THEN NULL WHEN user_id % 60 % 6 = 1 THEN 'other' ELSE sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) END AS fp FROM events WHERE user_id % 60 <> 9 GROUP BY 1)
SELECT repo_id, CASE WHEN s.files IS NULL THEN 'unknown' WHEN coalesce(m.files, 0) <> s.files OR (s.fp IS NOT NULL AND m.fp IS DISTINCT FROM s.fp) THEN 'stale' ELSE 'fresh' END AS state FROM s FULL JOIN m USING (repo_id)""")
def staleness(t) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    own = t("events").groupBy(F.expr("user_id % 60").alias("repo_id")).agg(F.count("*").alias("files"), F.sha2(ids, 256).alias("fingerprint"))
    fingerprint = F.when(F.expr("repo_id % 5 = 0"), None).when(F.expr("repo_id % 6 = 1"), "other").otherwise(F.col("fingerprint"))
    states = own.where("repo_id <> 9").select("repo_id", (F.col("files") + F.expr("IF(repo_id % 4 = 0, 1, 0)")).alias("files"), fingerprint.alias("fingerprint"))
    return upkeep.staleness(own.where("repo_id <> 7"), states).select("repo_id", _state(F.col("stale")).alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN (event_id % 7 = 0) OR 1000 * (user_id % 12) > 5000 AND event_id % 3 > 0 THEN 'stale' ELSE 'fresh' END AS state FROM events""")
def watched_staleness(t) -> DataFrame:
    since = F.when(F.expr("event_id % 3 > 0"), 100_000 - 1000 * F.expr("user_id % 12"))
    return t("events").select("event_id", _state(upkeep.watched_staleness(F.expr("event_id % 5 <> 0"), F.expr("event_id % 7 = 0"), since, F.lit(100_000))).alias("state"))


_ASK = {
    "event": "CASE WHEN event_id % 13 = 0 THEN 'subagentStart' END", "tool": "CASE event_id % 5 WHEN 0 THEN 'Grep' WHEN 1 THEN 'Glob' WHEN 2 THEN 'Task' WHEN 3 THEN 'Read' END", "subagent": "CASE event_id % 17 WHEN 0 THEN 'explore' WHEN 1 THEN 'build' END",
    "cwd": "CASE WHEN event_id % 3 = 0 THEN '/w/a' END", "path": "CASE user_id % 6 WHEN 0 THEN '/w/a/' WHEN 1 THEN '/w/a/src' WHEN 2 THEN '/w/a/x.ts' WHEN 3 THEN '.' ELSE '' END", "directory": "CASE user_id % 4 WHEN 0 THEN '/w/b' WHEN 1 THEN '/w/a/src' END",
    "pattern": "CASE user_id % 5 WHEN 0 THEN '**/*.ts' WHEN 1 THEN '*.md' WHEN 2 THEN '*' END", "prompt": "CASE user_id % 7 WHEN 0 THEN 'Find where it is' WHEN 1 THEN 'exploring' ELSE 'write it' END",
}


@query(f"""WITH q AS (SELECT event_id, {", ".join(f"{v} AS {k}" for k, v in _ASK.items())} FROM events), z AS (SELECT *, list_filter(['/w/b', cwd], lambda x: x IS NOT NULL) AS roots, CASE WHEN coalesce(path, '') <> '' THEN path ELSE coalesce(directory, '') END AS target, coalesce(pattern, '') = '' OR contains(pattern, '**') OR pattern IN ('*', '*.*') AS broad FROM q)
SELECT event_id, CASE WHEN event = 'subagentStart' OR (subagent IS NOT NULL AND tool IS NULL) THEN coalesce(subagent, '') = 'explore' WHEN tool = 'Task' THEN regexp_matches(lower(prompt), '\\b(explor(e|ing)|search the (code|repo|codebase)|find where|how does)\\b') WHEN event_id % 11 = 0 AND tool IN ('Grep', 'Glob') THEN FALSE
WHEN tool = 'Grep' THEN NOT regexp_matches(target, '\\.[A-Za-z0-9]{{1,8}}$') AND (target = '' OR target = '.' OR list_contains(roots, regexp_replace(target, '/+$', ''))) WHEN tool = 'Glob' THEN broad AND (coalesce(directory, '') IN ('', '.') OR list_contains(roots, directory)) ELSE FALSE END AS denied FROM z""")
def tree_scan_policy(t) -> DataFrame:
    rows = t("events").select("event_id", *[F.expr(v).alias(k) for k, v in _ASK.items()], F.array(F.lit("/w/b")).alias("roots"), *[F.lit(None).cast("string").alias(c) for c in ("description", "task", "task_subagent")])
    return policy.denied(rows, F.expr("event_id % 11 = 0")).select("event_id", "denied")


@query("SELECT source AS repo, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY source")
def directory_size(t) -> DataFrame:
    return t("documents").groupBy(F.col("source").alias("repo")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files"))


@query("SELECT o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY 1")
def discard_reasons(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey AS file, l_partkey AS id, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS total FROM lineitem) SELECT file, max(total) AS best, count(*) AS chunks, string_agg(CAST(id AS VARCHAR) || '@' || CAST(n AS VARCHAR), ' ' ORDER BY total DESC, n, id) AS ids FROM c GROUP BY file""")
def chunks_by_file(t) -> DataFrame:
    rows = t("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "n", "id")))
    return rows.groupBy("file").agg(F.max("total").alias("best"), F.count("*").alias("chunks"), F.array_join(F.transform(ordered, lambda x: F.concat(x.id.cast("string"), F.lit("@"), x.n.cast("string"))), " ").alias("ids"))


@query("SELECT l_orderkey AS id, floor((l_extendedprice - l_discount * 1e4) / l_extendedprice * 100 * 10000 + 5e-1) / 10000 AS reduced FROM lineitem WHERE l_linenumber = 1")
def token_reduction(t) -> DataFrame:
    base, own = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double") * 1e4
    return t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), round_at(usage.reduction(base, own), 4).alias("reduced"))


@query("""WITH l AS (SELECT user_id AS ctx, max(ts) AS last_used FROM events GROUP BY 1) SELECT ctx, epoch_us(last_used) AS last_us FROM l WHERE epoch_ms((SELECT max(last_used) FROM l)) - epoch_ms(last_used) <= 200000000 ORDER BY last_used DESC, ctx LIMIT 64""")
def context_eviction(t) -> DataFrame:
    calls = t("events").select(F.col("user_id").alias("ctx"), F.col("ts").cast("timestamp").alias("used"))
    return ledger.live_contexts(calls, 64, 200_000_000).select("ctx", F.unix_micros("last_used").alias("last_us"))


@query("""WITH n AS (SELECT l_suppkey AS ctx, l_linenumber AS path, l_orderkey AS line_no, max(l_partkey % 3) AS hash FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 100 < 60 GROUP BY ALL), k AS (SELECT l_suppkey AS ctx, l_linenumber AS path, l_orderkey AS line_no, max(l_partkey % 3) AS hash FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY ALL),
c AS (SELECT ctx, path, line_no, coalesce(n.hash = k.hash, FALSE) AS seen FROM n LEFT JOIN k USING (ctx, path, line_no)), a AS (SELECT *, CASE WHEN lag(seen) OVER w IS NOT DISTINCT FROM seen THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY ctx, path ORDER BY line_no)), b AS (SELECT *, sum(s) OVER (PARTITION BY ctx, path ORDER BY line_no) AS g FROM a),
d AS (SELECT ctx, path, line_no, seen AND count(*) OVER (PARTITION BY ctx, path, g) >= 4 AS seen FROM b), e AS (SELECT *, CASE WHEN lag(seen) OVER w IS NOT DISTINCT FROM seen THEN 0 ELSE 1 END AS s FROM d WINDOW w AS (PARTITION BY ctx, path ORDER BY line_no)), f AS (SELECT *, sum(s) OVER (PARTITION BY ctx, path ORDER BY line_no) AS g FROM e)
SELECT ctx, path, min(line_no) AS lo, max(line_no) AS hi, seen FROM f GROUP BY ctx, path, g, seen""")
def ledger_runs(t) -> DataFrame:
    own = t("lineitem").groupBy(F.col("l_suppkey").alias("ctx"), F.col("l_linenumber").alias("path"), F.col("l_orderkey").alias("line_no")).agg(F.max(F.expr("l_partkey % 3")).alias("hash"))
    return ledger.classified(own.where("line_no % 2 = 0 OR line_no % 100 < 60"), own.where("line_no % 7 <> 0"), 4)
