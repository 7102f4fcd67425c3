"""Requests of several parts: facets, how well code covers each, what is still to be read, and how sure the answer is."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions.text import round_at
from ..functions.words import plain_content_words, word_set
from .intent import analyse_one, clauses_of, shape

#: When a request is split, how many parts it keeps, and what whole requests and anchors weigh.
SPLIT_WORDS, SPLIT_MARKS, MOST, WHOLE, ANCHOR, BROAD, LABEL = 12, 2, 10, 0.5, 0.5, 4, 160
#: Strengths of covered and weak facets, the weight that may be weak, and the factor of prose and tests.
COVERED, WEAK, WEAK_ALLOWED, ASIDE = 0.6, 0.35, 0.15, 0.55
#: Chunks, tokens, chunks a file and chunks a symbol by mode; multi and broad are routes of the normal mode.
MODES = {"minimal": (5, 5000, 2, 1), "normal": (8, 8000, 2, 2), "deep": (24, 25000, 6, 4), "multi": (12, 8000, 2, 2), "broad": (16, 8000, 2, 2)}


#: Words of tasks that change code.
CHANGES = "add|fix|implement|update|refactor|change|bug|endpoint|api|function|class|test"


def _kind(anchor: str, files: list[str]) -> str:
    if anchor.startswith("--"):
        return "flag"
    if shape(anchor) == "env":
        return "env"
    if anchor in files:
        return "file"
    return "command" if re.fullmatch(r"[a-z][a-z0-9]*(-[a-z0-9]+)+", anchor) else "symbol"


def _segments(task: str) -> list[str]:
    """The parts of a request; unlike clauses they are also cut at list marks, and a comma needs a space after it."""
    kept = re.sub(r",(?=\S)", "\1", re.sub(r"\s[-*•]\s", "\n", task))
    out = []
    for part in clauses_of(kept):
        part = re.sub(r"^(?:and|or|also|then|plus)\s+", "", part.replace("\1", ",").strip(" \t\r\n,.;:()").rstrip("?,.;:() "), flags=re.I)
        if part:
            out.append(part)
    return out


def plan_one(task: str | None) -> dict:
    """route and facets (facet_id, kind, label, terms, anchors, weight, embed_text, auxiliary) of a request.

    Short requests and those of one part are focused: one facet. Otherwise every part is a facet; one that says too little
    joins the part before it, one that says the same as an earlier facet is folded into that. The heaviest MOST stay, and
    the request as a whole is an auxiliary facet beside them. Weights add up to 1.
    """
    task = task or ""
    found = analyse_one(task)
    known = list(dict.fromkeys([*found["exact_terms"], *found["symbols"], *found["files"]]))
    terms = plain_content_words(task)
    anchors = lambda text: [a for a in known if a in text]
    whole = {"facet_id": "f0", "kind": "concept", "label": task.strip()[:LABEL], "terms": terms, "anchors": anchors(task), "weight": 1.0, "embed_text": task, "auxiliary": False}
    marks = len(re.findall(r"[,;\n]|\s(?:and|or)(?=\s)", task, re.I))
    drafts: list[dict] = []
    if len(terms) >= SPLIT_WORDS or marks >= SPLIT_MARKS:
        parts: list[str] = []
        for part in _segments(task):
            if parts and len(plain_content_words(part)) < 2 and not anchors(part):
                parts[-1] += f" {part}"
            else:
                parts.append(part)
        parts = [p for p in parts if plain_content_words(p) or anchors(p)]
        for part in parts if len(parts) > 1 else ():
            own, held = plain_content_words(part), anchors(part)
            alike = next((d for d in drafts if own and d["terms"] and 2 * len(set(own) & set(d["terms"])) >= len(set(own) | set(d["terms"])) and set(held) <= set(d["anchors"])), None)
            if alike:
                alike["terms"] = list(dict.fromkeys(alike["terms"] + own))
                alike["label"] = f"{alike['label']}; {part}"[:LABEL]
            else:
                drafts.append({"kind": _kind(held[0], found["files"]) if held else "concept", "label": part[:LABEL], "terms": own, "anchors": held, "embed_text": part if part == parts[0] else f"{parts[0]}: {part}", "auxiliary": False})
    heavy = sorted(range(len(drafts)), key=lambda i: (-len(drafts[i]["anchors"]), i))[:MOST]
    kept = [drafts[i] for i in sorted(heavy)]
    if len(kept) < 2:
        return {"route": "focused", "facets": [whole]}
    raw = [1 + ANCHOR * len(f["anchors"]) for f in kept]
    extra = WHOLE * sum(raw) / len(raw)
    facets = [{**f, "facet_id": f"f{i}", "weight": r / (sum(raw) + extra)} for i, (f, r) in enumerate(zip(kept, raw, strict=True))]
    facets.append({**whole, "facet_id": "task", "label": "whole request", "weight": extra / (sum(raw) + extra), "auxiliary": True})
    return {"route": "broad" if len(kept) >= BROAD else "multi", "facets": facets}


_FACET = "facet_id:string,kind:string,label:string,terms:array<string>,anchors:array<string>,weight:double,embed_text:string,auxiliary:boolean"


def plan(queries: DataFrame) -> DataFrame:
    """query_id, route, nth and the fields of every facet of queries(query_id, text)."""

    @F.pandas_udf(f"route string, facets array<struct<{_FACET}>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plan_one(t) for t in texts], columns=["route", "facets"])

    return queries.select("query_id", run("text").alias("p")).select("query_id", F.col("p.route").alias("route"), F.posexplode("p.facets").alias("nth", "f")).select("query_id", "route", "nth", "f.*")


def limits(mode: Column, route: Column) -> Column:
    """chunks, tokens, per_file and per_symbol of a mode; the normal mode gives way to the route of a request of several parts."""
    key = F.when((mode != "normal") | (route == "focused"), mode).otherwise(route)
    table = F.create_map(*[x for k, v in MODES.items() for x in (F.lit(k), F.struct(*[F.lit(n).alias(c) for c, n in zip(("chunks", "tokens", "per_file", "per_symbol"), v, strict=True)]))])
    return F.element_at(table, key)


def anchored(symbol, literals, path, content, anchors) -> Column:
    """Whether a chunk has one of the anchors: as its symbol, a literal, its file, or, if long and marked enough, in its text."""
    leaf = F.substring_index(symbol, ".", -1)
    return F.exists(anchors, lambda a: F.coalesce(leaf == a, F.lit(False)) | F.array_contains(F.coalesce(literals, F.array().cast("array<string>")), a) | (path == a) | path.endswith(F.concat(F.lit("/"), a)) | ((F.length(a) >= 6) & a.rlike("[-_.A-Z]") & content.contains(a)))


def relevance(candidates: DataFrame, facets: DataFrame, rankings: DataFrame | None = None) -> DataFrame:
    """(query_id, facet_id, id, relevance) for every candidate(query_id, id, file, symbol, content, literals, is_test,
    wants_docs, wants_tests) and facet(query_id, facet_id, terms, anchors) of the same query.

    An anchor counts in full; otherwise half is the share of the facet's words that the chunk has, each weighted by how
    rare it is among the query's candidates, and half its place in the facet's own ranking(query_id, facet_id, id, rank).
    Prose and tests count ASIDE unless they are wanted.
    """
    pool = candidates.groupBy("query_id").agg(F.greatest(F.count("*"), F.lit(1)).alias("pool"))
    wanted = facets.select("query_id", "facet_id", F.explode(F.array_distinct("terms")).alias("term"))
    words = candidates.select("query_id", "id", F.explode(word_set(F.col("file"), F.col("symbol"), F.col("content"))).alias("term")).join(wanted.select("query_id", "term").distinct(), ["query_id", "term"])
    df = words.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    idf = wanted.join(df, ["query_id", "term"], "left").join(pool, "query_id").withColumn("idf", F.log(1 + F.col("pool") / (F.coalesce("df", F.lit(0)) + 1)))
    idf = idf.withColumn("total", F.sum("idf").over(Window.partitionBy("query_id", "facet_id"))).select("query_id", "facet_id", "term", "idf", "total")
    lexical = words.join(idf, ["query_id", "term"]).groupBy("query_id", "facet_id", "id").agg((F.sum("idf") / F.max("total")).alias("lexical"))
    factor = F.when(P.is_doc(F.col("file")) & ~F.col("wants_docs"), ASIDE).when((F.col("is_test") | P.is_test(F.col("file"))) & ~F.col("wants_tests"), ASIDE).otherwise(1.0)
    pairs = candidates.join(facets.select("query_id", "facet_id", "anchors"), "query_id").select("query_id", "facet_id", "id", factor.alias("factor"), anchored(F.col("symbol"), F.col("literals"), F.col("file"), F.col("content"), F.col("anchors")).alias("hit"))
    out = pairs.join(lexical, ["query_id", "facet_id", "id"], "left")
    ranked = F.lit(0.0)
    if rankings is not None:
        out = out.join(rankings.select("query_id", "facet_id", "id", "rank"), ["query_id", "facet_id", "id"], "left")
        ranked = F.coalesce(1 / (1 + F.col("rank") / 3), F.lit(0.0))
    return out.select("query_id", "facet_id", "id", (F.col("factor") * F.when(F.col("hit"), 1.0).otherwise(0.5 * F.coalesce("lexical", F.lit(0.0)) + 0.5 * ranked)).alias("relevance"))


def report(selected: DataFrame, facets: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, facet_id, label, kind, weight, status, strength and the three best pieces of evidence of every facet that is
    not auxiliary, from selected(query_id, id, file, start_line, end_line, position) and relevance() of them."""
    own = facets.where(~F.col("auxiliary")).select("query_id", "facet_id", "label", "kind", "weight")
    near = selected.join(found.where(F.col("relevance") >= WEAK), ["query_id", "id"])
    nth = F.row_number().over(Window.partitionBy("query_id", "facet_id").orderBy(F.desc("relevance"), "position"))
    piece = F.struct(F.col("_nth"), F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("ref"))
    best = near.withColumn("_nth", nth).where("_nth <= 3").groupBy("query_id", "facet_id").agg(F.max("relevance").alias("best"), F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.ref).alias("evidence"))
    strength = F.coalesce("best", F.lit(0.0))
    status = F.when(strength >= COVERED, "covered").when(strength >= WEAK, "weak").otherwise("missing")
    return own.join(best, ["query_id", "facet_id"], "left").select("query_id", "facet_id", "label", "kind", "weight", status.alias("status"), round_at(strength, 2).alias("strength"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def completeness(reported: DataFrame, stale: Column | None = None) -> DataFrame:
    """query_id, complete, score and reason: the weighted share of the request that is covered; 0.2 from a stale index."""
    status, weight = F.col("status"), F.col("weight")
    labels = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(status == s, F.struct("facet_id", "label")))), lambda x: x.label), "; ")
    per = reported.groupBy("query_id").agg(
        F.count("*").alias("parts"), F.count(F.when(status == "covered", 1)).alias("covered"), F.count(F.when(status == "missing", 1)).alias("missing"), F.coalesce(F.sum(F.when(status == "weak", weight)), F.lit(0.0)).alias("weak"),
        round_at(F.sum(weight * F.least(F.lit(1.0), F.col("strength"))) / F.sum(weight), 2).alias("score"), labels("missing").alias("_missing"), labels("weak").alias("_weak"),
    )
    complete = (F.col("missing") == 0) & (F.col("weak") <= WEAK_ALLOWED)
    told = lambda name, text: F.when(F.col(name) != "", F.concat(F.lit(f". {text}: "), F.col(name))).otherwise("")
    partly = F.concat(F.lit("Covers "), F.col("covered").cast("string"), F.lit(" of "), F.col("parts").cast("string"), F.lit(" parts"), told("_missing", "missing"), told("_weak", "partial"), F.lit("."))
    reason = F.when(complete, F.concat(F.lit("Covers all "), F.col("parts").cast("string"), F.lit(" parts of the request."))).otherwise(partly)
    old = F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(False)
    return per.select("query_id", "parts", "covered", complete.alias("complete"), F.when(old, 0.2).otherwise(F.col("score")).alias("score"), F.when(old, "The index is older than the working tree.").otherwise(reason).alias("reason"))


def confidence(top_total, top_path, query, threshold: float = 0.15, stale=None) -> Column:
    """How sure a focused reply is: 0.2 from a stale index, 0 without a hit, just under the threshold where prose answers a
    change of code, else the best total."""
    change = F.lower(query).rlike(rf"\b({CHANGES})\b")
    old = F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(False)
    return F.when(old, 0.2).when(top_total.isNull(), 0.0).when(change & P.is_doc(top_path), F.least(top_total, F.lit(max(0.0, threshold - 0.01)))).otherwise(top_total)


def follow_ups(candidates: DataFrame, selected: DataFrame, reported: DataFrame, found: DataFrame, per_facet: int = 2, most: int = 8) -> DataFrame:
    """(query_id, position, facet_id, label, id, file, start_line, end_line, tokens): the best chunks left out for every
    facet that is not covered, each used once and none that overlaps what was sent; a query's pool is bounded."""
    kind, id_kind = (candidates.schema[c].dataType.simpleString() for c in ("query_id", "id"))
    columns = ["query_id", "position", "facet_id", "label", "id", "file", "start_line", "end_line", "tokens"]
    sent = selected.groupBy("query_id").agg(F.collect_list(F.struct("id", "file", "start_line", "end_line")).alias("sent"))
    rows = candidates.select("query_id", "id", "file", "start_line", "end_line", "total", "tokens").join(found, ["query_id", "id"]).join(reported.where("status <> 'covered'").select("query_id", "facet_id", "label", "strength"), ["query_id", "facet_id"])
    rows = rows.where((F.col("relevance") > F.col("strength")) & (F.col("relevance") >= WEAK)).join(sent, "query_id", "left")

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        shipped = [] if pool.sent.iloc[0] is None else [dict(x.asDict() if hasattr(x, "asDict") else x) for x in pool.sent.iloc[0]]
        used, out = {x["id"] for x in shipped}, []

        def overlaps(r) -> bool:
            return any(x["file"] == r.file and min(r.end_line, x["end_line"]) - max(r.start_line, x["start_line"]) + 1 >= 0.5 * (min(r.end_line - r.start_line, x["end_line"] - x["start_line"]) + 1) for x in shipped)

        for _, own in sorted(pool.groupby("facet_id"), key=lambda x: int(x[0].lstrip("f") or 0) if x[0].lstrip("f").isdigit() else 1 << 30):
            ranked = own.sort_values(["relevance", "total", "file", "start_line", "id"], ascending=[False, False, True, True, True])
            fit = [r for r in ranked.itertuples(index=False) if r.id not in used and not overlaps(r)][:per_facet]
            used |= {r.id for r in fit}
            out += fit
        return pd.DataFrame([(r.query_id, i + 1, r.facet_id, r.label, r.id, r.file, r.start_line, r.end_line, r.tokens) for i, r in enumerate(out[:most])], columns=columns)

    return rows.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, position int, facet_id string, label string, id {id_kind}, file string, start_line long, end_line long, tokens long")


def next_calls(reported: DataFrame, complete: DataFrame, reads: DataFrame, most: int = 3, ranges: int = 8) -> DataFrame:
    """(query_id, nth, tool, args, tokens) for requests that are not complete: one read of the follow-ups' ranges, then a
    search for every missing facet without one."""
    open_ = complete.where(~F.col("complete")).select("query_id")
    ref = F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    first = reads.where(F.col("position") <= ranges).join(open_, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", ref.alias("ref")))).alias("r"), (F.sum("tokens") + 20 * F.count("*")).alias("tokens"))
    first = first.select("query_id", F.lit(0).alias("_o"), F.lit("f").alias("facet_id"), F.lit("get_file_context").alias("tool"), F.to_json(F.struct(F.transform("r", lambda x: x.ref).alias("ranges"))).alias("args"), F.col("tokens").cast("long").alias("tokens"))
    missing = reported.where("status = 'missing'").join(open_, "query_id").join(reads.select("query_id", "facet_id").distinct(), ["query_id", "facet_id"], "left_anti")
    search = missing.select("query_id", F.lit(1).alias("_o"), "facet_id", F.lit("search_codebase").alias("tool"), F.to_json(F.struct(F.col("label").alias("query"), F.lit(3).alias("limit"))).alias("args"), F.lit(600).cast("long").alias("tokens"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("_o", F.length("facet_id"), "facet_id"))
    return first.unionByName(search).withColumn("nth", nth).where(F.col("nth") <= most).select("query_id", "nth", "tool", "args", "tokens")


def as_call(tool: str, args: str) -> str:
    """One call as a line of a reply."""
    return f"{tool} {json.dumps(json.loads(args), separators=(',', ':'), ensure_ascii=False)}"
