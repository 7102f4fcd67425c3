"""What a query names: scores of paths and symbols, and the floors of exact matches."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import clamp01, round_at, token_estimate
from ..functions.words import short_singular, stem_words
from .search import combined

#: File names that name a role, so that a query with that word does not ask for them.
GENERIC_STEMS = frozenset("app base common config constant core data default file helper index init lib main mod model setup shared spec test type util".split())
#: Words of a query that no path is scored by.
PATH_STOP = frozenset("add and does find fix how implemented implementation into the update where with".split())
#: Symbol types that define something.
DECLARATIONS = frozenset("function class method interface type enum namespace".split())
#: Floors of exact symbols, file names and files named by their words; the factor of tests nobody asked for.
SYMBOL_FLOOR, FILE_FLOOR, WORDS_FLOOR, TEST_FACTOR = 0.95, 0.90, 0.80, 0.85

#: What a query says before and after a word that it means as code, and beside one that it means as a command.
BEFORE_CODE = "where is|where's|find|locate|definition of|implementation of|function|method|class|symbol"
AFTER_CODE = "defined|implemented|declared|function|method|class"
RUNNERS, COMMAND_NOUNS = "npm run|npx|yarn|pnpm", "command|subcommand|tool"
#: Words of tasks that ask for tests, and of those that ask how something works.
TEST_WORDS, EXPLAINING = "test|tests|spec|coverage", "how|why|explain|overview|architecture|design|concepts?|works?"

_DATA = re.compile(r"\.(json|jsonc|ya?ml|toml|ini|xml|csv|lock|env)$")


def _pieces(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()) if p]


def _one(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


class Asked:
    """A query laid out so that names can be sought in it: its words end to end, and where each begins and ends."""

    def __init__(self, text: str):
        self.low = text.lower()
        found = list(re.finditer(r"[a-z0-9]+", self.low))
        self.joined = "".join(m[0] for m in found)
        self.gaps = [self.low[a.end() : b.start()] for a, b in zip(found, found[1:], strict=False)]
        self.ends, n = [0], 0
        for m in found:
            n += len(m[0])
            self.ends.append(n)
        alone = (t.strip("./-") for t in re.split(r"[^a-z0-9_./-]+", self.low))
        self.alone = {_one(w) for t in alone if t and not re.search(r"[_./]", t) for w in t.split("-") if w}
        self.parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text).lower()) if len(p) >= 3 and p not in PATH_STOP]
        self.tests = bool(re.search(rf"\b({TEST_WORDS})\b", self.low, re.A))

    def runs(self, compact: str):
        """(first, last) word of every place where consecutive words spell the name."""
        at = self.joined.find(compact)
        while compact and at >= 0:
            a, b = bisect_left(self.ends, at), bisect_left(self.ends, at + len(compact))
            if b < len(self.ends) and self.ends[a] == at and self.ends[b] == at + len(compact):
                yield a, b - 1
            at = self.joined.find(compact, at + 1)

    def spells(self, symbol: str) -> str | None:
        """literal where the query writes the symbol as code, joined where its words merely add up to it."""
        compact = re.sub(r"[^a-z0-9]", "", symbol.lower())
        for a, b in self.runs(compact) if len(compact) >= 3 else ():
            return "literal" if all(g in ("_", "-") for g in self.gaps[a:b]) else "joined"
        return None

    def has(self, pattern: str) -> bool:
        return bool(re.search(pattern, self.low, re.A))

    def as_code(self, word: str) -> bool:
        """Whether the query quotes the word, calls it, or asks where it is defined."""
        w = re.escape(word)
        before, after = rf"\b(?:{BEFORE_CODE})\s+{w}\b", rf"\b{w}\s+(?:is\s+)?(?:{AFTER_CODE})\b"
        return f"`{word}`" in self.low or f"{word}(" in self.low or self.has(f"{before}|{after}")

    def as_command(self, name: str) -> bool:
        """Whether the query names a registered command: a compound as a whole token, a plain word only beside what runs it."""
        w = re.escape(name)
        if "-" in name or "_" in name:
            return self.has(rf"(?<![a-z0-9_-]){w}(?![a-z0-9_-])")
        return f"`{name}`" in self.low or self.has(rf"\b(?:{RUNNERS}|{COMMAND_NOUNS})\s+{w}\b|\b{w}\s+(?:{COMMAND_NOUNS})\b")


@lru_cache(maxsize=4096)
def asked(text: str | None) -> Asked:
    return Asked(text or "")


def file_named(path: str, query: Asked, specific: frozenset[str] = frozenset()) -> float:
    """1 where the query has the file's full name or spells its name of several words; WORDS_FLOOR where it has all words
    of the name apart. Generic names and data files are not named by words; a name of one word only if it is specific to
    this file or the query has one of its folders too."""
    *folders, name = path.replace("\\", "/").split("/")
    if "." in name and len(name) >= 4 and query.has(rf"(?<![a-z0-9_-]){re.escape(name.lower())}(?![a-z0-9_-])"):
        return 1.0
    words = _pieces(re.sub(r"\.[^.]+$", "", name))
    if len(words) > 1 and len("".join(words)) >= 6 and any(True for _ in query.runs("".join(words))):
        return 1.0
    single = [_one(w) for w in words]
    if _DATA.search(name.lower()) or all(w in GENERIC_STEMS for w in single) or (len(words) == 1 and len(words[0]) < 4) or not query.alone.issuperset(single):
        return 0.0
    if len(words) > 1 or single[0] in specific:
        return WORDS_FLOOR
    around = {_one(w) for f in folders for w in _pieces(f) if len(w) >= 2 and w != "src"} - GENERIC_STEMS
    return WORDS_FLOOR if around & query.alone else 0.0


def path_score(path: str, query: Asked, specific: frozenset[str] = frozenset()) -> float:
    """1 for a file that the query names, else the share of the query's words that the path holds."""
    if file_named(path, query, specific):
        return 1.0
    low = path.lower().replace("\\", "/")
    return sum(p in low for p in query.parts) / len(query.parts) if query.parts else 0.0


def symbol_score(symbol: str | None, parent: str | None, kind: str | None, path: str | None, query: Asked) -> float:
    """1 for a symbol that the query writes as code or asks for, 0.5 where its words only add up to it or its parent is
    spelled; test titles never count."""
    if kind == "test":
        return 0.0
    how = query.spells(symbol) if symbol else None
    if not how:
        return 0.5 if parent and query.spells(parent) else 0.0
    if kind == "command":
        return 1.0 if query.as_command(symbol.lower()) else 0.5
    in_test = bool(path and re.search(r"\.test\.|\.spec\.|_test\.|/__tests__/|/tests/|/test/[^/]*$", path.lower()))
    defines = kind is None or kind in DECLARATIONS
    compound = bool(re.search(r"[_\-\d]|[a-z][A-Z]|[A-Z][a-z]+[A-Z]", symbol))
    code = query.as_code(symbol.lower())
    sure = code if in_test else (compound or code)
    return 1.0 if sure and (how == "literal" or (defines and not in_test)) else 0.5


def _names(path: pd.Series, symbol: pd.Series, parent: pd.Series, kind: pd.Series, query: pd.Series, specific: pd.Series) -> pd.DataFrame:
    rows = []
    for p, s, c, k, q, w in zip(path, symbol, parent, kind, query, specific, strict=True):
        own, only = asked(q), frozenset(w if w is not None else ())
        rows.append((file_named(p or "", own, only), path_score(p or "", own, only), symbol_score(s, c, k, p, own)))
    return pd.DataFrame(rows, columns=["named", "path", "symbol"])


def naming(*columns: str) -> Column:
    """file_named(), path_score() and symbol_score() as named, path and symbol, of the columns path, symbol, parent, kind, query and
    specific, the words that name the file alone."""
    return F.pandas_udf(_names, "named double, path double, symbol double")(*columns)


def specific_words(files: DataFrame) -> DataFrame:
    """(file_path, words): for code files the words of their names, of four letters or more, that no other code file's name has."""
    from ..functions.words import GENERIC_PATH

    words = files.where(P.is_code(F.col("file_path"))).select("file_path").distinct().select("file_path", F.explode(stem_words(F.col("file_path"))).alias("word")).where((F.length("word") >= 4) & ~F.col("word").isin(GENERIC_PATH))
    alone = words.groupBy("word").agg(F.count("*").alias("n"), F.first("file_path").alias("file_path")).where("n = 1")
    return alone.groupBy("file_path").agg(F.array_sort(F.collect_list("word")).alias("words"))


def path_hits(files: DataFrame, terms: DataFrame, stems: int = 3, folders: int = 2) -> DataFrame:
    """(query_id, file_path, term, specificity) of terms(query_id, term): code files whose name has the term, if at most
    `stems` have, or else whose folders have, if at most `folders` do. The specificity is 1 / files; a file keeps its most
    specific term, of equal ones the first in the alphabet."""
    from ..functions.words import GENERIC_PATH, dir_words

    code = files.where(P.is_code(F.col("file_path"))).select("file_path").distinct()
    own = code.select("file_path", stem_words(F.col("file_path")).alias("s"), dir_words(F.col("file_path")).alias("d"))
    words = own.select("file_path", F.explode("s").alias("word"), F.lit("stem").alias("kind")).unionByName(own.select("file_path", F.explode(F.array_except("d", "s")).alias("word"), F.lit("dir").alias("kind")))
    wanted = terms.select("query_id", F.lower("term").alias("term")).distinct().withColumn("word", short_singular(F.col("term"))).where((F.length("word") >= 3) & ~F.col("word").isin(GENERIC_PATH))
    few = words.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word", "kind").agg(F.count("*").alias("n"))
    by_stem = few.where(F.col("kind") == "stem")
    usable = by_stem.where(F.col("n") <= stems).unionByName(few.where((F.col("kind") == "dir") & (F.col("n") <= folders)).join(by_stem.select("word"), "word", "left_anti").select(*few.columns))
    hits = words.join(usable, ["word", "kind"]).join(wanted, "word")
    best = F.min(F.struct(F.col("n"), F.col("term"))).alias("b")
    return hits.groupBy("query_id", "file_path").agg(best).select("query_id", "file_path", F.col("b.term").alias("term"), (F.lit(1.0) / F.col("b.n")).alias("specificity"))


def prose_weight(query) -> Column:
    """1 for tasks about documentation, 0.85 for those that ask how something works, else 0.7."""
    low = F.lower(query)
    return F.when(P.is_doc_task(query), 1.0).when(low.rlike(rf"\b({EXPLAINING})\b"), 0.85).otherwise(0.7)


def structural(symbol, parent) -> Column:
    return F.when(symbol.isNotNull() & parent.isNotNull(), 1.0).when(symbol.isNotNull(), 0.7).when(parent.isNotNull(), 0.4).otherwise(0.0)


def recency(indexed_at, now) -> Column:
    """1 for what was indexed now, falling to 0 within a week; 0 for no or no valid time."""
    age = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(indexed_at))
    return F.when(age.isNull(), 0.0).otherwise(clamp01(1 - F.greatest(F.lit(0), age) / (7 * 86_400_000_000.0)))


def scored(rows: DataFrame, now=None) -> DataFrame:
    """rows(query_id, query, id, file_path, symbol_name, parent_symbol, symbol_type, content, last_indexed_at, specific, and
    the signals semantic, keyword, dependency, reference, path_hint, exact_identifier; all but the first four nullable) with
    the nine signals, exact_floor, total, tokens and reason.

    Exact symbols, identifiers and file names lift the total to a floor; prose and tests nobody asked for are scaled down
    and cannot be exact symbols.
    """
    now = F.current_timestamp() if now is None else now
    named = rows.withColumn("_n", naming("file_path", "symbol_name", "parent_symbol", "symbol_type", "query", "specific"))
    path = F.col("file_path")
    test, doc = P.is_test(path), P.is_doc(path)
    wants = F.lower("query").rlike(rf"\b({TEST_WORDS})\b")
    signals = {
        "semantic": clamp01(F.coalesce("semantic", F.lit(0.0))), "keyword": clamp01(F.coalesce("keyword", F.lit(0.0))), "symbol": F.col("_n.symbol"), "path": clamp01(F.coalesce("path_hint", "_n.path")),
        "structural": structural(F.col("symbol_name"), F.col("parent_symbol")), "dependency": clamp01(F.coalesce("dependency", F.lit(0.0))), "reference": clamp01(F.coalesce("reference", F.lit(0.0))),
        "test": F.when(test & wants, 1.0).otherwise(0.0), "recency": recency(F.col("last_indexed_at"), now),
    }
    weight = F.when(doc, prose_weight(F.col("query"))).when(test & ~wants, TEST_FACTOR).otherwise(1.0)
    out = named.select(*rows.columns, F.col("_n.named").alias("_named"), weight.alias("_w"), *[c.alias(f"s_{k}") for k, c in signals.items()])
    symbol = (F.col("s_symbol") == 1) & (F.col("_w") == 1)
    identifier = F.coalesce("exact_identifier", F.lit(False)) & (F.col("_w") == 1)
    file = (F.coalesce("path_hint", F.lit(0.0)) == 1) | (F.col("_named") == 1)
    by_words = ~doc & (F.col("_named") == WORDS_FLOOR)
    floor = F.when(symbol, SYMBOL_FLOOR).when(identifier, F.lit(0.82) + 0.13 * F.col("s_keyword")).when(file, FILE_FLOOR).when(by_words, WORDS_FLOOR).otherwise(0.0)
    reason = F.when(symbol, F.concat(F.lit("exact symbol match: "), "symbol_name")).when(identifier, "exact identifier").when(file, F.concat(F.lit("exact file match: "), "file_path")).when(by_words, F.concat(F.lit("file named in query: "), "file_path")).otherwise("weighted signals")
    total = combined({k: F.col(f"s_{k}") for k in signals}, F.when(file, 1.0).otherwise(F.col("_w")), floor)
    return out.select(*rows.columns, *[F.col(f"s_{k}") for k in signals], round_at(floor, 3).alias("exact_floor"), total.alias("total"), token_estimate(F.col("content")).alias("tokens"), reason.alias("reason"))
