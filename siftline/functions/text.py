"""Column builders for hashes, tokens, words and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9_]{3,}"


def token_estimate(text) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def normalised(text) -> Column:
    """Line ends as LF, no blanks at the ends of lines, no white space around the whole."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def content_hash(text) -> Column:
    return F.sha2(normalised(text), 256)


def chunk_id(repo, path, parent, kind, name) -> Column:
    return F.sha2(F.concat_ws(":", repo, path, F.coalesce(parent, F.lit("")), kind, name), 256)


def chunk_name(kind, name, text, index) -> Column:
    """What names a chunk in its identity: its own name, else a hash for a block, else its position."""
    return F.coalesce(name, F.when(kind == "block", F.concat(F.lit("h:"), F.substring(content_hash(text), 1, 16))), F.concat(F.lit("#"), index.cast("string")))


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def round_at(x, digits: int) -> Column:
    """Half up in double arithmetic: floor(x * 10**digits + 0.5) / 10**digits."""
    scale = 10**digits
    return F.floor(x * scale + F.lit(0.5)) / scale


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fnv1a(word) -> Column:
    """32-bit FNV-1a over the characters' codes; the offset basis for an empty string."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def singular(word) -> Column:
    """Plurals to singulars as far as endings tell."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n < 3) | ~word.endswith("s"), word)
        .when(n == 3, F.when(word.rlike("(ss|us|is|os|as)$"), word).otherwise(cut(1)))
        .when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(sses|xes|ches|shes)$"), cut(2))
        .when(word.rlike("(ss|us|is|os)$"), word)
        .otherwise(cut(1))
    )


def stem(word) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return F.when((n > 5) & word.endswith("ing"), cut(3)).when((n > 4) & word.endswith("ed"), cut(2)).when((n > 4) & word.endswith("e"), cut(1)).otherwise(word)


def identifiers(text, limit: int = 40) -> Column:
    """The first distinct identifiers of a text, in order, without the keywords."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    found = F.array_distinct(F.filter(runs, lambda x: x.rlike("^[A-Za-z_]..")))
    return F.slice(F.array_except(found, F.array(*[F.lit(k) for k in KEYWORDS])), 1, limit)


#: Keywords that are no references.
KEYWORDS = "const let var function class return import export from if else for while new this async await true false null".split()
