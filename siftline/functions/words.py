"""Words of prose and identifiers, as columns and as plain functions that agree with them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import singular, stem

#: Prose words that name no code.
PROSE_STOP = (
    "a an the and or but nor for with without from into onto of to in on at by as is are was were be been being it its this that these "
    "those there their them they we you your our my me i he she his her how what when where which who why whether does do did done doing can "
    "could should would will shall may might must has have had not no yes if then else than so such also too very just only any all each every "
    "some other another more most less least about after before between through during over under again here versus vs via per like please explain describe "
    "show tell find happen happens work works working make makes use uses used using get gets set sets add fix update change handle handles handled handling "
    "cope copes thing things way ways new old same different implemented implementation implement code file files function functions part parts"
).split()

#: Path words that name a role, not a feature.
GENERIC_PATH = (
    "src lib dist build test tests unit integration spec fixtures index type types util utils main app common shared core base helper helpers "
    "internal pkg cmd mod docs doc example examples"
).split()

_STOP = frozenset(PROSE_STOP)
_RAW = re.compile(r"[A-Za-z][A-Za-z0-9]*", re.A)
_ACRONYM = re.compile(r"[A-Z]{2,}s")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_TAIL = re.compile(r"([A-Z]+)([A-Z][a-z])")


def plain_singular(word: str) -> str:
    """singular() of a plain string: fixed endings, no dictionary."""
    n = len(word)
    if n < 3 or not word.endswith("s"):
        return word
    if n == 3:
        return word if word[1] in "suioa" else word[:2]
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("sses", "xes", "ches", "shes")):
        return word[:-2]
    return word if word[-2] in "suio" else word[:-1]


def plain_stem(word: str) -> str:
    for ending, least in (("ing", 5), ("ed", 4), ("e", 4)):
        if word.endswith(ending) and len(word) > least:
            return word[: -len(ending)]
    return word


def plain_words(text: str | None) -> list[str]:
    """words_of() of a plain string."""
    out: list[str] = []
    for raw in _RAW.findall(text or ""):
        if _ACRONYM.fullmatch(raw):
            out.append(raw[:-1].lower())
            continue
        parts = _TAIL.sub(r"\1 \2", _HUMP.sub(" ", raw)).lower().split()
        out += [plain_stem(plain_singular(p)) for p in parts]
        if len(parts) > 1:
            out.append(raw.lower())
    return out


def plain_content_words(text: str | None) -> list[str]:
    """content_words() of a plain string."""
    stopped = {plain_stem(plain_singular(w)) for w in re.findall(r"[a-z]+", (text or "").lower(), re.A) if w in _STOP}
    return [w for w in dict.fromkeys(plain_words(text)) if len(w) >= 2 and w not in _STOP and w not in stopped]


def normal(word) -> Column:
    return stem(singular(word))


def words_of(text) -> Column:
    """Lower-case words of a text, identifiers split at humps, singular and stemmed; a split identifier also whole."""
    raws = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RAW.pattern), F.lit(0))

    def own(raw):
        humps = F.regexp_replace(F.regexp_replace(raw, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
        parts = F.filter(F.split(F.lower(humps), " "), lambda p: p != "")
        words = F.transform(parts, normal)
        whole = F.when(F.size(parts) > 1, F.array(F.lower(raw))).otherwise(F.array().cast("array<string>"))
        return F.when(raw.rlike("^[A-Z]{2,}s$"), F.array(F.lower(F.substring(raw, F.lit(1), F.length(raw) - 1)))).otherwise(F.concat(words, whole))

    return F.flatten(F.transform(raws, own))


def content_words(text) -> Column:
    """Distinct words_of() of two letters or more that are no prose stop words, nor endings of such that the text has."""
    stop = F.array(*[F.lit(w) for w in PROSE_STOP])
    raw = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    stopped = F.transform(F.array_intersect(raw, stop), normal)
    found = F.filter(F.array_distinct(words_of(text)), lambda w: F.length(w) >= 2)
    return F.array_except(F.array_except(found, stop), stopped)


def word_set(path, symbol, content) -> Column:
    """Every word that a chunk offers: of its path without the extension, its symbol and its text."""
    return F.array_distinct(F.concat(words_of(F.regexp_replace(path, r"\.[^./]+$", "")), words_of(symbol), words_of(content)))


def short_singular(word) -> Column:
    """Path words lose a final s if they have more than three letters."""
    return F.when(F.length(word) > 3, F.regexp_replace(word, "s$", "")).otherwise(word)


def split_words(name) -> Column:
    """Lower-case pieces of a name, cut at humps and at all that is no letter or digit."""
    humps = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda p: p != "")


def stem_words(path) -> Column:
    """Distinct singular words of a file's name without its extension."""
    return F.array_distinct(F.transform(split_words(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")), short_singular))


def dir_words(path) -> Column:
    """Distinct singular words of the folders of a path."""
    folders = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return F.array_distinct(F.transform(split_words(folders), short_singular))


def term_match(path, term) -> Column:
    """stem or dir, where the term is a word of the file name or else of a folder; null for short and generic terms."""
    wanted = short_singular(F.lower(term))
    usable = (F.length(wanted) >= 3) & ~wanted.isin(GENERIC_PATH)
    return F.when(usable & F.array_contains(stem_words(path), wanted), "stem").when(usable & F.array_contains(dir_words(path), wanted), "dir")


def strip_comments(code) -> Column:
    """Code without block comments, // comments (not after a colon, a quote or a backslash) and lines that begin with #, but not #!."""
    blocks = F.regexp_replace(code, r"(?s)/\*.*?\*/", "")
    lines = F.regexp_replace(blocks, r"""(?m)(^|[^:'"`\\])//.*$""", "$1")
    return F.regexp_replace(lines, r"(?m)^[ \t]*#(?!!).*$", "")


def quoted(value) -> Column:
    """A value as a literal within a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def registers(code, term) -> Column:
    """Whether the code calls something with the term, or a string that begins with that word, as its first argument."""
    return F.regexp_like(code, F.concat(F.lit(r"""\(\s*['"`]"""), quoted(term), F.lit(r"""(?:\s[^'"`]*)?['"`]""")))


def like_literal(value) -> Column:
    """A value whose %, _ and \\ stand for themselves in a LIKE pattern with ESCAPE '\\'."""
    return F.regexp_replace(value, r"([%_\\])", r"\\$1")


def truncated(label, most: int = 70) -> Column:
    """A label of at most so many characters, the last of which tells that it was cut."""
    return F.when(F.length(label) > most, F.concat(F.rtrim(F.substring(label, 1, most - 1)), F.lit("…"))).otherwise(label)


def grouped_number(value) -> Column:
    return F.format_number(value, 0)


def range_ref(ref) -> Column:
    """file, start_line and end_line of "file", "file:line" or "file:first-last"; the last is not before the first."""
    text = F.trim(ref)
    part = lambda n: F.regexp_extract(text, r"(?s)^(.*?):(\d+)(?:-(\d+))?$", n)
    has = text.rlike(r"(?s)^.*?:\d+(-\d+)?$")
    start = F.when(has, part(2).cast("long"))
    end = F.when(has, F.greatest(start, F.when(part(3) != "", part(3).cast("long")).otherwise(start)))
    return F.struct(F.when(has, part(1)).otherwise(text).alias("file"), start.alias("start_line"), end.alias("end_line"))


def bytes_text(n) -> Column:
    """A number of bytes for people: B, KB, MB and so on, one digit after the point above bytes."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", (n / 1024**power).cast("double"))).otherwise(out)
    return out


def dollars(value) -> Column:
    """An amount with two digits, three below a dollar, four below a cent."""
    shown = lambda d: F.format_string(f"$%.{d}f", value.cast("double"))
    return F.when(value >= 1, shown(2)).when(value >= 0.01, shown(3)).otherwise(shown(4))


def repo_id(path) -> Column:
    """The first 16 digits of the hash of a path without its final slashes."""
    return F.substring(F.sha2(F.regexp_replace(path, "(?<=.)/+$", ""), 256), 1, 16)
