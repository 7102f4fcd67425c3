"""Structural chunks of source code: Python by its syntax tree, other languages by a scanner that knows brackets, strings
and comments. Every non-blank line of a file is in a chunk."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import windows_of

FIXTURES = {
    "src/auth.py": "import os\n\n\nclass Auth:\n    def __init__(self):\n        self.user = None\n\n    def login(self, name):\n        self.user = name\n        return bool(name)\n\n\ndef logout(auth):\n    auth.user = None\n    return auth\n",
    "src/store.ts": "import { a } from './a';\n\nexport class Store {\n  get(key: string) {\n    return this.map[key]; // }\n  }\n}\n\nexport function open(path: string) {\n  const s = '}';\n  return new Store();\n}\n",
    "src/cli.ts": "import { program } from 'commander';\n\nconst app = make();\napp.get('/a', handler);\n\nprogram\n  .command('code-scan')\n  .action(() => {\n    run('--dry-run');\n  });\n\nexport const limits = {\n  low: 1,\n  high: 2,\n};\n\nfunction wide(x)\n{\n  return x;\n}\n",
    "src/cli.test.ts": "describe('the scanner', () => {\n  it('scans', () => {\n    expect(scan()).toBe(1);\n  });\n});\n",
    "bin/run.sh": "#!/bin/bash\nset -e\n\nbuild() {\n  make all\n}\n\nbuild \"$@\"\n",
    "pkg/main.go": "package main\n\nfunc (s *Store) Open(path string) error {\n\treturn nil\n}\n\ntype Store struct {\n\tpath string\n}\n",
    "docs/notes.txt": "one\ntwo\nthree\n",
}

#: Methods that register what their first string names, methods that do so with a handler, test functions.
REGISTRARS = frozenset("command addCommand registerTool registerResource registerPrompt tool resource prompt route add_parser add_command subcommand on handle task".split())
HTTP = frozenset("get post put patch delete all use head options".split())
TESTS = frozenset("describe it test suite context".split())
#: Most calls, literals and characters of a signature that are kept, least characters of a block of its own.
CALLS, LITERALS, SIGNATURE, LEAST, TITLE = 40, 20, 200, 24, 120
#: Extensions of languages with braces, and of shell scripts.
BRACES = re.compile(r"\.([cm]?[jt]sx?|go|java|rs|c|cc|cpp|cxx|h|hpp|cs|kt|kts|swift|php|css|scss)$", re.I)
SHELL = re.compile(r"\.(sh|bash|zsh)$", re.I)

_LEAD = r"^\s*(?:(?:export|default|async|abstract|declare|public|private|protected|internal|static|final|pub(?:\([^)]*\))?|unsafe|inline|virtual|override|sealed|readonly)\s+)*"
_DECLARES = re.compile(_LEAD + r"(function|class|interface|type|enum|namespace|module|func|fn|struct|trait|impl|record|protocol|object|def)\b\s*\*?\s*(?:\(\s*\w+\s+\*?(?P<owner>\w+)[^)]*\)\s*)?(?:<[^>]*>\s*)?(?P<name>[A-Za-z_$][\w$]*)?")
_KINDS = {"func": "function", "fn": "function", "def": "function", "struct": "class", "trait": "interface", "protocol": "interface", "record": "class", "object": "class", "impl": "class", "module": "namespace"}
_VARIABLE = re.compile(_LEAD + r"(?:const|let|var|val)\s+(?P<name>[A-Za-z_$][\w$]*)[^=\n]*=\s*(?P<value>[\s\S]*)")
_FUNCTION_VALUE = re.compile(r"(?:async\s+)?(?:function\b|func\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?=>|[A-Za-z_$][\w$]*\s*=>)")
_STRUCTURED = re.compile(r"[\[{`]|new\s|[A-Za-z_$][\w$.]*\s*(?:<[^>]*>)?\(")
_METHOD = re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:export|async|abstract|public|private|protected|internal|static|final|override|readonly|virtual|inline|fun|func|fn|def|get|set|suspend|unsafe|pub)\s+)*(?:[\w<>\[\],.?&*:]+\s+)??\*?\s*#?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\(")
_NOT_METHODS = frozenset("if for while switch catch return function new await typeof super this else do throw case".split())
_CALL = re.compile(r"([\w$.\])]*?)\.?\b([A-Za-z_$][\w$]*)\s*\(\s*(['\"`])((?:(?!\3)[^\\\n]|\\.)*)\3")
_LITERAL = re.compile(r"--?[a-z][\w-]*|[a-z][a-z0-9]*(?:[-_][a-z0-9]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|/[\w/:.-]+|[a-z]+[A-Z][A-Za-z0-9]*")
_STRING = re.compile(r"'((?:[^'\\\n]|\\.)*)'|\"((?:[^\"\\\n]|\\.)*)\"|`((?:[^`\\]|\\.)*)`")
_SHELL_FUNCTION = re.compile(r"^\s*(?:function\s+([\w:-]+)|([\w:-]+)\s*\(\s*\))")
_COMMENT = re.compile(r"^\s*(//|/\*|\*|#(?!!)|--\s)")


@dataclass(frozen=True)
class Unit:
    """Lines first to last (from 1) of something with or without a name."""

    first: int
    last: int
    name: str | None = None
    kind: str = "block"
    parent: str | None = None
    inner: tuple[tuple[int, int], ...] = field(default=(), compare=False)  # statements inside, for pieces that are too long
    defines: tuple[str, ...] = field(default=(), compare=False)


def depths(lines: list[str], hash_comments: bool = False) -> list[int]:
    """Bracket depth before every line and after the last; brackets in strings and comments are not counted."""
    depth, out, quote, block = 0, [], "", False
    for line in lines:
        out.append(depth)
        i = 0
        while i < len(line):
            c, two = line[i], line[i : i + 2]
            if block:
                block = two != "*/"
                i += 1 if block else 2
            elif quote:
                quote = "" if c == quote else quote
                i += 2 if c == "\\" else 1
            elif (two == "//" and not hash_comments) or (c == "#" and hash_comments and (not i or line[i - 1].isspace())):
                break
            elif two == "/*" and not hash_comments:
                block, i = True, i + 2
            else:
                if c in "'\"`":
                    quote = c
                depth += (c in "([{") - (c in ")]}")
                i += 1
        quote = quote if quote == "`" else ""
        depth = max(depth, 0)
    return [*out, depth]


def statements(lines: list[str], at: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """The statements of lines first to last (from 1) at the depth where they begin: each goes on until its brackets are
    closed, and while its line or the next one tells that it is not complete. Comment lines are none."""
    base, out, i = at[first - 1], [], first
    while i <= last:
        text = lines[i - 1].strip()
        if not text or (_COMMENT.match(text) and at[i] == at[i - 1] and not text.startswith("#[")):
            i += 1
            continue
        end = i
        while end < last:
            after = next((lines[k - 1].strip() for k in range(end + 1, last + 1) if lines[k - 1].strip()), "")
            open_ = at[end] > base or re.search(r"(=>?|[,(\[{&|+?:.\\-]|\b(?:extends|implements|return|else))$", lines[end - 1].strip())
            if not open_ and not re.match(r"[{.?)\]]|(else|catch|finally|while)\b(?!.*;$)|=>|&&|\|\|", after):
                break
            end += 1
        out.append((i, end))
        i = end + 1
    return out


def registration(text: str) -> tuple[str, str] | None:
    """(name, kind) of a statement that registers a command, tool or route, or that is a test; the first call with a string decides."""
    for m in _CALL.finditer(text):
        on, what, title = m[1], m[2], m[4]
        if what in TESTS and not on and m.start() == len(text) - len(text.lstrip()):
            return title[:TITLE], "test"
        more = text[m.end() :].lstrip()
        if on or text[max(0, m.start(2) - 1)] == ".":
            if what in REGISTRARS or (what in HTTP and more.startswith(",")):
                return title, "command"
    return None


def _named(text: str, lines: int) -> tuple[str, str, str | None] | None:
    """(name, kind, parent) of a statement that is a unit of its own."""
    if (m := _DECLARES.match(text)) and m["name"]:
        return m["name"], "method" if m["owner"] else _KINDS.get(m[1], m[1]), m["owner"]
    if m := _VARIABLE.match(text):
        if _FUNCTION_VALUE.match(m["value"]):
            return m["name"], "function", None
        if found := registration(text):
            return *found, None
        return (m["name"], "const", None) if lines >= 3 or (lines > 1 and _STRUCTURED.match(m["value"])) else None
    if found := registration(text):
        return *found, None
    return None


def _body(lines: list[str], at: list[int], first: int, last: int) -> tuple[int, int] | None:
    """The lines between the brackets that a statement opens last and closes on its last line."""
    base, opens = at[first - 1], None
    for i in range(first, last + 1):
        if at[i] > base and re.search(r"[{(\[]\s*(//.*)?$", lines[i - 1]):
            opens = i
            break
    return (opens + 1, last - 1) if opens and opens < last - 1 else None


def brace_units(text: str, shell: bool = False) -> list[Unit]:
    lines = text.split("\n")
    at, out = depths(lines, shell), []
    for a, b in statements(lines, at, 1, len(lines)):
        body = "\n".join(lines[a - 1 : b])
        if shell:
            m = _SHELL_FUNCTION.match(body)
            found = (m[1] or m[2], "function", None) if m and b > a else None
        else:
            found = _named(body, b - a + 1)
        if not found:
            continue
        name, kind, parent = found
        span = _body(lines, at, a, b)
        inner = tuple(statements(lines, at, *span)) if span else ()
        members = []
        if kind in ("class", "interface") and inner and "{" in body:
            for x, y in inner:
                m = _METHOD.match(lines[x - 1])
                if m and m["name"] not in _NOT_METHODS and y > x:
                    deep = _body(lines, at, x, y)
                    members.append(Unit(x, y, m["name"], "method", name, tuple(statements(lines, at, *deep)) if deep else ()))
        if members:
            out += [Unit(a, members[0].first - 1, name, kind, parent, (), tuple(f"{m.name}:L{m.first}-{m.last}" for m in members)), *members]
            tail = members[-1].last + 1
            if tail <= b:
                out.append(Unit(tail, b, None, "block", name))
        else:
            out.append(Unit(a, b, name, kind, parent, inner))
    return out


def python_units(text: str) -> list[Unit]:
    out: list[Unit] = []
    spans = lambda body: tuple((min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]), n.end_lineno) for n in body)
    define = ast.FunctionDef | ast.AsyncFunctionDef

    def own(node, parent: str | None, kind: str) -> Unit:
        return Unit(spans([node])[0][0], node.end_lineno, node.name, kind, parent, spans(node.body))

    for node in ast.parse(text).body:
        if isinstance(node, ast.ClassDef):
            members = [own(m, node.name, "method") for m in node.body if isinstance(m, define)]
            a = spans([node])[0][0]
            if members and members[0].first > node.lineno:
                out += [Unit(a, members[0].first - 1, node.name, "class", None, (), tuple(f"{m.name}:L{m.first}-{m.last}" for m in members)), *members]
                if members[-1].last < node.end_lineno:
                    out.append(Unit(members[-1].last + 1, node.end_lineno, None, "block", node.name))
            else:
                out.append(Unit(a, node.end_lineno, node.name, "class", None, spans(node.body)))
        elif isinstance(node, define):
            out.append(own(node, None, "function"))
        else:
            body = "\n".join(text.split("\n")[node.lineno - 1 : node.end_lineno])
            if isinstance(node, ast.Expr | ast.Assign) and (found := registration(body)):
                out.append(Unit(node.lineno, node.end_lineno, *found))
            elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                if isinstance(node.value, ast.Lambda):
                    out.append(Unit(node.lineno, node.end_lineno, node.targets[0].id, "function"))
                elif node.end_lineno - node.lineno >= 2:
                    out.append(Unit(node.lineno, node.end_lineno, node.targets[0].id, "const"))
    return out


def covering(units: list[Unit], lines: list[str], max_chars: int) -> Iterator[Unit]:
    """The units with the comments above them, and blocks for what lies between, so that no line with text is left out.

    A short gap joins the unit after it, at the end of a file the one before; a unit of more than max_chars is cut between
    its inner statements, of which registrations stand alone.
    """
    size = lambda a, b: sum(len(x) + 1 for x in lines[a - 1 : b])
    out: list[Unit] = []
    done = 0
    for u in units:
        first, parent = u.first, u.parent if u.kind == "method" else None
        while first - 1 > done and _COMMENT.match(lines[first - 2]):
            first -= 1
        gap = [x for x in lines[done : first - 1] if x.strip()]
        if gap and sum(len(x.strip()) for x in gap) < LEAST:
            first = done + 1
        elif gap:
            out.append(Unit(done + 1, first - 1, None, "block", parent))
        while not lines[first - 1].strip() and first < u.first:
            first += 1
        out.append(replace(u, first=first))
        done = u.last
    rest = [x for x in lines[done:] if x.strip()]
    if rest and out and sum(len(x.strip()) for x in rest) < LEAST:
        out[-1] = replace(out[-1], last=len(lines))
    elif rest:
        out.append(Unit(done + 1, len(lines)))
    for u in out:
        if size(u.first, u.last) <= max_chars or not u.inner:
            yield u
            continue
        at, start = u.first, u.first  # what is not yet given out begins at start
        for a, b in u.inner:
            found = registration("\n".join(lines[a - 1 : b]))
            if found and start < a:
                yield replace(u, first=start, last=a - 1)
                start = a
            if found:
                yield Unit(start, b, *found, u.name)
                start = b + 1
            elif size(start, b) > max_chars and start < a:
                yield replace(u, first=start, last=a - 1)
                start = a
            at = b
        if start <= u.last:
            yield replace(u, first=start, last=max(at, u.last))


def facts(content: str, name: str | None) -> tuple[str | None, list[str], list[str]]:
    """Signature (up to the body), called names and code-shaped strings of a chunk."""
    head = re.split(r"\{\s*$|:\s*$|=>", content.strip(), maxsplit=1, flags=re.M)[0] if name else ""
    calls = [c for c in dict.fromkeys(re.findall(r"([A-Za-z_$][\w$]*)\s*\(", content)) if c != name and c not in _NOT_METHODS]
    strings = (next(g for g in m.groups() if g is not None) for m in _STRING.finditer(content))
    found = [s for s in dict.fromkeys(strings) if 3 <= len(s) <= 60 and _LITERAL.fullmatch(s)]
    return (re.sub(r"\s+", " ", head).strip()[:SIGNATURE] or None) if name else None, calls[:CALLS], found[:LITERALS]


def imports_of(path: str, text: str) -> list[str]:
    """What a file imports, in order."""
    if path.endswith((".py", ".pyw")):
        found = [m[1] or m[2] for m in re.finditer(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", text)]
    else:
        found = [next(g for g in m.groups() if g) for m in re.finditer(r"""\bfrom\s+['"]([^'"]+)['"]|\bimport\s+['"]([^'"]+)['"]|\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)""", text)]
    return list(dict.fromkeys(found))


def exports_of(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|interface|type|enum|const|let|var|namespace)\s+([A-Za-z_$][\w$]*)", text)))


SCHEMA = (
    "file_path string, chunk_index int, symbol_name string, symbol_type string, parent_symbol string, start_line int, end_line int, content string, "
    "signature string, calls array<string>, literals array<string>, defines array<string>, imports array<string>, exports array<string>"
)


def chunk_rows(path: str, text: str, max_chars: int = 3200, overlap: int = 100) -> Iterator[tuple]:
    """The columns of SCHEMA after chunk_index, for every chunk of a file."""
    lines, units = text.split("\n"), []
    try:
        units = python_units(text) if path.endswith((".py", ".pyw")) else brace_units(text, bool(SHELL.search(path))) if BRACES.search(path) or SHELL.search(path) else []
    except (SyntaxError, ValueError, RecursionError):
        pass
    imports, exports = (imports_of(path, text), exports_of(text)) if units else ([], [])
    for u in covering(units, lines, max_chars) if units else [Unit(1, len(lines), None, "")]:
        content = "\n".join(lines[u.first - 1 : u.last])
        whole = bool(units) and len(content) <= max_chars
        for x, y, part in [(1, u.last - u.first + 1, content)] if whole else windows_of(content, max_chars, overlap):
            signature, calls, literals = facts(part, u.name)
            yield u.name, u.kind or None, u.parent, u.first + x - 1, u.first + y - 1, part, signature, calls, literals, list(u.defines), imports, exports


def structural_chunks(files: DataFrame, max_chars: int = 3200, overlap: int = 100) -> DataFrame:
    """SCHEMA rows of files(file_path, content).

    A file without structure, or that does not parse, is cut into text windows; so is a piece longer than max_chars. An empty
    or null file has no chunks.
    """

    def work(batches):
        for batch in batches:
            out = [(p, i, *r) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, r in enumerate(chunk_rows(p or "", text or "", max_chars, overlap))]
            strings = pa.list_(pa.string())
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[strings] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("file_path", "content").mapInArrow(work, SCHEMA)
