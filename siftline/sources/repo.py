"""Source trees as tables: discovery with ignore rules, read on the executors through a Python data source."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What discovery leaves out unless told otherwise.
IGNORED = (
    ".git/ .svn/ .hg/ node_modules/ dist/ build/ out/ coverage/ .next/ .nuxt/ .turbo/ target/ vendor/ .cache/ tmp/ .venv/ venv/ __pycache__/ .pytest_cache/ .mypy_cache/ .tox/ .gradle/ .idea/ "
    ".vscode-test/ Pods/ .expo/ .expo-shared/ Carthage/ DerivedData/ *.xcworkspace/ *.xcodeproj/ *.xcframework/ *.dSYM/ *.lock package-lock.json pnpm-lock.yaml npm-shrinkwrap.json *.min.js *.min.css "
    "*.map *.log *.pyc *.pyo *.class *.o *.obj *.zip *.tar *.tar.gz *.tgz *.rar *.7z *.png *.jpg *.jpeg *.gif *.webp *.ico *.bmp *.tiff *.svg *.mp4 *.mov *.avi *.mkv *.webm *.mp3 *.wav *.flac *.ogg "
    "*.pdf *.woff *.woff2 *.ttf *.eot *.exe *.dll *.so *.dylib *.jar *.wasm *.onnx *.a *.framework/ *.apk *.aab *.ipa"
).split()
SECRET = re.compile(r"(\.env(\..*)?|.*\.(pem|key|p12|pfx|keystore|jks)|(credentials|secrets)\..*|id_(rsa|dsa|ecdsa|ed25519))", re.I)
#: Ours: texts that look as if they held a secret.
SECRET_TEXT = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|(?i:api[_-]?key|secret|token|password)\s*[=:]\s*[\"'][^\"']{8,}")
MAX_BYTES, SNIFF = 2 << 20, 8000


class Ignore:
    """Patterns of the ignore-file kind: later ones win, ! takes back, / anchors, a final / means folders, ** spans folders."""

    def __init__(self, patterns: list[str]):
        self.rules = []
        for line in patterns:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            folder, body = line.endswith("/"), line.strip("/")
            anchored = "/" in line.rstrip("/")
            parts = [{"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, p if p.startswith("[") else re.escape(p)) for p in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|.", body)]
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + "".join(parts)), folder, keep))

    def hides(self, path: str, folder: bool = False) -> bool:
        """Whether the path, or a folder above it, is ignored."""
        steps = path.split("/")
        for n in range(1, len(steps) + 1):
            own, is_folder = "/".join(steps[:n]), n < len(steps) or folder
            state = False
            for rule, only_folders, keep in self.rules:
                if (is_folder or not only_folders) and rule.fullmatch(own):
                    state = not keep
            if state:
                return True
        return False


def rules(root: str, extra: tuple[str, ...] = ()) -> Ignore:
    """What is fixed, what the root's .gitignore says, and what else was given."""
    own = [*IGNORED]
    if os.path.isfile(os.path.join(root, ".gitignore")):
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as file:
            own += file.read().splitlines()
    return Ignore([*own, *extra])


def admits(root: str, path: str, extra: tuple[str, ...] = (), sensitive: bool = False) -> bool:
    """Whether a relative path is one that discovery would give, as far as its name tells."""
    return not rules(root, extra).hides(path) and (sensitive or not SECRET.fullmatch(path.rsplit("/", 1)[-1]))


def _entries(root: str, folder: str, ignore: Ignore) -> Iterator[tuple[str, os.DirEntry]]:
    """(relative path, entry) of what a folder shows: no links, nothing ignored; a folder that cannot be read shows nothing."""
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        if not e.is_symlink() and not ignore.hides(path, e.is_dir()):
            yield path, e


def discover(root: str, extra: tuple[str, ...] = (), under: str = "", deep: bool = True) -> Iterator[str]:
    """Relative paths of the files to index: no links, nothing ignored or secret, no nested repositories; of the folder itself
    alone unless deep."""
    ignore = rules(root, extra)

    def walk(folder: str) -> Iterator[str]:
        for path, e in _entries(root, folder, ignore):
            if e.is_dir():
                if deep and not os.path.exists(os.path.join(root, path, ".git")):
                    yield from walk(path)
            elif not SECRET.fullmatch(e.name):
                yield path

    yield from walk(under)


def folders(root: str, extra: tuple[str, ...] = ()) -> list[str]:
    """The folders right below the root that discovery goes into."""
    ignore = rules(root, extra)
    return [path for path, e in _entries(root, "", ignore) if e.is_dir() and not os.path.exists(os.path.join(root, path, ".git"))]


def admitted(data: bytes) -> str | None:
    """Why a file's content is not indexed; None where it is."""
    if len(data) > MAX_BYTES:
        return "oversized"
    if b"\0" in data[:SNIFF]:
        return "binary"
    return "secret" if SECRET_TEXT.search(data.decode("utf-8", "replace")) else None


class _Tree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    """The driver lists the root alone; every folder below it is walked and read by a task of its own."""

    def __init__(self, options: dict):
        self.root, self.extra = options["path"], tuple(p for p in options.get("ignore", "").split(",") if p)

    def partitions(self) -> list[InputPartition]:
        return [_Tree("", False), *(_Tree(f, True) for f in folders(self.root, self.extra))]

    def read(self, partition: _Tree) -> Iterator[tuple]:
        for path in discover(self.root, self.extra, partition.folder, partition.deep):
            try:
                with open(os.path.join(self.root, path), "rb") as file:
                    data = file.read(MAX_BYTES + 1)
            except OSError:
                continue
            reason = admitted(data)
            yield path, None if reason else data.decode("utf-8", "replace"), len(data), reason


class RepositorySource(DataSource):
    """spark.dataSource.register(RepositorySource); spark.read.format("siftline_repo").load(folder). The folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "siftline_repo"

    def schema(self) -> str:
        return "file_path string, content string, bytes long, skipped string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
