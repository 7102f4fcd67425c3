"""Column builders that classify file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension, in natural order.
LANGUAGES = {
    "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "python": "py pyw", "go": "go", "rust": "rs", "java": "java",
    "c": "c h", "cpp": "cpp cc cxx hpp", "csharp": "cs", "swift": "swift", "kotlin": "kt kts", "ruby": "rb", "php": "php", "sql": "sql",
    "html": "html htm", "css": "css scss", "json": "json", "yaml": "yaml yml", "markdown": "md markdown", "bash": "sh bash zsh",
}

#: Names of configuration files.
CONFIG_NAMES = (
    "package.json package-lock.json pnpm-lock.yaml yarn.lock tsconfig.json jsconfig.json pyproject.toml cargo.toml go.mod go.sum dockerfile docker-compose.yml "
    "docker-compose.yaml makefile .eslintrc .eslintrc.js .eslintrc.cjs .prettierrc vite.config.ts vite.config.js webpack.config.js vitest.config.ts jest.config.js"
).split()

#: Names of files that may hold secrets, as one expression over the base name.
SECRET_NAME = r"^(\.env(\..*)?|.*\.(pem|key|p12|pfx|keystore|jks)|(credentials|secrets)\..*|id_(rsa|dsa|ecdsa|ed25519))$"


#: Words and endings of tasks about documentation.
DOC_WORDS, DOC_ENDINGS = "docs?|documentation|readme|changelog|guide|tutorial|markdown|faq|wiki", "md|mdc|mdx|rst"


def basename(path) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def language(path) -> Column:
    known = F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for ext in exts.split() for x in (ext, name)])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("text"))


def is_test(path) -> Column:
    return F.lower(path).rlike(r"\.test\.|\.spec\.|_test\.|/__tests__/|/tests/|/test/[^/]*$")


def is_config(path) -> Column:
    name = F.lower(basename(path))
    return name.isin(CONFIG_NAMES) | name.rlike(r"\.config\.(ts|js|mjs)$|^\..*rc(\.json)?$")


def is_doc(path) -> Column:
    return F.lower(basename(path)).rlike(r"\.(md|mdc|mdx|markdown|rst|adoc|txt)$|^(readme|changelog|contributing|license|notice|authors)(\..*)?$")


def is_doc_task(query) -> Column:
    """Whether a task is about documentation itself."""
    return F.lower(query).rlike(rf"\b({DOC_WORDS})\b|\.({DOC_ENDINGS})\b")


def is_code(path) -> Column:
    return ~is_doc(path) & ~F.lower(path).rlike(r"\.(json|jsonc|ya?ml|toml|ini|xml|csv|lock|env|txt)$") & ~path.rlike(r"(^|/)\.")


def is_secret(path) -> Column:
    return F.lower(basename(path)).rlike(SECRET_NAME)


def stem_of(path) -> Column:
    return F.lower(F.regexp_replace(basename(path), r"\.[^.]*$", ""))


def test_stem(path) -> Column:
    """The stem that a test file is named after (a.test.ts: a); null for other files."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"(?i)^(.+)\.(?:test|spec)\.[^.]+$", 1)), F.lit(""))
