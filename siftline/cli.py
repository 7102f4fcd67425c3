"""The engine on the command line: python -m siftline.cli COMMAND …"""

from __future__ import annotations

import argparse
import json
import sys

COMMANDS = {
    "init": "write a configuration file with the defaults", "index": "bring the index of a repository up to date", "rebuild": "index a repository from nothing", "repos": "list what is indexed", "status": "tell how fresh an index is",
    "search": "search chunks by meaning and words", "context": "gather what a task needs", "symbol": "look a symbol up", "references": "find where a symbol is mentioned", "file": "read ranges of files", "overview": "languages and folders of a repository",
    "clean": "delete an index", "optimise": "write the keyword and vector indexes", "savings": "what retrieval has saved", "benchmark": "measure retrieval on labelled tasks", "plan": "show the parts of a request",
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftline", description=__doc__)
    out.add_argument("--database", help="folder of the indexes")
    out.add_argument("--repo", help="id, name or path of a repository")
    out.add_argument("--json", action="store_true", help="print JSON")
    sub = out.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        if name in ("index", "rebuild", "init"):
            p.add_argument("path", nargs="?", default=".")
        elif name in ("search", "context", "plan"):
            p.add_argument("query")
        elif name in ("symbol", "references"):
            p.add_argument("name")
        elif name == "file":
            p.add_argument("ranges", nargs="+")
        elif name == "benchmark":
            p.add_argument("tasks", help="JSON lines of query_id, text and labels")
        if name in ("search", "symbol", "references"):
            p.add_argument("--limit", type=int, default=10)
        if name == "savings":
            p.add_argument("--rate", type=float, default=3.0)
            p.add_argument("--turns", type=int, default=15)
    return out


def run(args: argparse.Namespace, engine) -> object:
    """What a command returns: rows as a list of maps, a map or a text."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    calls = {
        "index": lambda: engine.index(args.path), "rebuild": lambda: engine.index(args.path, full=True), "repos": lambda: rows(engine.list_indexed_repos()), "status": lambda: engine.index_status(args.repo),
        "search": lambda: rows(engine.search_codebase(args.query, args.limit, repo=args.repo)), "context": lambda: engine.get_task_context(args.query, args.repo), "symbol": lambda: rows(engine.search_symbol(args.name, args.limit, args.repo)),
        "references": lambda: rows(engine.find_references(args.name, args.limit, args.repo)), "file": lambda: engine.get_file_context(args.ranges, args.repo), "overview": lambda: engine.get_repo_context(args.repo),
        "clean": lambda: engine.forget(args.repo), "optimise": lambda: engine.build_indexes(args.repo), "savings": lambda: rows(engine.savings(args.rate, args.turns)), "plan": lambda: engine.plan(args.query),
        "benchmark": lambda: rows(engine.bench(engine.spark.read.schema("query_id string, text string, labels array<struct<file_path:string,level:int>>").json(args.tasks), args.repo)),
    }
    return calls[args.command]()


def main(argv: list[str] | None = None) -> int:
    from . import config

    args = parser().parse_args(argv)
    loaded = config.load(getattr(args, "path", None), given={"database": {"path": args.database}} if args.database else None)
    if args.command == "init":
        print(json.dumps(loaded, indent=2))
        return 0
    import os

    from .engine import Engine, EngineError
    from .session import session

    engine = Engine(session(), os.path.expanduser(loaded["database"]["path"]), loaded)
    try:
        found = run(args, engine)
    except EngineError as error:
        print(json.dumps(error.reply()) if args.json else f"{error}\n{error.recovery}", file=sys.stderr)
        return 1
    print(found if isinstance(found, str) and not args.json else json.dumps(found, indent=None if args.json else 2, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
