"""When an agent may scan the tree itself, as columns over its requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST = "event string, tool string, subagent string, cwd string, roots array<string>, path string, directory string, pattern string, description string, prompt string, task string, task_subagent string"
#: Phrases of a task that explores.
EXPLORES = r"\b(explor(e|ing)|search the (code|repo|codebase)|find where|how does)\b"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def denied(requests: DataFrame, granted: Column | None = None) -> DataFrame:
    """requests(REQUEST, all nullable) with the column denied.

    Explorers are denied, and so are searches and listings of a whole workspace, unless a fallback is granted. A search of a
    file or a folder below the root is let through, and so is a listing by a narrow pattern.
    """
    roots = F.transform(F.concat(F.coalesce("roots", F.array().cast("array<string>")), F.filter(F.array("cwd"), lambda x: x.isNotNull())), lambda r: F.regexp_replace(r, "/+$", ""))
    tool = _text("tool")

    def whole(target: Column) -> Column:
        own = F.regexp_replace(target, "/+$", "")
        return (target == "") | F.exists(roots, lambda r: (r != "") & ((own == r) | (own == ".")))

    target = F.when(_text("path") != "", _text("path")).otherwise(_text("directory"))
    pattern = _text("pattern")
    broad = (pattern == "") | pattern.contains("**") | pattern.isin("*", "*.*")
    said = F.lower(F.concat_ws(" ", _text("description"), _text("prompt"), _text("task")))
    asks = (_text("event") == "subagentStart") | ((_text("subagent") != "") & (tool == ""))
    free = granted if granted is not None else F.lit(False)
    verdict = (
        F.when(asks, _text("subagent") == "explore")
        .when(tool == "Task", (_text("task_subagent") == "explore") | said.rlike(EXPLORES))
        .when(free & tool.isin("Grep", "Glob"), False)
        .when(tool == "Grep", ~target.rlike(r"\.[A-Za-z0-9]{1,8}$") & whole(target))
        .when(tool == "Glob", broad & whole(_text("directory")))
        .otherwise(False)
    )
    return requests.withColumn("denied", verdict)
