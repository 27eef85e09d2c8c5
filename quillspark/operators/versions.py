"""Documents in versions: line trees, unified diffs and their replay, token budgets."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def parse_tree(text: str) -> list[dict]:
    """Lines with the headers above them: level, parent path, header, line (PRJ34)."""
    out, stack = [], []
    for line in text.split("\n"):
        if m := re.match(r"(#+) (.*)$", line):
            level = len(m[1])
            stack = [s for s in stack if s[0] < level]
            out.append({"level": level, "parent_path": [s[1] for s in stack], "header": m[2], "line": None})
            stack.append((level, m[2]))
        else:
            out.append({"level": 0, "parent_path": [s[1] for s in stack], "header": None, "line": line})
    return out


def render_tree(rows: list[dict]) -> str:
    """The text of parsed lines."""
    return "\n".join("#" * r["level"] + " " + r["header"] if r["header"] is not None else r["line"] for r in rows)


def tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """The line table of each document."""
    kind = "array<struct<level:int,parent_path:array<string>,header:string,line:string>>"

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([parse_tree(t or "") for t in texts])

    return df.select(key, F.posexplode(parse(text)).alias("ord", "x")).select(key, "ord", "x.*")


def unified(before: str, after: str) -> str:
    """A unified diff of the texts' lines; the end of the last line needs no mark, as lines are what stands between line feeds."""
    return "\n".join(difflib.unified_diff(before.split("\n"), after.split("\n"), "a", "b", lineterm=""))


HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def patch(before: str, diff: str) -> str:
    """The text after a unified diff of :func:`unified` (SNK11)."""
    old, out, at = before.split("\n"), [], 0
    for line in diff.split("\n")[2:]:
        if m := HUNK.match(line):
            start = int(m[1]) - (0 if m[2] == "0" else 1)
            out += old[at:start]
            at = start
        elif line[0] == " ":
            out.append(old[at])
            at += 1
        elif line[0] == "-":
            at += 1
        else:
            out.append(line[1:])
    return "\n".join(out + old[at:])


def diffs(versions: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Each version with the diff to the one before it (WIN18)."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified(x or "", y or "") for x, y in zip(a, b)])

    before = F.lag(text).over(W.partitionBy(key).orderBy(number))
    return versions.withColumn("__before", before).withColumn("diff", diff("__before", text)).drop("__before")


def replayed(changes: DataFrame, key: str, number: str, diff: str = "diff") -> DataFrame:
    """(key, number, text): the versions again, each by its diff from the one before (SNK11); a key's diffs must fit one task."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        text, out = "", []
        for n, change in sorted(zip(rows[number], rows[diff])):
            text = patch(text, change)
            out.append((rows[key].iloc[0], n, text))
        return pd.DataFrame(out, columns=[key, number, "text"])

    kinds = {c: changes.schema[c].dataType.simpleString() for c in (key, number)}
    return changes.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {number} {kinds[number]}, text string")


def condense_to_budget(df: DataFrame, text: str, budget: int, shorten: Callable[[Column], Column], passes: int = 5) -> DataFrame:
    """Texts over a token budget are shortened again, at most ``passes`` times (ITR05)."""
    for _ in range(passes):
        df = df.withColumn(text, F.when(T.token_estimate(text) > budget, shorten(F.col(text))).otherwise(F.col(text)))
    return df
