"""Which entries a duplicate scan leaves out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.functions import paths

HOME_EXCLUDES = ("Library", ".Trash")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern: * ? [..] with ranges and negation, backslash escapes. A leading dot is not special."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))
            if end < 0:
                out += r"\["
                continue
            body = pattern[i:end]
            i = end + 1
            negated = body[:1] in ("!", "^")
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]"
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def is_excluded(excludes: list[str]) -> Column:
    """Entries named by a glob, or by an absolute path."""
    hit = F.lit(False)
    for e in excludes:
        hit = hit | (F.col("path") == e if e.startswith("/") else F.col("name").rlike(glob_regex(e)))
    return hit


def is_home_excluded(home: str) -> Column:
    """App data and trash, in home and in any direct child of /Users."""
    above = (F.col("parent_path") == home) | (paths.parent(F.col("parent_path")) == "/Users") & F.col("parent_path").startswith("/Users/")
    return above & F.col("name").isin(*HOME_EXCLUDES)


def apply(nodes: DataFrame, home: str, excludes: list[str] = ()) -> DataFrame:
    """The catalog with excluded entries pruned."""
    return nodes.withColumn("pruned", F.col("pruned") | is_home_excluded(home) | is_excluded(list(excludes)))
