"""Path functions as Column expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components of a path."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def joined(path_parts: Column) -> Column:
    """The absolute path of components."""
    return F.concat(F.lit("/"), F.array_join(path_parts, "/"))


def parent(path: Column) -> Column:
    """The path above; the parent of a top-level path, and of the root, is the root."""
    p = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def basename(path: Column) -> Column:
    return F.when(path == "/", "/").otherwise(F.element_at(F.split(path, "/"), -1))


def depth(path: Column, root: Column) -> Column:
    """Edges from root to path."""
    return F.size(parts(path)) - F.size(parts(root))


def is_same_or_inside(path: Column, ancestor: Column) -> Column:
    """True for the path itself and anything below it, on component boundaries."""
    return (path == ancestor) | F.when(ancestor == "/", path.startswith("/")).otherwise(F.startswith(path, F.concat(ancestor, F.lit("/"))))


def abbreviate(path: Column, home: str) -> Column:
    """The home directory as ~."""
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def prefixes(path_parts: Column, least: int = 1) -> Column:
    """Component arrays of all ancestors with at least so many components, the path itself excluded."""
    n = F.size(path_parts)
    return F.when(n > least, F.transform(F.sequence(F.lit(least), n - 1), lambda k: F.slice(path_parts, F.lit(1), k))).otherwise(F.array().cast("array<array<string>>"))


def display_path(targets: Column) -> Column:
    """One target: itself; several: the folder of the first."""
    return F.when(F.size(targets) == 1, targets[0]).otherwise(F.concat(parent(targets[0]), F.lit("/…")))


def kind_of_mode(mode: Column) -> Column:
    """Entry kind from the file type bits of st_mode."""
    t = mode.bitwiseAND(F.lit(0o170000))
    return F.when(t == 0o100000, "file").when(t == 0o040000, "dir").when(t == 0o120000, "symlink").otherwise("other")


def normalize(path: str) -> str | None:
    """An absolute path with ~ and links resolved, on the driver; None if nothing is there. Both spellings of a data volume become the short one."""
    full = os.path.abspath(os.path.expanduser(path))
    if not os.path.lexists(full):
        return None
    real = os.path.realpath(full)
    if not os.path.exists(real):
        return None
    volume = "/System/Volumes/Data"
    if real.startswith(volume + "/"):
        short = real[len(volume) :]
        if os.path.lexists(short) and os.path.samestat(os.lstat(short), os.lstat(real)):
            return short
    return real
