"""The node catalog: one row for each file-system entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.functions import paths

KINDS = ("file", "dir", "symlink", "other")

#: Column, type, and the value where a catalog has no such column.
COLUMNS = (
    ("root_ord", "int", 0),
    ("path", "string", None),
    ("kind", "string", "file"),
    ("own_size", "bigint", 0),
    ("own_alloc", "bigint", None),
    ("mtime", "bigint", 0),
    ("mtime_nanos", "int", 0),
    ("dev", "int", 1),
    ("inode", "bigint", None),
    ("nlink", "int", 1),
    ("clone_id", "bigint", None),
    ("maybe_shared", "boolean", False),
    ("unreadable", "boolean", False),
    ("pruned", "boolean", False),
    ("dataless", "boolean", False),
    ("mount", "boolean", False),
    ("resource_fork", "boolean", False),
    ("link_target", "string", None),
    ("content", "binary", None),
    ("fork", "binary", None),
    ("rule_ord", "int", None),
    ("unpinned", "boolean", False),
)

#: The schema as a string that readers and createDataFrame take.
NODES = ", ".join(f"{n} {t}" for n, t, _ in COLUMNS)


def complete(rows: DataFrame) -> DataFrame:
    """A catalog with every column: defaults filled in, names and parents derived from paths."""
    have = set(rows.columns)
    cols = [(F.coalesce(F.col(n).cast(t), F.lit(d).cast(t)) if n in have else F.lit(d).cast(t)).alias(n) for n, t, d in COLUMNS]
    rows = rows.select(*cols)
    rows = rows.withColumn("own_alloc", F.coalesce("own_alloc", "own_size")).withColumn("clone_id", F.coalesce("clone_id", "inode"))
    return rows.withColumn("path_parts", paths.parts(F.col("path"))).withColumn("name", paths.basename(F.col("path"))).withColumn("parent_path", paths.parent(F.col("path")))


def directories_of(files: DataFrame, root_parts: int = 1) -> DataFrame:
    """Directory rows for every ancestor of the given paths (path), down from components so many from the top."""
    up = files.select(F.explode(paths.prefixes(paths.parts(F.col("path")), root_parts)).alias("p")).distinct()
    return up.select(paths.joined(F.col("p")).alias("path"), F.lit("dir").alias("kind"))
