"""Snapshot against snapshot: what changed since a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.functions import paths
from boscage.operators import dupes


def snapshot_diff(then: DataFrame, now: DataFrame) -> DataFrame:
    """(path, reason) of every node of then that is not as it was: gone, changed type, modified, entries added or removed, unreadable.

    Files compare size, time and inode; links size and inode; directories the names of their entries without view settings files.
    """
    names = lambda nodes, c: nodes.where(~dupes.is_ignorable() & (F.col("path") != "/")).groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias(f"{c}_n"), F.bit_xor(F.xxhash64("name")).alias(f"{c}_x"), F.sum(F.xxhash64(F.lit(7), "name").bitwiseAND(F.lit((1 << 40) - 1))).alias(f"{c}_s"))
    cols = ["path", "kind", "own_size", "mtime", "mtime_nanos", "inode", "unreadable"]
    a = then.where(~dupes.is_ignorable()).select(*cols).join(names(then, "a"), "path", "left")
    b = now.select("path", *[F.col(c).alias(f"now_{c}") for c in cols[1:]]).join(names(now, "b"), "path", "left")
    rows = a.join(b, "path", "left")
    differs = lambda *cs: F.concat(*[F.when(F.col(c).eqNullSafe(F.col(f"now_{c}")), "").otherwise("x") for c in cs]) != ""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = (
        F.when(F.col("now_kind").isNull(), "no longer exists")
        .when(F.col("kind") != F.col("now_kind"), "changed type")
        .when((F.col("kind") == "file") & differs("own_size", "mtime", "mtime_nanos", "inode"), "modified")
        .when((F.col("kind") == "symlink") & differs("own_size", "inode"), "modified")
        .when((F.col("kind") == "dir") & F.col("now_unreadable"), "cannot be read")
        .when((F.col("kind") == "dir") & ((zero("a_n") != zero("b_n")) | (zero("a_x") != zero("b_x")) | (zero("a_s") != zero("b_s"))), "entries were added or removed")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def changed_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members (path) with the first difference at or below them: reason, change_path; null if nothing changed."""
    ups = changes.select(F.col("path").alias("change_path"), "reason", F.explode(F.array_append(F.transform(paths.prefixes(paths.parts(F.col("path"))), paths.joined), F.col("path"))).alias("path"))
    first = ups.groupBy("path").agg(F.min(F.struct("change_path", "reason")).alias("_c")).select("path", "_c.change_path", "_c.reason")
    return members.join(first, "path", "left")
