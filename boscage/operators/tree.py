"""Hierarchy over path components: shared storage, roll-ups, navigation, scan rules. No loops over levels.

Sides of joins that grow with the catalog say "merge": sizes that Spark estimates of written tables are far below what a broadcast would take of the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boscage.functions import paths

#: Directories below / and /System that are other file systems (fixed values).
SYSTEM_MOUNTS = (("/", ("Volumes", "dev", ".vol", "net", "home")), ("/System", ("Volumes",)))


def with_shared_extra(nodes: DataFrame) -> DataFrame:
    """Adds shared_extra: of the files that may share storage, all but the first of each storage id in preorder over all roots."""
    order = F.struct("root_ord", "path_parts")
    first = nodes.where("maybe_shared and kind = 'file'").groupBy("dev", "clone_id").agg(F.min(order).alias("_first"))
    joined = nodes.join(first.hint("merge"), ["dev", "clone_id"], "left")
    extra = F.col("maybe_shared") & (F.col("kind") == "file") & (order != F.col("_first"))
    return joined.withColumn("shared_extra", F.coalesce(extra, F.lit(False))).drop("_first")


def blocked() -> Column:
    """A node that no longer says what is below it."""
    return F.col("unreadable") | F.col("pruned") | F.col("dataless") | F.col("mount")


def rollup(nodes: DataFrame, root_parts: int = 1) -> DataFrame:
    """Per directory: total_size, total_alloc (shared storage once), file_count, incomplete (something below could not be seen).

    nodes has shared_extra. Every node adds to each ancestor; partial sums keep the rows of high ancestors few.
    """
    below = nodes.select(
        "root_ord",
        F.explode(paths.prefixes(F.col("path_parts"), root_parts)).alias("dir_parts"),
        F.when(F.col("kind") == "dir", 0).otherwise(F.col("own_size")).alias("s"),
        F.when((F.col("kind") == "dir") | F.col("shared_extra"), 0).otherwise(F.col("own_alloc")).alias("a"),
        (F.col("kind") == "file").cast("bigint").alias("f"),
        blocked().alias("b"),
    )
    sums = below.groupBy("root_ord", "dir_parts").agg(F.sum("s").alias("total_size"), F.sum("a").alias("total_alloc"), F.sum("f").alias("file_count"), F.bool_or("b").alias("incomplete"))
    return sums.withColumn("path", paths.joined(F.col("dir_parts"))).drop("dir_parts")


def with_totals(nodes: DataFrame, root_parts: int = 1) -> DataFrame:
    """Every node with total_size, total_alloc, file_count and incomplete; a file's are its own. nodes has shared_extra."""
    sums = rollup(nodes, root_parts).withColumnsRenamed({"path": "_p", "root_ord": "_r"})
    own = lambda c, v: F.when(F.col("kind") == "dir", F.coalesce(c, F.lit(0))).otherwise(v)
    return nodes.join(sums.hint("merge"), (F.col("path") == F.col("_p")) & (F.col("root_ord") == F.col("_r")), "left").select(
        *nodes.columns,
        own(F.col("total_size"), F.col("own_size")).alias("total_size"),
        own(F.col("total_alloc"), F.col("own_alloc")).alias("total_alloc"),
        own(F.col("file_count"), (F.col("kind") == "file").cast("bigint")).alias("file_count"),
        F.coalesce("incomplete", F.lit(False)).alias("incomplete"),
    )


def children(nodes: DataFrame) -> DataFrame:
    """(path, names in byte order) of every directory with entries."""
    return nodes.where("path <> '/'").groupBy(F.col("parent_path").alias("path")).agg(F.sort_array(F.collect_list("name")).alias("names"))


def at_paths(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path) with the node's kind; null where nothing was scanned."""
    return wanted.join(nodes.select("path", "kind"), "path", "left")


def child_named(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (parent_path, name) with the path of that child; null if there is none."""
    return wanted.join(nodes.select("parent_path", "name", "path"), ["parent_path", "name"], "left")


def evidence(nodes: DataFrame, names: list[str], suffixes: list[str] = ()) -> DataFrame:
    """Per directory whether it has an entry of each name, or one that ends in each suffix and is longer."""
    has = [F.bool_or(F.col("name") == n).alias(f"has_{i}") for i, n in enumerate(names)]
    ends = [F.bool_or(F.col("name").endswith(x) & (F.length("name") > len(x))).alias(f"ends_{i}") for i, x in enumerate(suffixes)]
    return nodes.where("path <> '/'").groupBy("parent_path").agg(*has, *ends)


def root_dedup(nodes: DataFrame) -> DataFrame:
    """File roots without those that name a file already named; several hard links are several files."""
    w = Window.partitionBy("dev", "inode").orderBy("root_ord")
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1 or nlink >= 2").drop("_n")


def alias_prune(nodes: DataFrame) -> DataFrame:
    """Directories reached a second time are pruned; inode 0 is no identity."""
    w = Window.partitionBy("dev", "inode").orderBy("root_ord", "path_parts")
    again = (F.col("kind") == "dir") & (F.col("inode") != 0) & (F.row_number().over(w) > 1)
    return nodes.withColumn("pruned", F.col("pruned") | again)


def mount_filter(nodes: DataFrame, allowed: list[int], cross_devices: bool = False) -> DataFrame:
    """Marks directories on other devices than those of the roots."""
    return nodes.withColumn("mount", (F.col("kind") == "dir") & ~F.col("dev").isin(*allowed) & F.lit(not cross_devices))


def system_prune(nodes: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for above, names in SYSTEM_MOUNTS:
        hit = hit | ((F.col("parent_path") == above) & F.col("name").isin(*names))
    return nodes.withColumn("pruned", F.col("pruned") | (hit & (F.col("path") != "/")))


def scan_errors(nodes: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """The number of unreadable entries, exact, and the first of them."""
    bad = nodes.where("unreadable").select("path")
    return bad.agg(F.count("*").alias("error_count")), bad.orderBy("path").limit(most)


def without_pruned(nodes: DataFrame, root_parts: int = 1) -> DataFrame:
    """Drops what lies below pruned, mounted or unreadable directories; those stay themselves."""
    stop = nodes.where(blocked() & (F.col("kind") == "dir")).select(F.col("path_parts").alias("_up")).distinct()
    under = nodes.select("path", F.explode(paths.prefixes(F.col("path_parts"), root_parts)).alias("_up")).join(stop.hint("merge"), "_up", "left_semi").select("path").distinct()
    return nodes.join(under.hint("merge"), "path", "left_anti")


def dedupe_roots(roots: DataFrame) -> DataFrame:
    """Roots (root_ord, path, optional dev and inode) without repeats and without those inside another root, by text or by identity of a folder above."""
    rows = roots.groupBy("path").agg(F.min(F.struct(*[c for c in roots.columns if c != "path"])).alias("_r")).select("path", "_r.*")
    up = rows.select("path", F.explode(F.array_append(F.transform(paths.prefixes(paths.parts(F.col("path"))), paths.joined), F.lit("/"))).alias("up")).where("up <> path")
    inside = up.join(rows.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    out = rows.join(inside, "path", "left_anti")
    if {"dev", "inode"} <= set(roots.columns):
        w = Window.partitionBy("dev", "inode").orderBy("root_ord")
        out = out.withColumn("_n", F.when(F.col("inode").isNull(), 1).otherwise(F.row_number().over(w))).where("_n = 1").drop("_n")
    return out.select(*roots.columns)


def same_object(a: str, b: str, for_removal: bool = False) -> Column:
    """Whether columns a.* and b.* are one object. For removal, a file with several hard links survives under another name."""
    same = (F.col(f"{a}.dev") == F.col(f"{b}.dev")) & (F.col(f"{a}.inode") == F.col(f"{b}.inode"))
    return same & ~((F.col(f"{a}.kind") == "file") & (F.col(f"{a}.nlink") >= 2)) if for_removal else same
