"""Where the space went: the largest files and a breakdown by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boscage.operators import tree


def largest_files(nodes: DataFrame, k: int = 15) -> DataFrame:
    """The k files with most bytes on disk, shared storage once. nodes has shared_extra."""
    return nodes.where("kind = 'file' and not shared_extra").orderBy(F.desc("own_alloc"), "root_ord", "path_parts").limit(k).select("path", F.col("own_alloc").alias("alloc"))


def ranked_children(nodes: DataFrame) -> DataFrame:
    """All nodes but roots with effective alloc and their position among siblings by it. nodes has totals and shared_extra."""
    rows = nodes.withColumn("eff_alloc", F.when(F.col("shared_extra"), 0).otherwise(F.col("total_alloc")))
    w = Window.partitionBy("root_ord", "parent_path").orderBy(F.desc("eff_alloc"), "path_parts")
    return rows.withColumn("pos", F.row_number().over(w) - 1)


def breakdown(nodes: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """Entries shown below each root: (root_ord, path, level, pos, size, file_count, expanded, omitted_count, omitted_size).

    A child is shown and entered if it is among the first `limit` with at least a hundredth of the root; shown only, if among the first three with a
    thousandth; else it is omitted and summed on its parent. roots: (root_ord, path). Levels are joined one by one, depth times.
    """
    ranked = ranked_children(nodes)
    tops = roots.withColumnRenamed("path", "root").join(nodes.select("root_ord", F.col("path").alias("root"), F.col("total_alloc").alias("root_alloc"), F.col("file_count").alias("fc"), F.col("kind").alias("rk")), ["root_ord", "root"])
    tops = tops.withColumn("threshold", F.floor(F.col("root_alloc") * F.lit(0.01)).cast("bigint"))
    level = tops.select("root_ord", F.col("root").alias("path"), "threshold", F.lit(0).alias("level"), F.lit(0).alias("pos"), F.col("root_alloc").alias("size"), F.col("fc").alias("file_count"), ((F.col("rk") == "dir") & F.lit(depth > 0)).alias("expanded"))
    shown = [level]
    omitted = []
    for d in range(1, depth + 1):
        up = level.where("expanded").select("root_ord", F.col("path").alias("parent_path"), "threshold")
        kids = ranked.join(up, ["root_ord", "parent_path"]).select("root_ord", "parent_path", "path", "threshold", F.lit(d).alias("level"), "pos", F.col("eff_alloc").alias("size"), "file_count", "kind")
        enter = (F.col("pos") < limit) & (F.col("size") >= F.greatest("threshold", F.lit(1)))
        leaf = (F.col("pos") < min(limit, 3)) & (F.col("size") >= F.greatest(F.floor(F.col("threshold") / 10), F.lit(1)))
        kids = kids.withColumn("enter", enter).withColumn("seen", enter | leaf)
        level = kids.where("seen").select("root_ord", "path", "threshold", "level", "pos", "size", "file_count", (F.col("enter") & (F.col("kind") == "dir") & F.lit(d < depth)).alias("expanded"))
        shown.append(level)
        omitted.append(kids.where("not seen").groupBy("root_ord", F.col("parent_path").alias("path")).agg(F.count("*").alias("omitted_count"), F.sum("size").alias("omitted_size")))
    out, gone = shown[0], None
    for s in shown[1:]:
        out = out.unionByName(s)
    for o in omitted:
        gone = o if gone is None else gone.unionByName(o)
    zero = F.lit(0).cast("bigint")
    if gone is None:
        return out.drop("threshold").withColumn("omitted_count", zero).withColumn("omitted_size", zero)
    return out.drop("threshold").join(gone, ["root_ord", "path"], "left").withColumn("omitted_count", F.coalesce("omitted_count", zero)).withColumn("omitted_size", F.coalesce("omitted_size", zero))


def big(nodes: DataFrame, roots: DataFrame, depth: int = 2, top: int = 8, files: int = 15) -> dict[str, DataFrame]:
    """The breakdown and the largest files of a catalog."""
    all_nodes = tree.with_totals(tree.with_shared_extra(nodes))
    return {"breakdown": breakdown(all_nodes, roots, depth, top), "files": largest_files(all_nodes, files)}


def to_json(out: DataFrame) -> DataFrame:
    """One JSON object a row, keys sorted."""
    return out.select(F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"}).alias("json"))


