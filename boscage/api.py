"""The four commands as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.functions import scalars
from boscage.operators import big as big_ops
from boscage.operators import dupes as dupe_ops
from boscage.operators import excludes as exclude_ops
from boscage.operators import junk as junk_ops
from boscage.operators import tree
from boscage.sources.schema import complete
from boscage.sources.shared import materialize


def _check(flags: dict[str, bool], together: str) -> None:
    on = [k for k, v in flags.items() if v]
    if len(on) > 1:
        raise ValueError(f"{together}: {', '.join(on)}")


def digested(nodes: DataFrame) -> DataFrame:
    """A catalog with content_digest in place of contents, so that no join moves these."""
    if "content_digest" not in nodes.columns:
        nodes = nodes.withColumn("content_digest", F.when(F.col("kind") == "file", dupe_ops.file_digest(F.col("content"), F.when(F.col("resource_fork"), F.col("fork")))))
    return nodes.drop("content", "fork")


def prepared(nodes: DataFrame, include_hidden: bool = False, root_parts: int = 1, repo_roots: DataFrame | None = None) -> DataFrame:
    """A catalog with shared storage, totals, zones and digests of files, links and folders; contents, if there are any, end here.

    Files have content_digest (see sources.local.read_digests) or content.
    """
    ok = ~(F.col("unreadable") | F.col("pruned") | F.col("dataless"))
    leaf = F.when((F.col("kind") == "file") & ok, F.col("content_digest")).when(F.col("kind") == "symlink", dupe_ops.link_digest(F.col("link_target")))
    nodes = digested(nodes).withColumn("digest", leaf).drop("content_digest")
    # Each step reads its catalog several times over, so each is written once.
    rows = materialize(tree.with_totals(tree.with_shared_extra(nodes), root_parts), "totals")
    rows = materialize(dupe_ops.zones(rows, include_hidden, root_parts, repo_roots), "zones")
    folders = dupe_ops.folder_digest(rows, root_parts).withColumnRenamed("digest", "_folder")
    return rows.join(folders.hint("merge"), ["root_ord", "path"], "left").withColumn("digest", F.coalesce("digest", F.when(~F.col("incomplete"), F.col("_folder")))).drop("_folder")


def dupe_members(
    nodes: DataFrame, home: str, min_size: int = dupe_ops.MIN_SIZE, files_only: bool = False, folders_only: bool = False, hidden: bool = False, keep: str = "auto", prefer: list[str] = (), excludes: list[str] = (),
    containers: list[str] | None = None, root_parts: int = 1, repo_roots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Members of duplicate groups with holds, ranks and suggestions, and the prepared catalog."""
    _check({"files_only": files_only, "folders_only": folders_only}, "exclude each other")
    containers = [home, f"{home}/Downloads", f"{home}/Desktop", f"{home}/Documents"] if containers is None else containers
    nodes = digested(complete(nodes) if "path_parts" not in nodes.columns else nodes)
    rows = tree.without_pruned(exclude_ops.apply(nodes, home, excludes), root_parts)
    # Build output is one opaque thing, never copies to remove.
    matches = materialize(junk_ops.artifact_matches(rows, junk_ops.artifact_rules(rows.sparkSession), home), "matches")
    rows = junk_ops.tagged(rows, matches)
    rows = materialize(prepared(rows, hidden, root_parts, repo_roots), "prepared")
    found = materialize(dupe_ops.members(rows, min_size, not folders_only, not files_only), "members")
    held = materialize(dupe_ops.holds(found, rows, containers, root_parts), "held")
    ranked = materialize(dupe_ops.ranked(held, home, keep, prefer), "ranked")
    if dupe_ops.needs_sequential(ranked, rows):
        per = ranked.groupBy("kind", "digest").agg(F.min_by("total_size", F.struct("root_ord", "path_parts")).alias("size"), F.collect_list(F.struct("path", "hold", "rank", F.size("path_parts").alias("depth"))).alias("members"))
        order = dupe_ops.suggest_in_order([r.asDict(recursive=True) for r in per.collect()])  # one row a group: groups of this rare case only
        flags = ranked.sparkSession.createDataFrame(list(order.items()) or [("", False)], "path string, suggested boolean")
        return ranked.join(flags, "path", "left").withColumn("suggested", F.coalesce("suggested", F.lit(False))), rows
    return materialize(dupe_ops.suggested(ranked), "suggested"), rows


def dupes(nodes: DataFrame, home: str, **options) -> DataFrame:
    """Duplicate groups, largest gain first."""
    rows, every = dupe_members(nodes, home, **options)
    rows = rows.withColumn("selected", F.col("suggested"))
    return dupe_ops.groups(rows, dupe_ops.reclaim(rows, every))


def dupes_json(groups: DataFrame) -> DataFrame:
    """A JSON object a group, keys sorted; a missing hold is an explicit null."""
    member = F.transform("members", lambda m: F.struct(m["hold"].alias("hold"), m["mtime"].alias("modified"), m["path"].alias("path"), F.when(m["suggested"], "remove").otherwise("keep").alias("suggestion")))
    kind = F.when(F.col("kind") == "dir", "folder").otherwise("file")
    return groups.select(F.to_json(F.struct(F.col("shared").alias("alreadyShared"), F.col("file_count").alias("files"), kind.alias("kind"), member.alias("members"), "reclaimable", F.col("digest").alias("sha256"), "size"), {"ignoreNullFields": "false"}).alias("json"))


def junk(nodes: DataFrame, home: str, now: int, min_size: int = junk_ops.MIN_SIZE, older_than: float | None = None, only: list[str] = (), skip: list[str] = (), active_window: float = junk_ops.ACTIVE_WINDOW, projects: bool = True, known: bool = True, root_parts: int = 1) -> DataFrame:
    """Findings of regenerable data in report order. nodes covers the project folders and home."""
    if not (projects or known):
        raise ValueError("nothing to look for: projects and known are both off")
    spark = nodes.sparkSession
    rules = junk_ops.artifact_rules(spark)
    places = junk_ops.known_locations(spark, home).unionByName(junk_ops.sandbox_caches(nodes, home)).unionByName(junk_ops.installers(nodes))
    totals = materialize(tree.with_totals(tree.with_shared_extra(nodes), root_parts), "totals")
    items = None
    if known:
        items = junk_ops.location_items(totals, places, min_size).unionByName(junk_ops.child_items(totals, places, junk_ops.cache_labels(spark), min_size))
    if projects:
        tagged = materialize(junk_ops.tagged(totals, materialize(junk_ops.artifact_matches(totals, rules, home), "matches")), "tagged")
        tagged = materialize(junk_ops.walk_prune(tagged, junk_ops.claimed_names(places, totals, home), root_parts), "walked")
        own = junk_ops.artifact_items(tagged, rules, now, min_size, older_than, active_window)
        items = own if items is None else items.unionByName(own)
    return junk_ops.ordered(junk_ops.only_skip(items, list(only), list(skip)))


def big(nodes: DataFrame, roots: DataFrame, depth: int = 2, top: int = 8, files: int = 15) -> dict[str, DataFrame]:
    """The breakdown by folder and the largest files."""
    return big_ops.big(nodes, roots, depth, top, files)


def status(volume: DataFrame) -> DataFrame:
    """Volume rows (name, total, free, important) with used and purgeable bytes and a bar."""
    available = F.greatest(F.coalesce("important", "free"), "free")
    used = F.col("total") - F.col("free")
    return volume.select(
        "name", "total", "free", available.alias("available"), used.alias("used"), F.greatest(F.lit(0).cast("bigint"), available - F.col("free")).alias("purgeable"),
        scalars.fmt_bar(used / F.greatest("total", F.lit(1)), 30).alias("bar"), scalars.fmt_bytes(used).alias("used_text"),
    )
