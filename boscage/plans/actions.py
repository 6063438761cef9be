"""What an action would do, as rows: verdicts and reasons. Nothing is removed or cloned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.operators import dupes
from boscage.plans import guardrails

KEY = ["kind", "digest"]


def dupes_plan(rows: DataFrame, home: str, action: str = "trash", dry_run: bool = True, differing: DataFrame | None = None) -> DataFrame:
    """A verdict for each selected member: kind, digest, path, keeper, verdict (done, skipped), reason.

    rows: members with selected, change (null or what changed since the scan), dev, inode, nlink. A keeper is the first member that is not selected, not below
    anything selected, unchanged, and another object. differing: (path) of members whose unread bytes differ from their keeper's; a dry run does not look.
    """
    if action not in ("trash", "delete", "clone"):
        raise ValueError(f"no such action: {action}")
    gone = dupes.path_gone(rows.select("path"), rows.where("selected").select("path")) if action != "clone" else rows.where("false").select("path")
    rows = rows.join(gone.withColumn("_gone", F.lit(True)), "path", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    eligible = ~F.col("selected") & ~F.col("_gone") & F.col("change").isNull()
    # The first two eligible objects of a group are enough: one of them is another object than any member.
    solid = F.when((F.col("kind") == "file") & (F.col("nlink") >= 2), F.col("path")).otherwise(F.concat_ws(":", "dev", "inode"))
    objects = rows.where(eligible).groupBy(*KEY, solid.alias("_object")).agg(F.min("path").alias("_path"))
    keepers = objects.groupBy(*KEY).agg(F.min(F.struct("_path", "_object")).alias("_one"), F.count("*").alias("_n"))
    second = objects.join(keepers.select(*KEY, "_one"), KEY).where(F.col("_object") != F.col("_one._object")).groupBy(*KEY).agg(F.min("_path").alias("_two"))
    picked = rows.where("selected").withColumn("_mine", solid).join(keepers, KEY, "left").join(second, KEY, "left")
    same = F.col("_mine") == F.col("_one._object")
    keeper = F.when(F.col("_one").isNotNull() & ~same, F.col("_one._path")).when(same, F.col("_two"))
    picked = picked.withColumn("keeper", keeper)
    if differing is not None and not dry_run:
        picked = picked.join(differing.select("path", F.lit(True).alias("_differs")).distinct(), "path", "left")
    else:
        picked = picked.withColumn("_differs", F.lit(False))
    refused = guardrails.refusal(F.col("path"), home) if action != "clone" else F.lit(None).cast("string")
    reason = (
        F.when(F.col("keeper").isNull() & F.coalesce(same, F.lit(False)), "the other copy is this very item under another path")
        .when(F.col("keeper").isNull(), "no verified copy would remain")
        .when(F.col("change").isNotNull(), F.concat(F.lit("changed since the scan ("), "change", F.lit(")")))
        .when(refused.isNotNull(), F.concat(F.lit("refused: "), refused))
        .when(F.coalesce("_differs", F.lit(False)), F.concat(F.lit("differs from the copy that stays ("), "keeper", F.lit(")")))
    )
    return picked.select(*KEY, "path", "keeper", F.when(reason.isNull(), "done").otherwise("skipped").alias("verdict"), reason.alias("reason"))


def unread_differences(pairs: DataFrame) -> DataFrame:
    """Of pairs (path, content, read, keeper_content, keeper_read), those whose bytes differ and of which one side was matched without reading."""
    return pairs.where(~(F.col("read") & F.col("keeper_read")) & ~F.col("content").eqNullSafe(F.col("keeper_content"))).select("path")


def contents_equal(a: Column, b: Column) -> Column:
    return (F.octet_length(a) == F.octet_length(b)) & (a == b)


def clone_plan(pairs: DataFrame) -> DataFrame:
    """Per member what cloning would do, of aligned pairs (path, size, alloc, dev, clone_id, keeper_dev, keeper_clone_id): cloned, already_shared, bytes."""
    shared = (F.col("dev") == F.col("keeper_dev")) & (F.col("clone_id") == F.col("keeper_clone_id"))
    live = F.col("size") > 0
    return pairs.groupBy("path").agg(F.count_if(live & ~shared).alias("cloned"), F.count_if(live & shared).alias("already_shared"), F.coalesce(F.sum(F.when(live & ~shared, F.col("alloc"))), F.lit(0).cast("bigint")).alias("bytes"))


def clone_note(cloned: Column, shared: Column) -> Column:
    return F.concat_ws(
        ", ",
        F.when(cloned == 1, "1 file now shares storage").when(cloned > 1, F.concat(cloned.cast("string"), F.lit(" files now share storage"))),
        F.when(shared > 0, F.concat(shared.cast("string"), F.lit(" already shared"))),
    )


def clone_refusal(src: str = "src", dst: str = "dst", user: int = 501) -> Column:
    """Why a file cannot be replaced by a clone, the first reason that holds; src and dst are struct columns (null: gone)."""
    s, d = (lambda c: F.col(f"{src}.{c}")), (lambda c: F.col(f"{dst}.{c}"))
    return (
        F.when(F.col(src).isNull() | F.col(dst).isNull(), "file disappeared")
        .when((s("kind") != "file") | (d("kind") != "file"), "not a regular file")
        .when(s("dev") != d("dev"), "copies are on different volumes")
        .when(s("inode") == d("inode"), "already the same file (hard link)")
        .when(d("nlink") != 1, "has other hard links")
        .when(d("uid") != user, "owned by another user")
        .when(s("compressed") | d("compressed"), "uses file system compression")
        .when(d("locked"), "locked")
        .when(s("locked"), "the copy that stays is locked")
        .when((s("size") != d("size")) | (s("size") <= 0), "sizes differ")
    )


def junk_plan(items: DataFrame, nodes: DataFrame, mode: str = "trash") -> DataFrame:
    """Paths that cleaning findings would remove, with a verdict: path, verdict (remove, refused), reason. nodes: what is there now."""
    if mode not in ("trash", "delete"):
        raise ValueError(f"no such mode: {mode}")
    whole = F.when(F.col("safety") == "info", "report only").when((F.col("category") == "trash") & F.lit(mode == "trash"), "already in the Trash; use --delete to empty it")
    rows = items.withColumn("_why", whole)
    refused = rows.where("_why is not null").select(F.col("targets")[0].alias("path"), F.lit("refused").alias("verdict"), F.col("_why").alias("reason"))
    targets = rows.where("_why is null").select(F.explode("targets").alias("path"), "contents_only").join(nodes.select("path", F.col("kind").alias("now"), "unreadable"), "path", "left")
    links = targets.where("now = 'symlink'").select("path", F.lit("refused").alias("verdict"), F.lit("is now a symbolic link").alias("reason"))
    live = targets.where("now is null or now <> 'symlink'")
    closed = live.where("contents_only and (now is null or now <> 'dir' or unreadable)").select("path", F.lit("refused").alias("verdict"), F.lit("cannot be read").alias("reason"))
    inside = live.where("contents_only and now = 'dir' and not unreadable").select(F.col("path").alias("parent_path")).join(nodes.select("parent_path", "path"), "parent_path").select("path")
    plain = live.where("not contents_only").select("path").unionByName(inside).select("path", F.lit("remove").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    return plain.unionByName(refused).unionByName(links).unionByName(closed)


