"""A Spark data source that scans a directory tree with lstat, and the digests of files that can have copies. Links are never followed.

    spark.dataSource.register(LocalTree)
    nodes = complete(spark.read.format("local_tree").option("path", "/data").load())
    nodes = read_digests(nodes)

Partitions are the entries of the first levels, so executors that share the file system scan in parallel. A root that is not there and an
entry that cannot be looked at are unreadable rows.
"""

from __future__ import annotations

import hashlib
import os
import stat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boscage.sources.shared import materialize

SCHEMA = "root_ord int, path string, kind string, own_size bigint, own_alloc bigint, mtime bigint, mtime_nanos int, dev int, inode bigint, nlink int, unreadable boolean, mount boolean, link_target string"


_COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
_UNREADABLE, _MOUNT = _COLUMNS.index("unreadable"), _COLUMNS.index("mount")


class _Shard(InputPartition):
    def __init__(self, root_ord: int, path: str, deep: bool, dev: int):
        self.root_ord, self.path, self.deep, self.dev = root_ord, path, deep, dev


def kind_of(mode: int) -> str:
    return "file" if stat.S_ISREG(mode) else "dir" if stat.S_ISDIR(mode) else "symlink" if stat.S_ISLNK(mode) else "other"


def _row(root_ord: int, path: str, info: os.stat_result, unreadable: bool, mount: bool):
    kind = kind_of(info.st_mode)
    size = 0 if kind == "dir" else info.st_size
    alloc = 0 if kind == "dir" else info.st_blocks * 512
    target = os.readlink(path) if kind == "symlink" else None
    return (root_ord, path, kind, size, alloc, int(info.st_mtime_ns // 10**9), int(info.st_mtime_ns % 10**9), info.st_dev & 0x7FFFFFFF, info.st_ino, info.st_nlink, unreadable, mount, target)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = options.get("path", "").split(",")
        self.cross = options.get("crossdevices", "false").lower() == "true"
        self.shard_depth = int(options.get("sharddepth", "1"))

    def partitions(self):
        out = []
        for i, root in enumerate(self.roots):
            root = root.rstrip("/") or "/"
            try:
                dev = os.lstat(root).st_dev
            except OSError:
                out.append(_Shard(i, root, False, -1))  # its read gives the error row
                continue
            level = [root]
            for _ in range(self.shard_depth):
                below = []
                for p in level:
                    out.append(_Shard(i, p, False, dev))
                    below += self._entries(p, dev)
                level = below
            out += [_Shard(i, p, True, dev) for p in level]
        return out

    def _entries(self, path, dev):
        """What a scan enters below a path: nothing for links, files, other file systems and folders that cannot be listed."""
        try:
            info = os.lstat(path)
            if not stat.S_ISDIR(info.st_mode) or (info.st_dev != dev and not self.cross):
                return []
            return [os.path.join(path, n) for n in sorted(os.listdir(path))]
        except OSError:
            return []

    def read(self, shard):
        stack = [shard.path]
        while stack:
            path = stack.pop()
            try:
                info = os.lstat(path)
                row = _row(shard.root_ord, path, info, False, info.st_dev != shard.dev and not self.cross)
            except OSError:
                yield (shard.root_ord, path, "other", 0, 0, 0, 0, 0, None, 0, True, False, None)
                continue
            names = []
            if stat.S_ISDIR(info.st_mode) and not row[_MOUNT]:
                try:
                    names = sorted(os.listdir(path))
                except OSError:
                    row = (*row[:_UNREADABLE], True, *row[_UNREADABLE + 1 :])
            yield row
            if shard.deep:
                stack += [os.path.join(path, n) for n in reversed(names)]


class LocalTree(DataSource):
    @classmethod
    def name(cls):
        return "local_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


#: Bytes of a file's ends that a sample takes, and of a step of a full read. Files up to four samples are read at once.
SAMPLE, STEP = 65536, 1 << 20


def _digest(path: str, size: int, mtime: int, whole: bool) -> str | None:
    """SHA-256 of a file, or of its first and last SAMPLE bytes; None where it cannot be read or is not what the scan saw."""
    try:
        with open(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
            found, before = hashlib.sha256(), os.fstat(f.fileno())
            if not stat.S_ISREG(before.st_mode) or before.st_size != size or before.st_mtime_ns // 10**9 != mtime:
                return None
            if whole:
                while block := f.read(STEP):
                    found.update(block)
            else:
                found.update(f.read(SAMPLE))
                f.seek(max(0, size - SAMPLE))
                found.update(f.read(SAMPLE))
            after = os.fstat(f.fileno())
            return found.hexdigest() if (after.st_size, after.st_mtime_ns) == (before.st_size, before.st_mtime_ns) else None
    except OSError:
        return None


def _reading(whole: bool):
    def run(batches):
        for b in batches:
            b["found"] = [_digest(p, int(n), int(t), whole) for p, n, t in zip(b["path"], b["own_size"], b["mtime"])]
            yield b

    return run


def read_digests(nodes: DataFrame, min_size: int = 1) -> DataFrame:
    """The catalog with content_digest of files, read on the executors, which must see the same folders.

    Only files whose size occurs again are read, large ones first by their ends and in full only where those agree: contents are never rows. A file that is alone so far has a
    value of its own, which equals no other; one that cannot be read or has changed since the scan has none, and is unreadable.
    """
    files = nodes.where((F.col("kind") == "file") & (F.col("own_size") >= min_size) & ~(F.col("unreadable") | F.col("pruned") | F.col("dataless"))).select("root_ord", "path", "own_size", "mtime")
    several = files.groupBy("own_size").agg(F.count("*").alias("n")).where("n > 1").select("own_size")
    files = files.join(several, "own_size")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in files.schema.fields)}, found string"
    # Spread by path, so that files of one size do not meet in one task.
    sampled = materialize(files.where(F.col("own_size") > 4 * SAMPLE).repartition("path").mapInPandas(_reading(False), schema).withColumnRenamed("found", "sample"), "samples")
    alike = sampled.where("sample is not null").groupBy("own_size", "sample").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    whole = files.where(F.col("own_size") <= 4 * SAMPLE).unionByName(sampled.join(alike, ["own_size", "sample"]).select(*files.columns))
    read = whole.repartition("path").mapInPandas(_reading(True), schema).select("root_ord", "path", "found", F.lit(True).alias("read"))
    lost = sampled.where("sample is null").select("root_ord", "path", F.lit(None).cast("string").alias("found"), F.lit(True).alias("read"))
    read = materialize(read.unionByName(lost), "digests")
    alone = F.concat_ws(":", F.lit("alone"), F.col("root_ord").cast("string"), F.col("path"))
    empty = F.lit(hashlib.sha256().hexdigest())
    rows = nodes.join(read, ["root_ord", "path"], "left")
    digest = F.when(F.col("kind") != "file", None).when(F.col("read"), F.col("found")).when(F.col("own_size") == 0, empty).otherwise(alone)
    failed = F.coalesce("read", F.lit(False)) & F.col("found").isNull()
    return rows.select(*[(F.col("unreadable") | failed).alias(c) if c == "unreadable" else F.col(c) for c in nodes.columns], digest.alias("content_digest"))
