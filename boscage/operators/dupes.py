"""Identical files and identical folders: identity, groups, holds, ranking, suggestions, reclaimable space."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boscage.functions import names, paths
from boscage.operators import tree
from boscage.sources.shared import materialize

MIN_SIZE, MAX_FOLDERS_COMPARED = 1_000_000, 512
SAMPLE = 65536
SMALL_FILE = 262144

# Folder names that tools manage, and extensions of folders that are one thing to a user (fixed values).
TOOL_FOLDERS = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".Trash", ".Trashes", "$RECYCLE.BIN", "RECYCLER", "System Volume Information", "lost+found",
    ".Spotlight-V100", ".fseventsd", ".DocumentRevisions-V100", ".TemporaryItems",
)
BUNDLE_EXTENSIONS = (
    "app", "appex", "framework", "bundle", "plugin", "kext", "dext", "xpc", "prefpane", "saver", "qlgenerator", "mdimporter", "component", "vst", "vst3", "driver", "docset", "dsym",
    "xcodeproj", "xcworkspace", "xcassets", "xcarchive", "xcdatamodeld", "xcframework", "playground", "photoslibrary", "photolibrary", "musiclibrary", "tvlibrary", "imovielibrary", "aplibrary", "fcpbundle",
    "logicx", "band", "sparsebundle", "rtfd", "pages", "numbers", "key", "scriv", "lrdata", "pkg", "mpkg", "pvm", "vmwarevm", "utm", "download", "nib", "storyboardc", "lproj",
)


def is_ignorable() -> Column:
    """A file (not a folder) that only keeps a folder's view settings."""
    return (F.col("kind") == "file") & (F.col("name") == ".DS_Store")


def is_tool_folder(name: Column) -> Column:
    return name.isin(*TOOL_FOLDERS) | name.startswith(".Trash-")


def is_bundle(name: Column) -> Column:
    """A dot not in front, and a known extension in any case."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).isin(*BUNDLE_EXTENSIONS)


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def is_comparable() -> Column:
    return ~(tree.blocked() | F.col("incomplete"))


def zones(nodes: DataFrame, include_hidden: bool = False, root_parts: int = 1, repo_roots: DataFrame | None = None) -> DataFrame:
    """Adds in_opaque, self_opaque, bundle, has_git, inside_repo, hidden_file. Roots are not classified by their own names.

    repo_roots: (root_ord) of roots that lie in a repository whose .git is above the scan.
    """
    below_root = F.size("path_parts") > root_parts
    opaque_name = lambda n: is_tool_folder(n) | (is_hidden(n) if not include_hidden else F.lit(False))
    self_opaque = below_root & (F.col("kind") == "dir") & (opaque_name(F.col("name")) | F.col("rule_ord").isNotNull())
    bundle = below_root & (F.col("kind") == "dir") & ~self_opaque & is_bundle(F.col("name"))
    # Names of ancestors below the root decide without a join; tags of ancestors need one.
    above = F.when(F.size("path_parts") > root_parts + 1, F.slice("path_parts", root_parts + 1, F.size("path_parts") - root_parts - 1)).otherwise(F.array().cast("array<string>"))
    named = F.exists(above, lambda n: opaque_name(n) | is_bundle(n))
    # Of the ancestors, those with a tag and those with a .git beside: one exploded pass.
    marks = nodes.where("kind = 'dir' and rule_ord is not null").select("root_ord", F.col("path_parts").alias("_up"), F.lit(True).alias("tag"), F.lit(False).alias("git"))
    marks = marks.unionByName(nodes.where("name = '.git'").select("root_ord", paths.parts(F.col("parent_path")).alias("_up"), F.lit(False).alias("tag"), F.lit(True).alias("git")))
    marks = marks.groupBy("root_ord", "_up").agg(F.bool_or("tag").alias("tag"), F.bool_or("git").alias("git"))
    up = nodes.select("root_ord", "path", F.explode(paths.prefixes(F.col("path_parts"), root_parts)).alias("_up")).join(marks.hint("merge"), ["root_ord", "_up"]).groupBy("root_ord", "path").agg(F.bool_or("tag").alias("_tag"), F.bool_or("git").alias("_git"))
    own_git = marks.where("git").select(F.col("_up").alias("_own"), F.lit(True).alias("_has"))
    rows = nodes.join(up.hint("merge"), ["root_ord", "path"], "left").join(own_git.hint("merge"), F.col("path_parts") == F.col("_own"), "left").drop("_own")
    if repo_roots is not None:
        rows = rows.join(F.broadcast(repo_roots.select("root_ord", F.lit(True).alias("_outer")).distinct()), "root_ord", "left")  # a row a root
    else:
        rows = rows.withColumn("_outer", F.lit(None).cast("boolean"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        *nodes.columns,
        (named | yes("_tag")).alias("in_opaque"),
        self_opaque.alias("self_opaque"),
        bundle.alias("bundle"),
        yes("_has").alias("has_git"),
        (yes("_git") | yes("_outer")).alias("inside_repo"),
        ((F.col("kind") != "dir") & below_root & is_hidden(F.col("name")) & F.lit(not include_hidden)).alias("hidden_file"),
    )


# Identity of content --------------------------------------------------------------------------------------------------


def _le64(value: Column) -> Column:
    """A long as 8 bytes, least significant first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def file_digest(content: Column, fork: Column | None = None) -> Column:
    """SHA-256 of the content; where a fork exists, of the content, a marker, the fork's size and the fork."""
    if fork is None:
        return F.sha2(content, 256)
    marked = F.concat(content, _le64(F.lit(0x52535243464F524B).cast("bigint")), _le64(F.octet_length(fork).cast("bigint")), fork)
    return F.sha2(F.when(fork.isNull(), content).otherwise(marked), 256)


def sample_digest(content: Column) -> Column:
    """SHA-256 of the first and the last 64 KiB."""
    return F.sha2(F.concat(F.substring(content, 1, SAMPLE), F.substring(content, -SAMPLE, SAMPLE)), 256)


def link_digest(target: Column) -> Column:
    return F.sha2(F.concat(F.lit("L"), target), 256)


def stream_identity(dev: Column, clone_id: Column, size: Column) -> Column:
    """A name for a data stream that was matched by storage and never read. It is not a hash."""
    return F.concat_ws(":", F.lit("stream"), dev.cast("string"), clone_id.cast("string"), size.cast("string"))


def cascade(files: DataFrame, small: int = SMALL_FILE) -> DataFrame:
    """Candidate files with what identifies them: size runs, shared streams, samples, full reads.

    Adds stream, stage and identity, identity_kind. Stages: empty (known without reading), unique (no other file of its size), stream (all of its size share
    storage), read (small, or with a fork: read in full at once), sample (its sample is alone), clones (so is it, but it has several names) and full (read in full after
    its sample). files: nodes of kind file with content.
    """
    merge = F.col("maybe_shared") & ~F.col("resource_fork")
    stream = F.when(merge, F.concat_ws(":", F.lit("c"), "dev", "clone_id")).otherwise(F.concat_ws(":", F.lit("f"), "root_ord", "path"))
    empty = (F.col("own_size") == 0) & ~F.col("resource_fork")
    rows = files.withColumn("stream", stream)
    sizes = rows.where(~empty).groupBy("own_size").agg(F.count("*").alias("_n"), F.count_distinct("stream").alias("_streams"))
    several = rows.where(~empty).groupBy("own_size", "stream").agg(F.count("*").alias("_names"))
    rows = rows.join(sizes.hint("merge"), "own_size", "left").join(several.hint("merge"), ["own_size", "stream"], "left")
    at_once = (F.col("own_size") <= small) | F.col("resource_fork")
    rows = rows.withColumn("_sample", F.when(~empty & (F.col("_streams") > 1) & ~at_once, sample_digest(F.col("content"))))
    alike = rows.where("_sample is not null").groupBy("own_size", "_sample").agg(F.count_distinct("stream").alias("_alike"))
    rows = rows.join(alike.hint("merge"), ["own_size", "_sample"], "left")
    stage = (
        F.when(empty, "empty").when(F.col("_n") == 1, "unique").when(F.col("_streams") == 1, "stream").when(at_once, "read").when(F.col("_alike") > 1, "full").when(F.col("_names") > 1, "clones").otherwise("sample")
    )
    rows = rows.withColumn("stage", stage)
    read = F.col("stage").isin("empty", "read", "full")
    matched = F.col("stage").isin("stream", "clones")
    full = file_digest(F.col("content"), F.when(F.col("resource_fork"), F.col("fork")))
    return rows.select(
        *files.columns,
        "stream",
        "stage",
        F.when(read, full).when(matched, stream_identity(F.col("dev"), F.col("clone_id"), F.col("own_size"))).alias("identity"),
        F.when(read, "sha256").when(matched, "stream").alias("identity_kind"),
    )


def cascade_stats(rows: DataFrame) -> DataFrame:
    """Counters of a cascade: candidate files, streams sampled or read, streams read in full with their bytes, files matched without reading."""
    # One row a stream and stage, then one row.
    per = rows.groupBy("own_size", "stream", "stage").agg(F.count("*").alias("n"))
    jobs = F.col("stage").isin("read", "sample", "clones", "full")
    whole = F.col("stage").isin("read", "full")
    zero = F.lit(0).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("n"), zero).alias("candidate_files"),
        F.count_if(jobs).alias("sampled_files"),
        F.count_if(whole).alias("hashed_files"),
        F.coalesce(F.sum(F.when(whole, F.col("own_size"))), zero).alias("hashed_bytes"),
        F.coalesce(F.sum(F.when(F.col("stage").isin("stream", "clones"), F.col("n"))), zero).alias("stream_matched_files"),
    )


# Folders --------------------------------------------------------------------------------------------------------------


def _bag(value: Column) -> list[Column]:
    """Four 60-bit numbers of a hash; their sums identify a bag of values whatever its order."""
    return [F.conv(F.substring(value, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def _folder_hash(nodes: DataFrame, leaf: Column, root_parts: int) -> DataFrame:
    """(root_ord, path, hash): equal exactly where the bags of (relative path, kind, leaf) of all that counts below are equal; null where any leaf is.

    Sums merge in partial aggregation, so the top folder is no larger a group than any other.
    """
    rows = nodes.where(~is_ignorable()).withColumn("_leaf", F.when(F.col("kind") == "dir", F.lit("")).otherwise(leaf))
    below = rows.select("root_ord", F.explode(paths.prefixes(F.col("path_parts"), root_parts)).alias("up"), "path_parts", "kind", "_leaf", (tree.blocked() | (F.col("kind") == "other")).alias("_bad"))
    rel = F.array_join(F.slice("path_parts", F.size("up") + 1, F.size("path_parts")), "/")
    entry = F.sha2(F.concat(F.length(rel).cast("string"), F.lit(":"), rel, F.lit(":"), "kind", F.lit(":"), F.coalesce("_leaf", F.lit(""))), 256)
    sums = below.select("root_ord", "up", entry.alias("e"), (F.col("_leaf").isNull() | F.col("_bad")).alias("bad")).groupBy("root_ord", "up").agg(
        F.count("*").alias("n"), F.bool_or("bad").alias("bad"), *[F.sum(v).alias(f"b{i}") for i, v in enumerate(_bag(F.col("e")))]
    )
    hashed = sums.select("root_ord", paths.joined(F.col("up")).alias("path"), F.when(~F.col("bad"), F.sha2(F.concat_ws(",", "n", "b0", "b1", "b2", "b3"), 256)).alias("hash"))
    # A folder in which nothing counts has an identity too.
    empty = F.sha2(F.lit("0"), 256)
    folders = nodes.where("kind = 'dir'").select("root_ord", "path", tree.blocked().alias("_self"))
    return folders.join(hashed.withColumn("_any", F.lit(True)).hint("merge"), ["root_ord", "path"], "left").select("root_ord", "path", F.when(~F.col("_self"), F.when(F.col("_any"), F.col("hash")).otherwise(empty)).alias("hash"))


def structure_signature(nodes: DataFrame, root_parts: int = 1) -> DataFrame:
    """(root_ord, path, signature) of folders by names, kinds and sizes below."""
    return _folder_hash(nodes, F.when(F.col("kind").isin("file", "symlink"), F.col("own_size").cast("string")), root_parts).withColumnRenamed("hash", "signature")


def folder_digest(nodes: DataFrame, root_parts: int = 1) -> DataFrame:
    """(root_ord, path, digest) of folders by content below. nodes has digest for files and links."""
    return _folder_hash(nodes, F.col("digest"), root_parts).withColumnRenamed("hash", "digest")


def structure_twins(signatures: DataFrame) -> DataFrame:
    """Folders whose structure occurs elsewhere too."""
    counts = signatures.where("signature is not null").groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    return signatures.join(counts.hint("merge"), "signature")


def candidate_folders(nodes: DataFrame, signatures: DataFrame, root_parts: int = 1) -> DataFrame:
    """Folders whose contents must be hashed: twins, and what lies in tool-managed folders inside a folder that is one. nodes has zones."""
    twins = structure_twins(signatures).select("root_ord", "path")
    rows = nodes.where("kind = 'dir'").join(twins.withColumn("_twin", F.lit(True)).hint("merge"), ["root_ord", "path"], "left")
    open_twins = rows.where("_twin and not in_opaque and not self_opaque").select("root_ord", "path", "path_parts")
    # An opaque folder inherits from its nearest ancestor that is open.
    opaque = rows.where("in_opaque or self_opaque")
    ups = opaque.select("root_ord", "path", F.explode(paths.prefixes(F.col("path_parts"), root_parts)).alias("_up"))
    opens = rows.where("not in_opaque and not self_opaque").select("root_ord", F.col("path_parts").alias("_up"), F.coalesce("_twin", F.lit(False)).alias("_need"))
    nearest = ups.join(opens.hint("merge"), ["root_ord", "_up"]).groupBy("root_ord", "path").agg(F.max_by("_need", F.size("_up")).alias("need")).where("need")
    return open_twins.select("root_ord", "path").unionByName(nearest.select("root_ord", "path"))


# Groups ---------------------------------------------------------------------------------------------------------------


def is_reportable_file(min_size: int) -> Column:
    return (F.col("kind") == "file") & (F.col("own_size") >= max(min_size, 1)) & ~F.col("in_opaque") & ~F.col("hidden_file") & ~(F.col("unreadable") | F.col("pruned") | F.col("dataless"))


def is_reportable_folder(min_size: int) -> Column:
    return (F.col("kind") == "dir") & F.col("digest").isNotNull() & ~F.col("in_opaque") & ~F.col("self_opaque") & (F.col("total_size") >= max(min_size, 1))


def members(nodes: DataFrame, min_size: int = MIN_SIZE, include_files: bool = True, include_folders: bool = True) -> DataFrame:
    """Members of groups of identical files or folders: kind, digest, and the node's columns, with nested.

    nodes has zones, totals and digest (of files, links and folders). A group whose members all lie in duplicate folders is left out.
    """
    take = (is_reportable_folder(min_size) & F.lit(include_folders)) | (is_reportable_file(min_size) & F.lit(include_files) & F.col("digest").isNotNull())
    rows = nodes.where(take)
    sizes = rows.groupBy("kind", "digest").agg(F.count("*").alias("n_members")).where("n_members > 1")
    rows = rows.join(sizes.hint("merge"), ["kind", "digest"])
    twins = rows.where("kind = 'dir'").select("root_ord", F.col("path").alias("parent_path"), F.lit(True).alias("_dup")).distinct()
    rows = rows.join(twins.hint("merge"), ["root_ord", "parent_path"], "left").withColumn("nested", F.coalesce("_dup", F.lit(False))).drop("_dup")
    alive = rows.groupBy("kind", "digest").agg(F.bool_and("nested").alias("_all")).where("not _all").select("kind", "digest")
    return rows.join(alive.hint("merge"), ["kind", "digest"], "left_semi")


def _shared_names(found: DataFrame, pairs: DataFrame, entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, digest, root_ord, path) of members whose folder resembles another one, of pairs (kind, digest, fa, fb, first): fa the member's folder, first the first member of fb."""
    key = ["kind", "digest"]
    # Names in common, once for two folders however many groups they meet in, from the entries of the smaller one.
    two = pairs.select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb")).distinct()
    for side in ("fa", "fb"):
        two = two.join(counts.withColumnsRenamed({"f": side, "n": f"n_{side}"}).hint("merge"), side)
    less = F.col("n_fa") <= F.col("n_fb")
    named = two.withColumn("f", F.when(less, F.col("fa")).otherwise(F.col("fb"))).withColumn("other", F.when(less, F.col("fb")).otherwise(F.col("fa"))).join(entries.hint("merge"), "f")
    named = named.drop("f").join(entries.withColumnRenamed("f", "other").hint("merge"), ["other", "name"])
    shared = named.groupBy("fa", "fb", "n_fa", "n_fb").agg(F.count("*").alias("shared"))
    shared = shared.unionByName(shared.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"), F.col("n_fb").alias("n_fa"), F.col("n_fa").alias("n_fb"), "shared"))
    shared = pairs.join(shared.hint("merge"), ["fa", "fb"])
    mine = found.select(*key, "root_ord", "path", "name", F.struct("root_ord", F.col("parent_path").alias("folder")).alias("fa"))
    # Whether the other folder has an entry of the member's own name, and the member's folder one of the other's first member's.
    there = lambda side, name, flag: entries.select(F.col("f").alias(side), F.col("name").alias(name), F.lit(True).alias(flag)).hint("merge")
    own = mine.join(shared.hint("merge"), [*key, "fa"]).join(there("fb", "name", "_there"), ["fb", "name"], "left").join(there("fa", "first", "_first"), ["fa", "first"], "left")
    n = F.col("shared") - F.coalesce("_there", F.lit(False)).cast("int") - (F.coalesce("_first", F.lit(False)) & (F.col("first") != F.col("name"))).cast("int")
    smaller = F.least(F.col("n_fa") - 1, F.col("n_fb") - 1)
    return own.where((n >= 3) | ((n >= 1) & (n * 10 >= smaller * 3))).select(*key, "root_ord", "path").distinct()


def _resemblance_by_names(found: DataFrame, folders: DataFrame, entries: DataFrame, counts: DataFrame) -> DataFrame:
    """What _shared_names gives of all pairs of folders of a group, without making them. found: members of groups with many folders; folders: their kind, digest, f, first, n_members.

    A member needs one other folder only. So it is compared with two folders of its group, then with two that have one of its names, and what then is left with all those that can resemble it:
    a folder of up to 4 entries needs one name in common, which is told by counts a name, one of up to 7 needs two and others three. Of names in one order, rare ones first, each
    of two such folders has the first common name before its last one or two.
    """
    key = ["kind", "digest"]
    mine = lambda rows: rows.select(*key, "root_ord", "path", "name", F.struct("root_ord", F.col("parent_path").alias("folder")).alias("f"))
    left = lambda rows, done: materialize(rows.join(done.hint("merge"), [*key, "root_ord", "path"], "left_anti"), "undecided")
    partner = folders.select(*key, F.col("f").alias("fb"), "first")
    pairs = lambda rows: rows.select(*key, F.col("f").alias("fa"), F.explode(F.array("low", "high")).alias("fb")).where("fa <> fb").distinct().join(partner.hint("merge"), [*key, "fb"])
    ends = folders.groupBy(*key).agg(F.min("f").alias("low"), F.max("f").alias("high"))
    done = [materialize(_shared_names(found, pairs(folders.join(ends.hint("merge"), key)), entries, counts), "alike")]
    found = left(found, done[-1])
    # Entries of folders, without names that only one folder of the group has; need: names in common that a folder this small needs.
    need = F.when(F.col("n") <= 4, 1).when(F.col("n") <= 7, 2).otherwise(3)
    some = found.select(*key).distinct()
    rows = folders.join(some.hint("merge"), key, "left_semi").join(counts.hint("merge"), "f").withColumn("need", need).drop("n").join(entries.hint("merge"), "f")
    often = rows.groupBy(*key, "name").agg(F.count("*").alias("often")).where("often > 1")
    rows = materialize(rows.join(often.hint("merge"), [*key, "name"]), "names")
    # One name is enough: whether another folder has it, not as its first member, and one of the two is small.
    small = F.when(F.col("need") == 1, F.col("f"))
    held = rows.where("name <> first").groupBy(*key, "name").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.min(small).alias("small_low"), F.max(small).alias("small_high"))
    asked = rows.join(mine(found).select(*key, "f").distinct().hint("merge"), [*key, "f"], "left_semi")
    met = materialize(asked.join(held.hint("merge"), [*key, "name"]), "met")
    other = lambda low, high: F.coalesce((F.col(low) != F.col("f")) | (F.col(high) != F.col("f")), F.lit(False))
    one = met.where(F.when(F.col("need") == 1, other("low", "high")).otherwise(other("small_low", "small_high"))).select(*key, "f", "name")
    several = one.groupBy(*key, "f").agg(F.count("*").alias("n"))
    own = mine(found).join(several.hint("merge"), [*key, "f"]).join(one.withColumn("_own", F.lit(True)).hint("merge"), [*key, "f", "name"], "left")
    done.append(materialize(own.where(F.col("n") > F.coalesce("_own", F.lit(False)).cast("int")).select(*key, "root_ord", "path"), "alike"))
    found = left(found, done[-1])
    met = met.join(mine(found).select(*key, "f").distinct().hint("merge"), [*key, "f"], "left_semi")
    done.append(materialize(_shared_names(found, pairs(met), entries, counts), "alike"))
    found = left(found, done[-1])
    # All others. The name of a folder's only member counts on no side, that of the first member not on the other side.
    place = F.row_number().over(Window.partitionBy(*key, "f").orderBy(F.desc("often"), "name"))
    asked = rows.join(mine(found).select(*key, "f").distinct().hint("merge"), [*key, "f"], "left_semi").where("n_members > 1 or name <> first").withColumn("place", place)
    a, b = (t.select(*key, "name", *[F.col(c).alias(f"{c}_{x}") for c in ("f", "need", "place")]) for t, x in ((asked, "a"), (rows.where("name <> first").withColumn("place", place), "b")))
    meet = lambda a, b: a.join(b.hint("merge"), [*key, "name"]).where("f_a <> f_b").select(*key, F.col("f_a").alias("fa"), F.col("f_b").alias("fb"))
    met = meet(a.where("need_a = 3 and place_a >= 3"), b.where("need_b = 3 and place_b >= 3"))
    met = met.unionByName(meet(a.where("need_a = 2 and place_a >= 2"), b.where("need_b >= 2 and place_b >= 2"))).unionByName(meet(a.where("need_a = 3 and place_a >= 2"), b.where("need_b = 2 and place_b >= 2")))
    done.append(_shared_names(found, met.distinct().join(partner.hint("merge"), [*key, "fb"]), entries, counts))
    return functools.reduce(DataFrame.unionByName, done)


def resemblance(found: DataFrame, nodes: DataFrame, most: int | None = None, by_pairs: int = MAX_FOLDERS_COMPARED) -> DataFrame:
    """(kind, digest, root_ord, path) of members whose folder resembles that of another member: 3 entry names in common, or 1 and 30 % of the smaller.

    The member itself is not counted on its side, nor the first member of the other folder on that side. Folders are compared in pairs in groups of up to by_pairs of them and by their
    names in larger ones, with the same result. With most, groups with more folders are left out: for rules that hold their members unseen.
    """
    key = ["kind", "digest"]
    of = lambda side: F.struct("root_ord", F.col("parent_path").alias("folder")).alias(side)
    folders = found.groupBy(*key, of("f")).agg(F.min_by("name", "path_parts").alias("first"), F.count("*").alias("n_members"))
    sizes = folders.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    if most is not None:
        sizes = sizes.where(F.col("n") <= most)
    entries = nodes.where(~is_ignorable() & (F.col("path") != "/")).select(of("f"), "name")
    counts = entries.groupBy("f").agg(F.count("*").alias("n"))
    few = folders.drop("n_members").join(sizes.where(F.col("n") <= by_pairs).select(*key).hint("merge"), key)
    pairs = few.select(*key, F.col("f").alias("fa")).join(few.withColumnRenamed("f", "fb").hint("merge"), key).where("fa <> fb")
    out = _shared_names(found, pairs, entries, counts)
    if most is not None and most <= by_pairs:
        return out
    many = materialize(sizes.where(F.col("n") > by_pairs).select(*key), "many")
    if many.isEmpty():
        return out
    folders = materialize(folders.join(many.hint("merge"), key), "folders")
    return out.unionByName(_resemblance_by_names(found.join(many.hint("merge"), key, "left_semi"), folders, entries, counts))


def holds(found: DataFrame, nodes: DataFrame, containers: list[str] = (), root_parts: int = 1, most: int | None = None) -> DataFrame:
    """Members with hold: nested, repository, similarFolder, sibling, or null where a member stands on its own.

    All folders of a group are compared. With most, members in groups of more folders are held as similarFolder without comparing.
    """
    key = ["kind", "digest"]
    similar = resemblance(found, nodes, most).withColumn("_similar", F.lit(True))
    # Siblings: members of the same folder, as an array of names. A folder's members are compared by name only.
    sib = found.groupBy(*key, "root_ord", "parent_path").agg(F.collect_list("name").alias("_names"))
    rows, unseen = found.join(similar.hint("merge"), [*key, "root_ord", "path"], "left"), F.lit(False)
    if most is not None:
        rows = rows.join(found.groupBy(*key).agg(F.count_distinct("root_ord", "parent_path").alias("_folders")).hint("merge"), key)
        unseen = F.col("_folders") > most
    rows = rows.join(sib.hint("merge"), [*key, "root_ord", "parent_path"])
    me = F.col("name")
    like = names.has_copy_pattern(me) | F.exists(
        "_names", lambda o: (o != me) & (names.has_copy_pattern(o) | names.is_variant_name(me, o) | names.is_variant_name(o, me) | names.in_same_series(me, o))
    )
    alone = (F.size("path_parts") <= root_parts) | F.col("parent_path").isin(*containers) if containers else F.size("path_parts") <= root_parts
    hold = (
        F.when(F.col("nested"), "nested")
        .when(F.col("inside_repo"), "repository")
        .when(alone, F.lit(None).cast("string"))
        .when(F.coalesce("_similar", F.lit(False)) | unseen, "similarFolder")
        .when((F.size("_names") > 1) & ~like, "sibling")
    )
    return rows.withColumn("hold", hold).drop("_similar", "_folders", "_names")


def ranked(found: DataFrame, home: str, rule: str = "auto", prefer: list[str] = ()) -> DataFrame:
    """Members with score and rank among the unheld of their group, 1 being the best to keep."""
    key = ["kind", "digest"]
    if rule not in ("auto", "oldest", "newest"):
        raise ValueError(f"no such rule: {rule}")
    stem = names.stem(F.col("name"))
    free = F.col("hold").isNull()
    stems = found.where(free).groupBy(*key, stem.alias("_base")).agg(F.lit(True).alias("_there"))
    rows = found.withColumn("_base", names.numbered_base(stem)).join(stems.hint("merge"), [*key, "_base"], "left")
    score = names.copy_score(F.col("path"), home) + F.when(F.coalesce("_there", F.lit(False)), 2).otherwise(0)
    preferred = F.lit(False)
    for p in prefer:
        preferred = preferred | paths.is_same_or_inside(F.col("path"), F.lit(p))
    by_age = {"auto": [], "oldest": [F.col("mtime").asc()], "newest": [F.col("mtime").desc()]}[rule]
    w = Window.partitionBy(*key, "_free").orderBy(preferred.desc(), *by_age, "score", F.size("path_parts"), "mtime", "path")
    rows = rows.withColumn("_free", free).withColumn("score", score)
    return rows.withColumn("rank", F.when(F.col("_free"), F.row_number().over(w))).drop("_free", "_there", "_base")


def suggested(rows: DataFrame) -> DataFrame:
    """Adds suggested: all unheld members of a group with a hold, else all but the best ranked. rows: of ranked()."""
    key = ["kind", "digest"]
    held = rows.groupBy(*key).agg(F.bool_or(F.col("hold").isNotNull()).alias("_held"))
    return rows.join(held.hint("merge"), key).withColumn("suggested", F.col("hold").isNull() & (F.col("_held") | (F.col("rank") > 1))).drop("_held")


def needs_sequential(found: DataFrame, nodes: DataFrame) -> bool:
    """Whether a non-empty ignorable file lies below a duplicate folder: only then can copies differ in size, and the order of groups matter."""
    inside = nodes.where(is_ignorable() & (F.col("own_size") > 0)).select(F.explode(paths.prefixes(F.col("path_parts"))).alias("path_parts")).distinct()
    return found.where("kind = 'dir'").join(inside, "path_parts", "left_semi").limit(1).count() > 0


def suggest_in_order(groups: list[dict]) -> dict[str, bool]:
    """The exact rule, on the driver, largest group first: what went with a larger group is gone. groups: size, kind, members (path, hold, rank, depth)."""
    gone: set[str] = set()

    def is_gone(path: str) -> bool:
        while path and path != "/":
            if path in gone:
                return True
            path = path.rsplit("/", 1)[0]
        return False

    out: dict[str, bool] = {}
    for g in sorted(groups, key=lambda g: (-g["size"], g["kind"] != "dir", min(m["depth"] for m in g["members"]))):
        live = [m for m in g["members"] if not is_gone(m["path"])]
        held = [m for m in live if m["hold"] is not None]
        free = sorted((m for m in live if m["hold"] is None), key=lambda m: m["rank"])
        going = free if held else free[1:]
        out |= {m["path"]: False for m in g["members"]} | {m["path"]: True for m in going}
        gone |= {m["path"] for m in going}
    return out


# Reclaimable space ----------------------------------------------------------------------------------------------------


def _below(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """What lies in the folders among the members, and the file members themselves (rel ''): kind, digest, member, selected, rel, entry (its kind), dev, clone_id, alloc, size."""
    key = ["kind", "digest"]
    told = [F.col("kind").alias("entry"), "dev", "clone_id", F.col("own_alloc").alias("alloc"), F.col("own_size").alias("size")]
    files = rows.where("kind = 'file'").select(*key, F.col("path").alias("member"), "selected", F.lit("").alias("rel"), *told)
    tops = rows.where("kind = 'dir'").select(*key, F.col("path").alias("member"), F.col("path_parts").alias("_up"), "selected", "root_ord")
    below = nodes.where(~is_ignorable()).select("root_ord", F.explode(paths.prefixes(F.col("path_parts"))).alias("_up"), "path_parts", *told)
    below = below.join(tops.hint("merge"), ["root_ord", "_up"]).where(F.size("path_parts") > F.size("_up"))
    return files.unionByName(below.select(*key, "member", "selected", F.array_join(F.slice("path_parts", F.size("_up") + 1, F.size("path_parts")), "/").alias("rel"), "entry", "dev", "clone_id", "alloc", "size"))


def _alignment(rows: DataFrame, below: DataFrame) -> DataFrame:
    """Of groups in which anything lies: kind, digest, aligned: whether each place has an entry of the same kind in all members, be it a file, a folder or a link."""
    key = ["kind", "digest"]
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    places = below.groupBy(*key, "rel", "entry").agg(F.count("*").alias("_at"))
    return places.join(n.hint("merge"), key).groupBy(*key).agg(F.bool_and(F.col("_at") == F.col("_n")).alias("aligned"))


def aligned_files(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The files of every member by their place in it: kind, digest, member, selected, rel, dev, clone_id, alloc, size, and aligned: whether the members of the group line up entry by entry."""
    below = _below(rows, nodes)
    return below.where("entry = 'file'").drop("entry").join(_alignment(rows, below).hint("merge"), ["kind", "digest"])


def reclaim(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per group: freed and shared bytes if the selected members went. rows has selected; nodes the whole catalog.

    At each place, a removed file frees its bytes unless a kept copy, or an earlier removed one, has its storage. Where members no longer line up, the
    sums of the removed members' bytes are freed and nothing is shared.
    """
    key = ["kind", "digest"]
    below = _below(rows, nodes)
    files = below.where("entry = 'file'")
    n = rows.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("selected"), F.col("total_alloc"))), F.lit(0)).alias("_whole"))
    storage = files.groupBy(*key, "rel", "dev", "clone_id").agg(
        F.bool_or(~F.col("selected")).alias("kept"), F.sum(F.when(F.col("selected"), F.col("alloc"))).alias("going"), F.min_by("alloc", F.when(F.col("selected"), F.col("member"))).alias("first")
    )
    sums = storage.where("going is not null").groupBy(*key).agg(
        F.sum(F.when(F.col("kept"), 0).otherwise(F.col("first"))).alias("freed"), F.sum(F.col("going") - F.when(F.col("kept"), 0).otherwise(F.col("first"))).alias("shared")
    )
    zero = F.lit(0).cast("bigint")
    even = F.coalesce("aligned", F.lit(True))
    return n.join(_alignment(rows, below).hint("merge"), key, "left").join(sums.hint("merge"), key, "left").select(*key, F.when(even, F.coalesce("freed", zero)).otherwise(F.col("_whole")).alias("freed"), F.when(even, F.coalesce("shared", zero)).otherwise(zero).alias("shared"))


def groups(rows: DataFrame, freed: DataFrame) -> DataFrame:
    """One row a group with its members in order, largest gain first."""
    key = ["kind", "digest"]
    member = F.struct("path", "hold", "suggested", "nested", "mtime", "rank")
    out = rows.groupBy(*key).agg(
        F.min_by(F.col("total_size"), F.struct("root_ord", "path_parts")).alias("size"), F.min_by(F.col("file_count"), F.struct("root_ord", "path_parts")).alias("file_count"), F.sort_array(F.collect_list(member)).alias("members")
    )
    out = out.join(freed.hint("merge"), key).withColumnsRenamed({"freed": "reclaimable"})
    return out.orderBy(F.desc("reclaimable"), F.desc(F.col("size") * (F.size("members") - 1)), F.col("members")[0]["path"])


def undecided(rows: DataFrame) -> DataFrame:
    """Bytes that stay although only one copy is needed: per group size times (members that stay, not nested, less the one needed), summed."""
    stays = F.count_if(~F.col("nested") & ~F.col("selected"))
    needed = F.when(F.bool_or("nested"), 0).otherwise(1)
    return rows.groupBy("kind", "digest").agg((F.min("total_size") * F.greatest(F.lit(0), stays - needed)).alias("u")).agg(F.coalesce(F.sum("u"), F.lit(0)).alias("undecided_bytes"))


def without_survivor(rows: DataFrame) -> DataFrame:
    """Groups whose selection leaves no copy: every member is selected, or lies in something selected in any group. rows has selected."""
    gone = path_gone(rows.select("path", "path_parts"), rows.where("selected").select("path"))
    left = rows.join(gone.hint("merge"), "path", "left_anti").where("not selected").select("kind", "digest").distinct()
    return rows.where("selected").select("kind", "digest").distinct().join(left.hint("merge"), ["kind", "digest"], "left_anti")


def path_gone(wanted: DataFrame, removed: DataFrame) -> DataFrame:
    """The paths of wanted that are in removed (path), or below one of them."""
    ups = wanted.select("path", F.explode(F.array_append(F.transform(paths.prefixes(paths.parts(F.col("path"))), paths.joined), F.col("path"))).alias("up"))
    return ups.join(removed.select(F.col("path").alias("up")).distinct().hint("merge"), "up", "left_semi").select("path").distinct()


def clone_selection(rows: DataFrame) -> DataFrame:
    """Default selection for cloning: all but nested members and the keeper; the keeper is the first not nested and not suggested, and none if any member is nested."""
    key = ["kind", "digest"]
    any_nested = rows.groupBy(*key).agg(F.bool_or("nested").alias("_nested"), F.min(F.when(~F.col("nested") & ~F.col("suggested"), F.col("path"))).alias("_keeper"))
    keeper = F.when(~F.col("_nested"), F.col("_keeper"))
    return rows.join(any_nested.hint("merge"), key).withColumn("selected", ~F.col("nested") & F.coalesce(F.col("path") != keeper, F.lit(True))).drop("_nested", "_keeper")
