"""Regenerable data: build output by rules and evidence, known cache locations, safety and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boscage.functions import paths
from boscage.operators import dupes, junk_rules

MIN_SIZE, ACTIVE_WINDOW, LEVELS_UP = 10_000_000, 7 * 86400, 4


def artifact_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, r[0], r[1], list(r[2]), r[3], *[list(x) for x in r[4:9]], r[9], r[10]) for i, r in enumerate(junk_rules.ARTIFACTS)]
    return spark.createDataFrame(rows, junk_rules.ARTIFACT_SCHEMA)


def known_locations(spark: SparkSession, home: str) -> DataFrame:
    return spark.createDataFrame(junk_rules.locations(home), junk_rules.LOCATION_SCHEMA)


def cache_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(junk_rules.LABELS), junk_rules.LABEL_SCHEMA)


def _shown(nodes: DataFrame, wanted: list[tuple[str, tuple[str, ...]]], suffixes: tuple[str, ...]) -> DataFrame:
    """Per directory the evidence rules ask for, as arrays that hold only names (and suffixes) some rule mentions."""
    names = sorted({n for _, ns in wanted for n in ns})
    rows = nodes.where("path <> '/'")
    ends = F.array_compact(F.array(*[F.when(F.col("name").endswith(x) & (F.length("name") > len(x)), x) for x in suffixes]))
    return rows.groupBy("root_ord", "parent_path").agg(
        F.collect_set(F.when(F.col("name").isin(*names), F.col("name"))).alias("entries"), F.array_distinct(F.flatten(F.collect_set(F.when(F.size(ends) > 0, ends)))).alias("endings")
    )


def artifact_matches(nodes: DataFrame, rules: DataFrame, home: str = "/nohome") -> DataFrame:
    """Directories that are build output: root_ord, path, rule_ord, unpinned. The first rule in table order wins, exact names before prefixes.

    Evidence beside and inside comes from the catalog: a set of the mentioned names for each directory, at most as many as the rules mention.
    """
    groups = [("x", tuple(n for r in junk_rules.ARTIFACTS for k in (4, 6, 7, 8) for n in r[k]))]
    suffixes = tuple(sorted({n for r in junk_rules.ARTIFACTS for n in r[5]}))
    shown = _shown(nodes, groups, suffixes)
    # The rules are a small table of constants: broadcasting them is bounded.
    exact = rules.select("*", F.explode("names").alias("rule_name"), F.lit(False).alias("by_prefix"))
    dirs = nodes.where("kind = 'dir' and path <> '/'").select("root_ord", "path", "parent_path", "name")
    hits = dirs.join(F.broadcast(exact), F.col("name") == F.col("rule_name")).drop("rule_name")
    prefix = dirs.join(F.broadcast(rules.where("name_prefix is not null").withColumn("by_prefix", F.lit(True))), F.startswith("name", F.col("name_prefix")))
    hits = hits.unionByName(prefix)
    beside = shown.withColumnsRenamed({"entries": "near", "endings": "near_ends"})
    within = shown.select("root_ord", F.col("parent_path").alias("path"), F.col("entries").alias("deep"))
    none = F.array().cast("array<string>")
    hits = hits.join(beside.hint("merge"), ["root_ord", "parent_path"], "left").join(within.hint("merge"), ["root_ord", "path"], "left")
    near, ends, deep = (F.coalesce(c, none) for c in ("near", "near_ends", "deep"))
    any_of = lambda need, have: F.arrays_overlap(need, have)
    ok = F.forall("all_siblings", lambda n: F.array_contains(near, n))
    ok &= ((F.size("siblings") == 0) & (F.size("sibling_suffixes") == 0)) | any_of(F.col("siblings"), near) | any_of(F.col("sibling_suffixes"), ends)
    ok &= (F.size("inside") == 0) | any_of(F.col("inside"), deep)
    first = Window.partitionBy("root_ord", "path").orderBy("by_prefix", "rule_ord")
    won = hits.where(ok).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return won.join(pins(won, shown, home).hint("merge"), ["root_ord", "path"], "left").select("root_ord", "path", "rule_ord", (~F.coalesce("pinned", F.lit(False))).alias("unpinned"))


def pins(won: DataFrame, shown: DataFrame, home: str) -> DataFrame:
    """Matched directories with pinned: no lock files to look for, or one beside or up to four levels above, not in home."""
    up = paths.parts(F.col("parent_path"))
    levels = F.transform(F.sequence(F.lit(0), F.least(F.lit(LEVELS_UP), F.size(up))), lambda k: F.struct(k.alias("k"), F.when(F.size(up) - k > 0, paths.joined(F.slice(up, F.lit(1), F.size(up) - k))).otherwise("/").alias("at")))
    looks = won.where(F.size("lockfiles") > 0).select("root_ord", "path", "parent_path", "lockfiles", F.explode(levels).alias("l")).select("root_ord", "path", "lockfiles", "parent_path", "l.*")
    # Walking up ends at home, which is not consulted, unless the folder itself lies in home.
    stop = (F.col("k") > 0) & ((F.col("at") == home) | ~paths.is_same_or_inside(F.col("at"), F.lit(home)) & paths.is_same_or_inside(F.col("parent_path"), F.lit(home)))
    looks = looks.where(~stop).join(shown.select("root_ord", F.col("parent_path").alias("at"), "entries").hint("merge"), ["root_ord", "at"])
    found = looks.groupBy("root_ord", "path").agg(F.bool_or(F.arrays_overlap("lockfiles", "entries")).alias("pinned"))
    free = won.where(F.size("lockfiles") == 0).select("root_ord", "path", F.lit(True).alias("pinned"))
    return found.unionByName(free)


def tagged(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """The catalog with rule_ord and unpinned of matched directories; nothing below one is tagged again."""
    up = matches.select("root_ord", F.explode(paths.prefixes(paths.parts(F.col("path")))).alias("_up"), "path")
    inner = up.join(matches.select("root_ord", paths.parts(F.col("path")).alias("_up")).hint("merge"), ["root_ord", "_up"], "left_semi").select("root_ord", "path").distinct()
    outer = matches.join(inner.hint("merge"), ["root_ord", "path"], "left_anti")
    return nodes.drop("rule_ord", "unpinned").join(outer.hint("merge"), ["root_ord", "path"], "left").withColumn("unpinned", F.coalesce("unpinned", F.lit(False)))


def walk_prune(nodes: DataFrame, claimed: DataFrame, root_parts: int = 1) -> DataFrame:
    """The catalog without what a project search does not enter: below hidden folders, bundles, unowned node_modules and claimed folders, unless tagged.

    claimed: (parent_path, name). nodes is tagged. The folders themselves stay, as pruned. Inside a tagged folder everything stays.
    """
    rows = nodes.join(F.broadcast(claimed.distinct().withColumn("_c", F.lit(True))), ["parent_path", "name"], "left")  # a row a known location
    bad = (F.col("kind") == "dir") & (F.size("path_parts") > root_parts) & F.col("rule_ord").isNull()
    bad &= F.col("name").startswith(".") | (F.col("name") == "node_modules") | F.coalesce("_c", F.lit(False)) | dupes.is_bundle(F.col("name"))
    rows = rows.withColumn("_bad", bad).drop("_c")
    marks = rows.where("_bad or (kind = 'dir' and rule_ord is not null)").select("root_ord", F.col("path_parts").alias("_up"), F.col("_bad").alias("_b"))
    ups = rows.select("root_ord", "path", F.explode(paths.prefixes(F.col("path_parts"), root_parts)).alias("_up")).join(marks, ["root_ord", "_up"])
    # The outermost decision above a node holds.
    top = ups.groupBy("root_ord", "path").agg(F.min_by("_b", F.size("_up")).alias("_gone"), F.lit(True).alias("_in"))
    rows = rows.join(top, ["root_ord", "path"], "left").where(~F.coalesce("_gone", F.lit(False)))
    return rows.withColumn("pruned", F.col("pruned") | (F.col("_bad") & F.col("_in").isNull())).drop("_bad", "_gone", "_in")


def last_used(nodes: DataFrame) -> DataFrame:
    """Per tagged directory when its project was last touched: the newest of the folder around it and its untagged siblings. nodes is tagged."""
    around = nodes.where("rule_ord is null and path <> '/'").groupBy("root_ord", "parent_path").agg(F.max("mtime").alias("_newest"))
    parent = nodes.select("root_ord", F.col("path").alias("parent_path"), F.col("mtime").alias("_parent"))
    return nodes.where("rule_ord is not null").join(parent, ["root_ord", "parent_path"]).join(around, ["root_ord", "parent_path"], "left").select("root_ord", "path", F.greatest("_parent", "_newest").alias("last_used"))


ITEM_COLUMNS = ("id", "category", "title", "targets", "contents_only", "size", "file_count", "safety", "note", "last_used", "partial")


def artifact_items(nodes: DataFrame, rules: DataFrame, now: int, min_size: int = MIN_SIZE, older_than: float | None = None, active_window: float = ACTIVE_WINDOW) -> DataFrame:
    """Findings for build output. nodes is tagged and has totals."""
    rows = nodes.where((F.col("kind") == "dir") & F.col("rule_ord").isNotNull() & (F.col("total_alloc") >= min_size))
    rows = rows.join(last_used(nodes), ["root_ord", "path"]).join(F.broadcast(rules.select("rule_ord", "id", F.col("title").alias("rule_title"), "caution", "restore")), "rule_ord")
    idle = F.lit(now) - F.col("last_used")
    if older_than is not None:
        rows = rows.where(idle >= older_than)
    restore = F.concat(F.lit("Restore: "), "restore")
    note = (
        F.when(F.col("caution").isNotNull(), F.concat("caution", F.lit(". "), restore))
        .when(F.col("unpinned"), F.concat(F.lit("No lockfile nearby, so a reinstall may pick different versions. "), restore))
        .when(idle < active_window, F.concat(F.lit("Project in active use; it would need: "), "restore"))
        .otherwise(restore)
    )
    safe = F.col("caution").isNull() & ~F.col("unpinned") & (idle >= active_window)
    return rows.select(
        "id", F.lit("projects").alias("category"), F.col("rule_title").alias("title"), F.array("path").alias("targets"), F.lit(False).alias("contents_only"), F.col("total_alloc").alias("size"), "file_count",
        F.when(safe, "safe").otherwise("review").alias("safety"), note.alias("note"), "last_used", F.col("incomplete").alias("partial"),
    )


def location_items(nodes: DataFrame, locations: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Findings for known locations measured whole. nodes has totals."""
    each = locations.where("mode in ('contents', 'item')").select("*", F.posexplode("paths").alias("place", "path"))
    found = nodes.join(F.broadcast(each), "path")  # a row a known path
    bad = F.col("unreadable") | F.col("incomplete")
    sums = found.groupBy("ord", "id", "category", "title", "safety", "note", "mode").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("targets"),
        F.sum("total_alloc").alias("size"), F.sum("file_count").alias("file_count"), F.bool_or(bad).alias("partial"),
    )
    sums = sums.where((F.col("size") >= min_size) | F.col("partial"))
    return sums.withColumn("contents_only", F.col("mode") == "contents").withColumn("last_used", F.lit(None).cast("bigint")).select(*ITEM_COLUMNS)


def child_items(nodes: DataFrame, locations: DataFrame, labels: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Findings for each entry of locations whose children count alone. nodes has totals and shared_extra."""
    each = locations.where("mode = 'children'").select("id", "category", F.col("title").alias("loc_title"), F.col("safety").alias("loc_safety"), F.col("note").alias("loc_note"), F.explode("paths").alias("loc_path"))
    tops = nodes.where("kind = 'dir'").select(F.col("path").alias("loc_path"), F.col("unreadable").alias("_closed"))
    each = tops.join(F.broadcast(each), "loc_path")  # a row a known path
    closed = each.where("_closed").select(
        "id", "category", F.col("loc_title").alias("title"), F.array("loc_path").alias("targets"), F.lit(True).alias("contents_only"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("file_count"),
        F.lit("info").alias("safety"), F.lit("Could not be read").alias("note"), F.lit(None).cast("bigint").alias("last_used"), F.lit(True).alias("partial"),
    )
    size = F.when(F.col("shared_extra"), 0).otherwise(F.col("total_alloc"))
    apple = F.col("name").startswith("com.apple.") & ~F.col("name").startswith("com.apple.dt.")
    rows = nodes.join(F.broadcast(each.where("not _closed")), F.col("parent_path") == F.col("loc_path")).where(~apple & (size >= min_size) & (F.col("kind") != "symlink")).join(F.broadcast(labels), "name", "left")
    rows = rows.select(
        "id", "category", F.coalesce("label", F.concat("loc_title", F.lit(" · "), "name")).alias("title"), F.array("path").alias("targets"), F.lit(False).alias("contents_only"), size.alias("size"), "file_count",
        F.coalesce("label_safety", "loc_safety").alias("safety"), F.coalesce("label_note", "loc_note").alias("note"), F.lit(None).cast("bigint").alias("last_used"), F.col("incomplete").alias("partial"),
    )
    return rows.unionByName(closed)


def sandbox_caches(nodes: DataFrame, home: str) -> DataFrame:
    """Locations of sandboxed apps' caches: LOCATION_SCHEMA rows."""
    top = home + "/Library/Containers/"
    name = F.regexp_extract(F.substring("path", F.lit(len(top) + 1), F.length("path")), "^([^/]+)/Data/Library/Caches$", 1)
    rows = nodes.where(F.col("path").startswith(top)).withColumn("_app", name).where("_app <> '' and _app not like 'com.apple.%' and _app <> 'com.docker.docker'")
    return rows.select(F.lit(1000).alias("ord"), F.lit("app-cache").alias("id"), F.lit("system").alias("category"), F.concat(F.lit("Cache · "), "_app").alias("title"), F.array("path").alias("paths"), F.lit("safe").alias("safety"), F.lit("Apps rebuild their caches when needed").alias("note"), F.lit("contents").alias("mode"))


def installers(nodes: DataFrame) -> DataFrame:
    rows = nodes.where("parent_path = '/Applications' and name like 'Install macOS%.app'")
    return rows.select(F.lit(1001).alias("ord"), F.lit("macos-installer").alias("id"), F.lit("large").alias("category"), F.expr("left(name, length(name) - 4)").alias("title"), F.array("path").alias("paths"), F.lit("review").alias("safety"), F.lit("macOS installer; download it again from the App Store if needed").alias("note"), F.lit("item").alias("mode"))


def claimed_names(locations: DataFrame, nodes: DataFrame, home: str) -> DataFrame:
    """(parent_path, name) of locations that exist, and of the home folders a project search leaves out."""
    there = locations.select(F.explode("paths").alias("path")).join(nodes.select("path"), "path", "left_semi")
    fixed = locations.sparkSession.createDataFrame([(home, "Library"), (home, "Applications")], "parent_path string, name string")
    return there.select(paths.parent(F.col("path")).alias("parent_path"), paths.basename(F.col("path")).alias("name")).unionByName(fixed).distinct()


def project_roots(roots: DataFrame, locations: DataFrame) -> DataFrame:
    """Roots (path) not inside a known location: every place above a root is looked up, so this stays an equi-join."""
    places = locations.select(F.explode("paths").alias("_up"))
    ups = roots.select("path", F.explode(F.array_append(F.transform(paths.prefixes(paths.parts(F.col("path"))), paths.joined), F.col("path"))).alias("_up"))
    return roots.join(ups.join(F.broadcast(places), "_up", "left_semi").select("path").distinct(), "path", "left_anti")


def category_order(category):
    """Place of a category in reports."""
    out = F.lit(len(junk_rules.CATEGORIES))
    for i, (k, _) in enumerate(junk_rules.CATEGORIES):
        out = F.when(category == k, i).otherwise(out)
    return out


def ordered(items: DataFrame) -> DataFrame:
    return items.orderBy(category_order(F.col("category")), F.desc("size"), paths.display_path(F.col("targets")))


def only_skip(items: DataFrame, only: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """Findings whose id or category is named in only (if any), and not in skip, in any case."""
    hit = lambda ids: F.lower("id").isin(*[i.lower() for i in ids]) | F.col("category").isin(*[i.lower() for i in ids])
    items = items.where(hit(only)) if only else items
    return items.where(~hit(skip)) if skip else items


def category_totals(items: DataFrame) -> DataFrame:
    total = lambda s: F.coalesce(F.sum(F.when(F.col("safety") == s, F.col("size"))), F.lit(0)).alias(s)
    return items.groupBy("category").agg(F.sum("size").alias("size"), F.count("*").alias("n_items"), total("safe"), total("review"), total("info"))


def totals(items: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return items.agg(F.coalesce(F.sum(F.when(F.col("safety") == "safe", F.col("size"))), zero).alias("safe"), F.coalesce(F.sum(F.when(F.col("safety") != "info", F.col("size"))), zero).alias("removable"))


def top_per_category(items: DataFrame, limit: int = 8) -> DataFrame:
    """The first findings of each category, and a row (rank null) with count and size of the rest."""
    w = Window.partitionBy("category").orderBy(F.desc("size"), paths.display_path(F.col("targets")))
    rows = items.withColumn("rank", F.row_number().over(w))
    shown = rows.where(F.col("rank") <= limit).select("category", "rank", "title", "size", F.lit(1).cast("bigint").alias("n_items"))
    rest = rows.where(F.col("rank") > limit).groupBy("category").agg(F.lit(None).cast("int").alias("rank"), F.lit("more findings").alias("title"), F.sum("size").alias("size"), F.count("*").alias("n_items"))
    return shown.unionByName(rest)


def selection(items: DataFrame, review: bool = False) -> DataFrame:
    return items.where((F.col("size") > 0) & F.col("safety").isin(*(["safe", "review"] if review else ["safe"])))


def to_json(items: DataFrame) -> DataFrame:
    """A JSON object a finding, keys sorted; absent notes and dates are left out."""
    return items.select(
        F.to_json(
            F.struct("category", F.col("file_count").alias("files"), "id", "note", "partial", F.col("targets").alias("paths"), F.col("last_used").alias("projectLastTouched"), "safety", "size", "title")
        ).alias("json")
    )
