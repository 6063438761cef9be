"""Queries over catalogs derived from the Parquet tables, with their SQL oracles (DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boscage.functions import names, paths, scalars
from boscage.operators import big, diff, dupes, excludes, junk, junk_rules, tree
from boscage.plans import actions, guardrails
from boscage.sources import derived
from boscage.sources.schema import complete, directories_of
from boscage.sources.shared import materialize

QUERIES: dict = {}
ORACLES: dict = {}
HOME = "/Users/me"


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) query, with the DuckDB statement of the same result."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Catalogs in SQL ------------------------------------------------------------------------------------------------------

_DOCS = """docs AS (
  SELECT '/docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, '/docs/' || source || '/' || lang AS parent_path, doc_id || '.txt' AS name,
         strlen(text)::BIGINT AS own_size, (ceil(strlen(text) / 4096.0) * 4096)::BIGINT AS own_alloc, 1704067200 + doc_id * 60 AS mtime, doc_id + 1000 AS inode,
         CASE WHEN doc_id % 7 = 0 THEN doc_id // 14 ELSE doc_id + 1000 END AS clone_id, doc_id % 7 = 0 AS maybe_shared, text, doc_id, source, lang FROM documents)"""
_EXTRA = """extra AS (
  SELECT *, maybe_shared AND row_number() OVER (PARTITION BY maybe_shared, clone_id ORDER BY string_split(path, '/')) > 1 AS shared_extra FROM docs)"""
_SALES = """lines AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS own_size, max(epoch(l_shipdate))::BIGINT AS mtime FROM lineitem GROUP BY 1, 2),
sales AS (SELECT '/sales/' || r_name || '/' || n_name || '/' || c_custkey || '/' || l_orderkey || '/' || l_linenumber AS path, ['sales', r_name, n_name, c_custkey::VARCHAR, l_orderkey::VARCHAR, l_linenumber::VARCHAR] AS parts, own_size, mtime
  FROM lines JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_ORDERS = """entries AS (SELECT l_orderkey, l_linenumber, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS content FROM lineitem GROUP BY 1, 2)"""
_PROJECTS = """q AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q, max(epoch(l_shipdate))::BIGINT AS mtime FROM lineitem GROUP BY 1, 2),
has AS (SELECT l_orderkey AS o, bool_or(l_linenumber = 1) AS h1, bool_or(l_linenumber = 2) AS h2, bool_or(l_linenumber = 3) AS h3, bool_or(l_linenumber = 4) AS h4, bool_or(l_linenumber = 5) AS h5, bool_or(l_linenumber = 6) AS h6, bool_or(l_linenumber = 7) AS h7,
  max(q) FILTER (l_linenumber = 2) * 1000 AS q2, max(q) FILTER (l_linenumber = 4) * 1000 AS q4, max(q) FILTER (l_linenumber = 5) * 1000 AS q5, max(q) FILTER (l_linenumber = 7) * 1000 AS q7,
  max(mtime) FILTER (l_linenumber = 1) AS m1, max(mtime) FILTER (l_linenumber = 2) AS m2, max(mtime) FILTER (l_linenumber = 3) AS m3, max(mtime) FILTER (l_linenumber = 5) AS m5, max(mtime) FILTER (l_linenumber = 6) AS m6 FROM q GROUP BY 1),
hits AS (SELECT o, '/work/' || o || '/node_modules' AS path, 0 AS rule_ord, NOT h3 AS unpinned, q2 AS size FROM has WHERE h2 AND h1
  UNION ALL SELECT o, '/work/' || o || '/target', 3, false, q4 FROM has WHERE h4
  UNION ALL SELECT o, '/work/' || o || '/build', 13, false, q5 FROM has WHERE h5 AND h6
  UNION ALL SELECT o, '/work/' || o || '/venv', 15, false, q7 FROM has WHERE h7)"""
#: An untagged sibling counts for freshness: package.json, yarn.lock, CMakeLists.txt, and folders no rule matched.
_FRESH = """fresh AS (SELECT o, greatest(0, coalesce(CASE WHEN h1 THEN m1 END, 0), coalesce(CASE WHEN h3 THEN m3 END, 0), coalesce(CASE WHEN h6 THEN m6 END, 0),
  coalesce(CASE WHEN h2 AND NOT h1 THEN m2 END, 0), coalesce(CASE WHEN h5 AND NOT h6 THEN m5 END, 0)) AS last_used FROM has)"""
#: The fixed clock of queries about ages.
NOW = 1_000_000_000


def _docs(spark, sf_dir):
    return tree.with_shared_extra(derived.docs_tree(spark, sf_dir))


def _q(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


# Content identity -----------------------------------------------------------------------------------------------------


@query(
    "dup_files",
    """SELECT sha256(text) AS digest, any_value(strlen(text))::BIGINT AS size, count(*) AS n_members FROM documents WHERE strlen(text) >= 1 GROUP BY sha256(text) HAVING count(*) >= 2""",
)
def dup_files(spark, sf_dir):
    files = derived.docs_files(spark, sf_dir).where("own_size >= 1")
    return files.groupBy(dupes.file_digest(F.col("content")).alias("digest")).agg(F.first("own_size").alias("size"), F.count("*").alias("n_members")).where("n_members >= 2")


@query("file_digest", _q("SELECT path, sha256(text) AS digest FROM docs", _DOCS))
def file_digest(spark, sf_dir):
    return derived.docs_files(spark, sf_dir).select("path", dupes.file_digest(F.col("content")).alias("digest"))


_ASCII = "f AS (SELECT doc_id, strlen(text) AS size, sha256(substring(text, 1, 65536) || right(text, 65536)) AS sample FROM documents WHERE length(text) = strlen(text) AND strlen(text) <= 65536)"


def _samples(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").where("char_length(text) = octet_length(text) and octet_length(text) <= 65536")
    return d.select("doc_id", F.octet_length("text").alias("size"), dupes.sample_digest(F.encode("text", "UTF-8")).alias("sample"))


@query("file_sample_digest", _q("SELECT doc_id, sample FROM f", _ASCII))
def file_sample_digest(spark, sf_dir):
    return _samples(spark, sf_dir).select("doc_id", "sample")


@query("link_digest", "SELECT page_id, sha256('L' || url) AS digest FROM pages")
def link_digest(spark, sf_dir):
    return derived.table(spark, sf_dir, "pages").select("page_id", dupes.link_digest(F.col("url")).alias("digest"))


@query(
    "file_digest_fork",
    r"""SELECT p_partkey, sha256(p_name::BLOB || '\x4B\x52\x4F\x46\x43\x52\x53\x52'::BLOB || unhex(printf('%02X00000000000000', strlen(p_type))) || p_type::BLOB) AS digest FROM part""",
)
def file_digest_fork(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part")
    return p.select("p_partkey", dupes.file_digest(F.encode("p_name", "UTF-8"), F.encode("p_type", "UTF-8")).alias("digest"))


@query("size_runs", _q("SELECT path, own_size FROM (SELECT *, count(*) OVER (PARTITION BY own_size) AS n FROM docs) WHERE n >= 2", _DOCS))
def size_runs(spark, sf_dir):
    files = derived.docs_files(spark, sf_dir)
    repeated = files.groupBy("own_size").agg(F.count("*").alias("n")).where("n >= 2").select("own_size")
    return files.join(repeated, "own_size").select("path", "own_size")


@query(
    "data_streams",
    _q("SELECT own_size, CASE WHEN maybe_shared THEN 'c:1:' || clone_id ELSE 'f:0:' || path END AS stream, count(*) AS n_files FROM docs GROUP BY 1, 2", _DOCS),
)
def data_streams(spark, sf_dir):
    return dupes.cascade(derived.docs_files(spark, sf_dir)).groupBy("own_size", "stream").agg(F.count("*").alias("n_files"))


_CASCADE = """s AS (SELECT *, CASE WHEN maybe_shared THEN 'c:1:' || clone_id ELSE 'f:0:' || path END AS stream FROM docs),
z AS (SELECT own_size, count(*) AS n, count(DISTINCT stream) AS streams FROM s WHERE own_size > 0 GROUP BY 1),
c AS (SELECT s.*, CASE WHEN s.own_size = 0 THEN 'empty' WHEN n = 1 THEN 'unique' WHEN streams = 1 THEN 'stream' ELSE 'read' END AS stage FROM s LEFT JOIN z USING (own_size))"""


@query(
    "stream_identity",
    _q("SELECT path, stage, CASE WHEN stage IN ('empty', 'read') THEN 'sha256' WHEN stage = 'stream' THEN 'stream' END AS identity_kind FROM c", _DOCS, _CASCADE),
)
def stream_identity(spark, sf_dir):
    return dupes.cascade(derived.docs_files(spark, sf_dir)).select("path", "stage", "identity_kind")


@query("sample_survivors", _q("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY size, sample) AS n FROM f) WHERE n >= 2", _ASCII))
def sample_survivors(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return rows.join(rows.groupBy("size", "sample").agg(F.count("*").alias("n")).where("n >= 2").drop("n"), ["size", "sample"]).select("doc_id")


_BYTES = "f AS (SELECT doc_id, strlen(text) AS size, sha256(unhex(left(hex(encode(text)), 131072) || right(hex(encode(text)), 131072))) AS sample FROM documents)"


def _all_samples(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").alias("size"), dupes.sample_digest(F.encode("text", "UTF-8")).alias("sample"))


@query("file_sample_digest_all", _q("SELECT doc_id, sample FROM f", _BYTES))
def file_sample_digest_all(spark, sf_dir):
    return _all_samples(spark, sf_dir).select("doc_id", "sample")


@query("sample_survivors_all", _q("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY size, sample) AS n FROM f) WHERE n >= 2", _BYTES))
def sample_survivors_all(spark, sf_dir):
    rows = _all_samples(spark, sf_dir)
    return rows.join(rows.groupBy("size", "sample").agg(F.count("*").alias("n")).where("n >= 2").drop("n"), ["size", "sample"]).select("doc_id")


@query(
    "dupes_stats",
    _q(
        """SELECT count(*)::BIGINT AS candidate_files, count(DISTINCT (own_size, stream)) FILTER (stage = 'read') AS sampled_files, count(DISTINCT (own_size, stream)) FILTER (stage = 'read') AS hashed_files,
           (SELECT coalesce(sum(own_size), 0)::BIGINT FROM (SELECT DISTINCT own_size, stream FROM c WHERE stage = 'read')) AS hashed_bytes, count(*) FILTER (stage = 'stream') AS stream_matched_files FROM c""",
        _DOCS,
        _CASCADE,
    ),
)
def dupes_stats(spark, sf_dir):
    return dupes.cascade_stats(dupes.cascade(derived.docs_files(spark, sf_dir)))


@query("contents_equal", "SELECT a.doc_id AS a, b.doc_id AS b, a.text = b.text AS equal FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def contents_equal(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    a, b = d.select(F.col("doc_id").alias("a"), F.col("content").alias("ca")), d.select(F.col("doc_id").alias("b"), F.col("content").alias("cb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", actions.contents_equal(F.col("ca"), F.col("cb")).alias("equal"))


# Tree -----------------------------------------------------------------------------------------------------------------


@query("node_path", _q("SELECT path FROM sales", _SALES))
def node_path(spark, sf_dir):
    return derived.sales_files(spark, sf_dir).select(paths.joined(F.col("path_parts")).alias("path"))


@query("node_depth", "SELECT page_id, len(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> ''))::INTEGER AS depth FROM pages")
def node_depth(spark, sf_dir):
    return derived.pages_files(spark, sf_dir).select(F.col("inode").alias("page_id"), paths.depth(F.col("path"), F.lit("/pages")).alias("depth"))


@query("node_children", _q("SELECT parent_path AS path, count(*) AS n_children, min(name) AS first_child, max(name) AS last_child FROM docs GROUP BY 1", _DOCS))
def node_children(spark, sf_dir):
    rows = tree.children(derived.docs_files(spark, sf_dir))
    return rows.select("path", F.size("names").cast("bigint").alias("n_children"), F.col("names")[0].alias("first_child"), F.element_at("names", -1).alias("last_child"))


@query(
    "node_child_lookup",
    _q("SELECT w.parent_path, w.name, docs.path FROM (SELECT '/docs/src' || (doc_id % 20) || '/en' AS parent_path, doc_id || '.txt' AS name FROM documents) w LEFT JOIN docs USING (parent_path, name)", _DOCS),
)
def node_child_lookup(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    wanted = d.select(F.concat(F.lit("/docs/src"), (F.col("doc_id") % 20).cast("string"), F.lit("/en")).alias("parent_path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return tree.child_named(derived.docs_files(spark, sf_dir), wanted)


@query(
    "node_at_path",
    _q("SELECT w.path, CASE WHEN docs.path IS NOT NULL THEN 'file' END AS kind FROM (SELECT '/docs/src' || (doc_id % 20) || '/en/' || doc_id || '.txt' AS path FROM documents) w LEFT JOIN docs USING (path)", _DOCS),
)
def node_at_path(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    wanted = d.select(F.concat(F.lit("/docs/src"), (F.col("doc_id") % 20).cast("string"), F.lit("/en/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return tree.at_paths(derived.docs_files(spark, sf_dir), wanted)


@query(
    "dir_evidence",
    _q("SELECT '/work/' || o AS parent_path, h1 AS has_0, h3 AS has_1, h1 AS ends_0 FROM has", _PROJECTS),
)
def dir_evidence(spark, sf_dir):
    nodes = derived.projects(spark, sf_dir).where("parent_path like '/work/%' and parent_path not like '/work/%/%'")
    return tree.evidence(nodes, ["package.json", "yarn.lock"], [".json"]).select("parent_path", "has_0", "has_1", "ends_0")


@query("shared_extra", _q("SELECT path, shared_extra FROM extra WHERE maybe_shared", _DOCS, _EXTRA))
def shared_extra(spark, sf_dir):
    return tree.with_shared_extra(derived.docs_files(spark, sf_dir)).where("maybe_shared").select("path", "shared_extra")


@query(
    "dir_rollup",
    _q("SELECT '/' || array_to_string(parts[1:k], '/') AS path, sum(own_size)::BIGINT AS total_size, sum(own_size)::BIGINT AS total_alloc, count(*) AS file_count, false AS incomplete FROM sales, (VALUES (1), (2), (3), (4), (5)) AS v(k) GROUP BY 1", _SALES),
)
def dir_rollup(spark, sf_dir):
    return tree.rollup(tree.with_shared_extra(derived.sales_files(spark, sf_dir))).select("path", "total_size", "total_alloc", "file_count", "incomplete")


@query(
    "dir_rollup_shared",
    _q(
        """SELECT CASE k WHEN 1 THEN '/docs' WHEN 2 THEN '/docs/' || source ELSE parent_path END AS path, sum(own_size)::BIGINT AS total_size, coalesce(sum(own_alloc) FILTER (NOT shared_extra), 0)::BIGINT AS total_alloc, count(*) AS file_count
           FROM extra, (VALUES (1), (2), (3)) AS v(k) GROUP BY 1""",
        _DOCS,
        _EXTRA,
    ),
)
def dir_rollup_shared(spark, sf_dir):
    return tree.rollup(tree.with_shared_extra(derived.docs_files(spark, sf_dir))).select("path", "total_size", "total_alloc", "file_count")


@query(
    "dir_incomplete",
    _q("SELECT CASE k WHEN 1 THEN '/docs' WHEN 2 THEN '/docs/' || source ELSE parent_path END AS path, bool_or(doc_id % 97 = 0) AS incomplete FROM docs, (VALUES (1), (2), (3)) AS v(k) GROUP BY 1", _DOCS),
)
def dir_incomplete(spark, sf_dir):
    files = derived.docs_files(spark, sf_dir).withColumn("unreadable", (F.col("inode") - 1000) % 97 == 0)
    return tree.rollup(tree.with_shared_extra(files)).select("path", "incomplete")


@query(
    "scan_errors",
    "SELECT count(*) AS error_count, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT '/docs/' || source || '/' || lang || '/' || doc_id || '.txt' AS p FROM documents WHERE doc_id % 97 = 0 ORDER BY p LIMIT 200)) AS first_paths FROM documents WHERE doc_id % 97 = 0",
)
def scan_errors(spark, sf_dir):
    count, first = tree.scan_errors(derived.docs_files(spark, sf_dir).withColumn("unreadable", (F.col("inode") - 1000) % 97 == 0))
    return count.crossJoin(first.agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("first_paths")))  # one row each; the list is the report of 200


@query("scan_root_dedup", "SELECT doc_id AS root_ord, doc_id // 3 AS inode FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS n FROM documents) WHERE n = 1 OR doc_id % 5 = 0")
def scan_root_dedup(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("root_ord"), F.lit(1).alias("dev"), F.floor(F.col("doc_id") / 3).alias("inode"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("nlink"))
    return tree.root_dedup(d).select("root_ord", "inode")


@query("scan_alias_prune", "SELECT doc_id, doc_id // 2 <> 0 AND row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) > 1 AS pruned FROM documents")
def scan_alias_prune(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    nodes = complete(d.select(F.concat(F.lit("/a/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.lit("dir").alias("kind"), F.floor(F.col("doc_id") / 2).alias("inode"), F.col("doc_id").alias("own_size")))
    return tree.alias_prune(nodes).select(F.col("own_size").alias("doc_id"), "pruned")


@query("scan_mount_filter", "SELECT doc_id, doc_id % 3 = 2 AS mount FROM documents")
def scan_mount_filter(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    nodes = complete(d.select(F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"), F.lit("dir").alias("kind"), (F.col("doc_id") % 3).cast("int").alias("dev"), F.col("doc_id").alias("inode")))
    return tree.mount_filter(nodes, [0, 1]).select(F.col("inode").alias("doc_id"), "mount")


_PATHS = ("/Volumes", "/dev", "/home", "/net", "/.vol", "/Users", "/System/Volumes", "/System/Library", "/Users/dev", "/usr/home")


@query("scan_system_prune", f"SELECT p AS path, p IN ('/Volumes', '/dev', '/.vol', '/net', '/home', '/System/Volumes') AS pruned FROM (VALUES {', '.join(f'({p!r})' for p in _PATHS)}) AS v(p)")
def scan_system_prune(spark, sf_dir):
    return tree.system_prune(complete(spark.createDataFrame([(p,) for p in _PATHS], "path string"))).select("path", "pruned")


_ROOTS = ("/a/b", "/a", "/c", "/a/b/c", "/c", "/ab", "/d/e", "/d/e/f")


@query(
    "dedupe_roots",
    f"""WITH r AS (SELECT p AS path, min(i)::INTEGER AS root_ord FROM (VALUES {', '.join(f'({p!r}, {i})' for i, p in enumerate(_ROOTS))}) AS v(p, i) GROUP BY p)
        SELECT path, root_ord FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.path, o.path || '/'))""",
)
def dedupe_roots(spark, sf_dir):
    return tree.dedupe_roots(spark.createDataFrame([(p, i) for i, p in enumerate(_ROOTS)], "path string, root_ord int"))


@query("same_object", "SELECT a.doc_id, a.doc_id // 2 = b.doc_id // 2 AS same, a.doc_id // 2 = b.doc_id // 2 AND a.doc_id % 4 <> 0 AS same_for_removal FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def same_object(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("dev"), F.floor(F.col("doc_id") / 2).alias("inode"), F.lit("file").alias("kind"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("nlink"))
    pairs = d.alias("a").join(d.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return pairs.select(F.col("a.doc_id").alias("doc_id"), tree.same_object("a", "b").alias("same"), tree.same_object("a", "b", True).alias("same_for_removal"))


# Zones and filters ----------------------------------------------------------------------------------------------------

_ZOO_DIRS = (".git", "node_modules", "Tool.app", ".hidden", "plain", "lib.Framework", ".Trash-100", "notes.pages", "src", "v1.2")
_ZOO = f"""zoo AS (SELECT p_partkey, 'p' || (p_partkey % 23) AS top, CASE WHEN p_partkey % 23 >= 12 AND (p_partkey // 23) % 10 = 0 THEN 'gitless' ELSE [{', '.join(f"'{d}'" for d in _ZOO_DIRS)}][(p_partkey // 23) % 10 + 1] END AS dir,
  CASE WHEN p_partkey % 3 = 0 THEN '.h' ELSE 'f' END || p_partkey AS name, p_partkey * 100 AS own_size FROM part),
zooz AS (SELECT *, '/x/' || top || '/' || dir || '/' || name AS path, dir IN ('.git', 'node_modules', 'Tool.app', '.hidden', 'lib.Framework', '.Trash-100', 'notes.pages') AS in_opaque,
  (SELECT count(*) FROM part q WHERE q.p_partkey % 23 = zoo.p_partkey % 23 AND q.p_partkey % 23 < 12 AND (q.p_partkey // 23) % 10 = 0) > 0 AS inside_repo, name LIKE '.%' AS hidden_file FROM zoo)"""


def _zoo(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part")
    top = F.col("p_partkey") % 23
    which = (F.floor(F.col("p_partkey") / 23) % 10).cast("int")
    folder = F.when((top >= 12) & (which == 0), "gitless").otherwise(F.get(F.array(*[F.lit(d) for d in _ZOO_DIRS]), which))
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, ".h").otherwise("f"), F.col("p_partkey").cast("string"))
    files = complete(p.select(F.concat(F.lit("/x/p"), top.cast("string"), F.lit("/"), folder, F.lit("/"), name).alias("path"), (F.col("p_partkey") * 100).alias("own_size"), F.col("p_partkey").alias("inode")))
    return files.unionByName(complete(directories_of(files)))


@query("zones", _q("SELECT path, in_opaque, inside_repo, hidden_file FROM zooz", _ZOO))
def zones(spark, sf_dir):
    return dupes.zones(_zoo(spark, sf_dir)).where("kind = 'file'").select("path", "in_opaque", "inside_repo", "hidden_file")


@query("zone_has_git", _q("SELECT DISTINCT '/x/' || top AS path FROM zoo WHERE dir = '.git'", _ZOO))
def zone_has_git(spark, sf_dir):
    return dupes.zones(_zoo(spark, sf_dir)).where("has_git").select("path")


@query("zone_repo_above_root", _q("SELECT path, true AS inside_repo FROM zooz WHERE path <> '/x'", _ZOO))
def zone_repo_above_root(spark, sf_dir):
    outer = spark.createDataFrame([(0,)], "root_ord int")
    return dupes.zones(_zoo(spark, sf_dir), repo_roots=outer).where("kind = 'file'").select("path", "inside_repo")


@query("classify_tool_folders", _q("SELECT DISTINCT '/x/' || top || '/' || dir AS path FROM zoo WHERE dir IN ('.git', 'node_modules', '.Trash-100')", _ZOO))
def classify_tool_folders(spark, sf_dir):
    return _zoo(spark, sf_dir).where((F.col("kind") == "dir") & dupes.is_tool_folder(F.col("name"))).select("path")


@query("classify_bundles", _q("SELECT DISTINCT '/x/' || top || '/' || dir AS path FROM zoo WHERE dir IN ('Tool.app', 'lib.Framework', 'notes.pages')", _ZOO))
def classify_bundles(spark, sf_dir):
    return _zoo(spark, sf_dir).where((F.col("kind") == "dir") & dupes.is_bundle(F.col("name"))).select("path")


@query("filter_hidden", _q("SELECT path FROM zooz WHERE name LIKE '.%'", _ZOO))
def filter_hidden(spark, sf_dir):
    return _zoo(spark, sf_dir).where((F.col("kind") == "file") & dupes.is_hidden(F.col("name"))).select("path")


@query("filter_reportable_files", _q("SELECT path FROM zooz WHERE own_size >= 5000 AND NOT in_opaque AND NOT hidden_file", _ZOO))
def filter_reportable_files(spark, sf_dir):
    return dupes.zones(_zoo(spark, sf_dir)).where(dupes.is_reportable_file(5000)).select("path")


@query("filter_ignorable", "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS ignorable FROM part")
def filter_ignorable(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".DS_Store").otherwise(".env").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "dir").otherwise("file").alias("kind"))
    return rows.select("p_partkey", dupes.is_ignorable().alias("ignorable"))


@query("filter_comparable", "SELECT p_partkey FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def filter_comparable(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part")
    flags = {"unreadable": 2, "pruned": 3, "dataless": 5, "mount": 7, "incomplete": 11}
    return p.select("p_partkey", *[(F.col("p_partkey") % k == 0).alias(n) for n, k in flags.items()]).where(dupes.is_comparable()).select("p_partkey")


@query("filter_excludes", _q("SELECT path FROM docs WHERE name LIKE '1%.txt' OR regexp_matches(name, '^[2-3].[.]txt$') OR path = '/docs/src0/en/0.txt'", _DOCS))
def filter_excludes(spark, sf_dir):
    rows = excludes.apply(derived.docs_files(spark, sf_dir), HOME, ["1*.txt", "[2-3]?.txt", "/docs/src0/en/0.txt"])
    return rows.where("pruned").select("path")


_HOMES = ("/Users/me/Library", "/Users/me/.Trash", "/Users/you/Library", "/Users/me/work/Library", "/Users/Library", "/Users/me/Music", "/home/me/Library")


@query("filter_home_excludes", "SELECT * FROM (VALUES ('/Users/me/Library'), ('/Users/me/.Trash'), ('/Users/you/Library')) AS v(path)")
def filter_home_excludes(spark, sf_dir):
    return complete(spark.createDataFrame([(p,) for p in _HOMES], "path string")).where(excludes.is_home_excluded(HOME)).select("path")


@query("dupes_scan_rules", _q("SELECT path FROM hits", _PROJECTS))
def dupes_scan_rules(spark, sf_dir):
    nodes = derived.projects(spark, sf_dir)
    return junk.tagged(nodes, junk.artifact_matches(nodes, junk.artifact_rules(spark), HOME)).where("rule_ord is not null").select("path")


@query("path_inside", _q("SELECT path, path = '/docs/src1' OR starts_with(path, '/docs/src1/') AS inside FROM docs", _DOCS))
def path_inside(spark, sf_dir):
    return derived.docs_files(spark, sf_dir).select("path", paths.is_same_or_inside(F.col("path"), F.lit("/docs/src1")).alias("inside"))


@query("path_gone", _q("SELECT path FROM docs WHERE parent_path IN (SELECT '/docs/src' || n || '/en' FROM range(0, 20, 3) AS t(n)) OR path LIKE '/docs/src7/%' OR doc_id % 50 = 1", _DOCS))
def path_gone(spark, sf_dir):
    files = derived.docs_files(spark, sf_dir)
    removed = spark.range(0, 20, 3).select(F.concat(F.lit("/docs/src"), F.col("id").cast("string"), F.lit("/en")).alias("path")).unionByName(spark.createDataFrame([("/docs/src7",)], "path string"))
    removed = removed.unionByName(files.where((F.col("inode") - 1000) % 50 == 1).select("path"))
    return dupes.path_gone(files.select("path"), removed)


# Folders and groups ---------------------------------------------------------------------------------------------------

_FOLDERS = """folders AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || content, '|' ORDER BY l_linenumber) AS all_content, string_agg(l_linenumber || ':' || length(content), '|' ORDER BY l_linenumber) AS shape, sum(length(content))::BIGINT AS size, count(*) AS n FROM entries GROUP BY 1)"""


def _orders(spark, sf_dir):
    rows = materialize(tree.with_totals(tree.with_shared_extra(derived.order_folders(spark, sf_dir))), "orders")
    return materialize(dupes.zones(rows).withColumn("digest", F.when(F.col("kind") == "file", dupes.file_digest(F.col("content")))), "orders")


def _order_members(spark, sf_dir, **how):
    rows = _orders(spark, sf_dir)
    folder = dupes.folder_digest(rows).withColumnRenamed("digest", "_f")
    rows = materialize(rows.join(folder.hint("merge"), ["root_ord", "path"], "left").withColumn("digest", F.coalesce("digest", "_f")).drop("_f"), "orders")
    return dupes.members(rows, 1, **how), rows


@query("structure_signature", _q("SELECT '/orders/' || min(l_orderkey::VARCHAR) AS first_path, count(*) AS n_folders FROM folders GROUP BY shape", _ORDERS, _FOLDERS))
def structure_signature(spark, sf_dir):
    rows = dupes.structure_signature(derived.order_folders(spark, sf_dir)).where("path <> '/orders'")
    return rows.groupBy("signature").agg(F.min("path").alias("first_path"), F.count("*").alias("n_folders")).drop("signature")


@query("structure_twins", _q("SELECT '/orders/' || l_orderkey AS path, n FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY shape) AS n FROM folders) WHERE n > 1", _ORDERS, _FOLDERS))
def structure_twins(spark, sf_dir):
    return dupes.structure_twins(dupes.structure_signature(derived.order_folders(spark, sf_dir))).select("path", "n")


@query("folder_candidates", _q("SELECT '/orders/' || l_orderkey AS path FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY shape) AS n FROM folders) WHERE n > 1", _ORDERS, _FOLDERS))
def folder_candidates(spark, sf_dir):
    nodes = derived.order_folders(spark, sf_dir)
    return dupes.candidate_folders(dupes.zones(nodes), dupes.structure_signature(nodes)).select("path")


@query("file_candidates", _q("SELECT '/orders/' || l_orderkey || '/' || l_linenumber AS path FROM entries WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY shape) AS n FROM folders) WHERE n > 1)", _ORDERS, _FOLDERS))
def file_candidates(spark, sf_dir):
    nodes = derived.order_folders(spark, sf_dir)
    wanted = dupes.candidate_folders(dupes.zones(nodes), dupes.structure_signature(nodes)).select("root_ord", F.col("path").alias("parent_path"))
    return nodes.where("kind = 'file'").where(~dupes.is_ignorable()).join(wanted, ["root_ord", "parent_path"], "left_semi").select("path")


@query("folder_digest", _q("SELECT '/orders/' || min(l_orderkey::VARCHAR) AS first_path, count(*) AS n_folders FROM folders GROUP BY all_content", _ORDERS, _FOLDERS))
def folder_digest(spark, sf_dir):
    rows = dupes.folder_digest(_orders(spark, sf_dir)).where("path <> '/orders'")
    return rows.groupBy("digest").agg(F.min("path").alias("first_path"), F.count("*").alias("n_folders")).drop("digest")


@query("dup_folders", _q("SELECT '/orders/' || min(l_orderkey::VARCHAR) AS first_path, count(*) AS n_members, min(size) AS size FROM folders GROUP BY all_content HAVING count(*) > 1", _ORDERS, _FOLDERS))
def dup_folders(spark, sf_dir):
    found, _ = _order_members(spark, sf_dir, include_files=False)
    return found.groupBy("digest").agg(F.min("path").alias("first_path"), F.count("*").alias("n_members"), F.min("total_size").alias("size")).drop("digest")


@query("filter_reportable_folders", _q("SELECT '/orders/' || l_orderkey AS path FROM folders WHERE size >= 8 UNION ALL SELECT '/orders' FROM folders HAVING sum(size) >= 8", _ORDERS, _FOLDERS))
def filter_reportable_folders(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    rows = rows.drop("digest").join(dupes.folder_digest(rows).hint("merge"), ["root_ord", "path"])
    return rows.where(dupes.is_reportable_folder(8)).select("path")


@query(
    "holds_nested_repo",
    _q(
        """SELECT '/orders/' || l_orderkey || '/' || l_linenumber AS path, l_orderkey IN (SELECT l_orderkey FROM (SELECT l_orderkey, count(*) OVER (PARTITION BY all_content) AS n FROM folders) WHERE n > 1) AS nested
           FROM entries WHERE content IN (SELECT content FROM entries GROUP BY 1 HAVING count(*) > 1)""",
        _ORDERS,
        _FOLDERS,
    ),
)
def holds_nested_repo(spark, sf_dir):
    found, _ = _order_members(spark, sf_dir)
    return found.where("kind = 'file'").select("path", "nested")


_GROUPS = """m AS (SELECT e.*, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS n FROM extra e WHERE own_size >= 1),
h AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY digest, parent_path) > 1 THEN 'sibling' END AS hold FROM m WHERE n > 1),
r AS (SELECT *, CASE WHEN hold IS NULL THEN row_number() OVER (PARTITION BY digest, hold IS NULL ORDER BY mtime, path) END AS rank, bool_or(hold IS NOT NULL) OVER (PARTITION BY digest) AS held FROM h),
s AS (SELECT *, hold IS NULL AND (held OR rank > 1) AS suggested FROM r),
st AS (SELECT digest, clone_id, bool_or(NOT suggested) AS kept, sum(own_alloc) FILTER (suggested) AS going, first(own_alloc ORDER BY path) FILTER (suggested) AS one FROM s GROUP BY 1, 2),
g AS (SELECT digest, coalesce(sum(CASE WHEN kept THEN 0 ELSE one END) FILTER (going IS NOT NULL), 0)::BIGINT AS freed, coalesce(sum(going - CASE WHEN kept THEN 0 ELSE one END) FILTER (going IS NOT NULL), 0)::BIGINT AS shared FROM st GROUP BY 1)"""


def _doc_members(spark, sf_dir):
    from boscage import api

    return api.dupe_members(derived.docs_tree(spark, sf_dir), HOME, min_size=1, files_only=True)


@query("holds", _q("SELECT path, hold FROM s", _DOCS, _EXTRA, _GROUPS))
def holds(spark, sf_dir):
    return _doc_members(spark, sf_dir)[0].select("path", "hold")


@query("keep_rank", _q("SELECT path, coalesce(rank, 0)::BIGINT AS rank FROM s", _DOCS, _EXTRA, _GROUPS))
def keep_rank(spark, sf_dir):
    return _doc_members(spark, sf_dir)[0].select("path", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"))


@query("keep_suggest", _q("SELECT path, suggested FROM s", _DOCS, _EXTRA, _GROUPS))
def keep_suggest(spark, sf_dir):
    return _doc_members(spark, sf_dir)[0].select("path", "suggested")


@query("reclaim_estimate", _q("SELECT digest, freed, shared FROM g", _DOCS, _EXTRA, _GROUPS))
def reclaim_estimate(spark, sf_dir):
    rows, every = _doc_members(spark, sf_dir)
    return dupes.reclaim(rows.withColumn("selected", F.col("suggested")), every).select("digest", "freed", "shared")


@query(
    "dupes_groups",
    _q("SELECT digest, any_value(own_size) AS size, count(*) AS n_members, count(*) FILTER (suggested) AS n_suggested, any_value(freed) AS reclaimable, any_value(shared) AS shared, min(path) AS first_path FROM s JOIN g USING (digest) GROUP BY 1", _DOCS, _EXTRA, _GROUPS),
)
def dupes_groups(spark, sf_dir):
    from boscage import api

    rows = api.dupes(derived.docs_tree(spark, sf_dir), HOME, min_size=1, files_only=True)
    return rows.select("digest", "size", F.size("members").cast("bigint").alias("n_members"), F.size(F.filter("members", lambda m: m["suggested"])).cast("bigint").alias("n_suggested"), "reclaimable", "shared", F.col("members")[0]["path"].alias("first_path"))


@query("dupes_totals", _q("SELECT sum(freed)::BIGINT AS reclaimable, sum(shared)::BIGINT AS shared FROM g", _DOCS, _EXTRA, _GROUPS))
def dupes_totals(spark, sf_dir):
    rows, every = _doc_members(spark, sf_dir)
    return dupes.reclaim(rows.withColumn("selected", F.col("suggested")), every).agg(F.sum("freed").alias("reclaimable"), F.sum("shared").alias("shared"))


@query("dupes_top", _q("SELECT digest, freed AS reclaimable FROM g JOIN (SELECT digest, any_value(own_size) AS size, count(*) AS n, min(path) AS p FROM s GROUP BY 1) USING (digest) ORDER BY freed DESC, size * (n - 1) DESC, p LIMIT 20", _DOCS, _EXTRA, _GROUPS))
def dupes_top(spark, sf_dir):
    from boscage import api

    return api.dupes(derived.docs_tree(spark, sf_dir), HOME, min_size=1, files_only=True).limit(20).select("digest", "reclaimable")


@query("dupes_undecided", _q("SELECT coalesce(sum(size * greatest(0, stays - 1)), 0)::BIGINT AS undecided_bytes FROM (SELECT digest, any_value(own_size) AS size, count(*) FILTER (NOT suggested) AS stays FROM s GROUP BY 1)", _DOCS, _EXTRA, _GROUPS))
def dupes_undecided(spark, sf_dir):
    return dupes.undecided(_doc_members(spark, sf_dir)[0].withColumn("selected", F.col("suggested")))


@query("aligned_files", _q("SELECT digest, count(*) AS n_files, count(*) FILTER (suggested) AS n_selected FROM s GROUP BY 1", _DOCS, _EXTRA, _GROUPS))
def aligned_files(spark, sf_dir):
    rows, every = _doc_members(spark, sf_dir)
    return dupes.aligned_files(rows.withColumn("selected", F.col("suggested")), every).groupBy("digest").agg(F.count("*").alias("n_files"), F.count_if("selected").alias("n_selected"))


@query(
    "aligned_files_all",
    _q(
        """SELECT 'dir' AS kind, min('/orders/' || l_orderkey) AS first_path, count(*) AS n_members, sum(n)::BIGINT AS n_files, (sum(n) - any_value(n))::BIGINT AS n_selected, true AS aligned FROM fm WHERE k > 1 GROUP BY all_content
           UNION ALL SELECT 'file', min('/orders/' || l_orderkey || '/' || l_linenumber), count(*), count(*), count(*) - 1, true FROM em WHERE k > 1 GROUP BY content HAVING NOT bool_and(nested)""",
        _ORDERS,
        _FOLDERS,
        "fm AS (SELECT *, count(*) OVER (PARTITION BY all_content) AS k FROM folders)",
        "em AS (SELECT e.*, count(*) OVER (PARTITION BY content) AS k, fm.k > 1 AS nested FROM entries e JOIN fm USING (l_orderkey))",
    ),
)
def aligned_files_all(spark, sf_dir):
    """Groups of folders, walked in lockstep, and of files; all but the first member of a group are selected."""
    rows, every = _order_members(spark, sf_dir)
    rows = materialize(rows, "members")
    key = ["kind", "digest"]
    tops = rows.groupBy(*key).agg(F.min("path").alias("first_path"), F.count("*").alias("n_members"))
    rows = rows.join(tops.hint("merge"), key).withColumn("selected", F.col("path") != F.col("first_path"))
    files = dupes.aligned_files(rows.drop("first_path", "n_members"), every).groupBy(*key).agg(F.count("*").alias("n_files"), F.count_if("selected").alias("n_selected"), F.bool_and("aligned").alias("aligned"))
    return files.join(tops.hint("merge"), key).select("kind", "first_path", "n_members", "n_files", "n_selected", "aligned")


@query("reclaim_fallback", _q("SELECT digest, sum(own_alloc) FILTER (suggested)::BIGINT AS freed FROM s GROUP BY 1 HAVING count(*) FILTER (suggested) > 0", _DOCS, _EXTRA, _GROUPS))
def reclaim_fallback(spark, sf_dir):
    """Members whose places do not line up: here, members renamed to folders that the catalog holds nothing of but one."""
    rows, _ = _doc_members(spark, sf_dir)
    rows = rows.withColumn("selected", F.col("suggested"))
    first = rows.groupBy("digest").agg(F.min("path").alias("p"))
    inside = complete(first.select(F.concat("p", F.lit("/only.txt")).alias("path"), F.lit(1).alias("own_size")))
    out = dupes.reclaim(rows.withColumn("kind", F.lit("dir")), inside)
    return out.where("freed > 0").select("digest", "freed")


@query("groups_without_survivor", _q("SELECT digest FROM m WHERE n > 1 GROUP BY digest HAVING bool_and(doc_id % 2 = 0)", _DOCS, _EXTRA, _GROUPS))
def groups_without_survivor(spark, sf_dir):
    rows = _doc_members(spark, sf_dir)[0]
    return dupes.without_survivor(rows.withColumn("selected", (F.col("inode") - 1000) % 2 == 0)).select("digest")


@query("clone_selection", _q("SELECT path, path <> coalesce(min(CASE WHEN NOT suggested THEN path END) OVER (PARTITION BY digest), '') AS selected FROM s", _DOCS, _EXTRA, _GROUPS))
def clone_selection(spark, sf_dir):
    return dupes.clone_selection(_doc_members(spark, sf_dir)[0]).select("path", "selected")


@query(
    "dupes_json",
    _q("SELECT digest AS sha256, count(*) AS n_members, string_agg(CASE WHEN suggested THEN 'remove' ELSE 'keep' END, ',' ORDER BY path) AS suggestions FROM s GROUP BY 1", _DOCS, _EXTRA, _GROUPS),
)
def dupes_json(spark, sf_dir):
    from boscage import api

    rows = api.dupes_json(api.dupes(derived.docs_tree(spark, sf_dir), HOME, min_size=1, files_only=True))
    back = F.from_json("json", "sha256 string, members array<struct<path:string,suggestion:string>>")
    return rows.select(back.alias("j")).select("j.sha256", F.size("j.members").cast("bigint").alias("n_members"), F.array_join(F.transform("j.members", lambda m: m["suggestion"]), ",").alias("suggestions"))


@query(
    "folder_resemblance",
    _q(
        """SELECT DISTINCT '/orders/' || oa || '/' || name AS path FROM cnt WHERE shared >= 3 OR (shared >= 1 AND shared * 10 >= least(na, nb) * 3)""",
        _ORDERS,
        "f AS (SELECT content, l_orderkey AS o, min(l_linenumber::VARCHAR) AS first FROM entries GROUP BY 1, 2)",
        "ok AS (SELECT content FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 512)",
        "pr AS (SELECT a.content, a.o AS oa, b.o AS ob, b.first FROM f a JOIN f b USING (content) JOIN ok USING (content) WHERE a.o <> b.o)",
        "mem AS (SELECT pr.*, e.l_linenumber::VARCHAR AS name FROM pr JOIN entries e ON e.l_orderkey = oa AND e.content = pr.content)",
        "sizes AS (SELECT l_orderkey, count(*) - 1 AS n FROM entries GROUP BY 1)",
        """cnt AS (SELECT mem.content, oa, ob, name, first, any_value(sa.n) AS na, any_value(sb.n) AS nb,
             count(*) FILTER (x.l_linenumber::VARCHAR <> name AND y.l_linenumber IS NOT NULL AND y.l_linenumber::VARCHAR <> first) AS shared
           FROM mem JOIN entries x ON x.l_orderkey = oa LEFT JOIN entries y ON y.l_orderkey = ob AND y.l_linenumber = x.l_linenumber JOIN sizes sa ON sa.l_orderkey = oa JOIN sizes sb ON sb.l_orderkey = ob GROUP BY 1, 2, 3, 4, 5)""",
    ),
)
def folder_resemblance(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    found = materialize(dupes.members(rows, 1, include_folders=False), "members")
    return dupes.resemblance(found, rows, most=dupes.MAX_FOLDERS_COMPARED).select("path")


# Big ------------------------------------------------------------------------------------------------------------------


@query("big_largest_files", _q("SELECT path, own_alloc AS alloc FROM extra WHERE NOT shared_extra ORDER BY own_alloc DESC, string_split(path, '/') LIMIT 15", _DOCS, _EXTRA))
def big_largest_files(spark, sf_dir):
    return big.largest_files(tree.with_shared_extra(derived.docs_files(spark, sf_dir)))


_SALES_DIRS = """dirs AS (SELECT '/' || array_to_string(parts[1:k], '/') AS path, '/' || array_to_string(parts[1:k - 1], '/') AS parent_path, parts[k] AS name, k AS lvl, sum(own_size)::BIGINT AS size, count(*) AS files FROM sales, (VALUES (1), (2), (3), (4), (5)) AS v(k) GROUP BY 1, 2, 3, 4),
root AS (SELECT trunc(size * 0.01::DOUBLE)::BIGINT AS th FROM dirs WHERE lvl = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY size DESC, name) - 1 AS pos FROM dirs WHERE lvl > 1),
l1 AS (SELECT *, pos < 8 AND size >= greatest(th, 1) AS enter, pos < 3 AND size >= greatest(th // 10, 1) AS leaf FROM rk, root WHERE lvl = 2),
l2 AS (SELECT rk.*, th, rk.pos < 8 AND rk.size >= greatest(th, 1) AS enter, rk.pos < 3 AND rk.size >= greatest(th // 10, 1) AS leaf FROM rk JOIN (SELECT path AS up FROM l1 WHERE enter) ON parent_path = up, root WHERE lvl = 3)"""


def _sales(spark, sf_dir):
    return materialize(tree.with_totals(tree.with_shared_extra(derived.sales_tree(spark, sf_dir))), "sales")


@query("big_child_rank", _q("SELECT path, pos FROM rk", _SALES, _SALES_DIRS))
def big_child_rank(spark, sf_dir):
    return big.ranked_children(_sales(spark, sf_dir)).where("kind = 'dir' and path <> '/sales'").select("path", F.col("pos").cast("bigint").alias("pos"))


@query(
    "big_breakdown",
    _q("SELECT path, 1 AS level, size, files AS file_count FROM l1 WHERE enter OR leaf UNION ALL SELECT path, 2, size, files FROM l2 WHERE enter OR leaf UNION ALL SELECT path, 0, size, files FROM dirs WHERE lvl = 1", _SALES, _SALES_DIRS),
)
def big_breakdown(spark, sf_dir):
    roots = spark.createDataFrame([(0, "/sales")], "root_ord int, path string")
    return big.breakdown(_sales(spark, sf_dir), roots).select("path", "level", "size", "file_count")


@query(
    "big_omitted",
    _q(
        """SELECT path, coalesce(n, 0)::BIGINT AS omitted_count, coalesce(s, 0)::BIGINT AS omitted_size FROM (SELECT path FROM l1 WHERE enter OR leaf UNION ALL SELECT '/sales')
           LEFT JOIN (SELECT parent_path AS path, count(*) AS n, sum(size) AS s FROM (SELECT parent_path, size FROM l1 WHERE NOT (enter OR leaf) UNION ALL SELECT parent_path, size FROM l2 WHERE NOT (enter OR leaf)) GROUP BY 1) USING (path)""",
        _SALES,
        _SALES_DIRS,
    ),
)
def big_omitted(spark, sf_dir):
    roots = spark.createDataFrame([(0, "/sales")], "root_ord int, path string")
    return big.breakdown(_sales(spark, sf_dir), roots).where("level < 2").select("path", "omitted_count", "omitted_size")


@query("big_json", _q("SELECT path, own_alloc AS alloc FROM extra WHERE NOT shared_extra ORDER BY own_alloc DESC, string_split(path, '/') LIMIT 15", _DOCS, _EXTRA))
def big_json(spark, sf_dir):
    rows = big.to_json(big.largest_files(tree.with_shared_extra(derived.docs_files(spark, sf_dir))))
    return rows.select(F.from_json("json", "alloc bigint, path string").alias("j")).select("j.path", "j.alloc")


# Junk -----------------------------------------------------------------------------------------------------------------


def _tagged(spark, sf_dir):
    nodes = materialize(tree.with_totals(tree.with_shared_extra(derived.projects(spark, sf_dir))), "projects")
    return junk.tagged(nodes, materialize(junk.artifact_matches(nodes, junk.artifact_rules(spark), HOME), "matches"))


@query("artifact_match", _q("SELECT path, rule_ord, unpinned FROM hits", _PROJECTS))
def artifact_match(spark, sf_dir):
    nodes = derived.projects(spark, sf_dir)
    return junk.artifact_matches(nodes, junk.artifact_rules(spark), HOME).select("path", "rule_ord", "unpinned")


@query("artifact_evidence", _q("SELECT rule_ord, count(*) AS n FROM hits GROUP BY 1", _PROJECTS))
def artifact_evidence(spark, sf_dir):
    nodes = derived.projects(spark, sf_dir)
    return junk.artifact_matches(nodes, junk.artifact_rules(spark), HOME).groupBy("rule_ord").agg(F.count("*").alias("n"))


@query("artifact_pinned", _q("SELECT path FROM hits WHERE rule_ord = 0 AND NOT unpinned", _PROJECTS))
def artifact_pinned(spark, sf_dir):
    nodes = derived.projects(spark, sf_dir)
    return junk.artifact_matches(nodes, junk.artifact_rules(spark), HOME).where("rule_ord = 0 and not unpinned").select("path")


@query("project_last_used", _q("SELECT path, last_used FROM hits JOIN fresh USING (o)", _PROJECTS, _FRESH))
def project_last_used(spark, sf_dir):
    return junk.last_used(_tagged(spark, sf_dir)).select("path", "last_used")


_ITEMS = f"""items AS (SELECT path, size, last_used, rule_ord, CASE rule_ord WHEN 0 THEN 'node_modules' WHEN 3 THEN 'rust-target' WHEN 13 THEN 'cmake-build' ELSE 'python-venv' END AS id,
  CASE WHEN rule_ord = 15 OR unpinned OR {NOW} - last_used < 604800 THEN 'review' ELSE 'safe' END AS safety FROM hits JOIN fresh USING (o) WHERE size >= 10000)"""


def _items(spark, sf_dir, **how):
    return junk.artifact_items(_tagged(spark, sf_dir), junk.artifact_rules(spark), NOW, 10000, **how)


@query("junk_artifact_items", _q("SELECT path, id, size, safety, last_used FROM items", _PROJECTS, _FRESH, _ITEMS))
def junk_artifact_items(spark, sf_dir):
    return _items(spark, sf_dir).select(F.col("targets")[0].alias("path"), "id", "size", "safety", "last_used")


@query("junk_filter_only_skip", _q(f"SELECT path, id FROM items WHERE id <> 'python-venv' AND {NOW} - last_used >= 100000000", _PROJECTS, _FRESH, _ITEMS))
def junk_filter_only_skip(spark, sf_dir):
    return junk.only_skip(_items(spark, sf_dir, older_than=100_000_000), ["Projects"], ["PYTHON-VENV"]).select(F.col("targets")[0].alias("path"), "id")


@query("junk_category_totals", _q("SELECT 'projects' AS category, sum(size)::BIGINT AS size, count(*) AS n_items, sum(size) FILTER (safety = 'safe')::BIGINT AS safe, sum(size) FILTER (safety = 'review')::BIGINT AS review, 0::BIGINT AS info FROM items", _PROJECTS, _FRESH, _ITEMS))
def junk_category_totals(spark, sf_dir):
    return junk.category_totals(_items(spark, sf_dir))


@query("junk_totals", _q("SELECT sum(size) FILTER (safety = 'safe')::BIGINT AS safe, sum(size)::BIGINT AS removable FROM items", _PROJECTS, _FRESH, _ITEMS))
def junk_totals(spark, sf_dir):
    return junk.totals(_items(spark, sf_dir))


@query(
    "junk_top_per_category",
    _q("SELECT 'projects' AS category, sum(size)::BIGINT AS size, count(*) AS n_items FROM (SELECT *, row_number() OVER (ORDER BY size DESC, path) AS n FROM items) GROUP BY n <= 8", _PROJECTS, _FRESH, _ITEMS),
)
def junk_top_per_category(spark, sf_dir):
    rows = junk.top_per_category(_items(spark, sf_dir))
    return rows.groupBy("category", F.col("rank").isNull()).agg(F.sum("size").alias("size"), F.sum("n_items").alias("n_items")).select("category", "size", "n_items")


@query("junk_selection", _q("SELECT path FROM items WHERE safety IN ('safe', 'review') AND size > 0", _PROJECTS, _FRESH, _ITEMS))
def junk_selection(spark, sf_dir):
    return junk.selection(_items(spark, sf_dir), review=True).select(F.col("targets")[0].alias("path"))


@query("junk_items", _q("SELECT path, id, 'projects' AS category, size FROM items ORDER BY size DESC, path", _PROJECTS, _FRESH, _ITEMS))
def junk_items(spark, sf_dir):
    return junk.ordered(_items(spark, sf_dir)).select(F.col("targets")[0].alias("path"), "id", "category", "size")


@query("junk_json", _q("SELECT path, id, safety, size, last_used FROM items", _PROJECTS, _FRESH, _ITEMS))
def junk_json(spark, sf_dir):
    back = F.from_json("json", "paths array<string>, id string, safety string, size bigint, projectLastTouched bigint")
    return junk.to_json(_items(spark, sf_dir)).select(back.alias("j")).select(F.col("j.paths")[0].alias("path"), "j.id", "j.safety", "j.size", F.col("j.projectLastTouched").alias("last_used"))


@query("junk_action_plan", _q("SELECT path, 'remove' AS verdict FROM items WHERE safety = 'safe'", _PROJECTS, _FRESH, _ITEMS))
def junk_action_plan(spark, sf_dir):
    return actions.junk_plan(junk.selection(_items(spark, sf_dir)), derived.projects(spark, sf_dir)).select("path", "verdict")


#: Documents as entries of known cache folders: three locations, and names that labels know.
_CACHE_NAMES = ("pip", "Homebrew", "com.apple.Safari", "com.apple.dt.Xcode", "JetBrains", "other")
_CACHES = f"""caches AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/Users/me/Library/Caches/' WHEN 1 THEN '/Users/me/.cache/' ELSE '/Users/me/.Trash/' END || [{', '.join(f"'{n}'" for n in _CACHE_NAMES)}][doc_id % 6 + 1] || doc_id // 60 AS dummy,
  CASE doc_id % 3 WHEN 0 THEN 'app-cache' WHEN 1 THEN 'tool-cache' ELSE 'trash' END AS id, CASE WHEN doc_id < 6 THEN [{', '.join(f"'{n}'" for n in _CACHE_NAMES)}][doc_id + 1] ELSE 'entry' || doc_id // 6 END AS name, strlen(text)::BIGINT AS size FROM documents),
entry AS (SELECT id, name, sum(size)::BIGINT AS size, count(*) AS files FROM caches GROUP BY 1, 2)"""


def _cache_nodes(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    top = F.when(F.col("doc_id") % 3 == 0, "/Users/me/Library/Caches/").when(F.col("doc_id") % 3 == 1, "/Users/me/.cache/").otherwise("/Users/me/.Trash/")
    name = F.when(F.col("doc_id") < 6, F.get(F.array(*[F.lit(n) for n in _CACHE_NAMES]), F.col("doc_id").cast("int"))).otherwise(F.concat(F.lit("entry"), F.floor(F.col("doc_id") / 6).cast("string")))
    files = complete(d.select(F.concat(top, name, F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("bigint").alias("own_size"), F.col("doc_id").alias("inode")))
    nodes = files.unionByName(complete(directories_of(files)))
    return materialize(tree.with_totals(tree.with_shared_extra(nodes)), "caches")


@query("junk_child_items", _q("SELECT id, name, size FROM entry WHERE id <> 'trash' AND size >= 2000 AND name <> 'com.apple.Safari'", _CACHES))
def junk_child_items(spark, sf_dir):
    rows = junk.child_items(_cache_nodes(spark, sf_dir), junk.known_locations(spark, HOME), junk.cache_labels(spark), 2000)
    return rows.select("id", paths.basename(F.col("targets")[0]).alias("name"), "size")


@query(
    "junk_cache_labels",
    _q("SELECT CASE name WHEN 'pip' THEN 'pip cache' WHEN 'Homebrew' THEN 'Homebrew downloads' WHEN 'com.apple.dt.Xcode' THEN 'Xcode cache' WHEN 'JetBrains' THEN 'JetBrains IDE caches' ELSE 'Cache · ' || name END AS title, CASE name WHEN 'JetBrains' THEN 'review' ELSE 'safe' END AS safety FROM entry WHERE id <> 'trash' AND size >= 1 AND name <> 'com.apple.Safari'", _CACHES),
)
def junk_cache_labels(spark, sf_dir):
    return junk.child_items(_cache_nodes(spark, sf_dir), junk.known_locations(spark, HOME), junk.cache_labels(spark), 1).select("title", "safety")


@query("junk_location_items", _q("SELECT 'trash' AS id, sum(size)::BIGINT AS size, sum(files)::BIGINT AS file_count, 'review' AS safety FROM entry WHERE id = 'trash'", _CACHES))
def junk_location_items(spark, sf_dir):
    return junk.location_items(_cache_nodes(spark, sf_dir), junk.known_locations(spark, HOME), 1).select("id", "size", "file_count", "safety")


@query("junk_location_join", "SELECT '/Users/me/.Trash' AS path, 'trash' AS id UNION ALL SELECT '/Users/me/.cache', 'tool-cache' UNION ALL SELECT '/Users/me/Library/Caches', 'app-cache'")
def junk_location_join(spark, sf_dir):
    each = junk.known_locations(spark, HOME).select("id", F.explode("paths").alias("path"))
    return _cache_nodes(spark, sf_dir).join(F.broadcast(each), "path").select("path", "id")  # a row a known path


@query("junk_known_locations", f"SELECT count(*) AS n_locations, {sum(len(r[4]) for r in junk_rules.locations(HOME))}::BIGINT AS n_paths FROM range({len(junk_rules.LOCATIONS) + len(junk_rules.APPS)})")
def junk_known_locations(spark, sf_dir):
    return junk.known_locations(spark, HOME).agg(F.count("*").alias("n_locations"), F.sum(F.size("paths")).alias("n_paths"))


@query("junk_claimed", "SELECT * FROM (VALUES ('/Users/me', 'Library'), ('/Users/me', 'Applications'), ('/Users/me', '.cache'), ('/Users/me', '.Trash'), ('/Users/me/Library', 'Caches')) AS v(parent_path, name)")
def junk_claimed(spark, sf_dir):
    return junk.claimed_names(junk.known_locations(spark, HOME), _cache_nodes(spark, sf_dir), HOME)


_APPS = ("com.apple.mail", "com.docker.docker", "com.example.notes", "org.sample.chat")


@query("junk_sandbox_caches", "SELECT 'Cache · ' || a AS title, '/Users/me/Library/Containers/' || a || '/Data/Library/Caches' AS path FROM (VALUES ('com.example.notes'), ('org.sample.chat')) AS v(a)")
def junk_sandbox_caches(spark, sf_dir):
    rows = complete(spark.createDataFrame([(f"{HOME}/Library/Containers/{a}/Data/Library/Caches", "dir") for a in _APPS], "path string, kind string"))
    return junk.sandbox_caches(rows, HOME).select("title", F.col("paths")[0].alias("path"))


@query("junk_installers", "SELECT 'Install macOS Sonoma' AS title, '/Applications/Install macOS Sonoma.app' AS path")
def junk_installers(spark, sf_dir):
    rows = complete(spark.createDataFrame([("/Applications/Install macOS Sonoma.app", "dir"), ("/Applications/Install macOS", "dir"), ("/Applications/Notes.app", "dir"), ("/x/Install macOS A.app", "dir")], "path string, kind string"))
    return junk.installers(rows).select("title", F.col("paths")[0].alias("path"))


@query("junk_project_roots", "SELECT * FROM (VALUES ('/Users/me/work'), ('/Users/me'), ('/Users/me/.cached')) AS v(path)")
def junk_project_roots(spark, sf_dir):
    roots = spark.createDataFrame([("/Users/me/work",), ("/Users/me",), ("/Users/me/.cache/x",), ("/Users/me/.Trash",), ("/Users/me/.cached",)], "path string")
    return junk.project_roots(roots, junk.known_locations(spark, HOME))


@query("junk_display_path", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/a/' || doc_id ELSE '/a/…' END AS display_path FROM documents")
def junk_display_path(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents")
    one = F.concat(F.lit("/a/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", paths.display_path(F.when(F.col("doc_id") % 2 == 0, F.array(one)).otherwise(F.array(one, F.lit("/b")))).alias("display_path"))


@query("junk_walk_prune", _q("SELECT '/work/' || o || '/node_modules' AS path FROM has WHERE h2 AND NOT h1", _PROJECTS))
def junk_walk_prune(spark, sf_dir):
    claimed = spark.createDataFrame([("/work", "nothing")], "parent_path string, name string")
    return junk.walk_prune(_tagged(spark, sf_dir), claimed).where("pruned").select("path")


# Diff and plans -------------------------------------------------------------------------------------------------------


def _now(spark, sf_dir):
    nodes = derived.docs_tree(spark, sf_dir)
    doc = F.col("inode") - 1000
    later = nodes.where((F.col("kind") == "dir") | (doc % 31 != 0))
    return later.withColumn("own_size", F.when((F.col("kind") == "file") & (doc % 17 == 0), F.col("own_size") + 1).otherwise(F.col("own_size")))


@query(
    "snapshot_diff",
    _q("SELECT path, CASE WHEN doc_id % 31 = 0 THEN 'no longer exists' ELSE 'modified' END AS reason FROM docs WHERE doc_id % 31 = 0 OR doc_id % 17 = 0 UNION ALL SELECT DISTINCT parent_path, 'entries were added or removed' FROM docs WHERE doc_id % 31 = 0 AND EXISTS (SELECT 1 FROM docs k WHERE k.parent_path = docs.parent_path AND k.doc_id % 31 <> 0) UNION ALL SELECT parent_path, 'entries were added or removed' FROM docs GROUP BY 1 HAVING bool_and(doc_id % 31 = 0)", _DOCS),
)
def snapshot_diff(spark, sf_dir):
    return diff.snapshot_diff(derived.docs_tree(spark, sf_dir), _now(spark, sf_dir))


@query(
    "dupes_action_plan",
    _q(
        """SELECT path, CASE WHEN doc_id % 17 = 0 OR NOT EXISTS (SELECT 1 FROM s k WHERE k.digest = s.digest AND NOT k.suggested AND k.doc_id % 17 <> 0) THEN 'skipped' ELSE 'done' END AS verdict FROM s WHERE suggested""",
        _DOCS,
        _EXTRA,
        _GROUPS,
    ),
)
def dupes_action_plan(spark, sf_dir):
    rows = _doc_members(spark, sf_dir)[0].withColumn("selected", F.col("suggested")).withColumn("change", F.when((F.col("inode") - 1000) % 17 == 0, "modified"))
    return actions.dupes_plan(rows, HOME).select("path", "verdict")


@query("unread_confirm", "SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text <> b.text AND NOT (a.doc_id % 2 = 0 AND a.doc_id % 3 = 0)")
def unread_confirm(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    pairs = d.select(F.col("doc_id").alias("path"), "content", (F.col("doc_id") + 1).alias("k"), (F.col("doc_id") % 2 == 0).alias("read"), (F.col("doc_id") % 3 == 0).alias("keeper_read"))
    pairs = pairs.join(d.select(F.col("doc_id").alias("k"), F.col("content").alias("keeper_content")), "k")
    return actions.unread_differences(pairs).select(F.col("path").alias("doc_id"))


@query("clone_plan", _q("SELECT lang AS path, count(*) FILTER (own_size > 0 AND doc_id % 7 <> 0) AS cloned, count(*) FILTER (own_size > 0 AND doc_id % 7 = 0) AS already_shared, coalesce(sum(own_alloc) FILTER (own_size > 0 AND doc_id % 7 <> 0), 0)::BIGINT AS bytes FROM docs GROUP BY 1", _DOCS))
def clone_plan(spark, sf_dir):
    f = derived.docs_files(spark, sf_dir)
    doc = F.col("inode") - 1000
    pairs = f.select(F.col("path_parts")[2].alias("path"), F.col("own_size").alias("size"), F.col("own_alloc").alias("alloc"), "dev", "clone_id", F.col("dev").alias("keeper_dev"), F.when(doc % 7 == 0, F.col("clone_id")).otherwise(-1).alias("keeper_clone_id"))
    return actions.clone_plan(pairs)


@query(
    "clone_refusal",
    """SELECT p_partkey, CASE WHEN p_partkey % 29 = 0 THEN 'file disappeared' WHEN p_partkey % 23 = 0 THEN 'not a regular file' WHEN p_partkey % 19 = 0 THEN 'copies are on different volumes' WHEN p_partkey % 17 = 0 THEN 'already the same file (hard link)'
       WHEN p_partkey % 13 = 0 THEN 'has other hard links' WHEN p_partkey % 11 = 0 THEN 'owned by another user' WHEN p_partkey % 7 = 0 THEN 'uses file system compression' WHEN p_partkey % 5 = 0 THEN 'locked' WHEN p_partkey % 3 = 0 THEN 'the copy that stays is locked' WHEN p_partkey % 2 = 0 THEN 'sizes differ' END AS reason FROM part""",
)
def clone_refusal(spark, sf_dir):
    k = F.col("p_partkey")
    side = lambda **v: F.struct(*[x.alias(n) for n, x in v.items()])
    src = side(kind=F.lit("file"), dev=F.lit(1), inode=F.lit(1), nlink=F.lit(1), uid=F.lit(501), compressed=F.lit(False), locked=k % 3 == 0, size=F.lit(10))
    dst = side(kind=F.when(k % 23 == 0, "dir").otherwise("file"), dev=F.when(k % 19 == 0, 2).otherwise(1), inode=F.when(k % 17 == 0, 1).otherwise(2), nlink=F.when(k % 13 == 0, 2).otherwise(1), uid=F.when(k % 11 == 0, 0).otherwise(501), compressed=k % 7 == 0, locked=k % 5 == 0, size=F.when(k % 2 == 0, 11).otherwise(10))
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", src.alias("src"), F.when(k % 29 != 0, dst).alias("dst"))
    return rows.select("p_partkey", actions.clone_refusal().alias("reason"))


_GUARDED = (
    "/", "/Users", "/usr/bin", "/usr/local/x", "/System/Library", "/Library/Caches", "/Users/me", "/Users/you", "/Users/me/Documents", "/Users/you/Library/Caches", "/Users/me/.ssh/id", "/Users/me/Library/Mail/V10",
    "/Users/me/Library/CloudStorage/Drive", "/Users/me/Library/CloudStorage/Drive/a", "/Volumes/Disk", "/Volumes/Disk/a", "relative", "/a/../b", "/a//b", "/a/..", "/Users/me/Downloads/x.zip", "/private/var/db/x", "/private/var/folders/x", "/opt/homebrew", "/opt/homebrew/x", "/tmp/x",
)
_REFUSED = {
    "system location": ("/", "/Users", "/usr/bin", "/System/Library", "/Library/Caches", "/private/var/db/x", "/opt/homebrew"), "home directory": ("/Users/me", "/Users/you"), "standard home folder": ("/Users/me/Documents", "/Users/you/Library/Caches"),
    "credentials or mail": ("/Users/me/.ssh/id", "/Users/me/Library/Mail/V10"), "cloud storage folder": ("/Users/me/Library/CloudStorage/Drive",), "volume root": ("/Volumes/Disk",), "not an absolute, normalized path": ("relative", "/a/../b", "/a//b", "/a/.."),
}


@query("guardrail_refusal", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {next((repr(r) for r, ps in _REFUSED.items() if p in ps), 'NULL')})" for p in _GUARDED) + ") AS v(path, reason)")
def guardrail_refusal(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in _GUARDED], "path string").select("path", guardrails.refusal(F.col("path"), HOME).alias("reason"))


@query("status_volume", "SELECT r_name AS name, (r_regionkey + 1) * 1000 AS total, r_regionkey * 100 AS free, greatest(r_regionkey * 150, r_regionkey * 100) AS available, (r_regionkey + 1) * 1000 - r_regionkey * 100 AS used, r_regionkey * 50 AS purgeable FROM region")
def status_volume(spark, sf_dir):
    from boscage import api

    r = derived.table(spark, sf_dir, "region")
    return api.status(r.select(F.col("r_name").alias("name"), ((F.col("r_regionkey") + 1) * 1000).alias("total"), (F.col("r_regionkey") * 100).alias("free"), (F.col("r_regionkey") * 150).alias("important"))).drop("bar", "used_text")


# Scalars --------------------------------------------------------------------------------------------------------------


def _sql_bytes(n: str) -> str:
    steps = [f"({n})::DOUBLE"] + [f"(({n})::DOUBLE" + " / 1000" * k + ")" for k in range(1, 6)]
    text = lambda v, u: f"CASE WHEN {v} >= 99.95 THEN printf('%.0f', {v}) WHEN {v} >= 9.995 THEN printf('%.1f', {v}) ELSE printf('%.2f', {v}) END || ' {u}'"
    return f"CASE WHEN {steps[0]} < 999.5 THEN ({n}) || ' B' " + " ".join(f"WHEN {v} < 999.5 THEN {text(v, u)}" for v, u in zip(steps[1:5], scalars.UNITS[1:5])) + f" ELSE {text(steps[5], 'PB')} END"


@query("fmt_bytes", f"SELECT o_orderkey, {_sql_bytes('o_orderkey * o_orderkey * 37 + o_orderkey')} AS text FROM orders")
def fmt_bytes(spark, sf_dir):
    k = F.col("o_orderkey")
    return derived.table(spark, sf_dir, "orders").select(k, scalars.fmt_bytes(k * k * 37 + k).alias("text"))


_SIZES = (("500k", 500000), ("10M", 10000000), ("1.5GB", 1500000000), ("2GiB", 2147483648), ("12", 12), (" 7 kb ", 7000), ("1b", 1), ("x", None), ("-5", None), ("5 parsecs", None), ("1.2.3k", None), ("", None), ("9999999T", None), (".5k", 500), ("1tib", 1099511627776))


@query("parse_bytes", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {-1 if v is None else v}::BIGINT)" for s, v in _SIZES) + ") AS v(text, bytes)")
def parse_bytes(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in _SIZES], "text string").select("text", F.coalesce(scalars.parse_bytes(F.col("text")), F.lit(-1)).alias("bytes"))


_AGES = (("12h", 43200.0), ("30d", 2592000.0), ("2w", 1209600.0), ("6M", 15552000.0), ("1y", 31536000.0), ("1.5d", 129600.0), ("5", None), ("d", None), ("-1d", None), ("3x", None))


@query("parse_age", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {-1 if v is None else v}::DOUBLE)" for s, v in _AGES) + ") AS v(text, seconds)")
def parse_age(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in _AGES], "text string").select("text", F.coalesce(scalars.parse_age(F.col("text")), F.lit(-1.0)).alias("seconds"))


def _sql_unit(s: str, per: int, unit: str) -> str:
    return f"({s} // {per}) || ' {unit}' || CASE WHEN {s} // {per} = 1 THEN '' ELSE 's' END || ' ago'"


@query("fmt_ago", f"SELECT o_orderkey, CASE WHEN s < 3600 THEN 'just now' WHEN s < 86400 THEN {_sql_unit('s', 3600, 'hour')} WHEN s < 5184000 THEN {_sql_unit('s', 86400, 'day')} WHEN s < 63072000 THEN {_sql_unit('s', 2592000, 'month')} ELSE {_sql_unit('s', 31536000, 'year')} END AS ago FROM (SELECT o_orderkey, o_orderkey * o_orderkey - 5 AS s FROM orders)")
def fmt_ago(spark, sf_dir):
    k = F.col("o_orderkey")
    return derived.table(spark, sf_dir, "orders").select(k, scalars.fmt_ago((k * k - 5).cast("double")).alias("ago"))


@query("fmt_middle_truncate", "SELECT p_partkey, CASE WHEN length(p_name || p_type) > 16 THEN left(p_name || p_type, 5) || '…' || right(p_name || p_type, 10) ELSE p_name || p_type END AS text FROM part")
def fmt_middle_truncate(spark, sf_dir):
    return derived.table(spark, sf_dir, "part").select("p_partkey", scalars.middle_truncated(F.concat("p_name", "p_type"), 16).alias("text"))


@query(
    "fmt_misc",
    "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) || ' item' || CASE WHEN o_orderkey * 1000 = 1 THEN '' ELSE 's' END AS plural, CASE WHEN s < 10 THEN printf('%.1f', s) || 's' WHEN s < 90 THEN trunc(s)::BIGINT || 's' ELSE trunc(s)::BIGINT // 60 || 'm ' || trunc(s)::BIGINT % 60 || 's' END AS seconds, lpad(o_orderkey::VARCHAR, 12, ' ') AS padded FROM (SELECT o_orderkey, o_orderkey / 8.0 AS s FROM orders)",
)
def fmt_misc(spark, sf_dir):
    k = F.col("o_orderkey")
    return derived.table(spark, sf_dir, "orders").select(k, scalars.fmt_plural(k * 1000, "item").alias("plural"), scalars.fmt_seconds(k / 8.0).alias("seconds"), scalars.left_padded(k.cast("string"), 12).alias("padded"))


_SUFFIXES = (" copy", " (1).txt", " 2.txt", "-old", ".txt", " copy 2.tar", ".jpeg2000", " 12", "_backup.zip", "")
_NAMES = f"n AS (SELECT p_partkey, p_name || [{', '.join(f"'{x}'" for x in _SUFFIXES)}][p_partkey % {len(_SUFFIXES)} + 1] AS name, p_name || '.txt' AS original FROM part)"
_STEM = "CASE WHEN regexp_matches(name, '^.+\\.([^. ]{1,5})$') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END"
_STRONG = "regexp_matches({}, '([ ._-]copy( ?[0-9]+)?$)|(^copy of )|( ?\\([0-9]+\\)$)|([ ._-]salinan( ?[0-9]+)?$)|(^salinan )|([ ._-]kopie( ?[0-9]+)?$)', 'i')"


def _names(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part")
    suffix = F.get(F.array(*[F.lit(x) for x in _SUFFIXES]), (F.col("p_partkey") % len(_SUFFIXES)).cast("int"))
    return p.select("p_partkey", F.concat("p_name", suffix).alias("name"), F.concat("p_name", F.lit(".txt")).alias("original"))


@query("name_stem", _q(f"SELECT p_partkey, {_STEM} AS stem FROM n", _NAMES))
def name_stem(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", names.stem(F.col("name")).alias("stem"))


@query("has_copy_pattern", _q(f"SELECT p_partkey, {_STRONG.format(_STEM)} AS copy FROM n", _NAMES))
def has_copy_pattern(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", names.has_copy_pattern(F.col("name")).alias("copy"))


@query(
    "copy_score",
    _q(f"SELECT p_partkey, CASE WHEN {_STRONG.format(_STEM)} THEN 2 WHEN regexp_matches(name, '(^|[ ._-])(backup|backups|bak|old|orig|archive|archived|tmp|temp)($|[ ._-])', 'i') THEN 1 ELSE 0 END + 1 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS score FROM n", _NAMES),
)
def copy_score(spark, sf_dir):
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/Users/me/Downloads/old/").otherwise("/Users/me/x/old/"), "name")
    return _names(spark, sf_dir).select("p_partkey", names.copy_score(path, HOME).alias("score"))


@query("numbered_base", _q(f"SELECT p_partkey, CASE WHEN regexp_matches(stem, '^.+ [0-9]{{1,2}}$') THEN regexp_replace(stem, ' [0-9]{{1,2}}$', '') END AS base FROM (SELECT p_partkey, {_STEM} AS stem FROM n)", _NAMES))
def numbered_base(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", names.numbered_base(names.stem(F.col("name"))).alias("base"))


@query("in_same_series", "SELECT p_partkey, true AS series FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey % 3 <> 0")
def in_same_series(spark, sf_dir):
    other = F.when(F.col("p_partkey") % 3 == 0, "Draft 7.doc").when(F.col("p_partkey") % 3 == 1, "Draft.doc").otherwise("Sketch 7")
    return derived.table(spark, sf_dir, "part").select("p_partkey", names.in_same_series(F.lit("Draft 5.txt"), other).alias("series"))


_VARIANTS = (("Report 2.txt", "Report.txt", True), ("Report-old", "Report", True), ("Raw backup", "Raw", True), ("Old Report.txt", "Report.txt", True), ("file.1", "file", True), ("Report", "Report", False), ("Reports.txt", "Report.txt", False), ("xReport", "Report", False), ("index.html.1", "index.html", True), ("Report (1).pdf", "Report.pdf", True))


@query("is_variant_name", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(v).lower()})" for a, b, v in _VARIANTS) + ") AS v(name, original, variant)")
def is_variant_name(spark, sf_dir):
    return spark.createDataFrame([(a, b) for a, b, _ in _VARIANTS], "name string, original string").select("name", "original", names.is_variant_name(F.col("name"), F.col("original")).alias("variant"))


@query("numbered_copy_bonus", _q("SELECT path, 0 AS score FROM s", _DOCS, _EXTRA, _GROUPS))
def numbered_copy_bonus(spark, sf_dir):
    return _doc_members(spark, sf_dir)[0].select("path", "score")


@query("path_parent_base", _q("SELECT path, parent_path, name FROM docs", _DOCS))
def path_parent_base(spark, sf_dir):
    return derived.docs_files(spark, sf_dir).select("path", paths.parent(F.col("path")).alias("parent_path"), paths.basename(F.col("path")).alias("name"))


@query("path_abbreviate", _q("SELECT path, CASE WHEN path LIKE '/docs/src1/%' THEN '~' || substr(path, 11) ELSE path END AS short FROM docs", _DOCS))
def path_abbreviate(spark, sf_dir):
    return derived.docs_files(spark, sf_dir).select("path", paths.abbreviate(F.col("path"), "/docs/src1").alias("short"))


@query("mode_kind", "SELECT * FROM (VALUES (33188, 'file'), (16877, 'dir'), (41471, 'symlink'), (8630, 'other')) AS v(mode, kind)")
def mode_kind(spark, sf_dir):
    return spark.createDataFrame([(33188,), (16877,), (41471,), (8630,)], "mode int").select("mode", paths.kind_of_mode(F.col("mode")).alias("kind"))


@query("scan_catalog", "SELECT 'dir' AS kind, 2::BIGINT AS n UNION ALL SELECT 'file', 2 UNION ALL SELECT 'symlink', 1")
def scan_catalog(spark, sf_dir):
    """A scan of a small directory that is made for it, on the machine of a local session."""
    import os
    import tempfile

    from boscage.sources.local import LocalTree

    top = tempfile.mkdtemp(prefix="boscage-scan-")
    os.mkdir(f"{top}/sub")
    for name in ("a.txt", "sub/.hidden"):
        with open(f"{top}/{name}", "w") as f:
            f.write("x" * 10)
    os.symlink("a.txt", f"{top}/link")
    spark.dataSource.register(LocalTree)
    return spark.read.format("local_tree").option("path", top).load().groupBy("kind").agg(F.count("*").alias("n"))


@query("holds_large_group", _q("SELECT '/orders/' || l_orderkey || '/' || l_linenumber AS path, 'similarFolder' AS hold FROM entries WHERE content IN (SELECT content FROM entries GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 512)", _ORDERS))
def holds_large_group(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    found = dupes.members(rows, 1, include_folders=False)
    many = found.groupBy("kind", "digest").agg(F.count_distinct("parent_path").alias("n")).where(F.col("n") > dupes.MAX_FOLDERS_COMPARED).select("kind", "digest")
    found = materialize(found.join(many.hint("merge"), ["kind", "digest"], "left_semi"), "members")
    return dupes.holds(found, rows, most=dupes.MAX_FOLDERS_COMPARED).select("path", "hold")
