"""Operators on small catalogs, after the cases of FIXTURES.md."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from boscage import api
from boscage.functions import names, paths, scalars
from boscage.operators import big, diff, dupes, excludes, junk, tree
from boscage.plans import actions, guardrails
from boscage.sources.schema import complete

HOME = "/Users/me"


def content(seed: int, size: int) -> bytes:
    return random.Random(seed).randbytes(size)


def catalog(spark, rows):
    """rows: path, or (path, bytes), or (path, dict of columns)."""
    out = []
    for r in rows:
        path, v = r if isinstance(r, tuple) else (r, {"kind": "dir"})
        v = {"content": v, "own_size": len(v), "kind": "file"} if isinstance(v, bytes) else dict(v)
        out.append({"path": path, "inode": len(out) + 1, **v})
    have = {p["path"] for p in out}
    for p in [p["path"] for p in out]:
        up = p.rsplit("/", 1)[0]
        while up:
            if up not in have:
                have.add(up)
                out.append({"path": up, "kind": "dir", "inode": len(out) + 1})
            up = up.rsplit("/", 1)[0]
    cols = {"path": "string", "kind": "string", "own_size": "bigint", "inode": "bigint", "content": "binary", "mtime": "bigint", "clone_id": "bigint", "maybe_shared": "boolean", "link_target": "string", "resource_fork": "boolean", "fork": "binary", "unreadable": "boolean"}
    rows = [tuple(r.get(c) for c in cols) for r in out]
    return complete(spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in cols.items())))


def project(name):
    return [(f"{name}/readme.md", b"0123456789"), (f"{name}/src/main.c", content(11, 3000)), (f"{name}/src/util.c", content(12, 2000)), (f"{name}/assets/logo.png", content(13, 50000)), f"{name}/empty"]


def run(spark, rows, **how):
    found, _ = api.dupe_members(catalog(spark, rows), HOME, min_size=1, **how)
    groups = {}
    for r in found.collect():
        groups.setdefault((r["kind"], r["digest"]), []).append(r)
    return {tuple(sorted(m["path"] for m in g)): {m["path"]: m for m in g} for g in groups.values()}


def test_one_folder_group(spark):
    rows = project("/t/Project") + project("/t/Project copy") + project("/t/Backups/Project")
    groups = run(spark, rows)
    assert list(groups) == [("/t/Backups/Project", "/t/Project", "/t/Project copy")]
    (g,) = groups.values()
    assert g["/t/Project"]["file_count"] == 4 and g["/t/Project"]["total_size"] == 55010
    assert [p for p in g if not g[p]["suggested"]] == ["/t/Project"]


def test_largest_identical_parts_and_settings_files(spark):
    groups = run(spark, project("/t/A") + project("/t/B") + [("/t/B/src/extra.c", b"x")])
    assert sorted(len(k) for k in groups) == [2, 2, 2, 2]
    assert ("/t/A/assets", "/t/B/assets") in groups
    same = run(spark, project("/t/A") + project("/t/B") + [("/t/B/.DS_Store", b"")])
    assert list(same) == [("/t/A", "/t/B")]
    other = run(spark, project("/t/A") + project("/t/B") + [("/t/B/.env", b"k")])
    assert ("/t/A", "/t/B") not in other and ("/t/A/src", "/t/B/src") in other


def test_hidden_tools_bundles(spark):
    assert not run(spark, [("/t/.cache-a/x", b"same"), ("/t/.cache-b/x", b"same")])
    assert len(run(spark, [("/t/.cache-a/x", b"same"), ("/t/.cache-b/x", b"same")], hidden=True)) == 1
    tools = [f"/t/{d}" for d in ("app", "app-backup")]
    groups = run(spark, [(f"{d}/node_modules/p/i.js", b"abc") for d in tools] + [(f"{d}/main.js", b"m") for d in tools])
    assert list(groups) == [("/t/app", "/t/app-backup")]
    groups = run(spark, [("/t/Tool.app/x", b"1"), ("/t/Old/Tool.app/x", b"1"), ("/t/Other.app/x", b"2")])
    assert ("/t/Old/Tool.app", "/t/Tool.app") in groups and len(groups) == 1


def test_links_and_forks(spark):
    link = lambda t: {"kind": "symlink", "link_target": t, "own_size": len(t)}
    groups = run(spark, [("/t/A/l", link("data.bin")), ("/t/B/l", link("data.bin")), ("/t/C/l", link("DATA.BIN")), ("/t/A/f", b"x"), ("/t/B/f", b"x"), ("/t/C/f", b"x")], folders_only=True)
    assert list(groups) == [("/t/A", "/t/B")]
    fork = lambda f: {"kind": "file", "content": b"same", "own_size": 4, "resource_fork": f is not None, "fork": f}
    groups = run(spark, [("/t/a", fork(b"1")), ("/t/b", fork(b"1")), ("/t/c", fork(b"2")), ("/t/d", fork(None))])
    assert list(groups) == [("/t/a", "/t/b")]


def test_repository_sibling_similar_container_holds(spark):
    g = run(spark, ["/t/repo/.git", ("/t/repo/data", b"d"), ("/t/Downloads/data", b"d")])
    (m,) = g.values()
    assert m["/t/repo/data"]["hold"] == "repository" and m["/t/Downloads/data"]["suggested"]
    (m,) = run(spark, [("/t/x/en-GB", b"d"), ("/t/x/en-US", b"d")]).values()
    assert {r["hold"] for r in m.values()} == {"sibling"}
    (m,) = run(spark, [("/t/x/guide", b"d"), ("/t/x/guide-old", b"d")]).values()
    assert m["/t/x/guide-old"]["suggested"] and not m["/t/x/guide"]["suggested"]
    site = [(f"/t/site-v{v}/{n}", f"{n}{v}".encode()) for v in (1, 2) for n in ("index", "style", "app")] + [(f"/t/site-v{v}/same", b"same") for v in (1, 2)]
    m = run(spark, site)[("/t/site-v1/same", "/t/site-v2/same")]
    assert {r["hold"] for r in m.values()} == {"similarFolder"}
    m = run(spark, site, containers=["/t/site-v2"])[("/t/site-v1/same", "/t/site-v2/same")]
    assert m["/t/site-v2/same"]["suggested"]


def test_nested_survivors(spark):
    rows = project("/t/A") + project("/t/A copy") + [("/t/Desktop/assets/logo.png", content(13, 50000))]
    groups = run(spark, rows)
    inner = groups[("/t/A copy/assets", "/t/A/assets", "/t/Desktop/assets")]
    assert [inner[p]["hold"] for p in sorted(inner)] == ["nested", "nested", None]
    assert inner["/t/Desktop/assets"]["suggested"]


def test_clones_free_nothing(spark):
    shared = lambda c: {"kind": "file", "content": b"m" * 100, "own_size": 100, "clone_id": c, "maybe_shared": True}
    nodes = catalog(spark, [("/t/a", shared(9)), ("/t/a copy", shared(9)), ("/t/x/a (1)", {"kind": "file", "content": b"m" * 100, "own_size": 100})])
    (g,) = api.dupes(nodes, HOME, min_size=1).collect()
    assert (g["reclaimable"], g["shared"]) == (100, 100)
    assert tree.with_shared_extra(nodes).where("shared_extra").select("path").collect()[0][0] == "/t/a copy"


def test_cascade(spark):
    big_a, big_b = b"h" * 300000, b"h" * 100000 + b"x" * 100000 + b"h" * 100000
    shared = lambda b, c: {"kind": "file", "content": b, "own_size": len(b), "clone_id": c, "maybe_shared": True}
    rows = dupes.cascade(catalog(spark, [("/t/a", big_a), ("/t/b", big_b), ("/t/c", big_a), ("/t/e", b""), ("/t/u", b"123"), ("/t/s1", shared(b"zz", 7)), ("/t/s2", shared(b"zz", 7)), ("/t/r1", b"pqrs"), ("/t/r2", b"pqrs")]).where("kind = 'file'"))
    stage = {r["path"]: (r["stage"], r["identity"]) for r in rows.collect()}
    assert {p: s[0] for p, s in stage.items()} == {"/t/a": "full", "/t/b": "full", "/t/c": "full", "/t/e": "empty", "/t/u": "unique", "/t/s1": "stream", "/t/s2": "stream", "/t/r1": "read", "/t/r2": "read"}
    assert stage["/t/a"][1] == stage["/t/c"][1] != stage["/t/b"][1]
    s = dupes.cascade_stats(rows).head()
    assert (s["candidate_files"], s["sampled_files"], s["hashed_files"], s["stream_matched_files"]) == (9, 5, 5, 2)


def test_many_parent_folders_hold(spark):
    rows = [(f"/t/d{i}/f", b"same") for i in range(5)]
    nodes = tree.with_totals(tree.with_shared_extra(catalog(spark, rows)))
    nodes = dupes.zones(nodes).withColumn("digest", F.when(F.col("kind") == "file", dupes.file_digest(F.col("content"))))
    found = dupes.members(nodes, 1)
    assert {r["hold"] for r in dupes.holds(found, nodes, most=4).collect()} == {"similarFolder"}
    assert {r["hold"] for r in dupes.holds(found, nodes, most=5).collect()} == {None}


def test_sequential_rule_agrees_with_set_rule():
    rnd = random.Random(3)
    for _ in range(200):
        groups = [{"size": rnd.randrange(1, 9), "kind": "file", "members": [{"path": f"/g{g}/{m}", "hold": rnd.choice([None, None, "sibling"]), "rank": m + 1, "depth": 2} for m in range(rnd.randrange(2, 5))]} for g in range(4)]
        out = dupes.suggest_in_order(groups)
        for g in groups:
            free = [m for m in g["members"] if m["hold"] is None]
            held = len(free) < len(g["members"])
            want = {m["path"] for m in (free if held else free[1:])}
            assert {p for p in out if out[p] and p.startswith(g["members"][0]["path"].rsplit("/", 1)[0])} == want


def test_keep_rules(spark):
    f = lambda t: {"kind": "file", "content": b"n", "own_size": 1, "mtime": t}
    rows = [("/t/deep/er/file.bin", f(1)), ("/t/file.bin", f(2))]
    kept = lambda **how: [p for g in run(spark, rows, **how).values() for p in g if not g[p]["suggested"]]
    assert kept() == ["/t/file.bin"] and kept(keep="oldest") == ["/t/deep/er/file.bin"] and kept(keep="newest") == ["/t/file.bin"]
    assert kept(prefer=["/t/deep"]) == ["/t/deep/er/file.bin"]
    notes = [(f"/t/{n}", b"n") for n in ("Notes 2.txt", "Notes.txt", "Notes (1).txt")]
    (g,) = run(spark, notes).values()
    assert [p for p in g if not g[p]["suggested"]] == ["/t/Notes.txt"]


def test_options(spark):
    with pytest.raises(ValueError):
        api.dupe_members(catalog(spark, ["/t"]), HOME, files_only=True, folders_only=True)
    with pytest.raises(ValueError):
        actions.dupes_plan(catalog(spark, ["/t"]), HOME, action="shred")
    assert not run(spark, [])


def test_excludes():
    import re

    assert re.match(excludes.glob_regex("*.iso"), ".x.iso") and not re.match(excludes.glob_regex("?.iso"), "xx.iso")
    assert re.match(excludes.glob_regex("[!a-c]x"), "dx") and not re.match(excludes.glob_regex("[!a-c]x"), "bx")
    assert re.match(excludes.glob_regex("a.b"), "a.b") and not re.match(excludes.glob_regex("a.b"), "axb")


def test_junk_projects(spark):
    rows = [("/h/p/package.json", b"{}"), ("/h/p/yarn.lock", b"l"), ("/h/p/node_modules/m/i.js", b"x" * 50), ("/h/q/node_modules/i.js", b"x" * 50), ("/h/r/Cargo.toml", b"t"), ("/h/r/target/debug/o", b"x" * 70),
            ("/h/mono/yarn.lock", b"l"), ("/h/mono/a/b/package.json", b"{}"), ("/h/mono/a/b/node_modules/z", b"x" * 30), ("/h/tool/venv/pyvenv.cfg", b"c"), ("/h/app/build/x", b"x"), ("/h/cm/CMakeLists.txt", b"c"), ("/h/cm/cmake-build-debug/o", b"x" * 9)]
    items = {r["targets"][0]: r for r in api.junk(catalog(spark, rows), "/Users/me", 10**9, min_size=1, known=False).collect()}
    assert {p: (r["id"], r["safety"]) for p, r in items.items()} == {
        "/h/p/node_modules": ("node_modules", "safe"), "/h/r/target": ("rust-target", "safe"), "/h/mono/a/b/node_modules": ("node_modules", "safe"), "/h/tool/venv": ("python-venv", "review"), "/h/cm/cmake-build-debug": ("cmake-build", "safe"),
    }
    loose = api.junk(catalog(spark, [("/h/p/package.json", b"{}"), ("/h/p/node_modules/i", b"x")]), "/Users/me", 10**9, min_size=1, known=False).collect()
    assert [r["safety"] for r in loose] == ["review"] and loose[0]["note"].startswith("No lockfile")


def test_junk_locations(spark):
    h = "/Users/me"
    rows = [(f"{h}/Library/Caches/Homebrew/a", b"x" * 20), (f"{h}/Library/Caches/com.apple.Safari/a", b"x" * 20), (f"{h}/Library/Caches/com.app/a", b"x" * 30), (f"{h}/.npm/_cacache/a", b"x" * 40), (f"{h}/.Trash/t", b"x" * 5), (f"{h}/Library/Developer/Xcode/Archives/a", b"x" * 6)]
    nodes = catalog(spark, rows)
    items = api.junk(nodes, h, 10**9, min_size=1, projects=False).collect()
    assert [(r["title"], r["safety"], r["size"]) for r in items] == [("Xcode archives", "review", 6), ("npm cache", "safe", 40), ("Cache · com.app", "safe", 30), ("Homebrew downloads", "safe", 20), ("Trash", "review", 5)]
    plan = {(r["path"], r["verdict"], r["reason"]) for r in actions.junk_plan(api.junk(nodes, h, 10**9, min_size=1, projects=False), nodes).collect()}
    assert (f"{h}/.npm/_cacache/a", "remove", None) in plan and (f"{h}/.Trash", "refused", "already in the Trash; use --delete to empty it") in plan


def test_breakdown(spark):
    rows = [("/b/videos/a", b"x" * 500), ("/b/docs/b", b"x" * 300), ("/b/small/c", b"x" * 10)]
    out = api.big(catalog(spark, rows), spark.createDataFrame([(0, "/b")], "root_ord int, path string"), depth=1, top=2, files=2)
    shown = {r["path"]: r for r in out["breakdown"].collect()}
    assert set(shown) == {"/b", "/b/videos", "/b/docs"} and (shown["/b"]["omitted_count"], shown["/b"]["omitted_size"]) == (1, 10)
    assert [r["path"] for r in out["files"].collect()] == ["/b/videos/a", "/b/docs/b"]
    nothing = big.breakdown(tree.with_totals(tree.with_shared_extra(catalog(spark, rows))), spark.createDataFrame([(0, "/b")], "root_ord int, path string"), depth=0)
    assert nothing.count() == 1


def test_diff_and_plan(spark):
    then = catalog(spark, [("/t/dir/a.txt", b"a"), ("/t/dir/sub/b.txt", b"b"), ("/t/dir/.DS_Store", b"")])
    now = catalog(spark, [("/t/dir/a.txt", b"a"), ("/t/dir/sub/b.txt", b"b"), ("/t/dir/.DS_Store", b"zz")])
    assert not diff.snapshot_diff(then, now).collect()
    more = catalog(spark, [("/t/dir/a.txt", b"a"), ("/t/dir/sub/b.txt", b"longer"), ("/t/dir/.DS_Store", b""), ("/t/dir/new", b"n")])
    got = {r["path"]: r["reason"] for r in diff.snapshot_diff(then, more).collect()}
    assert got == {"/t/dir": "entries were added or removed", "/t/dir/sub/b.txt": "modified"}
    found, _ = api.dupe_members(catalog(spark, [("/t/x/a", b"s"), ("/t/y/a", b"s"), ("/t/z/a", b"s")]), HOME, min_size=1, files_only=True)
    rows = found.withColumn("selected", F.col("path") != "/t/x/a").withColumn("change", F.when(F.col("path") == "/t/z/a", "modified"))
    plan = {r["path"]: (r["verdict"], r["keeper"]) for r in actions.dupes_plan(rows, HOME).collect()}
    assert plan == {"/t/y/a": ("done", "/t/x/a"), "/t/z/a": ("skipped", "/t/x/a")}
    every = actions.dupes_plan(found.withColumn("selected", F.lit(True)).withColumn("change", F.lit(None).cast("string")), HOME)
    assert {r["reason"] for r in every.collect()} == {"no verified copy would remain"}


def test_scalars(spark):
    vals = [(0, "0 B"), (999, "999 B"), (1000, "1.00 KB"), (12250, "12.2 KB"), (12350, "12.3 KB"), (999_500, "1.00 MB"), (100_500, "100 KB"), (-1500, "-1.50 KB"), (10**15, "1.00 PB")]
    got = spark.createDataFrame([(v,) for v, _ in vals], "n bigint").select(scalars.fmt_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == [t for _, t in vals]
    one = spark.createDataFrame([(0.25, "hello")], "x double, s string").select(scalars.fmt_bar(F.col("x"), 8), scalars.right_padded(F.col("s"), 3), scalars.middle_truncated(F.col("s"), 4), scalars.fmt_ago(F.lit(-5.0))).head()
    assert tuple(one) == ("██░░░░░░", "hello", "hello", "just now")
    rows = spark.createDataFrame([("/",), ("/a",), ("/a/b",)], "p string").select(paths.parent(F.col("p")), paths.basename(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("/", "/"), ("/", "a"), ("/a", "b")]
    assert spark.range(1).select(names.stem(F.lit(".bashrc")), names.stem(F.lit("v1.2 final")), names.stem(F.lit("a."))).head() == (".bashrc", "v1.2 final", "a.")
    assert spark.range(1).select(guardrails.refusal(F.lit("/Users/me"), HOME)).head()[0] == "home directory"


def test_normalize(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to("real")
    assert paths.normalize(str(tmp_path / "link")) == str((tmp_path / "real").resolve())
    assert paths.normalize(str(tmp_path / "gone")) is None


def test_junk_helpers(spark):
    assert junk.known_locations(spark, HOME).count() == 44
    assert junk.artifact_rules(spark).count() == 27


def test_duplicates_of_scanned_folders(spark, tmp_path):
    """A made folder is scanned, only files that can have copies are read, and groups are those of its contents."""
    from boscage.sources import local

    top = tmp_path / "top"
    big = content(5, 600_000)
    other = big[:300_000] + b"x" + big[300_001:]
    made = {"A/one.txt": b"same", "B/one.txt": b"same", "A/big": big, "B/big": big, "C/big": other, "C/alone": b"alone here", "A/target/x.o": b"o" * 50, "A/Cargo.toml": b"[p]", "B/target/x.o": b"o" * 50, "B/Cargo.toml": b"[p]", "C/empty": b""}
    for path, data in made.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(data)
    (top / "link").symlink_to(top / "A")
    spark.dataSource.register(local.LocalTree)
    scan = lambda root, **o: complete(spark.read.format("local_tree").options(path=root, **o).load())
    nodes = local.read_digests(scan(str(top)))
    digests = {r.path.removeprefix(f"{top}/"): r.content_digest for r in nodes.where("kind = 'file'").collect()}
    assert digests["A/big"] == digests["B/big"] and digests["A/one.txt"] == digests["B/one.txt"] and digests["C/big"] != digests["A/big"] and digests["C/alone"].startswith("alone")
    found, _ = api.dupe_members(nodes, str(tmp_path), min_size=1, root_parts=len(str(top).strip("/").split("/")))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["digest"], set()).add(r["path"].removeprefix(f"{top}/"))
    assert sorted(map(sorted, groups.values())) == [["A", "B"]]
    # Deeper partitions give the same rows and enter no link; missing roots are error rows.
    flat = lambda df: sorted(r.path for r in df.collect())
    assert flat(scan(str(top), sharddepth="3")) == flat(scan(str(top))) and not any("/link/" in p for p in flat(nodes))
    assert [(r.path, r.unreadable) for r in scan("/no/such/root").collect()] == [("/no/such/root", True)]
    # A file that changed after the scan is unreadable, not a copy.
    seen = spark.createDataFrame(scan(str(top)).collect(), scan(str(top)).schema)
    (top / "A/one.txt").write_bytes(b"sama!")
    late = {r.path.removeprefix(f"{top}/"): r for r in local.read_digests(seen).collect()}
    assert late["A/one.txt"].unreadable and late["A/one.txt"].content_digest is None and not late["B/one.txt"].unreadable


def _joins(df):
    """The joins of a plan whose estimates are so low that all sides could be broadcast."""
    before = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "10g")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sides_that_grow_are_not_broadcast(spark):
    """Estimates of written catalogs are too low: what grows with the catalog is merged, whatever they say."""
    nodes = complete(spark.createDataFrame([("/r/a/x", "file", 3), ("/r/a", "dir", 0), ("/r", "dir", 0)], "path string, kind string, own_size bigint"))
    rows = tree.with_totals(tree.with_shared_extra(nodes)).withColumn("digest", F.lit("d"))
    zoned = dupes.zones(rows)
    found = dupes.members(zoned, 1)
    for df in (rows, zoned, dupes.folder_digest(zoned), found, dupes.resemblance(found, zoned), dupes.holds(found, zoned)):
        assert "Broadcast" not in _joins(df)


def test_contents_end_before_the_first_join(spark, monkeypatch):
    """What joins of dupe_members move has digests in place of contents."""
    seen = []
    real = tree.without_pruned
    monkeypatch.setattr(api.tree, "without_pruned", lambda nodes, *a: seen.append(nodes.columns) or real(nodes, *a))
    nodes = complete(spark.createDataFrame([("/r/a/x", b"same"), ("/r/b/y", b"same")], "path string, content binary").withColumn("own_size", F.lit(4)))
    rows, _ = api.dupe_members(nodes, "/home/me", min_size=1, files_only=True)
    assert {r.digest for r in rows.collect()} == {hashlib.sha256(b"same").hexdigest()}
    assert len(seen) == 1 and not {"content", "fork"} & set(seen[0])


def test_resemblance_compares_two_folders_once(spark):
    """Many groups in the same two large folders: rows grow with the entries, not with groups times entries."""
    rows = [(f"/r/{d}/{d}{i}", f"g{i}") for d in "ab" for i in range(300)] + [(f"/r/{d}/same{k}", f"s{d}{k}") for d in "ab" for k in range(3)]
    nodes = complete(spark.createDataFrame([(p,) for p, _ in rows], "path string"))
    nodes = nodes.join(spark.createDataFrame(rows, "path string, digest string"), "path")
    got = dupes.resemblance(nodes.where("digest like 'g%'"), nodes)
    assert got.count() == 600
    most = {}

    def walk(plan):
        if plan.nodeName().startswith(("SortMergeJoin", "Generate", "BroadcastHashJoin")) and plan.metrics().contains("numOutputRows"):
            most[plan.nodeName()] = max(most.get(plan.nodeName(), 0), plan.metrics().apply("numOutputRows").value())
        kids = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        if "QueryStage" not in plan.nodeName():
            kids += [plan.children().apply(i) for i in range(plan.children().length())]
        for k in kids:
            walk(k)

    got._jdf.collectAsList()
    walk(got._jdf.queryExecution().executedPlan())
    assert most and max(most.values()) < 5000


@pytest.mark.parametrize("seed", range(1))
def test_resemblance_by_names_is_that_of_pairs(spark, seed):
    """Groups of many folders are compared by names, with the result of all pairs told one by one."""
    rnd = random.Random(seed)
    folders = {f"/r/d{i}": rnd.sample([f"n{k}" for k in range(12 if i % 3 else 90)], rnd.choice((1, 2, 4, 5, 6, 7, 8, 9, 11))) for i in range(40)}
    digests = {f"{f}/{n}": f"g{rnd.randrange(2)}" if n == x[0] or rnd.random() < 0.1 else f"u{f}{n}" for f, x in folders.items() for n in x}
    nodes = complete(spark.createDataFrame([(p,) for p in digests], "path string")).join(spark.createDataFrame(list(digests.items()), "path string, digest string"), "path")
    found = nodes.where("digest like 'g%'")
    want = set()
    for p, g in digests.items():
        fa, name = p.rsplit("/", 1)
        for fb in {q.rsplit("/", 1)[0] for q, h in digests.items() if h == g} - {fa} if g[0] == "g" else ():
            first = min(n for n in folders[fb] if digests[f"{fb}/{n}"] == g)
            shared = len((set(folders[fa]) - {name}) & (set(folders[fb]) - {first}))
            if shared >= 3 or (shared and shared * 10 >= 3 * (min(len(folders[fa]), len(folders[fb])) - 1)):
                want.add(p)
    for by_pairs in (1, 512):
        assert {r.path for r in dupes.resemblance(found, nodes, by_pairs=by_pairs).collect()} == want
    assert 0 < len(want) < found.count()


def test_folders_that_differ_in_a_folder_do_not_line_up(spark):
    """Lockstep covers folders and links: one more empty folder in a copy is a mismatch, and its group falls back to plain totals."""
    cols = "path string, kind string, digest string, own_size bigint, own_alloc bigint, clone_id bigint"
    made = [("/t/A", "dir", "d", 0, 0, 1), ("/t/B", "dir", "d", 0, 0, 2), ("/t/C", "dir", "e", 0, 0, 3), ("/t/D", "dir", "e", 0, 0, 4), ("/t/B/more", "dir", None, 0, 0, 5)]
    made += [(f"/t/{d}/f", "file", None, 10, 4096, 9) for d in "ABCD"]
    rows = spark.createDataFrame(made, cols)
    nodes = complete(rows.drop("digest")).join(rows.select("path", "digest"), "path").withColumn("total_alloc", F.lit(4096).cast("bigint"))
    found = nodes.where("digest is not null").withColumn("selected", F.col("path").isin("/t/B", "/t/D"))
    got = {(r.digest, r.member, r.rel, r.aligned) for r in dupes.aligned_files(found, nodes).collect()}
    assert got == {("d", "/t/A", "f", False), ("d", "/t/B", "f", False), ("e", "/t/C", "f", True), ("e", "/t/D", "f", True)}
    assert {(r.digest, r.freed, r.shared) for r in dupes.reclaim(found, nodes).collect()} == {("d", 4096, 0), ("e", 0, 4096)}
