"""Core queries against their oracles on the smallest tables."""

import hashlib

import duckdb
import pytest

from boscage import catalog_queries as C

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["dup_files", "dir_rollup", "shared_extra", "dup_folders", "dupes_groups", "big_breakdown", "junk_artifact_items", "snapshot_diff", "fmt_bytes", "copy_score", "guardrail_refusal", "folder_resemblance"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(repr([r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, duck, name):
    got = C.QUERIES[name](spark, SF)
    want = duck.sql(C.ORACLES[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(C.QUERIES) == set(C.ORACLES)


def test_samples_of_all_texts(spark, duck, tmp_path):
    """Texts beyond ASCII and beyond twice the sample: query, oracle and plain Python agree."""
    long = "abcdé" * 40_000
    texts = ["", "plain", "ünïcode", "ünïcode", long, long, long[:110_000] + "X" + long[110_001:], "é" * 32_768 + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    raw = [t.encode() for t in texts]
    digest = [hashlib.sha256(b[:65536] + b[-65536:]).hexdigest() for b in raw]
    want = {"file_sample_digest_all": sorted(enumerate(digest)), "sample_survivors_all": [(i,) for i in range(len(raw)) if [(len(b), d) for b, d in zip(raw, digest)].count((len(raw[i]), digest[i])) > 1]}
    for name, rows in want.items():
        assert sorted(map(tuple, C.QUERIES[name](spark, str(tmp_path)).collect())) == rows == sorted(con.sql(C.ORACLES[name]).fetchall())
    assert want["sample_survivors_all"] == [(2,), (3,), (4,), (5,), (6,)]


def test_keep_rank_of_a_copy_in_many_folders(spark, tmp_path):
    """A text in more than 512 folders: query and oracle agree, and one copy ranks first."""
    rows = [(i, "same text", f"l{i % 2}", f"s{i // 2}") for i in range(1200)] + [(2000 + i, f"text {i}", "l0", f"s{i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, C.QUERIES["keep_rank"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(C.ORACLES["keep_rank"]).fetchall())
    assert sorted(r for _, r in got) == list(range(1, 1201))


def test_aligned_files_of_folders(spark, duck):
    """Folders are walked in lockstep, too: query and oracle agree on groups of both kinds."""
    got = C.QUERIES["aligned_files_all"](spark, SF)
    want = duck.sql(C.ORACLES["aligned_files_all"])
    rows = [tuple(r) for r in got.collect()]
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())
    assert {r[0] for r in rows} == {"dir", "file"}
