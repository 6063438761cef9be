"""Catalogs derived from the Parquet tables, so that queries over file systems have data at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscage.sources.schema import complete, directories_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /docs/<source>/<lang>/<id>.txt. Every seventh shares storage with its neighbour seven before."""
    d = table(spark, sf_dir, "documents")
    shared = F.col("doc_id") % 7 == 0
    return complete(
        d.select(
            F.concat(F.lit("/docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            F.octet_length("text").cast("bigint").alias("own_size"),
            (F.ceil(F.octet_length("text") / 4096) * 4096).cast("bigint").alias("own_alloc"),
            (F.lit(1704067200) + F.col("doc_id") * 60).alias("mtime"),
            (F.col("doc_id") + 1000).alias("inode"),
            F.when(shared, F.floor(F.col("doc_id") / 14)).otherwise(F.col("doc_id") + 1000).alias("clone_id"),
            shared.alias("maybe_shared"),
            F.encode("text", "UTF-8").alias("content"),
        )
    )


def docs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs_files with their directories."""
    files = docs_files(spark, sf_dir)
    return files.unionByName(complete(directories_of(files)))


def sales_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as files /<region>/<nation>/<customer>/<order>/<line>, of their quantity in bytes."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("own_size"), F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("mtime"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("/sales/"), F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return complete(rows.select(path.alias("path"), "own_size", "mtime", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inode")))


def sales_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sales_files(spark, sf_dir)
    return files.unionByName(complete(directories_of(files)))


def order_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders /orders/<order> with a file for each line number, whose content is its flags."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.sort_array(F.collect_list(F.concat("l_returnflag", "l_linestatus"))), ",").alias("content"))
    files = complete(
        lines.select(
            F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path"),
            F.length("content").cast("bigint").alias("own_size"),
            F.encode("content", "UTF-8").alias("content"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("inode"),
        )
    )
    return files.unionByName(complete(directories_of(files)))


#: Entries that the lines of an order stand for in projects(): line number, relative path, kind.
PROJECT_ENTRIES = (
    (1, "package.json", "file"),
    (2, "node_modules", "dir"),
    (2, "node_modules/left-pad.js", "file"),
    (3, "yarn.lock", "file"),
    (4, "target", "dir"),
    (4, "target/.rustc_info.json", "file"),
    (5, "build", "dir"),
    (5, "build/CMakeCache.txt", "file"),
    (6, "CMakeLists.txt", "file"),
    (7, "venv", "dir"),
    (7, "venv/pyvenv.cfg", "file"),
)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as projects /work/<order>: which entries a project has depends on its line numbers."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("q"), F.max(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("mtime"))
    entries = spark.createDataFrame(list(PROJECT_ENTRIES), "line int, rel string, kind string")
    rows = lines.join(F.broadcast(entries), F.col("l_linenumber") == F.col("line"))  # eleven rows
    base = F.concat(F.lit("/work/"), F.col("l_orderkey").cast("string"))
    size = F.when(F.col("kind") == "file", F.col("q") * 1000).otherwise(0)
    files = rows.select(F.concat(base, F.lit("/"), "rel").alias("path"), "kind", size.alias("own_size"), "mtime")
    tops = lines.select(base.alias("path"), F.lit("dir").alias("kind"), F.lit(0).cast("bigint").alias("own_size"), F.lit(0).cast("bigint").alias("mtime")).distinct()
    root = spark.createDataFrame([("/work", "dir", 0, 0)], "path string, kind string, own_size bigint, mtime bigint")
    return complete(files.unionByName(tops).unionByName(root))


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files below their host."""
    p = table(spark, sf_dir, "pages")
    return complete(p.select(F.concat(F.lit("/pages/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"), F.octet_length("html").cast("bigint").alias("own_size"), F.col("page_id").alias("inode")))
