"""A corpus pipeline of five stages, each one operator of boscage.llm over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a table; run() writes each as Parquet to the shared folder and reads it
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boscage.llm import jaccard, line_dedup, mixing, packing, toxicity
from boscage.llm.common import documents, materialize

#: The stages' decisions depend on hashes and models that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else c for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without fuzzily repeated lines; documents of which nothing is left go."""
    rows = line_dedup.line_dedup(docs, keep=["lang", "source"])
    return _columns(rows.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.lit(0)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that a pass ends in is cut there."""
    return _columns(mixing.mixed_texts(docs.select(*COLUMNS)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents in windows of 4096."""
    import public_tokenizers

    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
