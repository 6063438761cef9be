"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by a keyed hash, form one stream of words. Slot i of the schedule takes the point
frac(i * golden ratio) through the cumulative targets to a source; one slot at the end is added for each source that no point met. The slots of a source
share its target, rounded to words, in equal blocks (to a word) of its own, and the r-th slot takes the r-th block of the stream;
past the end of the stream a second pass begins. How much of a source is taken follows from its target alone, so that every source ends
at it to a word, however small it is beside the others; when it is taken follows from the schedule: slot is where a document's first word
falls, every stretch of slots is close to the targets, and mixed_texts writes the rows of every partition in this order.

Positions in a stream are prefix sums over hash ranges of a source, so a source with a third of all documents is
spread over many tasks. The schedule has a number of slots that depends on the number of sources only.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last; rows
with equal ids are separate documents; without documents the result is empty; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boscage.llm.common import SPACE, WORD, bounded, materialize

WEIGHTS, BUDGET, MOST_PASSES = (5, 2, 1), 1.5, 2
#: Slots of the schedule: at least this many, and this many a source.
SLOTS, SLOTS_PER_SOURCE = 1 << 17, 1 << 10
#: Documents of a source in one range of its shuffled stream.
RANGE_DOCS = 1024
_GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: dict, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST_PASSES) -> dict:
    """Words to take by source: weights repeat over the sources by code point, null last; what exceeds most times a source's size is reshared."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = budget * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / share > most * sizes[s]]
        if not over:
            return fixed | {s: rest * w[s] / share for s in free}
        fixed |= {s: float(most * sizes[s]) for s in over}


def _schedule(bounds: np.ndarray):
    def run(frames):
        for f in frames:
            points = f["slot"].to_numpy() * _GOLDEN % 1.0
            yield pd.DataFrame({"slot": f["slot"], "source_no": np.searchsorted(bounds, points, "right").clip(0, len(bounds) - 1).astype("int32")})

    return run


def schedule(table: DataFrame, bounds: np.ndarray, n_slots: int) -> DataFrame:
    """slot, source_no, its rank among the n slots of the source, start and words of the block it takes (start counts repeated passes), for sources (source_no, quota) with cumulative shares bounds."""
    slots = table.sparkSession.range(n_slots).withColumnRenamed("id", "slot").mapInPandas(_schedule(bounds), "slot long, source_no int")
    unmet = table.where("quota > 0").join(slots.select("source_no").distinct(), "source_no", "left_anti").select((F.lit(n_slots) + F.col("source_no")).cast("long").alias("slot"), "source_no")
    slots = slots.unionByName(unmet)
    slots = slots.withColumn("rank", F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1)
    n = slots.groupBy("source_no").agg(F.count("*").alias("n"))
    slots = slots.join(F.broadcast(n), "source_no").join(F.broadcast(table.select("source_no", "quota")), "source_no")
    return slots.select("slot", "source_no", F.col("rank").cast("long").alias("rank"), "n", F.expr("quota div n * rank + least(rank, quota % n)").alias("start"), F.expr("quota div n + if(rank < quota % n, 1L, 0L)").alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: int = 17, weights=WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), slot, and the columns of keep; a row for each input row.

    Within a pass a document's words are taken from its start. slot is the schedule's slot whose block has the document's first word; null where nothing is taken.
    """
    spark = docs.sparkSession
    keep = keep or []
    clash = {"doc_id", "source", "size", "source_size", "target", "taken", "slot"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep would clash: {sorted(clash)}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))).alias("at"), *keep)
    rows = materialize(rows, "sizes")
    per = [(r["source"], r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]  # a row a source
    sizes = {s: n for s, n, _ in per}
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    aim = targets(sizes, weights, budget) if names else {}
    total = sum(aim.values())
    n_slots = max(SLOTS, SLOTS_PER_SOURCE * len(names))
    n_slots = min(n_slots, math.ceil(total))
    n_ranges = bounded(max((n for *_, n in per), default=0) // RANGE_DOCS, 1, 1 << 20)
    table = spark.createDataFrame(
        [(i, s, sizes[s], float(aim[s]), round(aim[s])) for i, s in enumerate(names)] or [(0, None, 0, 0.0, 0)], "source_no int, source string, source_size long, target double, quota long"
    )
    # A row a source: small beside any table of documents.
    rows = rows.join(F.broadcast(table.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Where each document starts in its source's stream: words of earlier ranges, then of earlier documents of its range.
    rows = rows.withColumn("range", F.pmod(F.shiftright("at", 20), F.lit(n_ranges)))
    before = rows.groupBy("source_no", "range").agg(F.sum("size").alias("in_range"))
    before = before.select("source_no", "range", (F.sum("in_range").over(Window.partitionBy("source_no").orderBy("range")) - F.col("in_range")).alias("range_start"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "range").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(before, ["source_no", "range"]).withColumn("start", F.col("range_start") + F.col("inside")).drop("range", "inside", "range_start", "at")
    rows = materialize(rows, "streams")
    bounds = np.cumsum([aim[x] for x in names]) / total if total else np.array([1.0])
    slots = materialize(schedule(table, bounds, n_slots), "slots")
    # How many slots a source has: a row a source.
    rows = rows.join(F.broadcast(slots.groupBy("source_no").agg(F.max("n").alias("n"))), "source_no", "left")
    # Blocks follow each other: whole passes, and of the last one the words before its end.
    passes, end = F.expr("coalesce(quota div nullif(source_size, 0), 0)"), F.expr("coalesce(quota % nullif(source_size, 0), 0)")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), end - F.col("start")))
    # The block that the first word is in: the first quota % n blocks have a word more.
    rank = F.expr("if(start < quota % n * (quota div n + 1), start div (quota div n + 1), quota % n + (start - quota % n * (quota div n + 1)) div nullif(quota div n, 0))")
    rows = rows.withColumn("taken", taken).withColumn("rank", F.when(F.col("taken") > 0, rank))
    rows = rows.join(slots.select("source_no", "rank", "slot").hint("merge"), ["source_no", "rank"], "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "slot", *keep)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows of docs, all columns: a whole copy for each full pass over a document, and for a pass that ends inside it
its first words, joined by blanks; in every partition the first passes by slot, then the second ones. Documents the mix takes nothing of have no row.
    """
    # Rows are told apart by all that can be hashed; those that nothing tells apart share one row and the counts of their shares.
    told = [F.col(f.name) for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.withColumn("_text_hash", F.xxhash64(text_col)).withColumn("_row", F.xxhash64(*told, *[c.isNull() for c in told]))
    taken = mix(rows, id_col, text_col, source_col, keep=["_text_hash", "_row"], **how).where("taken > 0")
    key = {"doc_id": "_id", "source": "_source", "_text_hash": "_hash", "_row": "_key"}
    taken = taken.groupBy(*[F.col(c).alias(n) for c, n in key.items()], "size", "taken").agg(F.count("*").alias("_copies"), F.min("slot").alias("_slot")).withColumnsRenamed({"size": "_size", "taken": "_taken"})
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_row") == F.col("_key")) & F.col("_text_hash").eqNullSafe(F.col("_hash"))
    rows = rows.dropDuplicates([id_col, source_col, "_text_hash", "_row"]).join(taken, same)
    none = F.array().cast("array<bigint>")

    part = F.col("_taken") % F.col("_size")
    shares = F.concat(F.array_repeat(F.col("_size"), F.floor(F.col("_taken") / F.col("_size")).cast("int")), F.when(part > 0, F.array(part)).otherwise(none))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("*", F.posexplode(shares).alias("_pass", "_take")).sortWithinPartitions("_pass", "_slot")
    words = F.filter(F.split(text_col, SPACE), lambda w: w != "")
    cut = F.when(F.col("_take") >= F.col("_size"), F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, F.col("_take").cast("int")), " "))
    return rows.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])
