"""N-gram Jaccard join by an LSH forest of MinHash signatures, with exact verification.

1. Every text becomes the set of its word 5-grams, a MinHash signature and a label in each trie of the forest. Texts with
   equal words are one class, represented once from here on.
2. A trie's label is DEPTH values of the signature in order. Each trie is a table sorted by label, without the labels that share no prefix of
   the shortest length that can be needed. Texts meet in a place, where a prefix of their labels agrees.
3. Prefixes start at full depth and are shortened by one value a level. On a level only places that hold texts of different candidate clusters
   are open, and there only texts of different clusters are compared, by sketches of their signatures; those that agree well enough join their
   clusters. Places where the same classes meet as in an earlier trie are skipped. Shortening ends where no place is open, or where a
   pair at the threshold meets in some trie with the target recall (depth()).
4. Within a cluster all pairs are verified on the exact sets of 5-grams: links are counted and linked texts become groups.

Pairs are never rows: a task returns for each class its number of links and one edge of a spanning forest. Places and clusters
beyond BLOCK members are dealt out as pairs of blocks, so that no task holds a whole large group.

Defined results: texts with equal words are copies, blank and null texts among them; a text of fewer than 5 words has its whole
word sequence as its only gram; rows with equal ids are separate documents; a null id takes part, and a class of null ids alone has a null
class id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import materialize, release, slices
from boscage.llm.components import components
from boscage.llm.substring_dedup import Words, mix

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
TRIES, DEPTH = 15, 8
#: Values of a label that are compared in step 3, its last ones, and how far below the threshold their agreement may be.
TOLD, SLACK = 4, 0.25
#: Bytes of a value in a label.
VALUE = 2
#: Classes of one block, and rows of small groups that one task takes together.
BLOCK, TOGETHER = 384, 4000


def depth(threshold: float = THRESHOLD, tries: int = TRIES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares in some trie with the target recall."""
    d = deepest
    while d > 1 and 1 - (1 - threshold**d) ** tries < recall:
        d -= 1
    return d


def _keys(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def gram_hashes(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of a slice, in order of documents, and how many each document has."""
    first, hashes = words.windows(gram)
    n = np.bincount(words.doc[first], minlength=words.n_docs)
    short = np.flatnonzero((words.count > 0) & (words.count < gram))
    if len(short):
        base = np.concatenate(([0], np.cumsum(words.count)))
        own = np.zeros(len(short), np.uint64)
        for i in range(gram - 1):
            more = words.count[short] > i
            own[more] = mix(own[more] * np.uint64(0x2545F4914F6CDD1D) + words.hash[base[short[more]] + i] + np.uint64(1))
        at = np.concatenate(([0], np.cumsum(n)))[short]
        hashes = np.insert(hashes, at, own)
        n[short] = 1
    return hashes, n


def sequence_keys(words: Words, seed: int) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    edge = np.concatenate(([0], np.cumsum(words.count)))
    place = np.arange(len(words.hash)) - np.repeat(edge[:-1], words.count)
    step = mix(words.hash + (place.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step)))
    return mix(sums[edge[1:]] - sums[edge[:-1]] + np.uint64(seed)).view(np.int64)


def signatures(hashes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (rows x size, 32 bits) of documents with n hashes each; n > 0."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    keys = _keys(2 * size, 1)
    out = np.empty((len(n), size), np.uint32)
    for i in range(size):
        y = (x ^ np.uint32(keys[2 * i] >> np.uint64(32))) * np.uint32((keys[2 * i + 1] >> np.uint64(32)) | np.uint64(1))
        out[:, i] = np.minimum.reduceat(y, at)
    return out


def _sign(gram: int, tries: int, deepest: int):
    def run(batches):
        for b in slices(batches, 1, 1_500_000):
            words = Words(b.column(1))
            keys = [sequence_keys(words, seed) for seed in (5, 6)]
            hashes, n = gram_hashes(words, gram)
            some = np.flatnonzero(n)
            labels: list = [None] * len(n)
            sketches: list = [None] * len(n)
            if len(some):
                values = signatures(hashes, n[some], tries * deepest)
                for start in range(0, len(some), 4096):
                    v = mix(values[start : start + 4096].astype(np.uint64)).reshape(-1, tries, deepest)
                    label = (v >> np.uint64(48)).astype(">u2")
                    sketch = (v[:, :, -TOLD:] & np.uint64(255)).astype(np.uint8)
                    for i, p, s in zip(some[start : start + 4096], label, sketch):
                        labels[i], sketches[i] = p.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys[0]), pa.array(keys[1]), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary()), b.column(2)], names=["doc_id", "k1", "k2", "labels", "sketch", "text_hash"]
            )

    return run


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row of its connected component."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _units(t: pa.Table):
    """Rows of each unit (root, i, j) of a table: the arrow functions below get several units at once."""
    keys = [t[c].to_numpy() for c in ("root", "i", "j")]
    order = np.lexsort((keys[2], keys[1], keys[0]))
    keys = [k[order] for k in keys]
    cut = np.flatnonzero(np.concatenate(([True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1]))))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        yield order[a:b], int(keys[1][a]), int(keys[2][a])


def _allowed(block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs that a unit decides: those of one block, or those between two."""
    if i == j:
        return ~np.eye(len(block), dtype=bool)
    return block[:, None] != block[None, :]


def _meet(least: float):
    """Units of open places: edges of a forest between clusters, for every class whose sketch agrees with that of a class of another one.

    The classes of all clusters but the largest are compared with all.
    """

    def run(t: pa.Table) -> pa.Table:
        blocks, clusters = (t[c].to_numpy() for c in ("block", "cluster"))
        blobs = t["sketch"].to_pylist()
        a, b = [], []
        for rows, i, j in _units(t):
            cluster = clusters[rows]
            _, code, count = np.unique(cluster, return_inverse=True, return_counts=True)
            minor = np.flatnonzero(code != count.argmax())
            if not len(minor):
                continue
            s = np.frombuffer(b"".join(blobs[r] for r in rows), np.uint8).reshape(len(rows), -1)
            agree = np.zeros((len(minor), len(rows)), np.uint8)
            for c in range(s.shape[1]):
                agree += s[minor, c][:, None] == s[:, c][None, :]
            links = np.zeros((len(rows), len(rows)), bool)
            links[minor] = (agree >= least * s.shape[1]) & (code[minor][:, None] != code[None, :])
            links = (links | links.T) & _allowed(blocks[rows], i, j)
            root = _forest(links)
            moved = root != np.arange(len(root))
            a.append(cluster[moved])
            b.append(cluster[root[moved]])
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct arrays, by products of incidence matrices a strip of grams at a time."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    use = shared[code]
    code, owner = rank[code[use]], owner[use]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((n, n), np.float64)
    total = int(shared.sum())
    for lo in range(0, total, width):
        x, y = np.searchsorted(code, (lo, lo + width))
        m = np.zeros((n, min(width, total - lo)), np.float32)
        m[owner[x:y], code[x:y] - lo] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    """Units of clusters: for each class that has links, their number and an edge of a spanning forest of links."""

    def run(t: pa.Table) -> pa.Table:
        nodes, blocks, blobs = t["node"].to_numpy(), t["block"].to_numpy(), t["grams"].to_pylist()
        node, links, to = [], [], []
        for rows, i, j in _units(t):
            sets = [np.frombuffer(blobs[r], np.uint64) for r in rows]
            both = overlaps(sets)
            size = np.array([len(s) for s in sets], float)
            union = size[:, None] + size[None, :] - both
            linked = (both >= threshold * union - 1e-9) & _allowed(blocks[rows], i, j)
            n = linked.sum(1)
            some = n > 0
            own = nodes[rows]
            node.append(own[some])
            links.append(n[some])
            to.append(own[_forest(linked)][some])
        none = [np.zeros(0, np.int64)]
        return pa.table({k: np.concatenate(none + v).astype(np.int64) for k, v in (("node", node), ("links", links), ("to", to))})

    return run


def _dealt(members: DataFrame, sizes: DataFrame, by: list[str], root) -> DataFrame:
    """Members with the units they belong to: small groups whole, larger ones as pairs of blocks. Adds root, block, i, j and unit."""
    rows = members.join(sizes, by).withColumn("root", root)
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows


def _dispatch(rows: DataFrame, n_rows: int) -> DataFrame:
    """A column to deal units by: units of small groups share a value, so that a call handles many."""
    shared = max(12, n_rows // TOGETHER)
    return rows.withColumn("unit", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(shared))).otherwise(F.xxhash64("root", "i", "j")))


def _confirmed(gram: int):
    """Texts found by id to the sorted gram sets of those that are their class's text."""

    def run(batches):
        for b in slices(batches, 1, 1_500_000):
            words = Words(b.column(1))
            right = sequence_keys(words, 5) == b.column(0).to_numpy()
            hashes, n = gram_hashes(words, gram)
            edge = np.concatenate(([0], np.cumsum(n)))
            grams = [np.unique(hashes[edge[i] : edge[i + 1]]).tobytes() for i in np.flatnonzero(right)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(right)), pa.array(grams, pa.binary())], names=["node", "grams"])

    return run


def sorted_tries(classes: DataFrame, shortest: int, tries: int = TRIES, deepest: int = DEPTH) -> DataFrame:
    """(trie, label, node) in order of tries and labels, for labels that share their first values, so many as shortest, of classes (node, labels)."""
    rows = classes.where("labels is not null").select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("trie"))
    rows = rows.select("trie", F.substring("labels", F.col("trie") * VALUE * deepest + 1, F.lit(VALUE * deepest)).alias("label"), "node")
    rows = rows.withColumn("prefix", F.substring("label", 1, VALUE * shortest))
    shared = rows.groupBy("trie", "prefix").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, ["trie", "prefix"]).drop("prefix").repartitionByRange("trie", "label", "node").sortWithinPartitions("trie", "label")


def open_places(rows: DataFrame, length: int, clusters: DataFrame | None) -> DataFrame:
    """(node, cluster, root, n) of the places of one prefix length that hold classes of several clusters; a class in no cluster is its own.

    Of places with the same classes the first one is taken.
    """
    at = rows.select("trie", F.substring("label", 1, VALUE * length).alias("prefix"), "node")
    met = at.groupBy("trie", "prefix").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 20)).alias("s")).where("n > 1")
    fresh = met.groupBy("n", "x", "s").agg(F.min(F.struct("trie", "prefix")).alias("first")).select("first.*", "n")
    held = at.join(fresh, ["trie", "prefix"]).select("node", F.xxhash64("trie", "prefix").alias("root"), "n")
    if clusters is None:
        return held.withColumn("cluster", F.col("node"))
    held = held.join(clusters.withColumnRenamed("root", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    several = held.groupBy("root").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("root")
    return held.join(several, "root")


def joined(clusters: DataFrame | None, more: DataFrame) -> DataFrame:
    """(node, root) after clusters were joined, of the clusters before and (node, root) of those that were joined."""
    if clusters is None:
        return materialize(more, "clusters")
    to = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = clusters.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = materialize(moved.unionByName(more.join(clusters.select("node"), "node", "left_anti")), "clusters")
    release(clusters)
    return out


def candidate_clusters(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, root) of classes (node, labels, sketch) that the forest joins, prefixes shortened from DEPTH on."""
    shortest = depth(threshold, TRIES, DEPTH, recall)
    rows = materialize(sorted_tries(classes, shortest), "tries")
    clusters = None
    for length in range(DEPTH, shortest - 1, -1):
        held = materialize(open_places(rows, length, clusters), "open")
        n = held.count()
        if n:
            places = held.select("root", "n").distinct()
            dealt = _dealt(held.drop("n"), places, ["root"], F.col("root")).select("node", "cluster", "root", "blocks", "block", "i", "j")
            dealt = _dispatch(dealt, n).join(classes.select("node", "sketch"), "node")
            edges = materialize(dealt.groupBy("unit").applyInArrow(_meet(threshold - SLACK), "a long, b long").distinct(), "edges")
            if edges.head(1):
                clusters = joined(clusters, components(edges))
            release(edges)
        release(held)
    release(rows)
    return clusters if clusters is not None else classes.where(F.lit(False)).select("node", F.col("node").alias("root"))


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """near_duplicates() with two columns more: text_hash, and group, which names a linked group whatever its ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = materialize(rows.mapInArrow(_sign(gram, TRIES, DEPTH), f"doc_id {id_type}, k1 long, k2 long, labels binary, sketch binary, text_hash long"), "signed")
    # One row for each word sequence. The first hash names it from here on.
    classes = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumnRenamed("k1", "node"), "classes")
    clusters = candidate_clusters(classes, threshold, recall)
    # Exact sets of the texts in clusters; ids find the texts, hashes confirm them.
    wanted = clusters.join(classes.select("node", "k2", "copy_of"), "node").select("node", "root", "copy_of")
    found = rows.join(wanted.select("node", "copy_of"), F.col("doc_id").eqNullSafe(F.col("copy_of"))).select("node", "text")
    # Several rows may have the id; only those with the class's words are its text.
    grams = materialize(found.mapInArrow(_confirmed(gram), "node long, grams binary").dropDuplicates(["node"]), "grams")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    dealt = _dealt(clusters.withColumnRenamed("root", "cluster"), sizes.withColumnRenamed("root", "cluster"), ["cluster"], F.col("cluster"))
    dealt = _dispatch(dealt.select("node", "root", "blocks", "block", "i", "j"), clusters.count()).join(grams, "node")
    verified = materialize(dealt.groupBy("unit").applyInArrow(_verify(threshold), "node long, links long, to long"), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(verified.select(F.col("node").alias("a"), F.col("to").alias("b")))
    # Names of groups: the least id of their classes.
    named = groups.join(classes.select("node", "copy_of"), "node")
    named = named.join(named.groupBy("root").agg(F.min("copy_of").alias("class_id")), "root").join(links, "node").select("node", "root", "class_id", "n_links")
    told = classes.select("node", "k2", "copy_of", "n_copies").join(named, "node", "left")
    told = told.select(F.col("node").alias("k1"), "k2", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "node").alias("group"))
    return signed.select("doc_id", "k1", "k2", "text_hash").join(told, ["k1", "k2"]).select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "text_hash", "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least id of the linked group), copy_of (least id with equal words), n_copies, n_links (other word sequences at the threshold or above), a row for each input row."""
    return _grouped(docs, id_col, text_col, gram, threshold, recall).select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each linked group the row with the least id stays, once."""
    first = _grouped(docs, id_col, text_col, **how).groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select(F.col("f.doc_id").alias("_keep_id"), F.col("f.text_hash").alias("_keep_hash")).distinct()
    rows = docs.withColumn("_text_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "_text_hash"])
    return rows.join(first, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_text_hash") == F.col("_keep_hash")), "left_semi").select(*docs.columns)
