"""Exact substring deduplication by Rabin-Karp hashes of every window of consecutive words.

1. Each task hashes every window of its documents and sends the distinct hashes, sorted and packed, to hash
   buckets: one row a (bucket, chunk of documents) instead of one row a window. A flag bit says whether the hash
   occurs twice in the packed piece already.
2. A bucket counts its hashes over all chunks and answers each chunk with one bit a distinct hash: repeated or not.
3. A chunk of documents is hashed again, reads the bits, and merges repeated windows into maximal intervals.

A hash that occurs in a third of all windows is one entry of each piece, so no bucket grows with the copies of one
passage. The number of buckets and chunks follows the size of the input, so that neither outgrows a task.

Defined results: a null or blank text has no words; a text shorter than a window has nothing removed; rows with
equal ids are separate documents; windows never cross documents. Equality is by 61-bit hashes of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import bounded, slices

WINDOW = 35
#: Bytes of text a bucket's windows, or a chunk's documents, should come from.
BUCKET_BYTES, CHUNK_BYTES = 12_000_000, 4_000_000
#: Neighbouring ids that go to the same chunk.
RUN = 256

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts as arrays: byte spans in one buffer, document, 64-bit hash."""

    def __init__(self, texts: pa.Array):
        wide = pa.large_string()
        texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(wide), pa.scalar("", wide)), pa.scalar("", wide), pa.scalar("\n", wide))
        self.n_docs = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets, self.data = offsets - offsets[0], data
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]  # every text ends in a line feed, so every word ends
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.hash = self._hash()

    def _hash(self, block: int = 1 << 19) -> np.ndarray:
        """Polynomial hashes of the words' bytes, from prefix sums over blocks of whole words to bound memory."""
        out = np.zeros(len(self.start), np.uint64)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(self.start, np.arange(block, len(self.data), block)), [len(out)])))
        widest = max((int(self.end[j - 1] - self.start[i]) for i, j in zip(cuts[:-1], cuts[1:])), default=0)
        up, down = _powers(_BYTE_BASE, widest + 1), _powers(_inverse(_BYTE_BASE), widest + 1)
        for i, j in zip(cuts[:-1], cuts[1:]):
            lo, hi = self.start[i], self.end[j - 1]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            out[i:j] = mix((sums[self.end[i:j] - lo] - sums[self.start[i:j] - lo]) * down[self.start[i:j] - lo])
        return out

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of so many words within one document: a rolling polynomial of word hashes."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: n - length + 1] == self.doc[length - 1 :])
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(_WORD_BASE, n))))
        return first, mix((sums[first + length] - sums[first]) * _powers(_inverse(_WORD_BASE), n)[first])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _pieces(n_buckets: int, window: int):
    """Arrow batches of (chunk, text) to rows (bucket, chunk, packed hashes with the flag in the lowest bit)."""
    keep = np.uint64((1 << 64) - 8)

    def emit(chunks: np.ndarray, texts: pa.Array):
        words = Words(texts)
        first, hashes = words.windows(window)
        if not len(first):
            return
        chunk, bucket, hashes = chunks[words.doc[first]], _bucket(hashes, n_buckets), hashes & keep
        ids, slot = np.unique(chunk, return_inverse=True)
        key = slot * n_buckets + bucket
        order = np.lexsort((hashes, key))
        key, hashes = key[order], hashes[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])))
        at = np.flatnonzero(new)
        packed = hashes[at] | (np.diff(np.append(at, len(hashes))) > 1).astype(np.uint64)
        key = key[at]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        raw, bounds = packed.tobytes(), np.append(cut, len(key)) * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[cut] % n_buckets, pa.int64()), pa.array(ids[key[cut] // n_buckets], pa.int64()), pa.array([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
            names=["bucket", "chunk", "hashes"],
        )

    def run(batches):
        for b in slices(batches, 1, 1_500_000):
            yield from emit(b.column(0).to_numpy(), b.column(1))

    return run


def _merged(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of packed pieces, sorted, and whether each occurs more than once."""
    hashes = np.sort(hashes)
    plain = hashes & np.uint64((1 << 64) - 8)
    at = np.flatnonzero(np.concatenate(([True], plain[1:] != plain[:-1])))
    several = np.diff(np.append(at, len(plain))) > 1
    return plain[at], several | (np.maximum.reduceat(hashes & np.uint64(1), at) > 0)


def _count(table: pa.Table) -> pa.Table:
    """All pieces of one bucket: for each chunk, a bit for each of its distinct hashes in order."""
    bucket, blobs = table["bucket"][0].as_py(), table["hashes"].to_pylist()
    chunks = table["chunk"].to_numpy()
    every, repeated = _merged(np.frombuffer(b"".join(blobs), np.uint64))
    every = every[repeated]
    out = []
    for c in np.unique(chunks):
        own, _ = _merged(np.frombuffer(b"".join(blobs[i] for i in np.flatnonzero(chunks == c)), np.uint64))
        at = np.searchsorted(every, own)
        hit = at < len(every)
        hit[hit] = every[at[hit]] == own[hit]
        if hit.any():
            out.append((int(c), bucket, np.packbits(hit).tobytes()))
    return pa.Table.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names=["chunk", "bucket", "bits"])


def _resolve(n_buckets: int, window: int):
    """The documents of one chunk and its bits: words, maximal removal intervals and the kept text of each document."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        texts = docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string())
        words = Words(texts)
        first, hashes = words.windows(window)
        hit = np.zeros(len(first), bool)
        if bits.num_rows and len(first):
            bucket, hashes = _bucket(hashes, n_buckets), hashes & np.uint64((1 << 64) - 8)
            order = np.lexsort((hashes, bucket))
            sb, sh = bucket[order], hashes[order]
            edge = np.searchsorted(sb, np.arange(n_buckets + 1)) if n_buckets <= len(sb) else None
            for b, mask in zip(bits["bucket"].to_pylist(), bits["bits"].to_pylist()):
                lo, hi = (edge[b], edge[b + 1]) if edge is not None else (np.searchsorted(sb, b), np.searchsorted(sb, b + 1))
                if lo == hi:
                    continue
                own, rank = np.unique(sh[lo:hi], return_inverse=True)
                hit[order[lo:hi]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).astype(bool)[rank]
        return _texts(docs, words, first[hit], window)

    return run


def _texts(docs: pa.Table, words: Words, first: np.ndarray, window: int) -> pa.Table:
    n = len(words.hash)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + window, -1)
    gone = np.cumsum(step[:n]) > 0
    base = np.concatenate(([0], np.cumsum(words.count)))
    n_gone = np.concatenate(([0], np.cumsum(gone)))
    kept = [""] * words.n_docs
    intervals: list[list] = [[] for _ in range(words.n_docs)]
    # Kept text: the bytes of kept words and one blank after each.
    live = ~gone
    size = np.where(live, words.end - words.start + 1, 0)
    to = np.concatenate(([0], np.cumsum(size)))
    total = int(to[-1])
    if total:
        at = np.arange(total) - np.repeat(to[:-1][live], size[live]) + np.repeat(words.start[live], size[live])
        out = words.data[at]
        out[to[1:][live] - 1] = 32
        raw = out.tobytes()
        for d in range(words.n_docs):
            a, b = to[base[d]], to[base[d + 1]]
            kept[d] = raw[a : b - 1].decode() if b > a else ""
    # Maximal intervals of removed words, end exclusive.
    if gone.any():
        doc_edge = np.concatenate(([True], words.doc[1:] != words.doc[:-1]))
        begin = np.flatnonzero(gone & (doc_edge | ~np.concatenate(([False], gone[:-1]))))
        stop = np.flatnonzero(gone & (np.append(doc_edge[1:], True) | ~np.append(gone[1:], False))) + 1
        for a, b in zip(begin, stop):
            d = words.doc[a]
            intervals[d].append({"start": int(a - base[d]), "end": int(b - base[d])})
    return pa.Table.from_arrays(
        [docs["doc_id"].combine_chunks() if docs.num_rows else pa.array([], docs.schema.field("doc_id").type), pa.array(words.count, pa.int64()), pa.array(n_gone[base[1:]] - n_gone[base[:-1]], pa.int64()), pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of word positions, end exclusive) and kept_text, a row for each input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    n_buckets, n_chunks = bounded(total // BUCKET_BYTES, 1, 1 << 22), bounded(total // CHUNK_BYTES, 1, 1 << 22)
    n_buckets, n_chunks = max(12, n_buckets), max(12, n_chunks)
    by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.floor(F.col("doc_id") / RUN)))
    rows = rows.withColumn("chunk", F.pmod(by, F.lit(n_chunks)).cast("long"))
    pieces = rows.select("chunk", "text").mapInArrow(_pieces(n_buckets, window), "bucket long, chunk long, hashes binary")
    bits = pieces.groupBy("bucket").applyInArrow(_count, "chunk long, bucket long, bits binary")
    return rows.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(
        _resolve(n_buckets, window), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    )
