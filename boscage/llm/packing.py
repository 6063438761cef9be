"""Bounded-space online packing of tokenized documents into fixed windows.

Each task reads its documents once, in order, and keeps a fixed number of open windows. A document goes to the
window where it fits best, the fullest with room for it; if none has room, the fullest window is emitted and a new one
opened. A document longer than a window fills whole windows first and only its rest is placed. What is still open
at the end of a task is left over, at most that fixed number of windows, and the leftovers of all tasks are merged by the same
rule, a group of tasks at a time. No text is shuffled; memory is the open windows.

Defined results: a null or empty text is the end token alone; rows with equal ids are separate documents; no documents give no rows;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import materialize, slices

WINDOW, OPEN_WINDOWS, END_ID = 4096, 64, 2
#: Tasks whose leftovers one task merges.
MERGE_TASKS = 256
#: Distinct pre-tokens kept by a Python worker; beyond it the cache starts anew.
CACHE_WORDS = 500_000

#: Texts of these characters alone are split here; all others go to the tokenizer whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
#: The vocabulary's own split (fixed by its file), for such texts.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s\xa0\x85a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class Codes(dict):
    """Codes of pre-tokens in order of their first use; new ones are noted until their ids are learned."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordTokenizer:
    """Token ids of whole texts, with the ids of repeated pre-tokens looked up: pre-tokens are independent in this vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        #: Ids that end a pre-token.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.code, self.n_known = Codes(), 0
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.n_flat = 0

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """This worker's tokenizer: what one task has learned serves the next."""
        home = sys.modules.setdefault("_boscage_tokenizers", types.ModuleType("_boscage_tokenizers")).__dict__
        if path not in home:
            home[path] = cls(path)
        return home[path]

    def _learn(self, words: list[str]):
        """Ids of new pre-tokens, in order of their codes, encoded together: separated by blanks they stay what they are."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            parts = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            ids, stop = np.array([i for p in parts for i in p], np.uint32), np.cumsum([len(p) for p in parts])
        k = self.n_known
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while k + len(words) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.at[k + 1 : k + 1 + len(words)] = self.n_flat + stop
        self.n_flat += len(ids)
        self.n_known += len(words)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, split = [], []
        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text):
                plain.append(i)
                split.append(_SPLIT.findall(text.lower()))
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.code) > CACHE_WORDS:
            self._clear()
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        new, self.code.new = self.code.new, []
        for at in range(0, len(new), 4096):
            self._learn(new[at : at + 4096])
        start, size = self.at[codes], self.at[codes + 1] - self.at[codes]
        end = np.cumsum(size)
        ids = self.flat[np.arange(end[-1]) + np.repeat(start - end + size, size)] if len(codes) else np.zeros(0, np.uint32)
        words = np.cumsum([0] + [len(w) for w in split])
        bounds = np.concatenate(([0], end))[words]
        for i, a, b in zip(plain, bounds[:-1], bounds[1:]):
            out[i] = ids[a:b]
        return out


class OpenWindows:
    """A fixed number of open windows, sorted by how full they are."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.open, self.n = window, most, [], 0  # open: sorted (used, number)

    def place(self, length: int) -> tuple[int, int, int | None]:
        """Number and offset of the window for a piece, and the number of the window emitted for it."""
        closed = None
        if length >= self.window:  # needs no room beside others
            self.n += 1
            return self.n - 1, 0, self.n - 1
        at = bisect.bisect_right(self.open, (self.window - length, 1 << 62)) - 1
        if at >= 0:
            used, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                closed = self.open.pop()[1]
            used, number = 0, self.n
            self.n += 1
        if used + length < self.window:
            bisect.insort(self.open, (used + length, number))
        else:
            closed = number if closed is None else closed
        return number, used, closed


_SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, task long, window_no long, offset long, left_over boolean"


def _pack(path: str, window: int, most: int, end_id: int, id_type: str):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tok, bins = WordTokenizer.shared(path), OpenWindows(window, most)
        rows: list[tuple] = []
        kind = None

        def table(rows):
            still = {n for _, n in bins.open}
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()), pa.array([task] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in cols[5:7])]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([n in still for n in cols[5]])], names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "window_no", "offset", "left_over"])

        # Pieces wait until their window is emitted: then it is known whether it is left over.
        waiting: dict[int, list] = {}
        size = 0
        for b in slices(batches, 1, 1_000_000):
            kind = b.schema.field(0).type
            for key, ids in zip(b.column(0).to_pylist(), tok.encode_all([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id))
                n = len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window]
                    number, offset, closed = bins.place(len(part))
                    waiting.setdefault(number, []).append((key, at, len(part), part.astype("<u4").tobytes(), n, number, offset))
                    for done in {closed, number if offset + len(part) == window else None} - {None}:
                        rows += waiting.pop(done)
                    size += 4 * len(part)
                if size >= 4_000_000 and rows:
                    yield table(rows)
                    rows, size = [], 0
        rows += [r for group in waiting.values() for r in group]
        if rows:
            yield table(rows)

    return run


def _merge(window: int, most: int, group_col: str = "group"):
    """Leftover windows of a group of tasks, placed as pieces: (task, window_no) to the merged window and the offset there."""

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["window_no"].to_numpy(), t["task"].to_numpy(), -t["used"].to_numpy()))
        bins, out = OpenWindows(window, len(order) + 1), []
        used = t["used"].to_numpy()
        for i in order:
            number, offset, _ = bins.place(int(used[i]))
            out.append((number, offset))
        number, offset = (np.array(x, np.int64) for x in zip(*out))
        return pa.table({"task": t["task"].to_numpy()[order], "window_no": t["window_no"].to_numpy()[order], "merged_no": number, "shift": offset, "group": t["group"].to_numpy()[order]})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row for each piece.

    Sequences up to 2**40 of task t have ids t * 2**40 + number; merged leftovers have negative ids.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Written once: the merge below and the result must see the same placement, also after a lost executor.
    pieces = materialize(rows.mapInArrow(_pack(tokenizer_path, window, open_windows, end_id, id_type), _SCHEMA.format(id=id_type)), "pieces")
    done, left = pieces.where(~F.col("left_over")), pieces.where("left_over")
    sums = left.groupBy("task", "window_no").agg(F.sum("length").alias("used")).withColumn("group", F.floor(F.col("task") / MERGE_TASKS).cast("long"))
    merged = sums.groupBy("group").applyInArrow(_merge(window, open_windows), "task long, window_no long, merged_no long, shift long, group long")
    left = left.join(merged, ["task", "window_no"])
    cols = ["doc_id", "start", "length", "ids", "doc_tokens"]
    done = done.select(*cols, (F.shiftleft("task", 40) + F.col("window_no")).alias("sequence_id"), "offset")
    left = left.select(*cols, (-1 - (F.shiftleft("group", 40) + F.col("merged_no"))).alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return done.unionByName(left)
