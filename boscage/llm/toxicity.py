"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities: words of a stated lexicon, of words and word beginnings learned from labelled rows, the same after
undoing obfuscation, their nearness to second-person words, capitals, punctuation, obfuscated spellings. Labels, language,
source and id are never features.

The model is fitted on a bounded sample, at most max_rows labelled rows with the least hashes: half of them teach the lexicon, the
other half the trees, so that learned words are worth on new rows what the trees believe. Calibration is fitted on
predictions for rows that the trees at hand have not seen. Everything else runs over all documents, without a shuffle of texts.

Defined results: a null or empty text has zero densities and the score of those; without labels of both classes every score is the
share of label 1 (0 without labels); rows with equal ids are scored alone, and of
them the least text teaches, once a label; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import materialize, slices

#: Bound of the labelled sample, and of what it teaches.
MAX_ROWS, MAX_WORDS = 30_000, 4096
HELD_OUT_FOLD, FOLDS = 1, 3
PREFIX = 5
NEAR = 5

#: Insults of general English, a fixed list.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown clowns vermin filth filthy jerk imbecile "
    "fool fools ugly freak creep pig pigs rat rats bastard bastards bitch bitches asshole assholes crap shit bullshit fuck fucking fucked damn dickhead cunt slut whore "
    "retard retarded hate kill die".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch euer tu te toi ton tes vous votre vos usted ustedes ti tus vosotros".split())
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_CORE = re.compile(r"[^\W_]+(?:[^\w\s]+[^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")

SEED, WORD, BEGIN, PERSON, CAPS, OBFUSCATED, UNMASKED, LONG_RUN = (1 << i for i in range(8))
FEATURES = (
    "lexicon", "learned_words", "learned_beginnings", "unmasked", "any_hits", "log_hits", "densest_50", "near_person", "person",
    "capital_letters", "capital_words", "exclamations", "questions", "punctuation", "symbols", "obfuscated", "long_runs", "digits",
)


class Kinds(dict):
    """Bits of a blank-delimited token, worked out once for each distinct token."""

    def __init__(self, words: frozenset, begins: frozenset):
        super().__init__()
        self.words, self.begins = words, begins

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = _CORE.search(token)
        core = found[0] if found else ""
        low = core.lower()
        bits = 0
        if low in LEXICON:
            bits |= SEED
        if low in self.words:
            bits |= WORD
        if low[:PREFIX] in self.begins:
            bits |= BEGIN
        if low in SECOND_PERSON:
            bits |= PERSON
        if len(core) > 1 and core.isupper():
            bits |= CAPS
        if low and not low.isalpha() and any(c.isalpha() for c in low):
            bits |= OBFUSCATED
            plain = "".join(_LETTERS.findall(low.translate(_LEET)))
            if plain in LEXICON or plain in self.words:
                bits |= UNMASKED
        if len(low) > 3 and re.search(r"(.)\1\1", low):
            bits |= LONG_RUN
            plain = re.sub(r"(.)\1+", r"\1", low)
            if plain in LEXICON:
                bits |= UNMASKED
        self[token] = bits
        return bits


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for i in range(128):
        c = chr(i)
        out[i] = 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3 if c == "!" else 4 if c == "?" else 5 if c in ".,;:'\"()-" else 7 if c.isdigit() else 6 if i > 32 and i < 127 else 0
    return out


def features(texts: pa.Array, kinds: Kinds) -> np.ndarray:
    """Dense features (rows x FEATURES) of a slice of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    size = offsets[-1] - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    classes = _byte_classes()[data]

    def count(k):
        sums = np.concatenate(([0], np.cumsum(classes == k, dtype=np.int64)))
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    upper, lower, exclaim, question, punct, symbol, digit = (count(k) for k in range(1, 8))
    tokens = [t.split() for t in texts.to_pylist()]
    n_words = np.array([len(t) for t in tokens], np.int64)
    look = kinds.__getitem__
    bits = np.fromiter((look(w) for t in tokens for w in t), np.uint8, int(n_words.sum()))
    base = np.concatenate(([0], np.cumsum(n_words)))
    doc = np.repeat(np.arange(n), n_words)

    def words(mask):
        return np.bincount(doc[(bits & mask) > 0], minlength=n).astype(float)

    hit = (bits & (SEED | WORD | BEGIN | UNMASKED)) > 0
    hits = np.bincount(doc[hit], minlength=n).astype(float)
    place = np.flatnonzero(hit)
    densest, near = np.zeros(n), np.zeros(n)
    if len(place):
        own = doc[place]
        # Hits from each hit on, within 50 words of the same document.
        reach = np.searchsorted(place, np.minimum(place + 50, base[own + 1]))
        np.maximum.at(densest, own, (reach - np.arange(len(place))).astype(float))
        people = np.concatenate(([0], np.cumsum((bits & PERSON) > 0)))
        low, high = np.maximum(place - NEAR, base[own]), np.minimum(place + NEAR + 1, base[own + 1])
        near = np.bincount(own, weights=(people[high] > people[low]).astype(float), minlength=n)
    w, letters, length = np.maximum(n_words, 1), np.maximum(upper + lower, 1), np.maximum(np.diff(at), 1)
    return np.column_stack(
        [words(SEED) / w, words(WORD) / w, words(BEGIN) / w, words(UNMASKED) / w, hits / w, np.log1p(hits), densest / 50, near / np.maximum(hits, 1), words(PERSON) / w, upper / letters, words(CAPS) / w, exclaim / w, question / w, punct / length, symbol / length, words(OBFUSCATED) / w, words(LONG_RUN) / w, digit / length]
    )


class Trees:
    """Gradient boosting of the logistic loss with small histogram trees."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 0.4):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c[c > 0] if (c > 0).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        self.edges = [np.unique(np.concatenate(([0.0], e))) for e in self.edges]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        width = max(len(e) for e in self.edges) + 1
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        raw, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(self.depth):
                k = 1 << level
                best = np.zeros(k), np.zeros(k, np.int64), np.full(k, width, np.int64)  # gain, feature, last bin to the left
                for f in range(x.shape[1]):
                    key = node * width + binned[:, f]
                    g = np.bincount(key, grad, k * width).reshape(k, width).cumsum(1)
                    h = np.bincount(key, hess, k * width).reshape(k, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt**2 / (ht + self.l2)
                    gain[(h < self.least) | (ht - h < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(k), at]
                    better = top > best[0] + 1e-9
                    for old, new in zip(best, (top, np.full(k, f), at)):
                        old[better] = new[better]
                tree.append((best[1].copy(), best[2].copy()))
                node = 2 * node + (binned[np.arange(len(y)), best[1][node]] > best[2][node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.l2)
            raw = raw + value[node]
            self.trees.append((tree, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, last in tree:
                node = 2 * node + (binned[rows, feature[node]] > last[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the least-squares non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, least x, greatest x
    for v, t in zip(x[order], y[order]):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([float(t), 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    return np.array([p for b in blocks for p in b[2:4]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def learned_lexicon(rows: DataFrame, most: int = MAX_WORDS) -> tuple[frozenset, frozenset]:
    """Words, and beginnings of words, that mark label 1 in rows (text, label), a bounded sample."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    total, marked = (float(x or 0) for x in rows.agg(F.count("*"), F.sum("label")).head())
    found = []
    for of in (words, F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= PREFIX), lambda w: F.substring(w, 1, PREFIX)))):
        counts = rows.select(F.explode(of).alias("w"), "label").groupBy("w").agg(F.count("*").alias("n"), F.sum("label").alias("t")).where("t >= 5 and t >= 0.8 * n")
        odds = ((F.col("t") + 0.5) / (marked + 1)) / ((F.col("n") - F.col("t") + 0.5) / (total - marked + 1))
        found.append(frozenset(r[0] for r in counts.where(odds >= 10).orderBy(F.desc("t"), "w").limit(most).select("w").collect()))
    return found[0], found[1]


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, words: frozenset = frozenset(), begins: frozenset = frozenset(), share: float = 0.0):
        self.words, self.begins, self.share, self.trees = words, begins, share, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        self.share = float(y.mean()) if len(y) else 0.0
        if len(y) < 20 or y.min() == y.max():
            return self
        half = np.arange(len(y)) % 2 == 0
        if any(y[h].min() == y[h].max() for h in (half, ~half)):
            return self
        unseen = np.empty(len(y))
        for own in (half, ~half):
            unseen[~own] = Trees().fit(x[own], y[own]).raw(x[~own])
        self.points = isotonic(unseen, y)
        self.trees = Trees().fit(x, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of it ranks rows within a step of the calibration."""
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.points) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _featurize(words: frozenset, begins: frozenset):
    def run(batches):
        kinds = Kinds(words, begins)
        for b in slices(batches, 1, 1_000_000):
            x = features(b.column(1), kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fits on labelled rows outside the held-out fold, at most max_rows of them."""
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & (_fold("id") != HELD_OUT_FOLD) & F.col("id").isNotNull())
    sample = sample.withColumn("at", F.xxhash64("id")).orderBy("at", "id", "label").limit(max_rows)
    # Broadcast: at most max_rows rows of three numbers.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # One row a label, however many documents have its id: what the driver gathers stays within max_rows.
    rows = rows.groupBy("id", "label", "at").agg(F.min("text").alias("text")).select("label", "text", (F.col("at") % 2 == 0).alias("teaches_words"))
    rows = materialize(rows, "labelled")
    words, begins = learned_lexicon(rows.where("teaches_words"))
    got = rows.where("not teaches_words").select("label", "text").mapInArrow(_featurize(words, begins), "label int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist()).reshape(-1, len(FEATURES))
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of rows
    return Model(words, begins).fit(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), a row for each input row."""

    def run(batches):
        kinds = Kinds(model.words, model.begins)
        for b in slices(batches, 1, 1_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(features(b.column(1), kinds)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        kinds = Kinds(model.words, model.begins)
        for b in slices(batches, at, 1_000_000):
            yield b.filter(pa.array(model.score(features(b.column(at), kinds)) < threshold))

    return docs.mapInArrow(run, docs.schema)
