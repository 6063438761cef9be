"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns: assignments to names of secrets, access key ids, long runs of hex digits. Beyond them, every token that fits
an encoding (hex, base32, base36, base62, base64, letters) is tested for randomness in that encoding:

* chi-squared uniformity over the alphabet, runs above and below the middle of the alphabet, and lag-1 serial
  correlation, combined by Fisher's method: a token whose combined p-value is under UNIFORM_P is no random string;
* how likely the token is as natural text over how likely it is as a random one of its encoding, at most 1: by Markov's inequality a p-value of
  the null "this is natural". Natural text is a chain of symbol classes (CLASS_STEPS) with letters by the letter before, counted over the corpus.

Natural p-values are controlled by Benjamini-Hochberg at rate FDR within each band of lengths, over the whole corpus: short tokens,
which are many and say little, cannot borrow significance from long ones. Only counts by band and by bin of p leave the
executors, a bounded table.

Defined results: a null or empty text has no spans; spans count code points, end exclusive; a tested token that
overlaps a pattern's span adds nothing; repeated rows are separate documents; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boscage.llm.common import materialize, slices

BASE_KINDS = ("assign", "access", "hex")
FDR, UNIFORM_P = 0.01, 0.001
#: Chances of the next symbol's class (lower, upper, digit, other) in names and words, by the class before; the last row is the start (fixed values).
CLASS_STEPS = ((0.90, 0.04, 0.03, 0.03), (0.45, 0.45, 0.05, 0.05), (0.05, 0.05, 0.80, 0.10), (0.50, 0.20, 0.25, 0.05), (0.50, 0.30, 0.15, 0.05))
#: Upper ends of the bands of lengths, and bins of -log2 p.
BANDS, BINS = (24, 32, 40, 48, 64, 96, 128), 64

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Encodings from the narrowest: name, alphabet. A token has the first that holds all its symbols and whose classes it shows.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hexupper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def infer_encoding(token: str) -> tuple[str, str] | None:
    """Name and alphabet, or None where a token shows too few symbol classes to be an encoded value."""
    body = token.rstrip("=")
    digits, lower, upper = (any(a <= c <= z for c in body) for a, z in ("09", "az", "AZ"))
    if digits and not (lower or upper):
        return None  # a number
    symbols = set(body)
    for name, alphabet in ENCODINGS:
        if symbols <= set(alphabet):
            if name == "lower" or (digits and (name in ("hex", "hexupper", "base32", "base36") or (lower and upper))):
                return name, alphabet
    return None


def _normal_tail(z: float) -> float:
    """P(N > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


#: Bytes as letters 0 to 25 of either case, 26 for all else.
_FOLD = np.full(256, 26)
_FOLD[97:123] = _FOLD[65:91] = np.arange(26)


def letter_bits(counts: np.ndarray | None = None) -> np.ndarray:
    """Bits of a letter (column) after a letter or anything else (row 26), of counts of pairs, each one more than seen."""
    seen = np.ones((27, 26)) if counts is None else counts.reshape(27, 27)[:, :26] + 1.0
    return -np.log2(seen / seen.sum(1, keepdims=True))


def natural_bits(body: str, letters: np.ndarray) -> float:
    """Bits of a token as natural text."""
    bits, kind, last = 0.0, 4, 26
    for c in body:
        new = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3
        letter = int(_FOLD[ord(c)])
        bits -= math.log2(CLASS_STEPS[kind][new])
        bits += letters[last, letter] if new < 2 else math.log2(10) if new == 2 else 1.0
        kind, last = new, letter
    return float(bits)


def _pairs(batches):
    for b in slices(batches, 1):
        x = _FOLD[np.frombuffer("\n".join(t or "" for t in b.column(1).to_pylist()).encode("utf-8", "replace"), np.uint8)]
        counts = np.bincount(x[:-1] * 27 + x[1:], minlength=729)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(729)), pa.array(counts.astype(np.int64))], names=["pair", "n"])


def battery(token: str, alphabet: str, letters: np.ndarray | None = None) -> dict:
    """chi2 and the p-values of the tests; natural: p-value against natural text."""
    body = token.rstrip("=")
    n, k = len(body), len(alphabet)
    x = np.array([alphabet.index(c) for c in body])
    counts = np.bincount(x, minlength=k)
    chi2 = k / n * float((counts.astype(np.int64) ** 2).sum()) - n
    df = k - 1
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    p_chi = _normal_tail(((max(chi2, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    above = x >= k / 2
    n1 = int(above.sum())
    n2 = n - n1
    runs = 1 + int((above[1:] != above[:-1]).sum())
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centred = x - x.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _normal_tail(abs(r + 1 / (n - 1)) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    uniform = math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0
    over = natural_bits(body, letter_bits() if letters is None else letters) - n * math.log2(k)
    natural = 2.0 ** -min(max(over, 0.0), 1000.0)
    return {"chi2": chi2, "p_chi": p_chi, "p_runs": p_runs, "p_serial": p_serial, "uniform": uniform, "natural": natural}


def band(length: int) -> int:
    return sum(length > b for b in BANDS)


def candidates(text: str, spans: list[tuple[str, int, int]], letters: np.ndarray | None = None) -> list[dict]:
    """Tokens with an encoding, outside the spans: place, encoding, band, bin of the natural p-value, uniform p-value."""
    out = []
    for m in _TOKEN.finditer(text):
        found = infer_encoding(m[0])
        if not found or any(a < m.end() and m.start() < b for _, a, b in spans):
            continue
        p = battery(m[0], found[1], letters)
        bits = min(BINS - 1, int(-math.log2(max(p["natural"], 1e-300))))
        out.append({"start": m.start(), "end": m.end(), "encoding": found[0], "band": band(m.end() - m.start()), "bin": bits, "uniform": p["uniform"]})
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("band", pa.int32()), ("bin", pa.int32()), ("uniform", pa.float64())]))


def _scan(letters):
    def run(batches):
        for b in slices(batches, 1):
            spans, tested = [], []
            for text in b.column(1).to_pylist():
                own = base_spans(text or "")
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in own])
                tested.append(candidates(text or "", own, letters))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPAN), pa.array(tested, _CANDIDATE)], names=["doc_id", "base", "tested"])

    return run


def thresholds(counts: dict[tuple[int, int], int], rate: float = FDR) -> list[int]:
    """Benjamini-Hochberg over binned p-values: by band the first bin accepted (BINS if none). counts: by (band, bin)."""
    out = []
    for g in range(len(BANDS) + 1):
        total, seen, first = sum(n for (x, _), n in counts.items() if x == g), 0, BINS
        for i in range(BINS - 1, -1, -1):
            seen += counts.get((g, i), 0)
            # The upper edge of bin i is 2**-i: every p-value in it is at most that.
            if seen and 2.0**-i <= rate * seen / total:
                first = i
        out.append(first)
    return out


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR, uniform_p: float = UNIFORM_P) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; spans holds base and the random tokens, by start), a row for each input row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = np.zeros(729)
    for r in texts.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 729 rows at most
        counts[r["pair"]] = r["n"]
    rows = texts.mapInArrow(
        _scan(letter_bits(counts)), f"doc_id {id_type}, base array<struct<kind:string,start:long,end:long>>, tested array<struct<start:long,end:long,encoding:string,band:int,bin:int,uniform:double>>"
    )
    rows = materialize(rows, "secrets")  # no texts: spans and test results only
    every = rows.select(F.explode("tested").alias("t")).groupBy("t.band", "t.bin").count()  # bands x bins rows at most
    first = thresholds({(r["band"], r["bin"]): r["count"] for r in every.collect()}, rate)
    limit = F.array(*[F.lit(x) for x in first])
    found = F.filter("tested", lambda t: (t["uniform"] >= uniform_p) & (t["bin"] >= F.get(limit, t["band"])))
    extra = F.transform(found, lambda t: F.struct(F.concat(F.lit("random_"), t["encoding"]).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    order = F.array(*[F.lit(k) for k in BASE_KINDS])
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("o"), s["kind"].alias("kind"), s["end"].alias("end"))
    both = F.array_sort(F.transform(F.concat("base", extra), place))
    return rows.select("doc_id", "base", F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
