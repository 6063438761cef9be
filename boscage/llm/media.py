"""Media columns: baseline JPEG, written from bytes and read back, with DC-only luminance thumbnails.

encode() stores a payload losslessly in a baseline JPEG of one component: each 64 bytes are the 64 quantized
coefficients of a block, in zigzag order and shifted by LEVEL, with a quantization table of ones. Coefficients are the
format's own unit, and unlike samples they survive exactly. The scan has restart markers, so that it can be decoded from many
places at once.

decode() is a reader for such files and any other baseline JPEG of one component: it parses the markers, undoes byte stuffing,
and Huffman-decodes all restart intervals of a batch of files together in numpy, one symbol of each interval a step.

features() gives dimensions and hashes of the thumbnail of DC values (1/8 of each side).

Defined results: a null text is an empty one; an empty payload is one block; equal texts have equal files and features; what
is not such a JPEG gives null for all that would be read from it.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boscage.llm.common import slices

BLOCK = 64
#: Coefficient = byte - LEVEL; near the middle of letters, which makes most coefficients small.
LEVEL = 104
#: Blocks in a restart interval.
INTERVAL = 4
#: Bytes of payload encoded or decoded together.
BATCH_BYTES = 700_000


def payload(text: bytes) -> bytes:
    """UTF-8 bytes, with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))


# Huffman tables ------------------------------------------------------------------------------------------------------


def _code_lengths(weights: dict[int, int], longest: int = 16) -> dict[int, int]:
    """Lengths of a prefix code by symbol, none over longest, none all ones: the package-merge construction."""
    symbols = sorted(weights, key=lambda s: (weights[s], s))
    leaves = [(1, (-1,))] + [(weights[s], (s,)) for s in symbols]  # -1 takes the code of all ones
    merged: list = []
    for _ in range(longest):
        both = sorted(leaves + merged, key=lambda x: x[0])
        merged = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(both[::2], both[1::2])]
    lengths: dict[int, int] = {}
    for _, group in merged[: len(leaves) - 1]:
        for s in group:
            lengths[s] = lengths.get(s, 0) + 1
    # The reserved symbol must be the last of the longest codes; give it that length.
    top, own = max(lengths.values()), lengths.pop(-1)
    if own < top:
        s = max((s for s in lengths if lengths[s] == top), key=lambda s: s)
        lengths[s] = own
    return lengths


class Table:
    """A Huffman table: codes for writing, and for reading a lookup of the next 16 bits."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.look_symbol, self.look_size = np.zeros(1 << 16, np.int64), np.full(1 << 16, -1, np.int64)
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                s = symbols[k]
                k += 1
                self.code[s], self.size[s] = code, length
                lo = code << (16 - length)
                self.look_symbol[lo : lo + (1 << (16 - length))] = s
                self.look_size[lo : lo + (1 << (16 - length))] = length
                code += 1
            code <<= 1

    @classmethod
    def of(cls, weights: dict[int, int]) -> Table:
        lengths = _code_lengths(weights)
        symbols = sorted(lengths, key=lambda s: (lengths[s], s))
        return cls([sum(v == n for v in lengths.values()) for n in range(1, 17)], symbols)

    def segment(self, kind: int) -> bytes:
        body = bytes([kind, *self.counts, *self.symbols])
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


def _weights() -> tuple[dict[int, int], dict[int, int]]:
    """Frequencies the tables are built from, by rule: small sizes and short runs are likelier."""
    dc = {s: 1 << max(0, 12 - s) for s in range(12)}
    ac = {(run << 4) | size: 1 + (200_000 >> (5 * run)) // (1 + abs(size - 4) ** 2) for run in range(16) for size in range(1, 11)}
    return dc, ac | {0x00: 2000, 0xF0: 1}


_TABLES: list = []


def tables() -> tuple[Table, Table]:
    if not _TABLES:
        dc, ac = _weights()
        _TABLES.extend((Table.of(dc), Table.of(ac)))
    return _TABLES[0], _TABLES[1]


# Writing -------------------------------------------------------------------------------------------------------------


def _bits_of(values: np.ndarray) -> np.ndarray:
    """Size category of each value."""
    return np.where(values == 0, 0, np.frexp(np.abs(values).astype(np.float64))[1]).astype(np.int64)


def _entropy(coef: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with their extra bits for blocks of coefficients: (block of each, bits, number of bits) in order of the stream.

    first: blocks with which a restart interval begins.
    """
    dc_table, ac_table = tables()
    n = len(coef)
    previous = np.concatenate(([0], coef[:-1, 0]))
    diff = coef[:, 0] - np.where(first, 0, previous)
    size = _bits_of(diff)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    parts = [(np.arange(n), np.zeros(n, np.int64), (dc_table.code[size] << size.astype(np.uint64)) | extra, dc_table.size[size] + size)]
    b, k = np.nonzero(coef[:, 1:])
    v = coef[b, k + 1]
    before = np.where(np.concatenate(([True], b[1:] != b[:-1])), -1, np.concatenate(([0], k[:-1]))) if len(b) else k
    run = k - before - 1
    for i in range(1, 4):  # runs of 16 zeros and more
        at = run >= 16 * i
        if at.any():
            parts.append((b[at], 4 * (k[at] + 1) - 4 + i, np.full(at.sum(), ac_table.code[0xF0]), np.full(at.sum(), ac_table.size[0xF0])))
    size = _bits_of(v)
    extra = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
    symbol = ((run % 16) << 4) | size
    parts.append((b, 4 * (k + 1), (ac_table.code[symbol] << size.astype(np.uint64)) | extra, ac_table.size[symbol] + size))
    ends = np.flatnonzero(coef[:, 63] == 0)
    parts.append((ends, np.full(len(ends), 1000), np.full(len(ends), ac_table.code[0]), np.full(len(ends), ac_table.size[0])))
    block, place, bits, length = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(block * 1024 + place, kind="stable")
    return block[order], bits[order], length[order]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (bytes, a positive multiple of 64)."""
    if not payloads:
        return []
    n_blocks = np.array([len(p) // BLOCK for p in payloads])
    wide = np.ceil(np.sqrt(n_blocks)).astype(np.int64)
    high = -(-n_blocks // wide)
    filled = wide * high  # blocks of zeros fill the last row
    base = np.concatenate(([0], np.cumsum(filled)))
    coef = np.zeros((int(base[-1]), BLOCK), np.int64)
    for i, p in enumerate(payloads):
        coef[base[i] : base[i] + n_blocks[i]] = (np.frombuffer(p, np.uint8).astype(np.int64) - LEVEL).reshape(-1, BLOCK)
    inside = np.arange(len(coef)) - np.repeat(base[:-1], filled)
    first = inside % INTERVAL == 0
    block, bits, length = _entropy(coef, first)
    interval = np.cumsum(first) - 1
    owner = interval[block]
    # Each interval is padded with ones to a byte; then a marker follows unless it is the file's last.
    total = np.bincount(owner, weights=length, minlength=interval[-1] + 1).astype(np.int64)
    n_bytes = (total + 7) // 8
    byte_at = np.concatenate(([0], np.cumsum(n_bytes)))
    ends = np.cumsum(length)
    shift = byte_at[:-1] * 8 - np.concatenate(([0], np.cumsum(total)[:-1]))
    start = ends - length + shift[owner]
    out = np.zeros(int(byte_at[-1]) + 8, np.uint64)
    word = bits << (np.uint64(40) - (start % 8).astype(np.uint64) - length.astype(np.uint64))  # codes and extra bits: 27 at most
    for j in range(5):
        np.add.at(out, start // 8 + j, (word >> np.uint64(32 - 8 * j)) & np.uint64(255))
    fill = -total % 8
    out[byte_at[1:] - 1] += ((1 << fill) - 1).astype(np.uint64)
    data = out[: int(byte_at[-1])].astype(np.uint8)
    # Stuffed zeros and restart markers are inserted after their bytes.
    file_of = np.repeat(np.arange(len(payloads)), filled)[first]
    number = inside[first] // INTERVAL
    last = np.append(file_of[1:] != file_of[:-1], True)
    stuffed = np.flatnonzero(data == 255) + 1
    marks = byte_at[1:][~last]
    at = np.concatenate((stuffed, marks, marks))
    what = np.concatenate((np.zeros(len(stuffed), np.uint8), np.full(len(marks), 255, np.uint8), (0xD0 + number[~last] % 8).astype(np.uint8)))
    rank = np.concatenate((np.zeros(len(stuffed)), np.ones(len(marks)), np.full(len(marks), 2)))
    order = np.lexsort((rank, at))
    stream = np.insert(data, at[order], what[order]).tobytes()
    added = np.searchsorted(at[order], byte_at[1:][last], "right")
    stops = byte_at[1:][last] + added
    files, begin = [], 0
    head = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xdb\x00\x43\x00" + b"\x01" * 64
    tail = b"".join(t.segment(k) for t, k in zip(tables(), (0x00, 0x10))) + b"\xff\xdd\x00\x04" + INTERVAL.to_bytes(2, "big") + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    for i, stop in enumerate(stops):
        note = f"payload {len(payloads[i])}".encode()
        frame = b"\xff\xc0\x00\x0b\x08" + int(8 * high[i]).to_bytes(2, "big") + int(8 * wide[i]).to_bytes(2, "big") + b"\x01\x01\x11\x00"
        files.append(head + b"\xff\xfe" + (len(note) + 2).to_bytes(2, "big") + note + frame + tail + stream[begin:stop] + b"\xff\xd9")
        begin = stop
    return files


# Reading -------------------------------------------------------------------------------------------------------------


def parse(data: bytes) -> dict | None:
    """What the markers say: width, height, quantization, tables, restart interval, comment, span of the scan. None if not such a JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    out = {"interval": 0, "tables": {}, "comment": b""}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC0:
            if len(body) < 9 or body[0] != 8 or body[5] != 1:
                return None
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big")}
        elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            return None  # not baseline
        elif kind == 0xDB:
            out["quant"] = body[1] if body and body[0] >> 4 == 0 else int.from_bytes(body[1:3], "big")  # of the DC value
        elif kind == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                out["tables"][body[0]] = (body[:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            out["interval"] = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            out["comment"] = body
        elif kind == 0xDA:
            end = data.rfind(b"\xff\xd9")
            if end < at or "width" not in out or len(body) < 3:
                return None
            return out | {"scan": (at, end), "use": (body[2] >> 4, 0x10 | (body[2] & 15))}
    return None


def _decode_intervals(data: np.ndarray, start: np.ndarray, n_blocks: np.ndarray, dc: Table, ac: Table) -> np.ndarray:
    """Coefficients of all blocks of all restart intervals: every step reads one symbol of each interval that is not at its end."""
    base = np.concatenate(([0], np.cumsum(n_blocks)))
    coef = np.zeros(int(base[-1]) * BLOCK, np.int32)
    data = np.concatenate((data, np.full(8, 255, np.uint8))).astype(np.uint32)
    pairs = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    limit = len(pairs) - 1
    look = ((dc.look_symbol << 8) | (dc.look_size & 255)).astype(np.int32), ((ac.look_symbol << 8) | (ac.look_size & 255)).astype(np.int32)
    both = np.concatenate(look)
    bit = start.astype(np.int64) * 8
    k = base[:-1] * BLOCK  # place of the next coefficient
    stop = base[1:] * BLOCK
    last = np.zeros(len(start), np.int32)
    while len(k):
        byte = np.minimum(bit >> 3, limit)
        ahead = ((pairs[byte].astype(np.uint64) << np.uint64(8)) | data[np.minimum(byte + 4, len(data) - 1)]) << (bit & 7).astype(np.uint64)
        window = ((ahead >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)
        inside = k & 63
        is_ac = inside != 0
        found = both[window + (is_ac << 16)]
        used = found & 255
        symbol = found >> 8
        size, run = symbol & 15, symbol >> 4
        extra = ((ahead >> (40 - used - size).clip(0).astype(np.uint64)).astype(np.int64) & ((1 << size) - 1)).astype(np.int32)
        value = np.where((size > 0) & (extra < (1 << (size - 1).clip(0))), extra - (1 << size) + 1, extra)
        bad = used == 255
        end = is_ac & (symbol == 0)
        to = k + np.where(is_ac, run, 0)
        put = ((~is_ac) | (size > 0)) & ~bad & (to < stop)
        last = np.where(is_ac, last, last + value)
        coef[to[put]] = np.where(is_ac, value, last)[put]
        k = np.where(end, (k | 63) + 1, to + 1)
        bit = bit + used + size
        live = (k < stop) & ~bad
        if not live.all():
            bit, k, stop, last = bit[live], k[live], stop[live], last[live]
    return coef.reshape(-1, BLOCK)


def decode(files: list[bytes | None]) -> list[dict | None]:
    """width, height, coef (blocks x 64, zigzag order), quant and comment of each file."""
    heads = [None if f is None else parse(f) for f in files]
    out: list[dict | None] = [None] * len(files)
    groups: dict = {}
    for i, h in enumerate(heads):
        if h and all(u in h["tables"] for u in h["use"]):
            groups.setdefault(tuple(h["tables"][u] for u in h["use"]), []).append(i)
    for (dc, ac), members in groups.items():
        joined = np.frombuffer(b"".join(files[i][slice(*heads[i]["scan"])] + b"\xff\xd9" for i in members), np.uint8)
        file_end = np.cumsum([heads[i]["scan"][1] - heads[i]["scan"][0] + 2 for i in members])
        mark = np.flatnonzero(joined[:-1] == 255)
        nxt = joined[mark + 1]
        stuffed, ends = mark[nxt == 0], mark[(nxt >= 0xD0) & (nxt <= 0xD9)]
        drop = np.zeros(len(joined), bool)
        drop[stuffed + 1] = True
        drop[ends] = drop[ends + 1] = True
        begin = np.concatenate(([0], ends[:-1] + 2))
        to = np.cumsum(~drop) - ~drop  # place after removal
        which = np.searchsorted(file_end, begin, "right")
        wide = np.array([-(-heads[i]["width"] // 8) for i in members])
        high = np.array([-(-heads[i]["height"] // 8) for i in members])
        n, step = wide * high, np.array([heads[i]["interval"] or 1 << 40 for i in members])
        order = np.arange(len(begin)) - np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(members)))))[which]
        blocks = np.clip(n[which] - order * step[which], 0, step[which])
        table = [Table(list(x[0][1:17]), list(x[1])) for x in (dc, ac)]
        at = np.minimum(to[np.minimum(begin, len(to) - 1)], len(to))
        coef = _decode_intervals(joined[~drop], at, blocks, *table)
        edge = np.concatenate(([0], np.cumsum(np.bincount(which, weights=blocks, minlength=len(members)).astype(np.int64))))
        for j, i in enumerate(members):
            if edge[j + 1] - edge[j] == n[j]:
                out[i] = {"width": heads[i]["width"], "height": heads[i]["height"], "coef": coef[edge[j] : edge[j + 1]], "quant": heads[i].get("quant", 1), "comment": heads[i]["comment"]}
    return out


def stored_payload(image: dict) -> bytes | None:
    """The payload that encode() stored."""
    if not image["comment"].startswith(b"payload "):
        return None
    return (image["coef"].reshape(-1)[: int(image["comment"][8:])] + LEVEL).astype(np.uint8).tobytes()


def thumbnail(image: dict) -> np.ndarray:
    """Luminance from DC values alone: one sample for each block."""
    dc = image["coef"][:, 0].astype(np.int64) * image["quant"]
    return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8).reshape(-(-image["height"] // 8), -(-image["width"] // 8))


def _shrunk(thumb: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid of so many cells; small images repeat samples."""
    y = np.arange(rows + 1) * thumb.shape[0] // rows
    x = np.arange(cols + 1) * thumb.shape[1] // cols
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y1, x1 = np.maximum(y[1:], y[:-1] + 1), np.maximum(x[1:], x[:-1] + 1)
    area = (y1 - y[:-1])[:, None] * (x1 - x[:-1])[None, :]
    return (sums[y1][:, x1] - sums[y[:-1]][:, x1] - sums[y1][:, x[:-1]] + sums[y[:-1]][:, x[:-1]]) * 256 // area


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash, 64 bits each in hex."""
    a, d = _shrunk(thumb, 8, 8), _shrunk(thumb, 8, 9)
    ahash = np.packbits((a * a.size > a.sum()).reshape(-1)).tobytes().hex()
    return ahash, np.packbits((d[:, 1:] > d[:, :-1]).reshape(-1)).tobytes().hex()


# Operators -----------------------------------------------------------------------------------------------------------


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media (binary): a row for each input row."""

    def run(batches):
        for b in slices(batches, 1, BATCH_BYTES):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode([payload(r) for r in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


_FEATURES = (("payload", T.BinaryType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("thumbnail", T.BinaryType()), ("ahash", T.StringType()), ("dhash", T.StringType()))


def features(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload (binary), width, height, thumbnail (binary, a byte a sample), ahash and dhash, read from the media column."""
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in _FEATURES)])

    def run(batches):
        for b in slices(batches, names.index(media_col), BATCH_BYTES):
            cols: list[list] = [[], [], [], [], [], []]
            for x in decode(b.column(names.index(media_col)).to_pylist()):
                if x is None:
                    row = (None,) * 6
                else:
                    thumb = thumbnail(x)
                    row = (stored_payload(x), x["width"], x["height"], thumb.tobytes(), *thumbnail_hashes(thumb))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*names, "payload", "width", "height", "thumbnail", "ahash", "dhash"])

    return rows.mapInArrow(run, schema)
