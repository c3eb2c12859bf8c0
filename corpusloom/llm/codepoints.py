"""Arrow text as numpy code-point arrays, and back; word runs and word hashes over whole batches.

Nothing here loops over rows: a batch of texts is one array of code points plus row offsets.
Nulls come out as empty rows; the caller keeps the validity mask.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NCP = 0x110000
U64 = np.uint64
_LEAD = np.ones(256, dtype=np.uint8)
_LEAD[0x80:0xC0] = 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def decode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points uint32, row offsets int64 of length rows+1) of a string column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    if data is None or offs[-1] == offs[0]:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:  # bytes that aren't UTF-8: rebuild with replacement characters
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1] - offs[0], offs[1:] - offs[0])]
        return decode(pa.array(rows, pa.large_string()))
    lead = np.concatenate([[0], np.cumsum(_LEAD[raw], dtype=np.int64)])
    return cps, lead[offs - offs[0]]


def encode(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string column of code points and row offsets; rows where valid is False are null."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(width)])[offs]
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    arr = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data), mask)
    return arr.cast(pa.string())


def valid_mask(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.is_valid())


def row_ids(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(offs))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case (one code point to one), word characters (letters and digits), upper-case letters."""
    lower = np.arange(NCP, dtype=np.uint32)
    word = np.zeros(NCP, dtype=bool)
    upper = np.zeros(NCP, dtype=bool)
    for c in range(sys.maxunicode + 1):
        if c == 0x3400:  # the large uniform blocks are filled below
            break
        _fill(c, lower, word, upper)
    for lo, hi in ((0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x14700), (0x16000, 0x17000), (0x1AFF0, 0x1FC00), (0x1D000, 0x1D001)):
        for c in range(lo, hi):
            _fill(c, lower, word, upper)
    word[0x3400:0x4DC0] = word[0x4E00:0xA000] = word[0xAC00:0xD7A4] = True
    word[0x17000:0x18D09] = word[0x20000:0x2FA20] = word[0x30000:0x323B0] = True
    return lower, word, upper


def _fill(c: int, lower: np.ndarray, word: np.ndarray, upper: np.ndarray) -> None:
    ch = chr(c)
    cat = unicodedata.category(ch)
    if cat[0] == "L" or cat == "Nd":
        word[c] = True
        if cat in ("Lu", "Lt"):
            upper[c] = True
            low = ch.lower()
            lower[c] = ord(low[0])


_CACHE: dict[str, tuple] = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "t" not in _CACHE:
        _CACHE["t"] = _tables()
    return _CACHE["t"]


def word_runs(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of letters and digits; a run never crosses rows."""
    if not len(cps):
        z = np.empty(0, np.int64)
        return z, z, z
    _, word, _ = tables()
    w = word[cps]
    prev = np.concatenate([[False], w[:-1]])
    first = offs[:-1][np.diff(offs) > 0]
    prev[first] = False
    start = np.flatnonzero(w & ~prev)
    nxt = np.concatenate([w[1:], [False]])
    last = offs[1:][np.diff(offs) > 0] - 1
    nxt[last] = False
    end = np.flatnonzero(w & ~nxt) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def run_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run codes[start:end]: a polynomial over mixed codes, finalised."""
    if not len(start):
        return np.empty(0, U64)
    if "mixed" not in _CACHE:
        _CACHE["mixed"] = mix64(np.arange(NCP, dtype=U64) + U64(0x9E3779B97F4A7C15))
    lens = end - start
    total = int(lens.sum())
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    idx = pos + np.repeat(start, lens)
    power = _CACHE.get("power")
    if power is None or len(power) <= lens.max():
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(max(int(lens.max()) + 1, 256), 0x9E3779B97F4A7C15 | 1, dtype=U64))
        if len(power) <= 1 << 16:
            _CACHE["power"] = power
    with np.errstate(over="ignore"):
        terms = _CACHE["mixed"][codes[idx]] * power[pos]
        return mix64(np.add.reduceat(terms, first) + lens.astype(U64))


def pieces(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of the text column (one row at least), so that arrays stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(name)).cast(pa.large_string())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def slices(batches: Iterator[pa.RecordBatch], *names: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named columns hold about `most` bytes or one row."""
    for b in batches:
        size = np.cumsum(sum(pc.binary_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names))
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, to - at)
            at = to
