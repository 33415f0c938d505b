"""Words of whole texts as 64-bit hashes, computed over Arrow buffers without a Python object per word.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text; everything else
separates. ``WORD_RE`` is the same definition for brute-force versions and SQL. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

WORD_RE = "[0-9a-z\\x80-\\U0010ffff]+"
#: Bytes of text handled at once; numpy holds about 60 times this.
SEGMENT = 1 << 20

_LUT = np.zeros(256, bool)
_LUT[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(r: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _CACHE["p"], _CACHE["i"] = _powers(_R, size), _powers(_RI, size)
    return _CACHE["p"], _CACHE["i"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1) if seed else h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _segment(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends in ``data``; no word crosses a position of ``breaks``."""
    word = _LUT[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inv = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] ^ (ends - starts).astype(np.uint64)), starts, ends


def words(texts: pa.Array, spans: bool = False):
    """``(hashes, offsets)``: the words of all texts in a row, those of text k at ``offsets[k]:offsets[k + 1]``.

    With ``spans`` also the lower-cased bytes, every word's start and end in them, and where each text begins.
    """
    low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    _, at, buf = low.buffers()
    bounds = np.frombuffer(at, np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(buf, np.uint8)[bounds[0] : bounds[-1]] if buf is not None and len(low) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    hashes, starts, ends, begin = [], [], [], 0
    while begin < len(data):
        end = min(len(data), begin + SEGMENT)
        while end < len(data):  # cut only between words
            gap = np.flatnonzero(~_LUT[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        lo, hi = np.searchsorted(bounds, [begin, end])
        h, s, e = _segment(data[begin:end], bounds[lo:hi] - begin)
        hashes.append(h), starts.append(s + begin), ends.append(e + begin)
        begin = end
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    h, s = cat(hashes, np.uint64), cat(starts, np.int64)
    offsets = np.searchsorted(s, bounds)
    return (h, offsets, data, s, cat(ends, np.int64), bounds) if spans else (h, offsets)


def window_hashes(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` words of ``h``, by start."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for begin in range(0, n, SEGMENT):  # powers stay short
        part = h[begin : begin + min(SEGMENT, n - begin) + length - 1]
        p, inv = _pow(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix(part, seed + 1) * p[: len(part)], out=total[1:])
        k = len(part) - length + 1
        out[begin : begin + k] = mix((total[length:] - total[:k]) * inv[:k])
    return out


def trim() -> None:
    """Give freed memory back: reused workers would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes of text, or of one row."""
    try:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        trim()


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only what an operator reads, under fixed names, so that further columns can't clash."""
    return docs.select(F.col(id_col).cast(LongType()).alias("doc_id"), F.col(text_col).cast(StringType()).alias("text"), *more)
