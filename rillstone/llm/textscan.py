"""Vectorised scanning of text columns: blocks of rows as one byte array, words and their hashes.

Work is done on blocks of about a megabyte of text, so memory doesn't follow the batch size; a longer
text is a block of its own.
"""

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Bytes that belong to words: ASCII letters and digits, and all bytes of longer characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(2 * BLOCK, n)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others are spread evenly."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, offsets from 0 and bytes of each block."""
    off, data = raw(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1))
        yield row, end, off[row : end + 1] - off[row], data[off[row] : off[end]]
        row = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters, byte for byte, so that positions stay."""
    out = LOWER[data]
    if len(data) > 1:
        second = data[1:]
        upper = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][upper] += 0x20
    return out


#: Code points of scripts that put no spaces between words: Thai to Myanmar, Khmer, Tai, kana, Han, Yi, and their like.
UNSPACED = [(0xE00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1A00), (0x1A20, 0x1AB0), (0x3005, 0x3008), (0x3021, 0x3030), (0x3031, 0x3130), (0x31A0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xA980, 0xA9E0), (0xAA60, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000)]


@cache
def kinds() -> np.ndarray:
    """For each code point 1 if it separates words (punctuation and spaces), 2 if it is a word of its own, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for a, b in UNSPACED:
        out[a:b] = 2
    out[[c for c in range(128, 0x20000) if unicodedata.category(chr(c))[0] in "PZ"]] = 1
    return out


def single(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Takes separators beyond ASCII out of ``inside``; borders of the characters that are words of their own."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return lead
    b = np.concatenate((data, np.zeros(3, np.uint8)))
    first, (c, d, e) = b[lead].astype(np.int64), (b[lead + i].astype(np.int64) & 63 for i in (1, 2, 3))
    size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
    point = np.where(size == 2, (first & 31) << 6 | c, np.where(size == 3, (first & 15) << 12 | c << 6 | d, (first & 7) << 18 | c << 12 | d << 6 | e))
    kind = kinds()[np.minimum(point, 0x10FFFF)]
    for i in range(4):
        at = lead[(kind == 1) & (size > i)] + i
        inside[at[at < len(data)]] = False
    alone = kind == 2
    return np.concatenate((lead[alone], np.minimum(lead[alone] + size[alone], len(data))))


def words(data: np.ndarray, offsets: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of its first word (one entry more than rows).

    With ``apart``, Unicode punctuation and spaces separate too, and each character of a script without spaces is a word.
    """
    inside = WORD[data]
    rows = offsets
    if apart:
        offsets = np.concatenate((offsets, single(data, inside)))
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    opens = before[:-1].copy()
    bounds = offsets[offsets < len(data)]
    opens[bounds] = False
    starts = np.flatnonzero(inside & ~opens)
    closes = np.zeros(len(data) + 1, bool)
    closes[: len(data)] = inside
    closes = closes[1:]
    last = offsets[offsets > 0] - 1
    if len(data):
        closes[last] = False
    ends = np.flatnonzero(inside & ~closes) + 1
    return starts, ends, np.searchsorted(starts, rows)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from differences of one running polynomial sum."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def per_row(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc, empty: float) -> np.ndarray:
    """``ufunc`` over each row's run of values (along axis 0); rows with none get ``empty``."""
    rows = len(first) - 1
    out = np.full((rows, *values.shape[1:]), empty, values.dtype)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = ufunc.reduceat(values, first[:-1][some], axis=0)
    return out
