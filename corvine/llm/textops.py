"""Whole-text primitives on Arrow buffers: numpy only, no loop over words.

A batch of texts is one UTF-8 buffer with offsets. Words and n-grams are found and hashed for
the whole buffer at once; temporary arrays are bounded by ``BLOCK`` bytes, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; uint64 in and out."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if lower:
        column = pc.utf8_lower(column)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_table() -> np.ndarray:
    """True for the bytes of words: ASCII letters and digits, and every byte of a longer code point."""
    t = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[lo:hi] = True
    return t


def words(buf: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(start, end, text index, 64-bit hash) of every word; words end with their text.

    With ``stems`` also, for each of these lengths, the hashes of the words' first bytes, the whole word where it is shorter.
    """
    starts, ends, hashes, heads = [], [], [], [[] for _ in stems]
    table = word_table()
    size = max(1, min(BLOCK, len(buf)))
    power = np.cumprod(np.full(size, _BASE, np.uint64))
    inverse = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), np.uint64))
    at, begun = 0, None  # begun: (start, sum so far, heads) of a word that fills whole blocks
    while at < len(buf):
        upto = min(len(buf), at + BLOCK)
        mask = table[buf[at:upto]]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, upto)] - at
        if upto < len(buf):
            # Blocks end between words; a word longer than a block is summed over several.
            cut = max([*np.flatnonzero(~mask)[-1:], *edges[-1:]], default=0)
            if cut > 0:
                upto = at + int(cut)
                mask, edges = mask[:cut], edges[edges < cut]
        inside = upto < len(buf) and bool(mask[-1] and table[buf[upto]]) and offsets[np.searchsorted(offsets, upto)] != upto
        opens = mask.copy()
        opens[1:] &= ~mask[:-1]
        closes = mask.copy()
        closes[:-1] &= ~mask[1:]
        opens[edges] |= mask[edges]
        inner = edges[edges > 0] - 1
        closes[inner] |= mask[inner]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        n = upto - at
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum((buf[at:upto].astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        sums = (prefix[e] - prefix[s]) * inverse[s]
        tops = [(prefix[np.minimum(e, s + k)] - prefix[s]) * inverse[s] for k in stems]
        s, e = s + at, e + at
        if begun is not None:
            shift = pow(_BASE, int(at - begun[0]), 2**64)
            sums[0] = np.uint64((begun[1] + shift * int(sums[0])) % 2**64)
            s[0] = begun[0]
            for top, head in zip(tops, begun[2], strict=True):
                top[0] = head
            begun = None
        if inside:
            begun = int(s[-1]), int(sums[-1]), [top[-1] for top in tops]
            s, e, sums, tops = s[:-1], e[:-1], sums[:-1], [top[:-1] for top in tops]
        hashes.append(mix64(sums))
        for k, head, top in zip(stems, heads, tops, strict=True):
            head.append(mix64(top, k))
        starts.append(s)
        ends.append(e)
        at = upto
    if not starts:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, np.zeros(0, np.uint64), *(np.zeros(0, np.uint64) for _ in stems)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return s, e, np.searchsorted(offsets, s, side="right") - 1, h, *map(np.concatenate, heads)


def lowered(column: pa.Array, limit: int = BLOCK // 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of lower-cased texts, some ``limit`` bytes at a time; nulls count as empty."""
    for lo, hi in blocks(utf8(column)[1], limit):
        yield lo, hi, *utf8(column.slice(lo, hi - lo), lower=True)


def blocks(offsets: np.ndarray, limit: int = 4 * BLOCK) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text is a range of its own."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        out.append((lo, hi))
        lo = hi
    return out
