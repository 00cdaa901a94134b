"""Vectorised word hashing over Arrow string batches (numpy, no Python loop per word).

Words are maximal runs of bytes that are not separators. A word's hash is a polynomial
over its bytes modulo 2**64, mixed once more; all words of a batch are hashed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain): a bijection on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if "n" not in _powers or len(_powers["n"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("n", _BASE), ("inv", _BASE_INV)):
            step = np.full(size, base, dtype=_U)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["n"], _powers["inv"]


def table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is separator, value) for each byte; with lower, A-Z count as a-z."""
    is_sep = np.zeros(256, dtype=bool)
    is_sep[list(separators)] = True
    value = _BYTE_VALUE.copy()
    if lower:
        value[65:91] = value[97:123]
    return is_sep, value


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = table(b"\x20\t\n\x0b\x0c\r")
#: Every ASCII byte but letters and digits.
NON_ALNUM = table(bytes(c for c in range(128) if not chr(c).isalnum()))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return (body[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(texts) else (body[:0], np.zeros(1, np.int64))


def hash_words(body: np.ndarray, offsets: np.ndarray, kind=SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and the total, first byte of each word)."""
    n = len(body)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    is_sep, value = kind
    word = ~is_sep[body]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(value[body] * power[:n], out=total[1:])
    hashes = mix((total[last + 1] - total[first]) * inverse[first] + (last - first + 1).astype(_U))
    return hashes, np.searchsorted(first, offsets, side="left"), first


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` words inside one text, number of the first of each text and the total).

    A text with fewer words, but at least one, gives its whole sequence as its only shingle.
    """
    counts = np.diff(bounds)
    kept = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(kept, out=out_bounds[1:])
    out = np.zeros(out_bounds[-1], _U)
    if not len(out):
        return out, out_bounds
    text_of = np.repeat(np.arange(len(counts)), kept)
    at = bounds[text_of] + np.arange(len(out)) - out_bounds[text_of]
    span = np.minimum(counts[text_of], width)
    for i in range(width):
        inside = span > i
        word = hashes[np.where(inside, at + i, 0)]
        out = np.where(inside, mix(out * _U(_BASE) + word), out)
    return out, out_bounds


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about `most` bytes of the column at most; one long text stays whole."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the values of each text and drops repeats: (values, bounds)."""
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text_of))
    v, t = values[order], text_of[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[fresh], t[fresh]
    return v, np.searchsorted(t, np.arange(len(bounds)), side="left")
