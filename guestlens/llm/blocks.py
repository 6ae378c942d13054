"""Words of many texts at once: numpy over the bytes of an Arrow column.

The operators on words (n-gram join, substring dedup, language model, language
ID) read texts as Arrow binary columns and work on *blocks* of documents of a
bounded number of bytes.  A word is a run of bytes for which the separator
table is false; its 64-bit hash is a polynomial over its bytes, taken from one
running sum per chunk, so no Python code runs per word.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20   # text bytes per block of documents
CHUNK_BYTES = 1 << 20   # text bytes hashed at once

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)


def white_space() -> np.ndarray:
    """Separators of the plain word: space and \\t..\\r."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def byte_codes(fold: bool) -> np.ndarray:
    """A 64-bit code per byte; ``fold`` gives A-Z the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


class Words(NamedTuple):
    hash: np.ndarray    # uint64 per word
    doc: np.ndarray     # int64 row of the word's document in the block
    start: np.ndarray   # first byte in the block's buffer
    end: np.ndarray     # byte after the last
    count: np.ndarray   # words per document


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a binary column (null: empty)."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, fold: bool = True) -> Words:
    """All words of the block; ``separator`` is a table over byte values."""
    codes = byte_codes(fold)
    firsts = np.unique(offsets[:-1])
    hashes, starts, ends = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = _cut(data, firsts, separator, at, min(n, at + CHUNK_BYTES))
        part = data[at:to]
        out = separator[part]
        before = np.empty(len(part) + 1, bool)
        before[0] = before[-1] = True
        before[1:-1] = out[:-1]
        here = firsts[np.searchsorted(firsts, at):np.searchsorted(firsts, to)] - at
        after = np.empty(len(part), bool)
        after[:-1] = out[1:]
        after[-1] = True
        before[here] = True
        after[here[here > 0] - 1] = True
        word = ~out
        s, e = np.flatnonzero(word & before[:-1]), np.flatnonzero(word & after) + 1
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * powers(_MUL, len(part)), out=run[1:])
        h = (run[e] - run[s]) * powers(_INV, len(part) + 1)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(join(hashes, np.uint64), doc, start, join(ends, np.int64), np.bincount(doc, minlength=len(offsets) - 1))


def _cut(data, firsts, separator, at, to) -> int:
    """The first place from ``to`` on that is not inside a word."""
    if to >= len(data):
        return len(data)
    nxt = np.searchsorted(firsts, to)
    end = int(firsts[nxt]) if nxt < len(firsts) else len(data)
    while to < end:
        hit = separator[data[to:min(end, to + 65536)]]
        if hit.any():
            return to + int(hit.argmax())
        to = min(end, to + 65536)
    return end


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they are all in one document."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * powers(_MUL, n), out=run[1:])
    h = np.zeros(n, np.uint64)
    h[:n - k + 1] = mix((run[k:] - run[:-k]) * powers(_INV, n)[:n - k + 1] + np.uint64(k))
    whole = np.zeros(n, bool)
    whole[:n - k + 1] = w.doc[k - 1:] == w.doc[:n - k + 1]
    return h, whole


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into blocks of at most ``most`` text bytes (one longer text alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffer_of(batch.column(text))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
