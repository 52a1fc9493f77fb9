"""Words of many texts at once, as arrays over the UTF-8 bytes of a batch.

A batch is the concatenated bytes of its texts with their offsets. Word
classes are sets of bytes, so multi-byte characters count by their bytes, all
of which are above 0x7F. Words are named by a 64-bit fingerprint, or exactly by
``distinct``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words made of digits, letters a-z and everything outside ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

#: Bytes of words between blanks and the controls 0x09 to 0x0D.
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[0x20] = UNSPACED[0x09:0x0E] = False

#: Lanes of eight bytes up to which words are hashed together; longer ones go by BLAKE2b, one by one.
LANES = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte spans.

    Lanes of eight bytes are folded one after the other, each through a full
    mixing step, so no family of strings collides by its structure. Results
    that are not compared byte for byte rest on a chance of 2^-64 a pair.
    """
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = np.flatnonzero((sizes > 0) & (sizes <= 8 * LANES))
    at, rest = starts[left], sizes[left]
    while len(left):
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(rest, 8).astype(np.uint64) * np.uint64(8))
        out[left] = mixed((out[left] ^ (lanes[at] & keep)) * np.uint64(0xD6E8FEB86659FD93))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(sizes > 8 * LANES).tolist():
        told = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        out[i] = np.frombuffer(told, "<u8")[0]
    return out


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct content, and for every span the place of its content.

    Spans are grouped by fingerprint and then compared with their group's
    first, byte for byte; spans that differ make groups of their own.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = np.unique(fingerprints(data, starts, ends), return_index=True, return_inverse=True)
    sizes, like = ends - starts, first[which]
    odd = sizes != sizes[like]
    same = np.flatnonzero(~odd)
    differs = spread(data, starts[same], sizes[same]) != spread(data, starts[like[same]], sizes[same])
    if differs.any():
        odd[same[np.repeat(np.arange(len(same)), sizes[same])[differs]]] = True
    if odd.any():
        places: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(odd).tolist():
            body = data[starts[i] : ends[i]].tobytes()
            if body not in places:
                places[body] = len(first) + len(more)
                more.append(i)
            which[i] = places[body]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return first, which


class Words:
    """Words of a batch: byte spans, the number of words of each text, fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.low = LOWER[data]
        inside = word_bytes[self.low]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[firsts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[firsts[firsts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first_word = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first_word)

    def fingerprints(self) -> np.ndarray:
        return fingerprints(self.low, self.starts, self.ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def shards(batches: Iterator[pa.RecordBatch], text: str, most: int = (2 << 20) - 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    # A worker lives on for other tasks; what Arrow holds in reserve it gives back.
    pa.default_memory_pool().release_unused()
