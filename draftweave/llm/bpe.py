"""Byte-pair encoding by contiguous rank arrays, and its decoding.

A word is an array of part ids beside an array of the ranks of adjacent parts.
The least rank (the first of equal ones) is looked for by a scan of the whole
array; its two parts become one, the boundary between them is deleted, so both
arrays stay contiguous and get shorter by one, and the ranks on either side are
looked up anew. Words of one length are rows of one matrix, so that a step
works on all of them; words of more than ``SHORT`` bytes, for which a scan
a merge would be too dear, keep a heap of ranks instead.

Texts are lowered, cut into words, and encoded word by word; a batch encodes
each distinct word once. Special tokens that stand in a text are cut out first.
Decoding puts the tokens' own strings side by side with blanks between them, as
a vocabulary without a decoder asks for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm.tokens import plain_pieces, vocabulary
from draftweave.llm.words import distinct, shards, spread, text_bytes

#: Bytes of the longest word that is scanned, and rows of a matrix of words.
SHORT, ROWS = 64, 1 << 16

#: Bytes of text that a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = (1 << 20) - 1

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte.

    Printable bytes stand for themselves; the others take the letters from
    U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class Merges:
    """The merges of a vocabulary and the parts of which words are made at first."""

    def __init__(self, model: dict):
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int32)
        self.last = np.array([ids[x + end] for x in letters], np.int32)
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.keys = np.append(key[order], np.int64(2**63 - 1))
        self.rank_of = np.append(order.astype(np.int32), _NONE)
        self.made = made
        self.by_pair = dict(zip(key.tolist(), range(len(key))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts; pairs that never merge have the greatest."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.rank_of[at], _NONE)

    def parts(self, data: np.ndarray) -> np.ndarray:
        """First parts of words of equal length, given as rows of bytes."""
        found = self.inner[data]
        found[:, -1] = self.last[data[:, -1]]
        return found

    def scanned(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of equal length: flat, in the order of rows, and the size of each row."""
        n, width = parts.shape
        sizes = np.full(n, width, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(n)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            if parts.shape[1] > 1:
                at = ranks.argmin(axis=1)
                line = np.arange(len(rows))
                least = ranks[line, at]
                going = least != _NONE
            else:
                going = np.zeros(len(rows), bool)
            if not going.all():
                stopped = ~going
                sizes[rows[stopped]] = parts.shape[1]
                done.append((rows[stopped], parts[stopped]))
                if not going.any():
                    break
                rows, parts, ranks, at, least = rows[going], parts[going], ranks[going], at[going], least[going]
                line = np.arange(len(rows))
            # Delete the boundary: what stands behind it moves up by one place.
            parts = np.take_along_axis(parts, _without(parts.shape[1], at + 1), axis=1)
            parts[line, at] = self.made[least]
            ranks = np.take_along_axis(ranks, _without(ranks.shape[1], at), axis=1)
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.ranks(parts[back, at[back] - 1], parts[back, at[back]])
            on = np.flatnonzero(at < parts.shape[1] - 1)
            ranks[on, at[on]] = self.ranks(parts[on, at[on]], parts[on, at[on] + 1])
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for which, found in done:
            flat[starts[which][:, None] + np.arange(found.shape[1])] = found
        return flat, sizes

    def heaped(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long word."""
        first = self.parts(data[None, :])[0]
        ranks = self.ranks(first[:-1], first[1:])
        heap = [(r << 32) | i for i, r in zip(np.flatnonzero(ranks != _NONE).tolist(), ranks[ranks != _NONE].tolist())]
        heapify(heap)
        n = len(first)
        part, made, find = first.tolist(), self.made.tolist(), self.by_pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heappop(heap), 1 << 32)
            j = after[i]
            # A part that went into another one is -1; a pair that has changed has another rank.
            if part[i] < 0 or j >= n or find(part[i] << 32 | part[j]) != rank:
                continue
            part[i], part[j] = made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = find(part[i] << 32 | part[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = find(part[h] << 32 | part[i])
                if r is not None:
                    heappush(heap, r << 32 | h)
        found = np.array(part, np.int32)
        return found[found >= 0]

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that are these spans of bytes: flat, and bounds of each word."""
        sizes = ends - starts
        count = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            width = int(sizes[order[a]])
            if width > SHORT:
                for i in order[a:b].tolist():
                    ids = self.heaped(data[starts[i] : ends[i]])
                    count[i] = len(ids)
                    found.append((np.array([i]), ids))
                continue
            for at in range(a, b, ROWS):
                some = order[at : min(b, at + ROWS)]
                ids, size = self.scanned(self.parts(data[starts[some][:, None] + np.arange(width)]))
                count[some] = size
                found.append((some, ids))
        bounds = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(bounds[-1]), np.int32)
        for which, ids in found:
            own = count[which]
            flat[np.repeat(bounds[which] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return flat, bounds


def _without(width: int, at: np.ndarray) -> np.ndarray:
    """For each row, the columns of ``width`` but the one at ``at``."""
    columns = np.arange(width - 1)
    return columns + (columns >= at[:, None])


class Codec:
    """Encodes and decodes batches of texts with a vocabulary file's contents."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        told = json.loads(spec)
        self.merges = Merges(told["model"])
        whole = Tokenizer.from_str(spec)
        # Rules of Unicode (composition, lowering, word classes) are the library's.
        self.normalised, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {ord(x): b for b, x in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        apart = sorted(self.special, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, apart)) + ")") if apart else None
        names = dict(enumerate([""] * whole.get_vocab_size(True)))
        names |= {i: x for x, i in whole.get_vocab(True).items()}
        shown = [names[i].encode() + b" " for i in range(len(names))]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_bounds = np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    def _words(self, text: str) -> list[bytes | int]:
        """Words of one text, and ids of the special tokens in it."""
        out: list[bytes | int] = []
        for piece in self.apart.split(text) if self.apart else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out.extend(w.translate(self.bytes_of).encode("latin-1") for w, _ in self.cut(self.normalised(piece)))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text; null counts as empty."""
        data, offsets = text_bytes(column)
        plain, low, starts, ends = plain_pieces(data, offsets)
        counts = np.diff(np.searchsorted(starts, offsets))
        bodies, sizes, slots, special = [low.tobytes()], [], [], []
        texts = np.flatnonzero(~plain).tolist()
        for t in texts:
            cut = self._words(data[offsets[t] : offsets[t + 1]].tobytes().decode())
            counts[t] = len(cut)
            slots.append(np.array([-1 if isinstance(x, int) else 0 for x in cut], np.int64))
            special.extend(x for x in cut if isinstance(x, int))
            mine = [x for x in cut if not isinstance(x, int)]
            bodies.extend(mine)
            sizes.extend(map(len, mine))
        if sizes:
            far = len(low) + np.cumsum(sizes)
            starts, ends = np.concatenate([starts, far - sizes]), np.concatenate([ends, far])
            low = np.frombuffer(b"".join(bodies), np.uint8)
        first, which = distinct(low, starts, ends)
        flat, bounds = self.merges.encoded(low, starts[first], ends[first])
        # Special tokens are words of one id behind all others.
        flat = np.concatenate([flat, np.array(special, np.int32)])
        bounds = np.concatenate([bounds, bounds[-1] + np.arange(1, len(special) + 1)])
        own = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        word = own < 0
        own[~word] = which[len(which) - int((~word).sum()) :]
        own[word] = len(first) + np.arange(int(word.sum()))
        edge = np.concatenate([[0], np.cumsum(counts)])
        other = np.zeros(len(counts), bool)
        other[texts] = True
        place = np.zeros(int(edge[-1]), np.int64)
        by_hand = np.repeat(other, counts)
        place[by_hand] = own
        place[~by_hand] = which[: len(which) - int((~word).sum())]
        size = np.diff(bounds)[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return spread(flat, bounds[place], size), ends[edge]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each text's tokens with single blanks between them, and the bounds of each text."""
        sizes = np.diff(self.shown_bounds)[ids]
        body = spread(self.shown, self.shown_bounds[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        # Every token brings a blank; the last one of a text is not wanted.
        full = ends[1:] > ends[:-1]
        return np.delete(body, ends[1:][full] - 1), ends - np.concatenate([[0], np.cumsum(full)])


_codecs: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row, in no order; ``ids`` are little-endian unsigned 32-bit integers.

    Each row is worked on by itself: repeated rows and ids give a row each,
    null ids are kept, null and empty texts have no tokens, and an empty table
    gives an empty one. Other columns are not looked at. A very long text is
    worked on whole, in a slice of its own; memory grows with the longest text,
    and a word of more than ``SHORT`` bytes costs its length times the
    logarithm of it.
    """
    shared = vocabulary(docs.sparkSession, path)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shards(batches, "text", SLICE_BYTES):
            ids, bounds = codec(shared).encode(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), _binary(ids.astype("<u4").view(np.uint8), bounds * 4)],
                names=["doc_id", "n_tokens", "ids"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The table with the text of its ``ids`` as a further column (in place of one of that name).

    Null ids give a null text, no ids an empty one. An id outside the
    vocabulary is an error. Very long lists are decoded whole.
    """
    shared = vocabulary(encoded.sparkSession, path)
    rows = encoded.drop(text)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            start = 0
            while start < len(column):
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
                part = column.slice(start, end - start)
                span = offsets[start : end + 1]
                raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[span[0] : span[-1]]
                body, bounds = codec(shared).decode(raw.view("<u4").astype(np.int64), (span - span[0]) // 4)
                made = pa.array(_binary(body, bounds)).cast(pa.string())
                if part.null_count:
                    made = pc.if_else(part.is_valid(), made, None)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, made], names=[*batch.schema.names, text])
                start = end

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{text}` string")
