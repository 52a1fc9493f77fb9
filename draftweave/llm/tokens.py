"""Token ids of whole texts with a public byte-pair tokenizer.

The tokenizer lower-cases, drops white space and never joins pieces across it,
so a text's ids are those of its pre-tokens, one after the other. Each distinct
pre-token is encoded once and kept in a bounded cache. Plain texts are cut all
at once as arrays; texts of other Latin letters are cut by the vocabulary's own
pattern; of any other text, each word between ASCII blanks is encoded as it
stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from draftweave.llm.words import LOWER, distinct, shards, text_bytes

#: Distinct pre-tokens that a worker keeps, and those it encodes at a time.
SLICE, JOINED, SLICE_BYTES = 10_000, 100, (1 << 20) - 1
CACHED = 400_000

#: The vocabulary's pre-tokenizer pattern, its Unicode classes spelt out for lowered Latin-1 (fixed values).
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")

#: Settings under which pre-tokens may be encoded one by one (fixed values).
_BY_WORD = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
}


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file, broadcast; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Places(dict):
    """Numbers keys as they are first asked for."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


#: Kind of each byte of a lowered plain text: blank, letter, number, other. Pre-tokens are runs of
#: letters, single numbers and runs of others.
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x20] = _KIND[0x09:0x0E] = _BLANK
_KIND[0x61:0x7B] = _KIND[0x80:] = _LETTER
_KIND[0x30:0x3A] = _NUMBER


def plain_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which texts are plain, their lowered bytes, and the starts and ends of their pre-tokens.

    Plain texts hold ASCII without the apostrophe, which the pattern treats
    apart, and the letters from U+00C0 to U+00FF, all of which are two bytes
    that begin with 0xC3 and lower by 0x20 in the second.
    """
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    second = (before == 0xC3) & (data >= 0x80)
    fine = ((data < 0x80) & (data != 0x27)) | (data == 0xC3) | (second & (data != 0x97) & (data != 0xB7))
    fine &= ~((before == 0x3C) & (data == 0x7C))
    bad = np.concatenate([[0], np.cumsum(~fine)])
    plain = bad[offsets[1:]] == bad[offsets[:-1]]
    low = LOWER[data]
    low[second & (data <= 0x9E)] += 0x20
    kind = _KIND[low]
    kind[~np.repeat(plain, np.diff(offsets))] = _BLANK
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    edge[offsets] = True
    full = kind != _BLANK
    return plain, low, np.flatnonzero(full & edge[:-1]), np.flatnonzero(full & edge[1:]) + 1


class Encoder:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        told = json.loads(spec)
        self.by_word = [x["type"] for x in told["normalizer"]["normalizers"]] == _BY_WORD["normalizer"] and [
            x["type"] for x in told["pre_tokenizer"]["pretokenizers"]] == _BY_WORD["pre_tokenizer"] and all(
            x["content"].startswith("<|") for x in told["added_tokens"])
        end = told["model"].get("end_of_word_suffix") or "\n"
        size = self.tokenizer.get_vocab_size(True)
        self.closing = np.zeros(size, bool)
        self.closing[[i for x, i in self.tokenizer.get_vocab(True).items() if x.endswith(end)]] = True
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes | str, int] = {}
        self.bounds, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _cut(self, raw: bytes) -> list[str]:
        text = raw.decode()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            words = [x.decode() for x in raw.split()]
            return words if len(words) < 2 else list(chain.from_iterable(self._cut(x.encode()) for x in words))
        if "<|" in text:
            return [x.decode() for x in raw.split()]
        return PRE_TOKENS.findall(text.lower())

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list, pieces: list[str], single: bool) -> None:
        """Encode pieces not met before and keep their ids under these keys.

        Pieces that are a pre-token each (``single``) are encoded many at a
        time between blanks; each ends with the one id that closes a word.
        """
        self.places.update(zip(keys, range(len(self.places), len(self.places) + len(keys))))
        for at in range(0, len(pieces), SLICE):
            some = pieces[at : at + SLICE]
            ends = np.zeros(0, np.int64)
            if single:
                joined = self._encoded([" ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)])
                ids = np.fromiter(chain.from_iterable(joined), np.uint32)
                ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                found = self._encoded(some)
                ids = np.fromiter(chain.from_iterable(found), np.uint32)
                ends = np.cumsum([len(x) for x in found], dtype=np.int64)
            self.bounds = np.concatenate([self.bounds, ends + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])

    def _found(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text."""
        data, offsets = text_bytes(column)
        at = offsets.tolist()
        if not self.by_word:
            raw = data.tobytes()
            found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(at, at[1:])], add_special_tokens=False)
            ids = [x.ids for x in found]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if len(self.places) > CACHED:
            self._forget()
        plain, low, starts, ends = plain_pieces(data, offsets)
        first, which = distinct(low, starts, ends)
        raw = low.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        new = [k for k in keys if k not in self.places]
        self._learn(new, [k.decode() for k in new], True)
        counts = np.diff(np.searchsorted(starts, offsets))
        other = {int(t): self._cut(data[at[t] : at[t + 1]].tobytes()) for t in np.flatnonzero(~plain)}
        new = [x for x in dict.fromkeys(chain.from_iterable(other.values())) if x not in self.places]
        self._learn(new, new, False)
        quick = counts.copy()
        for t, cut in other.items():
            counts[t] = len(cut)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        place = np.zeros(int(bounds[-1]), np.int64)
        if len(starts):
            place[np.repeat(bounds[:-1] - (np.cumsum(quick) - quick), quick) + np.arange(len(starts))] = self._found(keys)[which]
        for t, cut in other.items():
            place[bounds[t] : bounds[t + 1]] = self._found(cut)
        sizes = (self.bounds[1:] - self.bounds[:-1])[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.bounds[place] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[bounds]


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; later tasks find its cache filled."""
    spec = shared.value
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def ended(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end`` behind them."""
    out = np.insert(ids, bounds[1:], end)
    return out.astype(np.uint32), bounds + np.arange(len(bounds))


def encoded(batches: Iterator[pa.RecordBatch], text: str, shared, end: int):
    """Slices of the batches with their ids and bounds."""
    encode = encoder(shared)
    for part in shards(batches, text, SLICE_BYTES):
        ids, bounds = encode(part.column(part.schema.get_field_index(text)))
        yield part, *ended(ids, bounds, end)
