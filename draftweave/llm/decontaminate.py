"""Benchmark decontamination with suffix arrays.

Every slice of the documents (a shard) gets a suffix array over its words.
Each distinct window of the benchmark is searched there by bisection, which
gives, as one interval of the array, all places that share it; each test suffix
is then searched inside its window's interval for its longest verbatim match.
Shards are independent, so nothing is shuffled; a passage that many documents
or many benchmark texts share costs no more than any other.

Windows are named in tasks, in blocks of about ``BLOCK_BYTES`` text bytes, and
each block is broadcast as flat arrays of some 40 bytes a word. A larger
benchmark takes one more pass over the documents for each further block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftweave.llm.words import ALPHANUMERIC, Words, shards, text_bytes

#: Text bytes of the benchmark in one broadcast, on average.
BLOCK_BYTES = 8 << 20

#: Occurrences compared byte for byte at a time, and item ids listed in one batch.
COMPARED, LISTED = 1 << 17, 1 << 19

_SPANS, _ITEMS, _WORDS = "_llm_spans", "_llm_items", "_llm_words"


@dataclass
class Patterns:
    """Words of one block of the benchmark, and its windows, equal ones merged.

    Word ``i`` has the fingerprint ``prints[i]`` and the bytes
    ``low[byte_start[i]:byte_end[i]]``; its text ends before word ``end[i]`` and
    is of item ``item_of[i]``. Window ``j`` is ``need[j]`` words from word
    ``head[j]`` and occurs in the items ``owners[owner_start[j]:owner_start[j + 1]]``.
    ``window_of[i]`` is the window that the test suffix at word ``i`` begins
    with, -1 where too few words follow. ``item_ids`` are sorted.
    """

    prints: np.ndarray
    byte_start: np.ndarray
    byte_end: np.ndarray
    low: np.ndarray
    end: np.ndarray
    item_of: np.ndarray
    window_of: np.ndarray
    head: np.ndarray
    need: np.ndarray
    owner_start: np.ndarray
    owners: np.ndarray
    item_ids: pa.Array


def patterns_of(ids: list[str], texts: list[str], window: int) -> Patterns:
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    found = Words(data, offsets, ALPHANUMERIC)
    n = len(found.starts)
    prints = found.fingerprints() if n else np.zeros(0, np.uint64)
    text_of = np.repeat(np.arange(len(texts)), found.counts)
    end = found.first_word[1:][text_of]
    need = np.minimum(window, found.counts)[text_of]
    suffix = np.flatnonzero(end - np.arange(n) >= need)
    # A window's name is that of its first words paired with the next word, so equal names mean equal words.
    word = np.unique(prints, return_inverse=True)[1].astype(np.int64) + 1
    name = need[suffix].astype(np.int64)
    for k in range(int(need.max(initial=0))):
        follows = np.where(k < need[suffix], word[np.minimum(suffix + k, n - 1)], 0)
        name = np.unique((name << 32) | follows, return_inverse=True)[1].astype(np.int64)
    head = suffix[np.unique(name, return_index=True)[1]]
    window_of = np.full(n, -1, np.int32)
    window_of[suffix] = name
    item_ids = sorted(set(ids))
    number = {item: i for i, item in enumerate(item_ids)}
    item_of = np.array([number[i] for i in ids], np.int64)[text_of]
    pairs = np.unique(name * max(1, len(item_ids)) + item_of[suffix])
    return Patterns(
        prints, found.starts.astype(np.int32), found.ends.astype(np.int32), found.low, end.astype(np.int32),
        item_of.astype(np.int32), window_of, head.astype(np.int32), need[head].astype(np.int32),
        np.searchsorted(pairs, np.arange(len(head) + 1) * max(1, len(item_ids))),
        (pairs % max(1, len(item_ids))).astype(np.int32), pa.array(item_ids, pa.string()),
    )


class SuffixArray:
    """All word suffixes of a shard, sorted to ``depth`` words or beyond.

    Texts stand one after another with a 0 behind each; words are numbered
    from 1 by the order of their fingerprints.
    """

    def __init__(self, prints: np.ndarray, counts: np.ndarray, depth: int):
        self.names, ranks = np.unique(prints, return_inverse=True)
        n, texts = len(prints), len(counts)
        self.bits = max(1, int(len(self.names)).bit_length())
        self.packed = max(1, 63 // self.bits)
        self.text_of_word = np.repeat(np.arange(texts), counts)
        places = np.arange(n) + self.text_of_word
        size = n + texts
        self.seq = np.zeros(size + max(self.packed, 2) + 1, np.int64)
        self.seq[places] = ranks + 1
        key = self.seq[places]
        for k in range(1, self.packed):
            key = (key << self.bits) | self.seq[places + k]
        order = np.argsort(key)
        self.keys = key[order]
        self.order = places[order]
        self._refine(depth, size)

    def _refine(self, depth: int, size: int) -> None:
        """Double the sorted depth; only suffixes still tied are sorted again."""
        n = len(self.order)
        if not n:
            return
        fresh = np.ones(n, bool)
        fresh[1:] = self.keys[1:] != self.keys[:-1]
        heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.zeros(len(self.seq), np.int64)
        rank[self.order] = heads + 1
        sorted_to = self.packed
        while sorted_to < depth:
            alone = fresh & np.append(fresh[1:], True)
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            behind = rank[np.minimum(self.order[tied] + sorted_to, size)]
            key = (heads[tied] << 32) | behind
            new = np.argsort(key)
            key = key[new]
            self.order[tied] = self.order[tied][new]
            fresh[tied] = np.append(True, key[1:] != key[:-1])
            heads[tied] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
            rank[self.order[tied]] = heads[tied] + 1
            sorted_to *= 2

    def numbered(self, prints: np.ndarray) -> np.ndarray:
        """Word numbers of fingerprints; 0 for words the shard doesn't have."""
        if not len(self.names):
            return np.zeros(prints.shape, np.int64)
        at = np.minimum(np.searchsorted(self.names, prints), len(self.names) - 1)
        return np.where(self.names[at] == prints, at + 1, 0)

    def _compared(self, place: np.ndarray, start: np.ndarray, words: np.ndarray, length: np.ndarray):
        """Sign of the suffix at ``place`` against ``length`` words from ``start``, and the words in common."""
        sign, common = np.zeros(len(place), np.int64), length.copy()
        live, k = np.flatnonzero(length > 0), 0
        while len(live):
            # A text's end is 0, below every word, so no comparison runs past it.
            step = self.seq[np.minimum(place[live] + k, len(self.seq) - 1)] - words[start[live] + k]
            other = step != 0
            sign[live[other]] = np.sign(step[other])
            common[live[other]] = k
            k += 1
            live = live[~other]
            live = live[length[live] > k]
        return sign, common

    def _bisect(self, lo, hi, start, words, length, after: bool) -> np.ndarray:
        """First place in ``lo:hi`` whose suffix is not below (``after``: is above) the words."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            sign, _ = self._compared(self.order[mid], start[open_], words, length[open_])
            below = sign <= 0 if after else sign < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    def windows(self, p: Patterns, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of ``p`` that occur, and their intervals of the array; ``words`` are numbered."""
        strange = np.append(0, np.cumsum(words == 0))
        row = np.flatnonzero(strange[p.head + p.need] == strange[p.head])
        start, need = p.head[row].astype(np.int64), p.need[row].astype(np.int64)
        low = np.zeros(len(row), np.int64)
        high = np.zeros(len(row), np.int64)
        for k in range(self.packed):
            word, free = words[np.minimum(start + k, len(words) - 1)], k >= need
            low = (low << self.bits) | np.where(free, 0, word)
            high = (high << self.bits) | np.where(free, (1 << self.bits) - 1, word)
        lo, hi = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        first = self._bisect(lo, hi, start, words, need, False)
        last = self._bisect(first, hi, start, words, need, True)
        some = first < last
        return row[some], first[some], last[some]

    def longest(self, p: Patterns, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffixes whose window occurs, their longest match and its first place."""
        row, first, last = self.windows(p, words)
        found = np.full(len(p.need) + 1, -1, np.int64)
        found[row] = np.arange(len(row))
        at = found[p.window_of]
        suffix = np.flatnonzero(at >= 0)
        first, last = first[at[suffix]], last[at[suffix]]
        if not len(suffix):
            return suffix, suffix, suffix
        strange = np.where(words == 0, np.arange(len(words)), len(words))
        strange = np.minimum.accumulate(strange[::-1])[::-1]
        known = np.minimum(strange, p.end)[suffix] - suffix
        near = self._bisect(first, last, suffix, words, known, False)
        left, right = np.maximum(near - 1, first), np.minimum(near, last - 1)
        _, to_left = self._compared(self.order[left], suffix, words, known)
        _, to_right = self._compared(self.order[right], suffix, words, known)
        longest = np.maximum(to_left, to_right)
        # The first of all places that match so far, whatever follows there; suffixes with one interval share it.
        first_of = self._bisect(first, last, suffix, words, longest, False)
        behind = self._bisect(first_of, last, suffix, words, longest, True)
        spans, which = np.unique((first_of << 32) | behind, return_inverse=True)
        edges = np.stack([spans >> 32, spans & 0xFFFFFFFF], axis=1).ravel()
        return suffix, longest, np.minimum.reduceat(np.append(self.order, len(self.seq)), edges)[::2][which]


def _ragged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the intervals, and the interval of each."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def _verbatim(found: Words, word: np.ndarray, window: np.ndarray, p: Patterns) -> np.ndarray:
    """Whether the words from ``word`` on equal their windows byte for byte."""
    good = np.ones(len(word), bool)
    for at in range(0, len(word), COMPARED):
        one, size = window[at : at + COMPARED], p.need[window[at : at + COMPARED]].astype(np.int64)
        k, owner = _ragged(np.zeros(len(one), np.int64), size)
        a, b = word[at : at + COMPARED][owner] + k, p.head[one][owner] + k
        a, a_end, b, b_end = found.starts[a], found.ends[a], p.byte_start[b], p.byte_end[b]
        same = a_end - a == b_end - b
        live, step = np.flatnonzero(same), 0
        while len(live):
            equal = found.low[a[live] + step] == p.low[b[live] + step]
            same[live[~equal]] = False
            step += 1
            live = live[equal]
            live = live[a_end[live] - a[live] > step]
        good[at : at + COMPARED] = np.bincount(owner[~same], minlength=len(one)) == 0
    return good


def _text_at(found: Words, place: np.ndarray) -> np.ndarray:
    """The text that a place of the suffix array lies in."""
    return np.searchsorted(found.first_word[:-1] + np.arange(len(found.counts)), place, "right") - 1


def _shard_hits(found: Words, p: Patterns) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Covered word spans of each text, and the distinct pairs of text and occurring window."""
    spans: list[list[int]] = [[] for _ in found.counts]
    if not len(found.starts) or not len(p.need):
        return spans, np.zeros(0, np.int64), np.zeros(0, np.int64)
    array = SuffixArray(found.fingerprints(), found.counts, int(p.need.max()))
    row, first, last = array.windows(p, array.numbered(p.prints))
    at, owner = _ragged(first, last)
    place = array.order[at]
    text, window = _text_at(found, place), row[owner]
    word = place - text
    exact = _verbatim(found, word, window, p)
    text, word, window = text[exact], word[exact], window[exact]
    edge = np.zeros(len(found.starts) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + p.need[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    prev = np.append(False, hit[:-1])
    prev[found.first_word[:-1][found.counts > 0]] = False
    starts = np.flatnonzero(hit & ~prev)
    follow = np.append(hit[1:], False)
    follow[(found.first_word[1:] - 1)[found.counts > 0]] = False
    ends = np.flatnonzero(hit & ~follow) + 1
    for s, e in zip(starts.tolist(), ends.tolist()):
        t = int(array.text_of_word[s])
        spans[t] += [s - int(found.first_word[t]), e - int(found.first_word[t])]
    pairs = np.unique((text << 32) | window)
    return spans, pairs >> 32, pairs & 0xFFFFFFFF


def _item_lists(p: Patterns, text: np.ndarray, window: np.ndarray, texts: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Slices of the texts with the ids of their items, ``LISTED`` windows' items or one text at a time."""
    items = max(1, len(p.item_ids))
    sizes = p.owner_start[window + 1] - p.owner_start[window]
    upto = np.append(0, np.cumsum(np.bincount(text, sizes, texts))).astype(np.int64)
    start = 0
    while start < texts:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + LISTED, "right")) - 1)
        low, high = np.searchsorted(text, [start, end])
        pick, pair = _ragged(p.owner_start[window[low:high]], p.owner_start[window[low:high] + 1])
        keys = np.unique((text[low:high][pair] - start) * items + p.owners[pick])
        offsets = np.append(0, np.cumsum(np.bincount(keys // items, minlength=end - start)))
        yield start, end, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), p.item_ids.take(pa.array(keys % items)))
        start = end


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[Patterns]:
    """Benchmark rows with a text, in blocks built by tasks; the id null is written ``null``."""
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")
    ).filter(F.col("text").isNotNull() & (F.col("text") != "")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        yield patterns_of([], [], window)
        return
    blocks = -(-size // BLOCK_BYTES)

    def built(block: pa.Table) -> pa.Table:
        p = patterns_of(block.column("item").to_pylist(), block.column("text").to_pylist(), window)
        return pa.table({"patterns": pa.array([pickle.dumps(p, 5)], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for (patterns,) in dealt.groupBy("block").applyInArrow(built, "patterns binary").toLocalIterator():
        yield pickle.loads(patterns)


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, text: str, item_id: str, item_text: str) -> DataFrame:
    """``docs`` with covered spans, item ids and number of words as three more columns."""
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    mine = [
        T.StructField(_SPANS, T.ArrayType(T.LongType())), T.StructField(_ITEMS, T.ArrayType(T.StringType())),
        T.StructField(_WORDS, T.LongType()),
    ]
    # Duplicate or clashing names can't pass by name, so columns travel under numbers.
    names = docs.columns
    moved = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    for number, patterns in enumerate(_blocks(benchmark, item_id, item_text, window)):
        shared = spark.sparkContext.broadcast(patterns)

        def searched(batches, shared=shared, later=number > 0):
            p = shared.value
            for part in shards(batches, body):
                data, offsets = text_bytes(part.column(part.schema.get_field_index(body)))
                found = Words(data, offsets, ALPHANUMERIC)
                spans, text_no, window_no = _shard_hits(found, p)
                for start, end, items in _item_lists(p, text_no, window_no, part.num_rows):
                    yield _extended(part.slice(start, end - start), spans[start:end], items, found.counts[start:end], later)

        fields = [f for f in moved.schema.fields if f.name not in (_SPANS, _ITEMS, _WORDS)]
        moved = moved.mapInArrow(searched, T.StructType(fields + mine))
    return moved


def _extended(part: pa.RecordBatch, spans: list[list[int]], items: pa.Array, counts: np.ndarray, later: bool) -> pa.RecordBatch:
    """Rows with what was found in them, joined to what earlier blocks found."""
    if later:
        spans = [_merged(a + b) for a, b in zip(part.column(_SPANS).to_pylist(), spans)]
        items = pa.array(
            [sorted({*a, *b}) for a, b in zip(part.column(_ITEMS).to_pylist(), items.to_pylist())], pa.list_(pa.string())
        )
        part = part.select([c for c in part.schema.names if c not in (_SPANS, _ITEMS, _WORDS)])
    return pa.RecordBatch.from_arrays(
        [*part.columns, pa.array(spans, pa.list_(pa.int64())), items, pa.array(counts, pa.int64())],
        names=[*part.schema.names, _SPANS, _ITEMS, _WORDS],
    )


def _merged(flat: list[int]) -> list[int]:
    """Union of spans given as start, end, start, end."""
    out: list[int] = []
    for start, end in sorted(zip(flat[::2], flat[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """What each document shares with the benchmark, one row for each row of ``docs``.

    Words are lower-cased in A-Z and consist of digits, letters and characters
    outside ASCII. A window is ``window`` consecutive words of a benchmark
    text, or the whole of a shorter one. Columns: ``doc_id, n_words, n_hit``
    (words inside any occurrence of a window), ``n_items, items_sha256``
    (SHA-256 of the ids of items with an occurring window, sorted as strings
    and joined by commas), ``contaminated, item_ids, hit_spans`` (start and end
    of each stretch of hit words) and ``longest_hit``.

    A null or empty text has no words and no hits; a null ``doc_id`` stays a
    row; repeated rows and ids give a row each. Benchmark rows without text
    are passed over, a null item id is listed as ``null``, several rows of one
    id count as one item. Empty tables give no rows, or rows without hits. A
    text of any length, on either side, is searched whole; a document beyond
    2 MB is a shard of its own.
    """
    found = _with_hits(docs.select(doc_id, text), benchmark, window, text, item_id, item_text)
    flat = F.col(_SPANS)
    spans = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int")),
        lambda i: F.struct(F.get(flat, 2 * i).alias("start"), F.get(flat, 2 * i + 1).alias("end")),
    )
    found = found.withColumn("hit_spans", F.slice(spans, F.lit(1), F.floor(F.size(flat) / 2).cast("int")))
    sizes = F.transform("hit_spans", lambda s: s["end"] - s["start"])
    n_hit = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("c0").alias("doc_id"), F.col(_WORDS).alias("n_words"), n_hit.alias("n_hit"),
        F.size(_ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(_ITEMS), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.col(_ITEMS).alias("item_ids"), "hit_spans",
        F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest_hit"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no window of any benchmark text, columns unchanged.

    Nulls, repeated rows and empty tables as in ``matches``: a row without
    text stays, repeated rows share one fate.
    """
    found = _with_hits(docs, benchmark, window, text, item_id, item_text)
    kept = found.filter(F.size(_SPANS) == 0)
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Longest verbatim match of each test suffix that has one of a whole window.

    One row for each item and suffix text: ``item_id`` (as text), ``length`` of
    the suffix in words, ``match`` (words in common) and its place
    ``(doc_id, word)``, the smallest of equally long ones found by the shards.
    Null and empty texts on either side give no rows, nor does an empty table;
    repeated rows count once; texts of any length are searched whole. Matches
    rest on word fingerprints, without the comparison of bytes that ``matches``
    makes.
    """
    spark = docs.sparkSession
    schema = f"item_id string, length long, match long, doc_id {docs.schema[doc_id].dataType.simpleString()}, word long"
    out = None
    for patterns in _blocks(benchmark, item_id, item_text, window):
        shared = spark.sparkContext.broadcast(patterns)

        def best(batches, shared=shared):
            p = shared.value
            deepest = int((p.end - np.arange(len(p.end))).max(initial=1))
            for part in shards(batches, "c1"):
                found = Words(*text_bytes(part.column(1)), ALPHANUMERIC)
                if not len(found.starts) or not len(p.need):
                    continue
                array = SuffixArray(found.fingerprints(), found.counts, deepest)
                suffix, longest, place = array.longest(p, array.numbered(p.prints))
                at = _text_at(found, place)
                yield pa.RecordBatch.from_arrays(
                    [p.item_ids.take(pa.array(p.item_of[suffix])), pa.array(p.end[suffix] - suffix, pa.int64()),
                     pa.array(longest, pa.int64()), part.column(0).take(pa.array(at)),
                     pa.array(place - at - found.first_word[at], pa.int64())],
                    names=["item_id", "length", "match", "doc_id", "word"],
                )

        found = docs.select(F.col(doc_id).alias("c0"), F.col(text).alias("c1")).mapInArrow(best, schema)
        out = found if out is None else out.unionByName(found)
    place = F.struct((-F.col("match")).alias("m"), F.col("doc_id").alias("doc_id"), F.col("word").alias("word"))
    return (
        out.groupBy("item_id", "length").agg(F.min(place).alias("b"))
        .select("item_id", "length", (-F.col("b.m")).alias("match"), "b.doc_id", "b.word")
    )
