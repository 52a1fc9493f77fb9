"""How two tokenizers cut the same texts, each distinct text worked on once.

Rows are brought together by their full text, so copies count as one text with
a multiplicity. A task tokenises slices of distinct texts both ways and aligns
them by byte offsets: between two neighbouring token ends (of either side)
stands exactly one pair of tokens that overlap, a link. No token of either side
runs from a character into a blank behind it, so texts are cut before such
blanks, and a worker aligns each distinct stretch once and keeps it in a
bounded cache. A slice of texts is
written as one row: each text's measures, the distinct id pairs of the slice
with the multiplicities of the texts that hold them, and for each text the
places of its pairs in that list.

Pair counts are summed over slices, never over documents, so what is shuffled
is the slices' lists of distinct pairs. The counts go back to the slices that
asked for them, and the measures of a text to all rows that hold it. A text
held by more than a thousandth of all rows meets them in a broadcast; there
are fewer than a thousand such texts.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm.bpe import byte_letters
from draftweave.llm.frequent import met
from draftweave.llm.storage import stored
from draftweave.llm.words import distinct, shards, spread, text_bytes

#: Bytes of distinct text in a slice; a longer text is a slice by itself.
SLICE_BYTES = (1 << 20) - 1

#: Stretches that a worker keeps, those it aligns at a time, and those that it joins to one text.
CACHED, STRETCHES, JOINED = 400_000, 40_000, 100

#: First bytes of characters that are surely no white space.
_OPENING = np.ones(256, bool)
_OPENING[:0x21] = _OPENING[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Table(NamedTuple):
    """Strings by number, as flat bytes and bounds."""

    flat: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Table:
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64))

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.bounds[which + 1] - self.bounds[which]

    def joined(self, which: np.ndarray) -> np.ndarray:
        return spread(self.flat, self.bounds[which], self.sizes(which))


class Side(NamedTuple):
    """Token ids of a batch of texts, with the bounds of each text."""

    ids: np.ndarray
    bounds: np.ndarray


def _side(found: list[list[int]]) -> Side:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    return Side(np.fromiter(chain.from_iterable(found), np.int64, int(bounds[-1])), bounds)


class Stretches(NamedTuple):
    """Stretches of text by their bytes: tokens and groups, and flat lists of links and of spelt groups with bounds.

    A stretch that the tokens of both sides don't spell out has no groups.
    """

    place: dict[bytes, int]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_bounds: np.ndarray
    links: np.ndarray
    spelt_bounds: np.ndarray
    spelt: np.ndarray

    def more(self, keys: list[str], found: Aligned, pair: Pair) -> Stretches:
        codes = found.a.ids[np.searchsorted(found.end_a, found.every)] * pair.pieces + found.b.ids[np.searchsorted(found.end_b, found.every)]
        body, ends = spelt(pair, found)
        self.place.update(zip((k.encode() for k in keys), range(len(self.place), len(self.place) + len(keys))))
        join = np.concatenate
        return Stretches(
            self.place, join([self.n_a, np.diff(found.a.bounds)]), join([self.n_b, np.diff(found.b.bounds)]),
            join([self.n_groups, np.diff(found.groups)]),
            join([self.link_bounds, found.links[1:] + len(self.links)]), join([self.links, codes]),
            join([self.spelt_bounds, ends[1:] + len(self.spelt)]), join([self.spelt, body]),
        )


def stretched(pair: Pair, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stretches of all texts in ``pair.known``, and the bounds of each text.

    Stretches begin at the text's start or behind a single blank that no other
    white space follows, which both sides take into the token behind it.
    """
    data, offsets = text_bytes(column)
    cut = np.zeros(len(data) + 1, bool)
    if pair.by_stretch and len(data) > 2:
        blank = data == 0x20
        cut[1:-2] = blank[1:-1] & ~blank[:-2] & _OPENING[data[2:]]
    # Blanks at either end of a text are no cuts.
    full = offsets[1:] > offsets[:-1]
    cut[offsets[:-1][full]] = False
    cut[offsets[1:][full] - 1] = False
    inner = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([offsets[:-1][full], inner + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], inner]))
    first, which = distinct(data, starts, ends)
    raw = data.tobytes()
    keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if len(pair.known.place) > CACHED:
        pair.forget()
    new = [k for k in keys if k not in pair.known.place]
    for at in range(0, len(new), STRETCHES):
        some = new[at : at + STRETCHES]
        pair.learn([k.decode() for k in some])
    place = np.fromiter(map(pair.known.place.__getitem__, keys), np.int64, len(keys))
    return place[which], np.searchsorted(starts, offsets)


class Pair:
    """The two tokenizers: byte-level merges (A) and pieces with byte fallback (B)."""

    def __init__(self, spec: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_str(spec)
        # The strings of special tokens are plain text here.
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        byte_of = {x: bytes([b]) for b, x in enumerate(byte_letters())}
        names = {i: x for x, i in self.a.get_vocab(True).items()}
        self.a_bytes = Table.of([
            b"".join(byte_of.get(c, c.encode()) for c in names.get(i, "")) for i in range(max(names) + 1)])
        self.b_bytes = Table.of([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])
        most = max(len(self.a_bytes.bounds), len(self.b_bytes.bounds)) - 1
        self.digits = Table.of([str(i).encode() + b"," for i in range(most)])
        self.pieces = self.b.get_piece_size()
        self.by_stretch = isinstance(self.a.pre_tokenizer, ByteLevel) and self.a.normalizer is None and not any(
            re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.pieces))
        self.forget()

    def forget(self) -> None:
        self.known = Stretches({}, *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(1, np.int64), np.zeros(0, np.int64),
                               np.zeros(1, np.int64), np.zeros(0, np.uint8))

    def learn(self, stretches: list[str]) -> None:
        """Align stretches not met before, many at a time between blanks; the odd ones singly."""
        fine = [bool(_OPENING[k[:1].encode()[0]]) and k[-1] not in " ▁" for k in stretches]
        odd, plain = [k for k, f in zip(stretches, fine) if not f], [k for k, f in zip(stretches, fine) if f]
        many = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        found = aligned(self, [" ".join(x) for x in many])
        good = [k for x, w in zip(many, found.whole) if w for k in x]
        self.known = self.known.more(good, found.cut(np.cumsum([len(k.encode()) + 1 for k in good], dtype=np.int64)), self)
        odd += [k for x, w in zip(many, found.whole) if not w for k in x]
        self.known = self.known.more(odd, aligned(self, odd), self)

    def encoded(self, texts: list[str]) -> tuple[Side, Side]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return _side(a), _side(self.b.encode(texts, num_threads=1))


def _whole(side: Side, names: Table, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts the tokens' bytes spell out exactly."""
    sizes = names.sizes(side.ids)
    at = np.concatenate([[0], np.cumsum(sizes)])[side.bounds]
    same = np.diff(at) == np.diff(ends)
    fine = same.copy()
    texts = np.flatnonzero(same)
    size = np.diff(ends)[texts]
    got = spread(names.joined(side.ids), at[texts], size)
    bad = np.repeat(texts, size)[got != spread(want, ends[texts], size)]
    fine[bad] = False
    return fine


def _kept(side: Side, keep: np.ndarray) -> Side:
    counts = np.diff(side.bounds) * keep
    return Side(side.ids[np.repeat(keep, np.diff(side.bounds))], np.concatenate([[0], np.cumsum(counts)]))


class Aligned(NamedTuple):
    """A batch of texts: tokens of both sides, groups and links.

    ``end_a`` and ``end_b`` are the byte ends of tokens, ``every`` those of
    links and ``common`` those of groups; ``links`` and ``groups`` hold the
    bounds of each text, ``whole`` says which texts have tokens.
    """

    a: Side
    b: Side
    end_a: np.ndarray
    end_b: np.ndarray
    every: np.ndarray
    common: np.ndarray
    links: np.ndarray
    groups: np.ndarray
    whole: np.ndarray

    def cut(self, ends: np.ndarray) -> Aligned:
        """The same tokens as texts that end at these bytes, where groups end as well."""
        ends = np.concatenate([[0], ends])

        def bounds(found: np.ndarray) -> np.ndarray:
            return np.searchsorted(found, ends, "right")

        return self._replace(
            a=Side(self.a.ids, bounds(self.end_a)), b=Side(self.b.ids, bounds(self.end_b)),
            links=bounds(self.every), groups=bounds(self.common), whole=np.ones(len(ends) - 1, bool),
        )


def aligned(pair: Pair, texts: list[str]) -> Aligned:
    """Align texts; those that are empty or not spelt out by both sides have no tokens."""
    a, b = pair.encoded(texts)
    want, ends = text_bytes(pa.array([" " + t for t in texts], pa.string()))
    keep = _whole(a, pair.a_bytes, want, ends) & _whole(b, pair.b_bytes, want, ends) & (np.diff(ends) > 1)
    a, b = _kept(a, keep), _kept(b, keep)
    end_a, end_b = np.cumsum(pair.a_bytes.sizes(a.ids)), np.cumsum(pair.b_bytes.sizes(b.ids))
    every, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
    text_ends = np.concatenate([[0], end_a])[a.bounds]
    return Aligned(
        a, b, end_a, end_b, every, common, np.searchsorted(every, text_ends, "right"), np.searchsorted(common, text_ends, "right"), keep)


def spelt(pair: Pair, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of each text, as bytes with bounds."""
    n = len(found.a.ids) + len(found.b.ids)
    group_a, group_b = np.searchsorted(found.common, found.end_a), np.searchsorted(found.common, found.end_b)
    of_a, of_b = np.bincount(group_a), np.bincount(group_b)
    before_b = np.concatenate([[0], np.cumsum(of_b)])
    through_a = np.cumsum(of_a)
    at_a = np.arange(len(found.a.ids)) + before_b[group_a]
    at_b = np.arange(len(found.b.ids)) + (through_a[group_b] if len(through_a) else 0)
    ids = np.zeros(n, np.int64)
    ids[at_a], ids[at_b] = found.a.ids, found.b.ids
    sizes = pair.digits.sizes(ids)
    out = pair.digits.joined(ids)
    ends = np.cumsum(sizes)
    last_a, last_b = np.cumsum(of_a) - 1, np.cumsum(of_b) - 1
    out[ends[at_a[last_a]] - 1] = ord("|")
    out[ends[at_b[last_b]] - 1] = ord(";")
    return out, np.concatenate([[0], ends])[found.a.bounds + found.b.bounds]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


_pairs: dict[int, Pair] = {}


def _pair(shared) -> Pair:
    spec, model = shared.value
    key = hash((spec, model))
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(spec, model)
    return _pairs[key]


_TEXTS = "array<struct<key:binary,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,pairs:binary,times:binary>>"
_SLICE = f"slice string, a array<int>, b array<int>, weight array<bigint>, texts {_TEXTS}"


def _texts(keys: pa.Array, columns: list, shas: list[str], pairs: list[bytes], times: list[bytes]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [keys, *(pa.array(c, pa.int64()) for c in columns), pa.array(shas, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
        names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def _slices(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shards(batches, "text", SLICE_BYTES):
            pair = _pair(shared)
            column, weight = part.column(0), part.column(1).to_numpy()
            place, edges = stretched(pair, column)
            known, n = pair.known, part.num_rows
            # A text has tokens only if all its stretches are spelt out.
            owner = np.repeat(np.arange(n), np.diff(edges))
            bad = np.zeros(n, bool)
            bad[owner[known.n_groups[place] == 0]] = True
            place, owner = place[~bad[owner]], owner[~bad[owner]]
            edges = np.searchsorted(owner, np.arange(n + 1))
            sums = [np.bincount(owner, x[place], n).astype(np.int64) for x in (known.n_a, known.n_b, known.n_groups)]
            size = known.link_bounds[place + 1] - known.link_bounds[place]
            code = spread(known.links, known.link_bounds[place], size)
            owner, n_links = np.repeat(owner, size), np.bincount(owner, size, n).astype(np.int64)
            spelt_at, spelt_size = known.spelt_bounds[place], known.spelt_bounds[place + 1] - known.spelt_bounds[place]
            body = spread(known.spelt, spelt_at, spelt_size).tobytes()
            ends = np.concatenate([[0], np.cumsum(spelt_size)])[edges].tolist()
            pairs, place = np.unique(code, return_inverse=True)
            # Distinct pairs of each text, with the times they are linked there.
            each, times = np.unique(owner * max(1, len(pairs)) + place, return_counts=True)
            owner, place = np.divmod(each, max(1, len(pairs)))
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, place, weight[owner])
            edges = np.searchsorted(owner, np.arange(n + 1)).tolist()
            place, times = place.astype("<u4"), times.astype("<u4")
            shas = [hashlib.sha256(body[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
            rows = _texts(
                pa.array([hashlib.sha256(t.encode()).digest() for t in column.to_pylist()], pa.binary()), [*sums, n_links], shas,
                [place[x:y].tobytes() for x, y in zip(edges, edges[1:])], [times[x:y].tobytes() for x, y in zip(edges, edges[1:])],
            )
            one = np.array([0, len(pairs)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), _lists(pairs // pair.pieces, one, pa.int32()), _lists(pairs % pair.pieces, one, pa.int32()),
                 _lists(total, one, pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows)],
                names=["slice", "a", "b", "weight", "texts"],
            )

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures of each text from its slice and the counts that the slice asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            texts = batch.column(0)[i].values
            if texts is None or not len(texts):
                continue
            asked = batch.column(1)[i].values
            n = 0 if asked is None else len(asked)
            count, best = np.zeros(n, np.int64), np.zeros(n, bool)
            if n:
                at = asked.field("place").to_numpy()
                count[at] = asked.field("n").to_numpy()
                best[at] = asked.field("best").to_numpy(zero_copy_only=False)
            n_best, total = [], []
            for p, t in zip(texts.field("pairs").to_pylist(), texts.field("times").to_pylist()):
                place, times = np.frombuffer(p, "<u4"), np.frombuffer(t, "<u4").astype(np.int64)
                n_best.append(int(times[best[place]].sum()))
                total.append(int((times * count[place]).sum()))
            yield pa.RecordBatch.from_arrays(
                [texts.field("key"), *(texts.field(c) for c in ("n_a", "n_b", "n_groups", "n_links")),
                 pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), texts.field("groups_sha256")],
                names=["key", *MEASURES, "groups_sha256"],
            )


def aligned_slices(texts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Slices of distinct ``(text, weight)``: their pairs with weights, and each text's measures."""
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        shared = texts.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    return texts.mapInArrow(_slices(shared), _SLICE)


def pair_counts(slices: DataFrame) -> DataFrame:
    """``a, b, n, best``: documents that hold an id pair linked, and whether no pair of ``a`` has more."""
    asked = slices.select(F.explode(F.arrays_zip("a", "b", "weight")).alias("p")).select("p.*")
    counts = stored(asked.groupBy("a", "b").agg(F.sum("weight").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures of every row: ``doc_id``, ``MEASURES`` and ``groups_sha256``.

    Every row counts as a document, repeated rows and ids included; null ids
    are kept. A text that is null, empty or not spelt out by the tokens of both
    sides has no tokens, links nothing and gets zeros and an empty string.
    Equal counts are all best. An empty table gives an empty one. Other columns
    are not looked at. A very long text is worked on whole as a slice of its
    own; memory grows with the longest text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("weight"))
    slices = stored(aligned_slices(texts, byte_level, pieces))
    asked = slices.select("slice", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("slice", "place", "p.*")
    told = asked.join(pair_counts(slices), ["a", "b"]).groupBy("slice").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))
    with_counts = slices.select("slice", "texts").join(told, "slice", "left").select("texts", "told")
    measures = stored(with_counts.mapInArrow(_measured, f"key binary, {', '.join(f'{m} long' for m in MEASURES)}, groups_sha256 string"))
    full = rows.filter("text <> ''").select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    empty = rows.filter("text = ''").select("doc_id", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups_sha256"))
    return met(stored(full), measures, "key").drop("key").unionByName(empty)
