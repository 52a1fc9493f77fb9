"""Language-model scores from a weighted backoff automaton.

States are contexts: the empty one, and each known n-gram shorter than the
order. A state has an arc for every word seen after it in training, weighted
with the word's smoothed probability there, and a failure arc to the state one
word shorter, weighted with the mass left for unseen words. A text is read
once from left to right; where a state has no arc for the next word, failure
arcs are taken until one has.

Counts are smoothed by a prior of ``PRIOR`` pseudo-counts from the next lower
order: ``p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR)``, and
``p(w) = (c(w) + 1) / (N + V + 1)``.

The automaton grows with the corpus, so no task holds it. Texts are dealt into
shards; a shard sends its distinct n-grams with their training counts to
buckets of the n-gram space, a bucket adds up, and returns to each shard the
totals of what it asked for: just the states and arcs that its texts pass.
N-grams are named by 64-bit fingerprints, so frequent ones weigh no more than
others, and a bucket gets each of them once from a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.llm.words import UNSPACED, Words, mixed, shards, text_bytes

ORDER, PRIOR = 2, 5.0

#: Text bytes of a shard; a text longer than that is a shard of its own size.
SHARD_BYTES = 12 << 20
#: Distinct words that a counting task gathers before it hands them on.
GATHERED = 2_000_000

_END, _START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def packed(x: np.ndarray) -> bytes:
    """Sorted or small integers, by byte planes of their differences or of themselves."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every text's words, an end behind each, and the number of tokens of each text."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in shards(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
        words = Words(*text_bytes(part.column(0)), UNSPACED)
        prints = words.fingerprints() if len(words.starts) else np.zeros(0, np.uint64)
        found.append(np.insert(prints, words.first_word[1:], _END))
        counts.append(words.counts + 1)
    return np.concatenate(found), np.concatenate(counts)


def ngrams(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the fingerprint of the n-gram that ends at each token; texts begin after a start."""
    firsts = np.cumsum(counts) - counts
    out = [tokens]
    for k in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[firsts] = _START + np.uint64(k)
        out.append(mixed(before * _JOIN + tokens + np.uint64(k)))
    return out


def learning(doc_id: Column, parts: int = 7, out: int = 2) -> Column:
    """Rows to learn from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts != out, F.lit(True))


def _vocabulary(docs: DataFrame, buckets: int) -> tuple[int, int, int, int]:
    """Training tokens, distinct ones, training texts, and text bytes of all rows."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told = np.zeros(0, np.uint64), [0, 0, 0]

        def out(final: bool) -> pa.RecordBatch:
            at = np.searchsorted(seen >> shift if buckets > 1 else np.zeros(len(seen), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
            keys = [packed(np.diff(seen[a:b], prepend=np.uint64(0))) for a, b in zip(at, at[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(buckets), pa.int32()), pa.array(keys, pa.binary())]
                + [pa.array([x if final and b == 0 else 0 for b in range(buckets)], pa.int64()) for x in told],
                names=["bucket", "keys", "tokens", "texts", "bytes"])

        for part in shards(batches, "text", 16 << 20):
            tokens, counts = tokens_of(part.column(part.schema.get_field_index("text")))
            learnt = part.column(part.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
            told[0] += int(counts[learnt].sum())
            told[1] += int(learnt.sum())
            told[2] += part.nbytes
            seen = np.union1d(seen, tokens[np.repeat(learnt, counts)])
            if len(seen) > GATHERED:
                yield out(False)
                seen = np.zeros(0, np.uint64)
        yield out(True)

    def united(group):
        every = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in group.column("keys").to_pylist())])
        total = [int(np.sum(group.column(c).to_numpy())) for c in ("tokens", "texts", "bytes")]
        return pa.table({"types": [len(np.unique(every))], "tokens": total[:1], "texts": total[1:2], "bytes": total[2:]})

    found = docs.select("text", "train").mapInArrow(gathered, "bucket int, keys binary, tokens long, texts long, bytes long")
    found = found.groupBy("bucket").applyInArrow(united, "types long, tokens long, texts long, bytes long")
    row = found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "texts", "bytes")]).first()
    return tuple(row)


class Automaton:
    """What a shard needs of the automaton: totals of its distinct n-grams, and the walk over them."""

    def __init__(self, column: pa.Array, order: int):
        self.tokens, self.counts = tokens_of(column)
        self.order = order
        grams = ngrams(self.tokens, self.counts, order)
        self.keys, self.place = np.unique(np.concatenate(grams), return_inverse=True)

    def learnt(self, train: np.ndarray) -> np.ndarray:
        """Training count of each distinct n-gram in this shard."""
        weight = np.tile(np.repeat(train, self.counts), self.order)
        return np.bincount(self.place[weight], minlength=len(self.keys)).astype(np.uint32)

    def walk(self, totals: np.ndarray, n: int, types: int, texts: int, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score and score, both as log10 of a probability."""
        size = len(self.tokens)
        count = totals[self.place].reshape(self.order, size).astype(float)
        firsts = np.cumsum(self.counts) - self.counts
        unigram = (count[0] + 1) / (n + types + 1)
        # Smoothed probability of each arc that a state on the way may have.
        context, chance = [], [unigram]
        for k in range(1, self.order):
            before = np.empty(size)
            before[1:] = count[k - 1][:-1]
            before[firsts] = texts
            context.append(before)
            chance.append((count[k] + prior * chance[-1]) / (before + prior))
        # The walk: from the longest state down failure arcs until there is an arc for the token.
        score, on_way = np.zeros(size), np.arange(size)
        for k in range(self.order - 1, 0, -1):
            arc = count[k][on_way] > 0
            taken, failed = on_way[arc], on_way[~arc]
            score[taken] += np.log10(chance[k][taken])
            score[failed] += np.log10(prior / (context[k - 1][failed] + prior))
            on_way = failed
        score[on_way] += np.log10(unigram[on_way])
        total = lambda x: np.add.reduceat(x, firsts) if len(firsts) else np.zeros(0)
        return total((count[0] > 0).astype(np.int64)), total(np.log10(unigram)), total(score)


def scores(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Scores of every row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words between blanks and 0x09-0x0D after lowering A-Z, and
    one end behind them. The model learns from rows for which ``train``, a
    condition on ``doc_id``, holds. ``base_score`` is the add-one unigram
    score, ``score`` the automaton's; both are log10 of the text's probability.

    Null and empty texts are one end token. Repeated rows count and are scored
    each. Without training rows all counts are 0. An empty table gives no
    rows; other columns are not looked at. Texts of any length are scored
    whole; a worker's memory grows with the longest text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("train", train)
    n, types, texts, size = _vocabulary(base, 64)
    parts = max(1, -(-size // shard_bytes))
    buckets = 1 << max(0, (size // (16 << 20)).bit_length())
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))

    def asked(key, group):
        part = Automaton(group.column("text").combine_chunks(), order)
        counts = part.learnt(group.column("train").to_numpy(zero_copy_only=False).astype(bool))
        at = np.searchsorted(part.keys >> shift if buckets > 1 else np.zeros(len(part.keys), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
        return pa.table({
            "bucket": pa.array(range(buckets), pa.int32()), "shard": pa.array([key[0].as_py()] * buckets, pa.int32()),
            "keys": pa.array([packed(np.diff(part.keys[a:b], prepend=np.uint64(0))) for a, b in zip(at, at[1:])], pa.binary()),
            "counts": pa.array([packed(counts[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
        })

    def added(key, group):
        keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in group.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x, np.uint32) for x in group.column("counts").to_pylist()])
        names, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(names)).astype(np.uint64)[place]
        ends = np.cumsum([len(x) for x in keys])
        return pa.table({
            "bucket": group.column("bucket"), "shard": group.column("shard"),
            "totals": pa.array([packed(total[b - len(x) : b]) for x, b in zip(keys, ends)], pa.binary()),
        })

    def walked(key, group, answers):
        part = Automaton(group.column("text").combine_chunks(), order)
        totals = np.concatenate([unpacked(x, np.uint64) for x in answers.sort_by("bucket").column("totals").to_pylist()])
        known, plain, score = part.walk(totals, n, types, texts, prior)
        return pa.table({
            "doc_id": group.column("doc_id"), "train": group.column("train"), "n_tokens": pa.array(part.counts, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "base_score": plain, "score": score,
        })

    answers = (
        dealt.groupBy("shard").applyInArrow(asked, "bucket int, shard int, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(added, "bucket int, shard int, totals binary")
    )
    found = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        walked, f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(n).cast("long"))
