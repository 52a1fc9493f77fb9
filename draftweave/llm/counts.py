"""Token counts under a unigram model, by a trie of distinct pre-tokens.

A pre-token is a word between blanks with the vocabulary's word mark before
it. Its tokens are those of its most probable split into pieces of a public
vocabulary; a character that no piece covers counts a token for each of its
bytes. Pieces have probabilities by Zipf's law over their rank in the file.

The new distinct pre-tokens of a slice of texts are walked in sorted order, the
order of a depth-first walk through their trie. The forward score of a node
depends on the path to it alone, so it stays for every word that shares the
prefix. What a terminal node holds, its number of tokens, is kept for the
texts that follow, in a table of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm.tokens import Places
from draftweave.llm.words import shards, text_bytes

#: Distinct pre-tokens that a worker keeps.
CACHED = 300_000

MARK = "▁"


def pieces_of(model: bytes) -> list[str]:
    """Ordinary pieces of a sentencepiece model, most frequent first."""
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_proto=model)
    odd = lambda i: found.is_control(i) or found.is_unknown(i) or found.is_byte(i) or found.is_unused(i)
    return [found.id_to_piece(i) for i in range(found.vocab_size()) if not odd(i)]


class Unigram:
    """Log probabilities of pieces, reachable through their endings."""

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / r for r in range(1, len(pieces) + 2)))
        self.endings: dict[str, float | None] = {}
        for rank, piece in enumerate(pieces, 1):
            for k in range(1, len(piece)):
                self.endings.setdefault(piece[k:], None)
            if self.endings.get(piece) is None:
                self.endings[piece] = -math.log(rank) - total
        #: Of each byte of a character without a piece.
        self.byte = -math.log(len(pieces) + 1) - total

    def counted(self, words: list[str]) -> list[int]:
        """Tokens of the best split of each word; words come sorted. Of equal scores, fewer tokens win."""
        score, tokens, before, out = [0.0], [0], "", []
        endings, byte = self.endings, self.byte
        nothing = object()
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                best, count = score[end - 1] + size * byte, tokens[end - 1] + size
                for start in range(end - 1, -1, -1):
                    worth = endings.get(word[start:end], nothing)
                    if worth is nothing:
                        break
                    if worth is not None:
                        s = score[start] + worth
                        if s > best or (s == best and tokens[start] < count):
                            best, count = s, tokens[start] + 1
                score.append(best)
                tokens.append(count)
            before = word
            out.append(tokens[-1])
        return out


class Counter:
    def __init__(self, model: bytes):
        self.unigram = Unigram(pieces_of(model))
        self._forget()

    def _forget(self) -> None:
        self.places, self.tokens = Places(), np.zeros(0, np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        data, offsets = text_bytes(column)
        raw, at = data.tobytes(), offsets.tolist()
        if len(self.places) > CACHED:
            self._forget()
        get = self.places.__getitem__
        words = [raw[a:b].split() for a, b in zip(at, at[1:])]
        counts = np.array([len(x) for x in words], np.int64)
        place = np.fromiter(map(get, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.places.new:
            new = [MARK + x.decode() for x in self.places.new]
            order = sorted(range(len(new)), key=new.__getitem__)
            found = np.zeros(len(new), np.int64)
            found[order] = self.unigram.counted([new[i] for i in order])
            self.tokens = np.concatenate([self.tokens, found])
            self.places.new.clear()
        sums = np.concatenate([[0], np.cumsum(self.tokens[place])])
        ends = np.cumsum(counts)
        return counts, sums[ends] - sums[ends - counts]


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row, over its whole text.

    ``model`` is the path of a sentencepiece file. Words are split at blanks
    and 0x09-0x0D. Null and empty texts have no words and no tokens; null ids
    and repeated rows give a row each; an empty table gives none; other
    columns are not looked at. Texts of any length are counted whole; a
    worker's memory grows with the longest text.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        if hash(raw) not in _counters:
            _counters.clear()
            _counters[hash(raw)] = Counter(raw)
        counter = _counters[hash(raw)]
        for part in shards(batches, "text"):
            words, tokens = counter(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, f"doc_id {kind}, n_words long, n_tokens long")
