import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from draftweave.llm import counts, packing, records, tokens
from draftweave.llm.queries import VOCABULARY
from draftweave.llm.storage import scratch

from .conftest import frame, words


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(VOCABULARY)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["a", "B", "é", "É", "ß", "ẞ", "İ", "Σ", "ς", "'", "'s", "'T", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "1", "²", "Ⅷ", ".", "!!",
       "<|", "<|endoftext|>", "“", "中", "é", "́", "ª", "×", "𝒳", "😀", "\xad", "\x00", "K", "ſ", "_"]


def test_encoder_equals_the_tokenizer(plain, mixed_texts):
    with open(VOCABULARY, encoding="utf-8") as f:
        encode = tokens.Encoder(f.read())
    dice = random.Random(0)
    texts = [*mixed_texts, *("".join(dice.choices(ODD, k=dice.randrange(14))) for _ in range(3000))]
    ids, bounds = encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t) for t in texts]


def test_encoder_forgets_and_learns_again(plain, mixed_texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    with open(VOCABULARY, encoding="utf-8") as f:
        encode = tokens.Encoder(f.read())
    for _ in range(2):
        for t in mixed_texts[:12]:
            assert encode(pa.array([t], pa.string()))[0].tolist() == plain(t)


def test_records_round_trip(spark, plain, mixed_texts):
    order = random.Random(2).sample(range(len(mixed_texts)), len(mixed_texts))
    folder = scratch(spark)
    records.write(frame(spark, [mixed_texts[i] for i in order], order).repartition(3), folder, VOCABULARY, 2)
    at, want = 0, []
    for i, t in enumerate(mixed_texts):
        ids = [*plain(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in records.in_order(spark, folder).collect()) == want
    shuffled = records.read(records.index(spark, folder).orderBy("bytes", "doc_id").filter("doc_id % 3 = 1"), folder)
    assert {r.doc_id: r.ids for r in shuffled.collect()} == {i: [*plain(t), 2] for i, t in enumerate(mixed_texts) if i % 3 == 1}


def test_records_of_null_and_repeated_ids_and_none(spark):
    folder = scratch(spark)
    records.write(frame(spark, ["b", None, "a", "a"], [7, None, 7, 7]), folder, VOCABULARY, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in records.in_order(spark, folder).collect()), key=lambda r: r[0])
    assert [g[1] for g in got] == [None, 7, 7, 7] and [g[2] for g in got] == [1, 2, 2, 2]
    empty = scratch(spark)
    assert records.write(frame(spark, []), empty, VOCABULARY, 2).count() == 0
    assert records.in_order(spark, empty).count() == 0


def test_damage_is_seen():
    good = records.framed(b"\x01\x00\x02\x00")
    assert records.payload_of(good) == b"\x01\x00\x02\x00"
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.payload_of(bytes(bad))


@pytest.mark.parametrize("block", [4096, 12])
def test_packing_holds_every_piece(spark, plain, mixed_texts, block):
    texts = [*mixed_texts, *(" ".join(words(20 + 7 * i, i)) for i in range(60))]
    got = packing.pack(frame(spark, texts), VOCABULARY, 0, limit=256, block_pieces=block).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = [*plain(t), 0]
        for p in range(0, len(ids), 256):
            want[i, p // 256] = (p, len(ids[p : p + 256]), crc(ids[p : p + 256]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    fewest = -(-sum(n for _, n, _ in want.values()) // 256)
    assert len(held) <= fewest * 1.02 + 1 + len(texts) / block


def test_packing_nulls_repeats_and_none(spark):
    got = packing.pack(frame(spark, ["a", "a", None], [1, 1, None]), VOCABULARY, 0).collect()
    assert sorted(r.offset for r in got) == [0, 2, 4] and len({r.sequence_id for r in got}) == 1
    assert packing.pack(frame(spark, []), VOCABULARY, 0).count() == 0


def test_crossover_keeps_every_piece_once():
    dice = random.Random(3)
    lengths = [dice.randrange(1, 100) for _ in range(300)]
    a, b = packing.best_fit_decreasing(lengths, 128), packing.best_fit_decreasing(lengths, 128, dice)
    for _ in range(20):
        a, b = packing.mutated(packing.crossover(a, b, lengths, 128, dice), lengths, 128, dice), a
        assert sorted(i for m in a for i in m) == list(range(300))
        assert max(packing.filled(a, lengths)) <= 128
    best = packing.evolved(lengths, 128, 1, [])
    assert len(best) <= len(packing.best_fit_decreasing(lengths, 128))


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def best_split(model, word):
    """Over all splits of a short word: the fewest tokens of the highest score."""
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * model.byte, -(best[end - 1][1] + size))]
        for start in range(end):
            worth = model.endings.get(word[start:end])
            if worth is not None:
                options.append((best[start][0] + worth, -(best[start][1] + 1)))
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[len(word)][1]


def test_token_counts_equal_each_word_alone(spark, mixed_texts):
    with open(MODEL, "rb") as f:
        model = counts.Unigram(counts.pieces_of(f.read()))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in counts.token_counts(frame(spark, mixed_texts), MODEL).collect()}
    for i, t in enumerate(mixed_texts):
        cut = [x.decode() for x in (t or "").encode().split()]
        memo = {w: best_split(model, counts.MARK + w) for w in set(cut)}
        assert got[i] == (len(cut), sum(memo[w] for w in cut))
    assert counts.token_counts(frame(spark, []), MODEL).count() == 0


def test_best_split_of_all_splits():
    model = counts.Unigram(["▁a", "b", "ab", "▁", "a", "abab", "c"])
    from itertools import product

    for word in ("▁abab", "▁aab", "▁cab", "▁xab"):
        totals = []
        for cut in product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cut, 1], 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            worth = [model.endings.get(p) for p in parts]
            if all(w is not None or len(p) == 1 for w, p in zip(worth, parts)):
                size = [1 if w is not None else len(p.encode()) for w, p in zip(worth, parts)]
                totals.append((sum(w if w is not None else n * model.byte for w, n in zip(worth, size)), -sum(size)))
        best = max(t for t, _ in totals)
        assert model.counted([word]) == [-max(n for t, n in totals if abs(t - best) < 1e-9)]
