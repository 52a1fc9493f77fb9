import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from draftweave.llm import bpe, words
from draftweave.llm.queries import QUERIES, VOCABULARY, table

from .conftest import frame
from .test_tokens import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Codec(f.read())


def both_ways(codec, texts):
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    body, ends = codec.decode(ids, bounds)
    return ([ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], [bytes(body[a:b]).decode() for a, b in zip(ends, ends[1:])])


def wanted(library, texts):
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [library.decode(i, skip_special_tokens=False) for i in ids]


def long_words():
    dice = random.Random(7)
    return ["a" * 70_000, "ab" * 900, "".join(dice.choices("abcdefgh", k=30_000)), "the" * 21 + "m", "the" * 22, "é" * 3000]


def test_codec_equals_the_library(codec, library, mixed_texts):
    dice = random.Random(0)
    odd = [*ODD, "<|startoftext|>", "the", "ing", "abcdefghijklmnopqrstuvwxyz" * 3]
    texts = [*mixed_texts, *("".join(dice.choices(odd, k=dice.randrange(14))) for _ in range(3000)), *long_words()]
    assert both_ways(codec, texts) == wanted(library, texts)


def test_every_letter_of_the_basic_plane(codec, library):
    texts = ["x" + chr(c) + "Y" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert both_ways(codec, texts) == wanted(library, texts)


@pytest.mark.parametrize("short", [1, 8, 4096])
def test_scan_and_heap_agree(codec, library, mixed_texts, monkeypatch, short):
    monkeypatch.setattr(bpe, "SHORT", short)
    monkeypatch.setattr(bpe, "ROWS", 3)
    texts = [*mixed_texts, "the" * 300]
    assert both_ways(codec, texts) == wanted(library, texts)


def test_words_of_one_fingerprint_keep_apart(codec, library, mixed_texts, monkeypatch):
    monkeypatch.setattr(words, "fingerprints", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    assert both_ways(codec, mixed_texts) == wanted(library, mixed_texts)


def test_round_trip_on_spark(spark, library, mixed_texts):
    docs = frame(spark, mixed_texts, [None, 3, 3, *range(len(mixed_texts) - 3)]).repartition(3)
    got = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    want = {}
    for t in mixed_texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault((np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids, skip_special_tokens=False)), t)
    assert len(got) == len(mixed_texts)
    assert {(bytes(r.ids), r.n_tokens, r.decoded) for r in got} == set(want)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i in [None, 3, 3, *range(len(mixed_texts) - 3)])


def test_nothing_and_null_ids(spark):
    assert bpe.decode(bpe.encode(frame(spark, []), VOCABULARY), VOCABULARY).count() == 0
    some = spark.createDataFrame([(1, bytearray(), "x"), (2, None, "y"), (3, bytearray(b"\x00\x01\x00\x00"), None)], "n long, ids binary, decoded string")
    got = {r.n: r.decoded for r in bpe.decode(some, VOCABULARY).collect()}
    assert got[1] == "" and got[2] is None and got[3]


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_bpe"](spark, folder).collect()}
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d.doc_id] == (
            d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
