import random
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from draftweave.llm import quality
from draftweave.llm.queries import VOCABULARY, quality_model
from draftweave.llm.storage import scratch

from .conftest import frame, words
from .test_decontaminate import brute as windows_of
from .test_near import brute as components_of
from .test_near import family


@pytest.fixture(scope="module")
def folder(spark):
    """A small corpus with junk, copies, near copies, benchmark passages, nulls and a long text."""
    dice = random.Random(8)
    passage = " ".join(words(30, 77))
    texts, labels = [], []
    for i in range(220):
        good = dice.random() < 0.75
        w = words(dice.randrange(30, 120), 1000 + i)
        texts.append(" ".join(w) if good else " | ".join(x.upper() + "!!" for x in w))
        labels.append((i, int(good), 0))
    near = family(3, 9)
    texts += [t for t in near] + [near[0].upper(), near[0]] + [f"w1 {passage} w2", " ".join(words(40, 5)) + " " + passage.upper(), None, "", " ".join(words(9000, 6))]
    out = scratch(spark)
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "never in any text at all"), (3, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, texts, passage


def test_stages_equal_brute_force(spark, folder):
    out, texts, passage = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    model = quality_model(spark, docs, out)
    scores = {r.doc_id: r.score for r in quality.with_score(docs, model).collect()}
    left = [i for i in range(len(texts)) if scores[i] >= quality.THRESHOLD]
    seen = defaultdict(list)
    for i in left:
        seen["".join(c.lower() if c.isascii() else c for c in texts[i] or "")].append(i)
    left = sorted(max(x) for x in seen.values())
    left = [i for i, _, _, kept in components_of([texts[i] for i in left], left) if kept]
    hits = windows_of([texts[i] for i in left], [(1, passage), (2, "never in any text at all")])
    left = [i for i, h in zip(left, hits) if not h[-1]]

    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], out).cache())
        assert frames[-1].columns == docs.columns, name
        assert frames[-1].count() < frames[-2].count(), name
    assert sorted(r.doc_id for r in frames[-1].collect()) == left

    encode = Tokenizer.from_file(VOCABULARY)
    want = {i: len(encode.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in left}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, out).collect():
        got[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert got == want


def test_every_stage_takes_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0, name
