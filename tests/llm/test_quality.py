import math
import random

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from draftweave.llm import quality

from .conftest import frame, words


def corpus(n, seed):
    dice = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        good = dice.random() < 0.7
        w = words(dice.randrange(20, 150), seed * 10_000 + i)
        texts.append(" ".join(w) if good else " | ".join(x.upper() + "!!" for x in w))
        labels.append(int(good))
    return texts, labels


def label_table(spark, labels, ids=None):
    return spark.createDataFrame([(i, y, 0) for i, y in zip(ids or range(len(labels)), labels)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, mixed_texts):
    texts, labels = corpus(500, 1)
    docs = frame(spark, [*texts, *mixed_texts])
    model = quality.fit(docs, label_table(spark, labels), ~quality.held_out(F.col("doc_id")))
    rows = quality.with_score(docs, model).select("doc_id", "score", quality.held_out(F.col("doc_id")).alias("out")).collect()
    assert len(rows) == len(texts) + len(mixed_texts) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.out and r.doc_id < 500]
    right = sum((r.score >= quality.THRESHOLD) == (labels[r.doc_id] == 1) for r in held)
    assert right >= 0.97 * len(held)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= quality.THRESHOLD}


def test_score_depends_on_the_text_alone(spark):
    texts, labels = corpus(200, 2)
    docs = frame(spark, texts)
    model = quality.fit(docs, label_table(spark, labels), F.lit(True))
    same = frame(spark, [texts[3], texts[3], None, ""], [None, 900, 901, 902]).withColumn("lang", F.lit("zz"))
    a, b, c, d = [r.score for r in quality.with_score(same, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert a == b and c == d


def test_one_class_no_labels_and_empty_tables(spark):
    docs = frame(spark, ["a b", None])
    for labels in ([], [1, 1], [None, 5]):
        model = quality.fit(docs, label_table(spark, labels), F.lit(True))
        assert model.constant is not None and len(quality.with_score(docs, model).collect()) == 2
    texts, labels = corpus(120, 3)
    model = quality.fit(frame(spark, texts), label_table(spark, labels), F.lit(True))
    assert quality.with_score(frame(spark, []), model).count() == 0


def test_repeated_labels_are_one_row(spark):
    texts, labels = corpus(150, 4)
    docs = frame(spark, texts)
    once = quality.fit(docs, label_table(spark, labels), F.lit(True))
    twice = quality.fit(docs, label_table(spark, labels + labels, [*range(150), *range(150)]), F.lit(True))
    assert once == twice


def test_repeated_rows_of_an_id_are_drawn_once(spark):
    texts, labels = corpus(120, 4)
    marks = label_table(spark, labels)
    plain = quality.fit(frame(spark, texts), marks, F.lit(True))
    often = [i for i in range(120) for _ in range(30 if i < 8 else 1)]
    assert quality.fit(frame(spark, [texts[i] for i in often], often), marks, F.lit(True)) == plain


def by_hand(text, model):
    """Compress block by block with each dictionary, one text at a time, and apply the curve."""
    raw = (text or "").encode()

    def size(data, dictionary=None):
        extra = {} if dictionary is None else {"dict_data": zstandard.ZstdCompressionDict(dictionary), "write_dict_id": False}
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, **extra).compress(data))

    blocks = [raw[i : i + 512] for i in range(0, len(raw), 512)] or [b""]
    good, bad = (sum(size(b, d) for b in blocks) for d in (model.good, model.bad))
    n = max(1, len(raw))
    x = [(bad - good) / (good + bad), math.log(good / n), math.log(bad / n), math.log(size(raw) / n), math.log(1 + len(raw))]
    z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.spread))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_brute_force(spark, mixed_texts):
    texts, labels = corpus(300, 6)
    every = [*texts, *mixed_texts, " ".join(words(40_000, 9))]
    model = quality.fit(frame(spark, every), label_table(spark, labels), ~quality.held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in quality.with_score(frame(spark, every), model).select("doc_id", "score").collect()}
    assert max(abs(got[i] - by_hand(t, model)) for i, t in enumerate(every)) < 1e-6


def test_blocks_of_a_sampled_row():
    batch = pa.RecordBatch.from_pydict({"label": pa.array([1, 0], pa.int32()), "text": ["a" * 10_000, None]})
    few = [b for part in quality._drawn(8)([batch]) for b in part.column(1).to_pylist()]
    whole = [b for part in quality._drawn(None)([batch]) for b in part.column(1).to_pylist()]
    assert len(few) <= 8 and b"".join(whole) == b"a" * 10_000
