import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftweave.llm import lm

from .conftest import frame

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, order, prior):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)), None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    counts = [Counter() for _ in range(order + 1)]
    for w, learnt in zip(tokens, train):
        if learnt:
            padded = [0] * (order - 1) + w
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    n, types, texts_learnt = sum(counts[1].values()), len(counts[1]), sum(train)
    out = []
    for w, learnt in zip(tokens, train):
        padded, base, score = [0] * (order - 1) + w, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            p = (counts[1][(padded[i],)] + 1) / (n + types + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                before = tuple(padded[i - k + 1 : i])
                seen = texts_learnt if all(x == 0 for x in before) else counts[k - 1][before]
                p = (counts[k][(*before, padded[i])] + prior * p) / (seen + prior)
            score += math.log10(p)
        out.append((learnt, len(w), sum(counts[1][(x,)] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("order,shard_bytes", [(1, 1 << 20), (2, 1 << 20), (2, 2000), (3, 5000)])
def test_scores_equal_brute_force(spark, mixed_texts, order, shard_bytes):
    texts = [*mixed_texts, "unseen words only", "w1 w2 w3", "same same other"]
    got = lm.scores(frame(spark, texts), lm.learning(F.col("doc_id")), order=order, shard_bytes=shard_bytes).orderBy("doc_id").collect()
    for r, want in zip(got, brute(texts, order, lm.PRIOR), strict=True):
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert math.isclose(r.base_score, want[4], rel_tol=1e-9) and math.isclose(r.score, want[5], rel_tol=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["a b a c", "a b", "b a"]
    every = ["a", "b", "c", "zzz", ""]
    got = lm.scores(frame(spark, texts + every), F.col("doc_id") < 3).filter("doc_id >= 3").orderBy("doc_id").collect()
    # First words after the start, the end after it divided out by another query of one more word.
    two = lm.scores(frame(spark, texts + [f"a {w}".strip() for w in every]), F.col("doc_id") < 3).filter("doc_id >= 3").orderBy("doc_id").collect()
    first = 10 ** got[4].score
    assert 0 < first < 1 and len(two) == 5 and two[0].score < 0


def test_nothing_learnt_empty_table_and_null_ids(spark):
    got = lm.scores(frame(spark, ["a b", None], [None, 1]), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.scores(frame(spark, []), lm.learning(F.col("doc_id"))).count() == 0
    twice = lm.scores(frame(spark, ["a", "a"], [None, None]), lm.learning(F.col("doc_id"))).collect()
    assert [r.train_tokens for r in twice] == [4, 4]


def test_packing_of_integers():
    for x in (np.zeros(0, np.uint64), np.array([3, 0, 2**63], np.uint64)):
        assert lm.unpacked(lm.packed(x), np.uint64).tolist() == x.tolist()
