import random
import re

import numpy as np
import pytest

from draftweave.llm import near
from draftweave.llm.components import connected_components

from .conftest import frame, words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, ids):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(s), least[root(i)], least[root(i)] == ids[i]) for i, s in enumerate(sets))


def family(seed, copies):
    """A text and copies of it with more and more words changed."""
    dice, base = random.Random(seed), words(150, seed)
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(k % 12):
            w[dice.randrange(len(w))] = f"x{dice.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(near, "TILE_MEMBERS", 3)
    monkeypatch.setattr(near, "TILE_SHINGLES", 500)


def told(frame_):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame_.collect())


def test_components_equal_brute_force(spark, mixed_texts):
    texts = [*mixed_texts, *family(5, 40), *family(6, 25)]
    ids = [1000 - i for i in range(len(texts))]
    assert told(near.components(frame(spark, texts, ids)).drop("row")) == brute(texts, ids)


def test_tiles_give_the_same(spark, small_tiles):
    texts = [*family(7, 45), "short one", "short one"]
    assert told(near.components(frame(spark, texts)).drop("row")) == brute(texts, range(len(texts)))


def test_chain_is_one_component(spark):
    base = words(400, 9)
    texts = []
    for k in range(12):
        for i in range(6):
            base[(k * 31 + i * 5) % 400] = f"y{k}_{i}"
        texts.append(" ".join(base))
    got = told(near.components(frame(spark, texts)).drop("row"))
    assert got == brute(texts, range(len(texts)))
    assert {c for _, _, c, _ in got} == {0}


def test_rows_left_nulls_and_empty_table(spark, mixed_texts):
    docs = frame(spark, mixed_texts)
    stay = {r.doc_id for r in near.components(docs).filter("kept").collect()}
    left = near.deduplicate(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == stay
    assert {0, 1, 2, 17, 18} <= stay
    assert near.components(frame(spark, [])).count() == 0
    ids = near.components(frame(spark, ["a b c", "a b c", None], [None, 4, None])).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in ids) == ["(4, 4, True)", "(None, 4, False)", "(None, None, True)"]


def test_sketch_estimates_similarity():
    dice = np.random.default_rng(1)
    for n in (3, 20, 400):
        hits = []
        for _ in range(60):
            x = dice.integers(0, 2**63, 2 * n, dtype=np.uint64)
            table = near.sketches([np.sort(x[: n + n // 2]), np.sort(x[n // 2 :])])
            assert (table != np.iinfo(np.uint64).max).all()
            hits.append((table[0] == table[1]).mean())
        a, b = set(range(n + n // 2)), set(range(n // 2, 2 * n))
        assert abs(np.mean(hits) - len(a & b) / len(a | b)) < 0.06


def test_connected_components_of_long_paths(spark):
    dice = random.Random(4)
    nodes = list(range(300))
    dice.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(299) if i % 100 != 99] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: min(nodes[i // 100 * 100 : i // 100 * 100 + 100]) for i, n in enumerate(nodes)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_limit_is_a_parameter(spark):
    base = words(204, 5, 10**6)
    # 200 shingles, and 20 of each other: 180 of 220 shared, 0.818.
    texts = [" ".join(base), " ".join([*base[20:], *words(20, 6, 10**6)])]
    docs = frame(spark, texts)
    assert [r.doc_id for r in near.deduplicate(docs, percent=80).collect()] == [0]
    assert near.deduplicate(docs, percent=85).count() == near.deduplicate(docs).count() == 2
    assert near.cuts(85) == (4, 60) and near.cuts(80) == (3, 53)
