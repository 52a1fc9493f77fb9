import hashlib
from collections import defaultdict

import pytest

from draftweave.llm import naming

from .conftest import frame

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[(t or "").translate(UPPER)].append(i)
    return sorted(
        (i, max(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
        for i, t in zip(ids, texts) for n in [(t or "").translate(UPPER)]
    )


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_groups_equal_brute_force(spark, mixed_texts, block):
    texts = [t if t is None else t[:3000] for t in mixed_texts]
    got = naming.exact_groups(frame(spark, texts), block_bytes=block).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(texts, range(len(texts)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_blocks_in_another_order_differ(spark):
    texts = ["aaabbb", "bbbaaa", "aaabbbaaa", "aaabbbaa", "aaa", "AAAbbb"]
    got = {r.doc_id: r.group_size for r in naming.exact_groups(frame(spark, texts), block_bytes=3).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2}


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["a", "a", "A", "b", None, ""], [5, 5, 3, None, None, None])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in naming.exact_groups(docs).collect()), key=str)
    assert got == sorted([
        (5, 5, 3, True), (5, 5, 3, False), (3, 5, 3, False), (None, None, 1, True), (None, None, 2, True), (None, None, 2, False)], key=str)
    left = naming.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect()) == [("5", "a"), ("None", ""), ("None", "b")]


def test_rows_left_and_empty_table(spark, mixed_texts):
    docs = frame(spark, mixed_texts)
    stay = {r.doc_id for r in naming.exact_groups(docs).filter("kept").collect()}
    assert {r.doc_id for r in naming.deduplicate(docs).collect()} == stay
    assert naming.exact_groups(frame(spark, [])).count() == 0
    assert naming.deduplicate(frame(spark, [])).count() == 0


def test_another_seed_where_digests_meet(spark, monkeypatch):
    from pyspark.sql import functions as F

    plain = naming._digest
    monkeypatch.setattr(naming, "_digest", lambda b, seed: plain(b, seed) if seed else [F.lit(1).cast("long").alias("a"), F.lit(1).cast("long").alias("b")])
    got = naming.exact_groups(frame(spark, ["x", "y", "x"])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(0, 2), (1, 1), (2, 2)]
