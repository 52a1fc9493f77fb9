import hashlib
import re
import tracemalloc

import pyarrow as pa
import pytest

from draftweave.llm import decontaminate

from .conftest import frame, words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(texts, items, window=10):
    wins = []
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        wins += [(str("null" if item is None else item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for text in texts:
        w, hit, found = cut(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit)))
    return out


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def items(mixed_texts):
    long = mixed_texts[12].split()
    return [
        (1, " ".join(words(120, 1)[20:45])), (2, "one two"), (11, "ONE, two!"), (3, None), (4, ""), (5, " ".join(["same"] * 14)),
        (6, " ".join(long[4000:4040])), (6, " ".join(long[8985:])), (None, "中文"), (7, "absent words only here"), (8, " ".join(long[:11])),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches_equal_brute_force(spark, mixed_texts, items, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    got = decontaminate.matches(frame(spark, mixed_texts), benchmark(spark, items)).orderBy("doc_id").collect()
    keys = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert [tuple(r[k] for k in keys) for r in got] == brute(mixed_texts, items)


def test_spans_and_rows_left(spark, mixed_texts, items):
    docs = frame(spark, mixed_texts)
    told = {r.doc_id: r for r in decontaminate.matches(docs, benchmark(spark, items)).collect()}
    assert [tuple(s) for s in told[3].hit_spans] == [(20, 45)] and told[3].longest_hit == 25
    left = decontaminate.decontaminate(docs, benchmark(spark, items))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in told.items() if not r.contaminated}


def test_longest_match_of_a_suffix(spark, mixed_texts, items):
    got = {(r.item_id, r.length): (r["match"], r.doc_id, r.word) for r in decontaminate.longest_matches(
        frame(spark, mixed_texts), benchmark(spark, items)).collect()}
    assert got["1", 25] == (25, 3, 20)
    assert got["6", 40] == (40, 12, 4000)


def test_empty_tables_and_null_ids(spark, items):
    assert decontaminate.matches(frame(spark, []), benchmark(spark, items)).count() == 0
    none = decontaminate.matches(frame(spark, ["one two", None], [None, None]), benchmark(spark, []))
    assert sorted((r.doc_id, r.n_hit) for r in none.collect()) == [(None, 0), (None, 0)]
    both = decontaminate.matches(frame(spark, ["one two", "one two"], [4, 4]), benchmark(spark, items))
    assert [r.n_hit for r in both.collect()] == [2, 2]


def test_items_that_share_an_opening(spark):
    opening = words(12, 5)
    items = [(i, " ".join([*opening, *words(8, 100 + i, 5000)])) for i in range(300)]
    texts = [" ".join([*words(5, i), *opening, *words(5, 900 + i)]) for i in range(40)] + [items[7][1]]
    got = decontaminate.matches(frame(spark, texts), benchmark(spark, items)).orderBy("doc_id").collect()
    keys = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert [tuple(r[k] for k in keys) for r in got] == brute(texts, items)
    best = {(r.item_id, r.length): r["match"] for r in decontaminate.longest_matches(frame(spark, texts), benchmark(spark, items)).collect()}
    assert best["7", 20] == 20 and best["8", 20] == 12 and len({i for i, _ in best}) == 300


def test_listing_in_slices_and_comparing_in_parts(spark, mixed_texts, items, monkeypatch):
    whole = decontaminate.matches(frame(spark, mixed_texts), benchmark(spark, items)).orderBy("doc_id").collect()
    p = decontaminate.patterns_of([str(i) for i, t in items if t], [t for _, t in items if t], 10)
    data, offsets = decontaminate.text_bytes(pa.array(mixed_texts, pa.string()))
    found = decontaminate.Words(data, offsets, decontaminate.ALPHANUMERIC)
    monkeypatch.setattr(decontaminate, "COMPARED", 7)
    monkeypatch.setattr(decontaminate, "LISTED", 1)
    spans, text, window = decontaminate._shard_hits(found, p)
    slices = list(decontaminate._item_lists(p, text, window, len(mixed_texts)))
    assert len(slices) > 3 and [s for s, _, _ in slices[1:]] == [e for _, e, _ in slices[:-1]]
    assert sum(e - s for s, e, _ in slices) == len(mixed_texts)
    listed = [{"null" if x == "None" else x for x in one} for _, _, part in slices for one in part.to_pylist()]
    assert listed == [set(r.item_ids) for r in whole]
    assert [sum(b - a for a, b in zip(s[::2], s[1::2])) for s in spans] == [r.n_hit for r in whole]


@pytest.mark.parametrize("count, size", [(20_000, 20), (1, 20_000)])
def test_memory_of_many_openings_and_of_a_long_item(count, size):
    """Flat arrays: many items with one opening, and one very long item, stay far below a worker's memory."""
    opening = words(12, 5)
    texts = [" ".join([*opening, *words(size - 12, i, 5000)]) for i in range(count)]
    docs = [" ".join([*opening, f"only{i} here"]) for i in range(1000)]
    tracemalloc.start()
    p = decontaminate.patterns_of([str(i) for i in range(count)], texts, 10)
    data, offsets = decontaminate.text_bytes(pa.array(docs, pa.string()))
    found = decontaminate.Words(data, offsets, decontaminate.ALPHANUMERIC)
    spans, text, window = decontaminate._shard_hits(found, p)
    hits = sum(len(part.values) for _, _, part in decontaminate._item_lists(p, text, window, len(docs)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits == count * len(docs) and all(s == [0, 12] for s in spans)
    assert peak < 400 << 20
