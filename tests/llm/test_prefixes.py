import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from draftweave.llm import prefixes
from draftweave.llm.queries import QUERIES, table

EXTRA = "conv long, name string, depth long, seg string, unit int"
SCHEMA = f"conv_id long, turn long, role string, text string, {EXTRA}"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(abs(c) % 100 * (1 if c >= 0 else -1)), [])[:h] + mine[h:]
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        last = ",".join(str(c) for c in sorted(who) if len(made[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(last.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, "s", 3) for r in rows], SCHEMA)


def nodes_of(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])


def talk(seed, convs, longest):
    dice = random.Random(seed)
    out = []
    for c in convs:
        for turn in range(dice.choice([1, 2, 3, 5, longest])):
            shared = dice.random() < 0.8
            out.append((c, None if turn == 0 and dice.random() < 0.2 else turn, ["user", "assistant", None][turn % 2 if dice.random() < 0.9 else 2],
                        f"t{turn} é😀" if shared else dice.choice([None, "", "x" * dice.randrange(9)])))
    dice.shuffle(out)
    return out


IDS = [*range(0, 12), 100, 101, 150, 199, 205, 299, 300, -100, -101, -5]


@pytest.mark.parametrize(("segment", "longest"), [(256, 9), (1, 9), (2, 21), (4, 37)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, longest):
    monkeypatch.setattr(prefixes, "SEGMENT", segment)
    rows = talk(longest, IDS, longest)
    assert nodes_of(prefixes.trie(table_of(spark, rows).repartition(3))) == brute(rows)


def test_hot_conversations_and_lists_of_ends(spark, monkeypatch, small_groups):
    monkeypatch.setattr(prefixes, "SEGMENT", 4)
    monkeypatch.setattr(prefixes, "ENDS", 3)
    monkeypatch.setattr("draftweave.llm.frequent.FREQUENT", 3)
    rows = [*talk(5, [1, 2, 70], 30), *((c, 0, "user", "hello") for c in range(300, 340))]
    assert nodes_of(prefixes.trie(table_of(spark, rows))) == brute(rows)


def test_nulls_repeats_empty_conversations_and_long_texts(spark):
    rows = [
        (None, 0, "user", "lost"), (7, 0, None, None), (7, 0, None, None), (7, None, "user", "z" * 100_000), (8, 1, "", ""),
        (100, 3, "user", "a"), (100, 3, "user", "a"), (101, 0, "user", "a"), (103, 1, "b", "c"), (104, 2, "bc", ""), (105, 2, "b", "c"),
    ]
    assert nodes_of(prefixes.trie(table_of(spark, rows))) == brute(rows)
    assert nodes_of(prefixes.trie(table_of(spark, []))) == []
    assert nodes_of(prefixes.trie(table_of(spark, [(None, 1, "a", "b")]))) == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(QUERIES["op12_prefix_trie"](spark, folder)) == brute(rows)
