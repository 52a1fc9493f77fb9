import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from draftweave.llm import align
from draftweave.llm.queries import BYTE_LEVEL, PIECES, QUERIES, table

from .conftest import frame


class Brute:
    """Alignment token by token, and pair counts over all documents."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_LEVEL)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.known = {}

    def tokens(self, text):
        if not text:
            return [], []
        if text not in self.known:
            whole = (" " + text).encode()
            a = self.a.encode(" " + text, add_special_tokens=False)
            at = [x.encode() for x in (" " + text)]
            starts = [0]
            for x in at:
                starts.append(starts[-1] + len(x))
            spans, end = [], 0
            letters = {x: i for i, x in enumerate(align.byte_letters())}
            for i, name in zip(a.ids, a.tokens):
                end += len(bytes(letters[c] for c in name))
                spans.append((i, end))
            ok = b"".join(bytes(letters[c] for c in name) for name in a.tokens) == whole
            other, end, body = [], 0, b""
            for i in self.b.encode(text):
                piece = self.b.id_to_piece(i)
                raw = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
                body += raw
                end += len(raw)
                other.append((i, end))
            self.known[text] = (spans, other) if ok and body == whole else ([], [])
        return self.known[text]

    def links(self, text):
        a, b = self.tokens(text)
        out, i, j = [], 0, 0
        while i < len(a):
            out.append((a[i][0], b[j][0]))
            x, y = a[i][1], b[j][1]
            i += x <= y
            j += y <= x
        return out

    def groups(self, text):
        a, b = self.tokens(text)
        both = {e for _, e in a} & {e for _, e in b}
        out = []
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, e in tokens:
                if at == len(out):
                    out.append(([], []))
                out[at][side].append(str(i))
                at += e in both
        return ";".join(",".join(x) + "|" + ",".join(y) for x, y in out), len(out)

    def rows(self, docs):
        count = Counter(p for _, t in docs for p in set(self.links(t)))
        most = defaultdict(int)
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        for i, t in docs:
            a, b = self.tokens(t)
            links, (spelt, n) = self.links(t), self.groups(t)
            yield (i, len(a), len(b), n, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                   hashlib.sha256(spelt.encode()).hexdigest() if a else "")


@pytest.fixture(scope="module")
def brute():
    return Brute()


ODD = ["a", "The ", "é", "<|endoftext|>", "<s>", "▁", " ", "  ", "\n", "\t", "中", "😀", "ﬁ", "́", "don't", "1234", "\x00", "<0x41>", "..."]
COLUMNS = ["doc_id", *align.MEASURES, "groups_sha256"]


def picked(found):
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


def test_white_space_around_blanks(brute):
    with open(BYTE_LEVEL, encoding="utf-8") as f, open(PIECES, "rb") as g:
        pair = align.Pair(f.read(), g.read())
    parts = ["a", "b.", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "▁", "é", "中", "'s"]
    dice = random.Random(3)
    texts = ["".join(dice.choices(parts, k=dice.randrange(1, 8))) for _ in range(6000)]
    place, edges = align.stretched(pair, pa.array(texts))
    known = pair.known
    for i, t in enumerate(texts):
        mine = place[edges[i] : edges[i + 1]]
        whole = bool((known.n_groups[mine] > 0).all())
        a, b = brute.tokens(t)
        assert (int(known.n_a[mine].sum()), int(known.n_b[mine].sum())) == (len(a), len(b)) if whole else not a, repr(t)
        body = b"".join(known.spelt[known.spelt_bounds[p] : known.spelt_bounds[p + 1]].tobytes() for p in mine)
        assert not whole or body[:-1].decode() == brute.groups(t)[0]


@pytest.mark.parametrize("size", [align.SLICE_BYTES, 60])
def test_alignments_equal_brute_force(spark, brute, mixed_texts, monkeypatch, size):
    monkeypatch.setattr(align, "SLICE_BYTES", size)
    dice = random.Random(1)
    texts = [*mixed_texts, *("".join(dice.choices(ODD, k=dice.randrange(9))) for _ in range(300)), *(["hot text here"] * 50)]
    ids = [None, 4, 4, *range(len(texts) - 3)]
    docs = frame(spark, texts, ids).repartition(3)
    assert picked(align.alignments(docs, BYTE_LEVEL, PIECES)) == sorted(brute.rows(list(zip(ids, texts))), key=str)


@pytest.mark.parametrize("frequent", [1, 3, 10**6])
def test_frequent_texts_are_broadcast(spark, brute, monkeypatch, frequent):
    monkeypatch.setattr("draftweave.llm.frequent.FREQUENT", frequent)
    texts = ["a b"] * 12 + ["b c", "c d", "", None] + ["a  b"] * 3
    docs = list(enumerate(texts))
    assert picked(align.alignments(frame(spark, texts), BYTE_LEVEL, PIECES)) == sorted(brute.rows(docs), key=str)


def test_nothing(spark):
    assert picked(align.alignments(frame(spark, []), BYTE_LEVEL, PIECES)) == []
    assert picked(align.alignments(frame(spark, [None, "", "▁"]), BYTE_LEVEL, PIECES)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(3)]


def test_query_equals_brute_force(spark, brute):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", F.col("text")).collect()]
    assert picked(QUERIES["op11_alignment"](spark, folder)) == sorted(brute.rows(docs), key=str)
