import random

import pytest

#: Columns that a table of documents may carry besides, named like those the operators make.
EXTRA = "row long, kept boolean, n_words long, c0 string, score double, name string, id long, shard int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def frame(spark, texts, ids=None):
    """Documents with clashing extra columns; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", 0 if t is None else len(t), 1, True, 2, "x", 0.5, "n", 7, 3) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed, vocabulary=400):
    dice = random.Random(seed)
    return [f"w{dice.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def mixed_texts():
    """Nulls, empty and blank texts, ties, copies, near copies, long texts and words, and odd characters.

    The last two words differ, but agree in every polynomial hash modulo a power of two.
    """
    alike = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:30], *words(90, 2)]
    return [
        None, "", "  \t\n ", " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far),
        "one two", "One  Two", "one two three four five", "É è ß İ ſ K 中文 😀", " ".join(words(9000, 3)), "a" * 5000,
        " ".join(["same"] * 300), " ".join(["same"] * 200), "\x00\x1f\x7f", None, "",
        alike, alike.translate(str.maketrans("ab", "ba")),
    ]
