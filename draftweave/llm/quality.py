"""Quality scores from compression with two dictionaries.

One Zstandard dictionary is built from good and one from bad labelled text. A
text is compressed block by block with each; the difference of the two sizes
over their sum says which dictionary knows it better. A logistic curve over
that difference, the sizes for each byte and the size without a dictionary
turns it into a probability, calibrated on labelled rows that the dictionaries
have not seen.

Only fitting uses a sample: ``DICTIONARY_ROWS`` rows a class with at most
``BLOCKS_OF_ROW`` blocks each, and ``CALIBRATION_ROWS`` rows. Every text is
scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.llm.words import shards, text_bytes

#: Bounds of the samples that fitting uses.
DICTIONARY_ROWS, BLOCKS_OF_ROW, CALIBRATION_ROWS = 3000, 8, 8000

BLOCK_BYTES, DICTIONARY_BYTES, LEVEL = 512, 64 << 10, 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries and curve; without both classes of labels, a constant score."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows kept out of learning; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return [*out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)]


def sizes(text: bytes, by: list[zstandard.ZstdCompressor]) -> tuple[int, int, int, int]:
    """Compressed size with the good and the bad dictionary, without one, and the plain size."""
    good, bad, none = by
    a = b = 0
    for at in range(0, max(1, len(text)), BLOCK_BYTES):
        block = text[at : at + BLOCK_BYTES]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return a, b, len(none.compress(text)), len(text)


def features(rows: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The normalised difference, and logarithms of the sizes a byte and of the length."""
    x = np.array(rows, float).reshape(-1, 4)
    a, b, c, n = x.T
    m = np.maximum(1, n)
    return np.stack([(b - a) / (a + b), np.log(a / m), np.log(b / m), np.log(c / m), np.log1p(n)], axis=1)


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, pull = np.zeros(z.shape[1]), ridge * len(x) * np.eye(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + pull, z.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, spread, w


def _drawn(most: int | None):
    """Evenly spread blocks of each sampled text, ``most`` of them or all."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shards(batches, "text"):
            data, offsets = text_bytes(part.column(1))
            labels, blocks = [], []
            for y, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                starts = range(a, b, BLOCK_BYTES)
                for s in starts[:: math.ceil(len(starts) / (most or max(1, len(starts)))) or 1]:
                    labels.append(y)
                    blocks.append(data[s : min(b, s + BLOCK_BYTES)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(blocks, pa.binary())], names=["label", "block"])

    return drawn


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS,
        blocks_of_row: int | None = BLOCKS_OF_ROW) -> Model:
    """Learn from the labelled rows for which ``learn``, a condition on ``doc_id``, holds.

    The sample is the same for the same labels: rows go by a hash of their id.
    Several labels of one id count as their largest; null and other labels
    than 0 and 1 are passed over. Of a sampled id's rows in ``docs``, one is
    drawn, by a hash of its text. Null texts are learnt from as empty ones, and
    of a long text ``blocks_of_row`` evenly spread blocks. With
    ``blocks_of_row=None`` the dictionaries are built from whole sampled texts,
    which then pass the driver whole.
    """
    marked = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
        .filter(learn).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id"))
    )
    first = F.col("h") % 2 == 0

    def top(part: DataFrame, n: int) -> DataFrame:
        return part.orderBy("h", "doc_id").limit(n).select("doc_id", "label")

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = top(marked.filter(first & (F.col("label") == 1)), dictionary_rows).unionByName(top(marked.filter(first & (F.col("label") == 0)), dictionary_rows))
    place = F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")

    def one_each(sample: DataFrame) -> DataFrame:
        """A row for each sampled id, however often ``docs`` repeats it."""
        held = source.join(F.broadcast(sample), "doc_id")
        return held.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), place).alias("row")).select("row.label", "row.text")

    # Both samples have a fixed number of rows at most.
    blocks = one_each(known).mapInArrow(_drawn(blocks_of_row), "label int, block binary").collect()
    # A fixed order without neighbours alike, as the dictionary builder goes through its samples in turn.
    by_class = [sorted((bytes(r.block) for r in blocks if r.label == y), key=lambda x: (zlib.crc32(x), x)) for y in (0, 1)]
    if min(map(len, by_class)) == 0:
        n = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        return Model(b"", b"", (), (), (), (n[1] + 1) / (n[0] + 2))
    bad, good = (_dictionary(x) for x in by_class)
    rest = top(marked.filter(~first), calibration_rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(good, bad)
        for part in shards(batches, "text"):
            found = _sizes(part.column(1), by)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["label", "sizes"])

    rows = one_each(rest).mapInArrow(measured, "label int, sizes array<long>").collect()
    rows.sort(key=lambda r: (r.label, r.sizes))
    if not rows:
        n = len(by_class[1]) / (len(by_class[0]) + len(by_class[1]))
        return Model(b"", b"", (), (), (), n)
    mean, spread, w = fitted(features([tuple(r.sizes) for r in rows]), np.array([r.label for r in rows], float))
    return Model(good, bad, tuple(mean), tuple(spread), tuple(w))


def _dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        # Too little text to train on: the text itself serves as the dictionary.
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b" " * 8


def _sizes(column: pa.Array, by: list[zstandard.ZstdCompressor]) -> list[tuple[int, int, int, int]]:
    data, offsets = text_bytes(column)
    raw, at = data.tobytes(), offsets.tolist()
    return [sizes(raw[a:b], by) for a, b in zip(at, at[1:])]


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row; higher is better.

    Null texts are scored as empty ones; an empty text has a score like any
    other. Repeated rows get equal scores, an empty table gives no rows, and
    other columns stay as they are. Texts of any length are scored over all
    their blocks; a worker's memory grows with the longest text.
    """
    if model.constant is not None:
        return docs.withColumn(score, F.lit(float(model.constant)))
    names = docs.columns
    moved = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    mean, spread, w = (np.array(x) for x in (model.mean, model.spread, model.weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(model.good, model.bad)
        for part in shards(batches, body):
            x = features(_sizes(part.column(part.schema.get_field_index(body)), by))
            p = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / spread) @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, "_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.schema.fields)
    found = moved.mapInArrow(scored, f"{fields}, _score double")
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != score], F.col("_score").alias(score))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns unchanged; cases as in ``with_score``."""
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    kept = with_score(plain, model, f"d{names.index(text)}", "_quality").filter(F.col("_quality") >= threshold)
    return kept.select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(names)])
