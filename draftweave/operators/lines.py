"""Text rows, gaps and cells of page words, worked out inside tasks.

Spark deals the words by image and sorts them by a hash of it; each task then
goes through its images in Arrow batches, several images at a time. Windows
would sort the same words once for each of rows, gaps, thresholds and cells.
Images above ``IMAGE_WORDS`` words do not come here: ``tables`` spreads them
over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

IMAGE = ["doc_id", "page_id", "region_id"]
EDGES = ["left", "top", "right", "bottom"]

#: Words of one image that a task holds at once.
IMAGE_WORDS = 250_000

# Fixed values.
ROW_TOLERANCE = 10
DEFAULT_GAP = 25.0
GAP_SAMPLE = 3
GAP_RATIO = 1.3


@dataclass(frozen=True)
class Layout:
    """Words of whole images in reading order, row by row.

    ``order`` takes words to that order; ``images``, ``lines`` and ``cells``
    hold the first place of each. ``gapped`` are the images with a gap above 0.
    """

    order: np.ndarray
    images: np.ndarray
    lines: np.ndarray
    cells: np.ndarray
    gap: np.ndarray
    threshold: np.ndarray
    gapped: np.ndarray


def layout(
    images: np.ndarray, centre: np.ndarray, left: np.ndarray, right: np.ndarray, ordinal: np.ndarray | None = None
) -> Layout:
    """Rows (W-06), gaps (W-04), thresholds (A-12) and cells (W-05) of words that lie image by image.

    Without an ordinal the words of each image are in order of left edge, centre and ordinal.
    """
    image = np.repeat(np.arange(len(images)), np.diff(np.append(images, len(centre))))
    line = _line_of(image, centre)
    if ordinal is None:
        order = np.argsort(line, kind="stable")
    else:
        order = np.lexsort((ordinal, centre, np.where(np.isnan(left), -np.inf, left), line))
    line = line[order]
    same = line[1:] == line[:-1]
    gap = np.full(len(order), np.nan)
    gap[1:][same] = (left[order][1:] - right[order][:-1])[same]
    threshold, gapped = _thresholds(image, gap, len(images))
    starts = np.append(True, ~same)
    cells = np.flatnonzero(starts | (gap > threshold[image]))
    return Layout(order, images, np.flatnonzero(starts), cells, gap, threshold, gapped)


def _line_of(image: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Number of the row of each word, ascending by image and height."""
    order = np.lexsort((centre, image))
    at, of = centre[order], image[order]
    fresh = np.ones(len(at), bool)
    with np.errstate(invalid="ignore"):
        fresh[1:] = (of[1:] != of[:-1]) | ~(at[1:] - at[:-1] <= ROW_TOLERANCE)
        first = np.flatnonzero(fresh)
        end = np.append(first[1:], len(at))
        tall = np.flatnonzero(at[end - 1] - at[first] > ROW_TOLERANCE)
    # A run no taller than the tolerance is one row: the mean stays within it.
    for a, b in zip(first[tall], end[tall]):
        values, places, counts = np.unique(at[a:b], return_index=True, return_counts=True)
        fresh[a + places] = _folded(values.tolist(), counts.tolist())
    line = np.empty(len(at), np.int64)
    line[order] = np.cumsum(fresh) - 1
    return line


def _folded(centres: list[float], counts: list[int]) -> list[bool]:
    """Whether each centre of a run starts a row, by the running mean."""
    starts, total, n = [], 0.0, 0
    for centre, k in zip(centres, counts):
        starts.append(n == 0 or abs(centre - total / n) > ROW_TOLERANCE)
        total, n = (0.0, 0) if starts[-1] else (total, n)
        total, n = total + centre * k, n + k
    return starts


def _thresholds(image: np.ndarray, gap: np.ndarray, images: int) -> tuple[np.ndarray, np.ndarray]:
    """Gap that separates the cells of each image, and the images that have gaps.

    The widest ratio between neighbouring distinct gaps marks the border, the
    smaller gap in a tie.
    """
    threshold = np.full(images, DEFAULT_GAP)
    wide = np.flatnonzero(gap > 0)
    if not len(wide):
        return threshold, wide
    order = np.lexsort((gap[wide], image[wide]))
    of, by = image[wide][order], gap[wide][order]
    n = np.bincount(of, minlength=images)
    distinct = np.append(True, (of[1:] != of[:-1]) | (by[1:] != by[:-1]))
    of, by = of[distinct], by[distinct]
    same = of[1:] == of[:-1]
    ratio = np.append(np.where(same, by[1:] / np.maximum(by[:-1], 1.0), 0.0), 0.0)
    middle = np.append((by[:-1] + by[1:]) / 2.0, 0.0)
    best = np.lexsort((by, -ratio, of))[np.flatnonzero(np.append(True, ~same))]
    gapped = of[best]
    usable = (n[gapped] >= GAP_SAMPLE) & (ratio[best] >= GAP_RATIO)
    threshold[gapped] = np.where(usable, middle[best], DEFAULT_GAP)
    return threshold, gapped


# --- batches -------------------------------------------------------------------


def _codes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Numbers of the distinct values of a column; null is a value like any other."""
    return batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Places where any column changes."""
    return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1


def _whole_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold whole images."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column("_image").to_numpy(zero_copy_only=False)
        changes = _changes([hashes])
        if len(changes):
            cut = int(changes[-1])
        elif held and held[-1].column("_image")[-1].as_py() != hashes[0]:
            cut = 0
        else:
            held.append(batch)
            continue
        yield _joined([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _numbers(column: pa.Array, missing: float = np.nan) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), missing).to_numpy(zero_copy_only=False)


def _values(numbers: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Numbers in the type of their column; NaN is null."""
    return pa.array(numbers, from_pandas=True).cast(kind)


def _together(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch with the rows of each image together, and the first row of each."""
    keys = [_codes(batch, name) for name in IMAGE]
    changes = _changes(keys)
    if len(changes) != len(_changes([batch.column("_image").to_numpy(zero_copy_only=False)])):
        # Images of one hash lie mixed.
        together = np.lexsort(keys)
        batch, changes = batch.take(pa.array(together)), _changes([k[together] for k in keys])
    return batch, np.append(0, changes).astype(np.int64)


def _wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Words of the images with a mark, a row without text (see ``lines``)."""
    batch, starts = _together(batch)
    mark = batch.column("text").is_null().to_numpy(zero_copy_only=False)
    marked = np.logical_or.reduceat(mark, starts)
    kept = np.repeat(marked, np.diff(np.append(starts, len(mark)))) & ~mark
    return batch.filter(pa.array(kept))


def _read(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, Layout]:
    """The batch with the words of each image together, and their layout."""
    batch, starts = _together(batch)
    ordinal = None
    if "_ord" in batch.schema.names:
        least = np.iinfo(np.int64).min
        ordinal = pc.fill_null(batch.column("_ord"), least).to_numpy(zero_copy_only=False)
    # Without a height a word stands alone, before all others.
    return batch, layout(
        starts, _numbers(batch.column("centre"), -np.inf),
        _numbers(batch.column("left")), _numbers(batch.column("right")), ordinal,
    )


def _within(starts: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Position of each start among those of the same outer start, from 0."""
    group = np.searchsorted(outer, starts, side="right") - 1
    return np.arange(len(starts)) - np.searchsorted(starts, outer)[group]


def _offsets(starts: np.ndarray, outer: np.ndarray) -> pa.Array:
    return pa.array(np.append(np.searchsorted(starts, outer), len(starts)), pa.int32())


def _lines(batch: pa.RecordBatch, schema: pa.Schema) -> list[pa.Array]:
    """One row an image: its rows, each with its cells."""
    batch, found = _read(batch)
    cell = schema.field("lines").type.value_type.field("cells").type.value_type
    texts = batch.column("text").take(pa.array(found.order)).cast(pa.string())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(found.cells, len(found.order)), pa.int32()), texts), " ")
    parts = [pa.array(_within(found.cells, found.lines), pa.int32()), joined]
    for name in EDGES[:cell.num_fields - 2]:
        least = np.fmin if name in ("left", "top") else np.fmax
        parts.append(_values(least.reduceat(_numbers(batch.column(name))[found.order], found.cells), cell.field(name).type))
    cells = pa.ListArray.from_arrays(_offsets(found.cells, found.lines), pa.StructArray.from_arrays(parts, fields=list(cell)))
    number = pa.array(_within(found.lines, found.images) + 1, pa.int32())
    line = schema.field("lines").type.value_type
    lines = pa.ListArray.from_arrays(
        _offsets(found.lines, found.images), pa.StructArray.from_arrays([number, cells], fields=list(line)))
    at = pa.array(found.images)
    return [*[batch.column(name).take(at) for name in IMAGE], lines.cast(schema.field("lines").type)]


def _gaps(batch: pa.RecordBatch, schema: pa.Schema) -> list[pa.Array]:
    """One row a word that has a word before it in its row."""
    batch, found = _read(batch)
    of = np.searchsorted(found.lines, np.arange(len(found.order)), side="right") - 1
    kept = np.flatnonzero(~np.isnan(found.gap))
    at = pa.array(found.order[kept])
    number = (_within(found.lines, found.images) + 1)[of[kept]]
    return [*[batch.column(name).take(at) for name in IMAGE], pa.array(number, pa.int32()), batch.column("left").take(at),
            batch.column("word_ord").take(at), _values(found.gap[kept], schema.field("gap").type)]


def _limits(batch: pa.RecordBatch, schema: pa.Schema) -> list[pa.Array]:
    """One row an image that has a gap."""
    batch, found = _read(batch)
    at = pa.array(found.images[found.gapped])
    return [*[batch.column(name).take(at) for name in IMAGE], pa.array(found.threshold[found.gapped])]


# --- frames ----------------------------------------------------------------------


def _mapped(
    words: DataFrame, columns: list[str], out: list[T.StructField], work: Callable, marks: DataFrame | None = None
) -> DataFrame:
    whole = isinstance(words.schema["word_ord"].dataType, T.IntegralType)
    rows = words.select(
        *IMAGE, F.xxhash64(*IMAGE).alias("_image"), "left", (F.col("left") + F.col("width")).alias("right"),
        (F.col("top") + F.col("height") / 2).cast("double").alias("centre"),
        *[edge.alias(n) for n, edge in (("top", F.col("top")), ("bottom", F.col("top") + F.col("height"))) if n in columns],
        *[n for n in ("text", "word_ord") if n in columns],
        F.col("word_ord").cast("bigint").alias("_ord") if whole else F.col("word_ord").alias("_ord"),
    )
    if marks is not None:
        rows = rows.unionByName(marks.select(*IMAGE, F.xxhash64(*IMAGE).alias("_image")), allowMissingColumns=True)
    rows = rows.repartition("_image")
    # One number sorts fastest; an ordinal of several parts is ordered by Spark as well.
    dealt = rows.sortWithinPartitions("_image") if whole else rows.sortWithinPartitions("_image", "left", "centre", "_ord").drop("_ord")
    schema = T.StructType([T.StructField(n, words.schema[n].dataType) for n in IMAGE] + out)
    arrow = to_arrow_schema(schema)
    marked = marks is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_images(batches):
            if marked:
                batch = _wanted(batch)
                if not batch.num_rows:
                    continue
            yield pa.RecordBatch.from_arrays(work(batch, arrow), schema=arrow)

    return dealt.mapInArrow(run, schema)


def lines(words: DataFrame, boxed: bool = True, marks: DataFrame | None = None) -> DataFrame:
    """``lines`` of every image: ``row_no`` and ``cells`` with number, text and, if ``boxed``, box.

    ``marks`` names the images wanted, in the types of the words' keys; null
    means all. Marks travel with the words, so that choosing images takes no
    join, which would deal and sort the words once more; words must have a text.
    """
    edges = EDGES if boxed else []
    kind = {n: words.schema[n].dataType for n in ("left", "top")}
    kind |= {n: words.select((F.col(a) + F.col(b)).alias("e")).schema["e"].dataType for n, a, b in (("right", "left", "width"), ("bottom", "top", "height"))}
    cell = T.StructType([T.StructField("cell_no", T.IntegerType()), T.StructField("text", T.StringType()),
                         *[T.StructField(n, kind[n]) for n in edges]])
    line = T.StructType([T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(cell))])
    return _mapped(words, ["text", *edges], [T.StructField("lines", T.ArrayType(line))], _lines, marks)


def gaps(words: DataFrame) -> DataFrame:
    """``row_no, left, word_ord, gap`` of every word with one before it in its row."""
    kind = words.select((F.col("left") - (F.col("left") + F.col("width"))).alias("gap")).schema["gap"].dataType
    out = [T.StructField("row_no", T.IntegerType()), T.StructField("left", words.schema["left"].dataType),
           T.StructField("word_ord", words.schema["word_ord"].dataType), T.StructField("gap", kind)]
    return _mapped(words, ["word_ord"], out, _gaps)


def thresholds(words: DataFrame) -> DataFrame:
    """``threshold`` of every image with a gap."""
    return _mapped(words, [], [T.StructField("threshold", T.DoubleType())], _limits)
