"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round *i* every shingle falls into one
bin at random and offers a value in ``[i, i + 1)``; a bin keeps its smallest
offer. Texts with bins still empty play further rounds, and in the last
``BINS`` rounds all shingles aim at one bin each, so after ``2 * BINS`` rounds
every coordinate is filled. Two sketches agree in a coordinate with a chance of
their sets' similarity, with the concentration of independent hashing.

A few coordinates make a band. Texts that share a band are compared by
their sketches first; whoever agrees in too few coordinates is no candidate.
Both counts follow from the limit (``cuts``): at 0.85 bands are of 4, and a
link escapes all of them with a chance of 2e-8, and the sketch comparison with
about 1.6e-8. Candidates make clusters, and inside each cluster links are
confirmed on the full shingle sets.

Texts with equal sets are one node from the start, so copies cost nothing.
Large buckets and clusters are cut into tiles of bounded size; a task walks a
tile breadth first and compares what it has reached with what it hasn't, and
reports a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm.components import connected_components
from draftweave.llm.storage import stored
from draftweave.llm.words import UNSPACED, Words, mixed, shards, text_bytes

SHINGLE = 5
#: ``MISS`` bounds the chance that a link at the limit escapes the bands, and likewise the sketches.
BINS, ROWS, MISS = 96, 4, 2.1e-8
#: A link: 100 * intersection >= percent * union; this is the percentage unless another is given.
PERCENT = 85

#: Members of a bucket, and shingles of a cluster, in half a tile.
TILE_MEMBERS, TILE_SHINGLES = 2048, 1 << 20

_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(percent: int) -> tuple[int, int]:
    """Coordinates of a band, and of a sketch that have to agree, for links of ``percent`` and more."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, got {percent}")
    p = percent / 100
    rows = next((r for r in range(ROWS, 1, -1) if (1 - p**r) ** (BINS // r) <= MISS), 1)
    missed, agree = 0.0, 0
    while agree < BINS:
        missed += math.comb(BINS, agree) * p**agree * (1 - p) ** (BINS - agree)
        if missed > MISS:
            break
        agree += 1
    return rows, agree


def shingle_sets(found: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct fingerprints of the shingles of each text."""
    prints = found.fingerprints() if len(found.starts) else np.zeros(0, np.uint64)
    n = len(prints)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        total[: n - k] += prints[k:] * _MULTIPLIERS[k]
    total = mixed(total)
    out = []
    for first, count in zip(found.first_word[:-1].tolist(), found.counts.tolist()):
        if count >= size:
            x = np.sort(total[first : first + count - size + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif count:
            few = (prints[first : first + count] * _MULTIPLIERS[8 : 8 + count]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(few + np.array([count], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of coordinates for each set; those of empty sets are all ones."""
    rows = len(sets)
    flat = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
    items = np.concatenate(sets) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(rows), [len(x) for x in sets])
    for i in range(2 * bins):
        if not len(items):
            break
        h = mixed(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        if i < bins:
            at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            at = i - bins
        offer = (np.uint64(i) << np.uint64(56)) | (mixed(h) >> np.uint64(8))
        np.minimum.at(flat, owner * bins + at, offer)
        full = (flat.reshape(rows, bins) != np.iinfo(np.uint64).max).all(axis=1)
        open_ = ~full[owner]
        items, owner = items[open_], owner[open_]
    return flat.reshape(rows, bins)


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = table.shape[1] // rows
    grouped = table[:, : bands * rows].reshape(len(table), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(table), bands)).copy()
    for k in range(rows):
        total = mixed(total + grouped[:, :, k])
    return total.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _sketched(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    for part in shards(batches, "text"):
        found = Words(*text_bytes(part.column(2)), UNSPACED)
        sets = shingle_sets(found)
        size = np.array([len(x) for x in sets], np.int64)
        table = sketches(sets)
        keys = band_keys(table, band)[size > 0]
        a = np.array([mixed(x).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
        b = np.array([mixed(x ^ _MULTIPLIERS[7]).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
        coarse = (mixed(table) & np.uint64(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(size), pa.array(a), pa.array(b),
             _lists(keys.ravel(), np.where(size > 0, BINS // band, 0), pa.int64()),
             pa.array([x.tobytes() for x in coarse], pa.binary())],
            names=["doc_id", "row", "n_shingles", "a", "b", "bands", "sketch"],
        )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by ``keys``, in pieces of whole groups, with the groups' bounds."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            x = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
        rest = batch.slice(starts[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def walked(size: int, linked) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of ``size`` nodes; ``linked(u, others)`` tells which of ``others`` node ``u`` links with."""
    left = np.arange(size)
    froms, tos = [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = linked(u, left)
            new = left[hit]
            froms += [u] * len(new)
            tos += new.tolist()
            queue += new.tolist()
            left = left[~hit]
    return np.array(froms, np.int64), np.array(tos, np.int64)


def _bucket_links(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    for piece, starts in _runs(batches, ["key", "low", "high"]):
        ids = piece.column(piece.schema.get_field_index("id")).to_numpy()
        raw = piece.column(piece.schema.get_field_index("sketch"))
        table = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(ids), -1)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        good = (table[two] == table[two + 1]).sum(axis=1) >= agree
        found = [(ids[two[good]], ids[two[good] + 1])]
        for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            mine = table[s : s + n]
            x, y = walked(n, lambda u, others, mine=mine: (mine[others] == mine[u]).sum(axis=1) >= agree)
            found.append((ids[s + x], ids[s + y]))
        yield _edges(found)


def confirmed(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among these sets."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, names, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set alone is in no intersection, so a set with too many of them has no link.
    shared = often[names] > 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    possible = np.bincount(owner[shared], minlength=len(sets))
    live = np.flatnonzero(100 * possible >= percent * sizes)
    names, owner = names[shared], owner[shared]
    bounds = np.concatenate([[0], np.cumsum(possible)])
    mask = np.zeros(len(often), bool)

    def linked(u: int, others: np.ndarray) -> np.ndarray:
        u, others = live[u], live[others]
        n, m = sizes[u], sizes[others]
        hit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (100 * np.minimum(possible[u], possible[others]) >= percent * np.maximum(n, m))
        near = others[hit]
        if len(near):
            mine = names[bounds[u] : bounds[u + 1]]
            mask[mine] = True
            lengths = possible[near]
            at = np.repeat(bounds[near] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            common = np.bincount(np.repeat(np.arange(len(near)), lengths), weights=mask[names[at]], minlength=len(near)).astype(np.int64)
            mask[mine] = False
            hit[hit] = 100 * common >= percent * (n + sizes[near] - common)
        return hit

    x, y = walked(len(live), linked)
    return live[x], live[y]


def _cluster_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for piece, starts in _runs(batches, ["cluster", "low", "high"]):
        ids = piece.column(piece.schema.get_field_index("id")).to_numpy()
        text = piece.column(piece.schema.get_field_index("text"))
        found = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s < 2:
                continue
            sets = []
            for part in shards(iter([pa.RecordBatch.from_arrays([text.slice(s, e - s)], names=["text"])]), "text"):
                sets += shingle_sets(Words(*text_bytes(part.column(0)), UNSPACED))
            x, y = confirmed(sets, percent)
            found.append((ids[s + x], ids[s + y]))
        yield _edges(found)


def _tiled(frame: DataFrame, key: str, halves) -> DataFrame:
    """Rows of each key in tiles ``(low, high)``, so that any two rows of a key share a tile.

    A key of one half is one tile. With more halves, each row goes to as many
    tiles as its key has halves.
    """
    mine = F.pmod(F.xxhash64("id"), F.col("halves")).cast("int")
    return (
        frame.withColumn("halves", halves).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("halves") - 1)))
        .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
        .drop("halves", "mine", "other")
    )


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Near-duplicate group of every row: ``doc_id, row, n_shingles, component_id, kept``.

    Words are split at blanks and 0x09-0x0D after lowering A-Z. A text's set
    holds its distinct shingles of five words, or its whole sequence where it
    has fewer; texts link when ``100 * intersection >= percent * union``.
    ``component_id`` is the smallest ``doc_id`` reachable over links, and
    ``kept`` marks the rows that carry it. ``row`` is a fingerprint of the
    text that tells apart rows of equal ``doc_id``.

    Null, empty and blank texts have no shingles, link with nothing and keep
    themselves. Rows of one ``doc_id`` share the kept mark when they are in
    one component. Null ids rank last: ``component_id`` is null only where all
    ids of a component are, and such rows are kept. Empty tables give no rows.
    Texts of any length are compared by their full sets; a worker's memory
    grows with the longest text. Other columns are not looked at.
    """
    band, agree = cuts(percent)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = stored(base.mapInArrow(
        lambda batches: _sketched(batches, band), f"doc_id {kind}, row long, n_shingles long, a long, b long, bands array<long>, sketch binary"))
    whole = ["a", "b", "n_shingles"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    nodes = stored(
        rows.filter("n_shingles > 0").groupBy(*whole)
        .agg(F.min(place).alias("place"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    each = nodes.select("id", F.explode("bands").alias("key"))
    # Buckets with the same members need one look.
    buckets = (
        each.groupBy("key").agg(F.count("id").alias("n"), F.min("id").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"))
        .filter("n > 1").groupBy("n", "m", "x").agg(F.min("key").alias("key")).select("key", "n")
    )
    members = stored(each.join(buckets, "key"))
    halves = F.ceil(F.col("n") / TILE_MEMBERS).cast("int")
    tiles = _tiled(members.join(nodes.select("id", "sketch"), "id"), "key", halves).select("key", "low", "high", "id", "sketch")
    candidates = (
        tiles.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")
        .mapInArrow(lambda batches: _bucket_links(batches, agree), "a long, b long")
    )
    clusters = connected_components(candidates).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    placed = stored(nodes.select("id", "place", "n_shingles").join(clusters, "id"))
    sized = stored(placed.groupBy("cluster").agg(F.sum("n_shingles").alias("n")))
    wanted = placed.join(sized, "cluster").select(
        F.col("place.doc_id").alias("_doc"), F.col("place.row").alias("_row"), "id", "cluster", "n")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
    texts = base.join(wanted, same).select("cluster", "id", "n", "text")
    halves = F.ceil(F.col("n") / TILE_SHINGLES).cast("int")
    tiles = _tiled(texts, "cluster", halves).select("cluster", "low", "high", "id", "text")
    links = (
        tiles.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")
        .mapInArrow(lambda batches: _cluster_links(batches, percent), "a long, b long")
    )
    joined = connected_components(links).select(F.col("node").alias("id"), "component")
    member = nodes.select(*whole, "id", "place").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = stored(member)
    least = stored(member.groupBy("component").agg(F.min("place").alias("first")))
    found = stored(member.join(least, "component").select(*whole, F.col("first.doc_id").alias("component_id")))
    linked = rows.join(found, whole).select("doc_id", "row", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged; cases as in ``components``.

    Rows without shingles all stay; of repeated rows that are kept, all stay.
    """
    stay = components(docs, doc_id, text, percent).filter("kept").select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).distinct()
    names = docs.columns
    moved = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, body = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}")
    same = key.eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("_row"))
    return moved.join(stored(stay), same, "left_semi").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
