"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Texts are encoded and cut only where they are longer than a sequence. Whole
sequences are done; the other pieces are spread over blocks of about
``BLOCK_PIECES`` by a hash, and each block is packed by ``ISLANDS`` separate
populations. An individual is a set of bins. A crossover injects whole
well-filled bins of one parent into the other, takes out the bins there that
hold an injected piece, and puts the pieces so displaced where they fit best.
Between epochs the best individual of each island moves on to the next one,
and at the end the best of a block's islands is its packing.

A task holds one block of one island: some thousand lengths.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm import tokens
from draftweave.llm.storage import stored

LIMIT = 2048
BLOCK_PIECES, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 3, 2, 4, 6


class Bins:
    """Open bins by free room; the fullest bin with room enough is found by a bit mask."""

    def __init__(self, limit: int):
        self.limit = limit
        self.by_room: dict[int, list[list[int]]] = {}
        self.mask = 0

    def put(self, members: list[int], room: int) -> None:
        self.by_room.setdefault(room, []).append(members)
        self.mask |= 1 << room

    def best_fit(self, piece: int, length: int) -> None:
        fitting = self.mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            held = self.by_room[room]
            members = held.pop()
            if not held:
                self.mask &= ~(1 << room)
            members.append(piece)
            self.put(members, room - length)
        else:
            self.put([piece], self.limit - length)

    def all(self) -> list[list[int]]:
        return [m for held in self.by_room.values() for m in held]


def filled(bins: list[list[int]], lengths: list[int]) -> list[int]:
    return [sum(map(lengths.__getitem__, b)) for b in bins]


def fitness(bins: list[list[int]], lengths: list[int], limit: int) -> tuple[int, float]:
    """Number of bins, then how unevenly they are filled (more negative is better)."""
    return len(bins), -sum((f / limit) ** 2 for f in filled(bins, lengths))


def best_fit_decreasing(lengths: list[int], limit: int, shaken: random.Random | None = None) -> list[list[int]]:
    order = range(len(lengths))
    key = (lambda i: -lengths[i]) if shaken is None else (lambda i: -lengths[i] * shaken.uniform(0.7, 1.3))
    bins = Bins(limit)
    for i in sorted(order, key=key):
        bins.best_fit(i, lengths[i])
    return bins.all()


def crossover(giver: list[list[int]], taker: list[list[int]], lengths: list[int], limit: int, dice: random.Random) -> list[list[int]]:
    full = filled(giver, lengths)
    best = sorted(range(len(giver)), key=lambda i: -full[i])[: max(1, len(giver) // 2)]
    injected = [giver[i] for i in best if dice.random() < 0.5] or [giver[best[0]]]
    inside = {i for b in injected for i in b}
    bins, displaced = Bins(limit), []
    for members in injected:
        bins.put(list(members), limit - sum(map(lengths.__getitem__, members)))
    for members in taker:
        if inside.isdisjoint(members):
            bins.put(list(members), limit - sum(map(lengths.__getitem__, members)))
        else:
            displaced += [i for i in members if i not in inside]
    for i in sorted(displaced, key=lambda i: -lengths[i]):
        bins.best_fit(i, lengths[i])
    return bins.all()


def mutated(bins: list[list[int]], lengths: list[int], limit: int, dice: random.Random) -> list[list[int]]:
    """Dissolve the emptiest bins and a few others, and place their pieces anew."""
    full = filled(bins, lengths)
    order = sorted(range(len(bins)), key=lambda i: full[i])
    gone = {*order[: max(1, len(bins) // 50)], *dice.sample(order, max(1, len(bins) // 50))}
    kept = Bins(limit)
    for i, members in enumerate(bins):
        if i not in gone:
            kept.put(list(members), limit - full[i])
    loose = [i for g in gone for i in bins[g]]
    for i in sorted(loose, key=lambda i: -lengths[i] * dice.uniform(0.9, 1.1)):
        kept.best_fit(i, lengths[i])
    return kept.all()


def evolved(lengths: list[int], limit: int, seed: int, elites: list[list[list[int]]], population: int = POPULATION,
            generations: int = GENERATIONS) -> list[list[int]]:
    """The best individual after some generations; elites take part from the start."""
    dice = random.Random(seed)
    fewest = -(-sum(lengths) // limit)
    people = list(elites) or [best_fit_decreasing(lengths, limit)]
    ranked = sorted((fitness(p, lengths, limit), n, p) for n, p in enumerate(people))
    if ranked[0][0][0] <= fewest:
        return ranked[0][2]
    while len(people) < population:
        people.append(best_fit_decreasing(lengths, limit, dice))
    ranked = sorted((fitness(p, lengths, limit), n, p) for n, p in enumerate(people))
    serial = len(people)
    for _ in range(generations):
        for _ in range(population):
            a, b = dice.sample(ranked[: max(2, population // 2)], 1)[0], dice.choice(ranked)
            child = crossover(a[2], b[2], lengths, limit, dice)
            if dice.random() < 0.5:
                child = mutated(child, lengths, limit, dice)
            serial += 1
            ranked.append((fitness(child, lengths, limit), serial, child))
        ranked = sorted(ranked)[:population]
        if ranked[0][0][0] <= fewest:
            break
    return ranked[0][2]


def pieces(docs: DataFrame, vocabulary: str, end: int, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``item, doc_id, piece, start, length, ids_crc32`` of every piece of every row."""
    shared = tokens.vocabulary(docs.sparkSession, vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 36
        for part, ids, bounds in tokens.encoded(batches, "text", shared, end):
            raw = ids.astype("<u4").tobytes()
            sizes = np.diff(bounds)
            counts = -(-sizes // limit)
            owner = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * limit
            length = np.minimum(limit, sizes[owner] - start)
            at = 4 * (bounds[:-1][owner] + start)
            sums = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item + np.arange(len(owner))), part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()),
                 pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                names=["item", "doc_id", "piece", "start", "length", "ids_crc32"],
            )
            item += len(owner)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"item long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _bins_of(plan: bytes) -> list[list[int]]:
    at = np.frombuffer(plan, np.int32)
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)]


def _plan_of(bins: list[list[int]], size: int) -> bytes:
    at = np.zeros(size, np.int32)
    for n, members in enumerate(bins):
        at[members] = n
    return at.tobytes()


def pack(
    docs: DataFrame, vocabulary: str, end: int, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
    block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS,
) -> DataFrame:
    """Sequences of at most ``limit`` ids that hold every row of ``docs``, a row for each piece.

    Columns: ``doc_id, piece`` (from 0), ``start`` (ids of its document before
    it), ``length, ids_crc32, sequence_id, offset`` (its place there, gapless
    from 0). Only texts of more than ``limit`` ids, the end id included, are
    cut. Null and empty texts are one piece of the end id. Null ids and
    repeated rows are packed like any others; an empty table gives no rows;
    other columns are not looked at. A very long text fills sequences of its
    own but for its last piece.
    """
    every = stored(pieces(docs, vocabulary, end, limit, doc_id, text))
    loose = every.filter(F.col("length") < limit)
    blocks = max(1, -(-loose.count() // block_pieces))
    loose = loose.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"))
    on_islands = loose.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    schema = "block int, island int, bins int, uneven double, plan binary"

    def sorted_lengths(items: pa.Table) -> tuple[pa.Table, list[int]]:
        items = items.sort_by([("length", "descending"), ("item", "ascending")])
        return items, items.column("length").to_pylist()

    def epoch(number: int):
        def run(key, items: pa.Table, elites: pa.Table) -> pa.Table:
            block, island = (x.as_py() for x in key)
            _, lengths = sorted_lengths(items)
            best = evolved(lengths, limit, (number * islands + island) * 1_000_003 + block, [_bins_of(x) for x in elites.column("plan").to_pylist()])
            n, uneven = fitness(best, lengths, limit)
            return pa.table({"block": pa.array([block], pa.int32()), "island": pa.array([island], pa.int32()), "bins": pa.array([n], pa.int32()),
                             "uneven": [uneven], "plan": pa.array([_plan_of(best, len(lengths))], pa.binary())})

        return run

    elites = docs.sparkSession.createDataFrame([], schema)
    for number in range(epochs):
        best = stored(on_islands.groupBy("block", "island").cogroup(elites.groupBy("block", "island")).applyInArrow(epoch(number), schema))
        elites = best.unionByName(best.withColumn("island", ((F.col("island") + 1) % islands).cast("int")))
    chosen = best.groupBy("block").agg(F.min_by("plan", F.struct("bins", "uneven", "island")).alias("plan"))

    def placed(key, items: pa.Table, plans: pa.Table) -> pa.Table:
        items, lengths = sorted_lengths(items)
        at, offset = np.frombuffer(plans.column("plan")[0].as_py(), np.int32), np.zeros(len(lengths), np.int64)
        room: dict[int, int] = {}
        for i, b in enumerate(at.tolist()):
            offset[i] = room.get(b, 0)
            room[b] = room.get(b, 0) + lengths[i]
        return pa.table({"item": items.column("item"), "sequence_id": (np.int64(key[0].as_py()) << np.int64(32)) + at, "offset": offset})

    found = loose.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(placed, "item long, sequence_id long, offset long")
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = every.filter(F.col("length") == limit).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return every.join(found, "item").select(*shown).unionByName(whole.select(*shown))
