"""Splitting groups too large for one task.

A document, page or key may hold a large share of all rows. Operators that
need an order or a lookup within a group ask here first: groups above a row
limit are counted once (the counts combine on the map side), and only those
take a path that spreads one group over many tasks. Everything else keeps the
plain window or join.

The list of large groups has at most ``rows / limit`` entries, which is what
bounds every broadcast made here.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000

#: Bytes of input whose exchange may lie on disk at a time.
SLICE_BYTES = 1 << 30

#: Setting under which a write removes its shuffle files when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hot_rows(spark: SparkSession) -> int:
    """Rows above which a group is split (``spark.draftweave.hotRows``)."""
    return int(spark.conf.get("spark.draftweave.hotRows", str(HOT_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="draftweave-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """Cut lineage in the checkpoint folder shared by the cluster."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``frame`` once as a table in the shared folder and go on from it, columns pruned by each reader.

    A ``path`` is replaced if it is there, and the caller removes it.
    """
    path = path or f"{shared_folder(frame.sparkSession)}/rows-{uuid.uuid4().hex}"
    with shuffles_removed(frame.sparkSession):
        frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the action that made them ends. Write tables in it, keep no lazy rows of it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def slices_of(*frames: DataFrame) -> int:
    """Slices of documents to write one after the other, so that exchanges keep ``spark.draftweave.sliceBytes`` of the inputs on disk at a time.

    Every slice reads the inputs again, so anything but projections of files counts as one.
    """
    total = 0
    for frame in frames:
        nodes = [frame._jdf.queryExecution().optimizedPlan()]
        while nodes:
            node = nodes.pop()
            if node.children().isEmpty() and node.nodeName() == "LogicalRelation":
                total += int(str(node.stats().sizeInBytes()))
            elif node.nodeName() in ("Project", "Filter", "Union"):
                nodes += [node.children().apply(i) for i in range(node.children().size())]
            else:
                return 1
    limit = int(frames[0].sparkSession.conf.get("spark.draftweave.sliceBytes", str(SLICE_BYTES)))
    return max(1, -(-total // limit))


def write_in_slices(frame: DataFrame, by: str, slices: int, write: Callable[[DataFrameWriter, str], None], mode: str) -> None:
    """Write all rows, one slice of the keys after the other; ``_SUCCESS`` comes with the last.

    ``write`` gets the writer of a slice and its mode. A filter by key goes
    below windows, exchanges and aggregates by that key, so a slice deals out
    its own rows only, and its shuffle files go before the next one starts.
    """
    with shuffles_removed(frame.sparkSession):
        for i in range(slices):
            part = frame if slices == 1 else frame.filter(F.pmod(F.xxhash64(by), F.lit(slices)) == i)
            writer = part.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(i == slices - 1).lower())
            write(writer, "append" if i else mode)


def hot_groups(frame: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys of the groups holding more than ``limit`` rows; None when there are none.

    The first key alone is counted first: it is one short column, and where none
    of its groups is large, none within them is.
    """
    limit = hot_rows(frame.sparkSession) if limit is None else limit
    if len(by) > 1:
        wide = hot_groups(frame, by[:1], limit)
        if wide is None:
            return None
        frame = hot_part(frame, wide, by[:1])
    hot = frame.groupBy(*by).count().filter(F.col("count") > limit).select(*by)
    return None if hot.isEmpty() else hot


def _named(frame: DataFrame, hot: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys that may be null: a null key is a group like any other."""
    keys = F.broadcast(hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on]))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_hot_{c}"))
    return frame.join(keys, same, how)


def cold_part(frame: DataFrame, hot: DataFrame | None, on: Sequence[str]) -> DataFrame:
    return frame if hot is None else _named(frame, hot, on, "left_anti")


def hot_part(frame: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    return _named(frame, hot, on, "left_semi")


def ranked(
    frame: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row within its group under a unique order."""
    plain = F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint")
    if hot is None:
        return frame.withColumn(name, plain)
    cold = cold_part(frame, hot, by).withColumn(name, plain)
    return cold.unionByName(ranked_by_range(hot_part(frame, hot, by), by, order, name))


def ranked_by_range(frame: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Positions from a range-partitioned sort: one group spans many tasks.

    Range bounds are sampled, so the partition numbers are fixed by a
    checkpoint before they are counted. A boundary cuts at most one group, so
    the table of offsets has at most ``groups + partitions`` rows.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        frame.repartitionByRange(parts, *by, *order).withColumn("_slice", F.spark_partition_id())
    )
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*by, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(*by, "_slice").orderBy(*order))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), [*by, "_slice"])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_slice")
    )


def lookup(
    frame: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    hot: DataFrame | None = None,
    how: str = "left",
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Join a table with one row per key; rows of hot groups meet a broadcast.

    ``hot_on`` names the columns of ``hot`` when they are fewer than ``on``;
    the table must then be small within such a group.
    """
    on = list(on)
    if hot is None:
        return frame.join(table, on, how)
    hot_on = list(hot_on or on)
    cold = cold_part(frame, hot, hot_on).join(table, on, how)
    warm = hot_part(frame, hot, hot_on).join(F.broadcast(hot_part(table, hot, hot_on)), on, how)
    return cold.unionByName(warm)
