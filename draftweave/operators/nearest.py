"""Greedy selection: walk items in rank order, keep those that clash with none kept.

Ordinary groups run as one fold over an array. Groups above ``FOLD_ROWS`` run
in rounds on the whole cluster: items fall into cells such that clashing items
sit in neighbouring cells; each round keeps every item that outranks all
undecided items of its neighbourhood and drops what clashes with it. Each round
touches only per-cell minima and one join on the cell, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.operators import skew

FOLD_ROWS = 2_000

Clash = Callable[[Column, Column], Column]


def fold_rows(frame: DataFrame) -> int:
    """Items above which a group runs in rounds (``spark.draftweave.foldRows``)."""
    return int(frame.sparkSession.conf.get("spark.draftweave.foldRows", str(FOLD_ROWS)))


def decide(
    items: DataFrame,
    by: Sequence[str],
    rank: Column,
    shape: Column,
    clash: Clash,
    cell: Column,
    neighbours: Callable[[Column], Column],
) -> DataFrame:
    """Every item with its keeper.

    ``items`` has the group columns and an ``id`` unique within the group;
    ``rank`` is an orderable struct, unique within the group, lowest first;
    ``shape`` is what ``clash`` compares. Returns ``by + id, rank, shape,
    keeper`` where ``keeper`` is ``(rank, id, shape)`` of the first kept item
    that clashes, or null for kept items.
    """
    by = list(by)
    rows = items.select(*by, "id", rank.alias("rank"), shape.alias("shape"), cell.alias("cell"))
    large = rows.groupBy(*by).count().filter(F.col("count") > fold_rows(items)).select(*by)
    if large.isEmpty():
        return _folded(rows.drop("cell"), by, clash)
    # Not broadcast by hand: there may be many groups just above the limit.
    small = rows.join(large, by, "left_anti").drop("cell")
    big = rows.join(large, by, "left_semi")
    return _folded(small, by, clash).unionByName(_in_rounds(big, by, clash, neighbours))


def _entry(x: Column) -> Column:
    return F.struct(x["rank"].alias("rank"), x["id"].alias("id"), x["shape"].alias("shape"))


def _folded(rows: DataFrame, by: list[str], clash: Clash) -> DataFrame:
    listed = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "shape"))).alias("xs")
    )
    none = F.filter("xs", lambda x: F.lit(False))
    kept = F.aggregate(
        "xs", none,
        lambda acc, x: F.when(F.exists(acc, lambda k: clash(k["shape"], x["shape"])), acc).otherwise(
            F.concat(acc, F.array(x))
        ),
    )

    def with_keeper(x: Column) -> Column:
        before = F.filter(
            F.col("kept"), lambda k: (k["rank"] < x["rank"]) & clash(k["shape"], x["shape"])
        )
        return F.struct(
            x["rank"].alias("rank"), x["id"].alias("id"), x["shape"].alias("shape"),
            F.get(before, F.lit(0)).alias("keeper"),
        )

    return (
        listed.withColumn("kept", kept)
        .select(*by, F.inline(F.transform("xs", with_keeper)))
        .select(*by, "id", "rank", "shape", "keeper")
    )


def _in_rounds(
    rows: DataFrame, by: list[str], clash: Clash, neighbours: Callable[[Column], Column]
) -> DataFrame:
    at = [*by, "cell"]
    rows = skew.durable(rows)
    undecided, kept = rows, None
    while not undecided.isEmpty():
        best = undecided.groupBy(*at).agg(F.min(F.struct("rank", "id", "shape")).alias("best"))
        around = best.select(*by, F.explode(neighbours(F.col("cell"))).alias("cell"), F.col("best.rank").alias("r"))
        first = around.groupBy(*at).agg(F.min("r").alias("r"))
        winners = best.join(first, at).filter(F.col("best.rank") == F.col("r")).select(*at, "best")
        winners = skew.durable(winners)
        kept = winners if kept is None else kept.unionByName(winners)
        reach = winners.select(*by, F.explode(neighbours(F.col("cell"))).alias("cell"), "best")
        u, w = undecided.alias("u"), reach.alias("w")
        same_cell = _all_equal("u", "w", at)
        gone = (F.col("u.rank") == F.col("w.best.rank")) | clash(F.col("w.best.shape"), F.col("u.shape"))
        undecided = skew.durable(u.join(w, same_cell & gone, "left_anti"))
    reach = kept.select(*by, F.explode(neighbours(F.col("cell"))).alias("cell"), "best")
    u, w = rows.alias("u"), reach.alias("w")
    hit = (F.col("w.best.rank") < F.col("u.rank")) & clash(F.col("w.best.shape"), F.col("u.shape"))
    found = (
        u.join(w, _all_equal("u", "w", at) & hit)
        .groupBy(*[F.col(f"u.{c}").alias(c) for c in by], F.col("u.id").alias("id"))
        .agg(F.min("w.best").alias("keeper"))
    )
    dropped = rows.drop("cell").join(found, [*by, "id"])
    stayed = kept.select(
        *by, "best.id", "best.rank", "best.shape", F.lit(None).cast(dropped.schema["keeper"].dataType).alias("keeper")
    )
    return dropped.select(*by, "id", "rank", "shape", "keeper").unionByName(stayed)


def _all_equal(a: str, b: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"{a}.{n}") == F.col(f"{b}.{n}"))
    return out
