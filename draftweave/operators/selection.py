"""Exact medians of groups too large to sort: values are counted by range, round by round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.operators import skew

#: Ranges a group's values are counted in at a time.
RANGES = 4096


def medians(rows: DataFrame, by: Sequence[str], value: str, limit: int | None = None) -> DataFrame:
    """``by, n, median``: rows and exact median of the finite values of few, large groups.

    One pass finds a group's least and largest value. Each further pass counts
    the values of ``RANGES`` equal ranges between them, on the map side, and
    goes on with the range that holds the middle. A group is done when its
    middle values fall into two ranges or its range has one value left; a
    range of at most ``limit`` rows (``skew.hot_rows`` by default) is ordered by one task. Ten
    billion evenly spread values take three passes.

    Nulls count in ``n`` only; a group without values has a null median. The
    table of ranges has a row a group and is broadcast, so ``rows`` must be of
    large groups: ``rows / hotRows`` bounds it.
    """
    by, limit = list(by), skew.hot_rows(rows.sparkSession) if limit is None else limit
    values = rows.select(*by, F.col(value).cast("double").alias("_v"))
    valued = F.count("_v")
    state = skew.durable(values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), valued.alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.floor((valued + 1) / 2).alias("rank"), (valued % 2 == 0).alias("even"),
    ))
    while not (wide := state.filter((F.col("low") < F.col("high")) & (F.col("inside") > limit))).isEmpty():
        state = skew.durable(_narrowed(values, wide, by).unionByName(_without(state, wide, by)))
    small = state.filter("low < high")
    order = F.row_number().over(W.partitionBy(*by).orderBy("_v"))
    middle = _inside(values, small, by).withColumn("_at", order).filter(
        (F.col("_at") == F.col("rank")) | (F.col("even") & (F.col("_at") == F.col("rank") + 1)))
    ordered = middle.groupBy(*by).agg(F.first("n").alias("n"), F.avg("_v").alias("median"))
    told = state.filter("not coalesce(low < high, false)").select(*by, "n", F.col("low").alias("median"))
    return told.unionByName(ordered)


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


def _inside(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Values within the range of their group, with its state."""
    l, r = values.alias("l"), F.broadcast(state).alias("r")
    near = F.col("l._v").between(F.col("r.low"), F.col("r.high"))
    return l.join(r, _same(by) & near).select("l.*", *[f"r.{c}" for c in state.columns if c not in by])


def _without(state: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    return state.alias("l").join(F.broadcast(gone.select(*by)).alias("r"), _same(by), "left_anti")


def _narrowed(values: DataFrame, wide: DataFrame, by: list[str]) -> DataFrame:
    """Groups with the range that holds their middle; both ends are values of the group."""
    share = (F.col("_v") - F.col("low")) / (F.col("high") - F.col("low"))
    ranges = _inside(values, wide, by).groupBy(
        *by, F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).alias("_range")
    ).agg(
        F.first("n").alias("n"), F.first("rank").alias("_rank"), F.first("even").alias("even"),
        F.count(F.lit(1)).alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"),
    )
    step = W.partitionBy(*by).orderBy("_range")
    upto, rank = F.col("_upto"), F.col("_rank")
    held = ranges.withColumns({"_upto": F.sum("inside").over(step), "_next": F.lead("low").over(step)}).filter(
        (upto >= rank) & (upto - F.col("inside") < rank))
    # The upper middle value is the next range's least: nothing is left to look for.
    split = F.col("even") & (upto == rank)
    between = (F.col("high") + F.col("_next")) / 2
    return held.select(
        *by, "n", "inside", F.when(split, between).otherwise(F.col("low")).alias("low"),
        F.when(split, between).otherwise(F.col("high")).alias("high"),
        (rank - (upto - F.col("inside"))).alias("rank"), "even",
    )
