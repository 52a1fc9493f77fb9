"""Rows that meet a table by a key which very many of them may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.llm.storage import stored

#: A key is frequent if more than one row in this many has it, so there are fewer frequent keys than that.
FREQUENT = 1000


def met(rows: DataFrame, table: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """Inner join of stored ``rows`` with a stored ``table`` of one row a key.

    Frequent keys meet their rows of the table in a broadcast of fewer than
    ``share`` rows; only the others are shuffled. Null keys meet nothing.
    """
    share = FREQUENT if share is None else share
    total = rows.count()
    often = rows.groupBy(key).count().filter(F.col("count") * share > total).select(key)
    often = stored(table.join(F.broadcast(often), key))
    rare = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table, key)
    return rare.unionByName(rows.join(F.broadcast(often), key))
