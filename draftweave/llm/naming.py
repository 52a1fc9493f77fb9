"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are
sorted and numbered, then adjacent numbers are paired, the distinct pairs
sorted and numbered again, until one number is left of each text. Texts with
equally many blocks and equal last numbers are equal, without any chance of a
collision. Only DataFrame functions are used.

Blocks of text cross the network once, after equal ones have met in each task.
Places of a block find its number by a 128-bit digest instead of the block;
the digest is checked to be one-to-one on the blocks at hand, and another
seed is taken should it ever not be.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.llm.storage import stored

BLOCK_BYTES = 2048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> Column:
    """The text with A-Z lowered; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def _fingerprint(text: Column) -> Column:
    """Tells apart rows that share a doc_id; equal texts always share it."""
    return F.xxhash64(F.lit("row"), text)


def _once(value: Column, columns) -> Column:
    """Columns made from ``value``, which is computed once a row; to be selected alone or beside others."""
    return F.inline(F.transform(F.array(value), lambda x: F.struct(*columns(x))))


def _once_list(value: Column, made) -> Column:
    return F.transform(F.array(value), made)[0]


def _blocks(raw: Column, size: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Distinct rows with an integer name each, ascending in sorted order within a task."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(docs: DataFrame, text: str, size: int) -> tuple[DataFrame, int]:
    """Digest and name of every distinct block, and the seed of the digest."""
    cut = _once(normalised(text).cast("binary"), lambda raw: [_blocks(raw, size).alias("blocks")])
    blocks = docs.select(cut).select(F.explode("blocks").alias("block")).distinct()
    for seed in count():
        names = stored(_numbered(blocks, "block").select(*_digest(F.col("block"), seed), "name"))
        if names.groupBy("a", "b").count().filter("count > 1").isEmpty():
            return names, seed
    raise AssertionError


def _digest(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b")]


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each distinct row key ``(doc_id, row)``, ``row`` being a fingerprint of the text.

    ``blocks`` and ``name`` together identify the normalised text; ``copies``
    counts the input rows of the key; ``text_sha256`` is carried along.
    """
    names, seed = _named_blocks(docs, text, block_bytes)
    told = _once(normalised(text), lambda norm: [
        _fingerprint(norm).alias("row"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        _once_list(norm.cast("binary"), lambda raw: F.transform(_blocks(raw, block_bytes), lambda b: F.struct(*_digest(b, seed)))).alias("cut"),
    ])
    placed = docs.select(F.col(doc_id).alias("doc_id"), told).select(
        "doc_id", "row", "text_sha256", F.size("cut").alias("blocks"), F.posexplode("cut").alias("pos", "at"))
    first = F.when(F.col("pos") == 0, F.col("text_sha256"))
    level = stored(
        placed.select("doc_id", "row", "blocks", "pos", "at.a", "at.b", first.alias("text_sha256"))
        .join(names, ["a", "b"]).drop("a", "b")
    )
    key = ["doc_id", "row", "blocks"]
    rows = level.groupBy(*key).agg(
        F.count_if(F.col("pos") == 0).alias("copies"), F.max("text_sha256").alias("text_sha256"),
        F.max(F.when(F.col("blocks") == 1, F.col("name"))).alias("name"),
    )
    most = level.agg(F.max("blocks")).first()[0] or 1
    level = level.filter("blocks > 1").drop("text_sha256")
    if most == 1:
        return rows
    while most > 1:
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left")
        right = F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        pairs = stored(level.groupBy(*key, F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(left, right))
        names = stored(_numbered(pairs.select("left", "right").distinct(), "left", "right"))
        level = pairs.join(names, ["left", "right"]).select(*key, "pos", "name")
        most = (most + 1) // 2
    # A null doc_id is a key like any other, so the two parts meet by grouping and not by a join.
    return (
        rows.unionByName(
            level.select(*key, F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("text_sha256"), "name")
        )
        .groupBy(*key).agg(F.sum("copies").alias("copies"), F.max("text_sha256").alias("text_sha256"), F.max("name").alias("name"))
    )


def _groups(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """Row keys with the surviving id, the size of their group and the same-id copies."""
    rows = stored(identities(docs, doc_id, text, block_bytes))
    whole = stored(rows.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    return rows.join(whole, ["blocks", "name"])


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Group of equal texts of every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lowering A-Z; null counts as empty.
    The row with the largest ``doc_id`` stays; of rows that share text and
    ``doc_id``, exactly one. A null ``doc_id`` ranks below all others, and a
    group of such rows alone has a null ``keep_id``. An empty table gives no
    rows; other columns of ``docs`` are not looked at. Very long texts are
    named block by block, over many tasks. Names are the same for equal blocks
    within one run; they ascend within a slice and not over the whole table.
    """
    each = _groups(docs, doc_id, text, block_bytes).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; cases as in ``exact_groups``.

    Of repeated rows that differ in other columns only, any one stays.
    """
    groups = _groups(docs, doc_id, text, block_bytes)
    stay = stored(groups.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias("_key"), F.col("row").alias("_row"), (F.col("copies") > 1).alias("_many")))
    names = docs.columns
    moved = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body, key = f"c{names.index(text)}", F.col(f"c{names.index(doc_id)}")
    moved = moved.withColumn("_print", _fingerprint(normalised(body)))
    single, many = stay.filter("not _many"), stay.filter("_many")
    same = key.eqNullSafe(F.col("_key")) & (F.col("_print") == F.col("_row"))
    kept = moved.join(single, same, "left_semi")
    if not many.isEmpty():
        once = moved.join(many, same, "left_semi").dropDuplicates([f"c{names.index(doc_id)}", "_print"])
        kept = kept.unionByName(once)
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
