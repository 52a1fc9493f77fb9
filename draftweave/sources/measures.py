"""Checked readers of what was measured on pages: words, contours, segments, cell tables (S-05).

Each table has a contract of columns and kinds of values. A stored table that
lacks a column, or holds a list where a scalar belongs, is refused at once.
Single bad rows are told with their reasons and kept apart, so that they reach
neither the row clustering nor the calibration, which rest on whole pixels.
Everything is one projection over the scan: no exchange, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of values and the type they are read as; a key keeps the type it is stored with.
KEY, TEXT, ORDINAL, PIXEL, MEASURE, CELLS = "key", "text", "ordinal", "pixel", "measure", "cells"
TYPES = {TEXT: "string", ORDINAL: "bigint", PIXEL: "int", MEASURE: "double", CELLS: "array<array<string>>"}
LARGEST = {ORDINAL: 9e18, PIXEL: 2147483647.0}

REASONS = "reasons"


@dataclass(frozen=True)
class Contract:
    """Columns in order with their kinds, and the least values of some of them."""

    columns: dict[str, str]
    least: dict[str, int]


PAGE = {"doc_id": KEY, "page_id": KEY}
CONTRACTS = {
    "words": Contract(
        {**PAGE, "region_id": KEY, "word_ord": ORDINAL, "text": TEXT, "left": PIXEL, "top": PIXEL, "width": PIXEL, "height": PIXEL},
        {"left": 0, "top": 0, "width": 0, "height": 0},
    ),
    "contours": Contract(
        {**PAGE, "contour_ord": ORDINAL, "radius": MEASURE, "area": MEASURE, "cx": MEASURE, "cy": MEASURE},
        {"radius": 0, "area": 0},
    ),
    "segments": Contract(
        {**PAGE, "seg_ord": ORDINAL, "x": PIXEL, "y": PIXEL, "w": PIXEL, "h": PIXEL},
        {"x": 0, "y": 0, "w": 0, "h": 0},
    ),
    "cell_tables": Contract({**PAGE, "table_ord": ORDINAL, "cells": CELLS}, {}),
}


def checked(rows: DataFrame, kind: str) -> DataFrame:
    """The contract's columns, typed, and ``reasons``: one for each column at fault, in order.

    A value at fault comes out null; a row without faults has an empty list.
    Columns outside the contract are left out. Repeated rows stay.
    """
    return _with_reasons(rows, kind)


def _reasons(kind: str) -> dict[str, Column]:
    contract = CONTRACTS[kind]
    return {n: _reason(n, sort, F.col(n), contract.least.get(n)) for n, sort in contract.columns.items()}


def _with_reasons(rows: DataFrame, kind: str, *extra: str) -> DataFrame:
    contract = CONTRACTS[kind]
    _refuse_misfits(rows, kind)
    reasons = _reasons(kind)
    values = [F.when(reasons[n].isNull(), _typed(sort, F.col(n))).alias(n) for n, sort in contract.columns.items()]
    return rows.select(*values, F.array_compact(F.array(*reasons.values())).alias(REASONS), *extra)


def _refuse_misfits(rows: DataFrame, kind: str) -> None:
    columns = CONTRACTS[kind].columns
    missing = [n for n in columns if n not in rows.columns]
    if missing:
        raise ValueError(f"{kind} lack the columns {', '.join(missing)}")
    for name, sort in columns.items():
        stored = rows.schema[name].dataType
        nested = isinstance(stored, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        lists = isinstance(stored, T.ArrayType) and isinstance(stored.elementType, T.ArrayType)
        if not lists if sort == CELLS else nested:
            raise ValueError(f"{kind}: column {name} is stored as {stored.simpleString()}")


def _typed(sort: str, raw: Column) -> Column:
    if sort == KEY:
        return raw
    if sort in (ORDINAL, PIXEL):
        # A text like 3.0 is a whole number, which only the detour by double reads.
        return F.coalesce(raw.try_cast(TYPES[sort]), raw.try_cast("double").try_cast(TYPES[sort]))
    return raw.try_cast(TYPES[sort])


def _reason(name: str, sort: str, raw: Column, least: int | None) -> Column:
    """What is wrong with a value, null if nothing is."""

    def told(what: str) -> Column:
        return F.lit(f"{name} {what}")

    if sort == TEXT:
        return F.lit(None).cast("string")
    reason = F.when(raw.isNull(), told("is missing"))
    if sort == KEY:
        return reason
    if sort == CELLS:
        return reason.when(F.size(raw) == 0, told("has no rows")).when(
            F.exists(raw, lambda row: row.isNull()), told("has a missing row"))
    number = raw.try_cast("double")
    reason = reason.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), told("is not a number"))
    if sort in LARGEST:
        reason = reason.when(F.rint(number) != number, told("is not a whole number"))
        reason = reason.when(F.abs(number) > LARGEST[sort], told("is too large"))
    return reason if least is None else reason.when(number < least, told(f"is below {least}"))


def accepted(rows: DataFrame, kind: str) -> DataFrame:
    """Rows that keep the contract, typed.

    Faults are looked for in the filter only: a row that passes has none to look for again.
    """
    _refuse_misfits(rows, kind)
    whole = rows.filter(F.coalesce(*_reasons(kind).values()).isNull())
    return whole.select(*[_typed(sort, F.col(n)).alias(n) for n, sort in CONTRACTS[kind].columns.items()])


def rejected(rows: DataFrame, kind: str) -> DataFrame:
    """Rows that break the contract: typed columns, ``reasons`` and the whole stored row as JSON in ``record``."""
    _refuse_misfits(rows, kind)
    faulty = rows.filter(F.coalesce(*_reasons(kind).values()).isNotNull())
    kept = faulty.withColumn("_record", F.to_json(F.struct(*[F.col(f"`{n}`") for n in rows.columns])))
    names = list(CONTRACTS[kind].columns)
    return _with_reasons(kept, kind, "_record").select(*names, REASONS, F.col("_record").alias("record"))


def read_measures(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a stored table (S-05)."""
    rows = spark.read.parquet(path)
    return accepted(rows, kind), rejected(rows, kind)
