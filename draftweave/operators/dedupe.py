"""Overlapping tiles and the removal of callouts found twice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import nearest, skew

GROUP = ["doc_id", "page_id", "bubble_number"]


def tiles(pages: DataFrame, rows: int = 2, cols: int = 2, overlap: float = 0.12) -> DataFrame:
    """Overlapping grid per page in pixels, at least one pixel each (E-01)."""
    if rows < 1 or cols < 1:
        raise ValueError(f"grid must be at least 1x1, got {rows}x{cols}")
    if not 0.0 <= overlap < 1.0:
        raise ValueError(f"overlap must be in [0, 1), got {overlap}")
    grid = pages.select(
        "doc_id", "page_id", "width", "height",
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))

    def span(size: Column, n: int, i: Column):
        cell = size / F.lit(float(n))
        half = cell * overlap / 2
        low = F.greatest(F.lit(0.0), i * cell - F.when(i > 0, half).otherwise(0.0)).cast("int")
        high = F.least(size.cast("double"), (i + 1) * cell + F.when(i < n - 1, half).otherwise(0.0)).cast("int")
        return low, F.when(high <= low, F.least(size.cast("int"), low + 1)).otherwise(high)

    x0, x1 = span(F.col("width"), cols, F.col("col"))
    y0, y1 = span(F.col("height"), rows, F.col("row"))
    return grid.select(
        "doc_id", "page_id",
        F.format_string("tile[r%dc%d]", "row", "col").alias("tile"),
        "row", "col", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        "width", "height",
    )


def crop_to_page(callouts: DataFrame, crops: DataFrame, on: list[str]) -> DataFrame:
    """Move boxes and leader ends from crop scale to page scale (J-10).

    ``crops`` has one row per key with a ``crop`` struct ``(x, y, width,
    height)`` in pixels and the page's ``width`` and ``height``. A null crop
    leaves the callout as it is.
    """
    geometry = crops.select(*on, F.col("crop").alias("_crop"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    joined = callouts.join(geometry, on, "left")
    return moved_to_page(joined, F.col("_crop"), F.col("_w"), F.col("_h")).drop("_crop", "_w", "_h")


def moved_to_page(callouts: DataFrame, crop: Column, width: Column, height: Column) -> DataFrame:
    """:func:`crop_to_page` for callouts that carry the crop and the size of their page."""
    box = F.col("bubble_bbox")
    if "bounding_box" in callouts.columns:
        box = geo.pick_bbox(box, F.col("bounding_box"))
    moved = crop.isNotNull()
    page = F.when(moved, geo.remap_from_crop(box, crop, width, height)).otherwise(box)
    out = callouts.withColumns({"bubble_bbox": page, "bounding_box": page})
    if "leader_endpoint" in callouts.columns:
        end = F.col("leader_endpoint")
        out = out.withColumn("leader_endpoint", F.when(moved, geo.remap_point_from_crop(end, crop, width, height)).otherwise(end))
    return out


def tile_crops(tiled: DataFrame, *more: str) -> DataFrame:
    """Tiles, with further columns of theirs, in the form :func:`crop_to_page` looks up."""
    crop = F.struct(
        F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"),
        (F.col("x1") - F.col("x0")).cast("double").alias("width"),
        (F.col("y1") - F.col("y0")).cast("double").alias("height"),
    )
    return tiled.select("doc_id", "page_id", "tile", *more, crop.alias("crop"), "width", "height")


def page_crops(pages: DataFrame) -> DataFrame:
    """Drawing regions in the form :func:`crop_to_page` looks up."""
    region = F.col("drawing_region")
    crop = F.when(region.isNotNull(), geo.crop_pixels(region, F.col("width"), F.col("height")))
    return pages.select("doc_id", "page_id", crop.alias("crop"), "width", "height")


# --- overlap ---------------------------------------------------------------------


def size_cell(box: Column) -> Column:
    """Size classes of a box and its centre's place on a grid of that class.

    A box of class ``c`` is at least 2^c and less than 2^(c+1) long; the grid of
    class ``c`` has steps of 2^(c+2).
    """

    def axis(low: Column, high: Column):
        size = F.floor(F.log2(high - low)).cast("int")
        return size, F.floor((low + high) / 2 / F.pow(F.lit(2.0), size + 2)).cast("bigint")

    w, ix = axis(box["xmin"], box["xmax"])
    h, iy = axis(box["ymin"], box["ymax"])
    return F.struct(w.alias("w"), h.alias("h"), ix.alias("ix"), iy.alias("iy"))


def cells_in_reach(iou: float):
    """Cells that may hold a box with at least this overlap.

    Such boxes differ in length by at most ``1 / iou``, and their centres by
    less than the longer one.
    """
    classes = max(0, math.ceil(math.log2(1 / iou)))

    def span(size: Column, i: Column, other: Column) -> Column:
        step, margin = F.pow(F.lit(2.0), size + 2), F.pow(F.lit(2.0), F.greatest(size, other) + 1)
        grid = F.pow(F.lit(2.0), other + 2)
        return F.sequence(
            F.floor((i * step - margin) / grid).cast("bigint"),
            F.floor(((i + 1) * step + margin) / grid).cast("bigint"),
        )

    def near(size: Column) -> Column:
        return F.sequence(size - classes, size + classes)

    def neighbours(c: Column) -> Column:
        return F.flatten(F.transform(near(c["w"]), lambda w: F.flatten(F.transform(
            near(c["h"]), lambda h: F.flatten(F.transform(
                span(c["w"], c["ix"], w), lambda ix: F.transform(
                    span(c["h"], c["iy"], h), lambda iy: F.struct(
                        w.alias("w"), h.alias("h"), ix.alias("ix"), iy.alias("iy")
                    ),
                ),
            )),
        ))))

    return neighbours


def _decided(callouts: DataFrame, iou: float) -> DataFrame:
    """Every callout with its keeper; empty boxes clash with nothing."""
    if iou <= 0:
        raise ValueError(f"iou must be positive, got {iou}")
    box = F.col("bubble_bbox")
    solid = (box["xmax"] > box["xmin"]) & (box["ymax"] > box["ymin"])
    items = callouts.select(
        *GROUP, F.struct(*[F.col(c) for c in callouts.columns]).alias("id"),
        "confidence_score", "call_ord", "bubble_bbox",
    )
    rank = F.struct((-F.col("confidence_score")).alias("score"), F.col("call_ord").alias("ord"))
    decided = nearest.decide(
        items.filter(solid), GROUP, rank, box,
        lambda a, b: geo.bbox_iou(a, b) >= iou, size_cell(box), cells_in_reach(iou),
    )
    empty = items.filter(~F.coalesce(solid, F.lit(False))).select(
        *GROUP, "id", rank.alias("rank"), F.col("bubble_bbox").alias("shape"),
        F.lit(None).cast(decided.schema["keeper"].dataType).alias("keeper"),
    )
    return decided.unionByName(empty)


def _kept(decided: DataFrame, callouts: DataFrame) -> DataFrame:
    kept = decided.filter(F.col("keeper").isNull()).select("id.*")
    box = F.col("bubble_bbox")
    hot = skew.hot_groups(callouts, ["doc_id", "page_id"])
    order = [box["ymin"], box["xmin"], F.col("bubble_number"), -F.col("confidence_score"), F.col("call_ord")]
    return skew.ranked(kept, ["doc_id", "page_id"], order, "reading_order", hot)


def _pairs(decided: DataFrame, iou: float) -> DataFrame:
    kept, gone = F.col("keeper.id"), F.col("id")
    return decided.filter(F.col("keeper").isNotNull()).select(
        *GROUP,
        kept["call_ord"].alias("kept_ord"), gone["call_ord"].alias("dropped_ord"),
        geo.bbox_iou(F.col("keeper.shape"), F.col("shape")).alias("iou"),
        F.concat(
            F.lit("Deduplicated overlapping callout bubble '"), "bubble_number",
            F.lit("': kept confidence="), sc.two_decimals(kept["confidence_score"]),
            F.lit(", dropped confidence="), sc.two_decimals(gone["confidence_score"]),
            F.lit(f" (IoU>={iou})"),
        ).alias("warning"),
    )


def dedupe_callouts(callouts: DataFrame, iou: float = 0.5) -> DataFrame:
    """Callouts kept when same-numbered boxes overlap strongly (W-10).

    Adds ``reading_order``, the position by top edge, left edge and number
    within the page (O-02).
    """
    return _kept(_decided(callouts, iou), callouts)


def overlap_pairs(callouts: DataFrame, iou: float = 0.5) -> DataFrame:
    """Each dropped callout with the kept one it repeats (J-09).

    One row per dropped callout, never the square of a pile of copies.
    """
    return _pairs(_decided(callouts, iou), iou)


def kept_and_pairs(callouts: DataFrame, iou: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """:func:`dedupe_callouts` and :func:`overlap_pairs` of one decision."""
    decided = _decided(callouts, iou)
    return _kept(decided, callouts), _pairs(decided, iou)
