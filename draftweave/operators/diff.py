"""Set difference of item numbers and balloon numbers, and the exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc
from draftweave.operators import skew


def _balloons(balloons: DataFrame) -> DataFrame:
    """Valid balloons with their key (F-03)."""
    kind = F.col("number_kind") if "number_kind" in balloons.columns else F.lit("int")
    rows = balloons.filter("is_balloon").select(
        "doc_id", "ord", "crop_id",
        sc.normalize_identifier(F.col("number").cast("string"), kind).alias("key"),
    )
    return rows.filter("key is not null")


def balloon_crops(balloons: DataFrame) -> DataFrame:
    """Crops of each key in list order, one row each: ``doc_id, key, position, crop_id``.

    A row a crop at every size: whoever wants a list collects it by key.
    """
    by = ["doc_id", "key"]
    rows = _balloons(balloons)
    hot = skew.hot_groups(rows, by)
    return skew.ranked(rows, by, [F.col("ord")], "position", hot).select(*by, "position", "crop_id")


def diff(bom: DataFrame, balloons: DataFrame) -> DataFrame:
    """Keys on both sides, only in the BOM, or only on the drawing (J-02, U-02).

    Columns ``doc_id, key, kind, bom_count, balloon_count``; both counts combine
    on the map side. :func:`balloon_crops` has the crops of each key.
    """
    kind = F.col("item_kind") if "item_kind" in bom.columns else F.lit("string")
    items = (
        bom.select("doc_id", sc.normalize_identifier(F.col("item_number"), kind).alias("key"))
        .filter("key is not null")
        .groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("bom_count"))
    )
    seen = _balloons(balloons).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("balloon_count"))
    kinds = (
        F.when(F.col("balloon_count").isNull(), "missing")
        .when(F.col("bom_count").isNull(), "extra")
        .otherwise("matched")
    )
    return (
        items.join(seen, ["doc_id", "key"], "full_outer")
        .withColumn("kind", kinds)
        .na.fill(0, ["bom_count", "balloon_count"])
        .select("doc_id", "key", "kind", "bom_count", "balloon_count")
    )


def balloon_duplicates(balloons: DataFrame) -> DataFrame:
    """Balloon numbers seen more than once (A-09): ``doc_id, key, count``."""
    return _balloons(balloons).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


# --- exact join ----------------------------------------------------------------


def first_callouts(callouts: DataFrame) -> DataFrame:
    """First callout of each exact bubble number (O-04); combines on the map side."""
    return callouts.groupBy("doc_id", F.col("bubble_number").alias("item_number")).agg(
        F.min_by(
            F.struct("confidence_score", "bubble_bbox"), F.col("call_ord")
        ).alias("callout")
    )


def exact_components(bom: DataFrame, callouts: DataFrame) -> DataFrame:
    """Components by exact text match with the first callout only (J-03).

    The callout side has one row per number, so a repeated BOM number only
    widens the streamed side, which adaptive execution splits when skewed.
    """
    return bom.join(first_callouts(callouts), ["doc_id", "item_number"]).select(
        "doc_id", "bom_ord",
        sc.exact_component_id(F.col("item_number")).alias("component_id"),
        "item_number", F.col("item_number").alias("bubble_number"), "part_number",
        F.col("description").alias("part_name"), "quantity", "material_specification",
        F.least("confidence_score", "callout.confidence_score").alias("confidence_score"),
        F.col("callout.bubble_bbox").alias("bounding_box"),
    )


def orphans(bom: DataFrame, callouts: DataFrame) -> DataFrame:
    """Warnings for rows without a partner, BOM side first (J-04)."""
    numbers = bom.select("doc_id", F.col("item_number").alias("bubble_number")).distinct()
    bubbles = callouts.select("doc_id", F.col("bubble_number").alias("item_number")).distinct()
    lone_items = bom.join(bubbles, ["doc_id", "item_number"], "left_anti").select(
        "doc_id", F.lit(0).alias("side"), F.col("bom_ord").alias("ord"),
        F.concat(F.lit("BOM item "), "item_number", F.lit(": No callout detected.")).alias("warning"),
    )
    lone_bubbles = callouts.join(numbers, ["doc_id", "bubble_number"], "left_anti").select(
        "doc_id", F.lit(1).alias("side"), F.col("call_ord").alias("ord"),
        F.concat(F.lit("Callout "), "bubble_number", F.lit(" has no matching BOM row.")).alias("warning"),
    )
    return lone_items.unionByName(lone_bubbles)


# --- lists per document ----------------------------------------------------------


def collect_warnings(warnings: DataFrame, order: list[Column]) -> DataFrame:
    """Warnings of each document in order, each with its page's prefix (A-17).

    ``warnings`` has ``doc_id, page_id, warning`` and optionally ``source``
    (such as "title block"), shown after the page. One row a warning:
    ``doc_id, position, warning``.
    """
    place = F.col("page_id")
    if "source" in warnings.columns:
        place = F.concat(place, F.coalesce(F.concat(F.lit(" ("), "source", F.lit(")")), F.lit("")))
    text = F.concat(place, F.lit(": "), "warning")
    hot = skew.hot_groups(warnings, ["doc_id"])
    placed = skew.ranked(warnings, ["doc_id"], order, "position", hot)
    return placed.select("doc_id", "position", text.alias("warning"))
