"""Flat views that a front end or a report reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import skew


def attach_validation(components: DataFrame, records: DataFrame) -> DataFrame:
    """First validation record of each component; none means linked (J-08).

    Used when components and records were stored apart; rows straight from
    ``validate`` already carry both.
    """
    first = records.groupBy("doc_id", "component_id").agg(
        F.min_by(F.struct("status", "issues"), F.col("record_ord")).alias("_r")
    )
    return components.join(first, ["doc_id", "component_id"], "left").select(
        *[F.col(c) for c in components.columns if c not in ("status", "issues")],
        F.coalesce("_r.status", F.lit("linked")).alias("status"),
        F.coalesce("_r.issues", F.array().cast("array<struct<type:string,severity:string,message:string>>")).alias("issues"),
    )


def parts_view(validated: DataFrame) -> DataFrame:
    """One part row per component with its badge (E-04, P-17, P-18, P-25)."""
    name = sc.display_name(F.col("description"), F.col("part_name"))
    extra = [F.col("procurement_data").alias("procurement")] if "procurement_data" in validated.columns else []
    return validated.select(
        "doc_id", "component_id", "item_number", "bubble_number", "part_number",
        name.alias("part_name"), "description", "quantity", "material_specification",
        "revision", "location_description", "confidence_score", "bounding_box", *extra,
        F.col("status").alias("backend_status"),
        sc.badge(F.col("status")).alias("status"),
        "issues",
        sc.confidence_percent(F.col("confidence_score")).alias("confidence_pct"),
        sc.display_label(F.col("bubble_number"), F.col("item_number")).alias("label"),
    )


def stats_cards(parts: DataFrame) -> DataFrame:
    """Total, matched, warning and missing parts per document (A-08)."""
    status = F.col("status")
    return parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "warning").alias("warnings"),
        F.count_if(status == "missing").alias("missing"),
    )


def flatten_issues(parts: DataFrame) -> DataFrame:
    """One row per issue with the part it belongs to (E-02)."""
    return parts.select(
        "doc_id", "component_id", "item_number", "bubble_number", "part_name",
        F.col("backend_status").alias("status"),
        F.posexplode("issues").alias("issue_pos", "issue"),
    ).select(
        "doc_id", "component_id", "issue_pos", "issue.type", "issue.severity", "issue.message",
        "status", "item_number", "bubble_number", "part_name",
        sc.issue_label(F.col("item_number"), F.col("bubble_number"), F.col("component_id")).alias("label"),
    )


def overlay(parts: DataFrame) -> DataFrame:
    """Located parts and their place on the page in percent (F-11, P-20)."""
    return parts.filter(F.col("bounding_box").isNotNull()).select(
        "doc_id", "component_id", "label", geo.overlay_percent(F.col("bounding_box")).alias("place")
    ).select("doc_id", "component_id", "label", "place.*")


def locate(components: DataFrame, item_number: str | Column) -> DataFrame:
    """Boxes of an item, in every document (J-12)."""
    return components.filter(F.col("item_number") == item_number).select(
        "doc_id", "page_id", "component_id", "bounding_box"
    )


# Boxes on a page's 0-1000 scale fall into eleven size classes: class c holds boxes of at most 2^c a side.


def _on_page(c: Column) -> Column:
    """A coordinate moved to the page's edge if it lies beyond; order is kept."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c.cast("double")))


def _step(c: Column, size: Column) -> Column:
    """Step of a coordinate on the grid of a size class."""
    return F.floor(_on_page(c) / F.pow(F.lit(2.0), size)).cast("int")


def parts_at(components: DataFrame, clicks: DataFrame) -> DataFrame:
    """Parts whose box holds a clicked point of its page (J-12).

    A point and a box meet by an equi join on document, page, size class and
    grid step. The grid of a class is as fine as its boxes are long, so a box
    lies on four steps at most and a crowd of small boxes spreads over as many
    steps as it has places; a point looks up one step of each class that its
    document has boxes of. Clicks without ``page_id`` mean every page; a box with
    swapped edges holds no point.

    The boxes are written to the shared folder while the plan is built: their
    classes and the lookup both read them there. Both joins are dealt by key,
    never broadcast: Spark's size of the points is that of the clicks, before
    they are repeated by class.
    """
    b = F.col("bounding_box")
    side = F.greatest(_on_page(b["xmax"]) - _on_page(b["xmin"]), _on_page(b["ymax"]) - _on_page(b["ymin"]), F.lit(1.0))
    size = F.ceil(F.log2(side)).cast("int")
    placed = skew.written(components.filter((b["xmin"] <= b["xmax"]) & (b["ymin"] <= b["ymax"])).select(
        F.col("doc_id").alias("_doc"), F.col("page_id").alias("_page"), "component_id", "item_number", "bounding_box", size.alias("_size")))
    size = F.col("_size")
    boxes = placed.withColumn("_col", F.explode(F.sequence(_step(b["xmin"], size), _step(b["xmax"], size)))).withColumn(
        "_row", F.explode(F.sequence(_step(b["ymin"], size), _step(b["ymax"], size))))
    classes = placed.groupBy(F.col("_doc").alias("_with")).agg(F.collect_set("_size").alias("_classes"))
    points = clicks.join(classes.hint("merge"), F.col("doc_id") == F.col("_with")).select(
        *clicks.columns, F.explode("_classes").alias("_class"))
    on = (F.col("doc_id") == F.col("_doc")) & (F.col("_class") == F.col("_size"))
    on = on & (_step(F.col("x"), F.col("_class")) == F.col("_col")) & (_step(F.col("y"), F.col("_class")) == F.col("_row"))
    if "page_id" in clicks.columns:
        on = on & F.col("page_id").eqNullSafe(F.col("_page"))
    hits = points.hint("merge").join(boxes, on).filter(geo.contains_point(b, F.col("x"), F.col("y")))
    return hits.select(*clicks.columns, "component_id", "item_number")
