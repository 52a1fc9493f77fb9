"""Issues, statuses and per-document counts of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc

REVIEW_THRESHOLD = 0.75

ISSUE_TYPE = "array<struct<type:string,severity:string,message:string>>"


def _issue(condition: Column, kind: str, severity: str, *message: Column | str) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m for m in message]
    record = F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.concat(*parts).alias("message")
    )
    return F.when(condition, record)


def _shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("None"))


def issues_of(threshold: float = REVIEW_THRESHOLD) -> Column:
    """Ordered issue list of a component row (G-07)."""
    item, bubble = F.col("item_number"), F.col("bubble_number")
    status, score, quantity = F.col("link_status"), F.col("confidence_score"), F.col("quantity")
    has_bom = status.isin("matched", "bom_only")
    limit = F.lit(float(threshold))

    def given(raw: Column, kind: Column) -> Column:
        empty = raw.isNull() | (raw == "") | ((kind == "bool") & (raw == "false")) | (
            kind.isin("int", "float") & (raw.try_cast("double") == 0)
        )
        return F.when(~empty, sc.scalar_repr(raw, kind))

    # An empty item value falls through to the bubble's, shown even when empty.
    raw_bubble, bubble_kind = F.col("raw_bubble_number"), F.col("raw_bubble_kind")
    raw = F.coalesce(
        given(F.col("raw_item_number"), F.col("raw_item_kind")),
        F.when(raw_bubble.isNotNull(), sc.scalar_repr(raw_bubble, bubble_kind)),
        F.lit("None"),
    )
    ambiguous = F.array(
        _issue(
            F.lit(True), "ambiguous_identifier", "error", "Identifier '", raw,
            "' could not be normalized to a single unambiguous number and was not auto-matched.",
        )
    )
    checks = F.array(
        _issue(status == "bom_only", "missing_callout", "error",
               "BOM item ", _shown(item), " has no matching drawing callout."),
        _issue(status == "callout_only", "missing_bom_item", "error",
               "Drawing bubble ", _shown(bubble), " has no matching BOM item."),
        _issue(F.col("duplicate_item_number"), "duplicate_bom_item", "error",
               "Item number ", _shown(item), " appears more than once in the BOM."),
        _issue(F.col("duplicate_bubble_number"), "duplicate_callout", "error",
               "Bubble number ", _shown(bubble), " appears more than once on the drawing."),
        _issue(score.isNull(), "confidence_unavailable", "info",
               "No confidence score was available from either the BOM or the drawing extraction."),
        _issue(score < limit, "low_confidence", "warning",
               "Combined confidence ", sc.two_decimals(score),
               " is below the review threshold of ", sc.two_decimals(limit), "."),
        _issue(has_bom & (F.coalesce("part_name", F.lit("")) == ""), "missing_field", "warning",
               "Part name is missing."),
        _issue(has_bom & quantity.isNull(), "missing_field", "warning", "Quantity is missing."),
        _issue(has_bom & (quantity <= 0), "invalid_quantity", "warning",
               "Quantity ", quantity.cast("string"), " is not a valid positive count."),
        _issue(has_bom & (F.coalesce("material_specification", F.lit("")) == ""), "missing_field", "info",
               "Material specification is missing."),
    )
    return F.when(status == "ambiguous", ambiguous).otherwise(
        F.filter(checks, lambda x: x.isNotNull())
    )


def status_of(issues: Column) -> Column:
    link = F.col("link_status")
    return (
        F.when(link == "ambiguous", "invalid")
        .when(link == "bom_only", "missing_callout")
        .when(link == "callout_only", "missing_bom_item")
        .when(F.size(issues) > 0, "review_required")
        .otherwise("linked")
    )


def validate(components: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Add ``issues`` and ``status`` to every component; no rows move."""
    return components.withColumn("issues", issues_of(threshold)).withColumn(
        "status", status_of(F.col("issues"))
    )


def summary_counts() -> dict[str, Column]:
    """The counts of a validation summary, as aggregates over validated rows."""
    link, status = F.col("link_status"), F.col("status")
    item, bubble = F.col("ambiguous_item_number"), F.col("ambiguous_bubble_number")
    return {
        "total_bom_items": F.count_if(link.isin("matched", "bom_only") | item),
        "total_callouts": F.count_if(link.isin("matched", "callout_only") | bubble),
        "linked_items": F.count_if(link == "matched"),
        "missing_callouts": F.count_if(link == "bom_only"),
        "missing_bom_items": F.count_if(link == "callout_only"),
        "low_confidence_items": F.count_if(
            F.exists("issues", lambda x: x["type"] == "low_confidence")
        ),
        "duplicate_bom_items": F.count_if(F.col("duplicate_item_number")),
        "duplicate_callouts": F.count_if(F.col("duplicate_bubble_number")),
        "ambiguous_identifiers": F.count_if(item | bubble),
        "review_required_items": F.count_if(status == "review_required"),
        "invalid_items": F.count_if(status == "invalid"),
    }


def validation_summary(validated: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Twelve figures per document, combined on the map side (A-01)."""
    counts = [c.alias(name) for name, c in summary_counts().items()]
    return validated.groupBy("doc_id").agg(*counts).withColumn(
        "confidence_threshold", F.lit(float(threshold))
    )


def status_counts(validated: DataFrame) -> DataFrame:
    """Components per status (A-07)."""
    return validated.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("components"))
