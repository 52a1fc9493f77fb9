"""Nested workspace documents.

A workspace nests all components of a drawing. Documents with at most
``PART_ROWS`` components come out as one row; larger ones as numbered parts
that each hold the next ``PART_ROWS`` components, so no row outgrows a task
and nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave import schemas
from draftweave.functions import scalars as sc
from draftweave.operators import procure, skew, validate

SCHEMA_VERSION = "1.0"
GENERATED_BY = "draftweave"
PART_ROWS = 10_000

COMPONENT_FIELDS = [
    "item_number", "bubble_number", "part_number", "part_name", "description", "quantity",
    "material_specification", "revision", "location_description", "bounding_box",
    "confidence_score", "procurement_data",
]


# What the run of a document adds to its metadata, and the error of an empty one.
RUN_FIELDS = {
    "original_filename": "string", "pages_processed": "bigint", "drawing_number": "string", "revision": "string",
    "extraction_source": "string", "using_mock_vision_extraction": "boolean", "extraction_warnings": "array<string>",
}
ERRORS = "array<struct<stage:string,message:string>>"
EMPTY_STAGE, EMPTY_MESSAGE = "vision_extraction", "No BOM items or callouts were extracted"


def _ordered(condition: Column | None, value: Column, order: list[Column] | None = None) -> Column:
    """Values of the rows that meet a condition, in component order."""
    keys = order or [F.col("seq")]
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))
    picked = entry if condition is None else F.when(condition, entry)
    return F.transform(F.array_sort(F.collect_list(picked)), lambda x: x["v"])


def workspace_documents(
    components: DataFrame,
    threshold: float = validate.REVIEW_THRESHOLD,
    hot: DataFrame | None = None,
    part_rows: int = PART_ROWS,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Priced and validated components to nested rows ``(doc_id, part, …)`` (K-01).

    ``runs`` names the documents that were processed, a row each, with any of
    ``RUN_FIELDS`` and ``pipeline_errors``. Every one of them has a workspace
    then: one without components comes out empty and says so in its errors.
    Good, empty and failed documents share one schema.

    One exchange by document serves the numbering upstream and this
    aggregation. Document totals are summed over parts with a window, or with a
    join for documents named in ``hot``.
    """
    counts = {**validate.summary_counts(), "total_components": F.count(F.lit(1))}
    cost = F.col("procurement_data.estimated_total_cost_usd").cast("decimal(28,2)")
    money = {
        "_cents": F.sum(F.coalesce(cost, F.lit(0).cast("decimal(28,2)"))),
        "items_with_price": procure.procurement_counts()["items_with_price"],
        "items_without_price": procure.procurement_counts()["items_without_price"],
    }
    figures = {**counts, **money}
    component = F.struct(F.col("component_id").alias("id"), *COMPONENT_FIELDS)
    record = F.struct("component_id", "issues", "status")
    numbered = components.withColumn(
        "part", F.floor((F.col("seq") - 1) / part_rows).cast("bigint")
    )
    lists = {
        "components": _ordered(None, component),
        "records": _ordered(None, record),
        "duplicate_item_numbers": _ordered(
            F.col("duplicate_item_number") & (F.col("bom_rn") == 1),
            F.col("item_number"), sc.key_order(F.col("item_number")),
        ),
        "duplicate_bubble_numbers": _ordered(
            F.col("duplicate_bubble_number") & (F.col("call_rn") == 1),
            F.col("bubble_number"), sc.key_order(F.col("bubble_number")),
        ),
        "ambiguous_bom_identifiers": _ordered(F.col("ambiguous_item_number"), F.col("raw_item_number")),
        "ambiguous_callout_identifiers": _ordered(F.col("ambiguous_bubble_number"), F.col("raw_bubble_number")),
    }

    def nested(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id", "part").agg(
            *[c.alias(n) for n, c in {**lists, **figures}.items()]
        )

    doc = W.partitionBy("doc_id")
    parts = nested(skew.cold_part(numbered, hot, ["doc_id"])).withColumns(
        {n: F.sum(n).over(doc) for n in figures}
    )
    if hot is not None:
        large = skew.hot_part(numbered, hot, ["doc_id"])
        totals = large.groupBy("doc_id").agg(*[c.alias(n) for n, c in figures.items()])
        # One row per hot document: the broadcast is bounded like ``hot`` itself.
        big = nested(large).drop(*figures).join(F.broadcast(totals), "doc_id")
        parts = parts.unionByName(big)
    if runs is None:
        return _nested_rows(parts, threshold)
    told = _filled_runs(runs).withColumn("_run", F.lit(True))
    rows = parts.join(told, "doc_id", "full_outer").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    none = F.coalesce(F.size("components") == 0, F.lit(True))
    empty = F.array(F.struct(F.lit(EMPTY_STAGE).alias("stage"), F.lit(EMPTY_MESSAGE).alias("message")))
    errors = F.concat(F.coalesce("pipeline_errors", F.array().cast(ERRORS)), F.when(none, empty).otherwise(F.array().cast(ERRORS)))
    return _nested_rows(rows.withColumn("pipeline_errors", errors), threshold)


def _filled_runs(runs: DataFrame) -> DataFrame:
    fields = {**RUN_FIELDS, "pipeline_errors": ERRORS}
    return runs.select("doc_id", *[
        (F.col(n) if n in runs.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields.items()])


def _nested_rows(rows: DataFrame, threshold: float | None, status: Column | None = None) -> DataFrame:
    """The workspace schema from flat columns; what is missing comes out empty or zero."""

    def at(name: str, kind: str, otherwise: Column | None = None) -> Column:
        found = (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
        return (found if otherwise is None else F.coalesce(found, otherwise.cast(kind))).alias(name)

    def listed(name: str, kind: str) -> Column:
        return at(name, f"array<{kind}>", F.array().cast(f"array<{kind}>"))

    zero, failed = F.lit(0), threshold is None
    limit = F.lit(threshold).cast("double").alias("confidence_threshold")
    summary = F.struct(*[at(n, "bigint", zero) for n in validate.summary_counts()], limit)
    if status is None and "pipeline_errors" in rows.columns:
        status = F.when(F.size("pipeline_errors") > 0, "partial").otherwise("ok")
    issue = f"struct<component_id:string,issues:array<{schemas.ISSUE}>,status:string>"
    flag = F.lit(None if failed else True).cast("boolean")
    return rows.select(
        "doc_id", at("part", "bigint", zero), listed("components", schemas.COMPONENT),
        F.struct(summary.alias("summary"), listed("records", issue).alias("issues")).alias("validation"),
        F.struct(
            F.lit("USD" if failed else procure.CURRENCY).alias("currency"),
            at("_cents", "double", F.lit(0.0)).alias("estimated_total_cost_usd"),
            at("items_with_price", "bigint", zero), at("items_without_price", "bigint", zero),
            flag.alias("estimated"), flag.alias("mock_data"),
            F.lit(None if failed else procure.ESTIMATE_NOTE).cast("string").alias("note"),
        ).alias("procurement_summary"),
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("generated_at"),
            F.lit(GENERATED_BY).alias("generated_by"), at("total_components", "bigint", zero), limit,
            *[listed(n, "string") for n in (
                "duplicate_item_numbers", "duplicate_bubble_numbers", "ambiguous_bom_identifiers", "ambiguous_callout_identifiers")],
            (F.lit(None) if status is None else status).cast("string").alias("pipeline_status"),
            at("pipeline_errors", ERRORS),
            *[at(n, kind) for n, kind in RUN_FIELDS.items()],
        ).alias("metadata"),
    )


def failed_workspaces(failures: DataFrame) -> DataFrame:
    """Empty, correctly shaped documents for failed inputs (K-06).

    ``failures`` has ``doc_id, stage, message`` and optionally any of
    ``RUN_FIELDS``. The currency of a failed document is USD. The schema is
    that of :func:`workspace_documents`, so both go into one table.
    """
    noted = failures.withColumn("pipeline_errors", F.array(F.struct("stage", "message")))
    rows = _filled_runs(noted).withColumn(
        "using_mock_vision_extraction", F.coalesce("using_mock_vision_extraction", F.lit(False)))
    return _nested_rows(rows, None, F.lit("failed"))


def missing_results(documents: DataFrame, results: DataFrame, stage: str, message: str) -> DataFrame:
    """Failure rows for documents that produced no result."""
    return documents.join(results.select("doc_id").distinct(), "doc_id", "left_anti").withColumns(
        {"stage": F.lit(stage), "message": F.lit(message)}
    )


def write_workspace(documents: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip", slices: int = 1) -> None:
    """Nested rows as JSON lines, one document (part) per line.

    Field names fill most of the text, so it is compressed; Spark's reader
    opens either form. ``compression="none"`` gives plain text. ``slices`` of a
    workspace bound the shuffle files on disk, see :func:`skew.write_in_slices`.
    """
    skew.write_in_slices(
        documents, "doc_id", slices, lambda writer, how: writer.mode(how).option("compression", compression).json(path), mode)
