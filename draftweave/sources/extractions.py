"""Stored extraction documents and raw responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftweave import schemas
from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction documents, one JSON record per page (S-01).

    A record that can't be parsed keeps its text in ``_corrupt_record``;
    :func:`broken_records` turns such rows into failures.
    """
    return with_file(spark.read.schema(schemas.EXTRACTION).json(path))


def with_file(documents: DataFrame) -> DataFrame:
    return documents.withColumn("file", F.col("_metadata.file_path"))


def broken_records(documents: DataFrame) -> DataFrame:
    """Records without a readable document: ``doc_id`` (the file's name and the record's hash), ``stage, message, original_filename``."""
    broken = documents.filter(F.col("_corrupt_record").isNotNull() | F.col("doc_id").isNull())
    text = F.coalesce("_corrupt_record", F.lit(""))
    return broken.select(
        F.concat(F.regexp_extract("file", "([^/]*)$", 1), F.lit("#"), F.hex(F.xxhash64(text))).alias("doc_id"),
        F.lit("extraction").alias("stage"), F.lit("Malformed extraction record").alias("message"),
        F.col("file").alias("original_filename"),
    )


def _page(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id is not null").withColumn("page_id", F.coalesce("page_id", F.lit("page_001")))


def _scalars(rows: DataFrame, names: list[str]) -> DataFrame:
    """Text and kind of the VARIANT fields of ``r``; an absent field has kind null."""
    texts = {f"t_{n}": sc.variant_text(F.col(f"r.{n}")) for n in names}
    kinds = {f"k_{n}": F.coalesce(sc.variant_kind(F.col(f"r.{n}")), F.lit("null")) for n in names}
    return rows.withColumns({**texts, **kinds})


def bom_rows(documents: DataFrame) -> DataFrame:
    """BOM rows of extraction documents, typed, with identifier kinds (S-01, U-04, P-02, P-03)."""
    rows = _page(documents).select("doc_id", "page_id", F.posexplode("bom_items").alias("i", "r"))
    return _scalars(rows, ["item_number", "quantity", "confidence_score"]).select(
        "doc_id", "page_id", sc.place("i").alias("bom_ord"),
        F.col("t_item_number").alias("item_number"), F.col("k_item_number").alias("item_kind"),
        "r.part_number", "r.part_name", "r.description",
        sc.safe_int(F.col("t_quantity"), F.col("k_quantity")).alias("quantity"),
        "r.material_specification", "r.material", "r.revision",
        sc.safe_float(F.col("t_confidence_score"), F.col("k_confidence_score")).alias("confidence_score"),
    )


def callout_rows(documents: DataFrame) -> DataFrame:
    """Callout rows of extraction documents (S-01, X-15, X-16)."""
    rows = _page(documents).select("doc_id", "page_id", F.posexplode("callouts").alias("i", "r"))
    main, legacy = F.col("r.bubble_bbox"), F.col("r.bounding_box")
    empty = F.coalesce(F.schema_of_variant(main).isin("VOID", "OBJECT<>"), F.lit(True))
    # One generator a step: each is a method of its own, and small enough for the JVM to compile.
    rows = sc.computed(_scalars(rows, ["bubble_number", "confidence_score"]), {"_picked": F.when(empty, legacy).otherwise(main)})
    rows = sc.with_fields(rows, "_picked", geo.EDGES, "b_")
    for e in geo.EDGES:
        rows = sc.computed(rows, {f"b_{e}": sc.safe_float(F.col(f"b_{e}"), F.col(f"b_{e}_kind"))})
    box = geo.normalize_bounding_box(*[F.col(f"b_{e}") for e in geo.EDGES])
    return rows.select(
        "doc_id", "page_id", sc.place("i").alias("call_ord"),
        F.col("t_bubble_number").alias("bubble_number"), F.col("k_bubble_number").alias("bubble_kind"),
        "r.location_description", box.alias("bubble_bbox"),
        sc.safe_float(F.col("t_confidence_score"), F.col("k_confidence_score")).alias("confidence_score"),
        "r.leader_endpoint", "r.leader_line_status",
    )


def warning_rows(documents: DataFrame) -> DataFrame:
    """Warnings of extraction documents in order."""
    return _page(documents).select(
        "doc_id", "page_id", F.posexplode("extraction_warnings").alias("i", "warning")
    ).select("doc_id", "page_id", sc.place("i").alias("ord"), "warning")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Raw model responses, one JSON record per request (S-04)."""
    return spark.read.schema(schemas.RESPONSE).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Words, contours, segments or cell tables extracted beforehand (S-05)."""
    return spark.read.parquet(path)
