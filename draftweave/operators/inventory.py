"""Checks on drawing files and status of documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc

# Accepted extensions and the leading bytes of their formats.
ALLOWED = [".jpeg", ".jpg", ".pdf", ".png"]
SIGNATURES = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF"}


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, or empty; a leading dot is no extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def file_checks(files: DataFrame) -> DataFrame:
    """Ordered checks on ``path, length, header`` rows (F-09, S-03).

    ``length`` is null for a file that does not exist. Pixels are not decoded.
    """
    path, length, ext = F.col("path"), F.col("length"), suffix(F.col("path"))
    kind = F.regexp_replace(ext, r"^\.", "")
    begin = F.hex("header")
    image = F.concat(F.lit("File could not be opened as a valid "), F.upper(kind), F.lit(" image."))

    def starts(name: str) -> Column:
        return F.coalesce(begin.startswith(SIGNATURES[name]), F.lit(False))

    other_image = F.when(kind == "png", starts("jpg")).otherwise(starts("png"))
    wrong = F.when(kind == "png", F.lit("File extension is .png but content is not a PNG.")).otherwise(
        F.concat(F.lit("File extension is ."), F.regexp_replace(ext, r"^\.", ""), F.lit(" but content is not a JPEG."))
    )
    matches = F.when(kind == "pdf", starts("pdf")).when(kind == "png", starts("png")).otherwise(starts("jpg"))
    error = (
        F.when(length.isNull(), F.concat(F.lit("File does not exist: "), path))
        .when(length <= 0, "File is empty.")
        .when(~ext.isin(*ALLOWED), F.concat(
            F.lit("Unsupported file type '"), ext, F.lit("'. Allowed: " + ", ".join(ALLOWED))))
        .when((kind == "pdf") & ~matches, "File extension is .pdf but content is not a valid PDF.")
        .when(~matches & other_image, wrong)
        .when(~matches, image)
    )
    known = ext.isin(*ALLOWED) & (length > 0)
    return files.withColumns({
        "error": error,
        "valid": error.isNull(),
        "file_type": F.when(known, kind),
        "error_code": F.when(error.isNotNull(), sc.validation_error_code(error)),
        "document_id": sc.document_id(path),
    })


def allowed_upload(names: DataFrame) -> DataFrame:
    """Extension gate on upload names; ``detail`` explains a refusal (F-12)."""
    ext = suffix(F.col("path"))
    refused = F.concat(
        F.lit("Unsupported file type '"), F.coalesce(sc.blank_to_null(ext), F.lit("(none)")),
        F.lit("'. Allowed: " + ", ".join(ALLOWED)),
    )
    ok = ext.isin(*ALLOWED)
    return names.withColumns({"allowed": ok, "detail": F.when(~ok, refused)})


def document_status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Status and page count per document (A-14, A-18).

    ``pages`` has ``doc_id, page_number, error``. Failed without any good page,
    partial with a page error, else processed.
    """
    per = pages.groupBy("doc_id").agg(
        F.count_if(F.col("error").isNull()).alias("page_count"),
        F.count_if(F.col("error").isNotNull()).alias("page_error_count"),
    )
    rows = documents.join(per, "doc_id", "left").na.fill(0, ["page_count", "page_error_count"])
    status = (
        F.when(F.col("page_count") == 0, "failed")
        .when(F.col("page_error_count") > 0, "partial")
        .otherwise("processed")
    )
    return rows.withColumn("status", status)


def page_errors(pages: DataFrame) -> DataFrame:
    """Failed pages as error rows, other pages unaffected (A-19)."""
    named = F.col("page_id").cast("string") if "page_id" in pages.columns else F.lit(None).cast("string")
    return pages.filter(F.col("error").isNotNull()).select(
        "doc_id", "page_number",
        F.coalesce("error_code", F.lit("IMAGE_PROCESSING_ERROR")).alias("code"),
        F.concat(F.coalesce(sc.page_id(F.col("page_number")), named), F.lit(": "), "error").alias("message"),
        F.lit("page").alias("field"),
    )


def unsized_pages(pages: DataFrame, *contents: DataFrame) -> DataFrame:
    """Pages with contents but without a size, as rows for :func:`page_errors`.

    ``contents`` are tables with ``doc_id, page_id``: words, contours, segments.
    """
    named = [c.select("doc_id", "page_id").distinct() for c in contents]
    seen = named[0]
    for other in named[1:]:
        seen = seen.unionByName(other)
    sized = pages.filter(F.col("width").isNotNull() & F.col("height").isNotNull()).select("doc_id", "page_id")
    return seen.distinct().join(sized, ["doc_id", "page_id"], "left_anti").select(
        "doc_id", F.regexp_extract("page_id", r"([0-9]+)$", 1).try_cast("bigint").alias("page_number"), "page_id",
        F.lit("PAGE_SIZE_MISSING").alias("error_code"), F.lit("page size is missing").alias("error"),
    )


def first_metadata(pages: DataFrame) -> DataFrame:
    """First non-empty drawing number and revision in page order (A-15)."""
    def first(name: str) -> Column:
        filled = F.coalesce(name, F.lit("")) != ""
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col("page_number"))).alias(name)

    return pages.groupBy("doc_id").agg(first("drawing_number"), first("revision"))


def pages_processed(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Page count per document and whether it equals the declared one (A-18)."""
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_processed"))
    return documents.join(counted, "doc_id", "left").na.fill(0, ["pages_processed"]).withColumn(
        "consistent", F.col("page_count") == F.col("pages_processed")
    )


def pipeline_status(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """``ok``, ``partial`` with stage errors, or ``failed`` without any page."""
    noted = errors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pipeline_error_count"))
    rows = documents.join(noted, "doc_id", "left").na.fill(0, ["pipeline_error_count"])
    return rows.withColumn(
        "pipeline_status",
        F.when(F.col("status") == "failed", "failed")
        .when(F.col("pipeline_error_count") > 0, "partial")
        .otherwise("ok"),
    )
