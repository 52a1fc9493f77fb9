"""Raw whole-page model responses to workspace inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc
from draftweave.operators import dedupe, diff, responses, verification
from draftweave.plans.workspace import Workspace, build_workspace


@dataclass(frozen=True)
class Extraction:
    bom: DataFrame
    callouts: DataFrame
    metadata: DataFrame
    warnings: DataFrame

    @property
    def components(self) -> DataFrame:
        """Exact-text components of the extraction itself."""
        return diff.exact_components(self.bom, self.callouts)

    @property
    def orphans(self) -> DataFrame:
        return diff.orphans(self.bom, self.callouts)

    def workspace(self, catalog: DataFrame | None = None, threshold: float = 0.75) -> Workspace:
        return build_workspace(self.bom, self.callouts, catalog, threshold)


def _step_warnings(step: int, checked: DataFrame, field: str, label: str, failure: str) -> DataFrame:
    """Responses that can't be read, fields that are no list, and rows that were skipped or changed.

    A response without items is the row of ``checked`` with a null ``index``,
    so each response is parsed once for all three.
    """
    whole = F.when(F.col("parse_error").isNotNull(), F.array(F.concat(F.lit(failure), "parse_error"))).when(
        F.col("_field_kind") != "array", F.array(F.lit(f"{label} response '{field}' was not a list; treated as empty")))
    said = F.when(F.col("index").isNull(), whole).otherwise(F.col("warnings"))
    return checked.select(
        "doc_id", "page_id", F.lit(step).alias("step"), "tile", F.coalesce("index", F.lit(-1)).alias("index"),
        F.posexplode(said).alias("i", "warning"),
    )


def extractions_from_responses(
    raw: DataFrame,
    pages: DataFrame,
    verdicts: DataFrame | None = None,
    threshold: float = responses.LOW_CONFIDENCE,
) -> Extraction:
    """BOM and callout rows of every page (stages ``bom`` and ``callouts``).

    Callouts found on a drawing region are moved to the page. ``verdicts`` are
    raw verification responses, each for the callout at ``index`` of the
    response ``doc_id, page_id, tile``. ``warnings`` has a row for everything
    that was skipped, changed or could not be read, placed by ``step`` (0 BOM,
    1 callouts, 2 verification), ``tile``, ``index`` and ``i``.
    """
    parsed = responses.parse_json_response(raw)
    in_order = sc.place("tile", F.col("index").cast("bigint"))
    bom_sent = parsed.filter("stage = 'bom'")
    bom_checked = responses.validate_bom_items(responses.list_items(bom_sent, "bom_items", outer=True), threshold)
    bom = bom_checked.filter("valid and index is not null").drop("_field_kind").withColumn("bom_ord", in_order)
    sizes = pages.select("doc_id", "page_id", "width", "height")
    call_sent = parsed.filter("stage = 'callouts'").join(sizes, ["doc_id", "page_id"], "left")
    call_checked = responses.validate_callouts(
        responses.list_items(call_sent, "callouts", outer=True), threshold, "width", "height"
    )
    callouts = call_checked.filter("valid and index is not null").withColumn("call_ord", in_order).drop(
        "width", "height", "_field_kind")
    warnings = _step_warnings(0, bom_checked, "bom_items", "BOM", "BOM extraction failed: ").unionByName(
        _step_warnings(1, call_checked, "callouts", "Callout", "Callout detection failed: ")
    )
    if verdicts is not None:
        said = verdicts.withColumn("call_ord", in_order).drop("tile", "index")
        judged = verification.apply_verification(callouts, verification.parse_verifications(said))
        callouts = judged.filter("kept").drop("kept", "warning")
        warnings = warnings.unionByName(judged.filter("warning is not null").select(
            "doc_id", "page_id", F.lit(2).alias("step"), "tile", "index", F.lit(0).alias("i"), "warning"))
    callouts = dedupe.crop_to_page(callouts, dedupe.page_crops(pages), ["doc_id", "page_id"])
    described = bom_sent.select(
        "doc_id", sc.place()["page_number"].alias("page_number"),
        sc.variant_text(sc.variant_field(F.col("parsed"), "drawing_number")).alias("drawing_number"),
        sc.variant_text(sc.variant_field(F.col("parsed"), "revision")).alias("revision"),
    )
    return Extraction(bom, callouts, described, warnings)
