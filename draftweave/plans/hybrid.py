"""Measured page contents to a workspace: words and rules give BOM rows,
contours and crop verdicts give callouts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc
from draftweave.operators import candidates as cand
from draftweave.operators import diff, responses, skew, tables
from draftweave.plans.workspace import Workspace, build_workspace


@dataclass(frozen=True)
class Hybrid:
    """``callouts`` and the workspace read their sources several times, so these
    are written to the shared folder when first asked for; the counts and the
    difference read them once and write nothing."""

    bom: DataFrame
    candidates: DataFrame
    classified: DataFrame
    pages: DataFrame

    @cached_property
    def callouts(self) -> DataFrame:
        placed = cand.attach_classification(skew.written(self.candidates), self.classified, self.pages)
        return skew.written(placed.withColumn("call_ord", sc.place(F.col("call_ord").cast("bigint"))))

    @property
    def stage_counts(self) -> DataFrame:
        return cand.stage_counts(self.bom, self.candidates, self.classified)

    @property
    def difference(self) -> DataFrame:
        balloons = self.classified.join(
            self.candidates.select("doc_id", "crop_id", F.col("contour_ord").alias("ord")), ["doc_id", "crop_id"]
        )
        return diff.diff(self.bom, balloons)

    def workspace(self, catalog: DataFrame | None = None, threshold: float = 0.75) -> Workspace:
        return build_workspace(skew.written(self.bom), self.callouts, catalog, threshold)


def run_hybrid(
    words: DataFrame,
    segments: DataFrame,
    cell_tables: DataFrame | None,
    contours: DataFrame,
    crop_responses: DataFrame,
    pages: DataFrame,
    digits: DataFrame | None = None,
) -> Hybrid:
    """The default route over tables of measured page contents."""
    regions = tables.table_regions(tables.wide_segments(segments, pages))
    rows = tables.to_contract(tables.extract_bom(words, regions, cell_tables, digits))
    bom = rows.withColumn("bom_ord", sc.place(F.col("row_ord").cast("bigint")))
    found = cand.select_candidates(contours, pages)
    judged = responses.parse_classifications(crop_responses)
    return Hybrid(bom, found, judged, pages)
