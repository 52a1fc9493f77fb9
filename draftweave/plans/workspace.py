"""The core plan: two row tables to a priced, validated workspace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.operators import procure, reconcile, skew, validate, views
from draftweave.sinks import documents
from draftweave.sources.catalog import base_catalog, merge_catalog


@dataclass(frozen=True)
class Workspace:
    """Lazy frames of one run. ``components`` carries prices, issues and status."""

    components: DataFrame
    threshold: float
    hot: DataFrame | None
    slices: int = 1

    @property
    def issues(self) -> DataFrame:
        return self.components.select("doc_id", "seq", "component_id", "issues", "status")

    @property
    def validation_summary(self) -> DataFrame:
        return validate.validation_summary(self.components, self.threshold)

    @property
    def procurement_summary(self) -> DataFrame:
        return procure.procurement_summary(self.components)

    @property
    def parts(self) -> DataFrame:
        return views.parts_view(self.components)

    @property
    def documents(self) -> DataFrame:
        return self.documents_of(None)

    def documents_of(self, runs: DataFrame | None) -> DataFrame:
        """Nested documents of all ``runs``, those without components included."""
        return documents.workspace_documents(self.components, self.threshold, self.hot, runs=runs)

    def stored(self, path: str) -> Workspace:
        """Write the components once and go on from the stored table.

        Use it when several of the frames above are wanted: each would
        otherwise link and price the inputs again. Large inputs are linked in
        ``slices`` of their documents, which bounds the shuffle files on disk.
        """
        skew.write_in_slices(self.components, "doc_id", self.slices, lambda writer, mode: writer.mode(mode).option("compression", "zstd").parquet(path), "overwrite")
        rows = self.components.sparkSession.read.parquet(path)
        return Workspace(rows, self.threshold, self.hot)


def build_workspace(
    bom: DataFrame,
    callouts: DataFrame,
    catalog: DataFrame | None = None,
    threshold: float = validate.REVIEW_THRESHOLD,
    override: DataFrame | None = None,
) -> Workspace:
    """Reconcile, price and validate every document of the inputs.

    ``catalog`` replaces the base catalogue; ``override`` replaces or adds
    single entries of whichever catalogue is used.
    """
    prices = base_catalog(bom.sparkSession) if catalog is None else catalog
    if override is not None:
        prices = merge_catalog(prices, override)
    hot = reconcile.hot_documents(bom, callouts)
    components = reconcile.reconcile(bom, callouts, hot)
    priced = procure.price(components, prices)
    # Documents in ``hot`` are checkpointed; their rows would be dealt again for each slice.
    slices = skew.slices_of(bom, callouts) if hot is None else 1
    return Workspace(validate.validate(priced, threshold), float(threshold), hot, slices)
