"""Drawing-to-BOM reconciliation for many documents at once, on Spark."""

from draftweave.operators.candidates import select_candidates
from draftweave.operators.dedupe import dedupe_callouts
from draftweave.operators.diff import diff
from draftweave.operators.procure import price
from draftweave.operators.reconcile import reconcile
from draftweave.operators.responses import parse_classifications
from draftweave.operators.tables import extract_bom
from draftweave.operators.validate import validate
from draftweave.operators.verification import apply_verification
from draftweave.plans.hybrid import run_hybrid
from draftweave.plans.vision import extractions_from_responses
from draftweave.plans.workspace import Workspace, build_workspace
from draftweave.sinks.exports import export_bundle, read_bundle
from draftweave.sources.files import document_inventory
from draftweave.streaming.workspaces import stream_workspaces

__all__ = [
    "Workspace", "apply_verification", "build_workspace", "dedupe_callouts", "diff",
    "document_inventory", "export_bundle", "extract_bom", "extractions_from_responses",
    "parse_classifications", "price", "read_bundle", "reconcile", "run_hybrid", "select_candidates",
    "stream_workspaces", "validate",
]
