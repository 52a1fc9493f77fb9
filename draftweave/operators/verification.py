"""Second-pass verdicts on callouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc
from draftweave.operators import responses as rs

NO_REASON = "Verification rejected without a reason"
OUTSIDE = "Proposed bounding box does not surround the bubble"


def parse_verifications(responses: DataFrame) -> DataFrame:
    """Verdict per callout: ``verdict`` is valid, invalid or failed (G-05)."""
    parsed = rs.parse_json_response(responses)
    names = ["valid", "reason", "bubble_number", "leader_visible", "endpoint_visible",
             "bbox_surrounds_bubble", "confidence_score"]
    rows = sc.with_fields(parsed, "parsed", names, "f_")
    text = {n: F.col(f"f_{n}") for n in names}
    rows = rows.withColumns({f"k_{n}": F.coalesce(f"f_{n}_kind", F.lit("null")) for n in names})
    kind = {n: F.col(f"k_{n}") for n in names}

    def flag(name: str):
        """Lax boolean: booleans, 0/1 and their common words; null otherwise."""
        t = F.lower(text[name])
        return (
            F.when(kind[name] == "bool", t == "true")
            .when(kind[name].isin("int", "float", "string") & t.isin("1", "true", "t", "yes", "y", "on"), True)
            .when(kind[name].isin("int", "float", "string") & t.isin("0", "false", "f", "no", "n", "off"), False)
        )

    readable = F.lit(True)
    for n in ("leader_visible", "endpoint_visible", "bbox_surrounds_bubble"):
        readable = readable & ((kind[n] == "null") | flag(n).isNotNull())
    score = sc.safe_float(text["confidence_score"], kind["confidence_score"])
    score_ok = (kind["confidence_score"] == "null") | F.coalesce(score.between(0.0, 1.0), F.lit(False))
    texts_ok = kind["reason"].isin("null", "string") & kind["bubble_number"].isin("null", "string")
    outside = (kind["valid"] == "bool") & (text["valid"] == "true") & (
        kind["bbox_surrounds_bubble"] == "bool") & (text["bbox_surrounds_bubble"] == "false")
    complete = (
        (F.coalesce(text["bubble_number"], F.lit("")) != "")
        & flag("leader_visible").isNotNull() & flag("endpoint_visible").isNotNull()
        & ~F.coalesce(flag("bbox_surrounds_bubble") == F.lit(False), F.lit(False))
        & score.isNotNull()
    )
    reason = sc.blank_to_null(text["reason"])
    problem = (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(outside & kind["reason"].isin("null", "string"), F.lit(None).cast("string"))
        .when(flag("valid").isNull(), "valid is missing or not a flag")
        .when(~readable | ~score_ok | ~texts_ok, "malformed verdict")
        .when(flag("valid") & ~complete, "valid verdict is incomplete")
    )
    rows = sc.computed(rows, {"problem": problem, "_outside": outside})
    problem, outside = F.col("problem"), F.col("_outside")
    verdict = F.when(problem.isNotNull(), "failed").when(outside | ~flag("valid"), "invalid").otherwise("valid")
    keep = verdict == "valid"
    return rows.select(
        *[c for c in responses.columns if c != "response_text"],
        verdict.alias("verdict"),
        F.when(verdict == "invalid", F.coalesce(
            reason, F.when(outside, OUTSIDE), F.lit(NO_REASON))).alias("reason"),
        F.when(keep, text["bubble_number"]).alias("new_number"),
        F.when(keep, flag("leader_visible")).alias("leader_visible"),
        F.when(keep, flag("endpoint_visible")).alias("endpoint_visible"),
        F.when(keep, score).alias("new_confidence"),
        "problem",
    )


def apply_verification(callouts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every callout with its verdict applied (J-13).

    ``kept`` is false for rejected callouts; unreadable or missing verdicts
    keep the original. ``warning`` says what happened. The join key is one
    callout, so it cannot be skewed.
    """
    on = ["doc_id", "page_id", "call_ord"]
    rows = callouts.join(verdicts, on, "left")
    verdict = F.coalesce("verdict", F.lit("failed"))
    valid = verdict == "valid"
    leader, end = F.col("leader_visible"), F.col("endpoint_visible")
    status = (
        F.when(leader & end & F.col("leader_endpoint").isNotNull(), "clear")
        .when(~leader, "missing")
        .otherwise("unclear")
    )
    old = F.concat(F.lit("'"), "bubble_number", F.lit("'"))
    warning = (
        F.when(verdict == "failed", F.concat(
            F.lit("Callout verification failed for bubble "), old, F.lit("; keeping original detection ("),
            F.coalesce("problem", F.lit("no verdict")), F.lit(")")))
        .when(verdict == "invalid", F.concat(
            F.lit("Rejected callout bubble "), old, F.lit(" after verification: "), "reason"))
        .when(F.col("new_number") != F.col("bubble_number"), F.concat(
            F.lit("Verification corrected bubble number "), old, F.lit(" -> '"), "new_number", F.lit("'")))
    )
    changed = {
        "bubble_number": F.when(valid, F.col("new_number")).otherwise(F.col("bubble_number")),
        "confidence_score": F.when(valid, F.col("new_confidence")).otherwise(F.col("confidence_score")),
        "location_description": F.when(valid & ~leader, F.lit(None)).otherwise(F.col("location_description")),
        "leader_endpoint": F.when(valid & (status != "clear"), F.lit(None)).otherwise(F.col("leader_endpoint")),
        "leader_line_status": F.when(valid, status).otherwise(F.col("leader_line_status")),
    }
    kept = [changed.get(c, F.col(c)).alias(c) for c in callouts.columns]
    return rows.select(*kept, (verdict != "invalid").alias("kept"), warning.alias("warning"))
