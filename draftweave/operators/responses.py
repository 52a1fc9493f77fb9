"""Turning raw model text into validated rows.

Responses are one row per request: ``doc_id, page_id, stage, tile,
response_text``. Parsing gives VARIANT values, so missing keys, nulls and the
kinds of scalars stay distinguishable. A bad row never stops the others: it
carries the reason in ``warnings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import dedupe, skew

# Fixed values.
CALLOUT_MIN_CONFIDENCE = 0.85
LOW_CONFIDENCE = 0.70
PYTHON_NAMES = {
    "null": "NoneType", "bool": "bool", "int": "int", "float": "float", "string": "str", "array": "list",
}
REQUEST = ["doc_id", "page_id", "stage", "tile"]


def _without_fences(stripped: Column) -> Column:
    body = F.regexp_replace(stripped, r"^```[^\r\n]*(\r\n|\n|\r|$)", "")
    body = F.regexp_replace(body, r"(^|\r\n|\n|\r)[^\S\r\n]*```[^\r\n]*$", "")
    return F.when(stripped.startswith("```"), sc.strip(body)).otherwise(stripped)


def strip_fences(text: Column) -> Column:
    """Text without a surrounding Markdown code fence."""
    return _without_fences(sc.strip(text))


def parse_json_response(responses: DataFrame) -> DataFrame:
    """Add ``parsed`` (a VARIANT object or null) and ``parse_error`` (G-01)."""
    text = F.col("_stripped")
    rows = sc.computed(responses, {"_stripped": sc.strip(F.col("response_text"))})
    rows = sc.computed(rows, {"_value": F.try_parse_json(_without_fences(text)), "_blank": F.coalesce(text, F.lit("")) == ""})
    rows = sc.computed(rows, {"_object": sc.is_object(F.col("_value"))})
    names = F.create_map(*[F.lit(x) for pair in PYTHON_NAMES.items() for x in pair])
    error = (
        F.when(F.col("_object"), F.lit(None).cast("string"))
        .when(F.col("_blank"), "Empty response from vision model")
        .when(F.col("_value").isNull(), "Malformed JSON in vision model response")
        .otherwise(F.concat(
            F.lit("Expected a JSON object from vision model, got "),
            F.try_element_at(names, sc.variant_kind(F.col("_value"))),
        ))
    )
    return sc.computed(rows, {
        "parse_error": error,
        "parsed": F.when(F.col("_object"), F.col("_value")),
    }).drop("_value", "_blank", "_object", "_stripped")


def _with_list(parsed: DataFrame, name: str) -> DataFrame:
    """Add ``_items``, the items of a named field if it is a list, and the field's kind as ``_field_kind``."""
    listed = sc.computed(parsed, {"_items": F.try_variant_get("parsed", f"$.{name}", "array<variant>")})
    other = sc.variant_kind(sc.variant_field(F.col("parsed"), name))
    return listed.withColumn("_field_kind", F.when(F.col("_items").isNotNull(), "array").otherwise(other))


def list_items(parsed: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Items of a named list with their index as ``index, raw``.

    With ``outer`` a response without items keeps one row, both null, and each
    row carries the kind of the field as ``_field_kind``.
    """
    return _with_list(parsed, name).select(
        *[c for c in parsed.columns if c not in ("parsed", "response_text")], *(["_field_kind"] if outer else []),
        (F.posexplode_outer if outer else F.posexplode)("_items").alias("index", "raw"),
    )


def reject_non_list(parsed: DataFrame, name: str, label: str) -> DataFrame:
    """Warnings for fields that should be lists (G-08)."""
    return _with_list(parsed, name).filter(F.col("_field_kind") != "array").select(
        *[c for c in REQUEST if c in parsed.columns],
        F.lit(f"{label} response '{name}' was not a list; treated as empty").alias("warning"),
    )


def _optional_text_ok(kind: Column) -> Column:
    return kind.isNull() | kind.isin("null", "string")


def _present(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("null")) != "null"


# --- BOM rows ------------------------------------------------------------------------


def lax_quantity(text: Column, kind: Column) -> Column:
    """Whole number from an integer, whole float, whole text or boolean, else null."""
    stripped = sc.strip(text)
    whole_text = F.when(stripped.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_extract(stripped, r"^([+-]?[0-9]+)", 1))
    return (
        F.when(kind == "bool", F.when(text == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        .when(kind == "string", whole_text.try_cast("bigint"))
        .otherwise(sc.safe_int(text, kind))
    )


def validate_bom_items(items: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Check BOM rows: ``valid``, the accepted fields and ``warnings`` (G-02, G-09, P-24, F-02).

    Guessed-name fields are never read, ``part_name`` is always null, and
    ``material`` fills a missing ``material_specification``.
    """
    plain = ["item_number", "part_number", "description", "revision"]
    raw = ["material_specification", "material", "quantity", "confidence_score"]
    rows = sc.computed(items, {"_object": sc.is_object(F.col("raw"))})
    rows = sc.with_fields(sc.with_fields(rows, "raw", plain), "raw", raw, "raw_")
    text = {**{n: F.col(n) for n in plain}, **{n: F.col(f"raw_{n}") for n in raw}}
    kind = {**{n: F.col(f"{n}_kind") for n in plain}, **{n: F.col(f"raw_{n}_kind") for n in raw}}
    spec_given = _present(kind["material_specification"])
    rows = rows.withColumns({
        "material_specification": F.when(spec_given, text["material_specification"]).otherwise(text["material"]),
        "_material_kind": F.when(spec_given, kind["material_specification"]).otherwise(kind["material"]),
        "quantity": F.when(_present(kind["quantity"]), lax_quantity(text["quantity"], kind["quantity"])),
        "confidence_score": sc.clamp_confidence(text["confidence_score"], kind["confidence_score"]),
    })
    quantity = F.col("quantity")
    reason = (
        F.when(F.col("raw").isNotNull() & ~F.col("_object"), "BOM row is not an object")
        .when(kind["item_number"].isNull(), "item_number is missing")
        .when(kind["item_number"] != "string", "item_number is not text")
        .when(~_optional_text_ok(kind["part_number"]), "part_number is not text")
        .when(~_optional_text_ok(kind["description"]), "description is not text")
        .when(_present(kind["quantity"]) & quantity.isNull(), "quantity is not a whole number")
        .when(quantity < 0, F.concat(F.lit("quantity cannot be negative, got "), quantity.cast("string")))
        .when(~_optional_text_ok(F.col("_material_kind")), "material_specification is not text")
        .when(~_optional_text_ok(kind["revision"]), "revision is not text")
    )
    rows = rows.withColumn("_reason", reason)
    skipped = F.concat(
        F.lit("Skipped invalid BOM row at index "), F.col("index").cast("string"), F.lit(": "), F.col("_reason")
    )
    low = F.when(
        sc.is_low_confidence(F.col("confidence_score"), threshold),
        sc.low_confidence_warning("BOM item", text["item_number"], F.col("confidence_score")),
    )
    checked = sc.computed(rows, {
        "valid": F.col("_reason").isNull(),
        "part_name": F.lit(None).cast("string"),
        "warnings": F.when(F.col("_reason").isNotNull(), F.array(skipped)).otherwise(
            F.filter(F.array(low), lambda x: x.isNotNull())
        ),
    })
    return checked.select(
        *[c for c in items.columns if c != "raw"], "valid", "item_number", "part_number", "part_name",
        "description", "quantity", "material_specification", "revision", "confidence_score", "warnings",
    )


# --- callouts ------------------------------------------------------------------------


def resolve_leader(status: Column, endpoint: Column) -> Column:
    """``(status, endpoint)``: only a clear leader keeps its end; clear without one is missing (G-06)."""
    kept = F.when((status == "clear") & endpoint.isNotNull(), endpoint)
    resolved = F.when((status == "clear") & endpoint.isNull(), "missing").otherwise(
        F.coalesce(status, F.lit("missing"))
    )
    return F.struct(resolved.alias("status"), kept.alias("endpoint"))


def _repr(text: Column, kind: Column) -> Column:
    quoted = F.when(
        F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), text, F.lit('"'))
    ).otherwise(F.concat(F.lit("'"), F.regexp_replace(text, "'", r"\\\\'"), F.lit("'")))
    return F.when(kind == "string", quoted).otherwise(sc.scalar_repr(text, kind))


def _number(name: str) -> Column:
    text, kind = F.col(name), F.col(f"{name}_kind")
    return F.when(kind == "bool", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(sc.safe_float(text, kind))


def validate_callouts(
    items: DataFrame, threshold: float = LOW_CONFIDENCE, width: str | None = None, height: str | None = None
) -> DataFrame:
    """Check callout rows in order; degradations become ``warnings`` (G-03, G-06, F-01, X-04, W-03).

    ``width`` and ``height`` name columns with the size of the image the model
    saw; boxes off the 0-1000 scale are read as pixels of it.
    """
    size = [F.lit(None).cast("double") if c is None else F.col(c).cast("double") for c in (width, height)]
    plain = ["bubble_number", "location_description", "confidence_score", "leader_line_status"]
    nested = ["bubble_bbox", "bounding_box", "leader_endpoint"]
    rows = sc.computed(items, {"_object": sc.is_object(F.col("raw"))})
    rows = sc.with_fields(rows, "raw", plain, "f_")
    rows = sc.computed(rows, {"_nested": F.try_variant_get("raw", "$", f"struct<{','.join(f'{n}:variant' for n in nested)}>")})
    rows = sc.computed(rows, {
        "f_leader_endpoint_v": F.col("_nested.leader_endpoint"),
        "_pointed": sc.is_object(F.col("_nested.leader_endpoint")),
        "_boxed": F.when(sc.is_object(F.col("_nested.bubble_bbox")), F.col("_nested.bubble_bbox")).when(
            sc.is_object(F.col("_nested.bounding_box")), F.col("_nested.bounding_box")),
    }).drop("_nested")
    status, status_kind = F.col("f_leader_line_status"), F.col("f_leader_line_status_kind")
    rows = sc.computed(rows, {
        "confidence_score": sc.clamp_confidence(F.col("f_confidence_score"), F.col("f_confidence_score_kind")),
        "_status_raw": F.when(_present(status_kind), sc.scalar_repr(status, status_kind)),
    })
    rows = sc.with_fields(rows, "_boxed", geo.EDGES, "b_")
    rows = sc.with_fields(rows, "f_leader_endpoint_v", ["x", "y"], "e_")
    rows = sc.computed(rows, {
        "_label": F.when(F.col("_object"), _repr(F.col("f_bubble_number"), F.coalesce("f_bubble_number_kind", F.lit("null")))).otherwise("?"),
    })
    edges = {**{f"b_{e}": _number(f"b_{e}") for e in geo.EDGES}, "_x": _number("e_x"), "_y": _number("e_y")}
    for name, value in edges.items():
        rows = sc.computed(rows, {name: value})
    rows = sc.computed(rows, {"_box": F.when(F.col("_boxed").isNotNull(), geo.box(*[F.col(f"b_{e}") for e in geo.EDGES]))})
    numbers = F.lit(True)
    for e in geo.EDGES:
        numbers = numbers & F.col("_box")[e].isNotNull()
    on_page = F.col("_x").between(0.0, geo.SCALE) & F.col("_y").between(0.0, geo.SCALE)
    sized = F.coalesce((size[0] > 0) & (size[1] > 0), F.lit(False))
    rows = sc.computed(rows, {
        "_x": F.when(~on_page & sized, geo.normalize_coordinate(F.col("_x"), size[0])).otherwise(F.col("_x")),
        "_y": F.when(~on_page & sized, geo.normalize_coordinate(F.col("_y"), size[1])).otherwise(F.col("_y")),
        "_numbers": F.coalesce(numbers, F.lit(False)),
    })
    x, y = F.col("_x"), F.col("_y")
    point = F.struct(x.alias("x"), y.alias("y"))
    has_end = F.col("f_leader_endpoint_v").isNotNull() & ~F.is_variant_null("f_leader_endpoint_v")
    end_ok = F.coalesce(F.col("_pointed") & x.between(0.0, geo.SCALE) & y.between(0.0, geo.SCALE), F.lit(False))
    given = F.col("_status_raw")
    lowered = F.when(given.isin("clear", "unclear", "missing"), given).otherwise(F.lower(sc.strip(given)))
    empty_status = F.col("_status_raw").isNull() | (F.col("_status_raw") == "")
    rows = sc.computed(rows, {"_moved": F.when(F.col("_numbers"), geo.scaled_bbox(F.col("_box"), *size))})
    rows = sc.computed(rows, {
        "bubble_bbox": F.when(geo.in_range(F.col("_moved")), F.col("_moved")),
        "_leader_given": F.col("f_leader_line_status_kind").isNotNull() | F.col("f_leader_endpoint_v").isNotNull(),
        "_status": F.when(empty_status, "missing").otherwise(lowered),
        "_bad_end": has_end & ~end_ok,
        "_point": F.when(end_ok, point),
    })
    # An unusable end downgrades a clear leader before the other leader checks.
    rows = rows.withColumn(
        "_checked", F.when(F.col("_bad_end") & (F.col("_status") == "clear"), "missing").otherwise(F.col("_status"))
    )
    low_score = F.col("confidence_score") < CALLOUT_MIN_CONFIDENCE
    at = F.col("index").cast("string")
    where = F.concat(at, F.lit(" (bubble="), F.col("_label"), F.lit("): "))
    label = F.col("_label")
    invalid = (
        F.when(~F.col("_status").isin("clear", "unclear", "missing"), F.concat(
            F.lit("leader_line_status must be one of ['clear', 'missing', 'unclear'], got "),
            _repr(F.col("_status_raw"), F.col("f_leader_line_status_kind")),
        ))
        .when(F.col("f_bubble_number_kind").isNull(), "'bubble_number'")
        .when(~_optional_text_ok(F.col("f_location_description_kind")), "location_description is not text")
    )
    rows = sc.computed(rows, {"_invalid": invalid})
    box_problem = (
        F.when(F.col("_boxed").isNull(), "malformed bubble_bbox: missing or not an object")
        .when(~F.col("_numbers"), "box edge missing or not a number")
        .when(F.col("bubble_bbox").isNull(), "box out of range or out of order")
    )
    rows = sc.computed(rows, {"_box_problem": box_problem})
    gate = (
        F.when(F.col("raw").isNotNull() & ~F.col("_object"), F.concat(
            F.lit("Skipped invalid callout at index "), at, F.lit(": callout row is not an object")))
        .when(low_score, F.concat(
            F.lit("Skipped callout at index "), where, F.lit("confidence "),
            sc.two_decimals(F.col("confidence_score")), F.lit(f" below minimum {CALLOUT_MIN_CONFIDENCE}")))
        .when(F.col("_box_problem").isNotNull(), F.concat(
            F.lit("Malformed bubble_bbox for callout at index "), where, F.col("_box_problem")))
        .when(~F.col("_status").isin("clear", "unclear", "missing"), F.concat(
            F.lit("Skipped invalid callout at index "), at, F.lit(": "), F.col("_invalid")))
    )
    rows = sc.computed(rows, {"_gate": gate})
    checked, given, pointed = F.col("_checked"), F.col("_leader_given"), F.col("_point").isNotNull()
    subject = F.concat(F.lit(" for callout bubble "), label)
    leader_warning = (
        F.when(~given, F.lit(None).cast("string"))
        .when((checked == "unclear") & pointed, F.concat(
            F.lit("Unclear leader line"), subject, F.lit(": endpoint discarded (do not invent a target)")))
        .when(checked == "unclear", F.concat(F.lit("Unclear leader line"), subject))
        .when((checked == "missing") & pointed, F.concat(
            F.lit("Missing endpoint"), subject,
            F.lit(": endpoint discarded because leader_line_status is 'missing'")))
        .when(checked == "missing", F.concat(F.lit("Missing endpoint"), subject))
        .when((checked == "clear") & ~pointed, F.concat(
            F.lit("Missing endpoint"), subject,
            F.lit(": leader_line_status was 'clear' but leader_endpoint was null; downgraded to 'missing'")))
    )
    bad_end = F.when(F.col("_bad_end"), F.concat(
        F.lit("Missing endpoint"), subject, F.lit(": invalid leader_endpoint")))
    skipped = F.when(F.col("_invalid").isNotNull(), F.concat(
        F.lit("Skipped invalid callout at index "), at, F.lit(": "), F.col("_invalid")))
    leader = resolve_leader(F.when(given, checked).otherwise("missing"), F.col("_point"))
    rows = sc.computed(rows, {"valid": F.col("_gate").isNull() & F.col("_invalid").isNull()})
    rows = sc.computed(rows, {
        "bubble_number": F.when(F.col("valid"), sc.scalar_repr(F.col("f_bubble_number"), F.col("f_bubble_number_kind"))),
        "_leader": leader,
        "_before": F.when(F.col("_gate").isNotNull(), F.array("_gate")).otherwise(
            F.filter(F.array(bad_end, leader_warning, skipped), lambda w: w.isNotNull())
        ),
    })
    # Rows of one response only: its text bounds them.
    key = [c for c in REQUEST if c in items.columns]
    earlier = W.partitionBy(*key, "bubble_number").orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    again = F.coalesce(F.max(F.when(F.col("valid"), 1)).over(earlier), F.lit(0)) == 1
    repeated = F.when(F.col("valid") & again, F.concat(
        F.lit("Duplicate bubble number detected: "), F.col("bubble_number")))
    low = F.when(F.col("valid") & sc.is_low_confidence(F.col("confidence_score"), threshold),
                 sc.low_confidence_warning("callout bubble", F.col("bubble_number"), F.col("confidence_score")))
    after = F.filter(F.array(repeated, low), lambda w: w.isNotNull())
    return rows.select(
        *[c for c in items.columns if c != "raw"],
        "valid", "bubble_number",
        F.when(F.col("valid"), F.col("f_location_description")).alias("location_description"),
        F.when(F.col("valid"), F.col("bubble_bbox")).alias("bubble_bbox"),
        "confidence_score",
        F.when(F.col("valid"), F.col("_leader.endpoint")).alias("leader_endpoint"),
        F.when(F.col("valid"), F.col("_leader.status")).alias("leader_line_status"),
        F.concat(F.col("_before"), after).alias("warnings"),
    )


def tiled_callouts(responses: DataFrame, tiles: DataFrame, iou: float = 0.5, threshold: float = LOW_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Callouts of tiled pages on the page scale, and tile-prefixed warnings (E-05).

    Each tile is parsed and checked against its own size, moved to the page and
    deduplicated across tiles. Tiles are joined once; their place goes with the
    rows. A failed tile only warns. Each callout dropped as
    a repeat warns for its page, with a null ``tile``. Responses are parsed
    once: the checked rows, and a row for each response without any, are
    written to the shared folder, and everything after reads them there.
    """
    on = ["doc_id", "page_id", "tile"]
    geometry = dedupe.tile_crops(tiles, "row", "col").withColumns({"tile_w": F.col("crop.width").cast("int"), "tile_h": F.col("crop.height").cast("int")})
    sent = responses.join(geometry.withColumn("_known", F.lit(True)), on, "left")
    items = list_items(parse_json_response(sent), "callouts", outer=True)
    checked = skew.written(validate_callouts(items, threshold, "tile_w", "tile_h"))
    unknown = checked.filter("_known is null and coalesce(index, 0) = 0").select(
        *on, F.concat(F.lit("Response for unknown tile "), F.coalesce("tile", F.lit("(none)")), F.lit(" was not used")).alias("warning"))
    known = checked.filter("_known")
    bare, rows = known.filter("index is null"), known.filter("index is not null")
    # Reading order of tiles, then index: the order callouts entered the page list.
    numbered = rows.filter("valid").withColumn(
        "call_ord", F.struct(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("index").cast("bigint").alias("index"))
    )
    placed = dedupe.moved_to_page(numbered, F.col("crop"), F.col("width"), F.col("height"))
    kept, pairs = dedupe.kept_and_pairs(
        placed.select(
            "doc_id", "page_id", "call_ord", "bubble_number", "location_description",
            "bubble_bbox", "confidence_score", "leader_endpoint", "leader_line_status",
        ),
        iou,
    )
    failed = bare.filter("parse_error is not null").select(
        *on, F.concat(F.lit("Callout detection failed on "), "tile", F.lit(": "), "parse_error").alias("warning")
    )
    not_lists = bare.filter("_field_kind <> 'array'").select(*on, F.concat(
        F.lit("Callout response on "), "tile", F.lit(" 'callouts' was not a list; treated as empty")).alias("warning"))
    rows = rows.select(*on, F.explode("warnings").alias("w")).select(
        *on, F.concat("tile", F.lit(": "), "w").alias("warning")
    )
    repeats = pairs.select("doc_id", "page_id", F.lit(None).cast("string").alias("tile"), "warning")
    return kept, unknown.unionByName(failed).unionByName(not_lists).unionByName(rows).unionByName(repeats)


# --- classification ------------------------------------------------------------------


def parse_classifications(responses: DataFrame) -> DataFrame:
    """Balloon verdicts per crop (G-04).

    The first ``{`` to the last ``}`` is read as JSON. ``is_balloon`` follows
    truthiness; a balloon without a usable number is not one.
    """
    text = F.coalesce("response_text", F.lit(""))
    found = sc.blank_to_null(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    rows = responses.withColumn("_found", found)
    rows = rows.withColumn("_v", F.try_parse_json("_found"))
    rows = sc.with_fields(rows, "_v", ["is_balloon", "number", "confidence"], "f_")
    flag, flag_kind = F.col("f_is_balloon"), F.col("f_is_balloon_kind")
    truthy = (
        F.when(flag_kind == "bool", flag == "true")
        .when(flag_kind.isin("int", "float"), flag.try_cast("double") != 0)
        .when(flag_kind == "string", flag != "")
        .when(flag_kind == "array", flag != "[]")
        .when(flag_kind == "object", flag != "{}")
        .otherwise(False)
    )
    raw, kind = F.col("f_number"), F.col("f_number_kind")
    stripped = sc.strip(raw)
    number = (
        F.when(kind == "bool", F.when(raw == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        .when(kind.isin("int", "float"), raw.try_cast("double").try_cast("bigint"))
        .when((kind == "string") & stripped.rlike(sc.INTEGER_TEXT), stripped.try_cast("bigint"))
    )
    number = F.when(kind == "int", raw.try_cast("bigint")).otherwise(number)
    confidence = sc.clamp_confidence(F.col("f_confidence"), F.col("f_confidence_kind"))
    error = F.when(F.col("_found").isNull(), F.concat(
        F.lit("unparseable response: "), _repr(F.substring(text, 1, 200), F.lit("string"))
    )).when(F.col("_v").isNull(), "invalid JSON")
    return rows.select(
        *[c for c in responses.columns if c != "response_text"],
        (truthy & number.isNotNull()).alias("is_balloon"),
        number.alias("number"),
        F.when(F.col("_v").isNull(), 0.0).otherwise(confidence).alias("confidence"),
        error.alias("error"),
    )


# --- diagnostics ---------------------------------------------------------------------


def extraction_diagnostics(parsed: DataFrame, checked: DataFrame, name: str) -> DataFrame:
    """Per request group: response length, parsed and accepted rows, warnings, errors (K-07).

    ``name`` is the list the stage fills, ``bom_items`` or ``callouts``.
    """
    by = ["doc_id", "page_id", "stage"]
    size = F.when(F.col("_field_kind") == "array", F.size("_items")).otherwise(0)
    sent = _with_list(parsed, name).groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum(F.length(F.coalesce("response_text", F.lit("")))).alias("raw_length"),
        F.sum(size).alias("parsed_count"),
        F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"),
    )
    rows = checked.groupBy(*by).agg(
        F.count_if("valid").alias("validated_count"), F.sum(F.size("warnings")).alias("warnings")
    )
    return sent.join(rows, by, "left").na.fill(0, ["validated_count", "warnings"])
