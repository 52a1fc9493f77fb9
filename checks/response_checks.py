"""Checks of raw model responses, verdicts, files, documents and streams."""

from pyspark.sql import functions as F

from checks.page_checks import ATTACHED, PAGE, box_column, order_callouts, sheets
from checks.registry import FRAGMENTS, check
from checks.scalar_checks import iou_sql
from draftweave.functions import scalars as sc
from draftweave.operators import candidates as cand
from draftweave.operators import dedupe, diff, inventory, responses, tables, verification
from draftweave.sources import extractions
from draftweave.sources.files import document_inventory
from draftweave.streaming.workspaces import current_components, stream_workspaces

KEY = "doc_id, page_id, tile"


def clean_sql(text: str) -> str:
    body = f"regexp_replace(regexp_replace(trim({text}), '^```[^\\r\\n]*(\\r\\n|\\n|\\r|$)', ''), '(^|\\r\\n|\\n|\\r)[ \\t]*```[^\\r\\n]*$', '')"
    return f"trim(case when starts_with(trim({text}), '```') then {body} else {text} end)"


def parsed_sql(source: str) -> str:
    return f"""
    select *, case when parse_error is null then js end as obj from (
      select *, case when trim(response_text) = '' then 'Empty response from vision model'
                     when not json_valid(js) then 'Malformed JSON in vision model response'
                     when json_type(js) <> 'OBJECT' then 'Expected a JSON object from vision model, got ' ||
                          case json_type(js) when 'ARRAY' then 'list' else 'int' end end as parse_error
      from (select *, {clean_sql('response_text')} as js from @{source}))"""


FRAGMENTS["bom_parsed"] = parsed_sql("bom_responses")
FRAGMENTS["call_parsed"] = parsed_sql("call_responses")


@check("g01_parse_json_response", f"select {KEY}, parse_error, json_extract_string(obj, '$.drawing_number') as drawing from @bom_parsed")
def _(t):
    p = responses.parse_json_response(t.bom_responses)
    drawing = sc.variant_text(sc.variant_field(F.col("parsed"), "drawing_number"))
    return p.select("doc_id", "page_id", "tile", "parse_error", drawing.alias("drawing"))


@check("g08_reject_non_list", f"""select {KEY}, 'bom' as stage, 'BOM response ''bom_items'' was not a list; treated as empty' as warning from @bom_parsed
    where obj is not null and json_type(obj, '$.bom_items') <> 'ARRAY'""")
def _(t):
    p = responses.parse_json_response(t.bom_responses)
    return responses.reject_non_list(p, "bom_items", "BOM")


def items_sql(source: str, name: str) -> str:
    return f"""
    select * exclude (rs), rs[index + 1] as r from (
      select *, unnest(range(len(rs))) as index from (
        select *, case when json_type(obj, '$.{name}') = 'ARRAY' then json_extract(obj, '$.{name}[*]') else [] end as rs from @{source} where obj is not null))"""


def num_text(r: str, path: str) -> str:
    """Number of a JSON scalar: numbers and numeric text, booleans as 1 and 0."""
    t, s = f"json_type({r}, '{path}')", f"json_extract_string({r}, '{path}')"
    return f"""case when {t} in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast({s} as double)
        when {t} = 'VARCHAR' and regexp_matches(trim({s}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then cast(trim({s}) as double)
        when {t} = 'BOOLEAN' then case {s} when 'true' then 1.0::double else 0.0::double end end"""


def clamp_sql(r: str, path: str) -> str:
    return f"greatest(0.0::double, least(1.0::double, coalesce({num_text(r, path)}, 0.0::double)))"


FRAGMENTS["bom_items"] = items_sql("bom_parsed", "bom_items")
_Q = "json_extract_string(r, '$.quantity')"
FRAGMENTS["bom_checked"] = f"""
    select *, case when json_type(r) <> 'OBJECT' then 'BOM row is not an object'
                   when it is null then 'item_number is missing' when it <> 'VARCHAR' then 'item_number is not text'
                   when coalesce(qt, 'NULL') <> 'NULL' and quantity is null then 'quantity is not a whole number'
                   when quantity < 0 then 'quantity cannot be negative, got ' || quantity end as reason
    from (select *, json_type(r, '$.item_number') as it, json_type(r, '$.quantity') as qt,
            case json_type(r, '$.quantity')
              when 'VARCHAR' then case when regexp_matches(trim({_Q}), '^[+-]?[0-9]+(\\.0*)?$') then cast(regexp_extract(trim({_Q}), '^[+-]?[0-9]+') as bigint) end
              when 'BOOLEAN' then case {_Q} when 'true' then 1 else 0 end
              when 'DOUBLE' then case when cast({_Q} as double) = floor(cast({_Q} as double)) then cast(cast({_Q} as double) as bigint) end
              when 'UBIGINT' then cast({_Q} as bigint) when 'BIGINT' then cast({_Q} as bigint) end as quantity,
            {clamp_sql('r', '$.confidence_score')} as conf,
            coalesce(json_extract_string(r, '$.material_specification'), json_extract_string(r, '$.material')) as mat
          from @bom_items)"""
BOM_COLUMNS = f"""{KEY}, index, reason is null as valid, json_extract_string(r, '$.item_number') as item_number, quantity, mat as material_specification, conf as confidence_score,
    case when reason is not null then 'Skipped invalid BOM row at index ' || index || ': ' || reason
         when conf < 0.7 then 'Low confidence extraction for BOM item ' || json_extract_string(r, '$.item_number') || ' (confidence=' || printf('%.2f', conf) || ')' else '' end as warnings"""


def bom_checked(t):
    return responses.validate_bom_items(responses.list_items(responses.parse_json_response(t.bom_responses), "bom_items"))


def _joined(frame):
    return frame.withColumn("warnings", F.array_join("warnings", " / "))


@check("g02_validate_bom_items", f"select {BOM_COLUMNS} from @bom_checked", bench=True)
def _(t):
    return _joined(bom_checked(t)).select("doc_id", "page_id", "tile", "index", "valid", "item_number", "quantity", "material_specification", "confidence_score", "warnings")


@check("f02_valid_bom_rows", f"select {KEY}, index, quantity from @bom_checked where reason is null")
def _(t):
    return bom_checked(t).filter("valid").select("doc_id", "page_id", "tile", "index", "quantity")


@check("p24_strip_forbidden_names", f"select {KEY}, index, null::varchar as part_name, mat as material_specification from @bom_checked where reason is null")
def _(t):
    return bom_checked(t).filter("valid").select("doc_id", "page_id", "tile", "index", "part_name", "material_specification")


@check("g09_row_shape_guard", f"select {KEY}, index, 'Skipped invalid BOM row at index ' || index || ': ' || reason as warning from @bom_checked where json_type(r) <> 'OBJECT'")
def _(t):
    guarded = bom_checked(t).filter(~F.col("valid")).select("doc_id", "page_id", "tile", "index", F.explode("warnings").alias("warning"))
    return guarded.filter(F.col("warning").endswith("BOM row is not an object"))


# --- callouts --------------------------------------------------------------------------

FRAGMENTS["call_items"] = items_sql("call_parsed", "callouts")
FRAGMENTS["call_fields"] = f"""
    select *, case when bj is not null then {num_text('bj', '$.xmin')} end as bx0, case when bj is not null then {num_text('bj', '$.ymin')} end as by0,
           case when bj is not null then {num_text('bj', '$.xmax')} end as bx1, case when bj is not null then {num_text('bj', '$.ymax')} end as by1
    from (select *, json_type(r) as shape, json_extract_string(r, '$.bubble_number') as bubble, json_type(r, '$.bubble_number') as bt,
            case when json_type(r) <> 'OBJECT' then '?' when json_type(r, '$.bubble_number') = 'VARCHAR' then '''' || json_extract_string(r, '$.bubble_number') || ''''
                 else coalesce(json_extract_string(r, '$.bubble_number'), 'None') end as label,
            {clamp_sql('r', '$.confidence_score')} as conf,
            case when json_type(r, '$.bubble_bbox') = 'OBJECT' then json_extract(r, '$.bubble_bbox') when json_type(r, '$.bounding_box') = 'OBJECT' then json_extract(r, '$.bounding_box') end as bj,
            json_type(r, '$.leader_line_status') is not null or json_type(r, '$.leader_endpoint') is not null as given,
            json_extract_string(r, '$.leader_line_status') as sraw, coalesce(nullif(lower(trim(json_extract_string(r, '$.leader_line_status'))), ''), 'missing') as st,
            json_type(r, '$.leader_endpoint') = 'OBJECT' as pointed, {num_text('r', '$.leader_endpoint.x')} as ex, {num_text('r', '$.leader_endpoint.y')} as ey
          from @call_items)"""
_PX = lambda e, s: f"case when bx0 between 0 and 1000 and by0 between 0 and 1000 and bx1 between 0 and 1000 and by1 between 0 and 1000 then {e} else greatest(0.0::double, least(1000.0::double, {e} / {s} * 1000.0::double)) end"
FRAGMENTS["call_boxed"] = f"""
    select *, x1 > x0 and y1 > y0 as box_ok from (select *, {_PX('bx0', 'width')} as x0, {_PX('by0', 'height')} as y0, {_PX('bx1', 'width')} as x1, {_PX('by1', 'height')} as y1,
      coalesce(bx0 is not null and by0 is not null and bx1 is not null and by1 is not null, false) as numbers from @call_fields)"""
FRAGMENTS["call_gated"] = """
    select *, case when shape <> 'OBJECT' then 'Skipped invalid callout at index ' || index || ': callout row is not an object'
        when conf < 0.85 then 'Skipped callout at index ' || index || ' (bubble=' || label || '): confidence ' || printf('%.2f', conf) || ' below minimum 0.85'
        when bj is null then 'Malformed bubble_bbox for callout at index ' || index || ' (bubble=' || label || '): malformed bubble_bbox: missing or not an object'
        when not numbers then 'Malformed bubble_bbox for callout at index ' || index || ' (bubble=' || label || '): box edge missing or not a number'
        when not box_ok then 'Malformed bubble_bbox for callout at index ' || index || ' (bubble=' || label || '): box out of range or out of order'
        when st not in ('clear', 'unclear', 'missing') then 'Skipped invalid callout at index ' || index || ': leader_line_status must be one of [''clear'', ''missing'', ''unclear''], got ''' || sraw || ''''
        end as gate, case when bt is null then 'Skipped invalid callout at index ' || index || ': ''bubble_number''' end as late
    from @call_boxed"""
FRAGMENTS["call_checked"] = """
    select *, gate is null and late is null as valid, case when gate is null and late is null then coalesce(bubble, 'None') end as number,
        case when gate is not null or not given then null
             when st = 'unclear' and coalesce(pointed, false) then 'Unclear leader line for callout bubble ' || label || ': endpoint discarded (do not invent a target)'
             when st = 'unclear' then 'Unclear leader line for callout bubble ' || label
             when st = 'missing' and coalesce(pointed, false) then 'Missing endpoint for callout bubble ' || label || ': endpoint discarded because leader_line_status is ''missing'''
             when st = 'missing' then 'Missing endpoint for callout bubble ' || label
             when st = 'clear' and not coalesce(pointed, false) then 'Missing endpoint for callout bubble ' || label || ': leader_line_status was ''clear'' but leader_endpoint was null; downgraded to ''missing'''
        end as leader_warning,
        case when not given then 'missing' when st = 'clear' and not coalesce(pointed, false) then 'missing' else st end as leader_status
    from @call_gated"""
FRAGMENTS["call_final"] = f"""
    select *, row_number() over (partition by {KEY}, number order by index) > 1 as again from @call_checked where valid
    union all by name select *, false as again from @call_checked where not valid"""
CALL_WARNINGS = """concat_ws(' / ', gate, leader_warning, case when gate is null then late end,
    case when valid and again then 'Duplicate bubble number detected: ' || number end,
    case when valid and conf < 0.9 then 'Low confidence extraction for callout bubble ' || number || ' (confidence=' || printf('%.2f', conf) || ')' end)"""


def call_checked(t):
    parsed = responses.parse_json_response(t.call_responses)
    return responses.validate_callouts(responses.list_items(parsed, "callouts"), 0.9, "width", "height")


@check("g03_validate_callouts", f"""select {KEY}, index, valid, number as bubble_number, case when valid then x0 end as xmin, case when valid then y1 end as ymax, conf as confidence_score,
    case when valid then leader_status end as leader_line_status, case when valid and leader_status = 'clear' then ex end as end_x, {CALL_WARNINGS} as warnings from @call_final""", bench=True)
def _(t):
    return _joined(call_checked(t)).select(
        "doc_id", "page_id", "tile", "index", "valid", "bubble_number", F.col("bubble_bbox.xmin").alias("xmin"), F.col("bubble_bbox.ymax").alias("ymax"),
        "confidence_score", "leader_line_status", F.col("leader_endpoint.x").alias("end_x"), "warnings")


@check("g06_resolve_leader", f"select {KEY}, index, leader_status as leader_line_status, case when leader_status = 'clear' then ey end as end_y from @call_final where valid")
def _(t):
    return call_checked(t).filter("valid").select("doc_id", "page_id", "tile", "index", "leader_line_status", F.col("leader_endpoint.y").alias("end_y"))


@check("f01_drop_low_confidence_callouts", f"select {KEY}, index, gate as warning from @call_final where shape = 'OBJECT' and conf < 0.85")
def _(t):
    rows = call_checked(t).filter(F.col("confidence_score") < responses.CALLOUT_MIN_CONFIDENCE)
    rows = rows.select("doc_id", "page_id", "tile", "index", F.explode("warnings").alias("warning"))
    return rows.filter(F.col("warning").startswith("Skipped callout at index"))


@check("w03_duplicate_bubble_warning", f"select {KEY}, index, 'Duplicate bubble number detected: ' || number as warning from @call_final where again")
def _(t):
    rows = call_checked(t).select("doc_id", "page_id", "tile", "index", F.explode("warnings").alias("warning"))
    return rows.filter(F.col("warning").startswith("Duplicate bubble number"))


@check("k07_extraction_diagnostics", f"""select p.doc_id, p.page_id, p.stage, p.responses, p.raw_length, p.parsed_count, p.parse_errors, coalesce(c.validated_count, 0) as validated_count, coalesce(c.warnings, 0) as warnings
    from (select doc_id, page_id, stage, count(*) as responses, sum(length(response_text)) as raw_length,
            sum(case when json_type(obj, '$.bom_items') = 'ARRAY' then json_array_length(obj, '$.bom_items') else 0 end) as parsed_count, count(parse_error) as parse_errors from @bom_parsed group by all) p
    left join (select doc_id, page_id, stage, count(*) filter (reason is null) as validated_count, count(*) filter (reason is not null or conf < 0.7) as warnings from @bom_checked group by all) c
      on p.doc_id = c.doc_id and p.page_id = c.page_id""")
def _(t):
    parsed = responses.parse_json_response(t.bom_responses)
    checked = responses.validate_bom_items(responses.list_items(parsed, "bom_items"))
    return responses.extraction_diagnostics(parsed, checked, "bom_items")


@check("u04_pages_union", f"""select doc_id, 'bom' as kind, count(*) as n from @bom_checked where reason is null group by all
    union all select doc_id, 'callout', count(*) from @call_final where valid group by all""")
def _(t):
    b = bom_checked(t).filter("valid").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("bom"))
    c = call_checked(t).filter("valid").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("callout"))
    return b.unionByName(c)


@check("a17_collect_warnings", f"""select doc_id, row_number() over (partition by doc_id order by page_id, tile, index) as position, page_id || ' (title block): ' || w as warning from (
    select doc_id, page_id, tile, index, case when reason is not null then 'Skipped invalid BOM row at index ' || index || ': ' || reason
      when conf < 0.7 then 'Low confidence extraction for BOM item ' || json_extract_string(r, '$.item_number') || ' (confidence=' || printf('%.2f', conf) || ')' end as w from @bom_checked)
    where w is not null""")
def _(t):
    rows = bom_checked(t).select("doc_id", "page_id", "tile", "index", F.lit("title block").alias("source"), F.explode("warnings").alias("warning"))
    return diff.collect_warnings(rows, [F.col("page_id"), F.col("tile"), F.col("index")])


# --- tiles -----------------------------------------------------------------------------


def tile_callouts(t):
    return responses.tiled_callouts(t.tile_responses, dedupe.tiles(t.sheets))


_TILE = lambda e, o, s, p: f"greatest(0.0::double, least(1000.0::double, ({o}::double + {e} / 1000.0::double * {s}::double) / {p} * 1000.0::double)) as {e}"
FRAGMENTS["tile_boxes"] = f"""
    select i.doc_id, i.page_id, json_extract_string(r, '$.bubble_number') as bubble_number, {clamp_sql('r', '$.confidence_score')} as confidence_score,
           (g.row * 1000 + g.col) * 1000000000::bigint + index as call_ord,
           {_TILE('xmin', 'g.x0', '(g.x1 - g.x0)', 'g.width')}, {_TILE('ymin', 'g.y0', '(g.y1 - g.y0)', 'g.height')},
           {_TILE('xmax', 'g.x0', '(g.x1 - g.x0)', 'g.width')}, {_TILE('ymax', 'g.y0', '(g.y1 - g.y0)', 'g.height')}
    from (select *, {num_text('r', '$.bubble_bbox.xmin')} as xmin, {num_text('r', '$.bubble_bbox.ymin')} as ymin,
            {num_text('r', '$.bubble_bbox.xmax')} as xmax, {num_text('r', '$.bubble_bbox.ymax')} as ymax from @tile_items) i
    join @tile_grid g on i.doc_id = g.doc_id and i.page_id = g.page_id and i.tile = g.tile"""
FRAGMENTS["tile_parsed"] = parsed_sql("tile_responses")
FRAGMENTS["tile_items"] = items_sql("tile_parsed", "callouts")
# The fixture gives each page at most two detections per number that overlap, so one comparison decides.
FRAGMENTS["tile_ranked"] = "select *, row_number() over (partition by doc_id, page_id, bubble_number order by confidence_score desc, call_ord) as rk from @tile_boxes"
FRAGMENTS["tile_kept"] = f"""
    select * from @tile_ranked a where not exists (select 1 from @tile_ranked b
      where a.doc_id = b.doc_id and a.page_id = b.page_id and a.bubble_number = b.bubble_number and b.rk < a.rk and ({iou_sql('b.', 'a.')}) >= 0.5)"""


@check("e05_tiled_callouts", f"select {PAGE}, bubble_number, call_ord, confidence_score, xmin, ymax from @tile_kept", bench=True)
def _(t):
    kept, _ = tile_callouts(t)
    at = F.col("call_ord")
    number = ((at["row"] * 1000 + at["col"]) * 1_000_000_000 + at["index"]).alias("call_ord")
    return kept.select("doc_id", "page_id", "bubble_number", number, "confidence_score", F.col("bubble_bbox.xmin").alias("xmin"), F.col("bubble_bbox.ymax").alias("ymax"))


@check("e05b_tile_warnings", f"select {KEY}, 'Callout detection failed on ' || tile || ': ' || parse_error as warning from @tile_parsed where parse_error is not null")
def _(t):
    return tile_callouts(t)[1].filter("tile is not null")


@check("e05c_all_tile_warnings", f"""select {KEY}, 'Callout detection failed on ' || tile || ': ' || parse_error as warning from @tile_parsed where parse_error is not null
    union all select a.doc_id, a.page_id, null::varchar, 'Deduplicated overlapping callout bubble ''' || a.bubble_number || ''': kept confidence=' || printf('%.2f', b.confidence_score)
      || ', dropped confidence=' || printf('%.2f', a.confidence_score) || ' (IoU>=0.5)'
    from @tile_ranked a join @tile_kept b on a.doc_id = b.doc_id and a.page_id = b.page_id and a.bubble_number = b.bubble_number and b.rk < a.rk and ({iou_sql('b.', 'a.')}) >= 0.5""")
def _(t):
    return tile_callouts(t)[1]


# --- classification -----------------------------------------------------------------------

_N = "json_extract_string(js, '$.number')"
FRAGMENTS["verdicts"] = f"""
    select doc_id, page_id, crop_id, coalesce(truthy and number is not null, false) as is_balloon, number, case when js is null then 0.0::double else {clamp_sql('js', '$.confidence')} end as confidence,
           case when found is null then 'unparseable response: ''' || response_text || '''' when js is null then 'invalid JSON' end as error
    from (select *, case json_type(js, '$.is_balloon') when 'BOOLEAN' then json_extract_string(js, '$.is_balloon') = 'true' when 'VARCHAR' then json_extract_string(js, '$.is_balloon') <> ''
                         when 'UBIGINT' then json_extract_string(js, '$.is_balloon') <> '0' else false end as truthy,
                 case json_type(js, '$.number') when 'UBIGINT' then cast({_N} as bigint) when 'DOUBLE' then cast(trunc(cast({_N} as double)) as bigint)
                      when 'VARCHAR' then try_cast({_N} as bigint) end as number
          from (select *, case when json_valid(found) then found end as js from (
            select *, nullif(regexp_extract(response_text, '(?s)\\{{.*\\}}'), '') as found from @crop_responses)))"""


@check("g04_parse_classification", f"select {PAGE}, crop_id, is_balloon, number, confidence, error from @verdicts", bench=True)
def _(t):
    return responses.parse_classifications(t.crop_responses)


@check("j07_attach_classification", ATTACHED)
def _(t):
    found = cand.select_candidates(t.contours, t.sheets)
    out = cand.attach_classification(found, responses.parse_classifications(t.crop_responses), sheets(t))
    return out.select("doc_id", "page_id", "crop_id", "call_ord", "bubble_number", "confidence_score", "bounding_box.xmin", "bounding_box.ymax")


@check("a13_stage_counts", """select coalesce(coalesce(a.doc_id, b.doc_id), c.doc_id) as doc_id, coalesce(x, 0) as bom_rows_extracted, coalesce(y, 0) as callout_candidates_detected, coalesce(z, 0) as classified_as_balloons
    from (select doc_id, count(*) as x from @vector_rows group by all) a full join (select doc_id, count(*) as y from @picked group by all) b on a.doc_id = b.doc_id
    full join (select doc_id, count(*) as z from @verdicts where is_balloon group by all) c on coalesce(a.doc_id, b.doc_id) = c.doc_id""")
def _(t):
    return cand.stage_counts(tables.rows_from_cell_tables(t.cell_tables), cand.select_candidates(t.contours), responses.parse_classifications(t.crop_responses))


# --- verification ---------------------------------------------------------------------------

FRAGMENTS["judged"] = """
    select *, case when problem is not null then 'failed' when outside or v = 'false' then 'invalid' else 'valid' end as verdict from (
      select *, case when parse_error is not null then parse_error when outside then null
                     when v = 'true' and (ep is null or num is null) then 'valid verdict is incomplete' end as problem
      from (select *, json_extract_string(obj, '$.valid') as v, json_extract_string(obj, '$.reason') as why, json_extract_string(obj, '$.bubble_number') as num,
              json_extract_string(obj, '$.leader_visible') as lv, json_extract_string(obj, '$.endpoint_visible') as ep, cast(json_extract_string(obj, '$.confidence_score') as double) as score,
              coalesce(json_extract_string(obj, '$.valid') = 'true' and json_extract_string(obj, '$.bbox_surrounds_bubble') = 'false', false) as outside from @judged_parsed))"""
FRAGMENTS["judged_parsed"] = parsed_sql("verdict_responses")


@check("g05_parse_verification", f"""select {PAGE}, call_ord, verdict, case when verdict = 'invalid' then coalesce(why, case when outside then 'Proposed bounding box does not surround the bubble' end, 'Verification rejected without a reason') end as reason,
    case when verdict = 'valid' then num end as new_number, case when verdict = 'valid' then score end as new_confidence, problem from @judged""")
def _(t):
    return verification.parse_verifications(t.verdict_responses).drop("leader_visible", "endpoint_visible")


@check("j13_apply_verification", f"""select c.doc_id, c.page_id, c.call_ord, case when v = 'valid' then num else bubble_number end as bubble_number,
    case when v = 'valid' then score else confidence_score::double end as confidence_score,
    case when v = 'valid' and lv = 'false' then null else location_description end as location_description,
    case when v = 'valid' then case when lv = 'true' and ep = 'true' and end_x is not null then 'clear' when lv = 'false' then 'missing' else 'unclear' end else leader_line_status end as leader_line_status,
    case when v = 'valid' and not (lv = 'true' and ep = 'true' and end_x is not null) then null else end_x end as end_x, v <> 'invalid' as kept,
    case v when 'failed' then 'Callout verification failed for bubble ''' || bubble_number || '''; keeping original detection (' || coalesce(problem, 'no verdict') || ')'
           when 'invalid' then 'Rejected callout bubble ''' || bubble_number || ''' after verification: ' || coalesce(why, case when outside then 'Proposed bounding box does not surround the bubble' end, 'Verification rejected without a reason')
           else case when num <> bubble_number then 'Verification corrected bubble number ''' || bubble_number || ''' -> ''' || num || '''' end end as warning
    from @order_callouts c left join (select * exclude (verdict, v), verdict as v0 from @judged) j using (doc_id, page_id, call_ord), lateral (select coalesce(v0, 'failed') as v) z""")
def _(t):
    out = verification.apply_verification(order_callouts(t), verification.parse_verifications(t.verdict_responses))
    return out.select("doc_id", "page_id", "call_ord", "bubble_number", "confidence_score", "location_description", "leader_line_status",
                      F.col("leader_endpoint.x").alias("end_x"), "kept", "warning")


# --- files and documents ----------------------------------------------------------------------

_EXT = "lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1))"
FRAGMENTS["checked_files"] = f"""
    select *, case when error is null then null when contains(error, 'Unsupported') then 'UNSUPPORTED_FORMAT' when error = 'File is empty.' then 'EMPTY_FILE'
        when starts_with(error, 'File does not exist') then 'FILE_NOT_FOUND' when contains(error, 'valid PDF') then 'INVALID_PDF' else 'CORRUPT_IMAGE' end as code
    from (select *, case when length is null then 'File does not exist: ' || path when length = 0 then 'File is empty.'
        when ext not in ('.pdf', '.png', '.jpg', '.jpeg') then 'Unsupported file type ''' || ext || '''. Allowed: .jpeg, .jpg, .pdf, .png'
        when ext = '.pdf' and not starts_with(header_hex, '25504446') then 'File extension is .pdf but content is not a valid PDF.'
        when ext = '.png' and starts_with(header_hex, 'FFD8FF') then 'File extension is .png but content is not a PNG.'
        when ext in ('.jpg', '.jpeg') and starts_with(header_hex, '89504E47') then 'File extension is ' || ext || ' but content is not a JPEG.'
        when ext = '.png' and not starts_with(header_hex, '89504E470D0A1A0A') or ext in ('.jpg', '.jpeg') and not starts_with(header_hex, 'FFD8FF')
          then 'File could not be opened as a valid ' || upper(ext[2:]) || ' image.' end as error
    from (select *, {_EXT} as ext from @files))"""


def files(t):
    return t.files.withColumn("header", F.unhex("header_hex")).drop("header_hex")


@check("f09_file_checks", "select doc_id, path, error, error is null as valid, code as error_code from @checked_files")
def _(t):
    return inventory.file_checks(files(t)).select("doc_id", "path", "error", "valid", "error_code")


@check("s03_drawing_files", "select path, length, case when length > 0 and ext in ('.pdf', '.png', '.jpg', '.jpeg') then ext[2:] end as file_type, 'doc_' || substr(sha256(path), 1, 8) as document_id from @checked_files")
def _(t):
    return inventory.file_checks(files(t)).select("path", "length", "file_type", "document_id")


def _written(folder):
    """Task that writes each row's content under its name."""
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            store, place = fs.FileSystem.from_uri(folder)
            store.create_dir(place, recursive=True)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{place}/{name}") as out:
                    out.write(content)
            yield batch.slice(0, 0)
    return run


@check("s03b_read_files", """select f.doc_id, case when f.length = 0 then 0 else length(f.header_hex) // 2 + strlen(html) end as length,
    case when f.length = 0 then '' else substr(f.header_hex || hex(encode(substr(html, 1, 8))), 1, 16) end as header, c.error is null as valid
    from @files f join @pages on page_id = f.doc_id join @checked_files c on c.doc_id = f.doc_id where f.length is not null""")
def _(t):
    named = t.files.filter("length is not null").join(t.shared("pages"), F.col("doc_id") == F.col("page_id"))
    content = F.when(F.col("length") == 0, F.lit(b"")).otherwise(F.concat(F.unhex("header_hex"), F.col("html").cast("binary")))
    folder = f"file:{t.scratch}/drawings" if t.scratch.startswith("/") else f"{t.scratch}/drawings"
    named.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), content.alias("content")).mapInArrow(
        _written(folder), "name string, content binary").write.format("noop").mode("overwrite").save()
    found = document_inventory(t.spark, folder)
    number = F.regexp_extract("path", r"/([0-9]+)[^/]*$", 1).cast("bigint")
    return found.select(number.alias("doc_id"), "length", F.hex("header").alias("header"), "valid")


@check("f12_allowed_upload", f"""select doc_id, path, ext in ('.pdf', '.png', '.jpg', '.jpeg') as allowed, case when ext not in ('.pdf', '.png', '.jpg', '.jpeg')
    then 'Unsupported file type ''' || coalesce(nullif(ext, ''), '(none)') || '''. Allowed: .jpeg, .jpg, .pdf, .png' end as detail from (select *, {_EXT} as ext from @files)""")
def _(t):
    return inventory.allowed_upload(t.files).select("doc_id", "path", "allowed", "detail")


def documents(t):
    return t.shared("orders").select(F.floor(F.col("o_orderkey") / 64).alias("doc_id"), F.lit(4).alias("page_count")).distinct()


DOCS = "(select distinct cast(floor(o_orderkey / 64) as bigint) as doc_id, 4 as page_count from @orders) d"


@check("a14_document_status", f"""select d.doc_id, coalesce(good, 0) as page_count, coalesce(bad, 0) as page_error_count, case when coalesce(good, 0) = 0 then 'failed' when bad > 0 then 'partial' else 'processed' end as status
    from {DOCS} left join (select doc_id, count(*) filter (error is null) as good, count(error) as bad from @sheets group by all) p on d.doc_id = p.doc_id""")
def _(t):
    return inventory.document_status(documents(t).drop("page_count"), t.sheets)


@check("a15_first_metadata", """select doc_id, arg_min(drawing_number, page_number) filter (coalesce(drawing_number, '') <> '') as drawing_number,
    arg_min(revision, page_number) filter (coalesce(revision, '') <> '') as revision from @sheets group by all""")
def _(t):
    return inventory.first_metadata(t.sheets)


@check("a18_pages_processed", f"select d.doc_id, d.page_count, coalesce(n, 0) as pages_processed, d.page_count = coalesce(n, 0) as consistent from {DOCS} left join (select doc_id, count(*) as n from @sheets group by all) p on d.doc_id = p.doc_id")
def _(t):
    return inventory.pages_processed(documents(t), t.sheets)


@check("a19_page_errors", "select doc_id, page_number, 'IMAGE_PROCESSING_ERROR' as code, 'page_' || lpad(cast(page_number as varchar), 3, '0') || ': ' || error as message, 'page' as field from @sheets where error is not null")
def _(t):
    return inventory.page_errors(t.sheets.withColumn("error_code", F.lit(None).cast("string")))


@check("a14b_pipeline_status", f"""select d.doc_id, coalesce(n, 0) as pipeline_error_count, case when coalesce(good, 0) = 0 then 'failed' when n > 0 then 'partial' else 'ok' end as pipeline_status
    from {DOCS} left join (select doc_id, count(*) filter (error is null) as good, count(error) as n from @sheets group by all) p on d.doc_id = p.doc_id""")
def _(t):
    docs = inventory.document_status(documents(t).drop("page_count"), t.sheets)
    errors = inventory.page_errors(t.sheets.withColumn("error_code", F.lit(None).cast("string")))
    return inventory.pipeline_status(docs, errors).select("doc_id", "pipeline_error_count", "pipeline_status")


# --- stored inputs -------------------------------------------------------------------------------

EXTRACTED_BOM = """select doc_id, json_extract_string(json, '$.page_id') as page_id, index,
    case json_extract_string(r, '$.item_number') when '3.0' then '3' else json_extract_string(r, '$.item_number') end as item_number,
    case json_type(r, '$.item_number') when 'DOUBLE' then 'float' when 'UBIGINT' then 'int' when 'BOOLEAN' then 'bool' else 'string' end as item_kind,
    json_extract_string(r, '$.part_number') as part_number,
    case json_type(r, '$.quantity') when 'UBIGINT' then cast(json_extract_string(r, '$.quantity') as bigint) when 'VARCHAR' then 4
         else case json_extract_string(r, '$.quantity') when '4.0' then 4 end end as quantity, cast(json_extract_string(r, '$.confidence_score') as double) as confidence_score
    from (select *, json_extract(json, '$.bom_items[*]')[index + 1] as r from (select *, unnest(range(2)) as index from @extractions))"""


def stored_extractions(t):
    t.extractions.select("json").write.text(f"{t.scratch}/extractions")
    return extractions.read_extractions(t.spark, f"{t.scratch}/extractions")


@check("s01_read_extractions", EXTRACTED_BOM)
def _(t):
    rows = extractions.bom_rows(stored_extractions(t))
    return rows.select("doc_id", "page_id", F.col("bom_ord.p0").alias("index"), "item_number", "item_kind", "part_number", "quantity", "confidence_score")


@check("s01b_read_callouts", """select doc_id, json_extract_string(json, '$.callouts[0].bubble_number') as bubble_number, case cast(doc_id as bigint) % 3 when 0 then 10.0::double when 1 then 1.0::double end as xmin,
    case cast(doc_id as bigint) % 3 when 0 then 40.0::double when 1 then 4.5::double end as ymax from @extractions""")
def _(t):
    rows = extractions.callout_rows(stored_extractions(t))
    return rows.select("doc_id", "bubble_number", F.col("bubble_bbox.xmin").alias("xmin"), F.col("bubble_bbox.ymax").alias("ymax"))


@check("s04_read_responses", "select cast(doc_id as varchar) as doc_id, page_id, stage, tile, response_text from @bom_responses")
def _(t):
    t.bom_responses.withColumn("doc_id", F.col("doc_id").cast("string")).write.json(f"{t.scratch}/responses")
    return extractions.read_responses(t.spark, f"{t.scratch}/responses").drop("crop_id")


@check("s05_read_words", "select doc_id, page_id, region_id, word_ord, text from @words")
def _(t):
    t.words.write.parquet(f"{t.scratch}/words")
    return extractions.read_table(t.spark, f"{t.scratch}/words").select("doc_id", "page_id", "region_id", "word_ord", "text")


STREAMED = f"""select doc_id, item_number, link_status, count(*) as n from (
    select coalesce(b.doc_id, c.doc_id) as doc_id, b.key as item_number, case when b.key is null and b.doc_id is not null then 'ambiguous' when b.doc_id is null then 'callout_only' when c.doc_id is null then 'bom_only' else 'matched' end as link_status
    from (select *, count(*) over (partition by doc_id, key) as n, row_number() over (partition by doc_id, key order by index) as rn from (
            select doc_id, index, case when item_kind = 'bool' then null else coalesce(nullif(ltrim(item_number, '0'), ''), '0') end as key from ({EXTRACTED_BOM}))) b
    full join (select doc_id, json_extract_string(json, '$.callouts[0].bubble_number') as key from @extractions) c on b.doc_id = c.doc_id and b.key = c.key and (b.n = 1 or b.rn = 1)) group by all"""


@check("r01_stream_workspaces", STREAMED)
def _(t):
    items = F.regexp_replace("json", '"callouts":.*,"extraction_warnings"', '"callouts":[],"extraction_warnings"')
    bubbles = F.regexp_replace(F.regexp_replace("json", '"bom_items":.*,"callouts"', '"bom_items":[],"callouts"'), '"page_id":"page_00', '"page_id":"page_01')
    for pages in (items, bubbles, F.lit("{broken")):
        t.extractions.select(pages.alias("json")).distinct().repartition(1).write.mode("append").text(f"{t.scratch}/arriving")
    stream_workspaces(
        t.spark, f"{t.scratch}/arriving", f"{t.scratch}/out", f"{t.scratch}/progress", available_now=True, files_per_batch=1).awaitTermination()
    rows = current_components(t.spark, f"{t.scratch}/out")
    return rows.groupBy("doc_id", "item_number", "link_status").agg(F.count(F.lit(1)).alias("n"))
