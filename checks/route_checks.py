"""Checks of whole routes: measured pages, and raw responses, to linked components."""

import re

from pyspark.sql import functions as F

from checks.page_checks import _origin, sheets, words
from checks.registry import FRAGMENTS, check
from draftweave.plans.hybrid import run_hybrid
from draftweave.plans.vision import extractions_from_responses


def rebased(name: str, prefix: str, **swapped: str) -> None:
    """Fragment ``prefix + name``: the named one over other inputs, with all that stands on these."""
    made = {}

    def moved(text: str) -> str:
        return re.sub(r"@([a-z_]+)", lambda m: "@" + seen(m[1]), text)

    def seen(n: str) -> str:
        if n in swapped:
            return swapped[n]
        if n not in FRAGMENTS:
            return n
        if n not in made:
            made[n] = n
            text = moved(FRAGMENTS[n])
            if text != FRAGMENTS[n]:
                made[n] = prefix + n
                FRAGMENTS[prefix + n] = text
        return made[n]

    seen(name)


# --- measured pages ------------------------------------------------------------------

FRAGMENTS["hybrid_bom"] = """
    select doc_id, page_id, row_number() over (partition by doc_id order by page_id, row_ord) as bom_ord, item_no as item_number, 'string' as item_kind,
           part_number, null::varchar as part_name, coalesce(description, '') as description, qty as quantity, material as material_specification,
           null::varchar as material, null::varchar as revision, null::double as confidence_score
    from @best_source where source_kind = first_kind and source_ord = first_ord"""
FRAGMENTS["hybrid_calls"] = f"""
    select c.doc_id, c.page_id, row_number() over (partition by c.doc_id order by c.page_id, contour_ord) as call_ord, 'string' as bubble_kind,
           cast(r.number as varchar) as bubble_number, '' as location_description, r.confidence as confidence_score,
           {_origin('xmin', 'dx0', 'width')}, {_origin('ymin', 'dy0', 'height')}, {_origin('xmax', 'dx0', 'width')}, {_origin('ymax', 'dy0', 'height')}
    from @placed_candidates c join @verdicts r on c.doc_id = r.doc_id and c.crop_id = r.crop_id where r.is_balloon and r.number is not null"""
rebased("comp", "hybrid_", bom="hybrid_bom", callouts="hybrid_calls")


def hybrid(t):
    return run_hybrid(words(t), t.segments, t.cell_tables, t.contours, t.crop_responses, sheets(t), t.digits)


@check("h01_hybrid_components", """select doc_id, seq, link_status, item as item_number, bubble as bubble_number, part_number, descr as description, quantity,
    conf as confidence_score, xmin, ymax from @hybrid_comp""")
def _(t):
    c = hybrid(t).workspace().components
    return c.select(
        "doc_id", "seq", "link_status", "item_number", "bubble_number", "part_number", "description", "quantity", "confidence_score",
        F.col("bounding_box.xmin").alias("xmin"), F.col("bounding_box.ymax").alias("ymax"))


@check("h02_hybrid_difference", """select coalesce(b.doc_id, c.doc_id) as doc_id, coalesce(b.key, c.key) as key,
    case when c.key is null then 'missing' when b.key is null then 'extra' else 'matched' end as kind, coalesce(bom_count, 0) as bom_count, coalesce(balloon_count, 0) as balloon_count
    from (select doc_id, key, count(*) as bom_count from @hybrid_keyed_bom group by all) b
    full join (select doc_id, cast(number as varchar) as key, count(*) as balloon_count from @verdicts r join (select doc_id, crop_id from @picked) p using (doc_id, crop_id)
               where is_balloon and number is not null group by all) c on b.doc_id = c.doc_id and b.key = c.key""")
def _(t):
    return hybrid(t).difference


@check("h03_hybrid_counts", """select doc_id, coalesce(a, 0) as bom_rows_extracted, coalesce(b, 0) as callout_candidates_detected, coalesce(c, 0) as classified_as_balloons
    from (select doc_id, count(*) as a from @hybrid_bom group by all) full join (select doc_id, count(*) as b from @picked group by all) using (doc_id)
    full join (select doc_id, count(*) as c from @verdicts where is_balloon group by all) using (doc_id)""")
def _(t):
    return hybrid(t).stage_counts


# --- raw responses -------------------------------------------------------------------


def extracted(t):
    raw = t.bom_responses.unionByName(t.call_responses.drop("width", "height"))
    return extractions_from_responses(raw, sheets(t))


@check("v01_response_failures", """select doc_id, page_id, tile, 0 as step, 'BOM extraction failed: ' || parse_error as warning from @bom_parsed where parse_error is not null
    union all select doc_id, page_id, tile, 1, 'Callout detection failed: ' || parse_error from @call_parsed where parse_error is not null
    union all select doc_id, page_id, tile, 0, 'BOM response ''bom_items'' was not a list; treated as empty' from @bom_parsed where obj is not null and json_type(obj, '$.bom_items') <> 'ARRAY'
    union all select doc_id, page_id, tile, 1, 'Callout response ''callouts'' was not a list; treated as empty' from @call_parsed where obj is not null and json_type(obj, '$.callouts') <> 'ARRAY'""")
def _(t):
    return extracted(t).warnings.filter("index = -1").select("doc_id", "page_id", "tile", "step", "warning")


@check("v02_response_bom", """select doc_id, page_id, tile, index, json_extract_string(r, '$.item_number') as item_number, quantity, conf as confidence_score from @bom_checked where reason is null""")
def _(t):
    rows = extracted(t).bom
    return rows.select("doc_id", F.col("bom_ord.page_id").alias("page_id"), F.col("bom_ord.p0").alias("tile"), F.col("bom_ord.p1").alias("index"),
                       "item_number", "quantity", "confidence_score")
