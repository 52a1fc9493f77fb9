"""Checks of work on page contents: tiles, overlaps, candidates and tables."""

from pyspark.sql import functions as F

from checks.registry import FRAGMENTS, check
from checks.scalar_checks import iou_sql
from draftweave.functions import geometry as geo
from draftweave.operators import candidates as cand
from draftweave.operators import dedupe, nearest, selection, skew, tables

PAGE = "doc_id, page_id"


def box_column(frame):
    return frame.withColumn("bubble_bbox", geo.box(*[F.col(e) for e in geo.EDGES])).drop(*geo.EDGES)


def boxes(t):
    return box_column(t.boxes)


# --- tiles ---------------------------------------------------------------------------

FRAGMENTS["tile_grid"] = """
    select g.doc_id, g.page_id, g.width, g.height, r.i as row, c.i as col,
           'tile[r' || r.i || 'c' || c.i || ']' as tile,
           cast(trunc(greatest(0.0::double, c.i * (width / 2.0::double) - case when c.i > 0 then width / 2.0::double * 0.12::double / 2 else 0.0::double end)) as int) as x0,
           cast(trunc(greatest(0.0::double, r.i * (height / 2.0::double) - case when r.i > 0 then height / 2.0::double * 0.12::double / 2 else 0.0::double end)) as int) as y0,
           cast(trunc(least(width::double, (c.i + 1) * (width / 2.0::double) + case when c.i < 1 then width / 2.0::double * 0.12::double / 2 else 0.0::double end)) as int) as x1,
           cast(trunc(least(height::double, (r.i + 1) * (height / 2.0::double) + case when r.i < 1 then height / 2.0::double * 0.12::double / 2 else 0.0::double end)) as int) as y1
    from @sheets g, (values (0), (1)) r(i), (values (0), (1)) c(i)"""


@check("e01_tiles", f"select {PAGE}, tile, x0, y0, x1, y1 from @tile_grid")
def _(t):
    return dedupe.tiles(t.sheets).select("doc_id", "page_id", "tile", "x0", "y0", "x1", "y1")


def sheets(t):
    region = geo.box(F.col("dx0"), F.col("dy0"), F.col("dx1"), F.col("dy1"))
    return t.sheets.withColumn("drawing_region", F.when(F.col("dx0").isNotNull(), region))


def order_callouts(t):
    end = F.when(F.col("end_x").isNotNull(), F.struct(F.col("end_x").alias("x"), F.col("end_y").alias("y")))
    return box_column(t.order_callouts).withColumn("leader_endpoint", end).drop("end_x", "end_y")


def _moved(e, lo, hi, size):
    return f"""case when dx0 is null or {e} is null then {e} else greatest(0.0::double, least(1000.0::double, ({lo} / 1000.0::double * {size}
        + {e} / 1000.0::double * (({hi} - {lo}) / 1000.0::double * {size})) / {size} * 1000.0::double)) end as {e}"""


@check("j10_crop_to_page", f"""select c.doc_id, c.page_id, call_ord, {_moved('xmin', 'dx0', 'dx1', 'width')}, {_moved('ymax', 'dy0', 'dy1', 'height')},
    {_moved('end_x', 'dx0', 'dx1', 'width')} from @order_callouts c join @sheets s on c.doc_id = s.doc_id and c.page_id = s.page_id""")
def _(t):
    out = dedupe.crop_to_page(order_callouts(t), dedupe.page_crops(sheets(t)), ["doc_id", "page_id"])
    return out.select("doc_id", "page_id", "call_ord", "bounding_box.xmin", "bubble_bbox.ymax", F.col("leader_endpoint.x").alias("end_x"))


# --- overlaps ------------------------------------------------------------------------
# The oracle walks each group with a recursive query, one callout per step.

FRAGMENTS["ranked_boxes"] = """
    select *, row_number() over (partition by doc_id, page_id, bubble_number order by confidence_score desc, call_ord) as rk from @boxes"""
_BOX = "{'xmin': b.xmin, 'ymin': b.ymin, 'xmax': b.xmax, 'ymax': b.ymax, 'ord': b.call_ord, 'conf': b.confidence_score, 'rk': b.rk}"
FRAGMENTS["grouped_boxes"] = f"""
    select doc_id, page_id, bubble_number, list({_BOX} order by rk) as xs from @ranked_boxes b group by all"""
FRAGMENTS["walk"] = f"""
    select doc_id, page_id, bubble_number, xs,
           list_reduce(list_prepend([xs[1]], list_transform(xs[2:], lambda x: [x])), lambda acc, x:
             case when len(list_filter(acc, lambda k: ({iou_sql('k.', 'x[1].')}) >= 0.5)) > 0 then acc else list_concat(acc, x) end) as kept
    from @grouped_boxes"""
FRAGMENTS["kept_boxes"] = "select doc_id, page_id, bubble_number, unnest(kept, recursive := true) from @walk"


@check("w10_dedupe_callouts", f"""select {PAGE}, bubble_number, ord as call_ord, conf as confidence_score, xmin,
    row_number() over (partition by doc_id, page_id order by ymin, xmin, bubble_number, conf desc, ord) as reading_order from @kept_boxes""", bench=True)
def _(t):
    return dedupe.dedupe_callouts(boxes(t)).select(
        "doc_id", "page_id", "bubble_number", "call_ord", "confidence_score", F.col("bubble_bbox.xmin").alias("xmin"), "reading_order")


@check("o02_reading_order", f"""select {PAGE}, call_ord, row_number() over (partition by doc_id, page_id order by ymin, xmin, bubble_number, call_ord) as pos from @boxes""")
def _(t):
    rows = boxes(t)
    hot = skew.hot_groups(rows, ["doc_id", "page_id"])
    b = F.col("bubble_bbox")
    out = skew.ranked(rows, ["doc_id", "page_id"], [b["ymin"], b["xmin"], F.col("bubble_number"), F.col("call_ord")], "pos", hot)
    return out.select("doc_id", "page_id", "call_ord", "pos")


FRAGMENTS["dropped_boxes"] = f"""
    select doc_id, page_id, bubble_number, x, list_filter(kept, lambda k: k.rk < x.rk and ({iou_sql('k.', 'x.')}) >= 0.5)[1] as k
    from (select doc_id, page_id, bubble_number, kept, unnest(xs) as x from @walk)"""


@check("j09_overlap_pairs", f"""select {PAGE}, bubble_number, k.ord as kept_ord, x.ord as dropped_ord, {iou_sql('k.', 'x.')} as iou,
    'Deduplicated overlapping callout bubble ''' || bubble_number || ''': kept confidence=' || printf('%.2f', k.conf) || ', dropped confidence=' || printf('%.2f', x.conf) || ' (IoU>=0.5)' as warning
    from @dropped_boxes where k is not null""")
def _(t):
    return dedupe.overlap_pairs(boxes(t))


# --- candidates ------------------------------------------------------------------------

FRAGMENTS["loose"] = """
    select * from (select *, area / (pi() * radius * radius) as circularity from @contours where area > 0 and radius between 1 and 500) where circularity >= 0.55"""
FRAGMENTS["radius_ranges"] = """
    select doc_id, page_id, case when n < 5 or h <= l then 10.0::double else l end as low, case when n < 5 or h <= l then 80.0::double else h end as high
    from (select doc_id, page_id, count(*) as n, greatest(10.0::double, median(radius) * 0.4::double) as l, least(240.0::double, median(radius) * 2.5::double) as h from @loose group by all)"""
FRAGMENTS["sized"] = """
    select l.* from @loose l join @radius_ranges r on l.doc_id = r.doc_id and l.page_id = r.page_id where radius between low and high"""
FRAGMENTS["gaps"] = """
    select doc_id, page_id, circularity as c, lead(circularity) over (partition by doc_id, page_id order by circularity) as nxt,
           row_number() over (partition by doc_id, page_id order by circularity) as i, count(*) over (partition by doc_id, page_id) as n from @sized"""
FRAGMENTS["cutoffs"] = """
    select doc_id, page_id, case when n < 6 or g is null or g.gap < 0.08 then 0.6::double else greatest(g.mid, 0.6::double) end as cutoff from (
      select doc_id, page_id, max(n) as n, first({'gap': nxt - c, 'mid': (c + nxt) / 2} order by nxt - c desc nulls last, i) as g from @gaps group by all)"""
FRAGMENTS["picked"] = """
    select s.*, page_id || '_c' || case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as crop_id,
           cast(greatest(0, floor(cx - (radius + 10))) as int) as xmin, cast(greatest(0, floor(cy - (radius + 10))) as int) as ymin,
           cast(least(4000, ceil(cx + (radius + 10))) as int) as xmax, cast(least(3000, ceil(cy + (radius + 10))) as int) as ymax
    from (select z.*, row_number() over (partition by z.doc_id, z.page_id order by contour_ord) as n
          from @sized z join @cutoffs k on z.doc_id = k.doc_id and z.page_id = k.page_id where circularity >= cutoff) s"""


def hot_contours(t):
    return skew.hot_groups(t.contours, cand.PAGE)


@check("f06_loose_candidates", f"select {PAGE}, contour_ord, circularity from @loose")
def _(t):
    return cand.loose_candidates(t.contours).select("doc_id", "page_id", "contour_ord", "circularity")


@check("a10_calibrate_radius", f"select {PAGE}, low, high from @radius_ranges")
def _(t):
    return cand.calibrate_radius(cand.loose_candidates(t.contours), hot_contours(t))


@check("a10b_counted_medians", "select page_id, count(*) as n, median(area) as median from @loose group by page_id")
def _(t):
    return selection.medians(cand.loose_candidates(t.contours), ["page_id"], "area", limit=1000)


def sized(t):
    loose, hot = cand.loose_candidates(t.contours), hot_contours(t)
    joined = skew.lookup(loose, cand.calibrate_radius(loose, hot), cand.PAGE, hot, "inner")
    return joined.filter(F.col("radius").between(F.col("low"), F.col("high")))


@check("f07_radius_filter", f"select {PAGE}, contour_ord, radius from @sized")
def _(t):
    return sized(t).select("doc_id", "page_id", "contour_ord", "radius")


@check("a11_calibrate_circularity", f"select {PAGE}, cutoff from @cutoffs")
def _(t):
    return cand.calibrate_circularity(sized(t))


@check("w09_crop_numbering", f"select {PAGE}, contour_ord, crop_id, xmin, ymin, xmax, ymax from @picked p where page_id in (select page_id from @sheets s where s.doc_id = p.doc_id)", bench=True)
def _(t):
    return cand.select_candidates(t.contours, t.sheets).select("doc_id", "page_id", "contour_ord", "crop_id", "bbox.*")


@check("f08_circularity_filter", f"select {PAGE}, contour_ord, circularity from @picked")
def _(t):
    return cand.select_candidates(t.contours).select("doc_id", "page_id", "contour_ord", "circularity")


# --- words to rows -----------------------------------------------------------------------

IMAGE = "doc_id, page_id, region_id"


def words(t):
    return t.words.withColumnsRenamed({"x": "left", "y": "top", "w": "width", "h": "height"})


FRAGMENTS["real_words"] = "select *, y + h / 2 as centre from @words where regexp_matches(text, '[A-Za-z0-9]')"
FRAGMENTS["centres"] = f"select {IMAGE}, centre, count(*) as n from @real_words group by all"
FRAGMENTS["row_lists"] = f"""
    select {IMAGE}, list_reduce(list_prepend({{'s': 0.0::double, 'n': 0.0::double, 'r': 0, 'out': [{{'c': -1.0::double, 'r': 0}}]}},
        list_transform(list({{'c': centre, 'n': n}} order by centre), lambda x: {{'s': x.c, 'n': x.n::double, 'r': 0, 'out': [{{'c': x.c, 'r': 0}}]}})),
        lambda a, x: case when a.n > 0 and x.s - a.s / a.n <= 10
          then {{'s': a.s + x.s * x.n, 'n': a.n + x.n, 'r': a.r, 'out': list_append(a.out, {{'c': x.s, 'r': a.r}})}}
          else {{'s': x.s * x.n, 'n': x.n, 'r': a.r + 1, 'out': list_append(a.out, {{'c': x.s, 'r': a.r + 1}})}} end) as z
    from @centres group by all"""
FRAGMENTS["row_numbers"] = f"select {IMAGE}, o.c as centre, o.r as row_no from (select {IMAGE}, unnest(z.out) as o from @row_lists) where o.c >= 0"
FRAGMENTS["placed_words"] = f"select w.*, r.row_no from @real_words w join @row_numbers r using ({IMAGE}, centre)"
FRAGMENTS["word_gaps"] = f"""
    select *, x - lag(x + w) over (partition by {IMAGE}, row_no order by x, centre, word_ord) as gap from @placed_words"""
FRAGMENTS["gap_steps"] = f"""
    select {IMAGE}, gap, lead(gap) over (partition by {IMAGE} order by gap) as nxt, row_number() over (partition by {IMAGE} order by gap) as i,
           count(*) over (partition by {IMAGE}) as n from @word_gaps where gap > 0"""
FRAGMENTS["thresholds"] = f"""
    select {IMAGE}, case when n < 3 or g is null or g.ratio < 1.3 then 25.0::double else g.mid end as threshold from (
      select {IMAGE}, max(n) as n, first({{'ratio': nxt / greatest(gap, 1.0::double), 'mid': (gap + nxt) / 2}} order by nxt / greatest(gap, 1.0::double) desc nulls last, i) as g
      from @gap_steps group by all)"""
FRAGMENTS["cell_words"] = f"""
    select g.*, sum(case when gap > coalesce(threshold, 25) then 1 else 0 end) over (partition by {IMAGE}, row_no order by x, centre, word_ord) as cell_no
    from @word_gaps g left join @thresholds t using ({IMAGE})"""
FRAGMENTS["cells"] = f"""
    select {IMAGE}, row_no, cast(cell_no as int) as cell_no, string_agg(text, ' ' order by x, centre, word_ord) as text,
           min(x) as l, min(y) as t, max(x + w) as r, max(y + h) as b from @cell_words group by all"""


@check("f05_drop_punctuation_words", f"select {IMAGE}, word_ord, text from @real_words")
def _(t):
    return tables.real_words(words(t)).select("doc_id", "page_id", "region_id", "word_ord", "text")


@check("w06_row_clustering", f"select {IMAGE}, centre, row_no from @row_numbers")
def _(t):
    return tables.row_of_centre(tables.real_words(words(t)))


@check("w04_word_gaps", f"select {IMAGE}, row_no, x as at, word_ord, gap from @word_gaps where gap is not null")
def _(t):
    return tables.gaps(words(t)).select("doc_id", "page_id", "region_id", "row_no", F.col("left").alias("at"), "word_ord", "gap")


@check("a12_infer_gap_threshold", f"select {IMAGE}, threshold from @thresholds")
def _(t):
    return tables.gap_thresholds(words(t))


CELL_SQL = f"select {IMAGE}, row_no, cell_no, text, l, t, r, b from @cells"


def cell_frame(t):
    return tables.cells(words(t)).select(
        "doc_id", "page_id", "region_id", "row_no", "cell_no", "text",
        F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))


@check("a16_cells_from_words", CELL_SQL, bench=True)
def _(t):
    return cell_frame(t)


@check("w05_cell_segmentation", f"select {IMAGE}, row_no, count(*) as cells from @cells group by all")
def _(t):
    return tables.row_cells(words(t)).withColumn("cells", F.size("cells").cast("bigint"))


@check("x18_cell_span", f"select {IMAGE}, row_no, cell_no, r - l as w, b - t as h from @cells")
def _(t):
    return cell_frame(t).select("doc_id", "page_id", "region_id", "row_no", "cell_no", (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h"))


@check("j11_digit_override", f"""select {IMAGE}, row_no, cell_no, text, nullif(regexp_replace(d.digits, '[^0-9]', '', 'g'), '') as digits
    from @cells left join @digits d using ({IMAGE}, row_no, cell_no)""")
def _(t):
    return tables.digit_override(tables.cells(words(t)), t.digits).select(
        "doc_id", "page_id", "region_id", "row_no", "cell_no", "text", "digits")


# --- header mapping ------------------------------------------------------------------------


def map_sql(cells: str) -> str:
    """Column mapping as a struct of 1-based positions, 0 for an unmapped field."""
    none = "{" + ", ".join(f"'{f}': 0" for f in tables.HEADER_KEYWORDS) + "}"
    has = lambda ws: "(" + " or ".join(f"contains(x.t, '{w.replace(chr(39), chr(39) * 2)}')" for w in ws) + ")"
    step = "a.m"
    for name, ws in reversed(tables.HEADER_KEYWORDS.items()):
        new = "{" + ", ".join(f"'{f}': " + ("x.i" if f == name else f"a.m.{f}") for f in tables.HEADER_KEYWORDS) + "}"
        step = f"case when a.m.{name} = 0 and {has(ws)} then {new} else {step} end"
    items = f"list_transform({cells}, lambda c, i: {{'t': lower(trim(coalesce(c, ''))), 'i': i::int, 'm': {none}}})"
    return f"list_reduce(list_prepend({{'t': '', 'i': 0, 'm': {none}}}, {items}), lambda a, x: {{'t': '', 'i': 0, 'm': case when x.t = '' then a.m else {step} end}}).m"


ANY = "greatest(" + ", ".join(f"m.{f}" for f in tables.HEADER_KEYWORDS) + ")"


@check("w08_column_mapping", f"""select doc_id, {', '.join(f"case when m.{f} > 0 then m.{f} - 1 end as {f}" for f in tables.HEADER_KEYWORDS)}
    from (select doc_id, {map_sql('cells')} as m from @headers)""")
def _(t):
    mapped = t.headers.withColumn("m", tables.map_columns(F.col("cells")))
    return mapped.select("doc_id", *[F.try_element_at("m", F.lit(f)).alias(f) for f in tables.HEADER_KEYWORDS])


FRAGMENTS["row_cells"] = f"""
    select * from (select *, count(*) over (partition by {IMAGE}) as n from (
      select {IMAGE}, row_no, list(text order by cell_no) as cells, list(digits order by cell_no) as digits
      from (select c.*, nullif(regexp_replace(d.digits, '[^0-9]', '', 'g'), '') as digits
            from @cells c left join @digits d using ({IMAGE}, row_no, cell_no)) group by all)) where n >= 2"""
FRAGMENTS["headers_found"] = f"""
    select {IMAGE}, min(row_no) as header_no, arg_min(m, row_no) as m from (select {IMAGE}, row_no, {map_sql('cells')} as m from @row_cells where row_no <= 3)
    where {ANY} > 0 group by all"""
POSITIONAL = "{'item_no': 1, 'part_number': 0, 'qty': 2, 'material': 4, 'description': 3}"
FRAGMENTS["header_rows"] = f"""
    select d.*, coalesce(h.header_no, 0) as header_no, coalesce(h.m, {POSITIONAL}) as m
    from (select distinct {IMAGE} from @row_cells) d left join @headers_found h using ({IMAGE})"""


def rows_of(t):
    return tables.row_cells(words(t))


@check("w07_header_search", f"select {IMAGE}, header_no, m.item_no - 1 as item_at from @header_rows")
def _(t):
    found = tables.header_of(rows_of(t), tables.IMAGE)
    return found.select("doc_id", "page_id", "region_id", "header_no", F.try_element_at("mapping", F.lit("item_no")).alias("item_at"))


@check("o05_first_rows", f"select {IMAGE}, row_no, count(*) as cells from @cells where row_no <= 3 group by all")
def _(t):
    return rows_of(t).filter(F.col("row_no") <= tables.HEADER_ROWS).select("doc_id", "page_id", "region_id", "row_no", F.size("cells").alias("cells"))


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def fields_sql(cells: str = "cells", digits: str | None = None) -> str:
    def cell(f, numeric=False):
        at = f"case when m.{f} > 0 then {cells}[m.{f}] end"
        if numeric and digits:
            return f"case when coalesce({at}, '') <> '' then coalesce(case when m.{f} > 0 then {digits}[m.{f}] end, {at}) else {at} end"
        return at
    run = lambda x: f"nullif(regexp_extract({clean(x)}, '[0-9]+'), '')"
    return f"""{run(cell('item_no', True))} as item_no, {clean(cell('description'))} as description,
        try_cast({run(cell('qty', True))} as bigint) as qty, nullif({clean(cell('material'))}, '') as material, nullif({clean(cell('part_number'))}, '') as part_number"""


FRAGMENTS["read_rows"] = f"""
    select * from (select {IMAGE}, row_no as row_ord, {fields_sql('cells', 'digits')} from @row_cells join @header_rows using ({IMAGE}) where row_no > header_no)
    where item_no is not null"""
FRAGMENTS["vector_rows"] = f"""
    select * from (select {PAGE}, table_ord, row_ord, {fields_sql('row')} from (
      select {PAGE}, table_ord, m, unnest(cells[2:]) as row, unnest(range(len(cells) - 1)) as row_ord from (
        select *, {map_sql('list_transform(cells[1], lambda c: ' + clean('c') + ')')} as m from @cell_tables where len(cells) >= 2) where {ANY} > 0)) where item_no is not null"""
FIELDS = "item_no, description, qty, material, part_number"


@check("f04_drop_blank_rows", f"select {IMAGE}, row_ord, {FIELDS} from @read_rows", bench=True)
def _(t):
    return tables.rows_from_words(words(t), t.digits)


@check("e03_table_rows", f"select {PAGE}, table_ord, row_ord, {FIELDS} from @vector_rows")
def _(t):
    return tables.rows_from_cell_tables(t.cell_tables)


# --- ruled regions ---------------------------------------------------------------------------

FRAGMENTS["wide"] = "select s.* from @segments s join @sheets p using (doc_id, page_id) where s.w >= p.width * 0.08::double"
FRAGMENTS["rule_groups"] = f"""
    select {PAGE}, list_reduce(list_prepend([{{'x': -99999, 'e': -99999, 'n': 0, 'y0': 0, 'y1': 0, 'k': -1::bigint}}],
      list_transform(list({{'x': x, 'e': x + w, 'y': y, 'z': y + h, 'o': seg_ord}} order by seg_ord), lambda s: [{{'x': s.x, 'e': s.e, 'n': 1, 'y0': s.y, 'y1': s.z, 'k': s.o}}])),
      lambda gs, s: case when len(list_filter(gs, lambda g: abs(g.x - s[1].x) <= 15 and abs(g.e - s[1].e) <= 15)) > 0 then gs else list_concat(gs, s) end) as leaders
    from @wide group by all"""
FRAGMENTS["regions"] = f"""
    select *, row_number() over (partition by {PAGE} order by row_count desc, k) as region_rank from (
      select {PAGE}, lead.k as k, count(*) as row_count, min(x) as xmin, min(y) as ymin, max(x + w) as xmax, max(y + h) as ymax from (
        select s.*, list_filter(r.leaders, lambda g: abs(g.x - s.x) <= 15 and abs(g.e - (s.x + s.w)) <= 15)[1] as lead
        from @wide s join @rule_groups r using (doc_id, page_id)) group by all) where row_count >= 3 and ymax - ymin >= 3000 * 0.02::double"""


@check("f10_wide_segments", f"select {PAGE}, seg_ord, w from @wide")
def _(t):
    return tables.wide_segments(t.segments, t.sheets).select("doc_id", "page_id", "seg_ord", "w")


def regions(t):
    return tables.table_regions(tables.wide_segments(t.segments, t.sheets))


@check("w11_segment_grouping", f"select {PAGE}, row_count, xmin, ymin, xmax, ymax, region_rank from @regions")
def _(t):
    return regions(t)


@check("o03_regions_by_dividers", f"select {PAGE}, row_count, region_rank from @regions")
def _(t):
    return regions(t).select("doc_id", "page_id", "row_count", "region_rank")


FRAGMENTS["sources"] = f"""
    select {PAGE}, 0 as source_kind, table_ord as source_ord, row_ord, {FIELDS} from @vector_rows union all
    select {PAGE}, 2, 0, row_ord, {FIELDS} from @read_rows where region_id = 'page' union all
    select {PAGE}, 1, cast(region_id as bigint), row_ord, {FIELDS} from @read_rows r
    where region_id <> 'page' and exists (select 1 from @regions g where g.doc_id = r.doc_id and g.page_id = r.page_id and cast(g.region_rank as varchar) = r.region_id)"""
FRAGMENTS["best_source"] = f"""
    select *, min(source_ord) over (partition by {PAGE}, source_kind) as first_ord, min(source_kind) over (partition by {PAGE}) as first_kind from @sources"""


@check("w12_source_fallback", f"select {PAGE}, source_kind, source_ord, row_ord, {FIELDS} from @best_source where source_kind = first_kind and source_ord = first_ord", bench=True)
def _(t):
    return tables.extract_bom(words(t), regions(t), t.cell_tables, t.digits)


@check("p21_bom_row_to_contract", f"""select {PAGE}, source_kind, source_ord, row_ord, item_no as item_number, part_number, null::varchar as part_name, coalesce(description, '') as description,
    qty as quantity, material as material_specification, null::double as confidence_score from @best_source where source_kind = first_kind and source_ord = first_ord""")
def _(t):
    return tables.to_contract(tables.extract_bom(words(t), regions(t), t.cell_tables, t.digits))


# --- classification joined to candidates ---------------------------------------------------

FRAGMENTS["placed_candidates"] = "select p.*, s.width, s.height, s.dx0, s.dy0 from @picked p join @sheets s using (doc_id, page_id)"


def _origin(e, lo, size):
    return f"greatest(0.0::double, least(1000.0::double, (coalesce({lo} / 1000.0::double * {size}, 0.0::double) + {e}) / {size} * 1000.0::double)) as {e}"


ATTACHED = f"""select c.doc_id, c.page_id, c.crop_id, contour_ord as call_ord, cast(r.number as varchar) as bubble_number, r.confidence as confidence_score,
    {_origin('xmin', 'dx0', 'width')}, {_origin('ymax', 'dy0', 'height')} from @placed_candidates c join @verdicts r on c.doc_id = r.doc_id and c.crop_id = r.crop_id where r.is_balloon"""
