"""Checks of column expressions on identifiers, numbers, text and boxes."""

from pyspark.sql import functions as F

from checks.registry import FRAGMENTS, check
from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc



def txt():
    return F.col("txt")


def kind():
    return F.col("kind")


NUMERIC = "'^[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+([eE][+-]?[0-9]+)?)$'"
WHOLE = "'^[+-]?[0-9]+$'"


def key_sql(text: str, kind: str) -> str:
    number = f"cast({text} as double)"
    return f"""case {kind}
        when 'string' then case when len(regexp_extract_all({text}, '[0-9]+')) = 1
             then coalesce(nullif(ltrim(regexp_extract({text}, '[0-9]+'), '0'), ''), '0') end
        when 'int' then {text}
        when 'float' then case when {number} = floor({number}) then cast(cast({number} as bigint) as varchar) end end"""


def _scalars(t, **cols):
    return t.scalars.select("doc_id", "ord", *[c.alias(n) for n, c in cols.items()])


@check("p01_normalize_identifier", f"select doc_id, ord, {key_sql('txt', 'kind')} as key from @scalars", bench=True)
def _(t):
    return _scalars(t, key=sc.normalize_identifier(txt(), kind()))


@check("p02_safe_int", f"""select doc_id, ord, case
    when kind = 'int' then cast(txt as bigint)
    when kind = 'float' then case when cast(txt as double) = floor(cast(txt as double)) then cast(cast(txt as double) as bigint) end
    when kind = 'string' and regexp_matches(trim(txt), {WHOLE}) then cast(trim(txt) as bigint) end as v from @scalars""")
def _(t):
    return _scalars(t, v=sc.safe_int(txt(), kind()))


FLOAT_SQL = f"""case when kind in ('int', 'float') then cast(txt as double)
    when kind = 'string' and regexp_matches(trim(txt), {NUMERIC}) then cast(trim(txt) as double) end"""
CLAMP_SQL = f"""greatest(0.0::double, least(1.0::double, coalesce(
    case when kind = 'bool' then case txt when 'true' then 1.0::double else 0.0::double end else {FLOAT_SQL} end, 0.0::double)))"""


@check("p03_safe_float", f"select doc_id, ord, {FLOAT_SQL} as v from @scalars")
def _(t):
    return _scalars(t, v=sc.safe_float(txt(), kind()))


@check("p04_clamp_confidence", f"select doc_id, ord, {CLAMP_SQL} as v from @scalars")
def _(t):
    return _scalars(t, v=sc.clamp_confidence(txt(), kind()))


@check("p05_is_valid_confidence", """select doc_id, ord, coalesce(kind in ('int', 'float')
    and cast(case when kind in ('int', 'float') then txt end as double) between 0 and 1, false) as v from @scalars""")
def _(t):
    return _scalars(t, v=sc.is_valid_confidence(txt(), kind()))


@check("p06_is_low_confidence", "select doc_id, bom_ord, confidence_score < 0.7 as low from @bom")
def _(t):
    return t.bom.select("doc_id", "bom_ord", sc.is_low_confidence(F.col("confidence_score"), 0.7).alias("low"))


@check("p07_low_confidence_warning", """select doc_id, bom_ord,
    'Low confidence extraction for BOM item ' || item_number || ' (confidence=' || printf('%.2f', confidence_score) || ')' as w
    from @bom where confidence_score < 0.7 and item_number is not null""")
def _(t):
    rows = t.bom.filter((F.col("confidence_score") < 0.7) & F.col("item_number").isNotNull())
    return rows.select("doc_id", "bom_ord", sc.low_confidence_warning("BOM item", F.col("item_number"), F.col("confidence_score")).alias("w"))


CLEAN_SQL = "trim(regexp_replace(coalesce(txt, ''), '\\s+', ' ', 'g'))"


@check("p08_clean_cell", f"select doc_id, ord, {CLEAN_SQL} as v from @scalars")
def _(t):
    return _scalars(t, v=sc.clean_cell(txt()))


@check("p09_extract_item_no", "select doc_id, ord, nullif(regexp_extract(coalesce(txt, ''), '[0-9]+'), '') as v from @scalars")
def _(t):
    return _scalars(t, v=sc.extract_item_no(txt()))


@check("p10_extract_qty", "select doc_id, ord, try_cast(nullif(regexp_extract(coalesce(txt, ''), '[0-9]+'), '') as bigint) as v from @scalars")
def _(t):
    return _scalars(t, v=sc.extract_qty(txt()))


@check("p11_get_cell", "select doc_id, case when i >= 0 then cells[i + 1] end as v from (select doc_id, cells, cast(doc_id % 7 as int) as i from @headers)")
def _(t):
    return t.headers.select("doc_id", sc.get_cell(F.col("cells"), (F.col("doc_id") % 7).cast("int")).alias("v"))


@check("p12_combine_confidence", """select doc_id, bom_ord, case when a is null then b when b is null then a else least(a, b) end as v
    from (select doc_id, bom_ord, confidence_score as a, case when quantity > 20 then cast(quantity as double) / 100 end as b from @bom)""")
def _(t):
    b = F.when(F.col("quantity") > 20, F.col("quantity").cast("double") / 100)
    return t.bom.select("doc_id", "bom_ord", sc.combine_confidence(F.col("confidence_score"), b).alias("v"))


@check("p14_format_component_id", "select o_orderkey, 'cmp_' || case when length(cast(o_orderkey as varchar)) < 3 then lpad(cast(o_orderkey as varchar), 3, '0') else cast(o_orderkey as varchar) end as id from @orders")
def _(t):
    return t.shared("orders").select("o_orderkey", sc.component_id(F.col("o_orderkey")).alias("id"))


@check("p15_exact_component_id", """select doc_id, ord, 'cmp_' || case when regexp_matches(txt, '^[0-9]+$') and length(txt) < 3 then lpad(txt, 3, '0') else txt end as id
    from @scalars where txt is not null""")
def _(t):
    return _scalars(t, id=sc.exact_component_id(txt())).filter("id is not null")


@check("p16_normalize_file_type", "select doc_id, regexp_replace(lower(trim('  ' || suffix)), '^\\.+', '') as v from (select doc_id, regexp_extract(path, '\\.[A-Za-z]+$') as suffix from @files)")
def _(t):
    return t.files.select("doc_id", sc.normalize_file_type(F.concat(F.lit("  "), F.regexp_extract("path", r"\.[A-Za-z]+$", 0))).alias("v"))


@check("p22_validation_error_code", """select doc_id, msg, case
    when contains(lower(msg), 'unsupported file type') then 'UNSUPPORTED_FORMAT' when contains(lower(msg), 'empty') then 'EMPTY_FILE'
    when contains(lower(msg), 'does not exist') then 'FILE_NOT_FOUND' when contains(lower(msg), 'not a valid pdf') then 'INVALID_PDF'
    when contains(lower(msg), 'valid') then 'CORRUPT_IMAGE' else 'VALIDATION_FAILED' end as code
    from (select doc_id, case doc_id % 6 when 0 then 'File is empty.' when 1 then 'Unsupported file type ''.txt''.' when 2 then 'File does not exist: ' || path
          when 3 then 'content is Not a Valid PDF.' when 4 then 'File could not be opened as a valid PNG image.' else 'odd ' || path end as msg from @files)""")
def _(t):
    rows = t.sql("""select doc_id, case doc_id % 6 when 0 then 'File is empty.' when 1 then "Unsupported file type '.txt'." when 2 then concat('File does not exist: ', path)
          when 3 then 'content is Not a Valid PDF.' when 4 then 'File could not be opened as a valid PNG image.' else concat('odd ', path) end as msg from @files""")
    return rows.withColumn("code", sc.validation_error_code(F.col("msg")))


@check("p23_parse_grid_size", """select o_orderkey, case when o_orderkey % 4 = 0 then 2 else o_orderkey % 5 + 1 end as rows,
    case when o_orderkey % 4 = 0 then 2 else o_custkey % 6 + 1 end as cols from @orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, "  ").otherwise(
        F.concat((F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(" X "), (F.col("o_custkey") % 6 + 1).cast("string")))
    return t.shared("orders").select("o_orderkey", sc.parse_grid_size(text).alias("g")).select("o_orderkey", "g.rows", "g.cols")


@check("p26_document_id", "select path, 'doc_' || substr(sha256(path), 1, 8) as id from @files")
def _(t):
    return t.files.select("path", sc.document_id(F.col("path")).alias("id"))


@check("p27_page_id", "select doc_id, page_number, 'page_' || lpad(cast(page_number as varchar), 3, '0') as id from @sheets")
def _(t):
    return t.sheets.select("doc_id", "page_number", sc.page_id(F.col("page_number")).alias("id"))


# --- geometry --------------------------------------------------------------------



def w():
    return F.col("width")


def h():
    return F.col("height")


def box():
    return geo.box(*[F.col(e) for e in geo.EDGES])


NORM = "greatest(0.0::double, least(1000.0::double, {0} / {1} * 1000.0::double))"


def _norm(edge: str, size: str) -> str:
    return NORM.format(edge, size)


NORM_BOX = ", ".join(f"{_norm(e, s)} as {e}" for e, s in zip(geo.EDGES, ("width", "height", "width", "height")))
IS_NORM = " and ".join(f"{e} between 0 and 1000" for e in geo.EDGES)


def _boxes(t, made):
    return t.geometry.select("doc_id", "ord", made.alias("b")).select("doc_id", "ord", "b.*")


@check("x01_pixel_to_norm", f"select doc_id, ord, {NORM_BOX} from @geometry")
def _(t):
    return _boxes(t, geo.pixel_to_norm(box(), w(), h()))


def _px(edge: str, size: str) -> str:
    return f"cast(round_even(greatest(0.0::double, least({size}::double, {edge} / 1000.0::double * {size})), 0) as int) as {edge}"


@check("x02_norm_to_pixel", f"select doc_id, ord, {_px('xmin', 'width')}, {_px('ymin', 'height')}, {_px('xmax', 'width')}, {_px('ymax', 'height')} from @geometry")
def _(t):
    return _boxes(t, geo.norm_to_pixel(box(), w(), h()))


@check("x03_is_already_normalized", f"select doc_id, ord, ({IS_NORM}) as ok from @geometry")
def _(t):
    return t.geometry.select("doc_id", "ord", geo.is_already_normalized(box()).alias("ok"))


RESOLVED = f"""select doc_id, ord, {', '.join(f"case when ({IS_NORM}) then {e} else {_norm(e, s)} end as {e}" for e, s in zip(geo.EDGES, ("width", "height", "width", "height")))} from @geometry"""


@check("x04_resolve_bbox", f"select doc_id, ord, {', '.join(f'case when xmin < xmax and ymin < ymax then {e} end as {e}' for e in geo.EDGES)} from ({RESOLVED})")
def _(t):
    return t.geometry.select("doc_id", "ord", geo.resolve_bbox(box(), w(), h()).alias("b")).select(
        "doc_id", "ord", *[F.col(f"b.{e}").alias(e) for e in geo.EDGES])


def crop():
    return F.struct(F.col("rx0").alias("x"), F.col("ry0").alias("y"), (F.col("rx1") - F.col("rx0")).alias("width"), (F.col("ry1") - F.col("ry0")).alias("height"))


def _remap(e, o, s, p):
    return f"greatest(0.0::double, least(1000.0::double, ({o} + {e} / 1000.0::double * {s}) / {p} * 1000.0::double)) as {e}"


@check("x05_remap_from_crop", f"""select doc_id, ord, {_remap('xmin', 'rx0', '(rx1 - rx0)', 'width')}, {_remap('ymin', 'ry0', '(ry1 - ry0)', 'height')},
    {_remap('xmax', 'rx0', '(rx1 - rx0)', 'width')}, {_remap('ymax', 'ry0', '(ry1 - ry0)', 'height')} from @geometry""")
def _(t):
    return _boxes(t, geo.remap_from_crop(box(), crop(), w(), h()))


def region():
    return geo.box(F.col("rx0"), F.col("ry0"), F.col("rx1"), F.col("ry1"))


@check("x05b_remap_from_region", """select doc_id, ord, rx0 + xmin / 1000.0::double * (rx1 - rx0) as xmin, ry0 + ymin / 1000.0::double * (ry1 - ry0) as ymin,
    rx0 + xmax / 1000.0::double * (rx1 - rx0) as xmax, ry0 + ymax / 1000.0::double * (ry1 - ry0) as ymax from @geometry""")
def _(t):
    return _boxes(t, geo.remap_from_region(box(), region()))


@check("x06_crop_pixels", """select doc_id, ord, rx0 / 1000.0::double * width as x, ry0 / 1000.0::double * height as y,
    (rx1 - rx0) / 1000.0::double * width as w, (ry1 - ry0) / 1000.0::double * height as h from @geometry""")
def _(t):
    c = t.geometry.select("doc_id", "ord", geo.crop_pixels(region(), w(), h()).alias("c"))
    return c.select("doc_id", "ord", "c.x", "c.y", F.col("c.width").alias("w"), F.col("c.height").alias("h"))


def _sheet_region():
    found = geo.box(F.col("dx0"), F.col("dy0"), F.col("dx1"), F.col("dy1"))
    return F.when(F.col("dx0").isNotNull(), found)


@check("x07_crop_origin", """select doc_id, page_id, coalesce(dx0 / 1000.0::double * width, 0.0::double) as x,
    coalesce(dy0 / 1000.0::double * height, 0.0::double) as y from @sheets""")
def _(t):
    return t.sheets.select("doc_id", "page_id", geo.crop_origin(_sheet_region(), w(), h()).alias("o")).select("doc_id", "page_id", "o.*")


def _page(e, o, p):
    return f"greatest(0.0::double, least(1000.0::double, ({o} + {e}) / {p} * 1000.0::double)) as {e}"


@check("x08_pixel_box_to_page", f"""select doc_id, ord, {_page('xmin', 'rx0', 'width')}, {_page('ymin', 'ry0', 'height')},
    {_page('xmax', 'rx0', 'width')}, {_page('ymax', 'ry0', 'height')} from @geometry""")
def _(t):
    origin = F.struct(F.col("rx0").alias("x"), F.col("ry0").alias("y"))
    return _boxes(t, geo.pixel_box_to_page(box(), origin, w(), h()))


@check("x09_fit_dimensions", """select doc_id, ord, case when s is null then width when width >= height then s
      else greatest(1, cast(round_even(width * (s / height::double), 0) as int)) end as w,
    case when s is null then height when width >= height then greatest(1, cast(round_even(height * (s / width::double), 0) as int)) else s end as h,
    s is not null as resized from (select *, case when greatest(width, height) > 5000 then 5000 when greatest(width, height) < 2000 then 2000 end as s from @geometry)""")
def _(t):
    f = t.geometry.select("doc_id", "ord", geo.fit_dimensions(w(), h(), 5000, 2000).alias("f"))
    return f.select("doc_id", "ord", F.col("f.width").alias("w"), F.col("f.height").alias("h"), "f.resized")


@check("x09b_cap_dimensions", """select doc_id, ord, case when m > 4096 then greatest(1, cast(round_even(width * (4096::double / m), 0) as int)) else width end as w,
    case when m > 4096 then greatest(1, cast(round_even(height * (4096::double / m), 0) as int)) else height end as h
    from (select *, greatest(width, height) as m from @geometry)""")
def _(t):
    f = t.geometry.select("doc_id", "ord", geo.cap_dimensions(w(), h()).alias("f"))
    return f.select("doc_id", "ord", F.col("f.width").alias("w"), F.col("f.height").alias("h"))


@check("x10_resolve_regions", """select doc_id, ord, 0 as dx0, 0 as dy0, 1000 as dx1, case when p is null then 850 else p * 10 end as dy1,
    case when p is null then 650 else 1000 - p * 5 end as tx0, case when p is null then 720 else 1000 - 280 end as ty0, 1000 as tx1, 1000 as ty1
    from (select doc_id, ord, case when width > 3000 then null else height % 60 + 20 end as p from @geometry)""")
def _(t):
    p = F.when(F.col("width") <= 3000, F.col("height") % 60 + 20).cast("double")
    rows = t.geometry.select("doc_id", "ord", geo.resolve_regions(drawing_ymax_pct=p, title_width_pct=p / 200).alias("r"))
    out = {f"d{a}": f"r.drawing.{e}" for a, e in zip(("x0", "y0", "x1", "y1"), geo.EDGES)}
    out |= {f"t{a}": f"r.title_block.{e}" for a, e in zip(("x0", "y0", "x1", "y1"), geo.EDGES)}
    return rows.select("doc_id", "ord", *[F.col(c).alias(n) for n, c in out.items()])


@check("x11_validate_region", f"select doc_id, ord, ({IS_NORM} and xmin < xmax and ymin < ymax) as ok from @geometry")
def _(t):
    return t.geometry.select("doc_id", "ord", geo.in_range(box()).alias("ok"))


@check("x12_padded_bbox", """select doc_id, contour_ord, cast(greatest(0, floor(cx - (radius + 10))) as int) as xmin, cast(greatest(0, floor(cy - (radius + 10))) as int) as ymin,
    cast(least(4000, ceil(cx + (radius + 10))) as int) as xmax, cast(least(3000, ceil(cy + (radius + 10))) as int) as ymax from @contours""")
def _(t):
    b = geo.padded_bbox(F.col("cx"), F.col("cy"), F.col("radius"), F.lit(4000), F.lit(3000))
    return t.contours.select("doc_id", "contour_ord", b.alias("b")).select("doc_id", "contour_ord", "b.*")


def _window(a, z, size):
    lo, hi = f"({a} / 1000.0::double * {size})", f"({z} / 1000.0::double * {size})"
    mid = f"(({lo} + {hi}) / 2.0::double)"
    half = f"greatest(({hi} - {lo}) / 2.0::double * 3.0::double, 40.0::double / 1000.0::double * {size})"
    low = f"cast(trunc(greatest(0.0::double, {mid} - {half})) as int)"
    high = f"cast(trunc(least({size}::double, {mid} + {half})) as int)"
    return low, f"case when {high} <= {low} then least({size}, {low} + 1) else {high} end"


_WX, _WY = _window("xmin", "xmax", "width"), _window("ymin", "ymax", "height")


@check("x13_verification_window", f"select doc_id, ord, {_WX[0]} as xmin, {_WY[0]} as ymin, {_WX[1]} as xmax, {_WY[1]} as ymax from @geometry")
def _(t):
    return _boxes(t, geo.verification_window(box(), w(), h()))


def iou_sql(a: str, b: str) -> str:
    g = lambda s, e: f"{s}{e}"
    iw = f"greatest(0.0::double, least({g(a, 'xmax')}, {g(b, 'xmax')}) - greatest({g(a, 'xmin')}, {g(b, 'xmin')}))"
    ih = f"greatest(0.0::double, least({g(a, 'ymax')}, {g(b, 'ymax')}) - greatest({g(a, 'ymin')}, {g(b, 'ymin')}))"
    area = lambda s: f"(greatest(0.0::double, {g(s, 'xmax')} - {g(s, 'xmin')}) * greatest(0.0::double, {g(s, 'ymax')} - {g(s, 'ymin')}))"
    inter, union = f"({iw} * {ih})", f"({area(a)} + {area(b)} - ({iw} * {ih}))"
    return f"case when {inter} > 0 and {union} > 0 then {inter} / {union} else 0.0::double end"


@check("x14_bbox_iou", f"""select doc_id, ord, {iou_sql('a.', 'b.')} as iou from (
    select doc_id, ord, {{'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}} as a, {{'xmin': rx0, 'ymin': ry0, 'xmax': rx1, 'ymax': ry1}} as b from @geometry)""")
def _(t):
    return t.geometry.select("doc_id", "ord", geo.bbox_iou(box(), region()).alias("iou"))


FULL = "xmin is not null and ymin is not null and xmax is not null and ymax is not null"


@check("x15_normalize_bounding_box", f"select doc_id, call_ord, {', '.join(f'case when {FULL} then {e} end as {e}' for e in geo.EDGES)} from @callouts")
def _(t):
    b = geo.normalize_bounding_box(*[F.col(e) for e in geo.EDGES])
    return t.callouts.select("doc_id", "call_ord", b.alias("b")).select("doc_id", "call_ord", *[F.col(f"b.{e}").alias(e) for e in geo.EDGES])


@check("x16_pick_bbox", """select doc_id, page_id, coalesce(dx0, 1.0::double) as xmin, case when dx0 is null then 2.0::double else dy0 end as ymin from @sheets""")
def _(t):
    main = geo.box(F.col("dx0"), F.col("dy0"), F.col("dx1"), F.col("dy1"))
    b = geo.pick_bbox(main, geo.box(1.0, 2.0, 3.0, 4.0))
    return t.sheets.select("doc_id", "page_id", b.alias("b")).select("doc_id", "page_id", "b.xmin", "b.ymin")


@check("x17_circularity", "select doc_id, contour_ord, area / (pi() * radius * radius) as v from @contours")
def _(t):
    return t.contours.select("doc_id", "contour_ord", geo.circularity(F.col("area"), F.col("radius")).alias("v"))


@check("p20_overlay_percent", "select doc_id, ord, xmin / 10 as l, ymin / 10 as t, (xmax - xmin) / 10 as w, (ymax - ymin) / 10 as h from @geometry")
def _(t):
    return t.geometry.select("doc_id", "ord", geo.overlay_percent(box()).alias("p")).select(
        "doc_id", "ord", F.col("p.left").alias("l"), F.col("p.top").alias("t"), F.col("p.width").alias("w"), F.col("p.height").alias("h"))


# --- digits of other scripts ------------------------------------------------------------

SCRIPTS = ["๐๑๒๓๔๕๖๗๘๙", "০১২৩৪৫৬৭৮৯", "٠١٢٣٤٥٦٧٨٩", "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗"]
_WRITTEN = " ".join(f"when {i} then translate(cast(o_custkey as STR), '0123456789', '{digits}')" for i, digits in enumerate(SCRIPTS))
FRAGMENTS["written_numbers"] = f"select o_orderkey as doc_id, o_custkey as n, case o_orderkey % {len(SCRIPTS)} {_WRITTEN} end as t from @orders"


@check("p01b_digits_of_scripts", """select doc_id, cast(n as varchar) as key, cast(n as bigint) as whole, cast(n as double) as real, cast(n as bigint) as qty from @written_numbers""")
def _(t):
    said = t.sql(FRAGMENTS["written_numbers"])
    return said.select(
        "doc_id", sc.normalize_identifier(F.concat(F.lit("Item "), "t")).alias("key"), sc.safe_int(F.col("t")).alias("whole"),
        sc.safe_float(F.col("t")).alias("real"), sc.extract_qty(F.concat(F.lit("x"), "t")).alias("qty"))
