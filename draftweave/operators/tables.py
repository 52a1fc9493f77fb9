"""Rebuilding BOM rows from word boxes, ruled lines and cell tables.

Words are dealt by image and laid out in tasks (``lines``). Images too large for
that take windows instead: positions are whole pixels, so an image has a bounded
number of distinct heights and left edges, and every order-dependent step works
on those after an aggregation that combines on the map side; no step gathers the
words of such an image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc
from draftweave.operators import lines, nearest, skew
from draftweave.operators.lines import DEFAULT_GAP, GAP_RATIO, GAP_SAMPLE, IMAGE, ROW_TOLERANCE

TABLE = ["doc_id", "page_id", "table_ord"]

# Fixed values.
HEADER_ROWS = 3
MIN_DIVIDERS = 3
MIN_WIDTH_SHARE, MIN_HEIGHT_SHARE = 0.08, 0.02
EXTENT_TOLERANCE = 15

# Header keywords per field, in the order fields are tried.
HEADER_KEYWORDS = {
    "item_no": ["item no", "item#", "item #", "item number", "ref", "no.", "item", "#", "bal", "balloon"],
    "part_number": ["part number", "part no", "part#", "p/n"],
    "qty": ["qty", "quantity", "q'ty"],
    "material": ["material", "matl", "spec", "material spec"],
    "description": ["description", "desc", "part name", "name", "part description"],
}
POSITIONAL_ORDER = ["item_no", "qty", "description", "material"]
MAPPING = "map<string,int>"


# --- words to rows ---------------------------------------------------------------


def real_words(words: DataFrame) -> DataFrame:
    """Words with at least one letter or digit, trimmed (F-05)."""
    return words.filter(sc.has_alphanumeric(F.col("text"))).withColumn("text", sc.trimmed(F.col("text")))


def row_of_centre(words: DataFrame) -> DataFrame:
    """Row number of every distinct vertical centre (W-06).

    Words join a row while within ``ROW_TOLERANCE`` of the running mean of its
    centres. The mean never passes the last centre, so a larger step between
    neighbouring centres always starts a row: runs between such steps are
    folded independently. Equal centres always share a row.
    """
    centre = F.col("top") + F.col("height") / 2
    counted = words.groupBy(*IMAGE, centre.alias("centre")).agg(F.count(F.lit(1)).alias("n"))
    page = W.partitionBy(*IMAGE).orderBy("centre")
    step = F.col("centre") - F.lag("centre").over(page)
    runs = counted.withColumn("_break", F.when(step > ROW_TOLERANCE, 1).otherwise(0)).withColumn(
        "run", F.sum("_break").over(page.rowsBetween(W.unboundedPreceding, 0))
    )
    listed = runs.groupBy(*IMAGE, "run").agg(F.array_sort(F.collect_list(F.struct("centre", "n"))).alias("xs"))
    # A run no taller than the tolerance is one row: the mean stays within it.
    height = F.element_at("xs", -1)["centre"] - F.get("xs", F.lit(0))["centre"]
    one_row = F.transform("xs", lambda x: F.struct(x["centre"].alias("centre"), F.lit(0).alias("row")))
    folded = listed.select(*IMAGE, "run", F.inline(F.when(height <= ROW_TOLERANCE, one_row).otherwise(_folded_rows())))
    number = F.dense_rank().over(W.partitionBy(*IMAGE).orderBy("run", "row"))
    return folded.select(*IMAGE, "centre", number.alias("row_no"))


def _folded_rows() -> Column:
    """Row of each centre of a run ``xs``, from 0, by the running mean."""
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("row"),
        F.filter(F.transform("xs", lambda x: F.struct(x["centre"].alias("centre"), F.lit(0).alias("row"))), lambda x: F.lit(False)).alias("out"),
    )

    def add(acc: Column, x: Column) -> Column:
        stays = (acc["n"] == 0) | (F.abs(x["centre"] - acc["total"] / acc["n"]) <= ROW_TOLERANCE)
        row = F.when(stays, acc["row"]).otherwise(acc["row"] + 1)
        sum_x = x["centre"] * x["n"]
        return F.struct(
            F.when(stays, acc["total"] + sum_x).otherwise(sum_x).alias("total"),
            F.when(stays, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            row.alias("row"),
            F.concat(acc["out"], F.array(F.struct(x["centre"].alias("centre"), row.alias("row")))).alias("out"),
        )

    return F.aggregate("xs", start, add, lambda acc: acc["out"])


READING = ["left", "centre", "word_ord"]


def large_images(words: DataFrame) -> DataFrame | None:
    """Images with more words than a task lays out at once; None when there are none."""
    return skew.hot_groups(words, IMAGE, min(skew.hot_rows(words.sparkSession), lines.IMAGE_WORDS))


def _met(frame: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join by keys that may be null, without a hint: there may be many images just above the limit."""
    named = table.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in table.columns if c not in on])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return frame.join(named, same, how).drop(*[f"_{c}" for c in on])


def text_rows(large: DataFrame) -> DataFrame:
    """Words of large images with their row, ready for a window along the row.

    They are merged per distinct left edge of a row: words with one left edge
    never start a cell between them, as the gap to the previous word is then
    negative. Their texts are joined in reading order, and ``right_last`` is
    the edge the next gap is measured from.
    """
    right = F.col("left") + F.col("width")
    bottom = F.col("top") + F.col("height")
    large = large.withColumn("centre", F.col("top") + F.col("height") / 2)
    rows = _met(large, row_of_centre(large), [*IMAGE, "centre"], "inner")
    order = F.struct("centre", "word_ord")
    return rows.groupBy(*IMAGE, "row_no", "left").agg(
        F.min("centre").alias("centre"), F.min("word_ord").alias("word_ord"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("text").alias("t")))), lambda x: x["t"]
        ).alias("texts"),
        F.max_by(right, order).alias("right_last"),
        F.min("top").alias("top"), F.max(right).alias("right"), F.max(bottom).alias("bottom"),
    )


def word_gaps(rows: DataFrame) -> DataFrame:
    """Distance from the previous word's right edge, null at a row's start (W-04)."""
    line = W.partitionBy(*IMAGE, "row_no").orderBy(*READING)
    return rows.withColumn("gap", F.col("left") - F.lag("right_last").over(line))


def gap_threshold(gapped: DataFrame) -> DataFrame:
    """Gap that separates cells, per image (A-12).

    The widest ratio between neighbouring sorted gaps marks the border; equal
    gaps have ratio 1 and never win, so distinct gaps suffice.
    """
    counted = gapped.filter("gap > 0").groupBy(*IMAGE, "gap").agg(F.count(F.lit(1)).alias("n"))
    nxt = F.lead("gap").over(W.partitionBy(*IMAGE).orderBy("gap"))
    steps = counted.withColumns({
        "ratio": nxt / F.greatest(F.col("gap").cast("double"), F.lit(1.0)),
        "middle": (F.col("gap") + nxt) / 2.0,
    })
    best = steps.groupBy(*IMAGE).agg(
        F.sum("n").alias("n"),
        F.max_by(F.struct("ratio", "middle"), F.struct(F.coalesce("ratio", F.lit(0.0)), -F.col("gap"))).alias("b"),
    )
    usable = (F.col("n") >= GAP_SAMPLE) & F.coalesce(F.col("b.ratio") >= GAP_RATIO, F.lit(False))
    return best.select(*IMAGE, F.when(usable, F.col("b.middle")).otherwise(DEFAULT_GAP).alias("threshold"))


def _laid_out(
    words: DataFrame, hot: DataFrame | None | bool, boxed: bool, wanted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``lines`` of ordinary images, and cells of large ones; only of ``wanted`` images if given."""
    if hot is True:
        hot = large_images(words)
    words = real_words(words)
    if wanted is not None:
        wanted = wanted.select(*[F.col(n).cast(words.schema[n].dataType).alias(n) for n in IMAGE])
    laid = lines.lines(skew.cold_part(words, hot, IMAGE), boxed, wanted)
    if hot is None:
        return laid, None
    large = skew.hot_part(words, hot, IMAGE)
    return laid, _large_cells(large if wanted is None else large.join(wanted, IMAGE, "left_semi"))


def _large_cells(large: DataFrame) -> DataFrame:
    gapped = word_gaps(text_rows(large))
    joined = _met(gapped, gap_threshold(gapped), IMAGE, "left")
    starts = F.when(F.col("gap") > F.coalesce("threshold", F.lit(DEFAULT_GAP)), 1).otherwise(0)
    line = W.partitionBy(*IMAGE, "row_no").orderBy(*READING).rowsBetween(W.unboundedPreceding, 0)
    numbered = joined.withColumn("cell_no", F.sum(starts).over(line).cast("int"))
    return numbered.groupBy(*IMAGE, "row_no", "cell_no").agg(
        F.array_join(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*READING, "texts"))), lambda x: x["texts"])), " "
        ).alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"),
        F.max("right").alias("right"), F.max("bottom").alias("bottom"),
    )


def cells(words: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Cells of every row with text and box (W-05, A-16, X-18)."""
    laid, large = _laid_out(words, hot, True)
    found = laid.select(*IMAGE, F.inline("lines")).select(*IMAGE, "row_no", F.inline("cells"))
    return found if large is None else found.unionByName(large)


def _large_rows(large: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("cell_no", "text")))
    return large.groupBy(*IMAGE, "row_no").agg(listed.alias("cells"))


def row_cells(words: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Texts of the cells of every row, in order, as ``cells``."""
    laid, large = _laid_out(words, hot, False)
    rows = laid.select(*IMAGE, F.inline("lines"))
    rows = rows if large is None else rows.unionByName(_large_rows(large))
    return rows.withColumn("cells", F.col("cells.text"))


def gaps(words: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """``row_no, left, word_ord, gap`` of words that have a gap before them (W-04)."""
    if hot is True:
        hot = large_images(words)
    words = real_words(words)
    found = lines.gaps(skew.cold_part(words, hot, IMAGE))
    if hot is None:
        return found
    large = word_gaps(text_rows(skew.hot_part(words, hot, IMAGE))).filter("gap is not null")
    return found.unionByName(large.select(*found.columns))


def gap_thresholds(words: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Gap that separates cells, of every image that has gaps (A-12)."""
    if hot is True:
        hot = large_images(words)
    words = real_words(words)
    found = lines.thresholds(skew.cold_part(words, hot, IMAGE))
    if hot is None:
        return found
    return found.unionByName(gap_threshold(word_gaps(text_rows(skew.hot_part(words, hot, IMAGE)))))


def digit_override(cell_table: DataFrame, digits: DataFrame) -> DataFrame:
    """Digits-only reading beside each cell's text (J-11).

    Only item and quantity cells use it, once the header names them.
    """
    on = [*IMAGE, "row_no", "cell_no"]
    reading = sc.blank_to_null(F.regexp_replace("digits", r"(?U)\D", ""))
    return cell_table.join(digits.select(*on, reading.alias("digits")), on, "left")


# --- header and rows ---------------------------------------------------------------


def map_columns(header: Column) -> Column:
    """Field to column index by keyword, left to right; null without a hit (W-08)."""
    numbered = F.transform(header, lambda cell, i: F.struct(
        F.lower(sc.strip(F.coalesce(cell, F.lit("")))).alias("text"), i.alias("i")
    ))

    def place(acc: Column, cell: Column) -> Column:
        hit = F
        for name, words in HEADER_KEYWORDS.items():
            said = reduce(Column.__or__, [F.contains(cell["text"], F.lit(w)) for w in words])
            hit = hit.when(said & ~F.map_contains_key(acc, F.lit(name)), F.lit(name))
        # Through a list of one, as a lambda works out a column anew wherever it is named.
        entry = F.filter(F.array(F.struct(hit.alias("key"), cell["i"].alias("value"))), lambda e: e["key"].isNotNull())
        return F.when(cell["text"] == "", acc).otherwise(F.map_concat(acc, F.map_from_entries(entry)))

    mapped = F.aggregate(numbered, F.create_map().cast(MAPPING), place, lambda acc: F.when(F.size(acc) > 0, acc))
    return mapped


def positional_mapping() -> Column:
    return F.create_map(*[c for i, name in enumerate(POSITIONAL_ORDER) for c in (F.lit(name), F.lit(i))])


def header_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Column mapping and header row per image, from its first three rows (W-07, O-05)."""
    tried = rows.filter(F.col("row_no") <= HEADER_ROWS).withColumn("mapping", map_columns(F.col("cells")))
    first = F.min_by(F.when(F.col("mapping").isNotNull(), F.struct("row_no", "mapping")),
                     F.when(F.col("mapping").isNotNull(), F.col("row_no")))
    return tried.groupBy(*by).agg(first.alias("h")).select(
        *by,
        F.coalesce("h.row_no", F.lit(0)).alias("header_no"),
        F.coalesce("h.mapping", positional_mapping()).alias("mapping"),
    )


def bom_fields(rows: DataFrame, cells_col: Column, mapping: Column, kept: list[str], digits: Column | None = None) -> DataFrame:
    """BOM rows of lists of cells, those with an item number (F-04, P-08..P-11)."""

    def cell(name: str, numeric: bool = False) -> Column:
        at = F.try_element_at(mapping, F.lit(name))
        text = sc.get_cell(cells_col, at)
        if numeric and digits is not None:
            read = sc.get_cell(digits, at)
            text = F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(read, text)).otherwise(text)
        return text

    # A generator works out each cell once; a blank row gives none.
    record = F.struct(
        sc.digit_run(cell("item_no", True)).alias("_item"),
        sc.clean_cell(cell("description")).alias("description"),
        sc.digit_run(cell("qty", True)).alias("_qty"),
        sc.clean_cell(cell("material")).alias("_material"),
        sc.clean_cell(cell("part_number")).alias("_part"),
    )
    filled = F.exists(cells_col, lambda c: sc.clean_cell(c) != "")
    found = rows.select(*kept, F.inline(F.when(filled, F.array(record)))).filter("_item <> ''")
    return found.select(
        *kept, F.col("_item").alias("item_no"), "description",
        sc.ascii_digits(F.col("_qty")).try_cast("bigint").alias("qty"),
        sc.blank_to_null(F.col("_material")).alias("material"), sc.blank_to_null(F.col("_part")).alias("part_number"),
    )


def _headed(laid: DataFrame) -> DataFrame:
    """Rows below the header of images with two rows or more, with the header's mapping."""
    row = lambda i: F.get("lines", F.lit(i))
    tried = F.array(*[
        F.struct(row(i)["row_no"].alias("row_no"), map_columns(row(i)["cells"]["text"]).alias("mapping")) for i in range(HEADER_ROWS)
    ])
    head = F.get(F.filter(tried, lambda h: h["mapping"].isNotNull()), F.lit(0))
    known = laid.filter(F.size("lines") >= 2).withColumn("_head", head)
    rows = known.select(
        *IMAGE, F.coalesce("_head.row_no", F.lit(0)).alias("header_no"),
        F.coalesce("_head.mapping", positional_mapping()).alias("mapping"), F.inline("lines"),
    )
    return rows.filter(F.col("row_no") > F.col("header_no")).drop("header_no")


def _large_headed(large: DataFrame) -> DataFrame:
    """:func:`_headed` of images of any size, by windows."""
    image = W.partitionBy(*IMAGE)
    head = F.when(F.col("row_no") <= HEADER_ROWS, map_columns(F.col("cells.text")))
    rows = _large_rows(large).withColumn("rows", F.count(F.lit(1)).over(image)).filter("rows >= 2").withColumn("_map", head)
    at = F.when(F.col("_map").isNotNull(), F.col("row_no"))
    body = rows.withColumns({
        "header_no": F.coalesce(F.min(at).over(image), F.lit(0)),
        "mapping": F.coalesce(F.min_by("_map", at).over(image), positional_mapping()),
    })
    return body.filter(F.col("row_no") > F.col("header_no")).select(*IMAGE, "mapping", "row_no", "cells")


def _with_digits(rows: DataFrame, digits: DataFrame) -> DataFrame:
    """:func:`digit_override` on rows of cells: each cell meets the readings of its row, in ``read``.

    Rows without a reading keep their cells as they are, and ``read`` is null.
    """
    on = [*IMAGE, "row_no"]
    reading = sc.blank_to_null(F.regexp_replace("digits", r"(?U)\D", ""))
    read = digits.groupBy(*on).agg(F.collect_list(F.struct("cell_no", reading.alias("digits"))).alias("_read"))

    def met(c: Column) -> Column:
        near = F.filter("_read", lambda d: d["cell_no"] == c["cell_no"])
        cell = lambda text: F.struct(c["cell_no"].alias("cell_no"), c["text"].alias("text"), text.cast("string").alias("digits"))
        return F.when(F.size(near) > 0, F.transform(near, lambda d: cell(d["digits"]))).otherwise(F.array(cell(F.lit(None))))

    both = F.when(F.col("_read").isNotNull(), F.array_sort(F.flatten(F.transform("cells", met))))
    joined = sc.computed(rows.join(read, on, "left"), {"_met": both}).drop("_read")
    return joined.withColumns({"texts": F.coalesce("_met.text", "cells.text"), "read": F.col("_met.digits")}).drop("_met", "cells")


def rows_from_words(
    words: DataFrame, digits: DataFrame | None = None, hot: DataFrame | None | bool = True
) -> DataFrame:
    """BOM rows of every image read by OCR (W-04..W-08, A-12, J-11)."""
    return _rows_of(*_laid_out(words, hot, False), digits)


def _rows_of(laid: DataFrame, large: DataFrame | None, digits: DataFrame | None) -> DataFrame:
    rows = _headed(laid)
    if large is not None:
        rows = rows.unionByName(_large_headed(large))
    text, read = F.col("cells.text"), None
    if digits is not None:
        rows, text, read = _with_digits(rows, digits), F.col("texts"), F.col("read")
    return bom_fields(rows.withColumnRenamed("row_no", "row_ord"), text, F.col("mapping"), [*IMAGE, "row_ord"], read)


def rows_from_cell_tables(cell_tables: DataFrame) -> DataFrame:
    """BOM rows of vector tables; short or unmapped tables give none (E-03)."""
    header = F.transform(F.get("cells", F.lit(0)), sc.clean_cell)
    mapped = sc.computed(cell_tables.filter(F.size("cells") >= 2), {"mapping": map_columns(header)}).filter(
        "mapping is not null"
    )
    body = mapped.select(
        *TABLE, "mapping",
        F.posexplode(F.slice("cells", F.lit(2), F.size("cells") - 1)).alias("row_ord", "row"),
    )
    return bom_fields(body, F.col("row"), F.col("mapping"), [*TABLE, "row_ord"])


# --- ruled regions -----------------------------------------------------------------


def wide_segments(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Horizontal rules at least 8 % of the page wide (F-10).

    Of a page without a size no rule is wide; ``inventory.unsized_pages`` names
    such pages.
    """
    hot = skew.hot_groups(segments, ["doc_id", "page_id"])
    sized = skew.lookup(
        segments, pages.select("doc_id", "page_id", F.col("width").alias("page_width"), F.col("height").alias("page_height")),
        ["doc_id", "page_id"], hot, "left",
    )
    return sized.filter(F.col("w") >= F.col("page_width") * MIN_WIDTH_SHARE)


def table_regions(wide: DataFrame) -> DataFrame:
    """Regions bounded by rules that share both ends (W-11, O-03).

    A rule joins the earliest group whose first member lies within 15 px at
    both ends. Rules with equal ends always share a group, so each distinct
    pair of ends stands for its rules.
    """
    page = ["doc_id", "page_id"]
    ends = wide.groupBy(*page, F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1")).agg(
        F.min("seg_ord").alias("ord"), F.count(F.lit(1)).alias("n"),
        F.min("y").alias("ymin"), F.max(F.col("y") + F.col("h")).alias("ymax"),
        F.first("page_height").alias("page_height"),
    )
    shape = F.struct("x0", "x1", "n", "ymin", "ymax", "page_height")
    step = EXTENT_TOLERANCE + 1
    cell = F.struct(F.floor(F.col("x0") / step).alias("a"), F.floor(F.col("x1") / step).alias("b"))

    def clash(a: Column, b: Column) -> Column:
        return (F.abs(a["x0"] - b["x0"]) <= EXTENT_TOLERANCE) & (F.abs(a["x1"] - b["x1"]) <= EXTENT_TOLERANCE)

    def neighbours(c: Column) -> Column:
        around = lambda v: F.sequence(v - 1, v + 1)
        return F.flatten(F.transform(around(c["a"]), lambda a: F.transform(
            around(c["b"]), lambda b: F.struct(a.alias("a"), b.alias("b"))
        )))

    decided = nearest.decide(
        ends.withColumn("id", F.col("ord")), page, F.struct("ord"), shape, clash, cell, neighbours
    )
    leader = F.coalesce("keeper.id", "id")
    s = F.col("shape")
    regions = decided.groupBy(*page, leader.alias("leader")).agg(
        F.sum(s["n"]).alias("row_count"),
        F.min(s["x0"]).alias("xmin"), F.min(s["ymin"]).alias("ymin"),
        F.max(s["x1"]).alias("xmax"), F.max(s["ymax"]).alias("ymax"),
        F.first(s["page_height"]).alias("page_height"),
    ).filter(
        (F.col("row_count") >= MIN_DIVIDERS)
        & (F.col("ymax") - F.col("ymin") >= F.col("page_height") * MIN_HEIGHT_SHARE)
    ).drop("page_height")
    # Regions per page are bounded by its width, so a plain window orders them.
    order = W.partitionBy(*page).orderBy(F.desc("row_count"), "leader")
    return regions.withColumn("region_rank", F.row_number().over(order)).drop("leader")


# --- choice of source ----------------------------------------------------------------


def first_source(candidates: DataFrame) -> DataFrame:
    """Rows of the first source of a page that has any (W-12).

    Sources are ordered by ``source_kind`` (vector tables, then ruled regions,
    then the whole page) and ``source_ord`` within a kind: the table's ordinal
    or the region's rank.
    """
    # BOM rows, unlike words, are few per page: a plain window picks the source.
    rank = F.struct("source_kind", "source_ord")
    best = F.min(rank).over(W.partitionBy("doc_id", "page_id"))
    return candidates.withColumns({"_rank": rank, "_best": best}).filter("_rank = _best").drop("_rank", "_best")


WHOLE_PAGE = "page"
VECTOR_TABLE, RULED_REGION, PAGE_IMAGE = 0, 1, 2


def unserved(contents: DataFrame, served: DataFrame) -> DataFrame:
    """Contents of the pages of which ``served`` holds no row; null keys are pages like any other.

    The join carries no hint: Spark broadcasts the served pages only while
    their measured size allows it, and else shuffles by page.
    """
    pages = served.select(F.col("doc_id").alias("_doc"), F.col("page_id").alias("_page")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page_id").eqNullSafe(F.col("_page"))
    return contents.join(pages, same, "left_anti")


def extract_bom(
    words: DataFrame,
    regions: DataFrame | None = None,
    cell_tables: DataFrame | None = None,
    digits: DataFrame | None = None,
) -> DataFrame:
    """BOM rows per page from the best source that yields any.

    ``words.region_id`` names the ruled region a word was read in (its
    ``region_rank`` as text) or ``page`` for the whole page.

    The sources run one after the other, each over the pages that the earlier
    ones left without rows, so words of served pages are never clustered. The
    rows of vector tables and of ruled regions, few beside the words, are
    written to the shared folder while the plan is built; the whole pages are
    read when the result is.
    """
    page = ["doc_id", "page_id"]
    fields = ["item_no", "description", "qty", "material", "part_number"]
    hot = large_images(words)
    whole = F.coalesce(F.col("region_id") == WHOLE_PAGE, F.lit(False))
    found = []

    def source(rows: DataFrame, kind: int, ordinal: Column) -> DataFrame:
        return first_source(rows.select(
            *page, F.lit(kind).alias("source_kind"), ordinal.cast("bigint").alias("source_ord"), "row_ord", *fields
        ))

    def left(contents: DataFrame) -> DataFrame:
        if not found:
            return contents
        return unserved(contents, reduce(DataFrame.unionAll, [rows.select(*page) for rows in found]))

    def read(laid: tuple[DataFrame, DataFrame | None], kind: int, ordinal: Column, part: Column) -> DataFrame:
        return source(_rows_of(*laid, None if digits is None else digits.filter(part)), kind, ordinal)

    if cell_tables is not None:
        found.append(skew.written(source(rows_from_cell_tables(cell_tables), VECTOR_TABLE, F.col("table_ord"))))
    inside = words.filter(~whole)
    if regions is None:
        laid = _laid_out(left(inside), hot, False)
    else:
        known = regions.select(*page, F.col("region_rank").cast("string").alias("region_id"))
        laid = _laid_out(inside, hot, False, left(known.filter("doc_id is not null and page_id is not null")))
    found.append(skew.written(read(laid, RULED_REGION, F.col("region_id").try_cast("bigint"), ~whole)))
    found.append(read(_laid_out(left(words.filter(whole)), hot, False), PAGE_IMAGE, F.lit(0), whole))
    return reduce(DataFrame.unionByName, found)


def to_contract(rows: DataFrame) -> DataFrame:
    """Extracted rows under the shared names (P-21)."""
    return rows.select(
        *[c for c in rows.columns if c in ("doc_id", "page_id", "source_kind", "source_ord", "row_ord")],
        F.col("item_no").alias("item_number"), "part_number",
        F.lit(None).cast("string").alias("part_name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("qty").alias("quantity"),
        F.col("material").alias("material_specification"),
        F.lit(None).cast("double").alias("confidence_score"),
    )
