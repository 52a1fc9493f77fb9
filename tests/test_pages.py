"""Tiles, overlaps, candidates, tables and verdicts on literal rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.inputs import Inputs
from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import candidates as cand
from draftweave.operators import dedupe, diff, lines, responses, skew, tables, verification
from tests.conftest import rows

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def boxes(spark, items):
    data = [(1, "p", i, b, c, tuple(map(float, xs))) for i, (b, c, xs) in enumerate(items)]
    return spark.createDataFrame(data, f"doc_id long, page_id string, call_ord long, bubble_number string, confidence_score double, bubble_bbox {BOX}")


def test_dedupe_keeps_the_surer_box(spark):
    frame = boxes(spark, [("3", 0.80, (110, 110, 210, 210)), ("3", 0.95, (100, 100, 200, 200)), ("3", 0.9, (500, 500, 600, 600)), ("4", 0.7, (100, 100, 200, 200))])
    assert rows(dedupe.dedupe_callouts(frame), "call_ord") == [(1,), (2,), (3,)]
    assert rows(dedupe.overlap_pairs(frame), "kept_ord", "dropped_ord") == [(1, 0)]


def brute_force(items, iou=0.5):
    def overlap(a, b):
        w = max(0.0, min(a[2], b[2]) - max(a[0], b[0])); h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w * h / (area(a) + area(b) - w * h) if w * h > 0 else 0.0
    kept = []
    for i in sorted(range(len(items)), key=lambda i: (-items[i][1], i)):
        if not any(items[k][0] == items[i][0] and overlap(items[k][2], items[i][2]) >= iou for k in kept):
            kept.append(i)
    return sorted(((i,) for i in kept), key=lambda r: str(r[0]))


def pile():
    out = []
    for i in range(40):
        x, y, w = (i * 37) % 90, (i * 53) % 70, 20 + (i * 7) % 45
        out.append((str(i % 2), 0.5 + (i * 11 % 50) / 100, (x, y, x + w, y + w + i % 9)))
    return out + [("0", 0.6, (5, 5, 40, 40))] * 6 + [("1", 0.6, (5, 5, 5, 40))] * 3


def test_rounds_equal_the_greedy_walk(spark, small_groups):
    items = pile()
    frame = boxes(spark, items)
    decided = dedupe._decided(frame, 0.5)
    assert rows(decided.filter("keeper is null"), "id.call_ord") == brute_force(items)
    dropped = rows(decided.filter("keeper is not null"), "keeper.id.call_ord", "id.call_ord")
    spark.conf.set("spark.draftweave.foldRows", "1000")
    assert rows(dedupe.overlap_pairs(frame), "kept_ord", "dropped_ord") == dropped


def test_fold_equals_the_greedy_walk(spark):
    items = pile()
    frame = boxes(spark, items).repartition(3)
    assert rows(dedupe.dedupe_callouts(frame), "call_ord") == brute_force(items)


def test_ranks_across_slices(spark, small_groups):
    frame = spark.range(200).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1009).alias("v"), "id")
    order = [F.col("v"), F.col("id")]
    plain = rows(skew.ranked(frame, ["g"], order, "rn"))
    hot = skew.hot_groups(frame, ["g"])
    assert hot is not None and rows(skew.ranked(frame, ["g"], order, "rn", hot)) == plain


def test_tiles(spark):
    page = spark.createDataFrame([(1, "p", 1000, 1000)], "doc_id long, page_id string, width int, height int")
    got = {r["tile"]: r for r in dedupe.tiles(page).collect()}
    assert got["tile[r0c0]"]["x1"] == 530 and got["tile[r0c1]"]["x0"] == 470 and len(got) == 4


def contours(spark, values):
    data = [(1, "p", i, c * 3.141592653589793 * r * r, float(10 * i), 5.0, float(r)) for i, (r, c) in enumerate(values)]
    return spark.createDataFrame(data, "doc_id long, page_id string, contour_ord long, area double, cx double, cy double, radius double")


CLOUD = [(12 + i % 4, c) for i, c in enumerate([0.60, 0.63, 0.66, 0.70, 0.74, 0.78, 0.93, 0.94, 0.95])]


def check_candidates(spark):
    frame = contours(spark, CLOUD)
    cut = cand.calibrate_circularity(cand.loose_candidates(frame)).first()["cutoff"]
    assert 0.78 < cut < 0.93
    assert rows(cand.select_candidates(frame), "crop_id", "contour_ord") == [("p_c0001", 6), ("p_c0002", 7), ("p_c0003", 8)]


def test_candidates(spark):
    check_candidates(spark)


def test_candidates_of_a_large_page(spark, small_groups):
    check_candidates(spark)


def test_radius_range(spark):
    frame = contours(spark, [(r, 0.9) for r in (10, 11, 12, 12, 13, 14, 50)])
    assert rows(cand.calibrate_radius(cand.loose_candidates(frame)), "low", "high") == [(10.0, 30.0)]


def words(spark, items):
    data = [(1, "p", "page", i, t, x, y, w, 10) for i, (t, x, y, w) in enumerate(items)]
    return spark.createDataFrame(data, "doc_id long, page_id string, region_id string, word_ord long, text string, left int, top int, width int, height int")


TABLE = [("PARTS", 10, 5, 40), ("ITEM", 0, 50, 30), ("QTY", 60, 52, 30), ("DESCRIPTION", 120, 51, 80),
         ("07", 0, 80, 12), ("x2", 60, 82, 12), ("Hex", 120, 81, 25), ("bolt", 149, 79, 30), ("|", 110, 80, 2),
         ("8", 0, 110, 8), ("4", 60, 111, 8), ("Nut", 120, 110, 25)]


def test_rows_from_words(spark):
    got = rows(tables.rows_from_words(words(spark, TABLE).repartition(4)), "item_no", "qty", "description")
    assert got == [("07", 2, "Hex bolt"), ("8", 4, "Nut")]


def test_rows_from_words_of_a_large_page(spark, small_groups):
    got = rows(tables.rows_from_words(words(spark, TABLE)), "item_no", "qty", "description")
    assert got == [("07", 2, "Hex bolt"), ("8", 4, "Nut")]


def test_digit_reading_replaces_item_cells(spark):
    digits = spark.createDataFrame([(1, "p", "page", 3, 0, "9")], "doc_id long, page_id string, region_id string, row_no int, cell_no int, digits string")
    assert rows(tables.rows_from_words(words(spark, TABLE), digits), "item_no") == [("8",), ("9",)]


def test_running_mean_of_a_row(spark):
    # 0, 10 and 15 share a row: 15 is within 10 of their mean; 19 is not.
    frame = words(spark, [("a", 0, 0, 5), ("b", 9, 10, 5), ("c", 20, 15, 5), ("d", 30, 19, 5)])
    assert rows(tables.row_of_centre(frame), "centre", "row_no") == [(15.0, 1), (20.0, 1), (24.0, 2), (5.0, 1)]


def test_header_map(spark):
    def mapped(cells):
        return spark.createDataFrame([(cells,)], "c array<string>").select(tables.map_columns(F.col("c"))).first()[0]
    assert mapped(["#", "Desc", "Q'ty", "Matl"]) == {"item_no": 0, "description": 1, "qty": 2, "material": 3}
    assert mapped(["ITEM", "PART NUMBER", "DESCRIPTION", "MATERIAL", "QTY"])["part_number"] == 1
    assert mapped(["alpha", None, ""]) is None


def regions(spark):
    data = [(1, "p", i, x, 100 + 30 * i, w, 2) for i, (x, w) in enumerate([(50, 800), (52, 799), (40, 805), (500, 300), (60, 790), (48, 801)])]
    segs = spark.createDataFrame(data, "doc_id long, page_id string, seg_ord long, x int, y int, w int, h int")
    pages = spark.createDataFrame([(1, "p", 1000, 1000)], "doc_id long, page_id string, width int, height int")
    return rows(tables.table_regions(tables.wide_segments(segs, pages)), "row_count", "xmin", "ymin", "xmax", "ymax", "region_rank")


def test_ruled_region(spark):
    assert regions(spark) == [(5, 40, 100, 851, 252, 1)]


def test_ruled_region_in_rounds(spark, small_groups):
    assert regions(spark) == [(5, 40, 100, 851, 252, 1)]


def diff_rows(spark):
    bom = spark.createDataFrame([(1, "1"), (1, "2")], "doc_id long, item_number string")
    seen = spark.createDataFrame([(1, i, f"c{i}", True, n) for i, n in enumerate([1, 1, 1, 1, 1, 3])], "doc_id long, ord long, crop_id string, is_balloon boolean, number long")
    counts = rows(diff.diff(bom, seen), "key", "kind", "bom_count", "balloon_count")
    return counts, rows(diff.balloon_duplicates(seen), "key", "count"), rows(diff.balloon_crops(seen), "key", "position", "crop_id")


DIFF = (
    [("1", "matched", 1, 5), ("2", "missing", 1, 0), ("3", "extra", 0, 1)], [("1", 5)],
    [("1", i + 1, f"c{i}") for i in range(5)] + [("3", 1, "c5")],
)


def test_diff_and_crops(spark):
    assert diff_rows(spark) == DIFF


def test_diff_of_a_large_key(spark, small_groups):
    assert diff_rows(spark) == DIFF


def warned(spark):
    said = spark.createDataFrame([(1, f"p{i % 2}", i, f"w{i}") for i in range(7)], "doc_id long, page_id string, ord long, warning string")
    return diff.collect_warnings(said, [F.col("ord")])


def test_warnings_in_order(spark):
    assert rows(warned(spark), "position", "warning") == [(i + 1, f"p{i % 2}: w{i}") for i in range(7)]


def test_warnings_of_a_large_document(spark, small_groups):
    assert rows(warned(spark), "position", "warning") == [(i + 1, f"p{i % 2}: w{i}") for i in range(7)]


def test_null_keys_are_a_large_group_too(spark):
    frame = spark.createDataFrame([(None, i) for i in range(5)] + [(1, 9)], "doc_id long, v long")
    hot = skew.hot_groups(frame, ["doc_id"], 3)
    assert rows(skew.hot_part(frame, hot, ["doc_id"]), "v") == [(i,) for i in range(5)]
    assert rows(skew.cold_part(frame, hot, ["doc_id"]), "v") == [(9,)]


def test_source_order_looks_at_the_kind_first(spark):
    given = [(1, "p", 0, 3_000_000_000, 0), (1, "p", 1, 1, 0), (1, "p", 2, 0, 0), (1, "q", 2, 0, 0), (1, "q", 1, 7, 1), (1, "q", 1, 2, 0)]
    frame = spark.createDataFrame(given, "doc_id long, page_id string, source_kind int, source_ord long, row_ord long")
    assert rows(tables.first_source(frame), "page_id", "source_kind", "source_ord") == [("p", 0, 3_000_000_000), ("q", 1, 2)]


def sources(spark):
    """Vector tables serve page v, a ruled region page r, the whole page w; page n has only its words."""
    text = lambda page, region: [(1, page, region, i, t, x, y, w, 10) for i, (t, x, y, w) in enumerate(TABLE)]
    schema = "doc_id long, page_id string, region_id string, word_ord long, text string, left int, top int, width int, height int"
    places = [("v", "page"), ("v", "1"), ("r", "page"), ("r", "1"), ("r", "2"), ("w", "page"), ("w", "9"), ("n", "page"), ("w", None)]
    found = spark.createDataFrame([row for at in places for row in text(*at)], schema)
    ruled = spark.createDataFrame([(1, p, r) for p, r in [("v", 1), ("r", 1), ("r", 2), ("w", 1)]], "doc_id long, page_id string, region_rank int")
    vector = spark.createDataFrame([
        (1, "v", 5, [["Item", "Qty"], ["4", "2"]]), (1, "v", 6, [["Item", "Qty"], ["5", "2"]]), (1, "r", 7, [["Item", "Qty"]]),
    ], "doc_id long, page_id string, table_ord long, cells array<array<string>>")
    return found, ruled, vector


SERVED = [("n", 2, 0, "07"), ("n", 2, 0, "8"), ("r", 1, 1, "07"), ("r", 1, 1, "8"), ("v", 0, 5, "4"), ("w", 2, 0, "07"), ("w", 2, 0, "8")]


def served_rows(spark):
    return rows(tables.extract_bom(*sources(spark)), "page_id", "source_kind", "source_ord", "item_no")


def test_each_page_stops_at_its_first_source(spark):
    assert served_rows(spark) == SERVED


def test_each_large_page_stops_at_its_first_source(spark, small_groups):
    assert served_rows(spark) == SERVED


def test_served_pages_may_be_too_many_for_a_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert served_rows(spark) == SERVED
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_page_without_a_name_has_sources_too(spark):
    nameless = words(spark, TABLE).withColumn("page_id", F.lit(None).cast("string"))
    served = spark.createDataFrame([(1, "p")], "doc_id long, page_id string")
    assert rows(tables.extract_bom(nameless), "page_id", "source_kind", "item_no") == [(None, 2, "07"), (None, 2, "8")]
    assert tables.unserved(nameless, served).count() == len(TABLE)
    assert tables.unserved(nameless, nameless).count() == 0


def test_sources_without_regions_or_tables(spark):
    found, _, vector = sources(spark)
    pick = ("page_id", "source_kind", "source_ord")
    assert set(rows(tables.extract_bom(found, None, vector), *pick)) == {("n", 2, 0), ("r", 1, 1), ("v", 0, 5), ("w", 1, None)}
    assert set(rows(tables.extract_bom(found.limit(0)), *pick)) == set()


def shuffled_rows(frame):
    """Rows that the exchanges of a collected frame by image wrote, by the plan's own metrics."""
    def nodes(plan):
        yield plan
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
        children = plan.children()
        for child in inner + [children.apply(i) for i in range(children.size())]:
            yield from nodes(child)
    return [
        n.metrics().apply("shuffleRecordsWritten").value() for n in nodes(frame._jdf.queryExecution().executedPlan())
        if n.getClass().getSimpleName() == "ShuffleExchangeExec" and n.shuffleOrigin().toString() == "REPARTITION_BY_COL"
    ]


def test_words_of_served_pages_are_not_clustered(spark):
    found, ruled, vector = sources(spark)
    last = tables.extract_bom(found, ruled, vector)
    last.collect()
    spoken = sum(any(c.isalnum() for c in t) for t, *_ in TABLE)
    # Of five whole pages of words only those of pages w and n are left.
    assert set(shuffled_rows(last)) == {2 * spoken}


def test_ordinals_of_pages_without_a_number_and_of_two_requests(spark):
    given = [("front", "a", 0), ("back", "a", 0), ("page_010", "a", 0), ("page_002", "b", 1), ("page_002", "b", 0), ("page_002", "a", 5)]
    frame = spark.createDataFrame(given, "page_id string, tile string, i long").withColumn("ord", sc.place("tile", "i"))
    assert [tuple(r)[:3] for r in frame.orderBy("ord").collect()] == [given[1], given[0], given[5], given[4], given[3], given[2]]


def test_classification_text(spark):
    texts = ['Sure: {"is_balloon": true, "number": 3, "confidence": 0.9} ok', '{"is_balloon": true, "number": null}', '{"is_balloon": true, "number": 2, "confidence": 5.0}', "no"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "crop_id int, response_text string")
    got = responses.parse_classifications(frame).orderBy("crop_id").collect()
    assert [(r["is_balloon"], r["number"], r["confidence"]) for r in got] == [(True, 3, 0.9), (False, None, 0.0), (True, 2, 1.0), (False, None, 0.0)]
    assert got[3]["error"].startswith("unparseable response")


def test_pixel_box_is_scaled(spark):
    text = '```json\n{"callouts": [{"bubble_number": 5, "bubble_bbox": {"xmin": 400, "ymin": 800, "xmax": 1200, "ymax": 1600}, "confidence_score": 0.9}]}\n```'
    frame = spark.createDataFrame([(1, "p", "callouts", "", text, 4000, 4000)], "doc_id long, page_id string, stage string, tile string, response_text string, width int, height int")
    checked = responses.validate_callouts(responses.list_items(responses.parse_json_response(frame), "callouts"), 0.7, "width", "height")
    row = checked.first()
    assert tuple(row["bubble_bbox"]) == (100.0, 200.0, 300.0, 400.0)
    assert (row["bubble_number"], row["leader_line_status"], row["warnings"]) == ("5", "missing", [])


def test_verdicts(spark):
    frame = boxes(spark, [("1", 0.9, (1, 1, 2, 2)), ("2", 0.9, (5, 5, 6, 6)), ("3", 0.9, (7, 7, 8, 8))]).withColumns({
        "location_description": F.lit("x"), "leader_line_status": F.lit("missing"), "leader_endpoint": F.lit(None).cast("struct<x:double,y:double>")})
    texts = ['{"valid": true, "bubble_number": "1", "leader_visible": false, "endpoint_visible": false, "confidence_score": 0.97}', '{"valid": false, "reason": "blank"}']
    said = spark.createDataFrame([(1, "p", i, t) for i, t in enumerate(texts)], "doc_id long, page_id string, call_ord long, response_text string")
    out = verification.apply_verification(frame, verification.parse_verifications(said))
    assert rows(out, "bubble_number", "confidence_score", "kept") == [("1", 0.97, True), ("2", 0.9, False), ("3", 0.9, True)]


def test_missing_coordinates_stay_missing(spark):
    frame = spark.createDataFrame([(None,)], "x double")
    assert frame.select(geo.clamp(F.col("x"))).first()[0] is None


def test_tiled_callouts_warn_of_repeats(spark):
    page = spark.createDataFrame([(1, "p", 1000, 1000)], "doc_id long, page_id string, width int, height int")
    found = '{"callouts":[{"bubble_number":"3","bubble_bbox":{"xmin":%d,"ymin":400,"xmax":%d,"ymax":450},"confidence_score":%s}]}'
    sent = [(1, "p", "tile[r0c0]", found % (900, 950, "0.90")), (1, "p", "tile[r0c1]", found % (10, 60, "0.95")), (1, "p", "tile[r1c0]", "sorry"),
            (1, "p", "tile[r7c7]", found % (10, 60, "0.95"))]
    responded = spark.createDataFrame(sent, "doc_id long, page_id string, tile string, response_text string")
    kept, warnings = responses.tiled_callouts(responded, dedupe.tiles(page))
    assert rows(kept, "bubble_number", "confidence_score") == [("3", 0.95)]
    assert rows(warnings, "tile", "warning") == [
        ("tile[r1c0]", "Callout detection failed on tile[r1c0]: Malformed JSON in vision model response"),
        ("tile[r7c7]", "Response for unknown tile tile[r7c7] was not used"),
        (None, "Deduplicated overlapping callout bubble '3': kept confidence=0.95, dropped confidence=0.90 (IoU>=0.5)"),
    ]


def test_every_order_gives_a_tile_response(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    assert t.tile_responses.count() == t.shared("orders").count()


def crowd(seed, n, height, ordinal):
    """Words of many images, some with null keys, crowded enough that rows touch."""
    draw = random.Random(seed)
    images = [(1, "p", "page"), (1, "p", "1"), (2, None, "page"), (2, None, None), (3, "q", "page")]
    return [
        (*draw.choice(images), ordinal(i), f" w{i}　" if i % 7 else "--", draw.randrange(0, 400), draw.randrange(0, height), draw.randrange(0, 30), draw.randrange(0, 9))
        for i in range(n)
    ]


WORD = "doc_id long, page_id string, region_id string, word_ord {}, text string, left int, top int, width int, height int"


@pytest.mark.parametrize("height", [40, 400, 4000])
def test_tasks_lay_out_words_as_windows_do(spark, height):
    frame = spark.createDataFrame(crowd(height, 600, height, lambda i: i * 37 % 600), WORD.format("long")).repartition(5).cache()
    every = frame.select(*tables.IMAGE).distinct()
    assert rows(tables.cells(frame)) == rows(tables.cells(frame, every).select(*tables.cells(frame).columns))
    assert rows(tables.gap_thresholds(frame)) == rows(tables.gap_thresholds(frame, every))
    got, want = tables.rows_from_words(frame), tables.rows_from_words(frame, None, every)
    assert rows(got) == rows(want.select(*got.columns))


def test_ordinals_of_several_parts_keep_their_order(spark):
    data = crowd(5, 300, 60, lambda i: (i % 3, str(i)))
    frame = spark.createDataFrame(data, WORD.format("struct<a:int,b:string>")).repartition(3)
    plain = {o: n for n, o in enumerate(sorted(r[3] for r in data))}
    again = spark.createDataFrame([(*r[:3], plain[r[3]], *r[4:]) for r in data], WORD.format("long"))
    assert rows(tables.cells(frame)) == rows(tables.cells(again))


def test_words_meet_one_exchange_and_no_window(spark):
    frame = spark.createDataFrame(crowd(1, 50, 60, lambda i: i), WORD.format("long"))
    plan = tables.cells(frame, None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_images_of_one_hash_and_over_many_batches():
    data = sorted(crowd(9, 400, 90, lambda i: i), key=lambda r: r[3])
    names = [f.split()[0] for f in WORD.split(", ")]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) | {
        "_image": 7, "_ord": r[3], "right": r[5] + r[7], "bottom": r[6] + r[8], "centre": r[6] + r[8] / 2,
    } for r in data])
    pieces = [batch.slice(i, 3) for i in range(0, 400, 3)]
    one, = lines._whole_images(iter(pieces))
    mixed, found = lines._read(one)
    alone = []
    for key in {r[:3] for r in data}:
        keep = pa.array([r[:3] == key for r in data])
        part, lay = lines._read(batch.filter(keep))
        alone.append((len(lay.images), len(lay.lines), len(lay.cells)))
    assert len(found.images) == 5 and one.num_rows == 400
    assert [len(found.images), len(found.lines), len(found.cells)] == [sum(x) for x in zip(*alone)]


def test_trimmed_removes_what_a_pattern_for_whitespace_does(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in chars], "t string")
    wrong = frame.filter(sc.trimmed(F.col("t")) != sc.strip(F.col("t")))
    assert wrong.count() == 0
    kind = spark.createDataFrame([(f"{a}{c}",) for c in chars for a in ("", "-")], "t string")
    assert kind.filter(sc.has_alphanumeric(F.col("t")) != F.col("t").rlike(r"[\p{L}\p{N}]")).count() == 0


def test_regions_are_chosen_without_a_join_of_words(spark, monkeypatch):
    """Ruled regions come with the words: the optimizer's plan of their lines joins only marks."""
    plans, whole = [], lines.lines

    def seen(words, boxed=True, marks=None):
        found = whole(words, boxed, marks)
        plans.append((words._jdf.queryExecution().optimizedPlan().toString(), marks is not None))
        return found

    monkeypatch.setattr(lines, "lines", seen)
    found, ruled, vector = sources(spark)
    assert rows(tables.extract_bom(found, ruled, vector), "page_id", "source_kind", "source_ord", "item_no") == SERVED
    assert [("Join" in text, marked) for text, marked in plans] == [(False, True), (True, False)]


def test_marks_choose_images_of_one_hash_too(spark):
    keys = [(1, "p", "1"), (1, "p", None), (2, "p", "1"), (None, "p", "1")]
    frame = three_words(spark, keys)
    marks = spark.createDataFrame([keys[0], keys[1], (9, "q", "1")], "doc_id long, page_id string, region_id string")
    got = lines.lines(frame, False, marks)
    assert rows(got, "doc_id", "page_id", "region_id") == rows(marks.filter("doc_id = 1"))
    # All rows under one hash, marks in between.
    mixed = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([1, 2, 1, 3, 2, 3]), "page_id": ["p"] * 6, "region_id": ["1"] * 6, "_image": pa.array([7] * 6),
        "text": ["a", "b", None, None, "c", "d"], "left": [0, 0, None, None, 5, 0], "right": [1, 1, None, None, 6, 1],
        "centre": [1.0, 1.0, None, None, 1.0, 1.0], "_ord": pa.array([1, 1, None, None, 2, 1]),
    })
    assert lines._wanted(mixed).column("text").to_pylist() == ["a", "d"]


def three_words(spark, keys):
    data = [(*k, i, "a1", 10 * i, 5, 8, 8) for k in keys for i in range(3)]
    return spark.createDataFrame(data, "doc_id long, page_id string, region_id string, word_ord long, text string, left int, top int, width int, height int")


def test_large_groups_are_looked_for_by_their_first_key(spark, small_groups):
    frame = spark.createDataFrame([(1, "a")] * 4 + [(1, "b")] * 2 + [(2, "a")] * 3 + [(None, None)] * 5 + [(3, c) for c in "abcd"], "doc_id long, page_id string")
    assert rows(skew.hot_groups(frame, ["doc_id", "page_id"])) == [(1, "a"), (None, None)]
    assert skew.hot_groups(frame.filter("doc_id in (2, 3)"), ["doc_id", "page_id"]) is None
