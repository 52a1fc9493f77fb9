"""Linking, pricing, validation and documents on literal rows."""

import gzip

import pytest
from pyspark.sql import functions as F

from draftweave import build_workspace, reconcile
from draftweave.functions import scalars as sc
from draftweave.operators import inventory, views
from draftweave.operators import reconcile as linking
from draftweave.sinks import documents, exports
from draftweave.sources import workspaces
from draftweave.streaming.workspaces import current_components, current_workspaces, stream_workspaces
from tests.conftest import rows

BOM = ("doc_id long, bom_ord long, item_number string, part_number string, part_name string, "
       "quantity long, material_specification string, confidence_score double")
CALL = "doc_id long, call_ord long, bubble_number string, confidence_score double"


def bom(spark, items, doc=1):
    return spark.createDataFrame([(doc, i, *r) for i, r in enumerate(items)], BOM)


def calls(spark, bubbles, doc=1):
    return spark.createDataFrame([(doc, i, *b) for i, b in enumerate(bubbles)], CALL)


def item(number, part=None, quantity=1, score=0.9, name="Part", material="Steel"):
    return (number, part, name, quantity, material, score)


@pytest.mark.parametrize("text,kind,expected", [
    ("3", "string", "3"), ("03", "string", "3"), ("Item 3", "string", "3"), ("BUBBLE 3", "string", "3"),
    ("Bubble-3", "string", "3"), ("3", "int", "3"), ("3.0", "float", "3"), ("-3", "int", "-3"), ("-3", "string", "3"),
    ("3-4", "string", None), ("N/A", "string", None), ("", "string", None), (None, "null", None),
    ("true", "bool", None), ("3.5", "float", None), ("3.0", "string", None), ("000", "string", "0"), (" ٣ ", "string", "3"), ("๓", "string", "3"), ("Item ০৩", "string", "3"), ("𝟟", "string", "7"),
])
def test_normalize_identifier(spark, text, kind, expected):
    frame = spark.createDataFrame([(text, kind)], "t string, k string")
    assert frame.select(sc.normalize_identifier(F.col("t"), F.col("k"))).first()[0] == expected


def test_key_order_is_numeric_at_any_length(spark):
    keys = ["10", "9", "123456789012345678901234567890123456789012", "-5", "-12", "0"]
    frame = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(*sc.key_order(F.col("k")))
    assert [r[0] for r in frame.collect()] == ["-12", "-5", "0", "9", "10", keys[2]]


def test_repeated_callout_of_one_item(spark):
    out = reconcile(bom(spark, [item("7")]), calls(spark, [("7", 0.9), ("7", 0.8)]))
    assert rows(out, "link_status", "duplicate_bubble_number") == [("matched", False)] * 2


def test_both_sides_repeated(spark):
    out = reconcile(bom(spark, [item("8"), item("8")]), calls(spark, [("8", 0.9)] * 3))
    assert [r[0] for r in out.orderBy("seq").select("link_status").collect()] == ["matched", "matched", "callout_only"]
    assert rows(out, "duplicate_item_number", "duplicate_bubble_number") == [(True, True)] * 3


def test_ambiguous_item(spark):
    out = reconcile(bom(spark, [item("Item 3-4")]), calls(spark, [("3", 0.9)]))
    assert rows(out, "seq", "link_status") == [(1, "callout_only"), (2, "ambiguous")]


SAMPLE_BOM = [
    item("1", "FB-M8-001", 6, 0.97), item("2", "WSH-M8-002", 12, 0.94), item("03", "BRK-STD-100", 2, 0.96),
    item("4", "BRG-6202-Z", 4, 0.55), item("5", "CUST-PLATE-099", 3, 0.89, material=None), item("6", "GSK-RUB-045", 8, 0.92),
    item("6", "GSK-RUB-045-ALT", 8, 0.90), item("7", "SHF-ST-303", 1, 0.93), item("9", "SCR-M4-010", 10, 0.91),
    item("10", "PIN-DWL-020", None, 0.88), item("Item 3-4", "AMB-000", 1, None, material=None),
]
SAMPLE_CALLS = [("1", 0.95), ("Bubble-2", 0.93), ("3", 0.96), ("4", 0.90), ("5", 0.91), ("6", 0.92), ("7", 0.94), ("7", 0.85), ("10", 0.90), ("14", 0.80)]


def check_sample(spark):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    s = ws.validation_summary.first().asDict()
    assert (s["total_bom_items"], s["total_callouts"], s["linked_items"]) == (12, 10, 9)
    assert (s["missing_callouts"], s["missing_bom_items"], s["ambiguous_identifiers"]) == (2, 1, 1)
    assert (s["duplicate_bom_items"], s["duplicate_callouts"], s["review_required_items"], s["invalid_items"]) == (2, 0, 4, 1)
    p = ws.procurement_summary.first()
    assert (p["estimated_total_cost_usd"], p["items_with_price"], p["items_without_price"]) == (5102.0, 7, 6)
    ordered = ws.components.orderBy("seq").select("component_id", F.coalesce("item_number", "bubble_number")).collect()
    assert [r[1] for r in ordered] == ["1", "2", "3", "4", "5", "6", "7", "7", "10", "6", "9", "14", None]
    assert ordered[0][0] == "cmp_001" and ordered[-1][0] == "cmp_013"
    return ws


def test_sample_workspace(spark):
    check_sample(spark)


def test_sample_workspace_with_every_group_split(spark, small_groups):
    assert check_sample(spark).hot is not None


def test_split_and_plain_paths_agree(spark):
    items = [item(str(i % 5 if i % 11 else "x"), f"P{i % 3}", i % 7, 0.5 + (i % 50) / 100) for i in range(24)]
    bubbles = [(str(i % 7 if i % 13 else "a-b"), 0.5 + (i % 40) / 100) for i in range(36)]
    b = bom(spark, items, 1).unionByName(bom(spark, items[:2], 2))
    c = calls(spark, bubbles, 1).unionByName(calls(spark, bubbles[:3], 2))

    def everything():
        ws = build_workspace(b.repartition(3), c.repartition(5))
        docs = ws.documents.select("doc_id", "part", "components", "validation", "procurement_summary", F.col("metadata").dropFields("generated_at"))
        return rows(ws.components), rows(docs)

    plain = everything()
    spark.conf.set("spark.draftweave.hotRows", "4")
    try:
        assert everything() == plain
    finally:
        spark.conf.unset("spark.draftweave.hotRows")


def test_large_documents_come_in_whole_parts(spark):
    ws = build_workspace(bom(spark, [item(str(i)) for i in range(25)]), calls(spark, [(str(i), 0.9) for i in range(25)]))
    parts = documents.workspace_documents(ws.components, part_rows=10).orderBy("part").collect()
    assert [len(p["components"]) for p in parts] == [10, 10, 5]
    assert {p["validation"]["summary"]["linked_items"] for p in parts} == {25}
    assert [c["id"] for p in parts for c in p["components"]] == [f"cmp_{i:03d}" for i in range(1, 26)]


def test_price_notes(spark):
    b = bom(spark, [item("1", "FB-M8-001", 6), item("2", "FB-M8-001", -3), item("3", None), item("4", "NOPE")])
    ws = build_workspace(b, calls(spark, []))
    got = [(r["estimated_unit_cost_usd"], r["estimated_total_cost_usd"]) for (r,) in ws.components.orderBy("seq").select("procurement_data").collect()]
    assert got == [(35.0, 210.0), (35.0, None), (None, None), (None, None)]


def test_stored_documents_read_back(spark, tmp_path):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    documents.write_workspace(ws.documents, str(tmp_path / "ws"))
    read = workspaces.read_workspace(spark, str(tmp_path / "ws"))
    assert workspaces.component_rows(read).count() == 13
    assert workspaces.summary_rows(read).first()["linked_items"] == 9
    assert workspaces.record_rows(read).filter("status = 'invalid'").count() == 1


def test_stored_documents_are_compressed(spark, tmp_path):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    sizes = {}
    for kind in ("gzip", "none"):
        folder = tmp_path / kind
        documents.write_workspace(ws.documents, str(folder), **({} if kind == "gzip" else {"compression": kind}))
        assert workspaces.component_rows(workspaces.read_workspace(spark, str(folder))).count() == 13
        sizes[kind] = sum(f.stat().st_size for f in folder.iterdir() if f.name.startswith("part-"))
    assert 4 * sizes["gzip"] < sizes["none"]


def test_documents_with_a_part_lost_are_refused(spark, tmp_path):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    whole = documents.workspace_documents(ws.components, part_rows=4)
    failed = documents.failed_workspaces(spark.createDataFrame([(9, "extraction", "no pages")], "doc_id long, stage string, message string"))
    lost = whole.filter("part <> 1").unionByName(failed)
    twice = whole.filter("part = 0").withColumn("doc_id", F.lit(7).cast("long"))
    for name, rows_ in {"whole": whole, "lost": lost, "twice": whole.unionByName(twice).unionByName(twice)}.items():
        documents.write_workspace(rows_.withColumn("doc_id", F.col("doc_id").cast("string")), str(tmp_path / name))
    read = {n: workspaces.read_workspace(spark, str(tmp_path / n)) for n in ("whole", "lost", "twice")}
    assert workspaces.incomplete_documents(read["whole"]).count() == 0
    assert workspaces.whole_documents(read["whole"]).count() == 4
    assert rows(workspaces.incomplete_documents(read["lost"])) == [("1", 13, 9)]
    assert rows(workspaces.whole_documents(read["lost"]), "doc_id") == [("9",)]
    assert rows(workspaces.incomplete_documents(read["twice"])) == [("7", 13, 8)]


def test_exports(spark, tmp_path):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    exports.export_bundle(ws.components, str(tmp_path))
    sheet = spark.read.option("header", True).csv(str(tmp_path / "bom"))
    assert sheet.count() == 13 and "Estimated Total (₹)" in sheet.columns
    assert rows(sheet.filter("`Item Number` = '1'"), "Quantity") == [("6",)]
    issues = exports.issues_export(ws.components)
    assert issues.filter("Message = 'No issues.'").count() == 5


def test_bundle_is_whole_or_refused(spark, tmp_path):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    odd = ws.components.withColumn("description", F.concat(F.lit('a "quoted", line\nand \\" more '), F.coalesce("description", F.lit(""))))
    for fmt in ("csv", "parquet"):
        folder = str(tmp_path / fmt)
        with pytest.raises(exports.IncompleteBundle, match="no manifest"):
            exports.read_bundle(spark, folder)
        exports.export_bundle(odd, folder, fmt)
        sheets = exports.read_bundle(spark, folder)
        assert {n: s.count() for n, s in sheets.items()} == {n: f(odd).count() for n, f in exports.SHEETS.items()}
        assert rows(sheets["bom"], "Description") == rows(odd, "description")
        part = next(p for p in sorted((tmp_path / fmt / "bom").iterdir()) if p.name.startswith("part-"))
        part.unlink()
        with pytest.raises(exports.IncompleteBundle, match="bom"):
            exports.read_bundle(spark, folder)


def test_a_bundle_is_held_against_its_manifest_without_parsing(spark, tmp_path, monkeypatch):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    monkeypatch.setattr(exports, "FILE_ROWS", 3)
    exports.export_bundle(ws.components, str(tmp_path))
    parts = [p for p in (tmp_path / "bom").iterdir() if p.name.startswith("part-")]
    assert len(parts) >= 5 and all(p.name.endswith(".csv.gz") for p in parts)
    assert exports.read_bundle(spark, str(tmp_path))["bom"].count() == 13
    text = gzip.decompress(parts[0].read_bytes())
    parts[0].write_bytes(gzip.compress(text.replace(b"P", b"Q") + b"x"))
    (tmp_path / "bom" / f".{parts[0].name}.crc").unlink()
    with pytest.raises(exports.IncompleteBundle, match="bom"):
        exports.read_bundle(spark, str(tmp_path))


def test_an_export_that_stops_leaves_nothing_readable(spark, tmp_path, monkeypatch):
    ws = build_workspace(bom(spark, SAMPLE_BOM), calls(spark, SAMPLE_CALLS))
    exports.export_bundle(ws.components, str(tmp_path))

    def killed(rows):
        raise RuntimeError("executor lost")

    monkeypatch.setitem(exports.SHEETS, "procurement_estimate", killed)
    with pytest.raises(RuntimeError):
        exports.export_bundle(ws.components, str(tmp_path))
    with pytest.raises(exports.IncompleteBundle, match="did not finish"):
        exports.read_bundle(spark, str(tmp_path))
    monkeypatch.undo()
    exports.export_bundle(ws.components.limit(0), str(tmp_path))
    assert [s.count() for s in exports.read_bundle(spark, str(tmp_path)).values()] == [0, 0, 0]


def test_good_empty_and_failed_documents_share_a_schema(spark, tmp_path):
    ws = build_workspace(bom(spark, [item("1"), item("1"), item("Item 3-4")]), calls(spark, [("1", 0.9), ("A/B", 0.5)]))
    runs = spark.createDataFrame([(1, "a.pdf", 2), (5, "b.pdf", 1)], "doc_id long, original_filename string, pages_processed long")
    failed = spark.createDataFrame([(9, "processing", "no pages")], "doc_id long, stage string, message string")
    both = ws.documents_of(runs).unionByName(documents.failed_workspaces(failed))
    documents.write_workspace(both.withColumn("doc_id", F.col("doc_id").cast("string")), str(tmp_path / "w"))
    got = {r["doc_id"]: r for r in workspaces.read_workspace(spark, str(tmp_path / "w")).collect()}
    assert [got[d]["metadata"]["pipeline_status"] for d in ("1", "5", "9")] == ["ok", "partial", "failed"]
    assert [len(got[d]["components"]) for d in ("1", "5", "9")] == [4, 0, 0]
    assert got["5"]["metadata"]["pipeline_errors"][0]["message"] == "No BOM items or callouts were extracted"
    assert (got["1"]["metadata"]["original_filename"], got["1"]["metadata"]["pages_processed"]) == ("a.pdf", 2)
    assert got["1"]["metadata"]["ambiguous_bom_identifiers"] == ["Item 3-4"] and got["1"]["metadata"]["ambiguous_callout_identifiers"] == ["A/B"]
    assert got["1"]["procurement_summary"]["mock_data"] and got["9"]["procurement_summary"]["currency"] == "USD"
    assert got["1"]["metadata"]["generated_at"] is not None


def test_points_meet_boxes_of_their_page(spark):
    box = lambda *xs: tuple(map(float, xs))
    given = [(1, "p1", "a", "1", box(0, 0, 450, 120)), (1, "p2", "b", "2", box(0, 0, 450, 120)), (1, None, "c", "3", box(-50, 0, 1200, 1000)), (1, "p1", "d", "4", None)]
    parts = spark.createDataFrame(given, "doc_id long, page_id string, component_id string, item_number string, bounding_box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    clicks = spark.createDataFrame([(1, "p1", 0, 450.0, 120.0), (1, "p2", 1, 10.0, 130.0), (1, None, 2, 1100.0, 5.0), (2, "p1", 3, 1.0, 1.0)], "doc_id long, page_id string, click int, x double, y double")
    assert rows(views.parts_at(parts, clicks), "click", "component_id") == [(0, "a"), (2, "c")]
    assert rows(views.parts_at(parts, clicks.drop("page_id")), "click", "component_id") == [(0, "a"), (0, "b"), (0, "c"), (1, "c"), (2, "c")]


def test_points_are_never_broadcast(spark):
    parts = spark.range(40).selectExpr(
        "id as doc_id", "'p1' as page_id", "concat('c', id) as component_id", "'1' as item_number",
        "named_struct('xmin', 0D, 'ymin', 0D, 'xmax', 60D, 'ymax', 60D) as bounding_box")
    clicks = spark.range(40).selectExpr("id as doc_id", "'p1' as page_id", "id as click", "60D as x", "id * 2D as y")
    found = views.parts_at(parts, clicks)
    # One look up a click and class of its document, by shuffles of both sides.
    assert rows(found, "click") == [(i,) for i in sorted(range(31), key=str)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_broken_records_and_late_pages_of_a_stream(spark, tmp_path):
    arriving, out = tmp_path / "in", str(tmp_path / "out")
    arriving.mkdir()
    page = '{"doc_id":"d","page_id":"%s","bom_items":[%s],"callouts":[%s]}'
    item_, bubble = '{"item_number":"3"}', '{"bubble_number":3,"bubble_bbox":{"xmin":1,"ymin":2,"xmax":3,"ymax":4}}'
    steps = [page % ("page_001", item_, "") + "\n{broken", page % ("page_002", "", bubble), page % ("page_002", "", "")]
    seen = []
    for n, text in enumerate(steps):
        (arriving / f"{n}.json").write_text(text)
        stream_workspaces(spark, str(arriving), out, str(tmp_path / "at"), available_now=True).awaitTermination()
        seen.append(rows(current_components(spark, out), "doc_id", "link_status"))
    assert seen == [[("d", "bom_only")], [("d", "matched")], [("d", "bom_only")]]
    now = {r["doc_id"]: r["metadata"] for r in current_workspaces(spark, out).collect()}
    assert now["d"]["pages_processed"] == 2 and len(now) == 2
    broken = next(m for d, m in now.items() if d != "d")
    assert broken["pipeline_status"] == "failed" and broken["pipeline_errors"][0]["message"] == "Malformed extraction record"


def test_pages_without_a_size_are_reported(spark):
    seen = spark.createDataFrame([(1, "page_002"), (1, "front"), (1, "page_001")], "doc_id long, page_id string")
    pages = spark.createDataFrame([(1, "page_001", 10, 10), (1, "page_002", None, 10)], "doc_id long, page_id string, width int, height int")
    found = inventory.page_errors(inventory.unsized_pages(pages, seen, seen))
    assert rows(found, "code", "message") == [("PAGE_SIZE_MISSING", "front: page size is missing"), ("PAGE_SIZE_MISSING", "page_002: page size is missing")]


def test_both_sides_are_linked_after_one_exchange(spark):
    bom = spark.createDataFrame(
        [(1, 1, "1"), (1, 2, "2"), (1, 3, "2"), (1, 4, "2"), (1, 5, "x"), (2, 1, "7"), (2, 2, "7"), (None, 1, "1"), (3, 1, "4")],
        "doc_id long, bom_ord long, item_number string")
    calls = spark.createDataFrame(
        [(1, 1, "1"), (1, 2, "1"), (1, 3, "2"), (1, 4, "2"), (1, 5, "y"), (2, 1, "7"), (2, 2, "7"), (2, 3, "7"), (None, 1, "1"), (4, 1, "4")],
        "doc_id long, call_ord long, bubble_number string")
    linked = linking.links(bom, calls)
    assert rows(linked, "doc_id", "key", "bom_ord", "call_ord", "bom_n", "call_n", "bom_rn", "call_rn", "section") == sorted([
        (1, "1", 1, 1, 1, 2, 1, 1, 0), (1, "1", 1, 2, 1, 2, 1, 2, 0),
        (1, "2", 2, 3, 3, 2, 1, 1, 0), (1, "2", 3, 4, 3, 2, 2, 2, 0), (1, "2", 4, None, 3, 2, 3, None, 1),
        (1, None, 5, None, 0, 0, None, None, 3), (1, None, None, 5, 0, 0, None, None, 4),
        (2, "7", 1, 1, 2, 3, 1, 1, 0), (2, "7", 2, 2, 2, 3, 2, 2, 0), (2, "7", None, 3, 2, 3, None, 3, 2),
        (None, "1", 1, None, 1, 1, 1, None, 1), (None, "1", None, 1, 1, 1, None, 1, 2),
        (3, "4", 1, None, 1, 0, 1, None, 1), (4, "4", None, 1, 0, 1, None, 1, 2),
    ], key=lambda r: tuple((x is None, str(x)) for x in r))
    plan = linking.reconcile(bom, calls, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
