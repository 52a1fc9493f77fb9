import json

import pytest

from draftweave.sources import measures

from tests.conftest import rows

WORDS = "doc_id long, page_id string, region_id string, word_ord long, text string, left double, top string, width int, height long, note string"


def test_words_with_faults_are_kept_apart(spark, tmp_path):
    given = [
        (1, "p", "page", 1, "BOLT", 10.0, "20", 5, 6, "a"), (1, "p", "page", 2, None, 10.0, "20.0", 0, 6, "b"),
        (1, "p", "page", 3, "X", 10.5, "20", 5, 6, "c"), (1, None, "page", None, "X", float("nan"), "y", -5, 3_000_000_000, "d"),
        (1, "p", "page", 1, "BOLT", 10.0, "20", 5, 6, "a"),
    ]
    spark.createDataFrame(given, WORDS).write.parquet(str(tmp_path / "words"))
    good, bad = measures.read_measures(spark, str(tmp_path / "words"), "words")
    assert good.schema["left"].dataType.simpleString() == "int" and "note" not in good.columns
    assert rows(good, "word_ord", "text", "left", "top", "width") == [(1, "BOLT", 10, 20, 5), (1, "BOLT", 10, 20, 5), (2, None, 10, 20, 0)]
    told = {json.loads(r.record)["note"]: r for r in bad.collect()}
    assert told["c"].reasons == ["left is not a whole number"] and told["c"].left is None and told["c"].top == 20
    assert told["d"].reasons == [
        "page_id is missing", "word_ord is missing", "left is not a number", "top is not a number",
        "width is below 0", "height is too large"]


def test_cell_tables_and_empty_tables(spark):
    schema = "doc_id long, page_id string, table_ord int, cells array<array<string>>"
    given = [(1, "p", 1, [["Item", None]]), (1, "p", 2, []), (1, "p", 3, None), (1, "p", 4, [["Item"], None])]
    frame = spark.createDataFrame(given, schema)
    assert rows(measures.accepted(frame, "cell_tables"), "table_ord") == [(1,)]
    assert [r.reasons for r in measures.rejected(frame, "cell_tables").orderBy("table_ord").collect()] == [
        ["cells has no rows"], ["cells is missing"], ["cells has a missing row"]]
    assert measures.checked(frame.limit(0), "cell_tables").count() == 0


def test_misfitting_tables_are_refused(spark):
    with pytest.raises(ValueError, match="segments lack the columns w, h"):
        measures.accepted(spark.createDataFrame([], "doc_id long, page_id string, seg_ord long, x int, y int"), "segments")
    with pytest.raises(ValueError, match="column x is stored as array<int>"):
        measures.accepted(spark.createDataFrame([], "doc_id long, page_id string, seg_ord long, x array<int>, y int, w int, h int"), "segments")
    with pytest.raises(ValueError, match="column cells is stored as string"):
        measures.rejected(spark.createDataFrame([], "doc_id long, page_id string, table_ord long, cells string"), "cell_tables")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], WORDS).write.parquet(str(tmp_path / "words"))
    good, _ = measures.read_measures(spark, str(tmp_path / "words"), "words")
    plan = good.select("text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "note" not in plan


def test_faults_are_looked_for_once_in_each_reading(spark):
    frame = spark.sql("select 1L as doc_id, 'p' as page_id, 5L as seg_ord, '3.0' as x, 1 as y, 2 as w, 3 as h union all select 1L, 'p', 6L, 'no', 1, null, 3")
    good, bad = measures.accepted(frame, "segments"), measures.rejected(frame, "segments")
    assert rows(good) == [(1, "p", 5, 3, 1, 2, 3)]
    assert rows(bad.select("seg_ord", "reasons")) == [(6, ["x is not a number", "w is missing"])]
    projected = [line for line in good._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in line]
    assert not any("is missing" in line for line in projected)
