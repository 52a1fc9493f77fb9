"""Checks of raw responses: what they cost for each row, and that cheaper readings of a value agree with plain ones."""

import json

import pytest
from pyspark.sql import functions as F

from draftweave.functions import scalars as sc
from draftweave.operators import dedupe, responses
from draftweave.sources import extractions

from tests.conftest import rows

#: The JVM compiles no method above this many bytes of bytecode.
HUGE_METHOD = 8_000

VALUES = [
    "1", "-1", "1.0", "1.50", "1e3", "100.0", "12345678901234567890", "12345678901234567890.0", "123456789012345678901234567890", "true", "null",
    '"x"', '" 3 "', '""', "{}", "[]", '{"a":1}', '[1,"a",{"b":[2]}]', '"null"', '"OBJECT<a>"',
]


def sent(spark, texts):
    return spark.createDataFrame([("d", "p", "s", str(i), t, 100, 100) for i, t in enumerate(texts)], "doc_id string, page_id string, stage string, tile string, response_text string, w int, h int")


def largest_method(frame):
    debug = frame.sparkSession._jvm.org.apache.spark.sql.execution.debug
    found = getattr(getattr(debug, "package$"), "MODULE$").codegenStringSeq(frame._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


@pytest.mark.parametrize("name, check", [
    ("bom_items", responses.validate_bom_items),
    ("callouts", lambda items: responses.validate_callouts(items, 0.9, "w", "h")),
])
def test_checks_are_code_that_the_jvm_compiles(spark, tmp_path, name, check):
    sent(spark, ["{}"]).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    checked = check(responses.list_items(responses.parse_json_response(stored), name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # such a plan has its code at once
    try:
        assert largest_method(checked) < HUGE_METHOD
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stored_callouts_are_read_by_code_that_the_jvm_compiles(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"doc_id": "d", "callouts": [{"bubble_number": 1}]}')
    stored = extractions.read_extractions(spark, str(tmp_path / "r.json"))
    assert largest_method(extractions.callout_rows(stored)) < HUGE_METHOD
    assert largest_method(extractions.bom_rows(stored)) < HUGE_METHOD


def test_fields_are_read_together_as_one_by_one(spark):
    objects = [f'{{"a":{v},"b":{w}}}' for v in VALUES for w in ("1", v)] + VALUES + ["{}", '{"b":2}', "{broken"]
    frame = spark.createDataFrame([(t,) for t in objects], "t string").withColumn("v", F.try_parse_json("t"))
    shape = {n: F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")) for n in "ab"}
    number = r"^DECIMAL\((19|[23][0-9]),0\)$"
    kind = {n: F.when(x.rlike(number), "int").otherwise(F.regexp_extract(F.lower(x), "^[a-z]+", 0)) for n, x in shape.items()}
    plain = frame.select("t", *[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in "ab"], *[
        F.coalesce(*[F.when(k == a, b) for a, b in (("void", "null"), ("boolean", "bool"), ("bigint", "int"), ("decimal", "float"), ("double", "float"))], k).alias(f"{n}_kind") for n, k in kind.items()])
    assert rows(sc.with_fields(frame, "v", ["a", "b"]).select(*plain.columns)) == rows(plain)
    assert sc.with_fields(frame, "v", ["a", "b"], texts=["b"]).columns == ["t", "v", "b", "a_kind", "b_kind"]
    objects_only = frame.filter(sc.is_object(F.col("v"))).select("t").collect()
    assert sorted(r.t for r in objects_only) == sorted(t for t in objects if t.startswith("{") and t != "{broken")


def test_strip_removes_what_a_pattern_for_whitespace_does(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a{c}b{c}{c}" for c in chars] + ["", " ", "a \n", "\n\n", "a ", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.filter(~sc.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_tiles_meet_their_responses_once(spark):
    pages = spark.createDataFrame([("d", "p", 1000, 800)], "doc_id string, page_id string, width int, height int")
    said = '{"callouts":[{"bubble_number":"1","confidence_score":0.9,"bubble_bbox":{"xmin":100,"ymin":100,"xmax":200,"ymax":200}}]}'
    raw = spark.createDataFrame([("d", "p", t, said) for t in ("tile[r0c0]", "tile[r1c1]")], "doc_id string, page_id string, tile string, response_text string")
    kept, warnings = responses.tiled_callouts(raw, dedupe.tiles(pages))
    boxes = [tuple(round(x, 6) for x in r.bubble_bbox) for r in kept.orderBy("call_ord").collect()]
    assert boxes == [(53.0, 53.0, 106.0, 106.0), (523.0, 523.0, 576.0, 576.0)]
    for frame in (kept, warnings):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_odd_responses(spark):
    texts = ["", "  \n", None, "sorry", "[1]", "7", "null", '"x"', "1.5", "true", "{}", "```json\n{}\n```", " ```\n{\"bom_items\": {}}\n``` ", '{"bom_items": null}', '{"bom_items": [1, null, {"item_number": "1"}]}']
    parsed = responses.parse_json_response(sent(spark, texts))
    got = "Expected a JSON object from vision model, got "
    errors = ["Empty response from vision model"] * 3 + ["Malformed JSON in vision model response"] + [got + x for x in ("list", "int", "NoneType", "str", "float", "bool")] + [None] * 5
    assert [r.parse_error for r in parsed.orderBy(F.col("tile").cast("int")).collect()] == errors
    items = responses.list_items(parsed, "bom_items", outer=True)
    assert [(r.tile, r._field_kind) for r in items.filter("_field_kind is not null and index is null").collect()] == [("12", "object"), ("13", "null")]
    said = responses.validate_bom_items(items.filter("index is not null")).orderBy("index").collect()
    assert [json.dumps(r.warnings) for r in said] == [
        '["Skipped invalid BOM row at index 0: BOM row is not an object"]', '["Skipped invalid BOM row at index 1: BOM row is not an object"]',
        '["Low confidence extraction for BOM item 1 (confidence=0.00)"]']
