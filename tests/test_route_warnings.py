"""Warnings of the response route come from one reading of each response."""

from draftweave.plans.vision import extractions_from_responses
from tests.conftest import rows
from tests.test_hybrid import counted

SENT = [
    ("bom", "r0", "no json"), ("bom", "r1", '{"bom_items": "none"}'), ("bom", "r2", '{"other": 1}'), ("bom", "r3", '{"bom_items": []}'),
    ("bom", "r4", '{"bom_items": [{"item_number": "1", "confidence_score": 0.9}, "junk"]}'), ("callouts", "r0", '{"callouts": 5}'),
]


def test_each_response_is_read_once_a_step(spark):
    raw = spark.createDataFrame([(1, "page_001", *s) for s in SENT], "doc_id long, page_id string, stage string, tile string, response_text string")
    pages = spark.createDataFrame(
        [(1, "page_001", 100, 100, None)],
        "doc_id long, page_id string, width int, height int, drawing_region struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    raw, read = counted(raw.repartition(1))
    out = extractions_from_responses(raw, pages)
    assert rows(out.warnings, "step", "tile", "index", "i", "warning") == [
        (0, "r0", -1, 0, "BOM extraction failed: Malformed JSON in vision model response"),
        (0, "r1", -1, 0, "BOM response 'bom_items' was not a list; treated as empty"),
        (0, "r4", 1, 0, "Skipped invalid BOM row at index 1: BOM row is not an object"),
        (1, "r0", -1, 0, "Callout response 'callouts' was not a list; treated as empty"),
    ]
    assert read.value == 2 * len(SENT)
    assert rows(out.bom, "tile", "item_number") == [("r4", "1")]
