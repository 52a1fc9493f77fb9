"""The measured-page route reads its inputs no more often than it must."""

from pyspark.sql import functions as F

from checks.inputs import Inputs
from checks.page_checks import sheets, words
from draftweave.plans.hybrid import run_hybrid
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def counted(frame):
    """The frame, and an accumulator of the rows read of it."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return frame.mapInArrow(tell, frame.schema), seen


def route(t, contours, crops, read):
    return run_hybrid(read, t.segments, t.cell_tables, contours, crops, sheets(t), t.digits)


def test_workspace_reads_verdicts_and_contours_once(spark):
    t = Inputs(spark, FOLDER)
    crops, parsed = counted(t.crop_responses.repartition(1))
    plain = route(t, t.contours, t.crop_responses, words(t)).workspace().components
    found = route(t, t.contours, crops, words(t)).workspace().components
    names = ["doc_id", "seq", "link_status", "item_number", "bubble_number", "quantity"]
    assert rows(found, *names) == rows(plain, *names)
    assert parsed.value == t.crop_responses.count()


def test_counts_and_difference_place_no_callouts(spark):
    t = Inputs(spark, FOLDER)
    crops, parsed = counted(t.crop_responses.repartition(1))
    contours, read = counted(t.contours.repartition(1))
    h = route(t, contours, crops, words(t))
    # The count of hot pages is one pass; no candidate is selected yet.
    assert (read.value, parsed.value) == (t.contours.count(), 0)
    assert h.stage_counts.agg(F.sum("classified_as_balloons")).first()[0] > 0
    assert parsed.value == t.crop_responses.count()
