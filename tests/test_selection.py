import random
import statistics

import pytest
from pyspark.sql import functions as F

from draftweave.operators import selection, views
from tests.conftest import rows


@pytest.mark.parametrize("ranges", [4, 4096])
def test_medians_by_counted_ranges(spark, small_groups, monkeypatch, ranges):
    monkeypatch.setattr(selection, "RANGES", ranges)
    dice = random.Random(1)
    groups = {
        "even": [dice.uniform(1, 500) for _ in range(60)], "odd": [dice.uniform(1, 500) for _ in range(61)],
        "ties": [12.5] * 30, "two": [1.0] * 10 + [500.0] * 10, "lean": [1.0] * 11 + [500.0] * 9,
        "close": [1 + i * 2.0**-40 for i in range(20)] + [499.0], "few": [3.0, 1.0], None: [7.0, 9.0, 8.0, 100.0, 2.0],
        "gaps": [None, 4.0, None, 6.0, 5.0, 4.5], "none": [None, None],
    }
    given = [(g, v) for g, values in groups.items() for v in values]
    dice.shuffle(given)
    found = selection.medians(spark.createDataFrame(given, "g string, v double").repartition(3), ["g"], "v")
    got = {r.g: (r.n, r["median"]) for r in found.collect()}
    real = {g: [v for v in values if v is not None] for g, values in groups.items()}
    assert got == {g: (len(groups[g]), statistics.median(v) if v else None) for g, v in real.items()}


def test_medians_of_nothing(spark):
    assert selection.medians(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_boxes_of_every_size_meet_their_points(spark):
    dice = random.Random(2)
    boxes = []
    for i in range(200):
        x, y = dice.uniform(-100, 1050), dice.uniform(-100, 1050)
        w, h = 2 ** dice.uniform(-3, 11), 2 ** dice.uniform(-3, 11)
        boxes.append((x, y, x + w, y + h))
    boxes += [(0.0, 0.0, 0.0, 0.0), (256.0, 256.0, 512.0, 512.0), (600.0, 1.0, 500.0, 9.0), (0.0, 0.0, 1000.0, 1000.0)]
    points = [(dice.uniform(-50, 1100), dice.uniform(-50, 1100)) for _ in range(60)] + [(0.0, 0.0), (512.0, 256.0), (1000.0, 1000.0)]
    schema = "doc_id long, page_id string, component_id string, item_number string, bounding_box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    parts = spark.createDataFrame([(1, "p", str(i), "1", b) for i, b in enumerate(boxes)] + [(1, "p", "none", "1", None)], schema)
    clicks = spark.createDataFrame([(1, "p", i, *xy) for i, xy in enumerate(points)], "doc_id long, page_id string, click long, x double, y double")
    want = sorted((i, str(j)) for i, (x, y) in enumerate(points) for j, b in enumerate(boxes) if b[0] <= x <= b[2] and b[1] <= y <= b[3])
    assert sorted(rows(views.parts_at(parts, clicks), "click", "component_id")) == want


def test_a_crowd_of_small_boxes_spreads_over_many_keys(spark, monkeypatch):
    """100,000 boxes inside one hundredth of a page: no join key holds more than a few of them."""
    n = 100_000
    low = lambda k: 300 + (F.col("id") * k) % 997 / 10.5
    box = F.struct(low(31).alias("xmin"), low(57).alias("ymin"), (low(31) + 0.5).alias("xmax"), (low(57) + 0.5).alias("ymax"))
    parts = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.lit("p").alias("page_id"), F.col("id").cast("string").alias("component_id"),
        F.lit("1").alias("item_number"), box.alias("bounding_box"))
    b = F.col("bounding_box")
    size = F.lit(0)
    keys = parts.groupBy(views._step(b["xmin"], size), views._step(b["ymin"], size)).count()
    assert keys.agg(F.max("count")).first()[0] < 500
    clicks = spark.createDataFrame([(1, "p", 350.0, 350.0)], "doc_id int, page_id string, x double, y double")
    inside = (b["xmin"] <= 350) & (b["xmax"] >= 350) & (b["ymin"] <= 350) & (b["ymax"] >= 350)
    assert views.parts_at(parts, clicks).count() == parts.filter(inside).count()
