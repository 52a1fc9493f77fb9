"""Selecting balloon candidates among contours, calibrated per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import selection, skew

PAGE = ["doc_id", "page_id"]

# Fixed values.
LOOSE_CIRCULARITY = 0.55
LOOSE_RADIUS = (1, 500)
DEFAULT_RADIUS = (10.0, 80.0)
DEFAULT_CIRCULARITY = 0.6
RADIUS_SAMPLE, CIRCULARITY_SAMPLE = 5, 6
CIRCULARITY_GAP = 0.08
BUCKET = CIRCULARITY_GAP / 2


def loose_candidates(contours: DataFrame) -> DataFrame:
    """Roughly round contours of plausible size (F-06, X-17)."""
    sized = contours.filter((F.col("area") > 0) & F.col("radius").between(*LOOSE_RADIUS))
    return sized.withColumn("circularity", geo.circularity(F.col("area"), F.col("radius"))).filter(
        F.col("circularity") >= LOOSE_CIRCULARITY
    )


def radius_range(n: Column, median: Column) -> Column:
    """Accepted radii from a page's count and median (A-10)."""
    low = F.greatest(F.lit(DEFAULT_RADIUS[0]), median * 0.4)
    high = F.least(F.lit(DEFAULT_RADIUS[1] * 3), median * 2.5)
    fixed = (n < RADIUS_SAMPLE) | (high <= low)
    return F.struct(
        F.when(fixed, DEFAULT_RADIUS[0]).otherwise(low).alias("low"),
        F.when(fixed, DEFAULT_RADIUS[1]).otherwise(high).alias("high"),
    )


def page_medians(rows: DataFrame, value: str, hot: DataFrame | None = None) -> DataFrame:
    """Count and exact median per page.

    The values of a hot page are counted by range over many tasks; the built-in
    median would hold all its distinct values in one.
    """
    plain = skew.cold_part(rows, hot, PAGE).groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n"), F.median(value).alias("median")
    )
    if hot is None:
        return plain
    return plain.unionByName(selection.medians(skew.hot_part(rows, hot, PAGE), PAGE, value))


def calibrate_radius(loose: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Radius range per page (A-10)."""
    stats = page_medians(loose, "radius", hot)
    return stats.select(*PAGE, radius_range(F.col("n"), F.col("median")).alias("radius_range")).select(
        *PAGE, "radius_range.low", "radius_range.high"
    )


def calibrate_circularity(sized: DataFrame) -> DataFrame:
    """Circularity cutoff per page from the widest gap between values (A-11).

    Only gaps of at least ``CIRCULARITY_GAP`` count, so values fall into
    buckets half as wide: such a gap lies between the largest value of one
    bucket and the smallest of the next. Bucket extremes combine on the map
    side, and a page has at most a few dozen buckets.
    """
    c = F.col("circularity")
    buckets = sized.groupBy(*PAGE, F.floor(c / BUCKET).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")
    )
    step = W.partitionBy(*PAGE).orderBy("bucket")
    nxt = F.lead("low").over(step)
    gaps = buckets.withColumns({"gap": nxt - F.col("high"), "middle": (F.col("high") + nxt) / 2.0})
    widest = gaps.groupBy(*PAGE).agg(
        F.sum("n").alias("n"),
        F.max_by(F.struct("gap", "middle"), F.struct(F.coalesce("gap", F.lit(-1.0)), -F.col("bucket"))).alias("g"),
    )
    usable = (F.col("n") >= CIRCULARITY_SAMPLE) & F.coalesce(F.col("g.gap") >= CIRCULARITY_GAP, F.lit(False))
    cutoff = F.when(usable, F.greatest(F.col("g.middle"), F.lit(DEFAULT_CIRCULARITY))).otherwise(DEFAULT_CIRCULARITY)
    return widest.select(*PAGE, cutoff.alias("cutoff"))


def crop_id(page: Column, n: Column) -> Column:
    """``<page>_c0001`` (W-09)."""
    return F.concat(page.cast("string"), F.lit("_c"), sc.zero_filled(n, 4))


def select_candidates(contours: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Candidates of every page, numbered in contour order (F-06..F-08, A-10, A-11, W-09, X-12).

    The radius gate comes before the circularity calibration, as the order
    changes the result. Page statistics are one row per page; rows of hot pages
    meet them by broadcast.
    """
    loose = loose_candidates(contours)
    hot = skew.hot_groups(contours, PAGE)
    ranges = calibrate_radius(loose, hot)
    sized = skew.lookup(loose, ranges, PAGE, hot, "inner").filter(
        F.col("radius").between(F.col("low"), F.col("high"))
    ).drop("low", "high")
    round_enough = skew.lookup(sized, calibrate_circularity(sized), PAGE, hot, "inner").filter(
        F.col("circularity") >= F.col("cutoff")
    ).drop("cutoff")
    numbered = skew.ranked(round_enough, PAGE, [F.col("contour_ord")], "n", hot)
    out = numbered.withColumn("crop_id", crop_id(F.col("page_id"), F.col("n"))).drop("n")
    if pages is None:
        return out
    sizes = pages.select(*PAGE, "width", "height")
    # Boxes of a page without a size are not cut at its edges.
    return skew.lookup(out, sizes, PAGE, hot, "left").withColumn(
        "bbox",
        geo.padded_bbox(F.col("cx"), F.col("cy"), F.col("radius"), F.col("width"), F.col("height")),
    ).drop("width", "height")


def attach_classification(candidates: DataFrame, results: DataFrame, pages: DataFrame) -> DataFrame:
    """Balloons as page-scale callouts (J-07, F-03, X-07, X-08).

    Results without a candidate are dropped. ``crop_id`` is unique within a
    document, so the join cannot be skewed; page geometry is one row per page.
    On a page without a size a balloon keeps its number and has no box.
    """
    on = ["doc_id", "crop_id"]
    hits = candidates.select(*PAGE, "crop_id", "contour_ord", "bbox").join(
        results.filter("is_balloon and number is not null").drop("page_id"), on
    )
    hot = skew.hot_groups(candidates, PAGE)
    placed = skew.lookup(hits, pages.select(*PAGE, "width", "height", "drawing_region"), PAGE, hot, "left")
    w, h = F.col("width"), F.col("height")
    box = geo.pixel_box_to_page(F.col("bbox"), geo.crop_origin(F.col("drawing_region"), w, h), w, h)
    return placed.select(
        *PAGE, "crop_id", F.col("contour_ord").alias("call_ord"),
        F.col("number").cast("string").alias("bubble_number"),
        F.lit("").alias("location_description"),
        box.alias("bounding_box"), F.col("confidence").alias("confidence_score"),
    )


def stage_counts(bom: DataFrame, candidates: DataFrame, classified: DataFrame) -> DataFrame:
    """Rows extracted, candidates found and balloons confirmed per document (A-13)."""
    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))

    return (
        counted(bom, "bom_rows_extracted")
        .join(counted(candidates, "callout_candidates_detected"), "doc_id", "full_outer")
        .join(counted(classified.filter("is_balloon"), "classified_as_balloons"), "doc_id", "full_outer")
        .na.fill(0)
    )
