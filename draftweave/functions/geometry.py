"""Column expressions on boxes.

Boxes are structs ``(xmin, ymin, xmax, ymax)`` of doubles on the 0-1000 page
scale unless a name says pixels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1000.0
EDGES = ("xmin", "ymin", "xmax", "ymax")

# Default drawing and title-block regions of a sheet (0-1000).
DRAWING_REGION = (0, 0, 1000, 850)
TITLE_BLOCK_REGION = (650, 720, 1000, 1000)


def box(xmin, ymin, xmax, ymax) -> Column:
    cols = [c if isinstance(c, Column) else F.lit(c) for c in (xmin, ymin, xmax, ymax)]
    return F.struct(*[c.alias(name) for c, name in zip(cols, EDGES)])


def edges(b: Column) -> tuple[Column, ...]:
    return tuple(b[name] for name in EDGES)


def clamp(x: Column, low: float = 0.0, high: float | Column = SCALE) -> Column:
    high = high if isinstance(high, Column) else F.lit(high)
    # greatest and least skip nulls, so a missing value is kept out of them.
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(high, x)))


def normalize_coordinate(pixel: Column, size: Column) -> Column:
    return clamp(pixel / size * SCALE)


def pixel_to_norm(b: Column, width: Column, height: Column, check: bool = True) -> Column:
    """Pixels to the page scale, clamped; a bad size or order raises (X-01)."""
    x0, y0, x1, y1 = edges(b)
    out = box(
        normalize_coordinate(x0, width), normalize_coordinate(y0, height),
        normalize_coordinate(x1, width), normalize_coordinate(y1, height),
    )
    if not check:
        return out
    return (
        F.when((width <= 0) | (height <= 0), F.raise_error(F.lit("image size must be positive")))
        .when((x1 < x0) | (y1 < y0), F.raise_error(F.lit("invalid box order")))
        .otherwise(out)
    )


def norm_to_pixel(b: Column, width: Column, height: Column) -> Column:
    """Page scale to whole pixels, half to even, clamped (X-02)."""
    x0, y0, x1, y1 = edges(b)

    def one(v: Column, size: Column) -> Column:
        return F.rint(clamp(v / SCALE * size, 0.0, size.cast("double"))).cast("int")

    return box(one(x0, width), one(y0, height), one(x1, width), one(y1, height))


def is_already_normalized(b: Column) -> Column:
    x0, y0, x1, y1 = edges(b)
    return (
        x0.between(0.0, SCALE) & y0.between(0.0, SCALE)
        & x1.between(0.0, SCALE) & y1.between(0.0, SCALE)
    )


def in_range(b: Column) -> Column:
    """All edges on the scale and strictly ordered (X-11)."""
    return is_already_normalized(b) & (b["xmin"] < b["xmax"]) & (b["ymin"] < b["ymax"])


def scaled_bbox(b: Column, width: Column, height: Column) -> Column:
    """Pixels converted only when off the scale."""
    sized = (width > 0) & (height > 0)
    return F.when(
        ~is_already_normalized(b) & F.coalesce(sized, F.lit(False)),
        pixel_to_norm(b, width, height, check=False),
    ).otherwise(b)


def resolve_bbox(b: Column, width: Column, height: Column) -> Column:
    """Pixels converted only when off the scale; null when still bad (X-04)."""
    moved = scaled_bbox(b, width, height)
    return F.when(in_range(moved), moved)


def remap_coordinate(v: Column, origin: Column, size: Column, page: Column) -> Column:
    """One axis from crop scale to page scale, clamped."""
    return clamp((origin + v / SCALE * size) / page * SCALE)


def remap_from_crop(b: Column, crop: Column, page_width: Column, page_height: Column) -> Column:
    """Box from crop scale to page scale (X-05); ``crop`` is ``(x, y, width, height)`` pixels."""
    x0, y0, x1, y1 = edges(b)
    return box(
        remap_coordinate(x0, crop["x"], crop["width"], page_width),
        remap_coordinate(y0, crop["y"], crop["height"], page_height),
        remap_coordinate(x1, crop["x"], crop["width"], page_width),
        remap_coordinate(y1, crop["y"], crop["height"], page_height),
    )


def remap_point_from_crop(p: Column, crop: Column, page_width: Column, page_height: Column) -> Column:
    return F.when(
        p.isNotNull(),
        F.struct(
            remap_coordinate(p["x"], crop["x"], crop["width"], page_width).alias("x"),
            remap_coordinate(p["y"], crop["y"], crop["height"], page_height).alias("y"),
        ),
    )


def remap_from_region(b: Column, region: Column) -> Column:
    """Older unclamped remap that needs only the region on the page scale."""
    x0, y0, x1, y1 = edges(b)
    w = region["xmax"] - region["xmin"]
    h = region["ymax"] - region["ymin"]
    return box(
        region["xmin"] + x0 / SCALE * w, region["ymin"] + y0 / SCALE * h,
        region["xmin"] + x1 / SCALE * w, region["ymin"] + y1 / SCALE * h,
    )


def crop_pixels(region: Column, width: Column, height: Column) -> Column:
    """Pixel origin and size of a page-scale region (X-06)."""
    return F.struct(
        (region["xmin"] / SCALE * width).alias("x"),
        (region["ymin"] / SCALE * height).alias("y"),
        ((region["xmax"] - region["xmin"]) / SCALE * width).alias("width"),
        ((region["ymax"] - region["ymin"]) / SCALE * height).alias("height"),
    )


def crop_origin(region: Column, width: Column, height: Column) -> Column:
    """Origin of the image callouts were found on: (0,0) without a region (X-07)."""
    return F.struct(
        F.coalesce(region["xmin"] / SCALE * width, F.lit(0.0)).alias("x"),
        F.coalesce(region["ymin"] / SCALE * height, F.lit(0.0)).alias("y"),
    )


def pixel_box_to_page(b: Column, origin: Column, width: Column, height: Column) -> Column:
    """Crop-pixel box to page scale, clamped per axis (X-08)."""
    x0, y0, x1, y1 = edges(b)
    return box(
        clamp((origin["x"] + x0) / width * SCALE), clamp((origin["y"] + y0) / height * SCALE),
        clamp((origin["x"] + x1) / width * SCALE), clamp((origin["y"] + y1) / height * SCALE),
    )


def fit_dimensions(width: Column, height: Column, longest: int = 7000, shortest: int = 2000) -> Column:
    """Aspect-preserving target size and whether it differs (X-09)."""
    side = F.greatest(width, height)
    target = F.when(side > longest, longest).when(side < shortest, shortest)
    wide = width >= height
    scaled_h = F.greatest(F.lit(1), F.rint(height * (target / width.cast("double"))).cast("int"))
    scaled_w = F.greatest(F.lit(1), F.rint(width * (target / height.cast("double"))).cast("int"))
    return F.struct(
        F.when(target.isNull(), width).when(wide, target).otherwise(scaled_w).cast("int").alias("width"),
        F.when(target.isNull(), height).when(wide, scaled_h).otherwise(target).cast("int").alias("height"),
        target.isNotNull().alias("resized"),
    )


def cap_dimensions(width: Column, height: Column, limit: int = 4096) -> Column:
    """Downscale only, by the longest side."""
    side = F.greatest(width, height)
    scale = F.lit(float(limit)) / side
    shrink = side > limit

    def one(v: Column) -> Column:
        return F.when(shrink, F.greatest(F.lit(1), F.rint(v * scale).cast("int"))).otherwise(v).cast("int")

    return F.struct(one(width).alias("width"), one(height).alias("height"))


def percent_to_norm(pct: Column) -> Column:
    """A 0-1 or 0-100 share to the 0-1000 scale; out of range raises."""
    share = F.when(pct > 1.0, pct / 100.0).otherwise(pct)
    return F.when(
        (share > 0.0) & (share <= 1.0), F.rint(share * SCALE).cast("int")
    ).otherwise(F.raise_error(F.concat(F.lit("bad percentage: "), pct.cast("string"))).cast("int"))


def resolve_regions(
    mode: str = "manual",
    drawing: Column | None = None,
    title_block: Column | None = None,
    drawing_ymax_pct: Column | None = None,
    title_width_pct: Column | None = None,
    title_height_pct: Column | None = None,
) -> Column:
    """Drawing and title-block regions from defaults, shares or boxes (X-10)."""
    base_d, base_t = box(*DRAWING_REGION), box(*TITLE_BLOCK_REGION)
    if mode.strip().lower() == "heuristic":
        return F.struct(base_d.alias("drawing"), base_t.alias("title_block"))
    null = F.lit(None).cast("double")
    ymax_pct = null if drawing_ymax_pct is None else drawing_ymax_pct
    w_pct = null if title_width_pct is None else title_width_pct
    h_pct = null if title_height_pct is None else title_height_pct
    ymax = F.when(ymax_pct.isNotNull(), percent_to_norm(ymax_pct)).otherwise(DRAWING_REGION[3])
    shared = w_pct.isNotNull() | h_pct.isNotNull()
    left = F.when(shared, 1000 - percent_to_norm(F.coalesce(w_pct, F.lit(0.35)))).otherwise(TITLE_BLOCK_REGION[0])
    top = F.when(shared, 1000 - percent_to_norm(F.coalesce(h_pct, F.lit(0.28)))).otherwise(TITLE_BLOCK_REGION[1])

    def whole(b: Column) -> Column:
        return box(*[F.rint(e.cast("double")).cast("int") for e in edges(b)])

    d = box(DRAWING_REGION[0], DRAWING_REGION[1], DRAWING_REGION[2], ymax)
    t = box(left, top, 1000, 1000)
    if drawing is not None:
        d = F.when(drawing.isNotNull(), whole(drawing)).otherwise(d)
    if title_block is not None:
        t = F.when(title_block.isNotNull(), whole(title_block)).otherwise(t)
    return F.struct(checked_region(d).alias("drawing"), checked_region(t).alias("title_block"))


def checked_region(b: Column) -> Column:
    return F.when(in_range(b), b).otherwise(F.raise_error(F.concat(F.lit("invalid region "), F.to_json(b))))


def padded_bbox(cx: Column, cy: Column, radius: Column, width: Column, height: Column, pad: int = 10) -> Column:
    """Whole-pixel box around a circle, clamped to the page (X-12)."""
    r = radius + pad
    return box(
        F.greatest(F.lit(0), F.floor(cx - r)).cast("int"),
        F.greatest(F.lit(0), F.floor(cy - r)).cast("int"),
        F.least(width, F.ceil(cx + r)).cast("int"),
        F.least(height, F.ceil(cy + r)).cast("int"),
    )


def verification_window(b: Column, width: Column, height: Column, factor: float = 3.0, least: float = 80.0) -> Column:
    """Padded pixel window around a bubble (X-13)."""
    x0, y0, x1, y1 = (e / SCALE * s for e, s in zip(edges(b), (width, height, width, height)))

    def axis(a: Column, z: Column, size: Column):
        mid = (a + z) / 2.0
        half = F.greatest((z - a) / 2.0 * factor, F.lit(least / 2.0) / SCALE * size)
        low = F.greatest(F.lit(0.0), mid - half).cast("int")
        high = F.least(size.cast("double"), mid + half).cast("int")
        return low, F.when(high <= low, F.least(size.cast("int"), low + 1)).otherwise(high)

    (xa, xb), (ya, yb) = axis(x0, x1, width), axis(y0, y1, height)
    return box(xa, ya, xb, yb)


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when apart or empty (X-14)."""
    iw = F.greatest(F.lit(0.0), F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]))
    ih = F.greatest(F.lit(0.0), F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
    inter = iw * ih
    area = lambda s: F.greatest(F.lit(0.0), s["xmax"] - s["xmin"]) * F.greatest(F.lit(0.0), s["ymax"] - s["ymin"])
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def normalize_bounding_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Box only when all four edges are numbers; no range check (X-15)."""
    full = xmin.isNotNull() & ymin.isNotNull() & xmax.isNotNull() & ymax.isNotNull()
    return F.when(full, box(*[e.cast("double") for e in (xmin, ymin, xmax, ymax)]))


def pick_bbox(bubble: Column, legacy: Column) -> Column:
    """The bubble box unless absent or empty, else the legacy box (X-16)."""
    return F.when(F.coalesce(*edges(bubble)).isNotNull(), bubble).otherwise(legacy)


def circularity(area: Column, radius: Column) -> Column:
    return area / (F.pi() * radius * radius)


def overlay_percent(b: Column) -> Column:
    """Left, top, width and height as percent of the page (P-20)."""
    x0, y0, x1, y1 = edges(b)
    return F.struct(
        (x0 / 10).alias("left"), (y0 / 10).alias("top"),
        ((x1 - x0) / 10).alias("width"), ((y1 - y0) / 10).alias("height"),
    )


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["xmin"], b["xmax"]) & y.between(b["ymin"], b["ymax"])
