"""Linking BOM rows to callouts.

Inputs carry ``doc_id`` and an ordinal (``bom_ord``, ``call_ord``) that fixes
list order within a document. ``item_kind`` / ``bubble_kind`` are optional
columns naming the kind of an untyped identifier; without them identifiers are
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.functions import geometry as geo
from draftweave.functions import scalars as sc
from draftweave.operators import skew

# Sections of the component list, in order.
MATCHED, BOM_ONLY, CALLOUT_ONLY, AMBIGUOUS_ITEM, AMBIGUOUS_BUBBLE = 0, 1, 2, 3, 4

BOM_DEFAULTS = {
    "item_kind": "string", "part_number": "string", "part_name": "string", "description": "string",
    "quantity": "bigint", "material_specification": "string", "material": "string",
    "revision": "string", "confidence_score": "double",
}
CALLOUT_DEFAULTS = {
    "page_id": "string", "bubble_kind": "string", "location_description": "string",
    "bubble_bbox": "struct<xmin:double,ymin:double,xmax:double,ymax:double>",
    "bounding_box": "struct<xmin:double,ymin:double,xmax:double,ymax:double>",
    "confidence_score": "double",
}


def _filled(frame: DataFrame, defaults: dict[str, str], kind: str) -> DataFrame:
    missing = {
        name: F.lit("string") if name == kind else F.lit(None).cast(dtype)
        for name, dtype in defaults.items()
        if name not in frame.columns
    }
    return frame.withColumns(missing) if missing else frame


def whole_number(frame: DataFrame, name: str) -> Column:
    """Integer column from whichever type the input has."""
    dtype = dict(frame.dtypes)[name]
    c = F.col(name)
    if dtype == "string":
        return sc.safe_int(c)
    if dtype in ("double", "float") or dtype.startswith("decimal"):
        return F.when(c == F.floor(c), c.try_cast("bigint"))
    return F.lit(None).cast("bigint") if dtype == "boolean" else c.cast("bigint")


def real_number(frame: DataFrame, name: str) -> Column:
    """Double column from whichever type the input has."""
    dtype = dict(frame.dtypes)[name]
    c = F.col(name)
    if dtype == "string":
        return sc.safe_float(c)
    return F.lit(None).cast("double") if dtype == "boolean" else c.cast("double")


def bom_rows(bom: DataFrame) -> DataFrame:
    """BOM side of the link: the key and the fields a component takes from it."""
    b = _filled(bom, BOM_DEFAULTS, "item_kind")
    return b.select(
        "doc_id", "bom_ord",
        sc.normalize_identifier(F.col("item_number"), F.col("item_kind")).alias("key"),
        F.struct(
            F.col("item_number").cast("string").alias("raw"),
            F.col("item_kind").alias("kind"),
            "part_number",
            F.coalesce(sc.blank_to_null(F.col("description")), sc.blank_to_null(F.col("part_name"))).alias("part_name"),
            F.coalesce("description", F.lit("")).alias("description"),
            whole_number(b, "quantity").alias("quantity"),
            F.coalesce("material_specification", "material").alias("material"),
            F.coalesce("revision", F.lit("")).alias("revision"),
            real_number(b, "confidence_score").alias("confidence"),
        ).alias("bom"),
    )


def callout_rows(callouts: DataFrame) -> DataFrame:
    """Callout side of the link."""
    c = _filled(callouts, CALLOUT_DEFAULTS, "bubble_kind")
    picked = geo.pick_bbox(F.col("bubble_bbox"), F.col("bounding_box"))
    return c.select(
        "doc_id", "call_ord",
        sc.normalize_identifier(F.col("bubble_number"), F.col("bubble_kind")).alias("key"),
        F.struct(
            F.col("bubble_number").cast("string").alias("raw"),
            F.col("bubble_kind").alias("kind"),
            F.coalesce("location_description", F.lit("")).alias("location"),
            geo.normalize_bounding_box(*geo.edges(picked)).alias("box"),
            F.col("page_id").cast("string").alias("page"),
            real_number(c, "confidence_score").alias("confidence"),
        ).alias("callout"),
    )


def hot_documents(bom: DataFrame, callouts: DataFrame) -> DataFrame | None:
    """Documents too large for one task, over both sides together."""
    both = bom.select("doc_id").unionAll(callouts.select("doc_id"))
    return skew.hot_groups(both, ["doc_id"])


def _pairs(b: DataFrame, c: DataFrame) -> DataFrame:
    """Rows of ordinary documents, both sides linked after one exchange by document.

    A single BOM row meets every callout of its key; several are paired by
    position; a null key meets nothing. A callout takes the BOM row it meets by
    a window, and a BOM row that some callout took is dropped. Windows by key
    and the numbering downstream all lie within the exchange by document.
    """
    rows = b.unionByName(c, allowMissingColumns=True).repartition("doc_id")
    key = W.partitionBy("doc_id", "key")
    is_bom = F.col("bom").isNotNull()
    placed = rows.withColumn("_bom", is_bom).withColumns({
        "bom_n": F.count("bom").over(key),
        "call_n": F.count("callout").over(key),
        "_slot": F.row_number().over(W.partitionBy("doc_id", "key", "_bom").orderBy("bom_ord", "call_ord")).cast("bigint"),
    })
    keyed = F.col("key").isNotNull()
    meets = keyed & F.col("doc_id").isNotNull()
    # A single BOM row stands at the slot of every callout.
    single = F.col("bom_n") == 1
    slot = placed.withColumn("_at", F.when(single, 1).otherwise(F.col("_slot")))
    side = F.first(F.when(is_bom, F.struct("bom_ord", "bom", "_slot")), ignorenulls=True)
    met = slot.withColumn("_met", F.when(meets, side.over(W.partitionBy("doc_id", "key", "_at"))))
    taken = F.col("_bom") & meets & F.when(single, F.col("call_n") > 0).otherwise(F.col("_slot") <= F.col("call_n"))
    own = F.when(F.col("_bom"), F.struct("bom_ord", "bom", "_slot")).otherwise(F.col("_met"))
    left = met.filter(~taken).withColumn("_own", own)
    return left.select(
        "doc_id", "key",
        F.col("_own.bom_ord").alias("bom_ord"), F.col("_own.bom").alias("bom"),
        F.when(keyed, F.col("bom_n")).otherwise(0).alias("bom_n"),
        F.when(keyed, F.col("_own._slot")).alias("bom_rn"),
        "call_ord", "callout",
        F.when(keyed, F.col("call_n")).otherwise(0).alias("call_n"),
        F.when(keyed & ~F.col("_bom"), F.col("_slot")).alias("call_rn"),
    )


def _with_ambiguous(linked: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Rows without a key join nothing and pass through."""
    return linked.unionByName(b.filter("key is null"), allowMissingColumns=True).unionByName(
        c.filter("key is null"), allowMissingColumns=True
    )


def _pairs_of_hot_documents(b: DataFrame, c: DataFrame) -> DataFrame:
    """The same links when one document, or one key in it, fills many tasks.

    Key sizes are counted first. Keys with several BOM rows join on
    ``(doc_id, key, position)``, which no single key can skew; a key with one
    BOM row is a one-row lookup; hot keys meet broadcasts bounded by the count
    of hot keys.
    """
    on = ["doc_id", "key"]
    every_b, every_c = b, c
    b, c = b.filter("key is not null"), c.filter("key is not null")
    sizes = (
        b.groupBy(*on).agg(F.count(F.lit(1)).alias("bom_n"))
        .join(c.groupBy(*on).agg(F.count(F.lit(1)).alias("call_n")), on, "full_outer")
        .na.fill(0, ["bom_n", "call_n"])
    )
    sizes = skew.durable(sizes.repartition(*on))
    limit = skew.hot_rows(b.sparkSession)
    hot = sizes.filter((F.col("bom_n") > limit) | (F.col("call_n") > limit)).select(*on)
    hot = None if hot.isEmpty() else hot
    # Both sides are read several times below; the checkpoints keep one copy.
    b = skew.durable(skew.ranked(skew.lookup(b, sizes, on, hot), on, [F.col("bom_ord")], "bom_rn", hot))
    c = skew.durable(skew.ranked(skew.lookup(c, sizes, on, hot), on, [F.col("call_ord")], "call_rn", hot))

    several_b = b.filter("bom_n > 1").withColumnRenamed("bom_rn", "slot")
    several_c = c.filter("bom_n > 1").withColumnRenamed("call_rn", "slot")
    paired = (
        several_b.drop("call_n").alias("b")
        .join(several_c.drop("bom_n").alias("c"), [*on, "slot"], "full_outer")
        .withColumns({
            "bom_rn": F.when(F.col("bom").isNotNull(), F.col("slot")),
            "call_rn": F.when(F.col("callout").isNotNull(), F.col("slot")),
        })
        .drop("slot", "bom_n", "call_n")
    )
    paired = skew.lookup(paired, sizes, on, hot)
    one_b = b.filter("bom_n = 1")
    repeated = skew.lookup(
        c.filter("bom_n = 1"), one_b.select(*on, "bom_ord", "bom", "bom_rn"), on, hot
    )
    alone_b = one_b.filter("call_n = 0")
    alone_c = c.filter("bom_n = 0")
    linked = (
        paired.unionByName(repeated)
        .unionByName(alone_b, allowMissingColumns=True)
        .unionByName(alone_c, allowMissingColumns=True)
    )
    return _with_ambiguous(linked, every_b, every_c).na.fill(0, ["bom_n", "call_n"])


def links(bom: DataFrame, callouts: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every BOM row and callout, linked or not, with its section (W-01, J-01, U-01)."""
    b, c = bom_rows(bom), callout_rows(callouts)
    on = ["doc_id"]
    rows = _pairs(skew.cold_part(b, hot, on), skew.cold_part(c, hot, on))
    if hot is not None:
        rows = rows.unionByName(
            _pairs_of_hot_documents(skew.hot_part(b, hot, on), skew.hot_part(c, hot, on))
        )
    has_b, has_c, keyed = (F.col(n).isNotNull() for n in ("bom", "callout", "key"))
    section = (
        F.when(has_b & has_c, MATCHED)
        .when(has_b & keyed, BOM_ONLY)
        .when(keyed, CALLOUT_ONLY)
        .when(has_b, AMBIGUOUS_ITEM)
        .otherwise(AMBIGUOUS_BUBBLE)
    )
    return rows.withColumn("section", section)


def link_status(section: Column) -> Column:
    return (
        F.when(section == MATCHED, "matched")
        .when(section == BOM_ONLY, "bom_only")
        .when(section == CALLOUT_ONLY, "callout_only")
        .otherwise("ambiguous")
    )


def reconcile(bom: DataFrame, callouts: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """Unified component rows, numbered per document (J-01, W-02, P-13).

    ``hot`` may carry the result of :func:`hot_documents`; by default it is
    computed here.
    """
    if hot is True:
        hot = hot_documents(bom, callouts)
    rows = links(bom, callouts, hot)
    order = [
        F.col("section"), *sc.key_order(F.col("key")), F.coalesce("call_ord", "bom_ord"),
    ]
    rows = skew.ranked(rows, ["doc_id"], order, "seq", hot)
    loose_b = F.col("section") == AMBIGUOUS_ITEM
    loose_c = F.col("section") == AMBIGUOUS_BUBBLE
    return rows.select(
        "doc_id", "seq",
        sc.component_id(F.col("seq")).alias("component_id"),
        F.when(F.col("bom").isNotNull(), F.col("key")).alias("item_number"),
        F.when(F.col("callout").isNotNull(), F.col("key")).alias("bubble_number"),
        F.col("bom.part_number").alias("part_number"),
        F.col("bom.part_name").alias("part_name"),
        F.coalesce("bom.description", F.lit("")).alias("description"),
        F.col("bom.quantity").alias("quantity"),
        F.col("bom.material").alias("material_specification"),
        F.coalesce("bom.revision", F.lit("")).alias("revision"),
        F.coalesce("callout.location", F.lit("")).alias("location_description"),
        F.col("callout.box").alias("bounding_box"),
        F.col("callout.page").alias("page_id"),
        sc.combine_confidence(F.col("bom.confidence"), F.col("callout.confidence")).alias("confidence_score"),
        link_status(F.col("section")).alias("link_status"),
        (F.col("bom_n") > 1).alias("duplicate_item_number"),
        ((F.col("call_n") > 1) & (F.col("bom_n") != 1)).alias("duplicate_bubble_number"),
        loose_b.alias("ambiguous_item_number"),
        loose_c.alias("ambiguous_bubble_number"),
        F.col("bom.raw").alias("raw_item_number"),
        F.col("bom.kind").alias("raw_item_kind"),
        F.col("callout.raw").alias("raw_bubble_number"),
        F.col("callout.kind").alias("raw_bubble_kind"),
        F.col("bom.confidence").alias("bom_confidence"),
        F.col("callout.confidence").alias("callout_confidence"),
        "bom_ord", "call_ord", "bom_rn", "call_rn",
    )


CONTRACT = [
    "doc_id", "component_id", "item_number", "bubble_number", "part_number", "part_name",
    "description", "quantity", "material_specification", "revision", "location_description",
    "bounding_box", "confidence_score",
]


def contract_view(components: DataFrame) -> DataFrame:
    """The shared fields only; bookkeeping columns are dropped."""
    extra = ["procurement_data"] if "procurement_data" in components.columns else []
    return components.select(*CONTRACT, *extra)


# --- side lists ----------------------------------------------------------------
# Each is a row table rather than an array per document, so a document of any
# size stays spread out. The first row of a key stands for the key.


def _positions(rows: DataFrame, order: list[Column], hot: DataFrame | None) -> DataFrame:
    return skew.ranked(rows, ["doc_id"], order, "position", hot)


def duplicate_item_numbers(components: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Keys with more than one BOM row, in numeric order (A-03)."""
    first = components.filter("duplicate_item_number and bom_rn = 1").select("doc_id", "item_number")
    return _positions(first, sc.key_order(F.col("item_number")), hot)


def duplicate_bubble_numbers(components: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Keys with more than one callout and not exactly one BOM row (A-04)."""
    first = components.filter("duplicate_bubble_number and call_rn = 1").select("doc_id", "bubble_number")
    return _positions(first, sc.key_order(F.col("bubble_number")), hot)


def ambiguous_identifiers(components: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Raw values that name no single number, BOM side first (A-05)."""
    rows = components.filter("link_status = 'ambiguous'").select(
        "doc_id", "seq",
        F.when(F.col("ambiguous_item_number"), "bom").otherwise("callout").alias("side"),
        F.coalesce("raw_item_number", "raw_bubble_number").alias("raw"),
    )
    return _positions(rows, [F.col("seq")], hot).drop("seq")


def unmatched_rows(components: DataFrame) -> DataFrame:
    """Leftover and ambiguous rows of each side (A-06)."""
    side = F.when(
        (F.col("link_status") == "bom_only") | F.col("ambiguous_item_number"), "bom"
    ).otherwise("callout")
    return components.filter("link_status <> 'matched'").select(
        "doc_id", side.alias("side"), "component_id", "link_status",
        F.coalesce("item_number", "bubble_number").alias("key"),
        F.coalesce("bom_ord", "call_ord").alias("ord"),
    )
