"""Pricing components from a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURRENCY = "INR"

# Texts shown with every estimate.
ESTIMATE_NOTE = "Mock/estimated procurement data for demonstration purposes only. Not a real quotation."
NO_TOTAL_NOTE = ESTIMATE_NOTE + " Total cost omitted: quantity is missing or invalid."


def price(components: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach a ``procurement_data`` struct to every component (J-05).

    The catalogue has one row per part number. No hint is given: Spark
    broadcasts it while its measured size stays under the session's limit, and
    beyond that joins by part number, where adaptive execution splits the
    component side of a skewed partition (a common part, or no part at all).
    """
    entry = catalog.select(
        "part_number",
        F.lit(True).alias("_found"),
        F.col("estimated_unit_cost_usd").cast("double").alias("_cost"),
        F.col("supplier_source").alias("_supplier"),
        F.col("stock_status").alias("_stock"),
    )
    rows = components.join(entry, "part_number", "left").withColumn(
        "_found", F.coalesce("_found", F.lit(False))
    )
    part, cost, quantity = F.col("part_number"), F.col("_cost"), F.col("quantity")
    nameless = F.coalesce(part, F.lit("")) == ""
    found = F.col("_found") & ~nameless
    priced = found & F.coalesce(cost >= 0, F.lit(False))
    total = F.when(priced & (quantity > 0), F.round(cost * quantity, 2))
    note = (
        F.when(nameless, "No part number available for pricing lookup.")
        .when(~found, F.concat(F.lit("No supplier pricing found for part number '"), part, F.lit("'.")))
        .when(~priced, F.concat(F.lit("Catalog entry for '"), part, F.lit("' has no valid unit cost.")))
        .when(total.isNull(), NO_TOTAL_NOTE)
        .otherwise(ESTIMATE_NOTE)
    )
    record = F.struct(
        F.when(priced, F.round(cost, 2)).alias("estimated_unit_cost_usd"),
        total.alias("estimated_total_cost_usd"),
        F.when(priced, F.col("_supplier")).alias("supplier_source"),
        F.when(priced, F.coalesce("_stock", F.lit("unknown"))).otherwise("unknown").alias("stock_status"),
        F.lit(True).alias("estimated"),
        F.lit(True).alias("mock_data"),
        note.alias("note"),
    )
    return rows.select(*components.columns, record.alias("procurement_data"))


def procurement_counts() -> dict:
    data = F.col("procurement_data")
    cents = data["estimated_total_cost_usd"].cast("decimal(28,2)")
    return {
        "estimated_total_cost_usd": F.coalesce(F.sum(cents), F.lit(0)).cast("double"),
        "items_with_price": F.count_if(data["estimated_unit_cost_usd"].isNotNull()),
        "items_without_price": F.count_if(data["estimated_unit_cost_usd"].isNull()),
    }


def procurement_summary(priced: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Cost totals per document; documents without components give 0 (A-02)."""
    figures = procurement_counts()
    totals = priced.groupBy("doc_id").agg(*[c.alias(n) for n, c in figures.items()])
    if documents is not None:
        totals = documents.select("doc_id").join(totals, "doc_id", "left").na.fill(0, list(figures))
    return totals.withColumns({
        "currency": F.lit(CURRENCY), "estimated": F.lit(True), "mock_data": F.lit(True),
        "note": F.lit(ESTIMATE_NOTE),
    })
