"""Price catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG_SCHEMA = (
    "part_number string, estimated_unit_cost_usd double, supplier_source string, stock_status string"
)

# Part number, unit cost, supplier, stock status.
BASE_CATALOG = [
    ("FB-M8-001", 35.00, "Chennai Fastener Works", "In Stock"),
    ("WSH-M8-002", 6.00, "Coimbatore Precision Components", "In Stock"),
    ("BRK-STD-100", 950.00, "Salem Metal Fabricators", "In Stock"),
    ("BRG-6202-Z", 240.00, "Tiruchirappalli Bearing Traders", "Low Stock"),
    ("GSK-RUB-045", 85.00, "Erode Rubber & Seals Co.", "In Stock"),
    ("SHF-ST-303", 640.00, "Hosur Precision Engineering", "Backordered"),
    ("PL-6061-014", 1650.00, "Coimbatore Metal Fabricators", "In Stock"),
    ("SHCS-M6-025", 11.00, "Tiruppur Fastener Industries", "In Stock"),
    ("WSH-M8-STD", 5.00, "Madurai Engineering Supplies", "In Stock"),
    ("HB-M8-001", 8.00, "Chennai Fastener Works", "In Stock"),
    ("WS-M8-001", 3.00, "Coimbatore Precision Components", "In Stock"),
    ("BH-001", 420.00, "Salem Metal Fabricators", "In Stock"),
    ("BR-6204", 260.00, "Tiruchirappalli Bearing Traders", "In Stock"),
    ("SH-001", 150.00, "Hosur Precision Engineering", "In Stock"),
    ("EC-001", 180.00, "Salem Metal Fabricators", "Low Stock"),
    ("NT-M8-001", 4.00, "Chennai Fastener Works", "In Stock"),
]


def base_catalog(spark: SparkSession) -> DataFrame:
    """The fixed entries as an inline table, whose size Spark knows."""
    rows = ", ".join(
        f"('{part}', {cost}d, '{supplier}', '{stock}')" for part, cost, supplier, stock in BASE_CATALOG
    )
    names = [field.split()[0] for field in CATALOG_SCHEMA.split(", ")]
    return spark.sql(f"select * from values {rows} as t({', '.join(names)})")


def merge_catalog(base: DataFrame, override: DataFrame) -> DataFrame:
    """Override entries replace whole entries of the same part (J-06)."""
    kept = base.join(override.select("part_number"), "part_number", "left_anti")
    return kept.unionByName(override, allowMissingColumns=True)


def catalog(spark: SparkSession, override: DataFrame | None = None) -> DataFrame:
    """The base catalogue, optionally overridden per part number (S-06)."""
    base = base_catalog(spark)
    return base if override is None else merge_catalog(base, override)
