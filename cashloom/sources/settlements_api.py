"""Settlement pages of a payment processor's API as canonical records. Fetching is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import canonical

# fixed values: an item's fields
ITEM = "id string, entity string, amount bigint, fees bigint, tax bigint, utr string, status string, created_at bigint"
MOST = 100


def page_size(count: int | None) -> int:
    return max(1, min(MOST, count if count is not None else MOST))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON pages {"items": [...]}."""
    pages = spark.read.schema(f"items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return pages.select(F.inline("items"))


def as_settlements(items: DataFrame) -> DataFrame:
    """Amounts are minor units already; an empty UTR is none. Time decides the order."""
    raw = F.create_map(*[x for c in ("id", "entity", "utr", "status") for x in (F.lit(c), F.col(c))])
    return canonical(
        items.select(
            F.col("created_at").alias("ord"), "id", F.lit("settlement").alias("source"), F.to_date(F.timestamp_seconds("created_at")).alias("date"), "amount",
            F.lit("INR").alias("currency"), F.nullif(F.col("utr"), F.lit("")).alias("reference"), "fees", "tax", raw.alias("raw"),
        )
    )
