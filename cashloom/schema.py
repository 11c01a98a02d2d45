"""The canonical record and the batch made of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = (
    "ord bigint, id string, source string, date date, amount bigint, currency string, reference string, counterparty string, "
    "memo string, parent_id string, fees bigint, tax bigint, ifsc string, raw map<string,string>"
)
COLUMNS = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]


@dataclass(frozen=True)
class Batch:
    """Bank credits, settlement payments and ledger invoices, with amounts in minor units.

    ``ord`` is each record's place in its source: it breaks all ties, as Spark's rows have no order.
    """

    dataset_id: str
    base_currency: str
    bank: DataFrame
    settlements: DataFrame
    ledger: DataFrame


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with all canonical columns, those it lacks as nulls, and no others."""
    kinds = dict(c.split(" ", 1) for c in RECORD.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
