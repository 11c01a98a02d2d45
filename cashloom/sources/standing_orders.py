"""Standing orders and transactions in semicolon-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import to_minor

# fixed values: columns by place
ORDER = "order_id string, account_id string, bank_to string, account_to string, amount string, k_symbol string"
TRANS = "trans_id string, account_id string, date string, type string, operation string, amount string, balance string, k_symbol string, bank string, account string"
OUTGOING = "VYDAJ"
CURRENCY = "CZK"
_OPTIONS = {"sep": ";", "quote": '"', "header": True, "enforceSchema": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}


def short_date(text: Column) -> Column:
    """YYMMDD of the twentieth century."""
    return F.try_to_date(F.concat(F.lit("19"), F.trim(text)), "yyyyMMdd")


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(**_OPTIONS).schema(ORDER).csv(path)
    return rows.withColumn("amount", to_minor(F.col("amount")))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(**_OPTIONS).schema(TRANS).csv(path)
    return rows.select("*", short_date(F.col("date")).alias("_d")).withColumn("date", F.col("_d")).withColumn("amount", to_minor(F.col("amount"))).withColumn("balance", to_minor(F.col("balance"))).drop("_d")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_orders(spark, f"{folder}/order.asc"), read_transactions(spark, f"{folder}/trans.asc")


def as_ledger(orders: DataFrame) -> DataFrame:
    """Orders as invoices without a date, keyed by the destination; with account_id."""
    return orders.select(
        F.expr("try_cast(order_id as bigint)").alias("ord"), F.concat(F.lit("order_"), "order_id").alias("id"), F.lit("ledger").alias("source"), "amount",
        F.lit(CURRENCY).alias("currency"), F.concat_ws(":", "bank_to", "account_to").alias("reference"), "account_id",
    )


def as_bank(transactions: DataFrame) -> DataFrame:
    """Outgoing transactions as bank records, keyed by the destination; with account_id."""
    own = transactions.where(F.col("type") == OUTGOING)
    return own.select(
        F.expr("try_cast(trans_id as bigint)").alias("ord"), F.concat(F.lit("trans_"), "trans_id").alias("id"), F.lit("bank").alias("source"), "date", "amount",
        F.lit(CURRENCY).alias("currency"), F.concat_ws(":", "bank", "account").alias("reference"), "account_id",
    )
