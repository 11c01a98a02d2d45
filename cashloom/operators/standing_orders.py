"""Recurring payments: transactions tied to standing orders on the same account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import score_amount

TOLERANCE_PCT = 0.1
ACCEPT = 0.8


def match_standing_orders(orders: DataFrame, trans: DataFrame, tolerance_pct: float = TOLERANCE_PCT, accept: float = ACCEPT) -> DataFrame:
    """One row for each of ``trans`` (id, account_id, reference, amount): trans_id, order_id, confidence.

    Of the orders (ord, id, account_id, reference, amount) on its account with its reference, the one
    nearest in amount, the first of equal ones; order_id is null under ``accept``, confidence stays. An
    order may serve any number of transactions.
    """
    o = orders.select(F.col("ord").alias("o_ord"), F.col("id").alias("o_id"), "account_id", "reference", F.col("amount").alias("o_amount"))
    pairs = trans.select(F.col("id").alias("trans_id"), "account_id", "reference", "amount").join(o, ["account_id", "reference"], "left")
    score = 0.5 + 0.5 * score_amount(F.col("o_amount"), F.col("amount"), tolerance_pct)
    best = pairs.groupBy("trans_id").agg(F.max(F.when(F.col("o_id").isNotNull(), F.struct(score.alias("c"), (-F.col("o_ord")).alias("o"), F.col("o_id").alias("id")))).alias("b"))
    confidence = F.coalesce("b.c", F.lit(0.0))
    return best.select("trans_id", F.when(confidence >= accept, F.col("b.id")).alias("order_id"), confidence.alias("confidence"))


def matching_stats(orders: DataFrame, trans: DataFrame) -> DataFrame:
    """Transactions, orders, and transactions on accounts that have no order, in one row."""
    lonely = trans.join(orders.select("account_id"), "account_id", "left_anti").agg(F.count(F.lit(1)).alias("trans_without_orders"))
    return trans.agg(F.count(F.lit(1)).alias("trans")).crossJoin(orders.agg(F.count(F.lit(1)).alias("orders"))).crossJoin(lonely)


def true_orders(orders: DataFrame, trans: DataFrame) -> DataFrame:
    """Truth: the first order on the account with the reference and exactly the amount; trans_id, order_id."""
    hit = orders.select("account_id", "reference", "amount", F.struct("ord", "id").alias("o"))
    found = trans.select(F.col("id").alias("trans_id"), "account_id", "reference", "amount").join(hit, ["account_id", "reference", "amount"], "left")
    return found.groupBy("trans_id").agg(F.min("o").alias("o")).select("trans_id", F.col("o.id").alias("order_id"))


def executed(orders: DataFrame, truth: DataFrame) -> DataFrame:
    """Orders with a flag whether any transaction carried them out."""
    done = truth.where("order_id IS NOT NULL").select(F.col("order_id").alias("id")).distinct().withColumn("_d", F.lit(True))
    return orders.join(done, "id", "left").withColumn("executed", F.coalesce("_d", F.lit(False))).drop("_d")
