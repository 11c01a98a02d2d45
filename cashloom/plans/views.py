"""Finance views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..schema import Batch, canonical

TABLES = ("orders", "customer", "lineitem", "events", "part", "nation")

LEDGER = """
SELECT o_orderkey AS ord, 'INV-' || CAST(o_orderkey + 2000 AS STRING) AS id, 'ledger' AS source,
       CAST(o_orderdate AS DATE) AS date, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount,
       CASE o_orderkey % 15 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'XYZ' ELSE 'INR' END AS currency,
       'INV-' || CAST(o_orderkey + 2000 AS STRING) AS reference, c_name AS counterparty,
       'PAYMENT FOR INV ' || CAST(o_orderkey + 2000 AS STRING) AS memo,
       CASE WHEN o_orderkey % 29 = 0 THEN 'HDFC9' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 7 = 0 THEN 'hdfc0000001' END AS ifsc
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Payments by class of the order: as they are, a few paise off, late, without reference, split in two, missing.
PAYMENTS = f"""
SELECT ord * 2 AS ord, 'pay_' || CAST(ord AS STRING) AS id, 'settlement' AS source,
       date + CAST(CASE WHEN ord % 20 IN (12, 13) THEN 7 ELSE ord % 3 END AS INT) AS date,
       CASE WHEN ord % 20 IN (10, 11) THEN inr + ord % 7 - 3 WHEN ord % 20 = 16 THEN CAST(floor(inr * 6 / 10.0e0) AS BIGINT) ELSE inr END AS amount,
       'INR' AS currency, CASE WHEN ord % 20 IN (14, 15) THEN NULL ELSE reference END AS reference, counterparty,
       CASE WHEN ord % 20 IN (14, 15) THEN 'NEFT ' || counterparty ELSE 'NEFT INV' || CAST(ord + 2000 AS STRING) END AS memo
FROM (SELECT *, CASE currency WHEN 'USD' THEN CAST(floor(amount * 87.42e0 + 0.5) AS BIGINT) WHEN 'EUR' THEN CAST(floor(amount * 94.15e0 + 0.5) AS BIGINT)
             ELSE amount END AS inr FROM ({LEDGER}) AS l) AS p
WHERE ord % 20 <> 17
UNION ALL
SELECT ord * 2 + 1 AS ord, 'pay_' || CAST(ord AS STRING) || '_b' AS id, 'settlement' AS source, date + CAST(2 AS INT) AS date,
       amount - CAST(floor(amount * 6 / 10.0e0) AS BIGINT) AS amount, 'INR' AS currency, reference, counterparty,
       'NEFT INV' || CAST(ord + 2000 AS STRING) AS memo
FROM ({LEDGER}) AS l WHERE ord % 20 = 16 AND currency = 'INR'
"""

SETTLEMENTS = """
SELECT l_orderkey * 1000 + rn AS ord, 'line_' || CAST(l_orderkey AS STRING) || '_' || CAST(rn AS STRING) AS id, 'settlement' AS source,
       CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN -amt ELSE amt END AS amount, 'INR' AS currency,
       CASE WHEN l_orderkey % 2 = 0 THEN 'SETTLEMENT N' || lpad(CAST(l_orderkey AS STRING), 12, '0') ELSE 'SETTLEMENT' END AS memo,
       'setl_' || CAST(l_orderkey AS STRING) AS parent_id,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(floor(amt * 2 / 100.0e0) AS BIGINT) END AS fees,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(floor(floor(amt * 2 / 100.0e0) * 18 / 100.0e0) AS BIGINT) END AS tax
FROM (SELECT *, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS amt,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                                l_returnflag, l_linestatus, l_shipdate) AS rn FROM {lineitem}) AS l
"""

BATCHES = f"""
SELECT parent_id AS batch_id, min(ord) AS batch_ord,
       CAST(coalesce(sum(CASE WHEN amount >= 0 THEN amount END), 0) AS BIGINT) AS gross,
       CAST(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0) AS BIGINT) AS refunds,
       CAST(sum(fees) AS BIGINT) AS fees, CAST(sum(tax) AS BIGINT) AS tax, max(date) AS date, count(*) AS payments,
       CAST(sum(amount) - sum(fees) - sum(tax) AS BIGINT) AS expected_net
FROM ({SETTLEMENTS}) AS s GROUP BY parent_id
"""

# A credit for most batches: some a little off, some missing, half with their UTR.
BANK = f"""
SELECT k AS ord, 'bank_' || CAST(k AS STRING) AS id, 'bank' AS source, date + CAST(k % 4 AS INT) AS date,
       expected_net + CASE WHEN k % 11 = 0 THEN 150 WHEN k % 17 = 0 THEN -75 ELSE 0 END AS amount, 'INR' AS currency,
       CASE WHEN k % 2 = 0 THEN 'NEFT N' || lpad(CAST(k AS STRING), 12, '0') ELSE 'NEFT CREDIT' END AS memo
FROM (SELECT *, CAST(substr(batch_id, 6) AS BIGINT) AS k FROM ({BATCHES}) AS b) AS c WHERE k % 13 <> 0
"""

STANDING = """
SELECT min(event_id) AS ord, 'order_' || CAST(min(event_id) AS STRING) AS id, 'acc_' || CAST(user_id AS STRING) AS account_id,
       event_type AS reference, CAST(floor(max(value) * 100 + 0.5) AS BIGINT) AS amount
FROM {events} WHERE event_type <> 'view' AND user_id % 5 <> 0 GROUP BY user_id, event_type
"""

TRANSACTIONS = """
SELECT event_id AS ord, 'trans_' || CAST(event_id AS STRING) AS id, 'acc_' || CAST(user_id AS STRING) AS account_id,
       event_type AS reference, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount, CAST(ts AS DATE) AS date,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'VYDAJ' ELSE 'PRIJEM' END AS type
FROM {events}
"""


def duck(sql: str) -> str:
    """The same text for DuckDB, whose views have the tables' names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def records(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return canonical(run(spark, sf_dir, sql))


def finance_batch(spark: SparkSession, sf_dir: str) -> Batch:
    """Invoices with their payments; bank credits of the settlement batches."""
    return Batch("orders", "INR", records(spark, sf_dir, BANK), records(spark, sf_dir, PAYMENTS), records(spark, sf_dir, LEDGER))


def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, SETTLEMENTS)


