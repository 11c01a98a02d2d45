"""Queries of readers, records, reasons and payloads. Files that readers take are written to the shared folder first."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..evaluation.scores import class_counts
from ..functions import calendar as cal
from ..functions import money
from ..functions.tables import FX_TO_INR, GENERIC_COPY, HOLIDAYS
from ..operators import adjudicate, candidates, classify, forecast, fx, qa
from ..operators.shared import shared_dir
from ..sources import csv_batch, settlements_api, sinks, standing_orders, two_way
from .relational_queries import FC1, _matched, fc1_forecast
from .views import LEDGER, PAYMENTS, duck, records, run

CFG = MatchConfig()
_L, _P = duck(LEDGER), duck(PAYMENTS)


def _written(df: DataFrame, sep: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/cashloom-files/{uuid.uuid4().hex}"
    df.write.options(sep=sep, header=True, quoteAll=True, quote="\"", escape="\"").csv(path)
    return path


# Uploads: every kind of defect, by the order's key.
_UPLOAD = """
SELECT CAST(o_orderkey + 1 AS BIGINT) AS line_no, CASE o_orderkey % 12 WHEN 0 THEN 'cash' WHEN 1 THEN NULL ELSE 'bank' END AS source,
       CASE WHEN o_orderkey % 12 = 2 THEN NULL WHEN o_orderkey % 12 = 3 THEN 'same' ELSE 'b' || CAST(o_orderkey AS STRING) END AS id,
       CASE o_orderkey % 12 WHEN 4 THEN '05/09/2026' WHEN 5 THEN NULL ELSE '2026-09-05' END AS date,
       CASE o_orderkey % 12 WHEN 6 THEN '1,000' WHEN 7 THEN '1.234' ELSE '10.5' END AS amount, CASE WHEN o_orderkey % 12 = 8 THEN NULL ELSE 'INR' END AS currency,
       CASE WHEN o_orderkey % 12 = 9 THEN '-2' END AS fees, CASE WHEN o_orderkey % 12 = 10 THEN 'x' WHEN o_orderkey % 12 = 11 THEN '3' END AS tax FROM {orders}
"""


def val_csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in each row of an upload, first thing first."""
    return csv_batch.errors(run(spark, sf_dir, _UPLOAD)).select("line_no", "error")


VAL = f"""
SELECT line_no, 'row ' || CAST(line_no AS varchar) || ': ' || CASE
  WHEN source IS NULL OR source NOT IN ('bank', 'settlement', 'ledger') THEN '"source" can be bank, settlement, ledger; got "' || coalesce(source, '') || '".'
  WHEN id IS NULL THEN '"id" has no value.'
  WHEN row_number() OVER (PARTITION BY source, id ORDER BY line_no) > 1 THEN 'duplicate id "' || id || '" among rows of ' || source || '.'
  WHEN date IS NULL OR NOT regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN '"date" is no day like 2026-01-31; got "' || coalesce(date, '') || '".'
  WHEN NOT regexp_full_match(amount, '-?\\d+(\\.\\d{{1,2}})?') THEN '"amount" is no number of two decimals at most; got "' || amount || '".'
  WHEN currency IS NULL THEN '"currency" has no value.'
  WHEN NOT regexp_full_match(coalesce(fees, '0'), '\\d+(\\.\\d{{1,2}})?') THEN '"fees" is no number from 0 on; got "' || fees || '".'
  WHEN NOT regexp_full_match(coalesce(tax, '0'), '\\d+(\\.\\d{{1,2}})?') THEN '"tax" is no number from 0 on; got "' || tax || '".' END AS error FROM ({duck(_UPLOAD)}) AS u
"""

_ROWS = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'settlement' ELSE 'ledger' END AS source, 's' || CAST(s_suppkey AS STRING) AS id,
       CAST(CAST(DATE '2026-01-01' + CAST(s_suppkey % 300 AS INT) AS DATE) AS STRING) AS date, CAST(s_suppkey % 1000 AS STRING) || '.5' AS amount, 'inr' AS currency,
       CASE WHEN s_suppkey % 2 = 0 THEN 'say "' || s_name || '", twice' ELSE '' END AS memo, CASE WHEN s_suppkey % 5 = 0 THEN '1.25' ELSE '' END AS fees, s_suppkey FROM supplier
"""


def src2_csv_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of many uploads, each the text of up to forty suppliers, quotes and all."""
    rows = run(spark, sf_dir, _ROWS.replace("FROM supplier", "FROM {supplier}"))
    cells = ["source", "id", "date", "amount", "currency", "memo", "fees"]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])
    lines = rows.groupBy(F.floor(F.col("s_suppkey") / 40).alias("upload")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("x")))).alias("l"))
    texts = lines.select("upload", F.concat(F.lit(",".join(cells) + "\n"), F.array_join(F.transform("l", lambda r: r["x"]), "\n")).alias("value"))
    records, _ = csv_batch.parse_uploads(texts)
    return records.select("upload", "source", "id", F.col("date").cast("string").alias("date"), "amount", "currency", "memo", "fees")


SRC2 = f"""
SELECT s_suppkey // 40 AS upload, source, id, date, CAST(round(CAST(amount AS decimal(18, 2)) * 100) AS bigint) AS amount, upper(currency) AS currency, nullif(memo, '') AS memo,
       CAST(round(CAST(nullif(fees, '') AS decimal(18, 2)) * 100) AS bigint) AS fees FROM ({_ROWS}) AS r
"""

_TWO_WAY = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) ELSE '' END AS A_id, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS STRING) ELSE '' END AS B_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 5000 AS STRING) || '.25' END AS A_amount, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '-' || CAST(o_orderkey % 5000 AS STRING) || '.5' END AS B_amount,
       CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS A_valueDate, CAST(CAST(o_orderdate AS DATE) AS STRING) AS B_valueDate,
       CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE '' END AS A_currencyCode, 'ref ' || CAST(o_orderkey AS STRING) AS A_transactionReferences, CASE WHEN o_orderkey % 4 = 0 THEN 'more, "so"' ELSE '' END AS A_transactionAttributes,
       'K' || CAST(o_orderkey % 9 AS STRING) AS A_allocation, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'K' || CAST(o_orderkey % 9 AS STRING) END AS targetAllocation FROM {orders}
"""


def src3_two_way_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the two-way format, written as CSV and read by header, as invoices and payments; no allocation among them."""
    rows = two_way.read_rows(spark, _written(run(spark, sf_dir, _TWO_WAY), ","))
    both = two_way.ledger_side(rows).unionByName(two_way.settlement_side(rows))
    return both.select("id", "source", F.col("date").cast("string").alias("date"), "amount", "currency", "memo")


SRC3 = f"""
WITH r AS ({duck(_TWO_WAY)})
SELECT 'A_' || A_id AS id, 'ledger' AS source, CAST(try_cast(A_valueDate AS date) AS varchar) AS date, CAST(round(CAST(A_amount AS decimal(18, 2)) * 100) AS bigint) AS amount, coalesce(nullif(A_currencyCode, ''), 'USD') AS currency,
       concat_ws(' ', A_transactionReferences, nullif(A_transactionAttributes, '')) AS memo FROM r WHERE A_id <> '' AND A_amount <> 'n/a'
UNION ALL SELECT 'B_' || B_id, 'settlement', B_valueDate, CAST(round(CAST(B_amount AS decimal(18, 2)) * 100) AS bigint), 'USD', NULL FROM r WHERE B_id <> '' AND B_amount <> ''
"""


def jn17_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of both sides, that of payments read from a solution file whose header has other names."""
    t = run(spark, sf_dir, _TWO_WAY)
    solution = two_way.read_solution(spark, _written(t.select(F.col("B_id").alias("row"), F.col("targetAllocation").alias("answer"), F.lit("Public").alias("Usage")), ","))
    own = two_way.own_allocations(t).select(F.col("a_id").alias("id"), "key")
    return own.unionByName(two_way.true_allocations(t, solution).select(F.col("b_id").alias("id"), "key"))


JN17 = f"""
WITH r AS ({duck(_TWO_WAY)}) SELECT 'A_' || A_id AS id, A_allocation AS key FROM r WHERE A_id <> ''
UNION ALL SELECT 'B_' || B_id, nullif(targetAllocation, '') FROM r WHERE B_id <> ''
"""


def src10_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run(spark, sf_dir, "SELECT CAST(event_id AS STRING) AS B_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'A_' || CAST(user_id AS STRING) END AS A_id, '0.' || CAST(event_id % 9 AS STRING) AS confidence FROM {events}")
    return two_way.read_submission(spark, _written(t, ","))


SRC10 = "SELECT CAST(event_id AS varchar) AS b_id, CASE WHEN event_id % 3 <> 0 THEN 'A_' || CAST(user_id AS varchar) END AS a_id, CAST('0.' || CAST(event_id % 9 AS varchar) AS double) AS confidence FROM events"

_STANDING_FILE = "SELECT CAST(c_custkey AS STRING) AS order_id, CAST(c_custkey % 50 AS STRING) AS account_id, 'YZ' AS bank_to, CAST(c_custkey * 7 AS STRING) AS account_to, CAST(c_custkey % 900 AS STRING) || '.40' AS amount, 'SIPO' AS k_symbol FROM {customer}"
_TRANS_FILE = """
SELECT CAST(event_id AS STRING) AS trans_id, CAST(user_id AS STRING) AS account_id, CASE WHEN event_id % 10 = 0 THEN 'x' ELSE '97' || lpad(CAST(event_id % 12 + 1 AS STRING), 2, '0') || '15' END AS date,
       CASE WHEN event_id % 3 = 0 THEN 'PRIJEM' ELSE 'VYDAJ' END AS type, 'PREVOD' AS operation, CAST(event_id % 900 AS STRING) || '.4' AS amount, '1.00' AS balance, '' AS k_symbol, 'AB' AS bank, CAST(event_id % 70 AS STRING) AS account FROM {events}
"""


def prj2_orders_as_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing orders, written with semicolons and read again, as invoices."""
    got = standing_orders.as_ledger(standing_orders.read_orders(spark, _written(run(spark, sf_dir, _STANDING_FILE), ";")))
    return got.select("ord", "id", "source", "amount", "currency", "reference", "account_id")


PRJ2 = "SELECT c_custkey AS ord, 'order_' || CAST(c_custkey AS varchar) AS id, 'ledger' AS source, CAST(c_custkey % 900 * 100 + 40 AS bigint) AS amount, 'CZK' AS currency, 'YZ:' || CAST(c_custkey * 7 AS varchar) AS reference, CAST(c_custkey % 50 AS varchar) AS account_id FROM customer"


def src6_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = standing_orders.as_bank(standing_orders.read_transactions(spark, _written(run(spark, sf_dir, _TRANS_FILE), ";")))
    return got.select("id", F.col("date").cast("string").alias("date"), "amount", "reference", "account_id")


SRC6 = """
SELECT 'trans_' || CAST(event_id AS varchar) AS id, CASE WHEN event_id % 10 <> 0 THEN '1997-' || lpad(CAST(event_id % 12 + 1 AS varchar), 2, '0') || '-15' END AS date, CAST(event_id % 900 * 100 + 40 AS bigint) AS amount,
       'AB:' || CAST(event_id % 70 AS varchar) AS reference, CAST(user_id AS varchar) AS account_id FROM events WHERE event_id % 3 <> 0
"""


def src9_settlement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = run(spark, sf_dir, "SELECT 'setl_' || CAST(o_orderkey AS STRING) AS id, 'settlement' AS entity, o_orderkey * 3 AS amount, o_orderkey AS fees, CAST(2 AS BIGINT) AS tax, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'U' || CAST(o_orderkey AS STRING) END AS utr, 'processed' AS status, 1568176960 + o_orderkey * 1000 AS created_at FROM {orders}")
    return settlements_api.as_settlements(items).select("id", F.col("date").cast("string").alias("date"), "amount", "fees", "reference", F.try_element_at("raw", F.lit("status")).alias("status"))


SRC9 = "SELECT 'setl_' || CAST(o_orderkey AS varchar) AS id, CAST(CAST(make_timestamp((1568176960 + o_orderkey * 1000) * 1000000) AS date) AS varchar) AS date, o_orderkey * 3 AS amount, o_orderkey AS fees, CASE WHEN o_orderkey % 2 = 1 THEN 'U' || CAST(o_orderkey AS varchar) END AS reference, 'processed' AS status FROM orders"


def dt3_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days around the fixed holidays: whether business is done, the day after, and days since the order."""
    t = run(spark, sf_dir, "SELECT o_orderkey, CAST(DATE '2026-01-01' + CAST(o_orderkey % 365 AS INT) AS DATE) AS d, CAST(o_orderdate AS DATE) AS o FROM {orders}")
    return t.select("o_orderkey", cal.is_business_day(F.col("d"), HOLIDAYS).alias("open"), F.date_add("d", 1).cast("string").alias("next"), F.datediff("d", "o").alias("days"))


DT3 = f"""
SELECT o_orderkey, isodow(d) < 6 AND d NOT IN ({", ".join(f"DATE '{h}'" for h in HOLIDAYS)}) AS open, CAST(CAST(d + 1 AS date) AS varchar) AS next, CAST(d - o AS int) AS days
FROM (SELECT o_orderkey, CAST(DATE '2026-01-01' + CAST(o_orderkey % 365 AS int) AS date) AS d, CAST(o_orderdate AS date) AS o FROM orders) AS t
"""


def mth3_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three decimals, quotients cut toward zero, percents and numbers to minor units."""
    t = run(spark, sf_dir, "SELECT event_id, CAST(floor(value * 100) AS BIGINT) - 20000 AS a, event_id % 7 + 1 AS b, event_id % 1000 / 8000.0e0 AS x FROM {events}")
    return t.select("event_id", money.truncated(F.col("a"), F.col("b")).alias("q"), money.round3(F.col("x")).alias("r"), money.percent((F.col("event_id") % 1001) / 1000).alias("p"), money.number_to_minor(F.col("x") * 8).alias("m"))


MTH3 = """
SELECT event_id, CAST((CAST(floor(value * 100) AS bigint) - 20000) // (event_id % 7 + 1) AS bigint) AS q, floor(event_id % 1000 / 8000.0e0 * 1000 + 0.5) / 1000 AS r,
       CAST(event_id % 1001 // 10 AS varchar) || '.' || CAST(event_id % 1001 % 10 AS varchar) || '%' AS p, CAST(floor(event_id % 1000 / 8000.0e0 * 8 * 100 + 0.5) AS bigint) AS m FROM events
"""


def jn15_dated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by the rate of their own day; days divisible by three have none."""
    ledger = records(spark, sf_dir, LEDGER)
    days = ledger.select("date").distinct().where(F.datediff("date", F.lit("1970-01-01").cast("date")) % 3 != 0)
    rates = days.crossJoin(F.broadcast(fx.rate_table(spark))).withColumn("rate", F.col("rate") + F.dayofmonth("date"))  # a day and a currency each
    return fx.normalise(ledger, "INR", rates).select("id", "amount", "currency", "fx_unresolved")


_RATE = "CASE currency " + " ".join(f"WHEN '{c}' THEN {r}e0" for c, r in FX_TO_INR.items()) + " END"
JN15 = f"""
SELECT id, CASE WHEN r IS NULL THEN amount ELSE CAST(floor(amount * r + 0.5) AS bigint) END AS amount, CASE WHEN r IS NULL THEN currency ELSE 'INR' END AS currency, currency <> 'INR' AND r IS NULL AS fx_unresolved
FROM (SELECT *, CASE WHEN (date - DATE '1970-01-01') % 3 <> 0 THEN {_RATE} + day(date) END AS r FROM ({_L}) AS l) AS t
"""


def str10_controller_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in [*GENERIC_COPY, "unknown"]])
    t = run(spark, sf_dir, "SELECT event_id FROM {events}").withColumn("reason", F.get(keys, (F.col("event_id") % (len(GENERIC_COPY) + 1)).cast("int")))
    return t.select("event_id", classify.controller_copy(F.col("reason"), F.when(F.col("event_id") % 5 == 0, "own")).alias("copy"))


STR10 = f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'own' ELSE CASE event_id % {len(GENERIC_COPY) + 1} {" ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(GENERIC_COPY.values()))} END END AS copy FROM events
"""

# Candidates, matches and reasons by arithmetic on the order's key, all different in confidence within an invoice.
_SCORED = f"""
SELECT id AS ledger_id, 'pay_' || CAST(ord * 10 + k AS STRING) AS payment_id, ord AS l_ord, ord * 10 + k AS p_ord, amount AS p_amount, CAST((ord * 7 + k * 31) % 97 AS DOUBLE) / 100 AS confidence, 'e' || CAST(k AS STRING) AS e
FROM ({LEDGER}) AS l JOIN (SELECT CAST(n_nationkey AS BIGINT) AS k FROM {{nation}} WHERE n_nationkey < 6) AS n ON k < ord % 7
"""
_TAKEN = f"SELECT id AS ledger_id, 'pay_' || CAST(ord * 10 AS STRING) AS payment_id, CAST(ord % 30 AS DOUBLE) / 100 + 0.7 AS confidence FROM ({LEDGER}) AS l WHERE ord % 4 = 0"


def _synthetic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scored = run(spark, sf_dir, _SCORED).withColumn("evidence", F.array("e")).drop("e")
    matches = run(spark, sf_dir, _TAKEN).select("ledger_id", F.array("payment_id").alias("payment_ids"), F.lit("exact").alias("tier"), "confidence", F.array(F.lit("m")).alias("evidence"))
    return records(spark, sf_dir, LEDGER), scored, matches


def cls1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason of each open invoice, over candidates and matches by arithmetic; half of the references recur."""
    ledger, scored, matches = _synthetic(spark, sf_dir)
    half = (F.col("ord") / 2).cast("bigint").cast("string")
    ledger = ledger.withColumn("reference", F.when(F.col("ord") % 5 == 0, half)).withColumn("amount", F.col("ord") % 3).withColumn("fx_unresolved", F.col("currency") == "XYZ")
    return classify.ledger_exceptions(ledger, scored, matches, CFG).select("ledger_id", "reason", "detail", F.round("confidence", 6).alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


CLS1 = f"""
WITH l AS (SELECT id, ord, currency, ifsc, date, CASE WHEN ord % 5 = 0 THEN CAST(ord // 2 AS varchar) END AS ref, ord % 3 AS amt FROM ({_L}) AS x),
s AS ({duck(_SCORED)}), r AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY confidence DESC, p_ord) AS rn, count(*) OVER (PARTITION BY ledger_id) AS n FROM s),
b AS (SELECT ledger_id, max(n) AS n, max(CASE WHEN rn = 1 THEN confidence END) AS one, max(CASE WHEN rn = 1 THEN payment_id END) AS p1, max(CASE WHEN rn = 1 THEN e END) AS e1,
             max(CASE WHEN rn = 2 THEN confidence END) AS two, max(CASE WHEN rn = 2 THEN payment_id END) AS p2 FROM r GROUP BY ledger_id),
t AS (SELECT ref, amt, arg_min(id, ord) AS twin FROM l WHERE ord % 4 = 0 GROUP BY ref, amt),
o AS (SELECT l.*, b.*, t.twin, CASE WHEN currency = 'XYZ' THEN 'fx_unresolved' WHEN coalesce(ifsc, '') <> '' AND NOT regexp_full_match(upper(ifsc), '[A-Z]{{4}}0[A-Z0-9]{{6}}') THEN 'invalid_bank_details'
             WHEN t.twin IS NOT NULL THEN 'duplicate_suspected' WHEN n >= 2 AND one - two < 0.05e0 AND one > 0.5 THEN 'ambiguous_multiple_candidates' WHEN one > 0.3 THEN 'low_confidence' ELSE 'orphan' END AS reason
      FROM l LEFT JOIN b ON b.ledger_id = l.id LEFT JOIN t ON t.ref IS NOT DISTINCT FROM l.ref AND t.amt = l.amt WHERE l.ord % 4 <> 0)
SELECT id AS ledger_id, reason, CASE reason WHEN 'fx_unresolved' THEN 'no ' || currency || ' rate for ' || CAST(date AS varchar) WHEN 'invalid_bank_details' THEN 'branch code ' || ifsc || ' is malformed'
       WHEN 'duplicate_suspected' THEN 'same reference and amount as the matched ' || twin WHEN 'ambiguous_multiple_candidates' THEN p1 || ' and ' || p2 || ' lead ' || CAST(n AS varchar) || ' candidates almost level'
       WHEN 'low_confidence' THEN p1 || ' leads with ' || CAST(floor(one * 1000 + 0.5) / 1000 AS varchar) || ' of the 0.72 needed' ELSE 'no payment comes near' END AS detail,
       round(coalesce(one, 0.0), 6) AS confidence, coalesce(e1, 'nothing scored over the floor') AS evidence FROM o
"""


def cls3_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three alternatives of each invoice with why they were not taken."""
    ledger, scored, matches = _synthetic(spark, sf_dir)
    exceptions = ledger.where("ord % 4 <> 0").select(F.col("id").alias("ledger_id"), F.lit(0.0).alias("confidence"), F.array(F.lit("x")).alias("evidence"), F.lit("low_confidence").alias("reason"))
    got = classify.decisions(ledger, scored, matches, exceptions, CFG)
    rows = got.select("subject_id", "outcome", F.array_join("tools_called", ",").alias("tools"), F.posexplode("alternatives").alias("place", "a"))
    return rows.select("subject_id", "outcome", "tools", "place", F.array_join("a.payment_ids", ",").alias("payment_id"), "a.score", "a.rejected_because")


CLS3 = f"""
WITH s AS ({duck(_SCORED)}), m AS ({duck(_TAKEN)}),
r AS (SELECT s.ledger_id, s.payment_id, s.confidence AS c, m.confidence AS w, row_number() OVER (PARTITION BY s.ledger_id ORDER BY s.confidence DESC, s.p_ord) - 1 AS place
      FROM s LEFT JOIN m ON m.ledger_id = s.ledger_id WHERE s.payment_id IS DISTINCT FROM m.payment_id)
SELECT r.ledger_id AS subject_id, CASE WHEN w IS NULL THEN 'exception' ELSE 'matched' END AS outcome, CASE WHEN l.currency <> 'INR' THEN 'fx.convert,' ELSE '' END || 'calendar.isBusinessDay' AS tools, CAST(place AS int) AS place, r.payment_id, floor(c * 1000 + 0.5) / 1000 AS score,
       CASE WHEN w IS NOT NULL THEN 'scored ' || CAST(floor(c * 1000 + 0.5) / 1000 AS varchar) || ' against the winner''s ' || CAST(floor(w * 1000 + 0.5) / 1000 AS varchar)
            WHEN c < 0.72 THEN 'at ' || CAST(floor(c * 1000 + 0.5) / 1000 AS varchar) || ' it is below accept threshold 0.72'
            ELSE 'good enough at ' || CAST(floor(c * 1000 + 0.5) / 1000 AS varchar) || ', but not used because the invoice is one of low confidence' END AS rejected_because
FROM r JOIN ({_L}) AS l ON l.id = r.ledger_id WHERE place < 3
"""


def top3_hardest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty open invoices with the best candidates (the agent's cap), each with its best five in order."""
    ledger, scored, matches = _synthetic(spark, sf_dir)
    top = adjudicate.hardest(ledger, scored, matches, CFG.max_agent_records)
    return top.select("id", "best", F.array_join(F.slice(F.transform("options", lambda o: o["payment_id"]), 1, adjudicate.SHOWN), ",").alias("shown"))


TOP3 = f"""
WITH s AS ({duck(_SCORED)}), b AS (SELECT l.id, l.ord, max(confidence) AS best, list(payment_id ORDER BY confidence DESC, p_ord) AS p
FROM ({_L}) AS l LEFT JOIN s ON s.ledger_id = l.id WHERE l.ord % 4 <> 0 GROUP BY l.id, l.ord)
SELECT id, best, array_to_string(p[1:5], ',') AS shown FROM b ORDER BY best DESC NULLS LAST, ord LIMIT 20
"""


def jn14_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has each payment, over matches of one or two payments."""
    return classify.claims(_matched(spark, sf_dir)[2])


JN14 = f"SELECT p.id AS payment_id, l.id AS claimed_by FROM ({_P}) AS p JOIN ({_L}) AS l ON p.reference = l.reference"


def set5_known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id that a run speaks of, once."""
    _, _, m, x = _matched(spark, sf_dir)
    spoken = SimpleNamespace(matches=m, exceptions=x.withColumn("bank_id", F.lit(None).cast("string")), decisions=m.select(F.col("ledger_id").alias("subject_id")))
    return qa.known_ids(spoken)


SET5 = f"SELECT id FROM ({_L}) AS l UNION SELECT p.id FROM ({_P}) AS p JOIN ({_L}) AS l ON p.reference = l.reference"


def set3_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that an invoice and the payments of its reference have in common."""
    l = candidates.text_features(records(spark, sf_dir, LEDGER)).select("reference", F.col("id").alias("ledger_id"), F.col("refs").alias("a"))
    p = candidates.text_features(records(spark, sf_dir, PAYMENTS)).select("reference", F.col("id").alias("payment_id"), F.col("refs").alias("b"))
    return l.join(p, "reference").select("ledger_id", "payment_id", F.array_join(F.array_intersect("a", "b"), ",").alias("shared"))


SET3 = f"SELECT l.id AS ledger_id, p.id AS payment_id, replace(l.reference, '-', '') AS shared FROM ({_L}) AS l JOIN ({_P}) AS p ON p.reference = l.reference"


def jn1_match_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their records as a dashboard shows them."""
    ledger, payments, m, _ = _matched(spark, sf_dir)
    shown = sinks.match_payload(SimpleNamespace(matches=m, ledger=ledger, payments=payments), 0.5)
    return shown.select("ledger_id", F.col("ledger.counterparty").alias("counterparty"), F.col("ledger.currency").alias("currency"), F.col("ledger.date").cast("string").alias("date"), F.array_join("payments.id", ",").alias("payments"), "auto_cleared")


JN1 = f"""
SELECT l.id AS ledger_id, l.counterparty, l.currency, CAST(l.date AS varchar) AS date, string_agg(p.id, ',' ORDER BY p.id) AS payments, CAST(l.ord % 50 AS double) / 50 >= 0.5 AS auto_cleared
FROM ({_L}) AS l JOIN ({_P}) AS p ON p.reference = l.reference GROUP BY l.id, l.ord, l.counterparty, l.currency, l.date
"""


def agg21_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, payments, m, _ = _matched(spark, sf_dir)
    return forecast.collection_lag(ledger, payments, m)


AGG21 = f"SELECT CAST(median(datediff('day', l.date, p.date)) AS double) AS lag_days, count(*) AS samples FROM ({_L}) AS l JOIN ({_P}) AS p ON p.reference = l.reference"


def agg11_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every class, absent ones too."""
    from .evaluation_queries import TRUTH

    return class_counts(run(spark, sf_dir, TRUTH).where("class <> 'typo_reference'").select("class"))


def _agg11() -> str:
    from .evaluation_queries import TRUTH
    from ..functions.tables import CLASSES

    return f"SELECT c.class, count(t.class) AS n FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CLASSES)}) AS c(class) LEFT JOIN (SELECT * FROM ({duck(TRUTH)}) AS x WHERE class <> 'typo_reference') AS t ON t.class = c.class GROUP BY c.class"


AGG11 = _agg11()


def ui2_tier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tier's share of the invoices."""
    ledger, _, m, x = _matched(spark, sf_dir)
    stats = ledger.agg(F.count(F.lit(1)).alias("ledger_rows")).withColumn("records", F.col("ledger_rows")).withColumn("cost_usd", F.lit(0.0))
    return sinks.dashboard(stats, sinks.tier_counts(m, x))[1].select("tier", F.round("share", 9).alias("share"))


UI2 = f"""
WITH l AS ({_L}), t AS (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM ({_P}) AS p WHERE p.reference = l.reference) THEN 'unresolved' WHEN ord % 4 = 0 THEN 'exact' ELSE 'fuzzy' END AS tier FROM l)
SELECT tier, round(count(*) / (SELECT count(*) FROM l), 9) AS share FROM t GROUP BY tier
"""


def ui1_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost for 1,000 records of runs by event type; one has no records."""
    t = run(spark, sf_dir, "SELECT event_type, count(*) AS records FROM {events} GROUP BY event_type UNION ALL SELECT 'none', CAST(0 AS BIGINT)")
    stats = t.withColumn("cost_usd", F.col("records") * 0.25).withColumn("ledger_rows", F.col("records"))
    none = t.select(F.lit("x").alias("tier"), F.lit(0).alias("n")).limit(0)
    return sinks.dashboard(stats, none)[0].groupBy("cost_per_1000").agg(F.count(F.lit(1)).alias("n"))


UI1 = "SELECT cost_per_1000, count(*) AS n FROM (SELECT event_type, 250.0::double AS cost_per_1000 FROM events GROUP BY event_type UNION ALL SELECT 'none', 0.0::double) AS t GROUP BY cost_per_1000"


def ui6_band_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.band_width(fc1_forecast(spark, sf_dir)).select("week_index", "band_width")


UI6 = f"SELECT week_index, CAST(band_high - band_low AS bigint) AS band_width FROM ({FC1}) AS f"


def ui7_last_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several decisions about a user, the last one."""
    t = run(spark, sf_dir, "SELECT CAST(user_id AS STRING) AS subject_id, event_id AS seq, event_type AS outcome FROM {events}")
    return sinks.last_decisions(t, "seq").select("subject_id", "outcome")


UI7 = "SELECT CAST(user_id AS varchar) AS subject_id, arg_max(event_type, event_id) AS outcome FROM events GROUP BY user_id"

_ALL = {
    "val_csv_errors": VAL, "src2_csv_upload": SRC2, "src3_two_way_sides": SRC3, "src6_transactions": SRC6, "src9_settlement_items": SRC9, "src10_submission": SRC10, "prj2_orders_as_ledger": PRJ2,
    "jn17_allocations": JN17, "dt3_business_days": DT3, "mth3_divisions": MTH3, "jn15_dated_rates": JN15, "str10_controller_copy": STR10, "cls1_reasons": CLS1, "cls3_alternatives": CLS3, "top3_hardest": TOP3,
    "jn14_claims": JN14, "set5_known_ids": SET5, "set3_shared_ids": SET3, "jn1_match_payload": JN1, "agg21_lag": AGG21, "agg11_class_counts": AGG11, "ui1_cost": UI1, "ui2_tier_shares": UI2, "ui6_band_width": UI6, "ui7_last_decision": UI7,
}
QUERIES = {name: globals()[name] for name in _ALL}
ORACLES = dict(_ALL)
