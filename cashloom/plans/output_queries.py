"""Queries of sources' parsers, payloads and small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import format_minor
from ..operators.classify import claims
from ..sources.csv_batch import split_line
from ..sources.standing_orders import short_date
from .evaluation_queries import CLAIMS, TRUTH, _ids
from .views import LEDGER, duck, run

_L = duck(LEDGER)


def prj8_auto_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims at or above the accept threshold, with whether a stricter one clears them."""
    c = run(spark, sf_dir, CLAIMS).where(F.col("confidence") >= 0.72)
    return c.select("ledger_id", "confidence", (F.col("confidence") >= 0.9).alias("auto_cleared"))


PRJ8 = f"SELECT ledger_id, confidence, confidence >= 0.9e0 AS auto_cleared FROM ({duck(CLAIMS)}) AS c WHERE confidence >= 0.72e0"


def agg9_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..evaluation.scores import same_payments

    t, c = _ids(run(spark, sf_dir, TRUTH)), _ids(run(spark, sf_dir, CLAIMS)).select("ledger_id", F.col("payment_ids").alias("claimed"))
    return t.join(c, "ledger_id").select("ledger_id", same_payments(F.col("claimed"), F.col("payment_ids")).alias("same"))


AGG9 = f"""
SELECT t.ledger_id, t.ids <> '' AND list_sort(string_split(c.ids, ',')) = list_sort(string_split(t.ids, ',')) AS same
FROM ({duck(TRUTH)}) AS t JOIN ({duck(CLAIMS)}) AS c ON c.ledger_id = t.ledger_id
"""


def jn14_claimed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner of each payment, of those that claim it."""
    c = run(spark, sf_dir, CLAIMS).withColumn("payment_ids", F.split("ids", ","))
    return claims(c)


JN14 = f"SELECT payment_id, max(ledger_id) AS claimed_by FROM (SELECT ledger_id, unnest(string_split(ids, ',')) AS payment_id FROM ({duck(CLAIMS)}) AS c) AS u GROUP BY payment_id"


def snk1_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as a dashboard shows them: the invoice's amount in its currency's grouping."""
    c, l = run(spark, sf_dir, CLAIMS), run(spark, sf_dir, LEDGER)
    shown = l.select(F.col("id").alias("ledger_id"), "counterparty", format_minor(F.col("amount"), F.lit("USD")).alias("amount"), F.col("date").cast("string").alias("date"))
    return c.join(shown, "ledger_id", "left").select("ledger_id", "counterparty", "amount", "date", "confidence")


SNK1 = f"""
SELECT c.ledger_id, counterparty, format('{{:,}}', amount // 100) || '.' || lpad(CAST(amount % 100 AS varchar), 2, '0') AS amount, CAST(date AS varchar) AS date, confidence
FROM ({duck(CLAIMS)}) AS c LEFT JOIN ({_L}) AS l ON l.id = c.ledger_id
"""


def src1_csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quoted commas and doubled quotes, cut into trimmed fields."""
    lines = run(spark, sf_dir, LEDGER).select(
        "ord", F.concat(F.col("id"), F.lit(' , "'), F.col("counterparty"), F.lit(', ""Ltd"""  ,,'), F.col("amount").cast("string"), F.lit(" ")).alias("line")
    )
    f = split_line(F.col("line"), 5)
    return lines.select("ord", *[F.get(f, F.lit(i)).alias(f"f{i}") for i in range(5)])


SRC1 = f"""SELECT ord, id AS f0, counterparty || ', "Ltd"' AS f1, '' AS f2, CAST(amount AS varchar) AS f3, '' AS f4 FROM ({_L}) AS l"""


def src7_short_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = run(spark, sf_dir, LEDGER).select("ord", F.date_format("date", "yyMMdd").alias("t"))
    return l.select("ord", short_date(F.col("t")).cast("string").alias("date"))


SRC7 = f"SELECT ord, CAST(try_strptime('19' || strftime(date, '%y%m%d'), '%Y%m%d')::DATE AS varchar) AS date FROM ({_L}) AS l"


def arr1_json_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a map; text that is no JSON gives null instead of an error."""
    e = run(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 3) ELSE props END AS p FROM {events}")
    return e.select("event_id", F.size(F.map_keys(F.from_json("p", "map<string,string>"))).alias("n")).where("n > 0")


ARR1 = """
SELECT event_id, CAST(len(json_keys(p)) AS int) AS n FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 3) ELSE props END AS p FROM events) AS e
WHERE json_valid(p) AND len(json_keys(p)) > 0
"""

_ALL = {
    "prj8_auto_cleared": PRJ8, "agg9_set_equality": AGG9, "jn14_claimed_by": JN14, "snk1_payload": SNK1, "src1_csv_line": SRC1, "src7_short_date": SRC7, "arr1_json_args": ARR1,
}
QUERIES = {name: globals()[name] for name in _ALL}
ORACLES = dict(_ALL)
