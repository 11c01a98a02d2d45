"""Queries of scoring and statistics, and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluation import scores
from ..functions.tables import CLASSES, THRESHOLDS
from ..operators.reconcile import Reconciliation, matches_of, reconcile
from .relational_queries import CONFIG
from .views import LEDGER, PAYMENTS, duck, finance_batch, run

_CLASS = f"CASE {' '.join(f'WHEN ord % 20 = {i} THEN {chr(39)}{c}{chr(39)}' for i, c in enumerate(CLASSES))} WHEN ord % 20 = 17 THEN 'true_orphan' ELSE 'clean' END"
# Truth, claims and refusals by arithmetic on the order's key; every ninth claim is wrong.
TRUTH = f"""
SELECT id AS ledger_id, {_CLASS} AS class, CASE WHEN ord % 20 = 17 THEN '' WHEN ord % 20 = 16 AND currency = 'INR' THEN 'pay_' || CAST(ord AS STRING) || ',pay_' || CAST(ord AS STRING) || '_b'
       ELSE 'pay_' || CAST(ord AS STRING) END AS ids FROM ({LEDGER}) AS l
"""
CLAIMS = f"""
SELECT id AS ledger_id, CASE WHEN ord % 9 = 0 THEN 'pay_x' WHEN ord % 20 = 16 AND currency = 'INR' THEN 'pay_' || CAST(ord AS STRING) || '_b,pay_' || CAST(ord AS STRING)
       ELSE 'pay_' || CAST(ord AS STRING) END AS ids, CAST(ord % 101 AS DOUBLE) / 100 AS confidence FROM ({LEDGER}) AS l WHERE ord % 6 <> 0
"""
REFUSED = f"SELECT id AS ledger_id FROM ({LEDGER}) AS l WHERE ord % 6 = 0"


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumn("payment_ids", F.filter(F.split("ids", ","), lambda x: x != "")).drop("ids")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.judged(_ids(run(spark, sf_dir, CLAIMS)), run(spark, sf_dir, REFUSED), _ids(run(spark, sf_dir, TRUTH)))


_J = f"""
j AS MATERIALIZED (SELECT t.ledger_id, t.class, t.ids <> '' AS matchable, c.confidence, r.ledger_id IS NOT NULL AS declined,
    t.ids <> '' AND coalesce(list_sort(string_split(c.ids, ',')) = list_sort(string_split(t.ids, ',')), false) AS hit
  FROM ({duck(TRUTH)}) AS t LEFT JOIN ({duck(CLAIMS)}) AS c ON c.ledger_id = t.ledger_id LEFT JOIN ({duck(REFUSED)}) AS r ON r.ledger_id = t.ledger_id),
p AS (SELECT CAST(threshold AS double) AS threshold, j.*, coalesce(confidence >= threshold, false) AS claimed FROM j CROSS JOIN (VALUES {", ".join(f"({t})" for t in THRESHOLDS)}) AS v(threshold)),
s AS (SELECT threshold, count(*) FILTER (WHERE claimed) AS claimed, count(*) FILTER (WHERE claimed AND hit) AS correct, count(*) FILTER (WHERE claimed AND NOT hit) AS wrong,
    count(*) FILTER (WHERE matchable) AS m, count(*) AS n, count(*) FILTER (WHERE NOT claimed AND (declined OR confidence IS NOT NULL) AND matchable) AS false_exceptions,
    count(*) FILTER (WHERE NOT claimed AND (declined OR confidence IS NOT NULL) AND NOT matchable) AS correctly_declined FROM p GROUP BY threshold),
q AS (SELECT *, CASE WHEN claimed = 0 THEN 1.0 ELSE correct / claimed END AS pr, correct / m AS re FROM s),
curve AS (SELECT threshold, claimed, correct, wrong, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1,
    round(claimed / n, 9) AS auto_clear, false_exceptions, correctly_declined FROM q)"""
_ROUNDED = ("precision", "recall", "f1", "auto_clear")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in _ROUNDED else F.col(c) for c in df.columns])


def agg7_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.curve(_judged(spark, sf_dir)))


AGG7 = f"WITH {_J} SELECT * FROM curve"


def agg6_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.curve(_judged(spark, sf_dir), [0.72]))


AGG6 = AGG7.replace(", ".join(f"({t})" for t in THRESHOLDS), "(0.72)")


def agg7_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.operating_point(scores.curve(_judged(spark, sf_dir)), 0.8))


AGG7O = f"""
WITH {_J} SELECT *, NOT EXISTS (SELECT 1 FROM curve WHERE precision >= 0.8 AND claimed > 0) AS target_missed FROM curve
ORDER BY (precision >= 0.8 AND claimed > 0) DESC, CASE WHEN precision >= 0.8 AND claimed > 0 THEN auto_clear ELSE precision END DESC, threshold LIMIT 1
"""


def agg13_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.threshold_for(_rounded(scores.curve(_judged(spark, sf_dir))), [0.5, 0.8, 0.85, 0.999])


AGG13 = f"""
WITH {_J} SELECT CAST(target AS double) AS target, min(threshold) FILTER (WHERE precision >= target AND claimed > 0) AS threshold
FROM curve CROSS JOIN (VALUES (0.5), (0.8), (0.85), (0.999)) AS v(target) GROUP BY target
"""


def agg8_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores.by_class(_judged(spark, sf_dir), 0.3)
    return out.select("class", "total", "correct", F.round("accuracy", 9).alias("accuracy"))


AGG8 = f"""
WITH {_J} SELECT class, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 9) AS accuracy
FROM (SELECT class, CASE WHEN matchable THEN coalesce(confidence >= 0.3, false) AND hit ELSE NOT coalesce(confidence >= 0.3, false) AND declined END AS ok FROM j) AS k GROUP BY class
"""


def agg10_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _ids(run(spark, sf_dir, TRUTH))
    share = scores.ceiling(truth).select(F.lit("ceiling").alias("name"), F.round("ceiling", 9).alias("value"))
    return share.unionByName(scores.class_counts(truth).select(F.col("class").alias("name"), F.col("n").cast("double").alias("value")))


AGG10 = f"""
WITH t AS MATERIALIZED ({duck(TRUTH)}) SELECT 'ceiling' AS name, round(avg(CASE WHEN ids <> '' THEN 1.0 ELSE 0.0 END), 9) AS value FROM t
UNION ALL SELECT c, CAST((SELECT count(*) FROM t WHERE class = c) AS double) FROM (VALUES {", ".join(f"('{c}')" for c in CLASSES)}) AS v(c)
"""


def agg12_alloc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way results by allocation key: the payment's key is its invoice's number, some keys are absent."""
    b = run(spark, sf_dir, f"SELECT id AS b_id, CASE WHEN ord % 8 = 0 THEN NULL ELSE 'A' || CAST(floor((ord + ord % 6) / 2) AS STRING) END AS a_id, CAST(floor(ord / 2) AS BIGINT) AS k FROM ({PAYMENTS}) AS p")
    a = run(spark, sf_dir, f"SELECT 'A' || CAST(ord AS STRING) AS a_id, CASE WHEN ord % 10 <> 3 THEN ord END AS k FROM ({LEDGER}) AS l")
    truth = b.select("b_id", F.col("k").cast("string").alias("key"))
    return _rounded4(scores.score_allocations(b.select("b_id", "a_id"), truth, a.select("a_id", F.col("k").cast("string").alias("key"))))


def _rounded4(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


AGG12 = f"""
WITH b AS (SELECT id AS b_id, CASE WHEN ord % 8 = 0 THEN NULL ELSE 'A' || CAST(CAST(floor((ord + ord % 6) / 2) AS bigint) AS varchar) END AS a_id, CAST(floor(ord / 2) AS bigint) AS k FROM ({duck(PAYMENTS)}) AS p),
a AS (SELECT 'A' || CAST(ord AS varchar) AS a_id, CASE WHEN ord % 10 <> 3 THEN ord END AS own FROM ({duck(LEDGER)}) AS l),
r AS (SELECT b.a_id IS NOT NULL AS made, k IN (SELECT own FROM a WHERE own IS NOT NULL) AS can, b.a_id IS NOT NULL AND coalesce(own = k, false) AS hit FROM b LEFT JOIN a ON a.a_id = b.a_id)
SELECT count(*) AS scored, count(*) FILTER (WHERE hit) AS correct, count(*) FILTER (WHERE made AND NOT hit) AS wrong, count(*) FILTER (WHERE NOT made AND can) AS missed,
       count(*) FILTER (WHERE NOT made AND NOT can) AS correctly_declined, round(count(*) FILTER (WHERE hit) / count(*) FILTER (WHERE made), 9) AS precision,
       round(count(*) FILTER (WHERE hit) / count(*) FILTER (WHERE can), 9) AS recall, round(count(*) FILTER (WHERE can) / count(*), 9) AS ceiling FROM r
"""

# Runs of an ablation: recall by user as seed and event type as rung.
RUNS = """
SELECT CAST(user_id AS INT) AS seed, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INT) AS rung,
       event_type AS label, floor(avg(value)) / 1000 AS recall, floor(max(value)) / 1000 AS precision FROM {events} GROUP BY user_id, event_type
"""


def agg14_ablation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded4(scores.ablation_stats(run(spark, sf_dir, RUNS)))


AGG14 = f"""
WITH g AS (SELECT *, coalesce(recall - lag(recall) OVER (PARTITION BY seed ORDER BY rung), 0.0) AS gain FROM ({duck(RUNS)}) AS r),
s AS (SELECT rung, label, count(*) AS runs, avg(recall) AS a, stddev_pop(recall) AS sd, min(recall) AS lo, max(recall) AS hi, avg(precision) AS p, avg(gain) AS g FROM g GROUP BY rung, label)
SELECT rung, label, runs, round(a, 9) AS recall_mean, round(sd, 9) AS recall_sd, round(lo, 9) AS recall_min, round(hi, 9) AS recall_max, round(p, 9) AS precision_mean, round(g, 9) AS gain_mean,
       rung > 0 AND abs(g) < sd AS gain_within_noise FROM s
"""


def win2_rung_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    gain = F.col("recall") - F.lag("recall").over(W.partitionBy("seed").orderBy("rung"))
    return run(spark, sf_dir, RUNS).select("seed", "rung", F.round(F.coalesce(gain, F.lit(0.0)), 9).alias("gain"))


WIN2 = f"SELECT seed, rung, round(coalesce(recall - lag(recall) OVER (PARTITION BY seed ORDER BY rung), 0.0), 9) AS gain FROM ({duck(RUNS)}) AS r"


def agg15_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.percentiles(run(spark, sf_dir, "SELECT user_id, value FROM {events}"), "user_id", "value", (50, 95, 100))


def agg15_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a few large groups, whose ranks are found by narrowing ranges of values."""
    return scores.percentiles(run(spark, sf_dir, "SELECT event_type, value FROM {events}"), "event_type", "value", (50, 95, 100), ranked=500)


AGG15T = """
SELECT event_type, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS bigint)) + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS bigint)) + 1] AS p95, v[len(v)] AS p100
FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) AS e
"""


AGG15 = """
SELECT user_id, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS bigint)) + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS bigint)) + 1] AS p95, v[len(v)] AS p100
FROM (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id) AS e
"""


def agg16_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = run(spark, sf_dir, "SELECT user_id, CASE WHEN event_type = 'purchase' THEN floor(value) END AS v FROM {events}")
    return e.groupBy("user_id").agg(F.coalesce(F.median("v").cast("double"), F.lit(2.0)).alias("median"))


AGG16 = "SELECT user_id, coalesce(CAST(median(CASE WHEN event_type = 'purchase' THEN floor(value) END) AS double), 2.0) AS median FROM events GROUP BY user_id"


def agg19_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.adjudicate import PRICES

    e = run(spark, sf_dir, "SELECT event_type, CAST(floor(value) AS BIGINT) AS p, CAST(event_id % 50 AS BIGINT) AS c FROM {events}").groupBy("event_type").agg(F.sum("p").alias("tokens_in"), F.sum("c").alias("tokens_out"))
    return e.select("*", F.round(F.col("tokens_in") / 1e6 * PRICES[0] + F.col("tokens_out") / 1e6 * PRICES[1], 9).alias("cost_usd"))


AGG19 = """
SELECT event_type, p AS tokens_in, c AS tokens_out, round(p / 1e6 * 0.15 + c / 1e6 * 0.6, 9) AS cost_usd
FROM (SELECT event_type, CAST(sum(CAST(floor(value) AS bigint)) AS bigint) AS p, CAST(sum(event_id % 50) AS bigint) AS c FROM events GROUP BY event_type) AS e
"""


def _run(spark: SparkSession, sf_dir: str) -> Reconciliation:
    return reconcile(finance_batch(spark, sf_dir), CONFIG)


def pipe_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of a run over all orders and payments. String scores have no SQL."""
    return matches_of(finance_batch(spark, sf_dir)).select("ledger_id", F.array_join("payment_ids", ",").alias("payment_ids"), "tier", F.round("confidence", 6).alias("confidence"))


def cls1_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).exceptions.select("ledger_id", "bank_id", "reason", "detail")


def cls4_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir).decisions
    return found.select("subject_id", "tier", "outcome", F.round("confidence", 6).alias("confidence"), F.array_join("tools_called", ",").alias("tools"), F.to_json("alternatives").alias("alternatives"))


def jn10_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way matching of all payments; the accepted edges' components are solved optimally or greedily."""
    from ..operators.fx import normalise, rate_table
    from ..operators.tiers import two_way
    from .views import records

    ledger = normalise(records(spark, sf_dir, LEDGER), "INR", rate_table(spark))
    return two_way(ledger, records(spark, sf_dir, PAYMENTS), CONFIG)[0].select("payment_id", "ledger_id", "tier", F.round("confidence", 6).alias("confidence"))


_ALL = {
    "agg6_score": AGG6, "agg7_sweep": AGG7, "agg7_operating_point": AGG7O, "agg8_by_class": AGG8, "agg10_ceiling": AGG10, "agg12_alloc_score": AGG12, "agg13_targets": AGG13,
    "agg14_ablation_stats": AGG14, "agg15_percentile": AGG15, "agg15_by_type": AGG15T, "agg16_median": AGG16, "agg19_costs": AGG19, "win2_rung_gain": WIN2, "pipe_matches": None, "cls1_exceptions": None,
    "cls4_decisions": None, "jn10_two_way": None,
}
QUERIES = {name: globals()[name] for name in _ALL}
ORACLES = {name: sql for name, sql in _ALL.items() if sql}
