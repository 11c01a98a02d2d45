"""Queries of scalar operators: money, text, calendar, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import money, text
from ..functions.similarity import jaro_winkler, token_set_ratio
from ..functions.tables import BRANCHES, HOLIDAYS
from .views import LEDGER, duck, run

_L = duck(LEDGER)
_HOLIDAY_SQL = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
# Memos made of the ledger's columns, with all kinds of identifiers.
MEMOS = f"""
SELECT ord, 'neft-' || CASE WHEN ord % 3 = 0 THEN 'HDFC0' || lpad(CAST(ord % 1000000 AS STRING), 6, '0') ELSE 'x' END || '-' || counterparty
       || CASE WHEN ord % 4 = 0 THEN '-N' || lpad(CAST(ord AS STRING), 14, '0') ELSE '' END || '/' || memo || '_Payment' AS memo FROM ({LEDGER}) AS l
"""


def str1_utrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("memo")
    return run(spark, sf_dir, MEMOS).select(
        "ord", F.array_join(text.utrs(m), ",").alias("utrs"), F.array_join(text.ifscs(m), ",").alias("ifscs"), F.array_join(text.invoice_refs(m), ",").alias("refs")
    )


STR1_UTRS = rf"""
SELECT ord, array_to_string(regexp_extract_all(upper(memo), '\b[A-Z]\d{{12,20}}\b'), ',') AS utrs,
       array_to_string(regexp_extract_all(upper(memo), '\b[A-Z]{{4}}0[A-Z0-9]{{6}}\b'), ',') AS ifscs,
       array_to_string(list_transform(regexp_extract_all(upper(memo), '\bINV[-_\s]?\d{{2,6}}\b'), lambda x: regexp_replace(x, '[-_\s]', '', 'g')), ',') AS refs
FROM ({duck(MEMOS)}) AS m
"""


def str1_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MEMOS).select("ord", text.residual(F.col("memo")).alias("residual"))


# Here a memo has at most one UTR and one IFSC, so two replacements do.
STR1_RESIDUAL = rf"""
WITH m AS (SELECT ord, upper(memo) AS u, regexp_extract(upper(memo), '\b[A-Z]\d{{12,20}}\b') AS a, regexp_extract(upper(memo), '\b[A-Z]{{4}}0[A-Z0-9]{{6}}\b') AS b FROM ({duck(MEMOS)}) AS m),
t AS (SELECT ord, CASE WHEN a <> '' THEN replace(u, a, ' ') ELSE u END AS u, b FROM m),
r AS (SELECT ord, CASE WHEN b <> '' THEN replace(u, b, ' ') ELSE u END AS u FROM t)
SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '\bINV[-_\s]?\d{{2,6}}\b', ' ', 'g'),
       '\b(NEFT|IMPS|RTGS|UPI|PAYMENT|SETTLEMENT|CREDIT)\b', ' ', 'g'), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g')) AS residual FROM r
"""


def str2_normalize_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lower("id"), F.lit("_ x-"), F.col("counterparty"))
    return run(spark, sf_dir, LEDGER).select("ord", text.normalize_ref(raw).alias("ref"))


STR2 = rf"SELECT ord, regexp_replace(upper(lower(id) || '_ x-' || counterparty), '[-_\s]', '', 'g') AS ref FROM ({_L}) AS l"


def str5_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts held against their type."""
    p = run(spark, sf_dir, "SELECT p_partkey, p_name, p_type FROM {part}")
    a, b = F.lower("p_name"), F.lower("p_type")
    return p.select("p_partkey", F.round(jaro_winkler(a, b), 6).alias("jaro_winkler"), token_set_ratio(F.col("p_name"), F.col("p_type")).alias("token_set"))


_LOW = "greatest(1, i - reach)"
_AT = f"instr(substr(acc.l, {_LOW}, greatest(0, least(len(b), i + reach) - {_LOW} + 1)), substr(a, i, 1))"
_SPOT = f"({_LOW} + {_AT} - 1)"
# The subsequence table is filled row by row here: a cell is the greatest of what stands above, and to the left.
STR5 = f"""
WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, greatest(0, greatest(len(p_name), len(p_type)) // 2 - 1) AS reach FROM part),
m AS (SELECT *, list_reduce(range(1, len(a) + 1), lambda acc, i: CASE WHEN {_AT} = 0 THEN acc ELSE {{'l': substr(acc.l, 1, {_SPOT} - 1) || chr(1) || substr(acc.l, {_SPOT} + 1), 'f': acc.f || substr(a, i, 1)}} END, {{'l': b, 'f': ''}}) AS r FROM p),
n AS (SELECT *, r.f AS f, array_to_string(list_filter(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN substr(r.l, i, 1) = chr(1) THEN substr(b, i, 1) END), lambda x: x IS NOT NULL), '') AS g FROM m),
j AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN len(f) = 0 THEN 0.0 ELSE (len(f) / len(a) + len(f) / len(b) + (len(f) - len(list_filter(range(1, len(f) + 1), lambda i: substr(f, i, 1) <> substr(g, i, 1))) / 2) / len(f)) / 3 END AS jaro,
             len(list_filter([1, 2, 3, 4], lambda k: k <= len(a) AND k <= len(b) AND left(a, k) = left(b, k))) AS same FROM n),
t AS (SELECT p_partkey, list_sort(list_distinct(list_filter(str_split_regex(a, '\\s+'), lambda x: x <> ''))) AS ta, list_sort(list_distinct(list_filter(str_split_regex(b, '\\s+'), lambda x: x <> ''))) AS tb FROM p),
s AS (SELECT p_partkey, array_to_string(list_filter(ta, lambda x: list_contains(tb, x)), ' ') AS c, trim(array_to_string(list_filter(ta, lambda x: list_contains(tb, x)), ' ') || ' ' || array_to_string(list_filter(ta, lambda x: NOT list_contains(tb, x)), ' ')) AS x,
             trim(array_to_string(list_filter(ta, lambda x: list_contains(tb, x)), ' ') || ' ' || array_to_string(list_filter(tb, lambda x: NOT list_contains(ta, x)), ' ')) AS y FROM t),
w AS (SELECT *, list_max(list_reduce(range(1, len(x) + 1), lambda acc, i: list_transform(range(0, len(y) + 1), lambda k: list_max(list_transform(range(0, k + 1), lambda h: greatest(acc[h + 1], CASE WHEN h > 0 AND substr(y, h, 1) = substr(x, i, 1) THEN acc[h] + 1 ELSE 0 END)))), list_transform(range(0, len(y) + 1), lambda k: CAST(0 AS bigint)))) AS common FROM s)
SELECT j.p_partkey, CAST(round(CASE WHEN jaro = 0 THEN 0.0 ELSE jaro + same * 0.1e0 * (1 - jaro) END, 6) AS double) AS jaro_winkler,
       greatest(CASE WHEN c = '' THEN 0 ELSE floor(200 * len(c) / (len(c) + len(x)) + 0.5) END, CASE WHEN c = '' THEN 0 ELSE floor(200 * len(c) / (len(c) + len(y)) + 0.5) END, floor(200 * common / (len(x) + len(y)) + 0.5)) / 100 AS token_set
FROM j JOIN w ON w.p_partkey = j.p_partkey
"""


def str7_format_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = run(spark, sf_dir, LEDGER).withColumn("a", F.when(F.col("ord") % 3 == 0, -F.col("amount") * 1000).otherwise(F.col("amount")))
    return l.select("ord", money.format_minor(F.col("a"), F.lit("INR")).alias("inr"), money.format_minor(F.col("a"), F.lit("USD")).alias("usd"))


STR7 = rf"""
WITH a AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN -amount * 1000 ELSE amount END AS a FROM ({_L}) AS l),
w AS (SELECT ord, CASE WHEN a < 0 THEN '-' ELSE '' END AS s, CAST(abs(a) // 100 AS varchar) AS w, lpad(CAST(abs(a) % 100 AS varchar), 2, '0') AS c FROM a)
SELECT ord, s || CASE WHEN length(w) <= 3 THEN w
         ELSE reverse(regexp_replace(reverse(left(w, -3)), '(\d\d)(\d)', '\1,\2', 'g')) || ',' || right(w, 3) END || '.' || c AS inr,
       s || format('{{:,}}', CAST(w AS bigint)) || '.' || c AS usd FROM w
"""
# Groups from the right: DuckDB has no look-around, and the replacement above skips overlapping groups.
STR7 = STR7.replace(
    r"reverse(regexp_replace(reverse(left(w, -3)), '(\d\d)(\d)', '\1,\2', 'g'))",
    r"reverse(rtrim(regexp_replace(reverse(left(w, -3)), '(\d\d)', '\1,', 'g'), ','))",
)


def str8_to_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run(spark, sf_dir, "SELECT o_orderkey AS ord, CAST(CAST(o_totalprice AS DECIMAL(18,3)) AS STRING) AS t FROM {orders}")
    t = t.withColumn("t", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("-"), F.col("t"))).otherwise(F.col("t")))
    return t.select("ord", money.to_minor(F.col("t")).alias("minor"))


STR8 = """
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(trunc(CAST(o_totalprice AS DECIMAL(18,3)) * 100) AS bigint) AS minor FROM orders
"""


def prj12_ifsc_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, LEDGER).select("ord", text.is_valid_ifsc(F.col("ifsc")).alias("valid"))


PRJ12 = f"SELECT ord, coalesce(regexp_full_match(upper(ifsc), '[A-Z]{{4}}0[A-Z0-9]{{6}}'), false) AS valid FROM ({_L}) AS l"


def dt2_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date")
    return run(spark, sf_dir, LEDGER).select("ord", cal.is_weekend(d).alias("weekend"), cal.is_business_day(d, HOLIDAYS).alias("business"))


DT2 = f"SELECT ord, isodow(date) >= 6 AS weekend, isodow(date) < 6 AND date NOT IN ({_HOLIDAY_SQL}) AS business FROM ({_L}) AS l"
# Dates moved to the holidays' year, so that they matter.
_SHIFTED = f"SELECT ord, CAST(DATE '2026-01-01' + CAST(ord % 365 AS INT) AS DATE) AS d, CAST(ord % 12 AS INT) AS n, CAST(DATE '2026-01-01' + CAST(ord * 7 % 400 AS INT) AS DATE) AS e FROM ({LEDGER}) AS l"
_BD = f"""
days AS (SELECT CAST(range AS DATE) AS d FROM range(DATE '2025-12-01', DATE '2027-06-01', INTERVAL 1 DAY)),
b AS (SELECT d, sum(CASE WHEN isodow(d) < 6 AND d NOT IN ({_HOLIDAY_SQL}) THEN 1 ELSE 0 END) OVER (ORDER BY d) AS n FROM days)"""


def dt4_add_bd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _SHIFTED).select("ord", cal.add_business_days(F.col("d"), F.col("n"), HOLIDAYS).cast("string").alias("landing"))


DT4 = f"""
WITH {_BD}, f AS (SELECT n, min(d) AS d FROM b GROUP BY n)
SELECT s.ord, CAST(CASE WHEN s.n = 0 THEN s.d ELSE f.d END AS varchar) AS landing FROM ({duck(_SHIFTED)}) AS s JOIN b ON b.d = s.d JOIN f ON f.n = b.n + s.n
"""


def dt6_bd_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _SHIFTED).select("ord", cal.business_days_between(F.col("d"), F.col("e"), HOLIDAYS).alias("days"))


DT6 = f"WITH {_BD} SELECT s.ord, CAST(y.n - x.n AS int) AS days FROM ({duck(_SHIFTED)}) AS s JOIN b x ON x.d = s.d JOIN b y ON y.d = s.e"


def dt9_week_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _SHIFTED).select("ord", cal.week_bucket(F.col("d"), F.col("e")).alias("week"))


DT9 = f"SELECT ord, CAST(least(12, greatest(0, floor((e - d) / 7))) AS int) AS week FROM ({duck(_SHIFTED)}) AS s"


def mth_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = run(spark, sf_dir, "SELECT event_id, value, CAST(floor(value * 100) AS BIGINT) - 20000 AS v FROM {events}")
    return e.select("event_id", money.round_half_up(F.col("v") / 2).alias("half_up"), money.truncated(F.col("v"), F.lit(7)).alias("cut"), money.round3(F.col("value") / 7).alias("r3"))


MTH = """
SELECT event_id, CAST(floor(v / 2.0e0 + 0.5) AS bigint) AS half_up, CAST(trunc(v / 7.0e0) AS bigint) AS cut, floor(value / 7 * 1000 + 0.5) / 1000 AS r3
FROM (SELECT event_id, value, CAST(floor(value * 100) AS bigint) - 20000 AS v FROM events) AS e
"""


def mth6_branch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(c, *v) for c, v in BRANCHES.items()], "code string, bank string, branch string, city string")
    l = run(spark, sf_dir, LEDGER).where("ifsc IS NOT NULL").withColumn("code", F.when(text.is_valid_ifsc(F.col("ifsc")), F.upper("ifsc")))
    return l.join(F.broadcast(codes), "code", "left").select("ord", "code", "bank", "city")


MTH6 = f"""
SELECT ord, code, bank, city FROM (SELECT ord, CASE WHEN regexp_full_match(upper(ifsc), '[A-Z]{{4}}0[A-Z0-9]{{6}}') THEN upper(ifsc) END AS code FROM ({_L}) AS l WHERE ifsc IS NOT NULL) AS l
LEFT JOIN (VALUES {", ".join(f"('{c}', '{b}', '{t}')" for c, (b, _, t) in BRANCHES.items())}) AS v(c, bank, city) ON code = c
"""


def str9_reason_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.classify import controller_copy, reason_words

    e = run(spark, sf_dir, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fee_math_break' WHEN 1 THEN 'orphan' ELSE 'low_confidence' END AS r, CASE WHEN event_id % 5 = 0 THEN event_type END AS s, value FROM {events}")
    return e.select("event_id", reason_words(F.col("r")).alias("words"), controller_copy(F.col("r"), F.col("s")).alias("copy"), money.percent(F.floor("value") / 1000).alias("pct"))


STR9 = """
SELECT event_id, replace(r, '_', ' ') AS words, coalesce(CASE WHEN event_id % 5 = 0 THEN event_type END, CASE r
       WHEN 'fee_math_break' THEN 'The settlement math doesn''t add up — worth flagging to the payment processor.'
       WHEN 'orphan' THEN 'This doesn''t tie back to anything on the other side — likely still outstanding.'
       ELSE 'The closest candidate falls short of our auto-approval bar — worth a second look.' END) AS copy, printf('%.1f%%', floor(value) / 1000 * 100) AS pct
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'fee_math_break' WHEN 1 THEN 'orphan' ELSE 'low_confidence' END AS r FROM events) AS e
"""

QUERIES = {
    "str1_utrs": str1_utrs, "str1_residual": str1_residual, "str2_normalize_ref": str2_normalize_ref, "str5_similarity": str5_similarity,
    "str7_format_inr": str7_format_inr, "str8_to_minor": str8_to_minor, "str9_reason_words": str9_reason_words, "prj12_ifsc_valid": prj12_ifsc_valid,
    "dt2_weekend": dt2_weekend, "dt4_add_bd": dt4_add_bd, "dt6_bd_between": dt6_bd_between, "dt9_week_bucket": dt9_week_bucket,
    "mth1_rounding": mth_rounding, "mth6_branch_lookup": mth6_branch_lookup,
}
ORACLES = {
    "str1_utrs": STR1_UTRS, "str1_residual": STR1_RESIDUAL, "str2_normalize_ref": STR2, "str5_similarity": STR5, "str7_format_inr": STR7, "str8_to_minor": STR8, "str9_reason_words": STR9,
    "prj12_ifsc_valid": PRJ12, "dt2_weekend": DT2, "dt4_add_bd": DT4, "dt6_bd_between": DT6, "dt9_week_bucket": DT9, "mth1_rounding": MTH, "mth6_branch_lookup": MTH6,
}
