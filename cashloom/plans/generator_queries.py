"""Queries of the seeded draws and the generator. Their SQL shuffles by recursion, one swap after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import draw, permutation
from ..functions.tables import HOLIDAYS
from ..operators.shared import running_sums
from ..sources import generator as g

SEED = 42
SHUFFLE_SEED = 7


def mth8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a number of its customer's sequence, at the order's place in it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", draw(F.col("o_custkey"), F.col("o_orderkey")).alias("u"))


def _u(place: str, seed: str | int = SEED) -> str:
    out = f"[({seed} + (CAST({place} AS hugeint) + 1) * 1831565813) & 4294967295]"
    for step in ("(xor(x, x >> 15) * (x | 1)) & 4294967295", "xor(x, (x + ((xor(x, x >> 7) * (x | 61)) & 4294967295)) & 4294967295)", "CAST(xor(x, x >> 14) AS double) / 4294967296"):
        out = f"list_transform({out}, lambda x: {step})"
    return f"{out}[1]"


MTH8D = f"SELECT o_orderkey, {_u('o_orderkey', 'o_custkey')} AS u FROM orders"


def mth8_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers in a seeded shuffle of their keys, by links instead of swaps, whatever their number."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    keys = running_sums(keys, "c_custkey", {"item": F.lit(1)})
    return permutation(spark, keys.count(), SHUFFLE_SEED, small=0).join(keys, "item").select("pos", "c_custkey")


def _shuffled(name: str, n: str, first: str, seed: int = SEED) -> str:
    """CTEs ``name`` (pos, item) of a shuffle of ``n`` items from number ``first`` on (both scalar subqueries)."""
    turn = _u(f"first + n - 1 - i", seed)
    return f"""
{name}_in AS MATERIALIZED (SELECT CAST({n} AS bigint) AS n, CAST({first} AS bigint) AS first),
{name}_steps(i, l, js) AS (
    SELECT n - 1, range(n), (SELECT coalesce(list(CAST(floor({turn} * (i + 1)) AS bigint) ORDER BY i), []) FROM {name}_in, range(n) AS r(i)) FROM {name}_in
    UNION ALL
    SELECT i - 1, CASE WHEN js[i + 1] = i THEN l ELSE l[1:js[i + 1]] || [l[i + 1]] || l[js[i + 1] + 2:i] || [l[js[i + 1] + 1]] || l[i + 2:] END, js FROM {name}_steps WHERE i > 0),
{name} AS MATERIALIZED (SELECT unnest(range(len(l))) AS pos, unnest(l) AS item FROM {name}_steps WHERE i <= 0)"""


MTH8S = f"""
WITH RECURSIVE {_shuffled("s", "(SELECT count(*) FROM customer)", "0", SHUFFLE_SEED)},
k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS item FROM customer)
SELECT s.pos, k.c_custkey FROM s JOIN k ON k.item = s.item
"""


def _generated(spark: SparkSession, sf_dir: str) -> tuple:
    """A batch of as many planned invoices as there are customers, whose names are the counterparties."""
    names = running_sums(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("name")), "c_custkey", {"pos": F.lit(1)})
    return g.generate(spark, SEED, names.count(), names)


def _date(c: str):
    return F.col(c).cast("string").alias(c)


def src11_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, truth = _generated(spark, sf_dir)
    known = truth.select(F.col("ledger_id").alias("id"), F.array_join("payment_ids", ",").alias("payment_ids"), "class")
    return batch.ledger.join(known, "id").select("id", _date("date"), "amount", "currency", "reference", "counterparty", "ifsc", "memo", "payment_ids", "class")


def src11_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir)[0].settlements.select("id", _date("date"), "amount", "fees", "tax", "counterparty", "parent_id", "memo", "ifsc")


def src11_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir)[0].bank.select("id", _date("date"), "amount", "reference", "memo")


def _int(u: str, low: int, high: int) -> str:
    return f"(CAST(floor({u} * {high - low + 1}) AS bigint) + {low})"


def _of(items: tuple, u: str) -> str:
    return f"[{', '.join(repr(x) for x in items)}][CAST(floor({u} * {len(items)}) AS bigint) + 1]"


def _utr(first: str) -> str:
    return "'N' || " + " || ".join(f"CAST({_int(_u(f'{first} + {d}'), 0, 9)} AS varchar)" for d in range(g.UTR_DIGITS))


def _business(day: str, n: int) -> str:
    """The n-th day after ``day`` that is open, looked up among the next few."""
    closed = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
    return f"list_filter(list_transform(range(1, 15), lambda d: {day} + CAST(d AS int)), lambda d: isodow(d) < 6 AND d NOT IN ({closed}))[{n}]"


_TAKES = "CASE class WHEN 'holiday_delayed' THEN 4 WHEN 'fx_settlement' THEN 6 WHEN 'typo_reference' THEN 9 ELSE 5 END"
_LAST = "CASE class WHEN 'typo_reference' THEN first + 8 WHEN 'fx_settlement' THEN first + 5 ELSE first + 4 END"
_COMMON = f"""
WITH RECURSIVE n AS MATERIALIZED (SELECT count(*) AS n FROM customer),
names AS MATERIALIZED (SELECT c_name AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
counts AS (SELECT k, name, CAST(floor(n * share + 0.5) AS bigint) AS c FROM n, (VALUES {", ".join(f"({k}, '{name}', {share}e0)" for k, (name, share) in enumerate(g.SHARES.items()))}) AS v(k, name, share)),
runs AS (SELECT * FROM counts UNION ALL SELECT 99, name, c % 2 FROM counts WHERE name = '{g._TWIN}'),
cuts AS MATERIALIZED (SELECT name, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(c) OVER (ORDER BY k) AS high FROM runs),
{_shuffled("order1", "(SELECT n FROM n)", "0")},
kinds AS (SELECT pos, coalesce(name, 'clean') AS class FROM order1 LEFT JOIN cuts ON item >= low AND item < high),
paired AS (SELECT pos, class, row_number() OVER (PARTITION BY class ORDER BY pos) AS nth, count(*) OVER (PARTITION BY class) AS twins FROM kinds),
named AS (SELECT pos, CASE WHEN class = '{g._TWIN}' AND (nth % 2 = 0 OR nth = twins) THEN 'clean' ELSE class END AS class FROM paired),
plan AS MATERIALIZED (
    SELECT pos, class, {_TAKES} AS takes, sum(CASE class WHEN '{g._TWIN}' THEN 2 ELSE 1 END) OVER w - CASE class WHEN '{g._TWIN}' THEN 1 ELSE 0 END AS number,
           (SELECT greatest(n - 1, 0) FROM n) + sum({_TAKES}) OVER w - {_TAKES} AS first
    FROM named WINDOW w AS (ORDER BY pos)),
u AS MATERIALIZED (
    SELECT CAST(number + leg AS bigint) AS number, class, leg, class = '{g._TWIN}' AS twin, {_u("CASE WHEN class = '" + g._TWIN + "' THEN first + 2 ELSE first END")} AS u_name,
           {_u("CASE WHEN class = '" + g._TWIN + "' THEN first + 3 + leg ELSE first + 1 END")} AS u_code, {_u("CASE WHEN class = '" + g._TWIN + "' THEN first + 1 ELSE first + 2 END")} AS u_day,
           {_u("CASE WHEN class = '" + g._TWIN + "' THEN first ELSE first + 3 END")} AS u_amount, {_u("first + 4")} AS u_more, {_u("first + 5")} AS w3, {_u("first + 6")} AS w2, {_u("first + 7")} AS w1, {_u(_LAST)} AS u_last
    FROM plan, unnest(CASE WHEN class = '{g._TWIN}' THEN [0, 1] ELSE [0] END) AS t(leg)),
drawn AS MATERIALIZED (
    SELECT number, class, 'INV-' || CAST(number + 2000 AS varchar) AS id, names.name AS counterparty, {_of(g.CODES, "u_code")} AS code, w3, w2, w1, u_more < 0.5 AS swap,
           CASE WHEN class = 'holiday_delayed' THEN CAST({_of(g.BEFORE_HOLIDAY, "u_day")} AS date) ELSE DATE '{g.FIRST_DAY}' + CAST({_int("u_day", 0, g.LAST_DAY)} + CASE WHEN twin THEN leg ELSE 0 END AS int) END AS date,
           100 * CASE WHEN twin THEN {_int("u_amount", 20_000, 80_000)} ELSE {_int("u_amount", 5_000, 250_000)} END AS inr,
           CASE WHEN class = 'fx_settlement' THEN {_of(tuple(g.RATES), "u_more")} ELSE 'INR' END AS currency, NOT (twin OR class = 'holiday_delayed') AND u_last >= {g.NO_REFERENCE} AS shown
    FROM u JOIN names ON names.pos = CAST(floor(u_name * (SELECT n FROM n)) AS bigint)),
written AS (
    SELECT *, CASE currency WHEN 'USD' THEN CAST(floor(inr / {g.RATES["USD"]}e0 + 0.5) AS bigint) WHEN 'EUR' THEN CAST(floor(inr / {g.RATES["EUR"]}e0 + 0.5) AS bigint) ELSE inr END AS amount,
           CASE WHEN class <> 'typo_reference' THEN id WHEN swap THEN 'INV-' || id[6] || id[5] || id[7:] ELSE 'INV-' || id[5] || id[7:] END AS reference,
           CASE WHEN class = 'wrong_ifsc' THEN code[1:4] || 'X' || code[6:] ELSE code END AS ifsc
    FROM drawn),
words0 AS (SELECT *, [counterparty, reference, ifsc, 'PAYMENT'] AS w, CAST(floor(w3 * 4) AS int) AS j3, CAST(floor(w2 * 3) AS int) AS j2, CAST(floor(w1 * 2) AS int) AS j1 FROM written),
words1 AS (SELECT * REPLACE ([CASE WHEN j3 = 0 THEN w[4] ELSE w[1] END, CASE WHEN j3 = 1 THEN w[4] ELSE w[2] END, CASE WHEN j3 = 2 THEN w[4] ELSE w[3] END, w[j3 + 1]] AS w) FROM words0),
words2 AS (SELECT * REPLACE ([CASE WHEN j2 = 0 THEN w[3] ELSE w[1] END, CASE WHEN j2 = 1 THEN w[3] ELSE w[2] END, w[j2 + 1], w[4]] AS w) FROM words1),
words3 AS (SELECT * REPLACE ([CASE WHEN j1 = 0 THEN w[2] ELSE w[1] END, w[j1 + 1], w[3], w[4]] AS w) FROM words2),
invoices AS MATERIALIZED (
    SELECT number, class, id, date, inr, amount, currency, reference, counterparty, ifsc, shown,
           CASE WHEN class = 'typo_reference' THEN 'NEFT-' || array_to_string(w, '-') ELSE 'NEFT-' || ifsc || '-' || counterparty || '-' || reference END AS memo FROM words3),
paid AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY number) - 1 AS e FROM invoices WHERE class <> 'true_orphan'),
after1 AS MATERIALIZED (SELECT (SELECT greatest(n - 1, 0) FROM n) + (SELECT coalesce(sum(takes), 0) FROM plan) AS after, (SELECT count(*) FROM paid) AS made),
{_shuffled("order2", "(SELECT made FROM after1)", "(SELECT after FROM after1)")},
sizes0 AS (SELECT b, {_int(_u("(SELECT after + greatest(made - 1, 0) FROM after1) + b"), *g.BATCH_SIZES)} AS size FROM after1, range((made + 2) // 3) AS r(b)),
sizes AS MATERIALIZED (SELECT * FROM (SELECT b, size, sum(size) OVER (ORDER BY b) - size AS start FROM sizes0) WHERE start < (SELECT made FROM after1)),
seated AS MATERIALIZED (
    SELECT paid.*, b, pos - start AS seat, CASE WHEN class IN ('timing_drift', 'partial_refund') THEN 1 ELSE 0 END AS takes
    FROM order2 JOIN sizes ON pos >= start AND pos < start + size JOIN paid ON paid.e = order2.item),
groups0 AS (SELECT b, max(date) AS latest, {g.UTR_DIGITS} + sum(takes) AS takes FROM seated GROUP BY b),
after2 AS MATERIALIZED (SELECT after + greatest(made - 1, 0) + (SELECT count(*) FROM sizes) AS after, (SELECT count(*) FROM sizes) AS batches FROM after1),
groups AS MATERIALIZED (SELECT b, latest, sum(takes) OVER (ORDER BY b) - takes + (SELECT after FROM after2) AS first FROM groups0),
later AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY number) - 1) // {g.SECOND_LEGS} AS c, (row_number() OVER (ORDER BY number) - 1) % {g.SECOND_LEGS} AS seat FROM paid WHERE class = 'split_settlement'),
after3 AS MATERIALIZED (SELECT after + (SELECT coalesce(sum(takes), 0) FROM groups0) AS after, batches FROM after2),
chunks AS (SELECT c, max(date) AS latest FROM later GROUP BY c),
legs AS MATERIALIZED (
    SELECT s.* EXCLUDE (b, takes, e), s.b AS batch, {_business("g.latest", 2)} AS settled, {_utr("g.first")} AS utr,
           {_u(f"g.first + {g.UTR_DIGITS} + coalesce(sum(s.takes) OVER (PARTITION BY s.b ORDER BY s.seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")} AS extra,
           CASE WHEN class = 'split_settlement' THEN inr * {g.SPLIT_PCT} // 100 ELSE inr END AS value, CASE WHEN class = 'split_settlement' THEN 'a' ELSE '' END AS suffix
    FROM seated s JOIN groups g ON g.b = s.b
    UNION ALL BY NAME
    SELECT l.* EXCLUDE (c, e), l.c + (SELECT batches FROM after3) AS batch, {_business(f"{_business('k.latest', 2)}", 3)} AS settled, {_utr(f"(SELECT after FROM after3) + l.c * {g.UTR_DIGITS}")} AS utr,
           0.0 AS extra, inr - inr * {g.SPLIT_PCT} // 100 AS value, 'b' AS suffix
    FROM later l JOIN chunks k ON k.c = l.c),
settlements AS MATERIALIZED (
    SELECT 'pay_' || CAST(number + 2000 AS varchar) || suffix AS id, settled + CAST(CASE WHEN class = 'timing_drift' THEN {_int("extra", 1, 3)} ELSE 0 END AS int) AS date, value AS amount, value * 2 // 100 AS fees,
           (value * 2 // 100) * 18 // 100 AS tax, counterparty, batch, settled, utr, utr || ' SETTLEMENT ' || CASE WHEN shown THEN reference ELSE counterparty END AS memo, CASE WHEN class <> 'wrong_ifsc' THEN ifsc END AS ifsc
    FROM legs
    UNION ALL
    SELECT 'rfnd_' || CAST(number + 2000 AS varchar), settled, -(value * {_int("extra", 10, 35)} // 100), 0, 0, counterparty, batch, settled, utr, utr || ' REFUND ADJUSTMENT ' || reference, NULL
    FROM legs WHERE class = 'partial_refund'),
after4 AS MATERIALIZED (SELECT after + {g.UTR_DIGITS} * (SELECT count(*) FROM chunks) AS after, batches + (SELECT count(*) FROM chunks) AS batches FROM after3)"""
_CLEAN = "(SELECT count(*) FROM paid WHERE class = 'clean')"
_ORDER3 = _shuffled("order3", _CLEAN, "(SELECT after FROM after4)")
SRC11 = f"""{_COMMON}, {_ORDER3},
clean AS (SELECT *, row_number() OVER (ORDER BY number) - 1 AS item FROM paid WHERE class = 'clean')
SELECT id, CAST(date AS varchar) AS date, CAST(amount AS bigint) AS amount, currency, reference, counterparty, ifsc, memo, class,
       CASE class WHEN 'true_orphan' THEN '' WHEN 'split_settlement' THEN 'pay_' || id[5:] || 'a,pay_' || id[5:] || 'b' ELSE 'pay_' || id[5:] END AS payment_ids FROM invoices
UNION ALL BY NAME
SELECT id || '-DUP' AS id, CAST(date AS varchar) AS date, CAST(amount AS bigint) AS amount, currency, reference, counterparty, ifsc, memo, 'duplicate_entry' AS class, '' AS payment_ids
FROM clean JOIN order3 ON order3.item = clean.item WHERE order3.pos < (SELECT greatest(1, CAST(floor(n * {g.DUPLICATES}e0 + 0.5) AS bigint)) FROM n)
"""
SRC11S = f"""{_COMMON}
SELECT id, CAST(date AS varchar) AS date, CAST(amount AS bigint) AS amount, CAST(fees AS bigint) AS fees, CAST(tax AS bigint) AS tax, counterparty, printf('setl_%04d', CAST(batch + 1 AS bigint)) AS parent_id, memo, ifsc FROM settlements
"""
_STRAY = f"(SELECT after + greatest({_CLEAN} - 1, 0) FROM after4) + i * {1 + g.UTR_DIGITS}"
SRC11B = f"""{_COMMON}
SELECT printf('bank_setl_%04d', CAST(batch + 1 AS bigint)) AS id, CAST(settled AS varchar) AS date, CAST(sum(amount - fees - tax) AS bigint) AS amount, utr AS reference, '{g.BANK_MEMO}' || utr AS memo
FROM settlements GROUP BY batch, settled, utr
UNION ALL BY NAME
SELECT 'bank_unmatched_' || CAST(i + 1 AS varchar) AS id, CAST(DATE '{g.STRAY_DAY}' + CAST(i * 4 AS int) AS varchar) AS date, CAST(100 * {_int(_u(_STRAY), 4_000, 90_000)} AS bigint) AS amount,
       {_utr(f"{_STRAY} + 1")} AS reference, '{g.STRAY_MEMO}' AS memo
FROM range(2) AS r(i)
"""

_ALL = {"mth8_draws": MTH8D, "mth8_shuffle": MTH8S, "src11_generated": SRC11, "src11_settlements": SRC11S, "src11_bank": SRC11B}
QUERIES = {name: globals()[name] for name in _ALL}
ORACLES = dict(_ALL)
