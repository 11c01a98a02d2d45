"""Operators with one key that holds most rows, and their edge cases, against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from cashloom.config import MatchConfig
from cashloom.evaluation.scores import percentiles
from cashloom.operators import tiers
from cashloom.operators.fx import normalise_as_of, rates_as_of
from cashloom.operators.qa import find_record_id, find_record_ids
from cashloom.operators.tieout import tie_out
from cashloom.schema import canonical


def test_rates_hold_until_the_next_one(spark):
    rng = random.Random(1)
    start = dt.date(2020, 1, 1)
    rates = [(c, start + dt.timedelta(rng.randrange(400)), "INR", rng.random()) for c in ("USD", "EUR") for _ in range(60)]
    rates += [("USD", start, "INR", 9.0), ("USD", start, "INR", 7.0), ("XAU", None, "INR", 1.0), (None, start, "INR", 1.0), ("GBP", start, "USD", 5.0), ("USD", start + dt.timedelta(3), "INR", None)]
    records = [(i, rng.choice(["USD"] * 8 + ["EUR", "INR", "JPY", None]), rng.choice([None] + [start + dt.timedelta(k) for k in range(-20, 900, 7)]), rng.randrange(10**6)) for i in range(3000)]
    table = spark.createDataFrame(rates, "currency string, date date, base string, rate double")
    df = spark.createDataFrame(records, "id int, currency string, date date, amount bigint")
    got = {r.id: r for r in normalise_as_of(df, "INR", table).collect()}
    assert len(got) == len(records)
    for i, cur, day, amount in records:
        known = [(d, r) for c, d, b, r in rates if c == cur and b == "INR" and d and r is not None and day and d <= day]
        rate = max(known)[1] if known else None
        r = got[i]
        if cur == "INR" or cur is None:
            assert (r.amount, r.currency) == (amount, cur) and not r.fx_unresolved
        elif rate is None:
            assert (r.amount, r.currency, r.fx_unresolved) == (amount, cur, True)
        else:
            assert (r.amount, r.currency, r.fx_unresolved) == (math.floor(amount * rate + 0.5), "INR", False)
    assert rates_as_of(df.limit(0), table).count() == 0 and rates_as_of(df, table.limit(0)).where("rate IS NOT NULL").count() == 0


def test_ranks_of_a_group_of_most_rows(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice([rng.gauss(0, 1), math.exp(rng.uniform(-30, 30)), 5.0, -2.5])) for _ in range(6000)] + [(2, 4.0)] * 900 + [(3, float(k)) for k in range(7)] + [(4, None)] + [(None, 1.5)] * 700
    df = spark.createDataFrame(rows, "g int, v double")
    want = {}
    for g in (1, 2, 3, None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = tuple(v[min(len(v) - 1, math.floor(p / 100 * len(v)))] for p in (0, 50, 95, 99.9, 100))
    for ranked in (5, 300, 100_000):
        got = percentiles(df, "g", "v", (0, 50, 95, 99.9, 100), ranked).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want
    assert percentiles(df.limit(0), "g", "v", (50,)).count() == 0


def test_questions_held_against_an_index(spark):
    rng = random.Random(5)
    ids = [f"INV-{k}" for k in range(2000, 2400)] + [f"INV-{k}-DUP" for k in range(2000, 2040)] + ["A1", "b", "", None, "Ünïque-77", "bank_setl_0001"]
    texts = [rng.choice(["why ", "", "x"]) + rng.choice([i or "?" for i in ids]).swapcase() + rng.choice([" open?", "0", "-dup", "-DU"]) for _ in range(500)] + ["", None, "nothing", "A", "zzz b zzz", "inv-2001 or INV-2002"]
    found = find_record_ids(spark.createDataFrame(list(enumerate(texts)), "q_id int, question string").withColumn("own", F.lit(1)), spark.createDataFrame([(i,) for i in ids], "id string"))
    assert found.columns == ["q_id", "question", "own", "id"]
    got = {r.q_id: r.id for r in found.collect()}
    for k, text in enumerate(texts):
        held = [i for i in ids if i and text is not None and i.lower() in text.lower()]
        assert got[k] == (min(held, key=lambda i: (-len(i), i)) if held else None), text
    assert find_record_id([], spark.createDataFrame([("a",)], "id string")).count() == 0


def _records(spark, rows):
    df = spark.createDataFrame([(i, f"{k}{i}", d, a, m) for i, (k, d, a, m) in enumerate(rows)], "ord int, id string, date date, amount bigint, memo string")
    return canonical(df.withColumn("currency", F.lit("INR")))


def test_splits_of_one_hot_reference_do_not_depend_on_its_parts(spark, monkeypatch):
    rng = random.Random(7)
    day = dt.date(2026, 3, 2)
    ledger = _records(spark, [("l", day, rng.choice([10_000, 25_000]), "INV-555") for _ in range(12)] + [("l", day, 9_000, "INV-777")])
    payments = _records(spark, [("p", day, rng.choice([4_000, 6_000, 10_000, 15_000, 5_990]), "NEFT INV555") for _ in range(40)] + [("p", day, 4_500, "INV777")] * 2)
    none = spark.createDataFrame([], "ledger_id string, payment_ids array<string>")
    got = []
    for part in (1_000, 3):
        monkeypatch.setattr(tiers, "SPLIT_PART", part)
        got.append(sorted(map(str, tiers.split_match(ledger, payments, none, MatchConfig()).collect())))
    assert got[0] == got[1] and len(got[0]) > 3


def test_credits_of_one_amount_tie_by_their_days(spark):
    """Many credits and batches of one amount: only those of neighbouring business days meet."""
    days = [dt.date(2026, 1, 1) + dt.timedelta(k) for k in range(200)]
    cfg = MatchConfig()
    bank = _records(spark, [("b", d, 5_000, "CREDIT") for d in days])
    batches = canonical(spark.createDataFrame([(i, f"p{i}", d, 5_000, f"s{i}") for i, d in enumerate(days)], "ord int, id string, date date, amount bigint, parent_id string").withColumn("currency", F.lit("INR")))
    got = {r.bank_id: r.batch_id for r in tie_out(bank, batches, cfg).collect()}
    taken, want = set(), {}
    number, n = {}, 0
    for k in range(-5, 260):
        d = dt.date(2026, 1, 1) + dt.timedelta(k)
        n += d.weekday() < 5 and d not in cfg.holidays
        number[d] = n
    for i, d in enumerate(days):
        free = [j for j, e in enumerate(days) if j not in taken and abs(number[d] - number[e]) <= cfg.date_slack]
        want[f"b{i}"] = f"s{free[0]}" if free else None
        taken |= {free[0]} if free else set()
    assert got == want


def test_best_candidates_are_the_first_of_all(spark):
    from cashloom.operators.candidates import best_candidates, candidates

    rng = random.Random(13)
    day = dt.date(2026, 3, 2)
    people = ["ACME CORP", "NIMBUS LTD", "ORION", ""]

    def side(name: str, n: int, memo: str):
        rows = [(i, f"{name}{i}", day + dt.timedelta(rng.randrange(0, 60)), 100_000 + rng.randrange(-700, 700), rng.choice(people), memo.format(rng.randrange(2000, 2060))) for i in range(n)]
        return canonical(spark.createDataFrame(rows, "ord int, id string, date date, amount bigint, counterparty string, memo string").withColumn("currency", F.lit("INR")))

    ledger, payments, cfg = side("l", 60, "PAYMENT INV-{}"), side("p", 90, "NEFT INV{} x"), MatchConfig()
    want = {}
    for r in candidates(ledger, payments, cfg).collect():
        want.setdefault(r.ledger_id, []).append((-r.confidence, r.p_ord))
    for k in (1, 5):
        got = {}
        for r in best_candidates(ledger, payments, cfg, k).collect():
            got.setdefault(r.ledger_id, []).append((-r.confidence, r.p_ord))
        assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x)[:k] for i, x in want.items()}


def test_string_bounds_hold(spark):
    from cashloom.operators.candidates import band_join, bound_features, score_strings, string_bounds

    rng = random.Random(5)
    names = ["ACME CORP", "Acme Corp", "NIMBUS LTD", "Customer#000000123", "Customer#000000132", "", None, "Ж" * 40, "x" * 300, "ab ba", "\U0001f600\U0001f600 shop"]
    memos = ["PAYMENT INV-{}", "NEFT INV{} N000000000{} x", "INV-{} INV-{}", "late fee {}", "", None, "word " * 80, "é{} ü ß", "N00000000000{}"]

    def side(name: str, n: int):
        def memo():
            m = rng.choice(memos)
            return m and m.format(rng.randrange(2000, 2100), rng.randrange(100, 110))

        rows = [(i, f"{name}{i}", dt.date(2026, 3, 2), 100_000, rng.choice(names), memo()) for i in range(n)]
        return canonical(spark.createDataFrame(rows, "ord int, id string, date date, amount bigint, counterparty string, memo string").withColumn("currency", F.lit("INR")))

    cfg = MatchConfig()
    pairs = band_join(bound_features(side("l", 150)), bound_features(side("p", 150)), 0.5)
    for weights in (cfg.strings, type(cfg.strings)(0.0, 1.0, 0.0), type(cfg.strings)(1.0, 0.0, 0.0), type(cfg.strings)(0.0, 0.0, 1.0)):
        rows = score_strings(string_bounds(pairs, weights).withColumnsRenamed({"string_low": "low", "string_high": "high"}), weights)
        n, wrong, near = rows.agg(F.count("*"), F.count_if((F.col("low") > F.col("string_score") + 1e-12) | (F.col("high") < F.col("string_score") - 1e-12)), F.count_if(F.col("high") < 1)).first()
        assert (n, wrong) == (150 * 150, 0) and near > 1000


def test_candidates_are_counted_by_bounds(spark):
    from cashloom.operators.candidates import candidates, count_candidates

    rng = random.Random(17)
    people = ["ACME CORP", "NIMBUS LTD", "ORION", "", "Q"]

    def side(name: str, n: int, memo: str):
        rows = [(i, f"{name}{i}", dt.date(2026, 3, 2) + dt.timedelta(rng.randrange(0, 60)), 100_000 + rng.randrange(-900, 900), rng.choice(people), rng.choice([memo, "{}"]).format(rng.randrange(2000, 9000))) for i in range(n)]
        return canonical(spark.createDataFrame(rows, "ord int, id string, date date, amount bigint, counterparty string, memo string").withColumn("currency", F.lit("INR")))

    ledger, payments, cfg = side("l", 80, "PAYMENT INV-{}"), side("p", 120, "NEFT INV{} x"), MatchConfig()
    want = {r.ledger_id: r["count"] for r in candidates(ledger, payments, cfg).groupBy("ledger_id").count().collect()}
    assert {r.ledger_id: r.n for r in count_candidates(ledger, payments, cfg).collect()} == want
