from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strings_by_hand import common_value, jaro_value, jaro_winkler_value, token_set_value

from cashloom.functions import calendar as cal
from cashloom.functions import money, text
from cashloom.functions.rng import CounterRng
from cashloom.functions.similarity import common_letters, jaro, jaro_winkler, token_set_ratio
from cashloom.functions.tables import HOLIDAYS


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_money_text(spark):
    parse = {"1234.56": 123456, "5": 500, "-0.5": -50, "1.999": 199, "x": None, "": None, ".7": 70}
    df = spark.createDataFrame([(k, v) for k, v in parse.items()], "t string, v bigint")
    assert all(r.m == r.v for r in df.select("v", money.to_minor(F.col("t")).alias("m")).collect())
    shown = {(14646000, "INR"): "1,46,460.00", (-50050, "INR"): "-500.50", (123456789, "USD"): "1,234,567.89", (5, "INR"): "0.05", (99900, "INR"): "999.00", (100000000, "INR"): "10,00,000.00"}
    for (a, c), want in shown.items():
        assert one(spark, money.format_minor(F.lit(a).cast("bigint"), F.lit(c))) == (want,)


def test_rounding(spark):
    assert one(spark, money.round_half_up(F.lit(-2.5)), money.round_half_up(F.lit(2.5))) == (-2, 3)
    assert one(spark, money.truncated(F.lit(-7), F.lit(2)), money.truncated(F.lit(7), F.lit(-2)), money.truncated(F.lit(10**17 + 1), F.lit(3))) == (-3, -3, (10**17 + 1) // 3)


def test_identifiers(spark):
    memo = F.lit("NEFT-HDFC0001234-ACME CORP PVT LTD-INV2841-PAYMENT")
    assert one(spark, text.ifscs(memo), text.invoice_refs(memo), text.residual(memo)) == (["HDFC0001234"], ["INV2841"], "ACME CORP PVT LTD")
    assert one(spark, text.utrs(F.lit("ref N452683498705921")), text.normalize_ref(F.lit("inv 2841"))) == (["N452683498705921"], "INV2841")
    nothing = F.lit(None).cast("string")
    assert one(spark, text.utrs(nothing), text.residual(nothing), text.is_valid_ifsc(nothing)) == ([], "", False)
    assert one(spark, text.is_valid_ifsc(F.lit("hdfc0001234")), text.is_valid_ifsc(F.lit("HDFC1001234"))) == (True, False)


def test_calendar(spark):
    d = lambda s: F.lit(dt.date.fromisoformat(s))
    assert one(spark, cal.add_business_days(d("2026-10-01"), F.lit(2), HOLIDAYS)) == (dt.date(2026, 10, 6),)
    assert one(spark, cal.business_days_between(d("2026-10-01"), d("2026-10-06"), HOLIDAYS), cal.business_days_between(d("2026-10-01"), d("2026-10-06"))) == (2, 3)
    assert one(spark, cal.business_days_between(d("2026-10-06"), d("2026-10-01"), HOLIDAYS)) == (-2,)
    assert one(spark, cal.add_business_days(d("2026-10-03"), F.lit(0), HOLIDAYS)) == (dt.date(2026, 10, 3),)


def test_calendar_against_days(spark):
    days = [dt.date(2026, 9, 20) + dt.timedelta(i) for i in range(30)]
    rows = [(a, n) for a in days for n in range(7)]

    def walk(a, n):
        while n > 0:
            a += dt.timedelta(1)
            n -= a.weekday() < 5 and a not in HOLIDAYS
        return a

    df = spark.createDataFrame(rows, "a date, n int")
    for r in df.select("a", "n", cal.add_business_days(F.col("a"), F.col("n"), HOLIDAYS).alias("b")).collect():
        assert r.b == walk(r.a, r.n), (r.a, r.n)


def _scored(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    return df.select("a", "b", jaro(a, b).alias("jaro"), jaro_winkler(a, b).alias("jw"), token_set_ratio(a, b).alias("tokens"), common_letters(a, b).alias("common"))


def test_similarity(spark):
    pairs = [("RAMESH", "RAMSEH"), ("", ""), ("a", ""), ("abc", "xyz"), ("MARTHA", "MARHTA"), ("ACME CORP", "corp acme ltd"), ("", "x"), (None, "x"), ("é🙂ü", "ü🙂é")]
    got = {(r.a, r.b): r for r in _scored(spark, pairs).collect()}
    assert got["RAMESH", "RAMSEH"].jw > 0.9 and got["", ""].jaro == 1 and got["a", ""].jaro == 0 and got["abc", "xyz"].jaro == 0
    assert got["MARTHA", "MARHTA"].jaro == pytest.approx(0.944444, abs=1e-6)
    assert got["ACME CORP", "corp acme ltd"].tokens == 1 and got["", "x"].tokens == 0 and got[None, "x"].jw is None and got[None, "x"].tokens is None


def test_similarities_of_100_000_pairs(spark):
    """Against their definitions: names, references and noise, of up to a few hundred letters."""
    rng = random.Random(8)

    def text() -> str:
        kind = rng.random()
        if kind < 0.3:
            return "INV" + "".join(rng.choice("0123") for _ in range(rng.randrange(2, 7)))
        if kind < 0.999:
            return "".join(rng.choice("abcA é ") for _ in range(rng.randrange(0, 14)))
        return " ".join("".join(rng.choice("xyz") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(20, 40)))

    pairs = [(text(), text()) for _ in range(100_000)]
    pairs += [(a, a[:3] + b) for a, b in pairs[:500]]
    for r in _scored(spark, pairs).toLocalIterator():
        assert r.common == common_value(r.a, r.b), (r.a, r.b)
        assert r.jaro == jaro_value(r.a, r.b) and r.jw == jaro_winkler_value(r.a, r.b), (r.a, r.b)
        assert r.tokens == token_set_value(r.a, r.b) / 100, (r.a, r.b)


def test_similarities_run_no_python(spark):
    plan = _scored(spark, [("a", "b")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_random_numbers():
    a, b = CounterRng(42), CounterRng(42)
    assert [a.next() for _ in range(5)] == [b.next() for _ in range(5)]
    assert sorted(CounterRng(1).shuffle(range(20))) == list(range(20))
    assert all(3 <= CounterRng(s).integer(3, 5) <= 5 for s in range(50))
