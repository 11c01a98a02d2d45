"""Draws by their place and the generator made of them, against the sequential generator and known figures."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cashloom.functions import rng
from cashloom.operators.shared import running_sums
from cashloom.sources import generator
from cashloom.sources.generator import generate


def test_draws_by_place_are_the_sequence(spark):
    for seed in (0, 42, 2**32 - 1, 2**32 + 5):
        own = rng.CounterRng(seed)
        want = [own.next() for _ in range(2_000)]
        got = spark.range(2_000).select("id", rng.draw(seed, F.col("id")).alias("u")).collect()
        assert [r.u for r in sorted(got)] == want
        assert rng.CounterRng(seed, 700).next() == want[700]
    far = spark.range(1).select(rng.draw(F.lit(7), F.lit(2**32 + 3)).alias("a"), rng.draw(7, F.lit(3)).alias("b")).first()
    assert far.a == far.b  # the state comes round


def test_permutation_by_links_is_the_shuffle(spark):
    for n in (0, 1, 2, 3, 50, 1_777):
        want = rng.CounterRng(9, 5).shuffle(range(n))
        for small in (0, 10_000):
            got = rng.permutation(spark, n, 9, 5, small).collect()
            assert [r.item for r in sorted(got)] == want, (n, small)


def test_running_sums_over_many_blocks(spark):
    df = spark.range(1000).where("id % 7 <> 3").withColumn("x", F.col("id") % 5).repartition(3)
    got = running_sums(df, "id", {"s": F.col("x"), "n": F.lit(1)}, block=64).orderBy("id").collect()
    total = 0
    for k, r in enumerate(got):
        assert (r.s, r.n) == (total, k)
        total += r.x
    assert running_sums(df.limit(0), "id", {"s": F.col("x")}).count() == 0


@pytest.fixture(scope="module")
def made(spark):
    batch, truth = generate(spark, 42, 180)
    return {k: getattr(batch, k).orderBy("ord").collect() for k in ("ledger", "settlements", "bank")}, truth.collect()


def test_known_figures_of_seed_42(made):
    """Rows, matchable rows and shares as published for this seed; the counts of classes follow from the shares."""
    rows, truth = made
    assert len(rows["ledger"]) == len(truth) == 195 and sum(bool(t.payment_ids) for t in truth) == 173
    count = Counter(t["class"] for t in truth)
    assert {k: v for k, v in count.items() if k != "clean"} == {
        "true_orphan": 12, "ambiguous_near_duplicate": 10, "split_settlement": 8, "partial_refund": 10, "fx_settlement": 12,
        "holiday_delayed": 10, "timing_drift": 16, "typo_reference": 14, "wrong_ifsc": 6, "duplicate_entry": 10,
    }


def test_first_invoices_are_drawn_in_turn(made):
    """The shuffled plan, then each invoice's numbers one after the other, as one sequence."""
    rows, truth = made
    kinds = [k for k, share in generator.SHARES.items() for _ in range(round(180 * share))]
    own = rng.CounterRng(42)
    kinds = own.shuffle(kinds + ["clean"] * (180 - len(kinds)))
    known = {t.ledger_id: t["class"] for t in truth}
    for r, kind in zip(rows["ledger"], kinds, strict=False):
        if kind == "ambiguous_near_duplicate":
            break
        assert known[r.id] == kind
        assert r.counterparty == own.pick(generator.NAMES)
        code = own.pick(generator.CODES)
        assert r.ifsc == (code if kind != "wrong_ifsc" else f"{code[:4]}X{code[5:]}")
        if kind == "holiday_delayed":
            assert str(r.date) == own.pick(generator.BEFORE_HOLIDAY)
        else:
            own.integer(0, 40)
        paise = own.integer(5_000, 250_000) * 100
        if kind == "fx_settlement":
            assert r.currency == own.pick(("USD", "EUR")) and r.amount == int(paise / generator.RATES[r.currency] + 0.5)
        else:
            assert (r.currency, r.amount) == ("INR", paise)
        if kind == "typo_reference":
            a, b = r.id[4:6]
            assert r.reference == "INV-" + (b + a if own.chance(0.5) else a) + r.id[6:]
            words = own.shuffle([r.counterparty, r.reference, r.ifsc, "PAYMENT"])
            assert r.memo == "NEFT-" + "-".join(words)
        else:
            assert r.reference == r.id
        if kind != "holiday_delayed":
            own.next()


def test_credits_are_what_their_batch_leaves(made):
    rows, truth = made
    net = Counter()
    for p in rows["settlements"]:
        net[p.parent_id] += p.amount - p.fees - p.tax
    assert {b.id: b.amount for b in rows["bank"][:-2]} == {f"bank_{k}": v for k, v in net.items()}
    assert len({p.id for p in rows["settlements"]}) == len(rows["settlements"])
    twins = [t.ledger_id for t in truth if t["class"] == "ambiguous_near_duplicate"]
    by_id = {r.id: r for r in rows["ledger"]}
    for a, b in zip(sorted(twins)[::2], sorted(twins)[1::2], strict=True):
        assert by_id[a].amount == by_id[b].amount and by_id[a].counterparty == by_id[b].counterparty and (by_id[b].date - by_id[a].date).days == 1


def test_few_and_no_invoices(spark):
    for n in (0, 1, 2, 5):
        batch, truth = generate(spark, 3, n)
        assert batch.ledger.count() == truth.count() >= n and batch.bank.count() >= 2
