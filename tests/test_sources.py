from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cashloom.evaluation import scores
from cashloom.operators import standing_orders as match
from cashloom.sources import csv_batch, settlements_api, standing_orders, two_way
from cashloom.sources.generator import generate

GOOD = '''source,id,date,amount,currency,reference,counterparty,memo,parentId,fees,tax,ifsc
bank,b-77,2026-03-18,512.35,INR,K9,,credit of the week,,,,

settlement,p-77,2026-03-17,512.35,inr,INV-8813,"OAK, ""ELM""",paid INV-8813,K9,10.50,1.89,
ledger,INV-8813,2026-03-12,524.74,INR,INV-8813,OAK AND ELM,,,,,
'''


def test_csv(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text(GOOD)
    for got in (csv_batch.parse_text(spark, GOOD), csv_batch.parse_file(spark, f"file://{path}")):
        assert got.ok and got.batch.base_currency == "INR"
        p = got.batch.settlements.first()
        assert (p.amount, p.fees, p.counterparty, p.currency, p.parent_id, p.raw["id"]) == (51235, 1050, 'OAK, "ELM"', "INR", "K9", "p-77")
        assert got.batch.bank.count() == got.batch.ledger.count() == 1 and got.batch.ledger.first().memo is None


HEAD = "id,source,date,amount,currency,fees\n"


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("", "empty"), ("\n \n", "empty"), ("source,id,date,amount\n", "currency"), (HEAD, "No data rows"),
        (HEAD + "1,cash,2026-01-01,1,INR,", 'row 2: "source"'), (HEAD + ",bank,2026-01-01,1,INR,", 'row 2: "id"'),
        (HEAD + "1,bank,2026-01-01,1,INR,\n1,bank,2026-01-01,1,INR,", 'row 3: duplicate id "1"'), (HEAD + "1,bank,01/02/2026,1,INR,", '"date"'),
        (HEAD + "1,bank,2026-99-99,1,INR,", '"date"'), (HEAD + '1,bank,2026-01-01,"1,000",INR,', '"amount"'), (HEAD + "1,bank,2026-01-01,1,,", '"currency"'),
        (HEAD + "1,bank,2026-01-01,1,INR,-2", '"fees"'), (HEAD + "1,bank,2026-01-01,1,INR,\n2,x,2026-01-01,y,INR,", 'row 3: "source"'),
    ],
)
def test_csv_errors(spark, text, error):
    got = csv_batch.parse_text(spark, text)
    assert not got.ok and error in got.error, got.error


def test_uploads_in_one_plan_are_those_one_by_one(spark):
    texts = [GOOD, HEAD + "1,bank,2026-01-01,1,INR,\n1,bank,2026-01-01,1,INR,", "", "a,b\n1,2", HEAD, "memo,currency,id,source,date,amount\n\"x, y\",usd,7,ledger,2026-02-03,5.1", HEAD + ",bank,2026-01-01,1,INR,"]
    records, problems = csv_batch.parse_uploads(spark.createDataFrame(list(enumerate(texts)), "upload int, value string"))
    wrong = {r.upload: r.error for r in problems.collect()}
    for k, text in enumerate(texts):
        one = csv_batch.parse_text(spark, text)
        assert wrong.get(k) == one.error
        if one.ok:
            want = one.batch.bank.unionByName(one.batch.settlements).unionByName(one.batch.ledger)
            got = records.where(F.col("upload") == k).select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_table_of_rows_without_id_and_a_hot_id(spark):
    rows = spark.range(4000).selectExpr("id + 1 AS line_no", "'bank' AS source", "CASE WHEN id % 2 = 0 THEN 'same' WHEN id % 4 = 1 THEN NULL ELSE CAST(id AS string) END AS id", "'2026-01-01' AS date", "'1' AS amount", "'INR' AS currency", "NULL AS fees", "NULL AS tax")
    got = csv_batch.errors(rows)
    assert got.count() == 4000 and got.where("error LIKE '%duplicate%'").count() == 1999 and got.where("error LIKE '%no value%'").count() == 1000
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_standing_orders(spark, tmp_path):
    (tmp_path / "order.asc").write_text('"order_id";"account_id";"bank_to";"account_to";"amount";"k_symbol"\r\n611;"1";"QR";"5550123";1805.40;"SIPO"\r\n612;"2";"GH";"5550987";77.10;"UVER"\r\n')
    (tmp_path / "trans.asc").write_text(
        '"trans_id";"account_id";"date";"type";"operation";"amount";"balance";"k_symbol";"bank";"account"\r\n9001;"1";930101;"VYDAJ";"PREVOD";1805.40;1.00;"SIPO";"QR";"5550123"\r\n'
        '9002;"1";930102;"PRIJEM";"VKLAD";5.00;1.00;"";"";""\r\n9005;"3";930103;"VYDAJ";"VYBER";7.50;1.00;"";"";""\r\n'
    )
    orders, trans = standing_orders.load(spark, f"file://{tmp_path}")
    l, b = standing_orders.as_ledger(orders), standing_orders.as_bank(trans)
    assert str(b.orderBy("ord").first().date) == "1993-01-01" and b.count() == 2
    got = {r.trans_id: r.order_id for r in match.match_standing_orders(l, b).collect()}
    assert got == {"trans_9001": "order_611", "trans_9005": None}
    assert match.matching_stats(l, b).first().trans_without_orders == 1
    truth = match.true_orders(l, b)
    assert scores.score_orders(match.match_standing_orders(l, b), truth).first().correct == 1
    assert {r.id: r.executed for r in match.executed(l, truth).collect()} == {"order_611": True, "order_612": False}


def test_two_way(spark, tmp_path):
    head = "B_id,A_id,A_amount,A_valueDate,A_currencyCode,A_transactionReferences,A_transactionAttributes,A_allocation,B_amount,B_valueDate,B_transactionReferences,targetAllocation"
    (tmp_path / "eval.csv").write_text(f"{head}\n,1,10.50,2026-01-01,,ref 1,more,K1,,,,\n9,,,,,,,,10.50,2026-01-02,ref 1,\n8,,,,,,,,x,2026-01-02,,K2\n")
    (tmp_path / "train.csv").write_text(head + "\n")
    (tmp_path / "solution.csv").write_text("B_id,targetAllocation,Usage\n9,K1,Public\n")
    (tmp_path / "sub.csv").write_text("B_id,A_id\n9,A_1\n8,\n")
    _, rows, solution = two_way.load(spark, f"file://{tmp_path}")
    a, b = two_way.ledger_side(rows).first(), two_way.settlement_side(rows).collect()
    assert (a.id, a.amount, a.currency, a.memo) == ("A_1", 1050, "USD", "ref 1 more") and [x.id for x in b] == ["B_9"]
    assert "K1" not in map(str, a)
    result = spark.createDataFrame([("B_9", "A_1")], "b_id string, a_id string")
    got = scores.score_allocations(result, two_way.true_allocations(rows, solution), two_way.own_allocations(rows)).first()
    assert (got.correct, got.precision, got.recall, got.ceiling) == (1, 1, 1, 1)
    assert two_way.read_submission(spark, f"file://{tmp_path}/sub.csv").orderBy("b_id").collect()[0].a_id is None


def test_settlement_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"items": [{"id": "setl_1", "entity": "settlement", "amount": 9973635, "fees": 471699, "tax": 42070, "utr": "", "status": "processed", "created_at": 1568176960}]}')
    r = settlements_api.as_settlements(settlements_api.read_pages(spark, f"file://{tmp_path}/p.json")).first()
    assert (r.id, r.amount, str(r.date), r.reference) == ("setl_1", 9973635, "2019-09-11", None)
    assert settlements_api.page_size(0) == 1 and settlements_api.page_size(500) == 100


def test_generator(spark):
    batch, truth = generate(spark, 7, 60)
    again, _ = generate(spark, 7, 60)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(batch.ledger) == key(again.ledger) and key(batch.ledger) != key(generate(spark, 8, 60)[0].ledger)
    assert batch.ledger.count() == truth.count() >= 60
    assert "class" not in batch.ledger.columns
    ids = {r.id for r in batch.settlements.collect()}
    assert all(set(t.payment_ids) <= ids for t in truth.collect())
