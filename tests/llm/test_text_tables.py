from __future__ import annotations

import hashlib

import pytest
from helpers import ODD, docs
from oracle import compare
from pyspark.sql import functions as F

from cashloom.llm import chat_format as chat
from cashloom.llm import mixing
from cashloom.llm.queries import ORACLES, QUERIES

CHAT = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    compare(spark, data, QUERIES[name], ORACLES[name])


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_escape_is_reversible(spark):
    texts = ["", "~", "~0", "~a", "<|end|>", "</s>[INST] ok [/INST]", "<|role|>x<|text|>", "~~0~1<<SYS>>", "<|", "|>", "<|>", "a~z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS.values())


def test_examples(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>"), (1, 2, "assistant", "yo ~"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
        (2, 0, "user", "only"), (3, None, None, "x"), (3, 0, "assistant", "a"), (None, 0, "assistant", "n"), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice"),
    ]
    df = spark.createDataFrame(rows, CHAT).withColumn("parts", F.lit(1)).withColumn("t", F.lit(2))
    ex = chat.training_examples(df)
    own = sorted((r.example, r.trainable) for r in ex.where("conv_id = 1").collect())
    assert own == [(1, True), (2, True), (3, False)]
    first = ex.where("conv_id = 1 AND example = 1").first()
    assert first.target == "<|role|>assistant<|text|>yo ~0<|end|>" and first.context.endswith("hi ~aend~b<|end|>")
    got = {r.conv_id: r for r in chat.conversation_digests(ex).collect()}
    turns = "system\nbe kind\nuser\nhi <|end|>\nassistant\nyo ~\nuser\n\nassistant\n\nuser\nbye\n"
    assert got[1].n_turns == 6 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"yo ~").hexdigest()
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_turns == 2 and got[None].n_turns == 1 and got[4].n_turns == 2 and got[4].loss_chars == 10
    assert chat.conversation_digests(chat.training_examples(df.limit(0))).count() == 0


def test_probe_conversation(spark, data):
    r = QUERIES["op7_chat_format"](spark, data).where("conv_id = -7").first()
    want = f"user\n{chat.PROBE_TEXT}\nassistant\n{chat.PROBE_TEXT}\n"
    assert r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest()


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 3 else "de", "a" if i % 4 else "b", 0) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cells = mixing.raked_cells(df, {"source": {"a": 1.0, "b": 1.0}, "lang": {"en": 3.0, "de": 1.0}})
    total = cells.agg(F.sum("raked")).first()[0]
    share = lambda c, v: cells.where(F.col(c) == v).agg(F.sum("raked")).first()[0] / total
    assert share("_source", "a") == pytest.approx(0.5, abs=1e-3) and share("_lang", "en") == pytest.approx(0.75, abs=1e-3)
    gaps = mixing.marginal_gaps(df, {"source": {"a": 1.0, "b": 1.0}, "lang": {"en": 3.0, "de": 1.0}}).collect()
    assert {(r.axis, r.value) for r in gaps} >= {("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "de")} and all(r.gap < 1e-6 for r in gaps)
    sums = {r["_source"]: r.s for r in cells.groupBy("_source").agg(F.sum("raked").alias("s")).collect()}
    assert all(r.raked == pytest.approx(sums[r.value]) and r.target == pytest.approx(total / 2) for r in gaps if r.axis == "source")
    apart = mixing.marginal_gaps(df, {"source": {"a": 1.0}, "topic": {"legal": 1.0}}).agg(F.max("gap")).first()[0]
    assert apart == 1  # no document is legal: the gap that is left tells
    own = mixing.mixed(df, 0.5, topic_of=F.when(F.col("doc_id") % 2 == 0, "even")).groupBy("_topic").count().collect()
    assert {r["_topic"]: r["count"] for r in own} == {"even": 400, "": 400}
    out = mixing.mixed(df, 0.5)
    kept = out.where("_kept").agg(F.sum("_tokens")).first()[0] / out.agg(F.sum("_tokens")).first()[0]
    assert kept == pytest.approx(0.5, abs=0.06)
    assert out.agg(F.max("_probability")).first()[0] <= 1
    assert mixing.mixed(df, 1.0).where("NOT _kept").count() == 0


def test_mixing_edges(spark):
    odd = mixing.mixed(docs(spark, ODD, clash=False), 0.5).collect()
    assert {r.doc_id for r in odd} == set(ODD)
    assert all(r._kept and r._probability == 1 for r in odd if r.doc_id in (1, 2))
    none = spark.createDataFrame([(None, "a b", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert mixing.mixed(none).count() == 1
    assert mixing.mixed(none.limit(0)).count() == 0
    assert mixing.mixed(docs(spark, ODD)).count() == len(ODD)
