"""Texts beyond a megabyte, repeated doc_ids and empty tables, for the operators whose own tests lack them."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from helpers import DOC, docs
from test_bpe import COUNTER, JSON, PATTERN, RANK_FILE, THEIRS
from test_dedup import brute_near

import corpus_pipeline
from cashloom.llm import bpe, media, mixing, near_dedup, quality, toxicity
from cashloom.llm import chat_format as chat
from cashloom.llm.token_counts import count_tokens

LONG = "".join(f"word{i % 5003} and some more, " for i in range(50_000))
PAIRS = [(1, "a b"), (1, "c d e"), (1, "a b"), (None, "x y"), (None, "x y"), (2, None), (2, "")]


@pytest.fixture
def repeats(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in PAIRS], DOC)


def test_bpe(spark, repeats):
    ids = THEIRS.encode_ordinary(LONG)
    r = bpe.round_trip(docs(spark, {1: LONG}), RANK_FILE, PATTERN).first()
    assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.round_trip(repeats, RANK_FILE, PATTERN).collect())
    assert got == Counter((i, tuple(THEIRS.encode_ordinary(t or ""))) for i, t in PAIRS)


def test_token_counts(spark, repeats):
    r = count_tokens(docs(spark, {1: LONG}), JSON).first()
    assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(LONG), len(COUNTER.tokenizer.encode(LONG, add_special_tokens=False).ids), True)
    got = Counter((r.doc_id, r.n_tokens) for r in count_tokens(repeats, JSON).collect())
    assert got == Counter((i, len(COUNTER.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in PAIRS)


def test_mixing(spark, repeats):
    rows = {r.doc_id: r for r in mixing.mixed(docs(spark, {1: LONG, 2: "a b"}, clash=False), 1.0).collect()}
    assert rows[1]._tokens == len(LONG.split(" ")) and rows[1]._kept and rows[2]._kept
    out = mixing.mixed(repeats, 0.5).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(PAIRS)
    assert all(len({r._kept for r in out if (r.doc_id, r.text) == p}) == 1 for p in PAIRS)


def test_near(spark):
    texts = {1: LONG, 2: LONG + " and one", 3: LONG[: len(LONG) // 2], 4: "short"}
    want = brute_near(texts, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts), 5, 80).collect()} == want


def test_chat(spark):
    df = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "~<|end|>")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.conversation_digests(chat.training_examples(df)).first()
    assert r.loss_sha256 == hashlib.sha256((LONG + "~<|end|>").encode()).hexdigest() and r.n_turns == 2


def test_scores_and_media_of_repeats(spark, repeats):
    net = quality.fit([b"good text here", b"### bad ###"] * 5, [1, 0] * 5)
    words = toxicity.fit([b"a b", b"idiot c"] * 5, [0, 1] * 5)
    texts = [(t or "").encode() for _, t in PAIRS]
    for out, scores in ((quality.score_documents(repeats, net), net.score(texts)), (toxicity.score_documents(repeats, words), words.score(texts)[0])):
        want = Counter((i, round(float(s), 4)) for (i, _), s in zip(PAIRS, scores, strict=True))
        assert Counter((r.doc_id, round(r.score, 4)) for r in out.collect()) == want
    got = Counter((r.doc_id, r.payload_sha256) for r in media.media_features(media.store_documents(repeats)).collect())
    assert got == Counter((i, hashlib.sha256(media.padded(t)).hexdigest()) for (i, _), t in zip(PAIRS, texts, strict=True))


def test_first_stage_of_the_pipeline(spark, data, repeats):
    """An empty table stays empty; without labels every score is 0.5, and all rows stay as they are."""
    assert corpus_pipeline.quality_classifier(spark, repeats.limit(0), data).count() == 0
    none = quality.quality_network(repeats, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert Counter(map(tuple, quality.keep_quality(repeats, none).collect())) == Counter(map(tuple, repeats.collect()))
